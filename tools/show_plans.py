"""Print ``explain("formatted")`` for registered queries.

Usage: python tools/show_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")


def main() -> None:
    from topicscope.plans.registry import QUERIES
    from topicscope.session import local_session

    sf = sys.argv[1]
    spark = local_session(8, 8)
    for name in sys.argv[2:]:
        print(f"===== {name}")
        QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
