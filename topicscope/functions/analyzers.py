"""Named tokenizers: Column -> Column functions that a model is given by name.

A tokenizer maps a text column to ``array<string>``, in text order.  Models keep its
name in their configuration, so a saved model loads in any session that has
registered the same name; an unknown name is an error, never a silent default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize

Tokenizer = Callable[[Column], Column]

DEFAULT = "word"


def whitespace_words(text: Column) -> Column:
    """Lower-cased runs of anything but blanks and line ends."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), 0)


_TOKENIZERS: dict[str, Tokenizer] = {DEFAULT: tokenize, "whitespace": whitespace_words}


def register_tokenizer(name: str, tokenizer: Tokenizer, replace: bool = False) -> None:
    """Make ``tokenizer`` known as ``name`` in this session."""
    if not replace and _TOKENIZERS.get(name, tokenizer) is not tokenizer:
        raise ValueError(f"a tokenizer named {name!r} is registered already")
    _TOKENIZERS[name] = tokenizer


def tokens_of(text: Column | str, name: str | None = None) -> Column:
    """The tokens of ``text`` by the tokenizer registered as ``name``."""
    name = name or DEFAULT
    if name not in _TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; registered: {sorted(_TOKENIZERS)}")
    return _TOKENIZERS[name](F.col(text) if isinstance(text, str) else text)
