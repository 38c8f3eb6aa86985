"""The combined automaton against plain regular expressions."""

import hashlib
import random
import re

import numpy as np

from topicscope.llm import secret_scan as S


def brute(text):
    out = []
    for k, r in enumerate(S.RULES):
        for m in re.finditer(r.find, text or "", re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "\n", "é", "ſecret", "deadbeef", "0123456789abcdef", "ABCDEFGHIJKL", "ghp_", "a1B2" * 9, "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "eyJ", ".", "x", "/", "-", "(", "日"]
    return [None, ""] + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_spans_match_plain_expressions(spark):
    rows = texts(1, 500) + ["a" * 5000 + " token=abcdefgh1 " + "f" * 3000, "x" * 2000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    for x in S.secret_report(docs).collect():
        want = [(S.RULES[k].kind, s, e) for s, k, e in brute(rows[x.doc_id])]
        say = lambda w: ",".join(f"{k}:{s}:{e}" for k, s, e in w)
        base = [w for w in want if w[0] in ("assign", "access", "hex")]
        assert x.spans == say(want) and x.base_sha256 == hashlib.sha256(say(base).encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(w[0] == k for w in base) for k in ("assign", "access", "hex"))


def test_redaction_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1 ok", 7), (2, "clean", 8), (3, None, 9)], "doc_id long, text string, kind int")
    assert sorted(map(tuple, S.redacted(docs).collect())) == [(1, "[assign] ok", 7), (2, "clean", 8), (3, None, 9)]
    assert S.secret_report(docs.limit(0)).collect() == []


def test_automaton_is_minimal_and_complete():
    auto = S.compile_rules(("ab", "cb"))
    assert len(auto.accepts) == 5 and auto.resets[ord("x")] and not auto.resets[ord("a")]
    assert [h for _, _, h in zip(*S.lanes_hit(auto, np.frombuffer(b"xaabx cb", np.uint8), np.array([0, 6, 8])), strict=True)] == [1, 2]


def test_sql_twin(spark):
    import duckdb

    rows = texts(2, 200)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
    cur = con.execute(S.oracle_sql())
    names = [d[0] for d in cur.description]
    got = S.secret_report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
