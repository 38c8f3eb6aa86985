"""Entity extraction against a brute-force greedy matcher."""

import re


def _greedy(text, phrases, max_len):
    toks = re.findall(r"[^\W]{2,}", text.lower())
    out, i = [], 0
    while i < len(toks):
        for n in range(min(max_len, len(toks) - i), 0, -1):
            p = " ".join(toks[i:i + n])
            if p in phrases:
                out.append(p)
                i += n
                break
        else:
            i += 1
    return " ".join(out)


def test_entity_text_matches_brute_force(spark):
    from topicscope.operators.entities import entity_text

    docs = spark.createDataFrame(
        [
            (1, "New York city is in New York state; new york again."),
            (2, "The heart attack and heart failure; attack heart."),
            (3, "nothing here"),
            (4, "York city York"),
        ],
        "doc_id long, text string",
    )
    phrases = ["new york", "new york city", "york", "heart attack", "heart", "city is"]
    d = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {r["doc_id"]: r["text"] for r in entity_text(docs, d, 3).collect()}
    want = {r["doc_id"]: _greedy(r["text"], set(phrases), 3) for r in docs.collect()}
    assert got == want
    assert got[1] == "new york city new york new york"
    assert got[3] == ""


def test_external_extractor_plugin(spark):
    import pandas as pd

    from topicscope.operators.entities import entity_text_with

    docs = spark.createDataFrame([(1, "Alice met Bob in Paris"), (2, None), (3, "nothing")], "doc_id long, text string")

    def capitalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(w for w in t.split() if w[:1].isupper()))

    got = {r["doc_id"]: r["text"] for r in entity_text_with(docs, capitalised).collect()}
    assert got == {1: "Alice Bob Paris", 2: "", 3: ""}


def test_entity_model_reloads_with_dictionary_and_with_extractor(spark, scratch):
    from topicscope.plans.topics import EntityTopicModel

    docs = spark.createDataFrame([(i, f"alpha beta {'gamma' if i % 2 else 'delta'} word{i % 5}") for i in range(30)], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in ("alpha", "beta", "gamma", "delta")], "phrase string")
    last = lambda s: s.str.split().str[2]
    for name, given in (("d", {"dictionary": words}), ("x", {"extractor": last})):
        m = EntityTopicModel(n_components=2, n_clusters=2, combine_kwargs={"include_abstract": False}, **given).fit(docs)
        path = f"{scratch}/{name}"
        m.save(path)
        back = EntityTopicModel.load(spark, path, extractor=given.get("extractor"))
        assert type(back) is EntityTopicModel and back.combine_kwargs == {"include_abstract": False}
        assert sorted(map(tuple, back.predict(docs).collect())) == sorted(map(tuple, m.predict(docs).collect()))


def test_trie_walk_equals_brute_force_with_and_without_broadcast(spark, monkeypatch):
    import random

    from topicscope.operators import entities as EN

    rng = random.Random(7)
    words = ["aa", "bb", "cc", "dd", "ee"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 40))) for i in range(40)] + [(99, None), (98, "")], "doc_id long, text string")
    phrases = sorted({text(rng.randrange(1, 5)) for _ in range(40)})
    d = spark.createDataFrame([(p,) for p in phrases] + [(phrases[0],)], "phrase string")
    want = {r["doc_id"]: _greedy(r["text"] or "", {p for p in phrases if len(p.split()) <= 3}, 3) for r in docs.collect()}
    for bound in (1_000_000, 0):
        monkeypatch.setattr(EN, "MAX_BROADCAST_PREFIXES", bound)
        assert {r["doc_id"]: r["text"] for r in EN.entity_text(docs, d, 3).collect()} == want
    level = {(r["n"], r["prefix"]): r["whole"] for r in EN.phrase_trie(d, 3).collect()}
    assert all(level[len(p.split()), p] for p in phrases if len(p.split()) <= 3)
    assert all(any((q + " ").startswith(p + " ") for q in phrases) for _, p in level)
