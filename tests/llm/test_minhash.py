"""Near duplicates against brute force; components against union-find."""

import random
import re

from topicscope.llm.minhash import components, near_duplicates


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_matches_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aBcdÉ") for _ in range(r.randint(1, 4)))
    texts = [None, "", "  ", "one", "ONE", "one two", "one two three four", "One two three four"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(5, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            texts.append(r.choice([" ", "\n"]).join(copy))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int")
    got = sorted(map(tuple, near_duplicates(docs).collect()))
    assert got == brute(texts)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (3, 4), (4, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in [7, *range(200, 260)]} == {7} and got[4] == got[3] == 3


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    got = near_duplicates(spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (9, "a b c d e")], schema)).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, False), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_dense_group_around_the_threshold(spark):
    """Copies of one text whose similarities lie on both sides of the limit."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(140)]
    texts = []
    for i in range(90):
        copy = list(base)
        for at in r.sample(range(140), i % 9):
            copy[at] = f"e{r.randrange(6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert 3 < len({c for _, _, c, _ in want}) < 80
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want


def test_pipeline_stage_takes_five_words(spark):
    """The stage against a five-word brute force, on pairs that only four words link."""
    from corpus_pipeline import drop_near_duplicates

    r = random.Random(5)
    texts = ["one", "one", "a b c d", "A b c d", ""]
    for i in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(40, 120))]
        copy = list(base)
        for at in r.sample(range(len(base)), max(1, len(base) * (i % 5) // 100)):
            copy[at] = "x"
        texts += [" ".join(base), " ".join(copy)]

    def kept(k):
        sets, root = [], list(range(len(texts)))
        for t in texts:
            w = t.lower().split()
            sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(sets):
            for j in range(i):
                if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
        return [i for i in range(len(texts)) if find(i) == i]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(x.doc_id for x in drop_near_duplicates(spark, docs, "").collect())
    assert kept(4) != kept(5) and got == kept(5)
