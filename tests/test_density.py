import numpy as np
from pyspark.sql import functions as F

from .conftest import SF_SMALL


def test_grid_clusters_find_blobs_and_noise(spark):
    from topicscope.operators.density import grid_clusters

    rng = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [5.0, 5.0], [0.0, 8.0]])
    sizes = [300, 200, 100]
    pts = [c + rng.normal(scale=0.3, size=(n, 2)) for c, n in zip(centres, sizes)]
    noise = rng.uniform(-20, -10, size=(5, 2))
    allp = np.vstack(pts + [noise])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(allp)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    lab = {r["id"]: r["label"] for r in grid_clusters(df, 0.5, 5).collect()}
    # the three blobs are three clusters numbered by size; isolated points are noise
    start = 0
    for want, n in enumerate(sizes):
        got = [lab[i] for i in range(start, start + n)]
        top = max(set(got), key=got.count)
        assert top == want
        assert got.count(top) > 0.8 * n
        start += n
    assert all(lab[i] == -1 for i in range(start, start + 5))


def test_embedding_model(spark, scratch):
    from topicscope.plans.embedding_topics import EmbeddingTopicModel
    from topicscope.sources.tables import read_table

    emb = read_table(spark, SF_SMALL, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    m = EmbeddingTopicModel(n_components=3, min_points=3, random_state=1).fit(emb, docs)
    n = emb.count()
    assert m.labels.count() == n
    red = m.transform(emb)
    assert {len(r["vector"]) for r in red.collect()} == {3}
    p = m.predict(emb)
    assert p.count() == n
    tv = m.topic_vectors.count()
    assert tv >= 1
    if m.names is not None and tv:
        assert all(r["name"].startswith(f"{r['label']}_") for r in m.names.collect())
    q = [float(x) for x in emb.first()["embedding"]]
    sims = m.similar_topics(q, 2).collect()
    assert len(sims) == min(2, tv) and all(r["label"] != -1 for r in sims)
    import os

    m.save(os.path.join(scratch, "emb"))
    back = EmbeddingTopicModel.load(spark, os.path.join(scratch, "emb"))
    assert sorted(map(tuple, back.predict(emb).collect())) == sorted(map(tuple, p.collect()))
    assert sorted(map(tuple, back.transform(emb).collect())) == sorted(map(tuple, red.collect()))


def test_doc_vector_model(spark, scratch):
    from topicscope.plans.embedding_topics import DocVectorTopicModel
    from topicscope.sources.tables import read_table

    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    m = DocVectorTopicModel(vector_size=8, min_points=3, n_components=3, random_state=1, cell_size=0.05).fit(docs)
    assert m.predict(docs).count() == docs.count()
    names = m.names.collect()
    assert all(len(r["name"].split("_")) <= 5 for r in names)
    assert m.query_topics(spark, "the of and", 1).count() <= 1
    import os

    m.save(os.path.join(scratch, "dv"))
    back = DocVectorTopicModel.load(spark, os.path.join(scratch, "dv"))
    assert sorted(map(tuple, back.predict(docs).collect())) == sorted(map(tuple, m.predict(docs).collect()))
