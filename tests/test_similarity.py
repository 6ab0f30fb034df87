"""Similarity search with more queries than a block holds."""

from annolens.operators import similarity
from annolens.plans import views

SMALL = "/root/testdata/sf0.001"


def test_more_queries_than_a_block(spark, monkeypatch):
    vectors = views.table(spark, SMALL, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda: sorted(map(tuple, similarity.search(vectors, queries, k=30, least=0.1).collect()))
    whole = rows()
    assert {r[0] for r in whole} == {r.query_id for r in queries.collect()}
    monkeypatch.setattr(similarity, "QUERY_ROWS", 4)
    assert rows() == whole


def test_chunks_give_what_single_rows_give(spark, monkeypatch):
    """Crowds of copies, near copies within the rounding, and vectors without arithmetic, by all measures."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from annolens.functions.overlap import dot
    from annolens.operators import blocks

    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.choice([0, 0, 3e-7]) for x in base[i % 8]]) for i in range(200)] + [(200, [0.0] * 6), (201, None), (202, [None] + [1.0] * 5), (203, [float("nan")] * 6), (204, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0 OR vec_id > 200").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(blocks, "VECTORS", 64)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    for metric, digits in (("cosine", 6), ("l2", 5), ("dot", 5)):
        known, asked = (vectors, queries) if metric != "cosine" else (similarity.normalized(vectors), similarity.normalized(queries))
        q, v = F.col("q"), F.col("embedding")
        apart = F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda s, x: s + x))
        value = F.round(apart if metric == "l2" else dot(v, q), digits)
        w = Window.partitionBy("query_id").orderBy(F.asc("value") if metric == "l2" else F.desc("value"), "vec_id")
        plain = known.crossJoin(asked.withColumnRenamed("embedding", "q")).select("query_id", "vec_id", value.alias("value")).withColumn("rank", F.row_number().over(w)).where("rank <= 7")
        got = similarity.search(vectors, queries, 7) if metric == "cosine" else similarity.vector_search(vectors, queries, 7, metric)
        text = lambda df: sorted(repr(tuple(r)) for r in df.collect())
        assert text(got) == text(plain), metric
    assert "ArrowEvalPython" in got._jdf.queryExecution().optimizedPlan().toString()
