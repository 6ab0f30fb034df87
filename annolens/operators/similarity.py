"""Similarity search over embeddings (id, vector), exact and in blocks of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions.overlap import dot, unit
from annolens.operators import blocks

QUERY_ROWS = 10_000


def normalized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn(vector, unit(F.col(vector)))


def search(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """The ``k`` most similar vectors of each query by cosine, then those of at least ``least``.

    ``queries`` (query_key, vector) of any number are searched in blocks of about QUERY_ROWS, dealt by
    the hash of their key; each block is broadcast, and every chunk of vectors keeps its own ``k`` best
    before the shuffle.
    """
    known, asked = normalized(vectors, vector).select(key, vector), normalized(queries, vector).select(query_key, F.col(vector).alias("__q"))
    n = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    scored = lambda some, few: some.join(F.broadcast(few)).select(query_key, key, F.round(dot(F.col(vector), F.col("__q")), 6).alias("score"))
    top = _searched(known, asked, scored, k, "dot", 6, "score", key, vector, query_key).withColumn("rank", n).where(F.col("rank") <= k)
    return top if least is None else top.where(F.col("score") >= least)


def _searched(known: DataFrame, asked: DataFrame, scored, k: int, metric: str, digits: int, name: str, key: str, vector: str, query_key: str) -> DataFrame:
    """(query, key, value) among which are the ``k`` nearest of each query: those of every chunk of vectors.

    Chunks of queries meet chunks of vectors, and ``blocks.nearest`` names the candidates of each two with
    their exact values. Rows that it has no arithmetic for (null, of odd length, with null or non-finite
    entries) go through ``scored``, the plain expression over single rows.
    """
    wide = asked.agg(F.max(F.size("__q"))).first()[0] or 0
    good = lambda c: F.coalesce((F.size(c) == wide) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < 1e150)), F.lit(False))
    n_known, odd_known = known.agg(F.count("*"), F.count(F.when(~good(vector), 1))).first()
    n_asked, odd_asked = asked.agg(F.count("*"), F.count(F.when(~good("__q"), 1))).first()
    chunks = blocks.chunked(known.where(good(vector)), n_known, key, vector, blocks.VECTORS)
    block = F.pmod(F.xxhash64(query_key), F.lit(max(1, -(-n_asked // QUERY_ROWS))))
    near = blocks.nearest(k, metric, digits, known.schema[key].dataType, asked.schema[query_key].dataType)
    parts = []
    for i in range(max(1, -(-n_asked // QUERY_ROWS))):
        some = blocks.chunked(asked.where(good("__q") & (block == i)), QUERY_ROWS, query_key, "__q", blocks.QUERIES).withColumnRenamed("rows", "asked")
        both = chunks.join(F.broadcast(some)).select(F.explode(near("rows", "asked")).alias("n"))
        parts.append(both.select(F.col("n.query").alias(query_key), F.col("n.key").alias(key), F.round("n.value", digits).alias(name)))
    if odd_known:
        parts.append(scored(known.where(~good(vector)), asked))
    if odd_asked:
        parts.append(scored(known.where(good(vector)), asked.where(~good("__q"))))
    return reduce(DataFrame.union, parts)


def similarity_index(found: DataFrame, max_distance: float, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(query, count, neighbours): those of ``search`` closer than ``max_distance``."""
    near = F.when(1 - F.col("score") < max_distance, F.struct("rank", key))
    return found.groupBy(query_key).agg(F.count(near).alias("count"), F.transform(F.sort_array(F.collect_list(near)), lambda x: x[key]).alias("neighbours"))


def mean_vector(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the element-wise mean, for queries made of several vectors."""
    return vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def sql_filter(df: DataFrame, clause: str, view: str = "table_view") -> DataFrame:
    """``SELECT * FROM df`` followed by ``clause``."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"SELECT * FROM {view} {clause}")


def load_or_build_index(spark, path: str, build) -> DataFrame:
    """The saved vectors at ``path``; where there are none, those of ``build()`` are saved first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int, metric: str = "cosine", where: str | None = None, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query, key, score or distance, rank): the ``limit`` nearest vectors that meet ``where``, by cosine, dot product (score) or l2 (distance).

    Queries are searched in blocks of about QUERY_ROWS, each broadcast.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"no such metric: {metric}")
    some = vectors.where(where) if where else vectors
    asked = queries.select(query_key, F.col(vector).alias("__q"))
    if metric == "cosine":
        some, asked = normalized(some, vector), normalized(asked, "__q")
    name = "distance" if metric == "l2" else "score"
    apart = F.sqrt(F.aggregate(F.zip_with(vector, "__q", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    value = F.round(apart if metric == "l2" else dot(F.col(vector), F.col("__q")), 5)
    n = F.row_number().over(Window.partitionBy(query_key).orderBy(F.asc(name) if metric == "l2" else F.desc(name), key))
    scored = lambda some, few: some.join(F.broadcast(few)).select(query_key, key, value.alias(name))
    found = _searched(some.select(key, vector), asked, scored, limit, "l2" if metric == "l2" else "dot", 5, name, key, vector, query_key)
    return found.withColumn("rank", n).where(F.col("rank") <= limit)
