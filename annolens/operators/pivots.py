"""An index of vectors by pivots: exact nearest neighbours by cosine, with vectors left out that the triangle inequality rules out.

Some vectors, chosen by hash, are pivots; every vector is kept with its nearest pivot and the angle to it,
partitioned by pivot. The angle of a query and a vector is at least the difference of their angles to the
pivot, so once a query's k-th neighbour so far is known, whole partitions and rings of the others go unread.
The more vectors gather around pivots, the more goes unread; vectors without any structure leave little out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolens.functions.overlap import dot
from annolens.operators import blocks
from annolens.operators.datasets import hash_unit
from annolens.operators.similarity import normalized
from annolens.sources.folders import written

PIVOTS = 64
ROUNDING = 1e-6
SLACK = 1e-9


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def choose(vectors: DataFrame, pivots: int = PIVOTS, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """One row: the first ``pivots`` vectors by hash, as an array of (pivot, p)."""
    first = normalized(vectors, vector).orderBy(hash_unit(F.lit(seed), F.col(key)), key).limit(pivots)
    numbered = first.withColumn("pivot", F.row_number().over(Window.orderBy(key)) - 1)  # at most ``pivots`` rows
    return numbered.agg(F.sort_array(F.collect_list(F.struct("pivot", F.col(vector).alias("p")))).alias("pivots"))


def build(vectors: DataFrame, path: str, pivots: int = PIVOTS, key: str = "vec_id", vector: str = "embedding") -> None:
    """Write the index: ``path``/pivots, and ``path``/vectors (key, unit vector, angle) partitioned by pivot. Vectors of length 0 have no direction and stay out."""
    chosen = written(choose(vectors, pivots, key, vector))
    chosen.write.mode("overwrite").parquet(f"{path}/pivots")
    unit = normalized(vectors, vector).select(key, vector).where(dot(F.col(vector), F.col(vector)) > 0)
    near = F.array_max(F.transform("pivots", lambda p: F.struct(dot(p["p"], F.col(vector)).alias("c"), p["pivot"].alias("pivot"))))
    placed = unit.join(F.broadcast(chosen)).withColumn("m", near).select(key, vector, _angle(F.col("m.c")).alias("angle"), F.col("m.pivot").alias("pivot"))
    placed.write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/vectors")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pivots, vectors) of an index."""
    return spark.read.parquet(f"{path}/pivots"), spark.read.parquet(f"{path}/vectors")


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(query, key, score to 6 digits, rank) of the ``k`` most similar vectors, as ``similarity.search`` gives them, and (query, compared): how many vectors each was compared with.

    First a query's nearest partitions that hold k vectors together are read; the k-th angle there bounds what is read of the others.
    """
    chosen, vectors = index
    asked = normalized(queries, vector).select(query_key, F.col(vector).alias("__q"))
    stats = vectors.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("most"), F.min("angle").alias("least"))
    angles = asked.join(F.broadcast(chosen)).select(query_key, F.explode(F.transform("pivots", lambda p: F.struct(p["pivot"].alias("pivot"), _angle(dot(p["p"], F.col("__q"))).alias("to")))).alias("x")).select(query_key, "x.*")
    order = Window.partitionBy(query_key).orderBy("to", "pivot")  # one row a pivot
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = written(angles.join(F.broadcast(stats), "pivot").withColumn("before", before))

    ring = F.abs(F.col("angle") - F.col("to")) <= F.col("limit")
    chunks = written(blocks.chunked_by(vectors, "pivot", blocks.VECTORS, "rows", key, vector, "angle"))
    nearest = blocks.nearest(k, "dot", 6, vectors.schema[key].dataType, queries.schema[query_key].dataType, True)

    def scored(some: DataFrame) -> DataFrame:
        """Those of ``some`` (query, pivot, to, limit) that may be among the k nearest of the vectors within limit."""
        few = blocks.chunked_by(some.join(asked, query_key), "pivot", blocks.QUERIES, "asked", query_key, "__q", "to", "limit")
        found = chunks.join(few, "pivot").select(F.explode(nearest("rows", "asked")).alias("n"))
        return found.select(F.col("n.query").alias(query_key), F.col("n.key").alias(key), F.round("n.value", 6).alias("score"))

    n = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    first = held.where(F.col("before") < k).select(query_key, "pivot", "to", F.lit(float("inf")).alias("limit"))
    near = written(scored(first))
    kth = near.withColumn("rank", n).where(F.col("rank") == k).select(query_key, (_angle(F.col("score") - ROUNDING) + SLACK).alias("limit"))
    rest = held.where(F.col("before") >= k).join(kth, query_key).where((F.col("to") - F.col("most") <= F.col("limit")) & (F.col("least") - F.col("to") <= F.col("limit")))
    rest = rest.select(query_key, "pivot", "to", "limit")
    every = near.union(scored(rest))
    looked = vectors.select("pivot", "angle").join(first.union(rest), "pivot").where(ring)
    return every.withColumn("rank", n).where(F.col("rank") <= k), looked.groupBy(query_key).agg(F.count("*").alias("compared"))
