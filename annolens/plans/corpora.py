"""Queries over documents, labels, embeddings and orders: splits, accuracies, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolens.functions import strings
from annolens.operators import datasets, metrics, pivots, similarity
from annolens.plans import views
from annolens.plans.boxes import _six
from annolens.plans.views import registry
from annolens.sources.folders import scratch

QUERIES, ORACLE_SQL, query = registry()


_U = "(('0x' || substr(md5('0 ' || {id}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_U.format(id='doc_id')}, doc_id) <= round_even(count(*) OVER () * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_random(spark, sf_dir):
    return datasets.quota_split(views.table(spark, sf_dir, "documents").select("doc_id"), 0.2, "doc_id")


@query(f"SELECT doc_id, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.9 + 0.05 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_U.format(id='doc_id')} AS u FROM documents)")
def split_weighted3(spark, sf_dir):
    return datasets.weighted_split(views.table(spark, sf_dir, "documents").select("doc_id"), [("train", 0.9), ("val", 0.05), ("test", 0.05)], "doc_id")


@query(f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_U.format(id='doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.8) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_per_class(spark, sf_dir):
    return datasets.quota_split(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), 0.8, "doc_id", by=["lang"], floor=True)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def binary_confusion_labels(spark, sf_dir):
    return views.table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    """SELECT round(avg(a), 6) AS top1, round(avg(b), 6) AS topk FROM (SELECT vec_id, max(CASE WHEN n = 1 AND cls = label THEN 1 ELSE 0 END) AS a, max(CASE WHEN cls = label THEN 1 ELSE 0 END) AS b FROM (
    SELECT vec_id, label, cls, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS n FROM (SELECT vec_id, label, CAST(i.range AS INTEGER) AS cls, CAST(embedding[i.range + 1] AS DOUBLE) AS score FROM embeddings, range(64) i)) WHERE n <= 5 GROUP BY vec_id)"""
)
def topk_accuracy(spark, sf_dir):
    """The coordinates as class scores."""
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("cls", "s")).withColumn("score", F.col("s").cast("double"))
    return _six(metrics.top_k_accuracy(rows, 5, "vec_id", "label"), "top1", "topk")


_SCORED = """v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), n AS (SELECT vec_id, label, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS e FROM v),
scored AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(n.e, q.e), 6) AS score FROM n, (SELECT * FROM n WHERE vec_id % 20 = 0) q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 30)"""


def _search(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors, queries


@query("SELECT query_id, vec_id, score, rank FROM top WHERE score >= 0.1", _SCORED)
def similarity_topk(spark, sf_dir):
    """The feature: the 30 most similar vectors of every vector whose id is divisible by 20, from a score of 0.1."""
    return similarity.search(*_search(spark, sf_dir), k=30, least=0.1)


@query("SELECT query_id, vec_id, score, rank FROM top WHERE score >= 0.1", _SCORED)
def similarity_pivots(spark, sf_dir):
    """The same through an index that leaves vectors out by the triangle inequality."""
    vectors, queries = _search(spark, sf_dir)
    path = scratch(spark)
    pivots.build(vectors, path)
    found, _ = pivots.search(pivots.opened(spark, path), queries, 30)
    return found.where("score >= 0.1")


@query("SELECT query_id, count(*) FILTER (1 - score < 0.8) AS count, coalesce(list(vec_id ORDER BY rank) FILTER (1 - score < 0.8), []) AS neighbours FROM top GROUP BY query_id", _SCORED)
def similarity_index(spark, sf_dir):
    return similarity.similarity_index(similarity.search(*_search(spark, sf_dir), k=30), 0.8)


@query("SELECT doc_id, lang, source FROM documents WHERE lang LIKE 'd%' AND n_chars > 500")
def sql_filter(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return similarity.sql_filter(docs, "WHERE lang LIKE 'd%' AND n_chars > 500").select("doc_id", "lang", "source")


@query("SELECT lower(trim(category)) AS category, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS category FROM pages) WHERE trim(category) <> '' GROUP BY 1")
def category_frequency(spark, sf_dir):
    return datasets.category_frequency(views.table(spark, sf_dir, "pages"), "url")


@query("SELECT page_id, regexp_replace(url, '[|@#!¡·$€%&()=?¿^*;:,¨`><+]', '_', 'g') AS cleaned, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS ident, '''' || replace(url, '''', '''''') || '''' AS quoted FROM pages")
def string_cleanup(spark, sf_dir):
    u = F.col("url")
    return views.table(spark, sf_dir, "pages").select("page_id", strings.clean(u).alias("cleaned"), strings.identifier(u).alias("ident"), strings.quoted(u).alias("quoted"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, (ceil(CAST(props ->> '$.k' AS BIGINT) / 32.0) * 32)::INTEGER AS padded FROM events")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return views.table(spark, sf_dir, "events").select("event_id", k.alias("k"), strings.divisible(k, 32).alias("padded"))
