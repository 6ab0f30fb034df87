"""Ids that are texts, columns that cannot be hashed, and what an operator leaves behind."""

from pyspark.sql import functions as F

from annolens.llm import line_runs, suffix_match

PLAIN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak"


def test_items_with_text_ids(spark):
    docs = spark.createDataFrame([("d1", f"so {PLAIN} it is"), ("d2", "nothing")], "doc_id string, text string")
    bench = spark.createDataFrame([("x/2", PLAIN), ("x/10", PLAIN), (None, PLAIN)], "item_id string, text string")
    got = {r.doc_id: (r.items, r.n_hit, r.longest) for r in suffix_match.matches(docs, bench).collect()}
    assert got == {"d1": (["x/10", "x/2"], 18, 18), "d2": ([], 0, 0)}


def test_line_dedup_with_a_map_column_in_both_ways(spark):
    rows = [(i, "same line\nown %d" % i) for i in range(12)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    for keys in (100_000, 0):
        out = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.m["k"]) for r in line_runs.drop_frequent(docs, broadcast_keys=keys).collect()}
        assert out == {**{i: (f"own {i}", 2, 1, i) for i in range(12)}, 99: ("", 1, 0, 99)}


def test_line_dedup_leaves_no_table_and_no_setting(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, "a line\nanother") for i in range(11)], "doc_id long, text string")
    assert line_runs.drop_frequent(docs).where("n_dropped = 2").count() == 11
    assert {t.name for t in spark.catalog.listTables()} == before
    assert spark.conf.get(line_runs.ORDERED, None) in (None, "false")


def test_a_hot_semi_join_reads_its_rows_once(spark):
    """pipeline: rows of hot keys that the right side has not are joined with nothing."""
    from annolens.llm import _common

    left = spark.range(6000).selectExpr("id % 3 AS k", "id")
    found = _common.join_hot(left, spark.createDataFrame([(1,), (7,)], "k long"), "k", "left_semi")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("LeftSemi") == 3  # hot keys of the right side, other rows, hot rows
    assert found.count() == 2000 and {r.k for r in found.select("k").distinct().collect()} == {1}


def test_a_hot_join_joins_its_rows_once(spark):
    """pipeline: no left-semi join gives the rows of hot keys before they are joined."""
    from annolens.llm import _common

    left = spark.range(6000).selectExpr("nullif(id % 4, 3) AS k", "id")
    right = spark.createDataFrame([(1, "x"), (7, "y")], "k long, what string")
    for how in ("inner", "left"):
        found = _common.join_hot(left, right, "k", how)
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
        assert plan.count("LeftSemi") == 1  # hot keys of the right side
        plain = left.join(right, "k", how)
        assert found.columns == plain.columns and sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
