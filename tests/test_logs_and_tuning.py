"""Replayed batches, drawn parents, readers of long documents, ranks by value."""

import json
import random
import time

from pyspark.sql import functions as F

from annolens.operators import datasets, pivots, runlog, similarity, suppression
from annolens.sources import annotations
from annolens.streaming import metrics_log


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *v: spark.createDataFrame([(c, float(x)) for c, x in v], "cls string, total double")
    metrics_log.append_batch(rows(("a", 1), ("b", 2)), 0, path)
    metrics_log.append_batch(rows(("a", 5)), 1, path)
    metrics_log.append_batch(rows(("a", 5)), 1, path)
    metrics_log.append_batch(rows(("a", 1), ("b", 2)), 0, path)
    got = sorted(map(tuple, metrics_log.read_log(spark, path, "cls string, total double").select("cls", "total", "batch_id").collect()))
    assert got == [("a", 1.0, 0), ("a", 5.0, 1), ("b", 2.0, 0)]


def test_a_stream_started_again_logs_nothing_twice(spark, tmp_path):
    source = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, cls int")
    source.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        count = lambda rows: rows.groupBy("cls").agg(F.count("*").alias("n"))
        metrics_log.appended(stream, str(tmp_path / "log"), count).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.cls, r.n) for r in metrics_log.read_log(spark, str(tmp_path / "log"), "cls int, n long").collect()) == [(0, 10), (1, 10), (2, 10)]


PARENTS = "fitness double, a double, b double"


def test_children_lie_around_their_parents(spark):
    parents = spark.createDataFrame([(1.0, 0.1, 5.0), (0.9, 0.2, 5.0), (0.0, 9.0, 5.0)], PARENTS)
    values = [{r.gene: r.value for r in runlog.crossover(parents, ["a", "b"], 9, 0.2, seed).collect()} for seed in range(12)]
    # the worst parent weighs 1e-6, so it is hardly ever drawn
    assert all(0.08 <= v["a"] <= 0.22 for v in values) and len({v["a"] for v in values}) > 6
    assert all(5 - 0.2 * 0.1 <= v["b"] <= 5 + 1.2 * 0.1 for v in values)
    one = runlog.crossover(parents.limit(1), ["a", "b"]).collect()
    assert {r.gene for r in one} == {"a", "b"}


def test_mutation_changes_something_within_bounds(spark):
    child = spark.createDataFrame([("a", 0.5), ("b", 3.0)], "gene string, value double")
    seen = [{r.gene: r.value for r in runlog.mutated(child, {"a": (0.0, 0.6), "b": (0.0, 4.0, 0.5)}, seed=s).collect()} for s in range(12)]
    assert all(0 <= v["a"] <= 0.6 and 0 <= v["b"] <= 4 and v != {"a": 0.5, "b": 3.0} for v in seen)
    assert {r.value for r in runlog.mutated(child, {"a": (0.0, 0.1), "b": (3.5, 4.0)}, chance=0.0).collect()} == {0.1, 3.5}


def test_a_document_of_many_annotations(spark, tmp_path):
    images = [{"id": i, "height": 10.0, "width": 20.0, "file_name": f"{i}.jpg"} for i in range(5000)]
    images.append({"id": 7, "height": 10.0, "width": 40.0, "file_name": "again.jpg"})  # of a repeated id the last counts
    boxes = [{"image_id": i % 5001, "category_id": 1 + i % 3, "bbox": [float(i % 10), 0.0, 1.0 + i // 5001, 1.0], "iscrowd": False} for i in range(100_000)]
    (tmp_path / "doc.json").write_text(json.dumps({"images": images, "annotations": boxes}))
    began = time.perf_counter()
    rows = annotations.read_boxes(spark, str(tmp_path), whole=True)
    assert rows.count() == len({(b["image_id"], b["category_id"], *b["bbox"]) for b in boxes if b["image_id"] < 5000})
    assert time.perf_counter() - began < 60
    again = rows.where("image_id = 7").select("file_name", F.round(F.col("w") * 40).alias("w")).distinct().collect()
    assert {r.file_name for r in again} == {"again.jpg"} and {r.w for r in again} == {float(1 + i) for i in range(20)}


def test_images_meet_boxes_of_their_own_document(spark, tmp_path):
    for k, width in (("a", 10.0), ("b", 20.0)):
        (tmp_path / f"{k}.json").write_text(json.dumps({"images": [{"id": 1, "height": 10.0, "width": width, "file_name": k}], "annotations": [{"image_id": 1, "category_id": 1, "bbox": [0.0, 0.0, 5.0, 5.0], "iscrowd": False}, {"image_id": None, "category_id": 1, "bbox": [0.0, 0.0, 5.0, 5.0], "iscrowd": False}]}))
    (tmp_path / "c.json").write_text(json.dumps({"images": None, "annotations": [{"image_id": 1, "category_id": 1, "bbox": [0.0, 0.0, 5.0, 5.0], "iscrowd": False}]}))
    assert sorted((r.file_name, r.w) for r in annotations.read_boxes(spark, str(tmp_path)).collect()) == [("a", 0.5), ("b", 0.25)]


def test_ranks_by_value_with_a_hot_value(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, 1.5 if rng.random() < 0.4 else rng.random() * 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "image_id long, v double")
    whole = {r.image_id: r["__r"] for r in datasets.value_rank(df, "v", "image_id").collect()}
    monkeypatch.setattr(datasets, "BUCKET_ROWS", 100)
    parts = {r.image_id: r["__r"] for r in datasets.value_rank(df, "v", "image_id").collect()}
    assert parts == whole and sorted(parts.values()) == list(range(1, 2001))
    order = sorted(parts, key=parts.get)
    assert [dict(rows)[i] for i in order] == sorted(v for _, v in rows)
    assert datasets.value_rank(df.limit(0), "v", "image_id").count() == 0


def test_tracks_of_a_crowded_stream(spark):
    """Many tracks in one stream, none near another but one pair."""
    rows = [(1, k, 10 + k, float(3 * (k % 60)), float(3 * (k // 60)), float(3 * (k % 60) + 1), float(3 * (k // 60) + 1)) for k in range(3000)]
    schema = "stream long, track_id long, frames long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(1, 9000, 5, 0.0, 0.0, 1.0, 1.05), (1, 9001, 5, 1.5, 1.5, 2.0, 2.0)], schema)
    left, right = suppression.remove_duplicate_tracks(a, b)
    assert left.count() == 3000 and [r.track_id for r in right.collect()] == [9001]


def test_pivots_give_the_same_neighbours_and_read_less(spark, tmp_path):
    rng = random.Random(0)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in centres[i % 40]]) for i in range(3000)] + [(3000, [0.0] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 50 = 0 AND vec_id < 3000").withColumnRenamed("vec_id", "query_id")
    pivots.build(vectors, str(tmp_path / "index"))
    found, compared = pivots.search(pivots.opened(spark, str(tmp_path / "index")), queries, 10)
    got = sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect())
    assert got == sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in similarity.search(vectors, queries, 10).collect())
    assert compared.agg(F.avg("compared")).first()[0] < 0.25 * len(rows)
    few, _ = pivots.search(pivots.opened(spark, str(tmp_path / "index")), queries.limit(1), 5000)
    assert few.count() == 3000


def test_a_report_may_begin_with_a_byte_order_mark(spark, tmp_path):
    from annolens.sources import reports

    rows = spark.createDataFrame([("spot", 3), ("splash", 4)], "name string, n int")
    for mark in (True, False):
        path = str(tmp_path / str(mark))
        reports.write_csv(rows, path, mark=mark)
        (file,) = [f for f in (tmp_path / str(mark)).iterdir() if f.suffix == ".csv"]
        assert file.read_bytes().startswith(b"\xef\xbb\xbfname,n" if mark else b"name,n")
        assert sorted(map(tuple, reports.read_csv(spark, path).select("name", "n").collect())) == [("splash", 4), ("spot", 3)]


def test_pivots_compare_in_chunks(spark, tmp_path, monkeypatch):
    from annolens.operators import blocks

    monkeypatch.setattr(blocks, "VECTORS", 20)
    monkeypatch.setattr(blocks, "QUERIES", 4)
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)] if i % 3 else [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    pivots.build(vectors, str(tmp_path / "index"), 5)
    found, _ = pivots.search(pivots.opened(spark, str(tmp_path / "index")), queries, 10)
    assert "ArrowEvalPython" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, similarity.search(vectors, queries, 10).select(*found.columns).collect()))
