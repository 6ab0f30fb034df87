"""Every query of the library against its SQL in DuckDB."""

import math

import duckdb
import pytest

import annolens.plans.catalogue as catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_stratified_split_has_every_image_once(spark):
    rows = catalogue.QUERIES["split_stratified_multilabel"](spark, SMALL).collect()
    assert len({r.image_id for r in rows}) == len(rows)
    share = sum(r.split == "val" for r in rows) / len(rows)
    assert 0.1 < share < 0.3


def test_operating_point_is_on_the_curve(spark):
    (row,) = catalogue.QUERIES["f1_operating_point"](spark, SMALL).collect()
    assert all(0 <= v <= 1 for v in row.asDict().values() if isinstance(v, float))
