"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        r = db.sql(sql)
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())


def test_plans_have_no_cartesian_product(spark):
    for name, q in catalogue.queries().items():
        assert "CartesianProduct" not in q(spark, SF)._jdf.queryExecution().toString(), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_lcom4_reads_every_method(spark, monkeypatch):
    from plumbline.plans import code_queries

    monkeypatch.setattr(code_queries.C, "lcom4", lambda methods: methods)
    assert code_queries.lcom4(spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
