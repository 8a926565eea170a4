"""Every query against its SQL form in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from captide.plans import catalog
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


def canonical(df):
    def text(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "~"
        if hasattr(x, "item") and not isinstance(x, (list, tuple)):
            x = x.item() if getattr(x, "size", 1) == 1 else list(x)
        if isinstance(x, bool):
            return str(x).lower()
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    cols = sorted(df.columns)
    return cols, sorted("|".join(map(text, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert canonical(catalog.queries()[name](spark, SMALL).toPandas()) == canonical(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
