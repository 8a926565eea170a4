import duckdb
import pytest

from captide.llm import queries
from tests.conftest import DATA

COLUMNS = {
    "p1_found": [("video_id", "string"), ("start_ms", "bigint"), ("end_ms", "bigint")], "p2_found": [("video_id", "string"), ("seg_idx", "bigint"), ("lang", "string")],
    "p3_found": [("id_a", "string"), ("id_b", "string")], "p5_found": [("control_id", "string"), ("gold_id", "string")], "p7_found": [("scope", "string"), ("item_key", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_with_the_columns_asked_for(spark, name):
    df = queries.queries()[name](spark, f"{DATA}/sf0.001")
    rows = df.count()
    assert rows > 0 or name in ("p3_found", "p7_found")  # two documents are flagged here, of no word in common
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        if name != "p8_ids":
            assert df.distinct().count() == rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    d = f"{DATA}/sf0.001"
    c = duckdb.connect()
    for t in ("compot_recall_controls", "compot_gold"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    assert sorted(map(tuple, queries.queries()[name](spark, d).collect())) == sorted(c.sql(queries.oracle_sql()[name]).fetchall())
