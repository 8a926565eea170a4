import random

import numpy as np
from pyspark.sql import functions as F

from captide.llm import packing, queries
from tests.conftest import DATA

SCHEMA = "id string, a long, b long, c long, extra string"


def test_limits_hold_and_nothing_is_lost(spark):
    r = random.Random(7)
    data = [(f"i{n}", r.choice([None, 0, r.randint(1, 90), 250]), r.randint(0, 9), r.randint(0, 30), "x") for n in range(700)] + [(None, 5, 1, 1, "x")]
    df = spark.createDataFrame(data + data[:50], SCHEMA)
    caps = [100, 12, 60]
    got = packing.pack(df, "id", ["a", "b", "c"], caps, shard_pieces=200).collect()
    sums = {}
    for x in got:
        t = sums.setdefault(x.container, [0, 0, 0])
        for k, v in enumerate((x.a, x.b, x.c)):
            t[k] += v
    assert all(t[k] <= caps[k] for t in sums.values() for k in range(3))
    whole = {}
    for x in got:
        t = whole.setdefault(x.id, [0, 0, 0, 0])
        t[3] += 1
        for k, v in enumerate((x.a, x.b, x.c)):
            t[k] += v
    assert {i: tuple(t[:3]) for i, t in whole.items()} == {i: (a or 0, b, c) for i, a, b, c, _ in data}
    assert all(t[3] == 1 or t[0] > 100 or t[1] > 12 or t[2] > 60 for t in whole.values())


def test_one_limit_fills_well():
    rng = np.random.default_rng(1)
    sizes = np.append(rng.integers(1, 40_000, 3000), rng.integers(1, 400, 1500))[:, None]
    at = packing.fill(sizes, np.array([70_000]))
    used = np.bincount(at, weights=sizes[:, 0])
    assert used.max() <= 70_000 and len(used) == -(-sizes.sum() // 70_000)


def test_same_result_for_one_and_more_limits():
    sizes = np.array([[5, 1], [5, 1], [3, 1], [2, 1]])
    at = packing.fill(sizes, np.array([5, 2]))
    assert len(set(at.tolist())) == 3 and at[2] == at[3]


def test_oversized_zero_and_empty(spark):
    df = spark.createDataFrame([("big", 250, 0, 0, ""), ("zero", 0, 0, 0, ""), ("minus", -4, 0, 0, "")], SCHEMA)
    got = packing.pack(df, "id", ["a"], [100]).collect()
    assert sorted((x.id, x.piece, x.a) for x in got) == [("big", 0, 100), ("big", 1, 100), ("big", 2, 50), ("minus", 0, 0), ("zero", 0, 0)]
    assert packing.pack(df.limit(0), "id", ["a"], [100]).count() == 0
    r = packing.fill_report(packing.pack(df, "id", ["a"], [100]), ["a"], [100]).collect()[0]
    assert (r.containers, r.pieces, r.a) == (3, 5, 250)


def test_instruction_batches_keep_three_limits(spark):
    out = queries.p6_instruction_batches(spark, f"{DATA}/sf0.001")
    most = out.groupBy("container").agg(*(F.sum(c).alias(c) for c in queries.LIMITS)).agg(*(F.max(c) for c in queries.LIMITS)).first()
    assert all(got <= limit for got, limit in zip(most, queries.LIMITS.values()))
    assert out.select(F.sum("segments")).first() == queries._examples(spark, f"{DATA}/sf0.001").select(F.sum("segments")).first()


def test_rows_without_id_are_spread_over_shards(spark):
    df = spark.range(3000).selectExpr("CAST(NULL AS STRING) AS id", "5L AS a", "id AS other")
    got = packing.pack(df, "id", ["a"], [50], shard_pieces=100)
    assert got.count() == 3000 and got.selectExpr("split(container, '-')[0] AS s").groupBy("s").count().agg({"count": "max"}).first()[0] < 300
