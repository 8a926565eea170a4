"""Queries that did less than the whole job."""

import random

from captide.operators import scenes
from captide.plans import catalog

SCENES = "scan_id string, video_id string, scene_id string, categories array<string>, context_start_ms long, context_end_ms long"


def tables(spark, path, **data):
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_scene_of_another_category_hides_no_vanished_event(spark, tmp_path, rows):
    data = [
        ("s1", "v", "a", ["violence", "gambling"], 1000, 2000),
        ("s2", "v", "b", ["gambling"], 4999, 6000),  # within 3 s of a
        ("s2", "v", "c", ["violence"], 5001, 6000),  # not within 3 s of a
        ("s3", "w", "d", None, 0, 10),
        (None, "w", "e", [], 0, 10),
    ]
    d = tables(spark, tmp_path, draft_scenes=(data, SCENES))
    got = {(r.scene_id, r.category) for r in catalog.queries()["vanished_events"](spark, d).collect()}
    assert got == {("a", "violence"), ("c", "violence"), ("d", ""), ("e", "")}


def near(a, b, pad=2000):
    return a[2] <= b[3] + pad and a[3] >= b[2] - pad


def test_first_is_kept_and_rescues_are_held_against_accepted_ones(spark):
    r = random.Random(11)
    make = lambda n: [(r.choice(["x", "y", None]), i, s := r.randint(0, 900) * 100, s + r.choice([0, 500, 9000])) for i in range(n)]
    data, known = make(300), [k for k in make(10) if k[0]]
    by_start = lambda rows: sorted(rows, key=lambda x: (x[2], x[1]))
    first, rescued = [], []
    for x in by_start(data):
        if not any(y[0] == x[0] and near(y, x) for y in first):
            first.append(x)
    for x in by_start(x for x in data if x[0]):
        if not any(y[0] == x[0] and near(y, x) for y in known + rescued):
            rescued.append(x)
    schema = "category string, i int, start_ms long, end_ms long"
    df, k = spark.createDataFrame(data, schema), spark.createDataFrame(known, schema)
    assert sorted(map(tuple, scenes.keep_first(df, ["category"], "i").collect()), key=str) == sorted(first, key=str)
    assert sorted(map(tuple, scenes.accepted(df.where("category IS NOT NULL"), k, ["category"], "i").collect())) == sorted(rescued)


def test_rescued_labels_are_held_against_each_other(spark, tmp_path):
    gold = [("a", "v", 9000, "main"), ("b", "v", 30000, "main"), ("c", "v", 35000, "main"), ("d", "v", 38000, "main"), ("e", "w", 35000, "main")]
    d = tables(spark, tmp_path, draft_scenes=([("s", "v", "x", ["violence"], 1000, 5000)], SCENES), compot_gold=(gold, "gold_id string, video_id string, start_ms long, attention string"))
    assert {r.gold_id for r in catalog.queries()["accepted_rescues"](spark, d).collect()} == {"b", "d", "e"}
