import random

import pytest

from captide.operators.periods import periods_and_gaps

SCHEMA = "k string, s long, e long, kind int"


def brute(data):
    out, by = [], {}
    for k, s, e, _ in set(data):
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, iv in by.items():
        iv.sort()
        merged = []
        for s, e in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10, 1000])
def test_against_brute_force(spark, block):
    r = random.Random(block)
    data = [(r.choice(["a", "b", None]), s := r.choice([None, *range(-60, 200)]), None if s is None else s + r.choice([-3, 0, 1, 2, 5, 40, 90]), 1) for _ in range(400)]
    data += data[:40]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["k"], "s", "e", block_ms=block)
    assert got.columns == ["k", "kind", "start_ms", "end_ms"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(data)


def test_touching_nested_and_far(spark, rows):
    data = [("x", 0, 10, 0), ("x", 10, 20, 0), ("x", 12, 13, 0), ("x", 30, 31, 0), ("x", 30, 31, 0), ("x", 10**15, 10**15 + 1, 0)]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["k"], "s", "e")) == sorted(
        [("x", "period", 0, 20), ("x", "gap", 20, 30), ("x", "period", 30, 31), ("x", "gap", 31, 10**15), ("x", "period", 10**15, 10**15 + 1)], key=lambda r: tuple((True, str(x)) for x in r)
    )


def test_empty_and_invalid(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, ["k"], "s", "e").count() == 0
    bad = spark.createDataFrame([("a", None, 3, 1), ("a", 3, None, 1), ("a", 5, 5, 1), ("a", 6, 5, 1)], SCHEMA)
    assert periods_and_gaps(bad, ["k"], "s", "e").count() == 0
