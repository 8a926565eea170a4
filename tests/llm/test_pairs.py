"""Overlaps across splits, and nearest times, against brute force."""

import random

from captide.llm import nearest, splits
from captide.llm.words import words

SCHEMA = "id string, split string, anchor string, source_video string, source int"


def mutate(r, w):
    w = list(w)
    for _ in range(r.randint(0, 2)):
        i = r.randrange(len(w))
        kind = r.random()
        if kind < 0.4:
            w[i] = f"new{r.randint(0, 10**6)}"
        elif kind < 0.7:
            w.insert(i, f"add{r.randint(0, 10**6)}")
        elif len(w) > 6:
            del w[i]
    return w


def test_cross_split_pairs_against_brute_force(spark):
    r = random.Random(11)
    stock = "the of and to in that it was for on".split()
    data = []
    for n in range(60):
        w = [r.choice(stock) if r.random() < 0.5 else f"name{r.randint(0, 10**6)}" for _ in range(r.randint(10, 20))]
        for k in range(r.randint(1, 4)):
            text = " ".join(mutate(r, w))
            text = r.choice([text, text.upper() + "!", text.replace(" ", ",  "), text.replace("o", "о").replace("a", "а")])
            data.append((f"r{n}-{k}", r.choice(["tuning", " Tuning", "HOLDOUT ", "holdout"]), text, "v", 1))
    data += [("x", None, "a b", "v", 1), ("y", "tuning", None, "v", 1), (None, "tuning", "a b", "v", 1), ("z", "holdout", "...", "v", 1), *data[:9]]
    # stock phrases without any rare word
    data += [(f"s{i}", "tuning" if i % 2 else "holdout", "the of and to in that it was for on" + " the" * (i % 3), "v", 1) for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {tuple(x) for x in splits.cross_split_pairs(df).collect()}
    of = {s: {(i, tuple(words(a))) for i, p, a, *_ in data if i and p and a and words(a) and p.strip().lower() == s} for s in ("tuning", "holdout")}
    want = {(min(i, j), max(i, j)) for i, a in of["tuning"] for j, b in of["holdout"] if i != j and splits.edits(a, b, 2) <= 2}
    matched = {i for p in want for i in p}
    assert got == want
    report = splits.overlap_report(df).collect()
    assert {(x.split, x.overlapping) for x in report} == {(s, len(matched & {i for i, _ in of[s]})) for s in of}


def test_edits():
    assert splits.edits("a b c".split(), "b a c".split(), 2) == 2
    assert splits.edits("a b c d".split(), "x y z d".split(), 2) == 3
    assert splits.edits([], ["a"], 2) == 1


def test_places_hold_every_shift():
    r = random.Random(2)
    for _ in range(400):
        n = r.randint(1, 14)
        a = [f"{r.randint(0, 9)}" for _ in range(n)]
        b = list(a)
        for _ in range(2):
            kind, i = r.randrange(3), r.randrange(len(b) + 1)
            if kind == 0 and i < len(b):
                b[i] = "x"
            elif kind == 1 and i < len(b) and len(b) > 1:
                del b[i]
            else:
                b.insert(i, "y")
        if splits.edits(a, b, 2) <= 2:
            sign, own, probe = splits.band_hashes([" ".join(a), " ".join(b)])
            assert set(own[0]) & set(probe[1]) and set(own[1]) & set(probe[0])
            assert bin((sign[0] ^ sign[1]) & (2**64 - 1)).count("1") <= 4


def test_words_are_folded():
    assert words("Желтый «ёж», дерев’яний мі́ст") == words("ЖЁЛТЫЙ еж дерев'яний міст")
    assert words("well-known co‑op") == ["well-known", "co-op"]
    assert words(None) == [] and words("​") == []


L, R = "lid string, v string, t long, x int", "rid string, v string, s long, x int"


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP_ROWS", 40)
    r = random.Random(5)
    left = [(f"l{i}", r.choice("abA"), r.choice([None, r.randint(-500, 3000)]), 0) for i in range(300)]
    right = [(f"r{i}", r.choice("abA"), r.randint(-500, 3000), 0) for i in range(150)] + [("n", None, 5, 0), ("m", "a", None, 0), (None, "a", 7, 0)]
    right += right[:20]
    got = {tuple(x) for x in nearest.nearest_pairs(spark.createDataFrame(left + left[:30], L), spark.createDataFrame(right, R), "lid", "rid", "v", "t", "s", tolerance=25, block=60).collect()}
    want = set()
    for i, v, t, _ in left:
        c = [(abs(s - t), s, j) for j, u, s, _ in right if t is not None and s is not None and j and u == v and abs(s - t) <= 25]
        if c:
            want.add((i, min(c)[2]))
    assert got == want


def test_nearest_ties_and_empty(spark):
    left = spark.createDataFrame([("l", "v", 10, 0)], L)
    right = spark.createDataFrame([("r2", "v", 5, 0), ("r1", "v", 15, 0), ("r0", "v", 5, 0), ("far", "v", 10**18, 0)], R)
    assert [tuple(x) for x in nearest.nearest_pairs(left, right, "lid", "rid", "v", "t", "s").collect()] == [("l", "r0")]
    assert nearest.nearest_pairs(left.limit(0), right, "lid", "rid", "v", "t", "s").count() == 0
    assert nearest.nearest_pairs(left, right.limit(0), "lid", "rid", "v", "t", "s").count() == 0


def test_times_at_the_ends_of_64_bits(spark):
    ends = (-(1 << 63), -(1 << 63) + 70_000, (1 << 63) - 1, 0)
    left = spark.createDataFrame([(f"l{i}", "v", t, 0) for i, t in enumerate(ends)], L)
    right = spark.createDataFrame([("r0", "v", ends[0] + 4_000, 0), ("r1", "v", ends[1] - 5_000, 0), ("r2", "v", ends[2] - 5_000, 0), ("r3", "v", 5_001, 0)], R)
    assert sorted(map(tuple, nearest.nearest_pairs(left, right, "lid", "rid", "v", "t", "s").collect())) == [("l0", "r0"), ("l1", "r1"), ("l2", "r2")]
