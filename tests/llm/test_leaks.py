import random

import numpy as np
import pytest

from captide.llm import leaks

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, suite string"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    who, does = ["the captain", "the old wizard", "the second player", "my team mate", "the lazy guard", "our builder"], ["hides the last lantern", "digs a tunnel", "opens the wrong door", "forgets the password", "loses the race"]
    where, why = ["near the mill", "over the river", "under the tower", "in the cave"], ["because", "while", "but", "so", "and then"]
    name = lambda: "".join(r.choice(["zim", "bra", "nep", "quen", "tor", "lu"]) for _ in range(5)).title()
    line = lambda: r.choice([f"{name()} buys {r.randint(1, 900)} lanterns from {name()}", f"nobody told {name()} that {name()} had {r.randint(1, 900)} keys"])
    items = [(i, ". ".join(f"{line()} {r.choice(why)} {r.choice(who)} {r.choice(does)} {r.choice(where)}" for _ in range(4)) + ".", "s") for i in range(30)]
    noise = lambda: ". ".join(f"{line()} {r.choice(why)} {r.choice(who)} {r.choice(does)} {r.choice(where)}" for _ in range(r.randint(2, 6)))
    return r, items, noise


def test_planted_leaks(spark, corpus):
    r, items, noise = corpus
    docs, want = [], set()
    for n in range(120):
        k = r.randrange(30)
        w = items[k][1].split()
        kind = n % 6
        cut = w[r.randrange(0, len(w) // 3) :]
        if kind == 0:  # whole, in another spelling
            body, leak = items[k][1].upper().replace("O", "О").replace(". ", "\n"), True
        elif kind == 1:  # half of it, with times between
            body, leak = " ".join(f"{x} (0:{i:02})" if i % 7 == 3 else x for i, x in enumerate(cut[: int(len(w) * 0.55)])), True
        elif kind == 2:  # a few words altered, dropped and added
            body, leak = " ".join("xyz" if i % 13 == 5 else x for i, x in enumerate(w) if i % 17 != 9), True
        elif kind == 3:  # too short a quote
            body, leak = " ".join(cut[: int(len(w) * 0.25)]), False
        elif kind == 4:  # the words of the item in another order
            body, leak = " ".join(r.sample(w, len(w))), False
        else:
            body, leak = "", False
        docs.append((n, f"{noise()} {body} {noise()}", "x"))
        if leak:
            want.add((n, k))
    docs += [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), docs[0]]
    got = {tuple(x) for x in leaks.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items + [(77, None, "s"), (78, "!", "s")], ITEM)).collect()}
    assert got == want


def test_blocks_of_items_long_text_and_report(spark, corpus, monkeypatch):
    r, items, noise = corpus
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)
    long_text = " ".join(noise() for _ in range(800)) + " " + items[3][1] + " " + " ".join(noise() for _ in range(800))
    docs = spark.createDataFrame([(1, long_text, "x"), (2, items[3][1], "x")], DOC)
    i = spark.createDataFrame(items, ITEM)
    monkeypatch.setattr(leaks, "ROUND_CHARACTERS", 10_000)
    found = leaks.leaked_items(docs, i)
    assert sorted(map(tuple, found.collect())) == [(1, 3), (2, 3)]
    report = {x.item_id: x.documents for x in leaks.leak_report(found, docs, i).collect()}
    assert report[3] == 2 and sum(report.values()) == 2 and len(report) == 30


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c", "s")], ITEM)
    assert leaks.leaked_items(none, item).count() == 0
    assert leaks.leaked_items(spark.createDataFrame([(1, "a b c", "x")], DOC), item.limit(0)).count() == 0


def test_items_in_three_suites_leak_as_one(spark, corpus):
    r, items, noise = corpus
    again = [(i + 100 * k, t if k < 2 else t + " and so on", s) for i, t, s in items for k in range(3)]
    docs = [(n, f"{noise()} {items[n][1]} {noise()}", "x") for n in range(10)] + [(50 + n, noise(), "x") for n in range(30)]
    got = {tuple(x) for x in leaks.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(again, ITEM)).collect()}
    assert got == {(n, n + 100 * k) for n in range(10) for k in range(3)}


def test_no_fingerprint_within_the_radius_is_missed(corpus):
    r, items, _ = corpus
    index = leaks.Index([(i, t) for i, t, _ in items[:10]])
    rng = np.random.default_rng(1)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, leaks.WINDOW) for x in index.items])
    windows = np.where(rng.random(windows.shape) < 0.15, rng.integers(0, len(index.code), windows.shape), windows).astype(np.int32)
    got = {(int(a), int(b)) for who, cand in index.near(windows) for a, b in zip(who, cand)}
    bits = np.bitwise_count(index.fingerprints(windows)[:, None] ^ index.prints[None, :])
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(bits <= leaks.RADIUS)))) and len(got) > 200
