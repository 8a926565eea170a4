import random

import numpy as np
import pytest

from captide.llm import abuse

DOC, LAB, SEG, VID = "doc_id long, text string, source string, score int", "doc_id long, flagged int", "video_id string, seg_idx int, text string, start_ms long", "video_id string, channel_id string"
PLAIN = ["the captain hides the last lantern over the river", "the old wizard digs a tunnel next to the market", "that noisy neighbour paints the roof yellow", "my team mate opens the wrong door before sunrise"]
INSULTS = ["idiot", "cretin", "moron", "scumbag", "loser", "halfwit"]
HARM = ["you are nothing but a pathetic {}", "shut your mouth you {}", "go and cry in a corner stupid {}", "get lost {} nobody can stand you"]
FINE = ["he says he never called anyone a {}", "the word {} once was a medical term", "you are no {} you solved it alone"]


def corpus(r, n, held_out):
    """Texts with harm in every fourth. Of each frame a third of the insults are held out, so that what is
    tested are pairs of words that no training text has."""
    data, labels = [], []

    def phrase(frames):
        while True:
            f, w = r.randrange(len(frames)), r.randrange(len(INSULTS))
            if ((f + w) % 3 == 0) == held_out:
                return frames[f].format(INSULTS[w])

    for i in range(n):
        lines = [phrase(FINE) if r.random() < 0.2 else r.choice(PLAIN) for _ in range(r.randint(4, 9))]
        if i % 4 == 0:
            lines.insert(r.randrange(len(lines)), phrase(HARM))
        data.append((i, ". ".join(lines), "s", 1))
        labels.append((i, int(i % 4 == 0)))
    return data, labels


def trained(data, labels):
    texts, flagged = [d[1] for d in data], [x[1] for x in labels]
    flat, at = abuse.Terms().flat(texts, abuse.WINDOW)
    term, n = abuse.texts_with(flat, at, abuse.candidates(texts, flagged))
    frequency = np.zeros(abuse.TERMS, np.int64)
    frequency[term] = n // 3  # all documents: these, and as many again twice, without such content
    return abuse.fit(texts, flagged, frequency, len(texts))


@pytest.fixture(scope="module")
def machine():
    return trained(*corpus(random.Random(1), 300, held_out=False))


def found(machine, texts):
    return machine.scores(abuse.Terms(machine.known), texts) > machine.limit


def test_pairs_of_words_never_seen_together(machine):
    data, labels = corpus(random.Random(9), 400, held_out=True)
    got, want = found(machine, [d[1] for d in data]), np.array([x[1] == 1 for x in labels])
    assert got[want].mean() >= 0.9 and got[~want].mean() <= 0.05


@pytest.mark.parametrize("word", ["idiot", "IDIOT", "1d10t", "i d i o t", "i.d.i.o.t", "idiiiiiot", "іdіоt", "<c>idiot</c>", "i​diot", "id**t", "i***t"])
def test_disguises(machine, word):
    assert found(machine, [f"the captain hides the lantern you are nothing but a pathetic {word}!"])[0]


def test_innocent_look_alikes_and_no_labels(machine):
    assert not found(machine, ["the cockpit of the old plane in essex is empty", "", "12:30 :: 77"]).any()
    assert abuse.fit(["a b"], [0], np.zeros(abuse.TERMS), 1) is abuse.NOTHING
    assert abuse.fit([], [], np.zeros(abuse.TERMS), 0) is abuse.NOTHING


def test_letters_of_two_texts_are_not_joined():
    flat, at = abuse.Terms().flat(["a b", "c d"], 0)
    assert (flat != 0).all() and list(at) == [0, 2, 4]


def test_documents_and_videos(spark, machine):
    bad = HARM[0].format("idiot")
    data, labels = corpus(random.Random(3), 160, held_out=False)
    docs = spark.createDataFrame(data + [(900, None, "s", 1), (901, "", "s", 1), (902, bad + " . " + PLAIN[0] * 3000, "s", 1), (None, bad, "s", 1)] + [(1000 + i, t, "s", 1) for i, t in enumerate(PLAIN * 100)], DOC)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (4444, 1)], LAB)
    got = {x.doc_id: x.found for x in abuse.score_documents(docs, lab).collect()}
    assert got[900] is False and got[901] is False and got[902] is True and len(got) == 563
    n = abuse.BLOCK + 20
    segs = [("v", i, "the captain", i) for i in range(n)]
    segs[abuse.BLOCK - 1] = ("v", abuse.BLOCK - 1, "you are nothing but", 0)  # the phrase crosses segments and blocks
    segs[abuse.BLOCK] = ("v", abuse.BLOCK, "a pathetic idiot", 0)
    segs += [("w", 0, "you", 0), ("w", 1, None, 0), ("u", 0, FINE[0].format("moron"), 0), (None, 0, bad, 0), *segs[:40]]
    # a phrase a word a segment, with sounds, repeats and blocks between its words
    for k, word in enumerate(bad.split()):
        segs += [("x", k * abuse.BLOCK // 2 + 7, word, 0)] * 30 + [("x", k * abuse.BLOCK // 2 + 8 + j, "...", 0) for j in range(40)]
    got = {x.video_id: x.found for x in abuse.score_videos(spark.createDataFrame(segs, SEG), docs, lab, machine).collect()}
    assert got == {"v": True, "w": False, "u": False, "x": True}
    both = abuse.score_items(docs, spark.createDataFrame(segs, SEG), spark.createDataFrame([("v", "c"), ("v", "c")], VID), lab)
    rates = {(x.scope, x.source): (x.items, x.found) for x in abuse.rates(both).collect()}
    assert rates["document", "s"][0] == 563 and rates["video", "c"] == (1, 1)


def test_videos_against_whole_texts(spark, machine):
    """Blocks, batches and repeats change no score: each video is scored as one text."""
    r = random.Random(4)
    words = " ".join([*HARM, *FINE, *PLAIN]).replace("{}", " ".join(INSULTS)).split()
    videos = {f"v{i}": [(3 * j + r.randint(0, 2), " ".join(r.choice(words) for _ in range(r.randint(0, 4)))) for j in range(r.choice([3, 40, 2500]))] for i in range(12)}
    rows = [(v, s, t, 0) for v, segs in videos.items() for s, t in segs]
    rows += r.sample(rows, 300)
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x.video_id: x.score for x in abuse.score_videos(spark.createDataFrame(rows, SEG), None, None, machine).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = dict(zip(videos, machine.scores(abuse.Terms(machine.known), [" ".join(t for _, t in sorted(segs)) for segs in videos.values()])))
    assert {k: round(x, 6) for k, x in got.items()} == {k: round(x, 6) for k, x in want.items() if k in got} and len(got) == 12


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC), spark.createDataFrame([], SEG), spark.createDataFrame([], LAB)
    assert abuse.found_items(*none).count() == 0
