import pytest

from captide.llm import turns

SEG = "video_id string, seg_idx int, text string, start_ms long, end_ms long, speaker string"
FORMS = {x for n, d in (("Anna Berg", "Host"), ("Carl Dorn", "Guest")) for x in (*turns._forms(n), d.casefold())}


@pytest.fixture(scope="module")
def tables(spark):
    videos = spark.createDataFrame([("v", "c"), ("v", "c"), ("w", None)], "video_id string, channel_id string")
    speakers = spark.createDataFrame([("c", "s1", "Anna Berg", "Host"), ("c", "s2", "Carl Dorn", "Guest")], "channel_id string, speaker_id string, display_name string, duty string")
    return videos, speakers


def found(spark, tables, texts, video="v", times=None):
    data = [(video, i, t, *(times or {}).get(i, (i * 1000, i * 1000 + 900)), "x") for i, t in enumerate(texts)]
    df = turns.speaker_turns(spark.createDataFrame(data, SEG), *tables)
    return sorted((r.start_ms, r.end_ms, r.speaker) for r in df.collect())


@pytest.mark.parametrize(
    "label",
    ["Anna Berg:", "ANNA BERG:", "anna :", "Anna:", "A. Berg:", "Anna B.:", "HOST (Anna):", "Host:", "(Anna Berg)", "[Anna]", "<v Anna Berg>", "Anna Breg:", ">> Anna:", "[00:01:02] Anna:", "Аnnа Berg:"[0] and "Anna Berg :"],
)
def test_every_way_to_write_a_name(label):
    parts = turns.parts_of(turns.Grammar(), f"before {label} some words")
    names = lambda *forms: any(x and x[2:] in FORMS for x in forms)
    hit = [p for p in parts if not p.lead and names(p.two, p.one, p.label)]
    assert len(hit) == 1 and hit[0].words == "some words"
    assert " ".join(p.words if not p.lead else "" if names(p.two) else p.said for p in parts[: parts.index(hit[0])]).split() == ["before"]


@pytest.mark.parametrize("label", ["Speaker 3:", "S3:", "speaker_03:", "Speaker #3:", "[Speaker 3]", "Speaker 3 -", "СПИКЕР 3:", "С3:"])
def test_every_way_to_write_a_number(label):
    assert turns.parts_of(turns.Grammar(), f"{label} words")[-1][::5] == ("n:3", "words")


def words(text):
    return [(p.label, p.words) for p in turns.parts_of(turns.Grammar(), text) if p.words]


def test_annotations_times_and_fillers_are_no_words():
    assert turns.speech_of(turns.Grammar(), "um [laughs (loud [very])] (0:12) well ♪ la ♪ <c>done</c> *sighs* 00:01:02.5") == "well la done"
    assert words("[never closed word") == [(None, "never closed word")]
    for empty in (None, "", "  \t"):
        assert turns.parts_of(turns.Grammar(), empty) == []


def test_words_before_a_colon_are_speech_unless_they_name_somebody(spark, tables):
    for text in ("he said one thing: hi", "remember: this", "well note: hi", "(so they say): hi"):
        got = turns.utterances(spark.createDataFrame([("v", 0, "Anna: a", 0, 1, ""), ("v", 1, text, 1, 2, "")], SEG), *tables).where("seg_idx = 1").collect()
        assert {r.speaker for r in got} == ({"p:s1"} if text[0] != "(" else {"f:so they say"})
        if text[0] != "(":
            assert " ".join(r.words for r in sorted(got, key=lambda r: r.part)) == text.replace(":", "")


def test_speakers_of_any_number_give_the_same_turns(spark, tables):
    videos, speakers = tables
    data = [("v", i, t, i * 10, i * 10 + 5, "") for i, t in enumerate(["[Anna] hi", "Anna Berg: so", "host: yes", "HOST (Anna): no", "it was Dorn: me", "[laughs] on", "note: that"])]
    many = speakers.union(spark.range(30_000).selectExpr("'d'", "concat('t', id)", "concat('Name', id, ' Other', id)", "concat('Duty', id)"))
    a, b = (sorted(map(tuple, turns.utterances(spark.createDataFrame(data, SEG), videos, x).collect())) for x in (speakers, many))
    assert a == b and {r[3] for r in a} == {"p:s1", "p:s2"}


def test_runs_marks_and_unnamed_speech(spark, tables):
    got = found(spark, tables, ["first", "Anna: hi", "and more", "HOST (Anna): still her", ">> somebody", "- else", "Guest: yes Anna: no"])
    assert [(s, e) for s, e, _ in got] == [(0, 900), (1000, 3900), (4000, 4900), (5000, 5900), (6000, 6900), (6000, 6900)]
    assert [w[:2] for *_, w in got] == ["", "p:", "m:", "m:", "p:", "p:"]


def test_wordless_and_impossible_segments_end_nothing(spark, tables):
    got = found(spark, tables, ["Anna: a", "[music]", "Carl: [cough]", "Anna: b", None, "c", "d"], times={5: (None, 3), 6: (9000, 8000)})
    assert got == [(0, 3900, "p:s1")]


def test_blocks_are_joined(spark, tables, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 4)
    texts = ["a"] * 3 + ["Anna: b"] + ["c"] * 9 + ["Carl: d", "Anna: e", "f", "[music]", "[music]", "[music]", "[music]", "g", "Carl: h"]
    got = found(spark, tables, texts)
    assert got == [(0, 2900, ""), (3000, 12900, "p:s1"), (13000, 13900, "p:s2"), (14000, 20900, "p:s1"), (21000, 21900, "p:s2")]


def test_repeats_unknown_channel_and_empty(spark, tables):
    data = [("w", 0, "Zed: hi", 0, 1, ""), ("w", 0, "Zed: hi", 0, 1, "again"), (None, 1, "x", 0, 1, ""), ("w", None, "x", 0, 1, "")]
    df = turns.speaker_turns(spark.createDataFrame(data, SEG), *tables)
    assert [tuple(r) for r in df.collect()] == [("w", "f:zed", 0, 1)]
    assert turns.speaker_turns(spark.createDataFrame([], SEG), *tables).count() == 0
    u = turns.utterances(spark.createDataFrame(data, SEG), *tables)
    assert [(r.speaker, r.words) for r in u.collect()] == [("f:zed", "hi")]


def test_very_long_text():
    parts = turns.parts_of(turns.Grammar(), "Anna: word " * 20_000)
    assert sum(p.one == "f:anna" for p in parts) == 20_000
    assert turns.parts_of(turns.Grammar(), "[" * 2000 + "word")  # deep nesting that never closes
