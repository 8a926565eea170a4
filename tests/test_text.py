import pytest
from pyspark.sql import functions as F

from captide.functions import numbers, text
from captide.sources import captionjson


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("<i>a</i>&nbsp;b", "a b"), ("  x\t\n y ", "x y"), ("a  b", "a b"), ("", ""), ("&NBSP;", ""), ("[смех] Ты где?", "[смех] Ты где?")],
)
def test_clean(spark, raw, clean):
    assert one(spark, text.clean_caption(F.lit(raw))) == clean


@pytest.mark.parametrize(("raw", "music"), [("[Музыка]", True), (" (MUSIC) ...", True), ("[instrumental]!", True), ("музыка", False), ("[смех]", False), ("[музыка] да", False)])
def test_music(spark, raw, music):
    assert one(spark, text.music_only(F.lit(raw))) is music


def test_clock_tokens_repeats(spark):
    assert one(spark, text.clock(F.lit(90_061_001))) == "25:01:01.001"
    assert one(spark, text.clock(F.lit(-5))) == "00:00:00.000"
    assert [one(spark, text.token_estimate(F.lit(t))) for t in ("", "abc", "abcd", "привет")] == [1, 1, 2, 4]
    assert one(spark, text.repeats(text.words(F.lit("Да да, нет нет нет")))) == 3
    assert one(spark, text.repeats(text.words(F.lit("")))) == 0


def test_markers(spark):
    t = F.lit("Ну, короче, ну как бы типа э-э значит ээ эм... конуру")
    assert one(spark, text.marker_counts(t, text.words(t))) == [2, 1, 1, 1, 1, 3, 1]


@pytest.mark.parametrize(
    ("asked", "got", "how"),
    [("ru", "ru", "exact"), ("ru", "asr-ru", "same_language_asr"), ("ru", "ru_RU", "same_language_variant"), ("ru", "en", "different_language"), (None, "ru", "unknown"), ("ru", "", "unknown"), ("ru", "asr", "different_language")],
)
def test_resolution(spark, asked, got, how):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, text.caption_resolution(lit(asked), lit(got))) == how


@pytest.mark.parametrize(
    ("have", "wish", "code"),
    [
        (["en", "asr-ru", "ru"], ["ru", "en"], "ru"), (["en", "asr-ru"], ["ru", "en"], "asr-ru"), (["de", "asr-fr"], ["ru", "asr"], "asr-fr"), (["de"], ["ru"], None),
        (["de", "fr"], [], "de"), (["ru_RU", "ru"], ["RU-ru"], "ru_RU"), (["ru"], ["asr-ru"], None),
    ],
)
def test_language_choice(spark, have, wish, code):
    assert one(spark, captionjson.select_language(F.array(*map(F.lit, have)), wish)) == code


@pytest.mark.parametrize(("a", "b", "n"), [("a b c", "B c d", 2), ("автомат", "мат", 0), ("a", "a", 1), ("x y", "z", 0)])
def test_shared_edge(spark, a, b, n):
    assert one(spark, text.shared_edge(F.lit(a), F.lit(b))) == n


def test_payloads_of_both_layouts(spark):
    bodies = [
        '{"video_id":"a","transcript":[{"text":"x","start":1.2345,"duration":0.5},{"text":"  ","start":2,"duration":1},{"text":"y","start":-1,"duration":1},{"start":1,"duration":1}]}',
        '{"video_id":"b","events":[{"tStartMs":5,"dDurationMs":7,"segs":[{"utf8":"p"},{"utf8":"q"},{}]},{"tStartMs":-1,"dDurationMs":1,"segs":[{"utf8":"n"}]},{"tStartMs":9}]}',
    ]
    got = captionjson.parse_captions(spark.createDataFrame([(b,) for b in bodies], "body string"), "body").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "x", 1235, 1735), ("a", 2, "y", 0, 1000), ("b", 0, "pq", 5, 12)]


def test_numbers(spark):
    assert one(spark, numbers.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, numbers.round_half_up(F.lit(0.25), 1)) == 0.3
    assert [one(spark, numbers.count_form(F.lit(n), "a", "b", "c")) for n in (1, 2, 5, 11, 21, 112)] == ["a", "b", "c", "c", "a", "c"]
    assert [one(spark, numbers.prevalence(F.lit(n), F.lit(10))) for n in (0, 2, 5, 8, 9)] == ["none", "rare", "occasional", "common", "pervasive"]
    assert one(spark, numbers.overlap_share(F.lit(0), F.lit(10), F.lit(5), F.lit(7))) == 1.0


def test_masks_text_everywhere(spark):
    df = spark.range(1).select(F.lit("t").alias("text"), F.struct(F.lit("t").alias("text"), F.lit(1).alias("n")).alias("s"), F.array(F.struct(F.lit("t").alias("text"), F.lit(2).alias("n"))).alias("a"))
    got = captionjson.without(df, ("text",))
    assert got.columns == ["s", "a"] and "text" not in got.schema.simpleString()


def test_result_is_written_by_scan(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a", "t"), ("s2", "b", "t")], "scan_id string, id string, text string")
    captionjson.write_result(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted(back.columns) == ["id", "scan_id"] and back.count() == 2
