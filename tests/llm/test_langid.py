import random

import pytest
from pyspark.sql import functions as F

from captide.llm import langid
from tests.conftest import DATA

WORDS = {
    "en": "the old wizard opens wrong door under tower while captain hides last lantern again", "de": "der alte zauberer öffnet die falsche tür unter dem turm und versteckt letzte laterne wieder",
    "ru": "старый волшебник открывает не ту дверь под башней пока капитан прячет последний фонарь", "uk": "старий чарівник відчиняє не ті двері під вежею доки капітан ховає останній ліхтар",
    "es": "el viejo mago abre la puerta equivocada bajo torre mientras capitana esconde última linterna", "fr": "le vieux magicien ouvre la mauvaise porte sous tour pendant que capitaine cache dernière lanterne",
}


def sentence(r, lang):
    w = WORDS[lang].split()
    i = r.randrange(len(w) - 5)
    return " ".join(w[i : i + r.randint(4, 8)])


@pytest.mark.parametrize(
    ("label", "code"),
    [("asr-ru-RU", "ru"), ("ASR-en", "en"), ("uk_UA", "uk"), ("deu", "de"), ("FR", "fr"), ("asr", None), ("und", None), ("??", None), ("", None), (None, None)],
)
def test_codes(spark, label, code):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(langid.language_code(F.col("l")).alias("c")).collect()[0].c == code


def test_wrong_labels_do_not_spoil_the_dictionaries():
    r = random.Random(1)
    samples = []
    for v in range(120):
        lang = langid.LANGUAGES[v % 6]
        label = r.choice(langid.LANGUAGES) if r.random() < 0.15 else lang
        samples += [(f"v{v}", label, sentence(r, lang)) for _ in range(12)]
    sizes = langid.Sizes(langid.fit(samples))
    right = 0
    for _ in range(300):
        lang = r.choice(langid.LANGUAGES)
        z = sizes.of(sentence(r, lang))
        right += langid.LANGUAGES[z.index(min(z))] == lang
    assert right >= 290


SEG, VID, SPK = "video_id string, seg_idx int, text string, start_ms long", "video_id string, language string, channel_id string", "display_name string, duty string"


def test_videos_and_mixed_segments(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 8)
    r = random.Random(3)
    segs, vids = [], []
    for v in range(36):
        lang = langid.LANGUAGES[v % 6]
        vids.append((f"v{v}", {0: None, 7: "asr-es"}.get(v, f"asr-{lang}"), "c"))
        segs += [(f"v{v}", i, sentence(r, lang), i) for i in range(20)]
    segs += [("v1", 20, WORDS["en"], 0), ("v2", 20, "[Musik]", 0), ("v2", 21, None, 0), ("v2", 22, "  ", 0), (None, 3, "x", 0), *segs[:15]]
    s, v = spark.createDataFrame(segs, SEG), spark.createDataFrame(vids + vids[:3], VID)
    found = langid.wrong_labels(langid.languages(s, v, spark.createDataFrame([("A B", "Host")], SPK)))
    assert sorted(map(tuple, found.collect())) == [("v0", -1, "en"), ("v1", 20, "en"), ("v7", -1, "ru")]


def test_other_scripts_and_narrow_margins_are_undetermined(spark):
    r = random.Random(5)
    vids = [(f"v{i}", langid.LANGUAGES[i % 6], "c") for i in range(36)] + [("gr", "el", "c"), ("zh", None, "c")]
    segs = [(f"v{i}", k, sentence(r, langid.LANGUAGES[i % 6]), 0) for i in range(36) for k in range(20)]
    segs += [("gr", k, "ο γέρος μάγος ανοίγει τη λάθος πόρτα", 0) for k in range(5)] + [("zh", 0, "老巫师打开了错误的门", 0), ("v0", 20, "ο γέρος μάγος ανοίγει", 0)]
    found = langid.languages(spark.createDataFrame(segs, SEG), spark.createDataFrame(vids, VID), spark.createDataFrame([], SPK))
    got = {(x.video_id, x.seg_idx): x.lang for x in found.collect()}
    assert got["gr", -1] == got["zh", -1] == got["v0", 20] == "und" and got["v0", -1] == "en"
    assert not langid.wrong_labels(found).where("video_id IN ('gr', 'zh', 'v0')").count()


def test_a_text_of_two_scripts_is_held_against_both():
    assert langid.scripts("captain прячет") == (True, True) and langid.scripts("кaпитан прячет фонарь") == (False, True)
    assert langid._bytes("ab прячет", True, True)[4:] == langid._bytes("прячет", False, True)[1:] and len(langid._bytes("ёü老", True, True)) == 5


def test_empty_tables(spark):
    none = langid.languages(spark.createDataFrame([], SEG), spark.createDataFrame([], VID), spark.createDataFrame([], SPK))
    assert none.count() == 0


def test_smallest_tables(spark):
    t = lambda n: spark.read.parquet(f"{DATA}/sf0.001/{n}.parquet")
    out = langid.languages(t("transcript_segments"), t("videos"), t("channel_speakers"))
    assert out.where("seg_idx = -1 AND confidence > 0.5").count() > 0
