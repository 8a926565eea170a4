"""Caption payloads, language lists and saved results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = "array<struct<text:string,start:double,duration:double>>"
TIMED = "array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"
SCHEMA = f"struct<video_id:string,language:string,transcript:{PLAIN},events:{TIMED}>"


def parse_captions(df: DataFrame, body: str) -> DataFrame:
    """(video_id, pos, text, start_ms, end_ms) from payloads of either layout: ``transcript`` with seconds,
    or ``events`` with milliseconds and text in pieces. Blank texts, missing and negative times give no
    row; ``pos`` is the place in the payload."""
    p = df.select(F.from_json(body, SCHEMA).alias("p"))
    ms = lambda x: F.floor(x * 1000 + F.lit(0.5)).cast("bigint")
    start = F.greatest(F.lit(0).cast("bigint"), ms(F.col("c.start")))
    plain = p.where("p.transcript IS NOT NULL").select("p.video_id", F.posexplode("p.transcript").alias("pos", "c")).where("c.start IS NOT NULL AND c.duration IS NOT NULL")
    plain = plain.select("video_id", "pos", F.col("c.text").alias("text"), start.alias("start_ms"), (start + F.greatest(F.lit(0).cast("bigint"), ms(F.col("c.duration")))).alias("end_ms"))
    timed = p.where("p.transcript IS NULL").select("p.video_id", F.posexplode("p.events").alias("pos", "c")).where("c.tStartMs >= 0 AND c.dDurationMs >= 0 AND c.segs IS NOT NULL")
    joined = F.array_join(F.transform("c.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    timed = timed.select("video_id", "pos", joined.alias("text"), F.col("c.tStartMs").alias("start_ms"), (F.col("c.tStartMs") + F.col("c.dDurationMs")).alias("end_ms"))
    return plain.unionByName(timed).where(r"text RLIKE '(?U)\\S'")


def restore_transcript(saved: DataFrame, lines: str, timeline: str) -> DataFrame:
    """(video_id, seg_idx, start_ms, end_ms, text) from texts of lines ``[number] words`` and, beside them, a
    time for each line. Lines that are no such line, and lines and times that differ in number, are an error."""
    row = F.arrays_zip(F.split(lines, "\n").alias("line"), F.col(timeline).alias("time"))
    whole = F.when(F.size(F.split(lines, "\n")) == F.size(timeline), row).otherwise(F.raise_error(F.lit("lines and times differ in number")))
    r = saved.select("video_id", F.explode(whole).alias("r"))
    number = F.regexp_extract("r.line", r"^\[(\d+)\] ", 1)
    checked = F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.lit("a line without a number")))
    return r.select("video_id", checked.alias("seg_idx"), "r.time.start_ms", "r.time.end_ms", F.regexp_replace("r.line", r"^\[\d+\] ", "").alias("text"))


def select_language(available: Column, priority: list[str]) -> Column:
    """The first available code that answers the first answerable wish: ``asr`` any automatic one,
    ``asr-xx`` the automatic one of a language, ``xx`` the manual one of a language, else its automatic
    one. Without wishes the first code."""
    normal = lambda c: F.regexp_replace(F.lower(F.trim(c)), "_", "-")
    asr = lambda c: (normal(c) == "asr") | normal(c).startswith("asr-")
    base = lambda c: F.split(F.regexp_replace(normal(c), "^asr-", ""), "-")[0]
    first = lambda test: F.get(F.filter(available, test), F.lit(0))
    of = lambda name, auto: lambda c: (asr(c) if auto else ~asr(c)) & (base(c) == F.lit(name))
    wishes = [w.strip().lower().replace("_", "-") for w in priority if w.strip()]
    if not wishes:
        return F.get(available, F.lit(0))
    options = []
    for w in wishes:
        name = w.removeprefix("asr-").split("-")[0]
        if w == "asr":
            options.append(first(asr))
        elif w.startswith("asr-"):
            options.append(first(of(name, True)))
        else:
            options += [first(of(name, False)), first(of(name, True))]
    return F.coalesce(*options)


def write_result(df: DataFrame, path: str, partition: str = "scan_id", masked: tuple[str, ...] = ("text",)) -> None:
    """Writes JSON, one folder per value of ``partition``, without the columns and struct fields named in
    ``masked``."""
    without(df, masked).write.mode("overwrite").partitionBy(partition).json(path)


def _dropping(names: list[str]):  # noqa: ANN202
    return lambda x: x.dropFields(*names)


def without(df: DataFrame, masked: tuple[str, ...]) -> DataFrame:
    """The columns but for those masked, at the top, in structs and in arrays of structs."""
    out = []
    for f in df.schema.fields:
        if f.name in masked:
            continue
        kind, c = f.dataType, F.col(f.name)
        if kind.typeName() == "struct" and (drop := [x for x in masked if x in kind.names]):
            c = c.dropFields(*drop)
        elif kind.typeName() == "array" and kind.elementType.typeName() == "struct" and (drop := [x for x in masked if x in kind.elementType.names]):
            c = F.transform(c, _dropping(drop))
        out.append(c.alias(f.name))
    return df.select(*out)
