"""Caption text as column functions; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken fillers in their order (the sixth is any run of its letter), and tags of music.
MARKERS = ("ну", "короче", "типа", "как бы", "значит", "э/ээ", "эм")
MUSIC = r"(?iuU)^\s*(?:\[(?:музыка|music|instrumental)\]|\((?:музыка|music|instrumental)\))\s*[.!…-]*\s*$"


def clean_caption(text: Column) -> Column:
    """Without mark-up and entities for blanks, white space of any kind collapsed and trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "(?i)&nbsp;", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")


def music_only(text: Column) -> Column:
    """Whether the text is nothing but a bracketed music tag."""
    return text.rlike(MUSIC)


def clock(ms: Column) -> Column:
    """HH:MM:SS.mmm; hours may exceed 24, times below zero are zero."""
    t = F.greatest(F.lit(0).cast("bigint"), ms.cast("bigint"))
    part = lambda unit, size: (F.floor(t / F.lit(unit)) % F.lit(size)).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(t / F.lit(3_600_000)).cast("bigint"), part(60_000, 60), part(1_000, 60), t % 1000)


def token_estimate(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.octet_length(text) / F.lit(3)).cast("bigint"))


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def repeats(tokens: Column) -> Column:
    """How many words equal the word before them."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return F.when(n > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))


def marker_counts(text: Column, tokens: Column) -> Column:
    """Array of how often each of MARKERS occurs."""
    count = lambda test: F.size(F.filter(tokens, test))
    equal = lambda m: lambda w: w == F.lit(m)
    of = {m: count(equal(m)) for m in MARKERS}
    of["э/ээ"] = count(lambda w: w.rlike("^э+$"))
    of["как бы"] = F.regexp_count(F.lower(text), F.lit(r"(?U)(^|[^\p{L}\p{N}])как\s+бы(?=$|[^\p{L}\p{N}])"))
    return F.array(*(of[m] for m in MARKERS))


def language_base(code: Column) -> Column:
    """The language of a code such as asr-ru_RU, without source and region."""
    return F.split(F.regexp_replace(F.lower(code), "^asr-", ""), "[-_]")[0]


def caption_parts(code: Column) -> tuple[Column, Column, Column]:
    """Normal form, source (asr, manual, unknown) and base of a caption language code."""
    known = code.isNotNull() & (code != "")
    normal = F.when(known, F.regexp_replace(F.lower(code), "_", "-"))
    asr = (normal == "asr") | normal.startswith("asr-")
    bare = F.when(asr, F.regexp_replace(normal, "^asr-?", "")).otherwise(normal)
    base = F.split(bare, "-")[0]
    return normal, F.when(~known, "unknown").when(asr, "asr").otherwise("manual"), F.when(base != "", base)


def caption_resolution(asked: Column, got: Column) -> Column:
    """How a caption's language code answers the one asked for."""
    a, _, a_base = caption_parts(asked)
    g, source, g_base = caption_parts(got)
    return (
        F.when(a.isNull() | g.isNull(), "unknown").when(a == g, "exact").when(~a_base.eqNullSafe(g_base), "different_language")
        .when(source == "asr", "same_language_asr").otherwise("same_language_variant")
    )


def shared_edge(before: Column, after: Column) -> Column:
    """Words that end one text and begin the next: the longest such run, without case."""
    a, b = F.split(F.lower(before), " "), F.split(F.lower(after), " ")
    most = F.least(F.size(a), F.size(b))
    fits = F.filter(F.sequence(F.lit(1), most), lambda n: F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n))
    return F.coalesce(F.array_max(fits), F.lit(0))
