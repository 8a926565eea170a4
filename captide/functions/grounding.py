"""Whether a paraphrase turns a negation of its source round: an Arrow function, since it walks over words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of requests, negations, and the beginning of a quote.
_WORD = re.compile(r"[a-zа-яё]{2,}", re.I)
_REQUEST = re.compile(r"пожалуйста|прошу|можно|хватит|перестань|please|could you", re.I)
NO = frozenset(("не", "not", "never"))
QUOTE = "В субтитрах: "
#: Letters by which two forms of a word are taken for one, characters of a request around a negation,
#: and of a quote around it.
STEM, BEFORE, AFTER, QUOTE_BEFORE, QUOTE_AFTER = 5, 45, 15, 48, 64


def _words(text: str) -> list[tuple[str, int]]:
    return [(m[0], m.start()) for m in _WORD.finditer(text.lower().replace("ё", "е"))]


def reversed_at(source: str | None, claim: str | None) -> tuple[int, int] | None:
    """Where the source negates a word (of STEM letters or more) that the claim states without negation
    and that the source states nowhere else; questions and requests don't count."""
    have, say = _words(source or ""), _words(claim or "")
    negated = lambda words, k, reach: any(w in NO for w, _ in words[max(0, k - reach) : k])
    stated: dict[str, bool] = {}  # of each stem of the claim, whether its first mention is negated
    for k, (w, _) in enumerate(say):
        stated.setdefault(w[:STEM], negated(say, k, 3))
    affirmed = {w[:STEM] for k, (w, _) in enumerate(have) if not negated(have, k, 2)}
    for (word, at), (verb, where) in zip(have, have[1:]):
        stem, end = verb[:STEM], where + len(verb)
        if word in NO and len(verb) >= STEM and stated.get(stem) is False and stem not in affirmed:
            around = source[max(0, at - BEFORE) : end + AFTER]
            if "?" not in around and not _REQUEST.search(around):
                return at, end
    return None


def grounded(source: str | None, claim: str | None) -> str | None:
    """The claim, or, where it turns a negation round, a quote of the source around it."""
    hit = reversed_at(source, claim)
    if not hit:
        return claim
    lo, hi = max(0, hit[0] - QUOTE_BEFORE), min(len(source), hit[1] + QUOTE_AFTER)
    quote = " ".join(source[lo:hi].split())
    return f"{QUOTE}«{'…' if lo else ''}{quote}{'…' if hi < len(source) else ''}»"


def ground_copy(source: Column, claim: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([grounded(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, "string")(source, claim)
