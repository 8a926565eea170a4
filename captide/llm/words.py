"""Words of a text in a form that case, punctuation, encoding and look-alike letters don't change."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like a Latin one, after case folding.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "β": "b", "η": "n", "ϲ": "c",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
}
_DROPPED = {c: None for c in [0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x180E, 0xFE0E, 0xFE0F, 0x27, 0x2019, 0x2018, 0x2BC, 0x60, 0xB4, *range(0x300, 0x370), *range(0x202A, 0x202F)]}
_HYPHENS = {c: "-" for c in (0x2010, 0x2011, 0x2012, 0xFE63, 0xFF0D)}
_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()} | _DROPPED | _HYPHENS
CLEAN = _DROPPED | _HYPHENS
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def folded(text: str) -> str:
    """The text in lower case, without accents and invisible characters, look-alikes made Latin."""
    return unicodedata.normalize("NFKD", text).casefold().translate(_TABLE)


def words(text: str | None) -> list[str]:
    """The folded words in order; hyphenated words are one."""
    return _WORD.findall(folded(text)) if text else []


def cleaned(text: str) -> str:
    """The text in lower case, composed, without invisible characters; letters keep their script."""
    return unicodedata.normalize("NFC", text).casefold().translate(CLEAN)
