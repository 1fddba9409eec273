"""Normalised words of a text, the same for copies that differ in form only."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

# Cyrillic and Greek letters that look like Latin ones, and what they look like.
_LOOKALIKES = {
    "а": "a", "А": "a", "в": "b", "В": "b", "с": "c", "С": "c", "ԁ": "d", "е": "e", "Е": "e", "һ": "h", "н": "h", "Н": "h", "і": "i", "І": "i",
    "ј": "j", "Ј": "j", "к": "k", "К": "k", "м": "m", "М": "m", "о": "o", "О": "o", "р": "p", "Р": "p", "ԛ": "q", "ѕ": "s", "Ѕ": "s", "т": "t",
    "Т": "t", "х": "x", "Х": "x", "у": "y", "У": "y", "ԝ": "w", "Α": "a", "α": "a", "Β": "b", "Ε": "e", "ε": "e", "Η": "h", "Ι": "i", "ι": "i",
    "Κ": "k", "κ": "k", "Μ": "m", "Ν": "n", "ν": "v", "Ο": "o", "ο": "o", "Ρ": "p", "ρ": "p", "Τ": "t", "τ": "t", "Υ": "y", "υ": "u", "Χ": "x", "χ": "x", "ı": "i",
}
_TABLE = str.maketrans(_LOOKALIKES)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n\s*(?=[^\W\d_])")
# Greek and Cyrillic, and the dotless i.
_FOREIGN = re.compile("[\u0131\u0370-\u052f]")
_WORD = re.compile(r"[^\W_]+")
# Combining marks, and invisible and control characters.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u00ad\u0600-\u0605\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20f0\ufe00-\ufe0f\ufe20-\ufe2f\ufeff\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
# UTF-8 that was read as a one-byte encoding: a first byte of two and a continuation byte, as letters.
_MOJIBAKE = re.compile("[Â-ß][\x80-\xbf]")
_MOJIBAKE_1252 = re.compile("[ÂÃ][€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\x80-\xbf]")


def _repair(match: re.Match) -> str:
    pair = match.group()
    for encoding in ("latin-1", "cp1252"):
        try:
            return pair.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return pair


def clean(text: str) -> str:
    """``text`` without markup, entities, broken encodings, hyphenation, accents, look-alike and invisible characters, in lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _HYPHEN.sub("", text).lower() if "-" in text else text.lower()
    if "Ã" in text or "Â" in text:
        text = _MOJIBAKE_1252.sub(_repair, _MOJIBAKE.sub(_repair, text))
    text = _HYPHEN.sub("", text)
    text = unicodedata.normalize("NFKD", text)
    if not text.isascii():
        text = _MARKS.sub("", text)
        if _FOREIGN.search(text):
            text = text.translate(_TABLE)
    return text.lower()


def words(text: str | None) -> list[str]:
    """Letters and digits of the cleaned text, as words; none for null, empty and blank texts."""
    return _WORD.findall(clean(text)) if text else []


_HASHES: dict[str, int] = {}


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each word. The cache is bounded; what it holds does not change the result."""
    if len(_HASHES) > 1_000_000:
        _HASHES.clear()
    known = _HASHES
    out = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            h = known[t] = xxhash.xxh64_intdigest(t.encode())
        out.append(h)
    return np.array(out, np.uint64)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
            out ^= out >> np.uint64(29)
    return out
