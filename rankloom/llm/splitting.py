"""Splitting oversized texts at natural boundaries, with a specified overlap.

Method: the least number of pieces that the limit allows gives targets of equal length; each target moves to the strongest
boundary near it, and the targets behind it are spread evenly over what is left; where the rest no longer fits within the limit,
one more piece is planned for it, so that a layout is mended from where it failed.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200
#: How far a cut may move from its target, as a share of the target length.
REACH = 0.2
#: By how much an overlap may be shorter so that the piece begins at a break.
SLACK = 40

# Boundaries, the strongest first. A boundary is the position after the match: what follows begins a new unit.
_BOUNDARIES = [
    re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*"),  # empty line
    re.compile(r"(?:\r\n?|[\n\x85\u2028\u2029])\s*"),  # line end
    re.compile(r"[.!?…。][\"'»”’)\]]*\s+"),  # sentence end
    re.compile(r"[;:,][\"'»”’)\]]*\s+"),  # clause end
    re.compile(r"\s+"),  # word end
]


def within_character(text: str, at: int) -> bool:
    """Whether a cut at this place would part what is shown as one character: before a combining mark, a variation selector, a
    joiner or what it joins, a skin tone or a tag, between the halves of a flag, within a line end."""
    if not 0 < at < len(text):
        return False
    before, after = text[at - 1], text[at]
    if after < "\u0300":
        return after == "\n" and before == "\r" or before == "\u200d"
    code = ord(after)
    if before == "\u200d" or after == "\u200d" or 0xFE00 <= code <= 0xFE0F or 0x1F3FB <= code <= 0x1F3FF or 0xE0020 <= code <= 0xE007F:
        return True
    if 0x1F1E6 <= code <= 0x1F1FF:
        n = at
        while n and 0x1F1E6 <= ord(text[n - 1]) <= 0x1F1FF:
            n -= 1
        return (at - n) % 2 == 1
    return unicodedata.category(after) in ("Mn", "Me", "Mc")


def _boundary(text: str, target: int, low: int, high: int, back: bool = True) -> int:
    """The strongest boundary in ``low..high``, of equal ones the nearest to ``target``, of these the first.

    Without any boundary it is the target, or the nearest place before it (``back``) or after it that parts no character; the
    target itself if there is none in ``low..high``.
    """
    base = max(0, low - 1)
    window = text[base:high]
    for pattern in _BOUNDARIES:
        found = [base + m.end() for m in pattern.finditer(window) if low <= base + m.end() <= high and not within_character(text, base + m.end())]
        if found:
            return min(found, key=lambda at: (abs(at - target), at))
    places = range(target, low - 1, -1) if back else range(target, high + 1)
    return next((at for at in places if not within_character(text, at)), target)


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, reach: float = REACH, slack: int = SLACK) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``, in code points. A text within the limit is one piece, an empty one too.

    Every piece has at most ``limit`` characters, the pieces cover the text, and each begins with the last ``overlap``
    characters of the one before, or up to ``slack`` fewer where that begins it at a break or keeps a character whole. A cut is
    within a character only if that is longer than the reach of a cut.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    slack = min(slack, overlap)
    out, start, left = [], 0, 0
    while n - start > limit:
        # The least number of pieces for the rest; more than planned if cuts before their targets have used up the room.
        left = max(left, math.ceil((n - start - overlap) / (limit - overlap)), 2)
        step = (n - start - overlap) / left  # what each piece adds; its length is this and the overlap
        move = max(1, min(int(reach * step), int(step / 2) - 1))
        first, last = start + overlap + 1, min(start + limit, n - 1)
        target = min(max(round(start + overlap + step), first), last)
        end = _boundary(text, target, max(first, target - move), min(last, target + move))
        out.append((start, end))
        start, left = _start(text, end, overlap, slack), left - 1
    return [*out, (start, n)]


def _start(text: str, end: int, overlap: int, slack: int) -> int:
    """Where the piece after ``end`` begins: ``overlap`` back, or at a break at most ``slack`` later."""
    at = end - overlap
    if not overlap or not slack:
        return at
    return _boundary(text, at, at, min(at + slack, end), back=False)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def piece_spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """``spans`` as an expression: array<struct<start, stop>>. Only texts over the limit go to Python; null gives null.

    The function counts as not deterministic, so that a filter on its result does not make it run twice.
    """

    @F.arrow_udf("array<struct<start:int,stop:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        cuts = [None if t is None else [{"start": a, "stop": b} for a, b in spans(t, limit, overlap)] for t in texts.to_pylist()]
        return pa.array(cuts, _SPANS)

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("stop")))
    return F.when(text.isNotNull(), F.coalesce(cut.asNondeterministic()(F.when(F.length(text) > limit, text)), whole))


def split_texts(df: DataFrame, column: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of ``column``: the columns of ``df`` besides it, and ``piece`` (from 0), ``pieces``, ``start``,
    ``stop`` and ``piece_text``, which replace columns of these names.

    A null text gives no row, an empty one a single empty piece; repeated rows are split each for itself; an empty table
    gives none. Texts of any length are processed whole, one at a time. No shuffle.
    """
    own = ["piece", "pieces", "start", "stop", "piece_text"]
    rest = [F.col(f"`{c}`") for c in df.columns if c != column and c not in own]
    cut = df.select(*rest, F.col(f"`{column}`").alias("__text"), piece_spans(F.col(f"`{column}`"), limit, overlap).alias("__spans"))
    return cut.select(
        *[F.col(f"`{c}`") for c in df.columns if c != column and c not in own],
        "__text", F.size("__spans").alias("pieces"), F.posexplode("__spans").alias("piece", "__span"),
    ).select(
        *[F.col(f"`{c}`") for c in df.columns if c != column and c not in own],
        "piece", "pieces", F.col("__span.start").alias("start"), F.col("__span.stop").alias("stop"),
        F.substring("__text", F.col("__span.start") + 1, F.col("__span.stop") - F.col("__span.start")).alias("piece_text"),
    )
