"""Per-document text quality statistics, and which texts are no natural prose.

Method: tables and lists show in the shape of the text: delimiters that stand in the same columns from one line to the next, or
as many of them in each, a periodic indentation, a period of the lengths of lines. The first two are told of a stretch, the
periods of its whole text. Together with word, symbol, punctuation and repetition ratios they describe each stretch of a text;
a logistic model, fitted on a bounded sample of labelled documents, tells how much of the text is prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import word_count
from rankloom.llm.tasks import spread
from rankloom.llm.words import gram_hashes

#: Labelled documents that the model is fitted on: those of smallest hash, at most so many.
TRAIN_DOCS = 4000
#: Stretches of a labelled document that the model is fitted on: all, or so many evenly spaced ones.
TRAIN_STRETCHES = 200
#: Words of a stretch of text that is judged by itself.
STRETCH = 30

# Function words of Spanish, Portuguese and English, without those that lists and names are full of (de, da, do, of).
FUNCTION_WORDS = frozenset(
    """
    a al ante antes aquella aquel aún aunque bajo cada como con contra cuando cuyo cuya del desde donde durante el él ella ellos en entre era es esa ese eso esta está están este
    esto fue ha han hasta hay la las le les lo los más me mi mientras muy ni no nos o para pero poco por porque pues que qué quien quién se según ser si sí sin sino sobre
    solo son su sus también tan tanto te tiene todo todos tras tu un una uno unos unas y ya yo
    ao aos as até com como depois dos e ela ele eles em era essa esse está foi há isso isto já lhe mais mas me muito na nas não nem no nos num numa o os ou para pela pelo
    por quando que quem se sem ser seu sua suas seus só são também te tem um uma umas uns você à às é
    about after also although an and are as at be been before between but by for from had has have he her his how if in into is it its more next no not now on one only or
    over she than that the their there they this through to under up was were what when where which while who with you
    """.split()
)

_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_BULLET = re.compile(r"\s*(?:[-*•·–—→‣▪◦>»+|]\s*\S|\(?[0-9]{1,4}[.):]\s|\(?[a-zA-Z][.)]\s|[ivxlc]{1,6}[.)]\s|\{\{|\|)")
_END = re.compile(r"[.!?…:;][\"'»”’)\]]*\s*$")
_GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_VOWEL = re.compile(r"[aeiouáéíóúàâãêôõüyAEIOUÁÉÍÓÚÀÂÃÊÔÕÜY]")
_ODD = re.compile(r"[^\w\s.,;:!?¡¿'\"«»()\-—–“”‘’…%°²ªº/&]|[\x00-\x08\x0e-\x1f�_]")
_INNER = re.compile(r"\w[^\w\s]+\w\S*")
_DELIMITER = re.compile(r"[|;\t\"=]|  ")
_COLUMN = re.compile(r"[|;=]| {2,}(?=\S)")

FEATURES = [
    "function_share", "function_kinds", "digit_share", "odd_share", "word_length", "words_per_line", "lines_ended", "bullets", "aligned",
    "short_lines", "capital_share", "repeated", "vowel_share", "hard_words", "inner_signs", "long_pieces", "sentence_ends", "broken", "letters_share", "gap_lines",
    "indent_period", "length_period", "columns",
]


def _delimiters(line: str, pieces: int) -> tuple[int, ...]:
    """How often a line of so many pieces has each delimiter: | ; tab "," || wide gap = and comma."""
    commas = line.count(",")
    if not _DELIMITER.search(line):
        return 0, 0, 0, 0, 0, 0, 0, commas
    tabs, gaps = line.count("\t"), len(_GAPS.findall(line))
    if pieces >= 12 and max(tabs, gaps) >= 0.6 * (pieces - 1):
        tabs = gaps = 0  # a text whose spaces are tabs or doubled, and no row of cells
    return line.count("|"), line.count(";"), tabs, line.count('","'), line.count("||"), gaps, line.count("="), commas


def _aligned(shapes: list[tuple[int, ...]], owner: list[int]) -> list[bool]:
    """Whether a line shares a delimiter, as many times, with the line of its text before or after; commas count from three on."""
    out = [False] * len(shapes)
    for i in range(1, len(shapes)):
        a, b = shapes[i - 1], shapes[i]
        if owner[i] != owner[i - 1]:
            continue
        if (a[7] == b[7] >= 3) or (any(a[:7]) and any(x == y > 0 for x, y in zip(a[:7], b[:7], strict=True))):
            out[i - 1] = out[i] = True
    return out


def _columns(line: str, shape: tuple[int, ...]) -> frozenset[int]:
    """The columns in which a line has | ; = or begins again behind a wide gap or a tab; what leads the line doesn't count."""
    if not any(shape[:3]) and not shape[5] and not shape[6]:
        return frozenset()
    own = line.expandtabs(8).rstrip()
    lead = len(own) - len(own.lstrip())
    return frozenset(m.end() for m in _COLUMN.finditer(own, lead + 1))


def _in_columns(columns: list[frozenset[int]], owner: list[int]) -> list[float]:
    """How many of a line's columns the line of its text before or after has too, as a share of the columns of the one that has
    more; the greater of both."""
    out = [0.0] * len(columns)
    for i in range(1, len(columns)):
        a, b = columns[i - 1], columns[i]
        if a and b and owner[i] == owner[i - 1]:
            share = len(a & b) / max(len(a), len(b))
            out[i - 1], out[i] = max(out[i - 1], share), max(out[i], share)
    return out


def _repeats(tokens: list[str], owner: np.ndarray, n: int = 10) -> np.ndarray:
    """Words of passages that their text says three times or more on end.

    The sentences of a small repertoire that come back now and then are no such passage: the copies must follow each other.
    """
    out = np.zeros(len(tokens), bool)
    if len(tokens) < n + 2:
        return out
    runs = gram_hashes(np.array([hash(t) for t in tokens], np.int64).view(np.uint64), n)
    at = np.flatnonzero(owner[: len(runs)] == owner[n - 1 :])
    _, which = np.unique(runs[at] ^ (owner[at].astype(np.uint64) << np.uint64(40)), return_inverse=True)
    order = np.argsort(which, kind="stable")
    same = which[order][1:] == which[order][:-1]
    gap = np.zeros(len(runs) + 1, np.int64)  # to the next place of the same run of words; 0 without one
    gap[at[order][:-1][same]] = np.diff(at[order])[same]
    place = np.arange(len(gap))
    thrice = (gap > 0) & (gap[np.minimum(place + gap, len(gap) - 1)] == gap)
    starts = np.flatnonzero(thrice & ~np.concatenate([[False], thrice[:-1] & (gap[1:] == gap[:-1])]))
    stops = np.flatnonzero(thrice & ~np.concatenate([thrice[1:] & (gap[1:] == gap[:-1]), [False]])) + 1
    for i, j in zip(starts.tolist(), stops.tolist(), strict=True):
        period = int(gap[i])
        if j - i >= period - n + 1:
            out[i : j - 1 + 2 * period + n] = True
    return out


def _autocorrelation(values: list[int], lag: int) -> float:
    if len(values) <= lag + 1:
        return 0.0
    x = np.asarray(values, float)
    x = x - x.mean()
    power = float((x * x).sum())
    return float((x[lag:] * x[:-lag]).sum() / power) if power else 1.0


def _period(values: list[int]) -> float:
    """The greatest autocorrelation over a lag of one to four lines."""
    return max(_autocorrelation(values, lag) for lag in (1, 2, 3, 4))


# Bits of a character's class.
_LETTER, _DIGITS, _VOWELS, _UPPER, _STRANGE, _BROKE = 1, 2, 4, 8, 16, 32


def _char_classes() -> np.ndarray:
    """Class of each character of the basic plane; the rest count as strange, but for letters."""
    out = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            out[code] = _LETTER | (_VOWELS if _VOWEL.match(c) else 0) | (_UPPER if c.isupper() else 0)
        elif c.isdecimal():
            out[code] = _DIGITS
        elif not 0xD800 <= code < 0xE000 and _ODD.match(c):
            out[code] = _STRANGE
    for c in "ÂÃâ¢€�":
        out[ord(c)] |= _BROKE
    return out


_CLASSES: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_char_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 0x10000:
        out = _CLASSES[0][np.minimum(codes, 0xFFFF)]
        high = codes >= 0x10000
        out[high] = [_LETTER if chr(c).isalpha() else _STRANGE for c in codes[high]]
        return out
    return _CLASSES[0][codes]


class Shape:
    """The shapes of some texts: their lines and pieces between white space, with what is known of each line and character."""

    def __init__(self, texts: list[str]) -> None:
        self.lines: list[str] = []
        self.text_of_line: list[int] = []
        for n, text in enumerate(texts):
            own = [line for line in _LINES.split(text) if line and not line.isspace()]
            self.lines += own
            self.text_of_line += [n] * len(own)
        self.pieces = [line.split() for line in self.lines]
        self.bullet = [_BULLET.match(line) is not None for line in self.lines]
        self.ended = [_END.search(line) is not None for line in self.lines]
        self.shapes = [_delimiters(line, len(own)) for line, own in zip(self.lines, self.pieces, strict=True)]
        self.aligned = _aligned(self.shapes, self.text_of_line)
        self.in_columns = _in_columns([_columns(line, x) for line, x in zip(self.lines, self.shapes, strict=True)], self.text_of_line)
        self.flat = [p for own in self.pieces for p in own]
        self.words = len(self.flat)
        self.joined = " ".join(self.flat)
        self.classes = _classes(self.joined)
        self.sizes = np.fromiter(map(len, self.flat), np.int64, self.words)
        owner = np.repeat(np.array(self.text_of_line, np.int64), [len(own) for own in self.pieces])
        self.repeated = _repeats(self.flat, owner)
        letter = (self.classes & _LETTER) > 0
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # of the runs of letters
        self.found = [self.joined[i:j].lower() for i, j in zip(self.starts.tolist(), self.stops.tolist(), strict=True)]
        self.function = np.fromiter((w in FUNCTION_WORDS for w in self.found), bool, len(self.found))

    @property
    def indents(self) -> list[int]:
        """Characters before the text of each line."""
        return [len(line) - len(line.lstrip()) for line in self.lines]

    def periods(self) -> np.ndarray:
        """For each text the periods of its indentation (0 if no line is indented) and of its line lengths."""
        count = self.text_of_line[-1] + 1 if self.text_of_line else 0
        bounds = np.searchsorted(self.text_of_line, np.arange(count + 1)).tolist()
        indents, out = self.indents, np.zeros((count, 2))
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if b - a > 2:
                out[n] = max(0.0, _period(indents[a:b])) if any(indents[a:b]) else 0.0, max(0.0, _period([len(x) for x in self.lines[a:b]]))
        return out

    def stretches(self, size: int = STRETCH) -> tuple[list[int], list[list[int]]]:
        """Consecutive stretches of about ``size`` pieces, long lines being cut: where each begins, with the end of the last,
        and the lines of each."""
        cuts, rows = [0], []
        lines: list[int] = []
        at = chars = 0
        sizes = self.sizes.tolist()
        text = -1
        for n, own in enumerate(self.pieces):
            if self.text_of_line[n] != text:
                text = self.text_of_line[n]
                if lines:
                    cuts.append(at)
                    rows.append(lines)
                    lines, chars = [], 0
            for start in range(0, max(1, len(own)), size):
                part = min(size, len(own) - start)
                chars += sum(sizes[at : at + part])
                at += part
                lines.append(n)
                if at - cuts[-1] >= size or chars >= 8 * size:
                    cuts.append(at)
                    rows.append(lines)
                    lines, chars = [], 0
        if at > cuts[-1]:
            cuts.append(at)
            rows.append(lines)
        return cuts, rows

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features of each stretch, in the order of FEATURES, its characters without white space, and its text."""
        cuts, rows = self.stretches()
        if not rows:
            return np.empty((0, len(FEATURES))), np.empty(0), np.empty(0, np.int64)
        pieces = np.diff(cuts)
        ends = np.cumsum(self.sizes + 1)  # behind the space after each piece
        places = np.concatenate([[0], ends[np.array(cuts[1:]) - 1]])
        at = places[:-1]
        count = lambda bit: np.add.reduceat((self.classes & bit) > 0, at, dtype=np.int64)
        solid = np.maximum(1, np.add.reduceat(self.sizes, cuts[:-1]))
        letters, vowels = count(_LETTER), count(_VOWELS)
        runs = np.searchsorted(self.starts, places)
        found = np.maximum(1, np.diff(runs))
        long = self.stops - self.starts
        of_runs = np.concatenate([[0], np.cumsum((self.classes & _VOWELS) > 0)])
        run_vowels = of_runs[self.stops] - of_runs[self.starts]
        hard = (long > 3) & ((run_vowels == 0) | (long > 5 * run_vowels))
        within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[runs])
        by_piece = lambda flags: np.add.reduceat(flags, cuts[:-1], dtype=np.int64)
        ended = np.fromiter((p[-1] in ".!?…" or p[-2:] in ('."', ".»", ".”") for p in self.flat), bool, self.words)
        bounds = places.tolist()
        inner = np.array([len(_INNER.findall(self.joined, i, j)) for i, j in zip(bounds, bounds[1:], strict=False)])
        function = self.function.nonzero()[0]
        owner = np.searchsorted(runs, function, "right") - 1
        kinds = np.zeros(len(rows))
        for n, _ in {(n, self.found[w]) for n, w in zip(owner.tolist(), function.tolist(), strict=True)}:
            kinds[n] += 1
        lines = np.array([len(r) for r in rows])
        texts = np.array([self.text_of_line[r[0]] for r in rows])
        share = lambda flags: np.array([sum(flags[i] for i in r) for r in rows]) / lines
        short = [len(own) <= 5 and not end for own, end in zip(self.pieces, self.ended, strict=True)]
        out = np.column_stack([
            within(self.function) / found, kinds / np.minimum(found, STRETCH), count(_DIGITS) / solid, count(_STRANGE) / solid, np.minimum(letters / found, 20.0),
            np.log1p(pieces / lines), share(self.ended), share(self.bullet), share(self.aligned), share(short),
            within((self.classes[self.starts] & _UPPER) > 0) / found, by_piece(self.repeated) / pieces, vowels / np.maximum(1, letters), within(hard) / found,
            inner / pieces, by_piece(self.sizes > 25) / pieces + solid / pieces / 50, by_piece(ended) / pieces, count(_BROKE) / pieces, letters / solid,
            share([s[5] > 0 for s in self.shapes]), self.periods()[texts], share(self.in_columns),
        ])
        return out, solid.astype(float), texts


def stretch_features(texts: list[str], chars: int = 400_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the features of its stretches, and their weights: the characters without white space.

    Texts are measured together, as many as have about ``chars`` characters; each by itself would give the same.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    batch: list[str] = []
    size = 0
    for n, text in enumerate(texts):
        batch.append(text)
        size += len(text)
        if size >= chars or n == len(texts) - 1:
            rows, weights, owner = Shape(batch).features()
            bounds = np.searchsorted(owner, np.arange(len(batch) + 1))
            out += [(rows[a:b], weights[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            batch, size = [], 0
    return out


def _expanded(rows: np.ndarray) -> np.ndarray:
    return np.hstack([rows, np.sqrt(np.abs(rows)), rows**2])


class ProseModel:
    """Logistic model of a stretch being no prose; without labels of both classes there is none, and plain rules decide."""

    def __init__(self, mean: np.ndarray | None = None, spread: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights

    def other(self, rows: np.ndarray) -> np.ndarray:
        """Probability of each stretch (a row of features) to be list, table or junk."""
        at = FEATURES.index
        if self.weights is None:
            odd = (rows[:, at("function_share")] < 0.12) | (rows[:, at("bullets")] > 0.5) | (rows[:, at("aligned")] > 0.5) | (rows[:, at("odd_share")] > 0.2) | (rows[:, at("repeated")] > 0.5)
            out = odd.astype(float)
        else:
            z = np.hstack([(_expanded(rows) - self.mean) / self.spread, np.ones((len(rows), 1))])
            out = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        # What the text says again and again is junk, whatever it says.
        out = 1 - (1 - out) * (1 - rows[:, at("repeated")])
        # Pieces of letters as long as lines: words run together.
        out[(rows[:, at("long_pieces")] > 0.8) & (rows[:, at("letters_share")] > 0.7)] = 1.0
        return out

    @classmethod
    def fit(cls, docs: list[tuple[bool, np.ndarray]], ridge: float = 3.0, rounds: int = 4) -> ProseModel:
        """Fits on documents: whether a label says it is no prose, and the features of its stretches.

        Labels are of documents and a few are wrong: between the rounds, stretches that clearly look like the other class
        change over, so that a prose opening of a list teaches prose. Where a class has no document there is no model.
        """
        docs = [(y, x) for y, x in docs if len(x)]
        if len({bool(y) for y, _ in docs}) < 2:
            return cls()
        rows = _expanded(np.vstack([x for _, x in docs]))
        label = np.repeat([float(y) for y, _ in docs], [len(x) for _, x in docs])
        weight = np.repeat([1 / np.sqrt(len(x)) for _, x in docs], [len(x) for _, x in docs])
        mean, spread = rows.mean(0), rows.std(0) + 1e-9
        z = np.hstack([(rows - mean) / spread, np.ones((len(rows), 1))])
        target, b = label.copy(), np.zeros(z.shape[1])
        for _ in range(rounds):
            b = np.zeros(z.shape[1])
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
                step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (weight * (p - target)) + ridge * b)
                b -= step
                if np.abs(step).max() < 1e-5:
                    break
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            target = np.where(label == 1, np.where(p < 0.2, 0.0, 1.0), np.where(p > 0.9, 1.0, 0.0))
        return cls(mean, spread, b)


def other_shares(texts: list[str | None], model: ProseModel) -> list[float | None]:
    """Share of each text, by characters, that is no prose; null for null, empty and blank texts."""
    sound = [n for n, t in enumerate(texts) if t and t.strip()]
    out: list[float | None] = [None] * len(texts)
    measured = stretch_features([texts[n] for n in sound])
    if measured:
        other = model.other(np.vstack([rows for rows, _ in measured]))
        at = 0
        for n, (rows, weights) in zip(sound, measured, strict=True):
            total = weights.sum()
            out[n] = float((other[at : at + len(rows)] * weights).sum() / total) if total else None
            at += len(rows)
    return out


def other_share(text: str | None, model: ProseModel) -> float | None:
    """``other_shares`` of one text."""
    return other_shares([text], model)[0]


_STATS = [
    "mean_word_length", "symbol_ratio", "digit_ratio", "lines", "ended_line_share", "common_word_share", "bullet_line_share", "delimiter_alignment", "delimiter_columns",
    "indent_period", "length_period", "length_autocorrelation", "repeated_share",
]


def _statistics(shape: Shape, count: int) -> list[dict[str, float | int | None]]:
    """The statistics of each text of a shape; all have words."""
    bounds = np.searchsorted(shape.text_of_line, np.arange(count + 1))
    pieces = np.concatenate([[0], np.cumsum([len(own) for own in shape.pieces])])[bounds]
    places = np.minimum(np.concatenate([[0], np.cumsum(shape.sizes + 1)])[pieces], len(shape.classes))
    runs = np.searchsorted(shape.starts, places)

    def total(x: list | np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[at])

    lines, words = np.diff(bounds), np.maximum(1, np.diff(runs))
    solid = np.maximum(1, total(shape.sizes, pieces))
    share = lambda bit: total((shape.classes & bit) > 0, places) / solid
    lengths = [len(x) for x in shape.lines]
    columns = {
        "mean_word_length": total(shape.stops - shape.starts, runs) / words, "symbol_ratio": share(_STRANGE), "digit_ratio": share(_DIGITS), "lines": lines,
        "ended_line_share": total(shape.ended, bounds) / lines, "common_word_share": total(shape.function, runs) / words, "bullet_line_share": total(shape.bullet, bounds) / lines,
        "delimiter_alignment": total(shape.aligned, bounds) / lines, "delimiter_columns": total(shape.in_columns, bounds) / lines,
        "indent_period": shape.periods()[:, 0], "length_period": shape.periods()[:, 1],
        "length_autocorrelation": [_autocorrelation(lengths[a:b], 1) for a, b in zip(bounds, bounds[1:], strict=False)],
        "repeated_share": total(shape.repeated, pieces) / np.maximum(1, np.diff(pieces)),
    }
    return [{n: int(x[i]) if n == "lines" else float(x[i]) for n, x in columns.items()} for i in range(count)]


def text_shapes(texts: list[str | None], model: ProseModel | None = None, chars: int = 400_000) -> list[dict[str, float | int | None]]:
    """The statistics of each text; without words every share is 0. Texts are measured together, each as it would be by itself."""
    none = dict.fromkeys(_STATS, 0.0) | {"lines": 0, "other_share": None}
    out = [none] * len(texts)
    sound = [n for n, t in enumerate(texts) if t and t.strip()]
    batch: list[int] = []
    size = 0
    for n in sound:
        batch.append(n)
        size += len(texts[n])
        if size >= chars or n == sound[-1]:
            shape = Shape([texts[i] for i in batch])
            other: list[float | None] = [None] * len(batch)
            if model:
                rows, weights, owner = shape.features()
                gone = model.other(rows) * weights
                other = [float(x) for x in np.bincount(owner, gone, len(batch)) / np.maximum(1, np.bincount(owner, weights, len(batch)))]
            for i, own, o in zip(batch, _statistics(shape, len(batch)), other, strict=True):
                out[i] = own | {"other_share": o}
            batch, size = [], 0
    return out


def text_shape(text: str | None, model: ProseModel | None = None) -> dict[str, float | int | None]:
    """``text_shapes`` of one text."""
    return text_shapes([text], model)[0]


def fit_prose_model(docs: DataFrame, labels: DataFrame, key: str = "docid", text: str = "text", label: str = "label", most: int = TRAIN_DOCS) -> ProseModel:
    """Fits the model on at most ``most`` labelled documents, those of smallest hash of the key.

    Null labels and keys don't count; of several texts of a key the longest does; a label other than ``prose`` means no prose.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.when(F.col(label) == "prose", 0).otherwise(1)).alias("other"))
    known = known.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)
    texts = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text).alias("text")).join(F.broadcast(known), key)
    longest = texts.groupBy(F.col(key).cast("string").alias("key"), "other").agg(F.max(F.struct(F.length("text").alias("size"), "text")).alias("x")).select("key", "other", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [rows[np.unique(np.linspace(0, max(0, len(rows) - 1), min(len(rows), TRAIN_STRETCHES)).astype(int))] for rows, _ in stretch_features(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("other"), pa.array([x.astype(np.float32).tobytes() for x in out], pa.binary())], names=["key", "other", "rows"])

    # At most ``most`` labelled documents, each of at most TRAIN_STRETCHES rows of single precision.
    found = spread(longest).mapInArrow(run, "key string, other int, rows binary").collect()
    return ProseModel.fit([(bool(other), np.frombuffer(flat, np.float32).astype(float).reshape(-1, len(FEATURES))) for _, other, flat in sorted(found)])


_SHAPE_TYPE = pa.struct([(n, pa.int32() if n == "lines" else pa.float64()) for n in [*_STATS, "other_share"]])


def shape_of(text: Column, model: ProseModel | None = None) -> Column:
    """``text_shape`` as an expression: a struct of the statistics."""
    kind = "struct<" + ",".join(f"{f.name}:{'int' if f.name == 'lines' else 'double'}" for f in _SHAPE_TYPE) + ">"

    @F.arrow_udf(kind)
    def shape(texts: pa.Array) -> pa.Array:
        return pa.array(text_shapes(texts.to_pylist(), model), _SHAPE_TYPE)

    return shape(text)


def share_of_other(text: Column, model: ProseModel) -> Column:
    """``other_share`` as an expression."""

    @F.arrow_udf("double")
    def share(texts: pa.Array) -> pa.Array:
        return pa.array(other_shares(texts.to_pylist(), model), pa.float64())

    return share(text)


def text_statistics(df: DataFrame, text: str, model: ProseModel | None = None, claimed: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with the statistics of each text: ``words`` (afresh), ``words_claimed_right`` if the column
    ``claimed`` is given, the shares of ``text_shape``, and with a model ``other_share``.

    Null, empty and blank texts have 0 words, shares of 0 and a null ``other_share``; columns of these names are replaced;
    texts are read whole, a row at a time, without a shuffle.
    """
    fresh = word_count(F.col(f"`{text}`"))
    names = ["words", *(["words_claimed_right"] if claimed else []), *_STATS, *(["other_share"] if model else [])]
    out = spread(df).withColumn("__shape", shape_of(F.col(f"`{text}`"), model)).withColumn("__words", fresh)
    extra = [F.col("__words").alias("words")]
    if claimed:
        extra.append(F.coalesce(F.col(f"`{claimed}`") == F.col("__words"), F.lit(False)).alias("words_claimed_right"))
    extra += [F.col(f"__shape.{n}").alias(n) for n in names if n in _STATS or n == "other_share"]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != text and c not in names], *extra)


def not_prose(docs: DataFrame, labels: DataFrame, key: str = "docid", text: str = "text", label: str = "label") -> DataFrame:
    """(key): the keys of which a text is for more than half of its characters a list, a table or junk.

    Null, empty and blank texts are no cases, null keys neither; a key with several texts counts if one of them does.
    """
    model = fit_prose_model(docs, labels, key, text, label)
    sound = spread(docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text))
    return sound.where(share_of_other(F.col(text), model) > 0.5).select(key).distinct()
