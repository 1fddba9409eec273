"""Evaluation texts that leak into a corpus.

Method: winnowing. Of the hashes of all runs of k words, the least of each sliding window is kept, so that two texts which
share a run of at least window + k - 1 words share a kept hash. The kept hashes of corpus and test items are joined, and
each hit is extended to both sides, over single words that were changed, added or left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tasks import spread
from rankloom.llm.words import gram_hashes, word_hashes, words
from rankloom.session import cut_lineage

K = 5
WINDOW = 2
#: Running words of an item that make a case.
RUN = 25
#: Share of the words of a run, or of a whole short item, that must be the same.
ALIKE = 0.75
#: Share of the rare words of a run that must be the same; a word is rare if at most this share of the items, or one, has it.
ALIKE_RARE, RARE = 0.5, 0.02
#: Share of a short item that counts as the whole.
WHOLE = 0.8
#: A run of so many words that so many different items have is a stock notice.
STOCK_WORDS, STOCK_ITEMS = 10, 3
#: Least words of a part of a copy that was broken up.
PART = 8
#: Most words skipped at once on either side.
SKIP = 4
#: Most words of all test items that are sent to every task; beyond it, fingerprints are joined by a shuffle.
MAX_ITEM_WORDS = 2_000_000
#: Parts that the documents of one fingerprint, or of one item, are cut into for the shuffles; the items' side is repeated for each.
PARTS = 16
#: Wordings that a task keeps prepared.
PREPARED = 1000


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the kept hashes, ascending: of each window the least, of equal ones the last."""
    n = len(grams)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))]) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


@dataclass
class Segment:
    """A run of an item found in a text: where it is in the item and the text, the equal places of the item, and how many
    words were changed, added or left out between them."""

    start: int
    stop: int
    at: int
    until: int
    equal: list[int]
    changed: int


def _walk(a: list, b: list, i: int, j: int, step: int) -> tuple[int, int, list[int], int]:
    """Extends from a[i] == b[j] in direction ``step``: the last equal places, all equal places in ``a``, the changes."""
    equal: list[int] = []
    changed = kept = 0
    last = (i, j)
    la, lb = len(a), len(b)
    while 0 <= i < la and 0 <= j < lb:
        if a[i] == b[j]:
            equal.append(i)
            last, kept = (i, j), changed
            i += step
            j += step
            continue
        found = None
        for total in range(1, 2 * SKIP + 1):
            for di in range(max(0, total - SKIP), min(SKIP, total) + 1):
                x, y = i + di * step, j + (total - di) * step
                if not (0 <= x < la and 0 <= y < lb) or a[x] != b[y]:
                    continue
                x2, y2 = x + step, y + step
                if not 0 <= x2 < la or (0 <= y2 < lb and a[x2] == b[y2]):
                    found = (x, y, max(di, total - di))
                    break
            if found:
                break
        if not found:
            break
        changed += found[2]
        if changed > 6 + (len(equal) + changed) // 3:
            break
        i, j = found[0], found[1]
    return *last, equal, kept


def segments(item: list, text: list, hits: list[tuple[int, int]], k: int = K) -> list[Segment]:
    """The runs of ``item`` in ``text`` around the hits (place in the item, place in the text)."""
    out: list[Segment] = []
    for i, j in sorted(hits, key=lambda h: (h[1], h[0])):
        if any(s.start <= i < s.stop and s.at <= j < s.until for s in out) or item[i : i + k] != text[j : j + k]:
            continue
        ri, rj, right, r_changed = _walk(item, text, i, j, 1)
        li, lj, left, l_changed = _walk(item, text, i, j, -1)
        out.append(Segment(li, ri + 1, lj, rj + 1, left[:0:-1] + right, r_changed + l_changed))
    return out


class Items:
    """The distinct wordings of the test items, with the ids that have them and their stock words.

    A text may be given as its words. ``common`` words and the hashes of ``stock`` runs are counted among the rows, unless they are given for a part of all items.
    """

    def __init__(self, rows: list[tuple[int, str | list[str] | None]], k: int = K, window: int = WINDOW, common: frozenset[str] | None = None, stock: set[int] | None = None) -> None:
        self.k, self.window = k, window
        ids: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item_id, text in rows:
            if item_id is not None and (own := tuple(text if isinstance(text, list) else words(text))):
                ids[own].append(item_id)
        self.words = [list(w) for w in sorted(ids)]
        self.ids = [sorted(set(ids[tuple(w)])) for w in self.words]
        if common is None:
            count = Counter(w for own in self.words for w in set(own))
            common = frozenset(w for w, n in count.items() if n > 1 + RARE * len(self.words))
        self.rare = [[w not in common for w in own] for own in self.words]
        grams = [gram_hashes(word_hashes(w), STOCK_WORDS) for w in self.words]
        often = stock if stock is not None else {g for g, n in Counter(g for own in grams for g in set(own.tolist())).items() if n >= STOCK_ITEMS}
        self.stock = []
        for w, own in zip(self.words, grams, strict=True):
            flags = [False] * len(w)
            for at, g in enumerate(own.tolist()):
                if g in often:
                    flags[at : at + STOCK_WORDS] = [True] * STOCK_WORDS
            self.stock.append(flags)

        self.rare_words = [[w for w, r, x in zip(own, flags, stock, strict=True) if r and not x] for own, flags, stock in zip(self.words, self.rare, self.stock, strict=True)]
        self.needed = [self._least_rare(n) for n in range(len(self.words))]

    def _least_rare(self, number: int) -> int:
        """Rare words of an item that a text with a copy of it has at least, whichever part the copy is of."""
        flags = np.array([r and not x for r, x in zip(self.rare[number], self.stock[number], strict=True)], int)
        length = len(flags) - sum(self.stock[number])
        sums = np.concatenate([[0], np.cumsum(flags)])

        def least(size: int) -> int:
            size = max(1, min(size, len(flags)))
            return int((sums[size:] - sums[:-size]).min())

        total = RUN if length >= RUN else math.ceil(WHOLE * length)
        part = min(PART, length)
        # A copy is one run, or up to total / part runs of at least part words.
        bounds = [least(total)]
        for parts in range(2, max(1, -(-total // max(1, part))) + 1):
            bounds.append(parts * least(part))
        return max(1, math.ceil(ALIKE_RARE * min(bounds)))

    def possible(self, number: int, text: set[str]) -> bool:
        """Whether a text with these words can have a copy of the item."""
        need = self.needed[number]
        for w in self.rare_words[number]:
            if w in text:
                need -= 1
                if need <= 0:
                    return True
        return False

    def fingerprints(self) -> list[tuple[int, int, int]]:
        """(hash, number of the wording, place). Items of fewer than k words have their only hash over all of them."""
        out = []
        for n, w in enumerate(self.words):
            grams = gram_hashes(word_hashes(w), min(self.k, len(w)))
            kept = range(len(grams))  # all places, as the kept ones of the texts are a share of theirs
            out += [(int(grams[p]), n, p) for p in kept]
        return out

    def parts(self, number: int, text: list[str], hits: list[tuple[int, int]]) -> list[tuple[int, Segment]]:
        """The segments of an item that are copies, with their length in words, without stock notices.

        Enough words of a copy are the same, and of the rare words too: two texts made after one pattern differ in these.
        """
        item, stock, rare = self.words[number], self.stock[number], self.rare[number]
        out = []
        for s in segments(item, text, hits, min(self.k, len(item))):
            places = [p for p in range(s.start, s.stop) if not stock[p]]
            equal = [p for p in s.equal if not stock[p]]
            scarce = sum(rare[p] for p in places)
            if equal and len(s.equal) >= ALIKE * (len(s.equal) + s.changed) and sum(rare[p] for p in equal) >= ALIKE_RARE * scarce > 0:
                out.append((len(places), s))
        return out

    def leaks(self, number: int, text: list[str], hits: list[tuple[int, int]]) -> bool:
        """Whether ``text`` has the whole item or a long enough run of it, given the hits of both."""
        item = self.words[number]
        length = len(item) - sum(self.stock[number])
        found = self.parts(number, text, hits)
        # A copy that was broken up has parts that overlap neither in the item nor in the text.
        used, total, taken = [False] * len(item), 0, []
        for own, s in sorted(found, key=lambda x: (-x[0], x[1].start, x[1].at)):
            if own >= RUN:
                return True
            if own >= min(PART, length) and not any(used[s.start : s.stop]) and not any(s.at < b and a < s.until for a, b in taken):
                taken.append((s.at, s.until))
                used[s.start : s.stop] = [True] * (s.stop - s.start)
                total += own
        return total >= min(RUN, WHOLE * length) > 0


def _hashed(k: int, window: int, short: tuple[int, ...] = ()):  # noqa: ANN202
    """Rows (key, text) to their kept hashes of k words, and all hashes of the ``short`` lengths, each once, with their lengths."""
    schema = pa.schema([("key", pa.int64()), ("length", pa.int32()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = word_hashes(words(text))
                grams = gram_hashes(hashes, k)
                for length, kept in ((k, grams[winnow(grams, window)]), *((n, gram_hashes(hashes, n)) for n in short)):
                    if len(kept):
                        kept = np.unique(kept)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), key), pa.int64()), pa.array(np.full(len(kept), length), pa.int32()), pa.array(kept.view(np.int64))], schema=schema)

    return run


def _wordings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text) to (item, words), without wordless texts."""
    for batch in batches:
        own = [(i, words(t)) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        own = [(i, w) for i, w in own if w]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([w for _, w in own], pa.list_(pa.string()))], names=["item", "words"])


def _grams(size: int | None, most: int):  # noqa: ANN202
    """Rows (wording, words) to (wording, length, fingerprint): each hash of ``size`` words once, or without it of ``most`` or, if fewer, all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column("wording").to_pylist(), batch.column("words").to_pylist(), strict=True):
                length = size or min(most, len(own))
                kept = np.unique(gram_hashes(word_hashes(own), length))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(kept), pa.string()), pa.array(np.full(len(kept), length), pa.int32()), pa.array(kept.view(np.int64))], names=["wording", "length", "fingerprint"])

    return run


def _in_text(items: Items, table: dict[int, list[tuple[int, int]]], shortest: list[int], known: np.ndarray, text: str | None) -> list[int]:
    """Numbers of the wordings that leak into ``text``: join of the fingerprints with those of the items, then extension."""
    own = words(text)
    if not own:
        return []
    hashes = word_hashes(own)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    grams = gram_hashes(hashes, items.k)
    places = winnow(grams, items.window)
    at = np.minimum(np.searchsorted(known, grams[places]), len(known) - 1)
    for place in places[known[at] == grams[places]].tolist():
        for number, at in table[int(grams[place])]:
            hits[number].append((at, place))
    for k in shortest:  # items of fewer than k words have no run of k
        for place, gram in enumerate(gram_hashes(hashes, k).tolist()):
            for number, at in table.get(gram, ()):
                if len(items.words[number]) == k:
                    hits[number].append((at, place))
    if not hits:
        return []
    present = set(own)
    return [n for n, h in hits.items() if items.possible(n, present) and items.leaks(n, own, h)]


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = K, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """(doc_key, item_key) of every document that has a whole item or at least 25 running words of it.

    Copies count even if they differ in case, accents, punctuation, markup, look-alike letters or line breaks, if single
    words were changed, added or left out, or if they were broken up. Stock notices that several items share don't count
    towards the length, nor do passages that share an item's pattern but not its names and numbers. Items of one wording
    count each; so do repeated documents. Null, empty and wordless texts and null keys on either side give no rows; an item
    of fewer than 5 words must occur as it is. Texts are read whole.

    The fingerprints of the test items are joined in the tasks if the items have at most ``max_item_words`` words together,
    which bounds what is broadcast. Larger test sets are joined by a shuffle on the fingerprint.
    """
    spark = docs.sparkSession
    sound_items = items.where(F.col(f"`{item_key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{text}`").alias("text"))
    rows = docs.where(F.col(f"`{doc_key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    size = sound_items.agg(F.sum(F.length("text"))).first()[0] or 0
    out = f"`{doc_key}` bigint, `{item_key}` bigint"
    if not size:
        return spark.createDataFrame([], out)
    if size <= 8 * max_item_words:
        listed = sound_items.select(F.col("item").cast("bigint"), "text").collect()
        return _joined_in_tasks(rows, [(r[0], r[1]) for r in listed], k, window, doc_key, item_key)
    return _joined_by_shuffle(rows, sound_items, k, window, doc_key, item_key)


def _tables(items: Items) -> tuple[dict[int, list[tuple[int, int]]], list[int], np.ndarray]:
    table: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for gram, number, at in items.fingerprints():
        table[gram].append((number, at))
    return dict(table), sorted({len(w) for w in items.words if len(w) < items.k}), np.sort(np.fromiter(table, np.uint64, len(table)))


_BUILT: dict[tuple, tuple] = {}


def _built(mark: tuple, listed: list[tuple[int, str]], k: int, window: int) -> tuple[Items, tuple]:
    """The items and their tables, made once in each worker for one test set."""
    if mark not in _BUILT:
        _BUILT.clear()
        items = Items(listed, k, window)
        _BUILT[mark] = items, _tables(items)
    return _BUILT[mark]


def _joined_in_tasks(rows: DataFrame, listed: list[tuple[int, str]], k: int, window: int, doc_key: str, item_key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(listed)
    mark = (xxhash.xxh128_hexdigest("\0".join(f"{i} {t}" for i, t in sorted(listed)).encode("utf-8", "surrogatepass")), k, window)
    schema = pa.schema([(doc_key, pa.int64()), (item_key, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, tables = _built(mark, shared.value, k, window)
        for batch in batches:
            docs, found = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for number in _in_text(items, *tables, text):
                    docs += [key] * len(items.ids[number])
                    found += items.ids[number]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], schema=schema)

    return spread(rows).mapInArrow(run, f"`{doc_key}` bigint, `{item_key}` bigint").distinct()


def _joined_by_shuffle(rows: DataFrame, items: DataFrame, k: int, window: int, doc_key: str, item_key: str) -> DataFrame:
    """For test sets of any size: fingerprints meet in a shuffle, candidate pairs are spread by pair and extended there.

    Rare words and stock notices are counted over all wordings in tables and joined to the pairs, and wordings of fewer than
    k words meet by the hash of all their words, so the rows are those of ``_joined_in_tasks``. Broadcast are only the words
    that are common, of which there are at most 1 / RARE times the mean number of different words of a wording.
    """
    spark = rows.sparkSession
    listed = spread(items.select(F.col("item").cast("bigint").alias("item"), "text")).mapInArrow(_wordings, "item bigint, words array<string>")
    test = cut_lineage(listed.groupBy("words").agg(F.collect_set("item").alias("ids")).withColumn("wording", F.sha2(F.concat_ws(" ", "words"), 256)))
    number = test.count()
    uses = test.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    common = spark.sparkContext.broadcast(frozenset(r[0] for r in uses.where(F.col("count") > 1 + RARE * number).select("word").collect()))
    short = tuple(r[0] for r in test.select(F.size("words")).where(F.size("words") < k).distinct().collect())
    plain = test.select("wording", "words")
    kinds = "wording string, length int, fingerprint bigint"
    notices = plain.where(F.size("words") >= STOCK_WORDS).mapInArrow(_grams(STOCK_WORDS, STOCK_WORDS), kinds)
    often = notices.groupBy("fingerprint").count().where(F.col("count") >= STOCK_ITEMS).select("fingerprint")
    stock = notices.join(often, "fingerprint").groupBy("wording").agg(F.collect_set("fingerprint").alias("stock"))
    told = test.join(stock, "wording", "left")

    # A fingerprint or an item that a third of all documents have is shared by PARTS tasks.
    part = F.pmod(F.shiftright("key", 32), F.lit(PARTS).cast("bigint")).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part")
    doc_marks = spread(rows).select(F.xxhash64("key", "text").alias("key"), "text").mapInArrow(_hashed(k, window, short), "key bigint, length int, fingerprint bigint")
    pairs = doc_marks.select("*", part).join(plain.mapInArrow(_grams(None, k), kinds).select("*", every), ["length", "fingerprint", "part"]).select("key", "wording").distinct()
    texts = rows.select(F.xxhash64("key", "text").alias("mark"), F.col("key").alias("doc"), "text").distinct()
    work = pairs.join(texts, pairs["key"] == F.col("mark")).select("*", part).join(told.select("*", every), ["wording", "part"]).select("wording", "doc", "text", "words", "ids", "stock")
    schema = pa.schema([(doc_key, pa.int64()), (item_key, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: dict[str, tuple] = {}
        for batch in batches:
            docs, found = [], []
            for row in batch.to_pylist():
                if row["wording"] not in prepared:
                    often = set(np.array(row["stock"] or [], np.int64).view(np.uint64).tolist())
                    one = Items([(0, row["words"])], k, window, common.value, often)
                    if len(prepared) >= PREPARED:
                        prepared.clear()
                    prepared[row["wording"]] = one, *_tables(one)
                if _in_text(*prepared[row["wording"]], row["text"]):
                    docs += [row["doc"]] * len(row["ids"])
                    found += row["ids"]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], schema=schema)

    return work.mapInArrow(run, f"`{doc_key}` bigint, `{item_key}` bigint").distinct()
