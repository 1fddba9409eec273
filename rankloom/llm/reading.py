"""Reading level of each document.

Method: coverage rank. A frequency-ranked vocabulary is cut to the smallest head that covers a fixed share of a document's
words; how far down the list that is tells how rare its words are. This is done with the vocabulary of the whole corpus and
with the vocabularies of the graded documents, one for each grade. Coverage ranks and sentence complexity are then
calibrated by a linear model, fitted on a bounded sample of graded documents and applied as SQL expressions.

Documents are read once, in blocks: a block has the different words of some documents, how often it has each, and the words of
each document as places in that list. The corpus vocabulary is the sum of the blocks' lists, and its ranks are joined to these
lists, not to documents. No vocabulary of the corpus is cut, broadcast or gathered.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.quality import ProseModel, other_shares
from rankloom.llm.tasks import spread
from rankloom.llm.words import words
from rankloom.session import cut_lineage

#: Graded documents that are fitted on: those of smallest hash, at most so many, and of these the ones of at most so many words.
TRAIN_DOCS, TRAIN_WORDS = 5000, 5000
#: The least rank of a word that the vocabulary of a grade lacks; beyond it, the rank after its last word.
UNKNOWN_RANK = 50_001
#: Words after which a block is closed; the document that passes it is still taken whole.
BLOCK_WORDS = 400_000
#: Shares of a document's words to be covered, by the corpus vocabulary and by those of the grades.
SHARES, GRADE_SHARES = (0.3, 0.5, 0.7, 0.9), (0.5, 0.7, 0.85)
#: Words of the least document.
LEAST_WORDS = 25
GRADES = (1, 2, 3)

_SENTENCE = re.compile(r"[.!?…]+[\s\"»”]*|\n\s*\n")

COMPLEXITY = ["sentence", "word_length", "long_words", "commas", "kinds", "numbers"]
FEATURES = [*(f"corpus_{int(100 * s)}" for s in SHARES), *(f"grade{g}_{int(100 * s)}" for g in GRADES for s in GRADE_SHARES), *COMPLEXITY]


def coverage(ranks: np.ndarray, sizes: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """For each document and share, the logarithm of the size of the smallest head of the vocabulary that covers the share.

    ``ranks`` has the ranks of the words of all documents, one after the other; ``sizes`` how many words each has, not 0.
    """
    starts = np.cumsum(sizes) - sizes
    # Sorted by document and rank at once.
    own = np.sort((np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 40) | ranks.astype(np.int64)) & ((1 << 40) - 1)
    places = np.stack([starts + np.ceil(s * sizes).astype(np.int64) - 1 for s in shares], 1)
    return np.log(own[places])


def complexity(texts: list[str], codes: np.ndarray, sizes: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """For each text: words in a sentence (logarithm), letters in a word, shares of long words, commas, different words and
    numbers. ``codes`` are the places of its words in ``vocabulary``."""
    if not len(sizes):
        return np.empty((0, len(COMPLEXITY)))
    starts = np.cumsum(sizes) - sizes
    length, digits = np.array([len(w) for w in vocabulary]), np.array([w.isdigit() for w in vocabulary])
    total = lambda x: np.add.reduceat(x[codes].astype(np.int64), starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kinds = np.bincount(np.unique(owner * len(vocabulary) + codes) // len(vocabulary), minlength=len(sizes))
    sentences = np.array([max(1, sum(1 for s in _SENTENCE.split(t) if s.strip())) for t in texts])
    commas = np.array([t.count(",") for t in texts])
    return np.column_stack([np.log(sizes / sentences), total(length) / sizes, total(length >= 9) / sizes, commas / sizes, kinds / sizes, total(digits) / sizes])


_BLOCK = pa.schema([
    ("block", pa.string()), ("words", pa.list_(pa.string())), ("uses", pa.list_(pa.int32())),
    ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("complexity", pa.list_(pa.float64())),
])
_BLOCK_DDL = "block string, words array<string>, uses array<int>, keys array<bigint>, sizes array<int>, codes array<int>, complexity array<double>"


def _blocks(model: ProseModel, least: int, most: int):  # noqa: ANN202
    """Rows (key, text) to blocks: ``words`` and ``uses`` of all their texts; keys, numbers of words, words (as places in
    ``words``) and complexity of those texts that are running prose of ``least`` words."""

    def closed(name: str, index: dict[str, int], uses: list[np.ndarray], prose: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
        listed = list(index)
        codes = np.concatenate([c for _, _, c in prose]) if prose else np.empty(0, np.int32)
        sizes = np.array([len(c) for _, _, c in prose], np.int32)
        counts = np.bincount(np.concatenate(uses), minlength=len(listed)) if uses else np.empty(0, np.int64)
        own = complexity([t for _, t, _ in prose], codes, sizes, listed)
        row = [name, listed, counts.astype(np.int32), np.array([k for k, _, _ in prose], np.int64), sizes, codes.astype(np.int32), own.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def fresh() -> defaultdict:
            index: defaultdict = defaultdict()
            index.default_factory = index.__len__
            return index

        index, uses, prose, held = fresh(), [], [], 0
        for batch in batches:
            given = batch.column("text").to_pylist()
            tokens = [words(t) for t in given]
            enough = [bool(w) and len(t.split()) >= least for t, w in zip(given, tokens, strict=True)]
            other = other_shares([t if e else None for t, e in zip(given, enough, strict=True)], model)
            for key, text, own, e, o in zip(batch.column("key").to_pylist(), given, tokens, enough, other, strict=True):
                codes = np.array([index[w] for w in own], np.int32)
                uses.append(codes)
                held += len(codes)
                if e and (o or 0.0) <= 0.5:
                    prose.append((key, text, codes))
                if held >= most:
                    yield closed(f"{task}-{number}", index, uses, prose)
                    index, uses, prose, held, number = fresh(), [], [], 0, number + 1
        if held:
            yield closed(f"{task}-{number}", index, uses, prose)

    return run


def corpus_ranks(blocks: DataFrame) -> DataFrame:
    """(word, uses, rank) of every word of the blocks (words, uses): its rank is the number of words that are used as often or
    more, so that words used equally often enter a vocabulary together.

    Ranks are told by the number of uses alone, of which there are few: at most the root of twice the number of all words.
    """
    vocabulary = blocks.select(F.explode(F.arrays_zip("words", "uses")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.uses").alias("uses"))
    levels = vocabulary.groupBy("uses").agg(F.count("*").alias("n"))
    ranks = levels.select("uses", F.sum("n").over(Window.orderBy(F.desc("uses"))).alias("rank"))
    return vocabulary.join(ranks, "uses").select("word", "uses", "rank")


def _with_ranks(blocks: DataFrame) -> DataFrame:
    """The blocks with ``ranks``, the corpus ranks of their words. A block has each word once, so that no word is hot."""
    found = blocks.select("block", F.posexplode("words").alias("at", "word")).join(corpus_ranks(blocks), "word")
    listed = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("x")).select("block", F.col("x.rank").alias("ranks"))
    return blocks.join(listed, "block").drop("uses", "block")


class Sample:
    """Graded documents: a common list of their words, each document's words as places in it, ranks in the corpus, complexity."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.corpus: list[int] = []
        self.docs: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def add(self, listed: list[str], ranks: list[int], docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Adds documents (key, grade, places in ``listed``, complexity)."""
        places = []
        for w, r in zip(listed, ranks, strict=True):
            if w not in self.number:
                self.number[w] = len(self.number)
                self.corpus.append(r)
            places.append(self.number[w])
        at = np.array(places, np.int64)
        self.docs += [(key, grade, at[codes], own) for key, grade, codes, own in docs]

    def sorted(self) -> Sample:
        """In the order of keys, whatever the order of blocks was."""
        self.docs.sort(key=lambda d: (d[0], len(d[2]), d[3].tolist()))
        return self


class LevelModel:
    """Ranked vocabularies of the grades and a linear model for each grade."""

    def __init__(self, grades: list[dict[str, int]], mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, present: list[int]) -> None:
        self.grades, self.mean, self.spread, self.weights, self.present = grades, mean, spread, weights, present

    @classmethod
    def fit(cls, sample: Sample, passes: int = 2) -> LevelModel | None:
        """Fits on graded documents; without any there is no model.

        A few grades are wrong: documents that the first model confidently gives another grade are left out of the second.
        """
        model, docs = None, sample.docs
        for _ in range(passes):
            if not docs:
                break
            model, chance = cls._fit_once(sample, docs)
            docs = [d for d, p in zip(docs, chance, strict=True) if p >= 0.2]
        return model

    @classmethod
    def _fit_once(cls, sample: Sample, docs: list[tuple], folds: int = 4, rounds: int = 600, ridge: float = 1e-3) -> tuple[LevelModel, np.ndarray]:
        """A model, and the probability that it gives each document's own grade. A document's features come from the
        vocabularies of the other folds, as those of a new document do."""
        listed = list(sample.number)
        size, alphabet = len(listed), np.argsort(np.argsort(np.array(listed, dtype=object)))
        fold, grade = np.arange(len(docs)) % folds, np.array([GRADES.index(d[1]) for d in docs])
        counts = np.zeros((folds, len(GRADES), size), np.int64)
        for f, g, (_, _, codes, _) in zip(fold, grade, docs, strict=True):
            counts[f, g] += np.bincount(codes, minlength=size)
        total = counts.sum(0)

        def ranks(uses: np.ndarray) -> np.ndarray:
            """Rank of each word by its uses, equal ones in the alphabet's order; the rank of unknown words for those without."""
            known = int((uses > 0).sum())
            out = np.full(size, max(UNKNOWN_RANK, known + 1), np.int64)
            out[np.lexsort((alphabet, -uses))[:known]] = np.arange(1, known + 1)
            return out

        rows = np.empty((len(docs), len(FEATURES)))
        corpus = np.array(sample.corpus, np.int64)
        for f in range(folds):
            at = np.flatnonzero(fold == f)
            if len(at):
                codes, sizes = np.concatenate([docs[n][2] for n in at]), np.array([len(docs[n][2]) for n in at])
                own = [coverage(corpus[codes], sizes, SHARES), *(coverage(ranks(total[g] - counts[f, g])[codes], sizes, GRADE_SHARES) for g in range(len(GRADES)))]
                rows[at] = np.hstack([*own, np.array([docs[n][3] for n in at])])
        mean, spread = rows.mean(0), rows.std(0) + 1e-9
        z = np.hstack([(rows - mean) / spread, np.ones((len(rows), 1))])
        target = np.eye(len(GRADES))[grade]
        b = np.zeros((z.shape[1], len(GRADES)))

        def chances() -> np.ndarray:
            e = np.exp(z @ b - (z @ b).max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        for _ in range(rounds):
            b -= 0.5 * (z.T @ (chances() - target) / len(z) + ridge * b)
        vocabularies = [{listed[n]: int(r[n]) for n in np.flatnonzero(total[g])} for g, r in enumerate(map(ranks, total))]
        return cls(vocabularies, mean, spread, b, sorted({GRADES[g] for g in grade})), (chances() * target).sum(1)

    def features(self, listed: list[str], corpus: np.ndarray, codes: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The features of documents, in the order of FEATURES: their words as places in ``listed``, the corpus ranks of these,
        and their complexity."""
        parts = [coverage(corpus[codes], sizes, SHARES)]
        for known in self.grades:
            unknown = max(UNKNOWN_RANK, len(known) + 1)
            parts.append(coverage(np.array([known.get(w, unknown) for w in listed], np.int64)[codes], sizes, GRADE_SHARES))
        return np.hstack([*parts, own])

    def grade(self, columns: list[Column]) -> Column:
        """The grade of highest score, the lower of equal ones, as an expression over the features."""
        scores = []
        for n, g in enumerate(GRADES):
            if g in self.present:
                slope = self.weights[:-1, n] / self.spread
                total = F.lit(float(self.weights[-1, n] - (slope * self.mean).sum()))
                for weight, column in zip(slope.tolist(), columns, strict=True):
                    total = total + F.lit(weight) * column
                scores.append((g, total))
        best = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
        out = F.lit(scores[-1][0])
        for g, s in reversed(scores[:-1]):
            out = F.when(s >= best, g).otherwise(out)
        return out.cast("int")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, ranks, keys, sizes, codes and complexity of each block that has documents."""
    for batch in batches:
        for n in range(batch.num_rows):
            ranks, keys, sizes, codes, own = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in ("ranks", "keys", "sizes", "codes", "complexity"))
            if len(keys):
                yield batch.column("words")[n].as_py(), ranks, keys, sizes.astype(np.int64), codes, own.reshape(-1, len(COMPLEXITY))


def _sampled(grades: dict[int, int], most: int):  # noqa: ANN202
    """Blocks to the same with only those documents that are graded and have at most ``most`` words."""
    schema = pa.schema([("words", pa.list_(pa.string())), ("ranks", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("complexity", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed, ranks, keys, sizes, codes, own in _rows(batches):
            taken = np.array([k in grades for k in keys.tolist()], bool) & (sizes <= most)
            if taken.any():
                used, at = np.unique(codes[np.repeat(taken, sizes)], return_inverse=True)
                row = [[listed[c] for c in used], ranks[used], keys[taken], sizes[taken].astype(np.int32), at.astype(np.int32), own[taken].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _measured(model: LevelModel, spark):  # noqa: ANN001, ANN202
    """Blocks to the features of their documents."""
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("key", pa.int64()), *((n, pa.float64()) for n in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed, ranks, keys, sizes, codes, own in _rows(batches):
            matrix = shared.value.features(listed, ranks, codes, sizes, own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(matrix[:, i])) for i in range(len(FEATURES)))], schema=schema)

    return run


def reading_levels(docs: DataFrame, labels: DataFrame, prose: ProseModel, key: str = "doc_id", text: str = "text", grade: str = "grade", least: int = LEAST_WORDS, train: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, grade): the level, 1 to 3, of each document that is running prose of at least ``least`` words.

    Null, empty and blank texts, null keys, and what the prose model takes for lists, tables or debris have no row. Grades
    that are null or not 1 to 3 don't count; of several grades of a document the most frequent does, of these the lowest.
    Repeated rows come out once. Without any graded prose there is no result. The corpus vocabulary counts all texts and ranks
    all words. The model is fitted on at most ``train`` graded documents of at most ``train_words`` words each.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    blocks = cut_lineage(spread(rows).mapInArrow(_blocks(prose, least, block_words), _BLOCK_DDL))
    ranked = cut_lineage(_with_ranks(blocks))
    votes = labels.where(F.col(grade).isin(*GRADES) & F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key"), F.col(grade).cast("int").alias("grade")).count()
    known = votes.groupBy("key").agg(F.max(F.struct("count", -F.col("grade"))).alias("v")).select("key", (-F.col("v.col2")).alias("grade"))
    # At most ``train`` keys and grades, and as many documents of bounded length.
    grades = {r["key"]: r["grade"] for r in known.orderBy(F.xxhash64("key"), "key").limit(train).collect()}
    sample = Sample()
    for r in ranked.mapInArrow(_sampled(grades, train_words), "words array<string>, ranks array<bigint>, keys array<bigint>, sizes array<int>, codes array<int>, complexity array<double>").collect():
        codes, own = np.array(r["codes"], np.int64), np.array(r["complexity"]).reshape(-1, len(COMPLEXITY))
        parts = np.split(codes, np.cumsum(r["sizes"])[:-1])
        sample.add(r["words"], r["ranks"], [(k, grades[k], c, x) for k, c, x in zip(r["keys"], parts, own, strict=True)])
    model = LevelModel.fit(sample.sorted())
    if model is None:
        return spark.createDataFrame([], f"`{key}` bigint, `{grade}` int")
    measured = ranked.mapInArrow(_measured(model, spark), "key bigint, " + ", ".join(f"{n} double" for n in FEATURES))
    return measured.select(F.col("key").alias(key), model.grade([F.col(n) for n in FEATURES]).alias(grade)).distinct()
