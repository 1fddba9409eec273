"""Encoding and decoding with a public byte-level BPE vocabulary.

Method: the merges are compiled into a finite-state transducer that is determinised lazily, as the bytes of the texts ask
for it. A state holds the tokenizations of those prefixes from which some token may still be going on; every prefix has
exactly one, the one whose last token is compatible with the token before it. What all of them share is certain and is
emitted, so a token comes out after a bounded lookahead and time is linear in the text, however long a word is.
Decoding is streaming, over a state machine for UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tasks import spread

#: Most states and most cached words of a worker; beyond it they are dropped and built anew. The result does not depend on it.
MAX_STATES = 50_000
MAX_WORDS = 200_000
#: Longest word that is cached.
CACHED_LENGTH = 40

# Fixed value: how the vocabulary cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a file with a base64 token and its id in each line."""
    with Path(path).open("rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Lazily determinised transducer of a BPE vocabulary in which ids are in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.token = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]  # of a node of the tree of tokens, by byte
        self.ends: list[int] = [-1]  # the token that ends at a node
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.children[node].get(byte)
                if following is None:
                    following = self.children[node][byte] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                node = following
            self.ends[node] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, (-1,)),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, text: bytes) -> list[int]:
        """Tokens of ``text`` by the definition: the merge of lowest rank first, the leftmost of equal ones."""
        parts = [bytes([b]) for b in text]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: their bytes together come out as these two."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.merge(self.token[left] + self.token[right]) == [left, right] if left >= 0 else self.merge(self.token[right]) == [right]
            if len(self.fits) > 4 * self.max_states:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinises one move. A state is a tuple of (node, path): the tokens since the last certain one, which leads the
        path, up to a prefix from which the bytes read since lead to the node."""
        going, here = [], None
        for node, path in self.states[state]:
            after = self.children[node].get(byte)
            if after is None:
                continue
            token = self.ends[after]
            if here is None and token >= 0 and self.compatible(path[-1], token):
                here = (*path, token)
            if self.children[after]:
                going.append((after, path))
        if here is None:
            raise ValueError("the vocabulary lacks a byte")
        going.append((0, here))
        paths = [path for _, path in going]
        shortest = min(map(len, paths))
        same = 1
        while same < shortest and all(p[same] == here[same] for p in paths):
            same += 1
        out = here[1:same]
        following = tuple((node, path[same - 1 :]) for node, path in going)
        self.moves[state][byte] = move = (self._add(following), out)
        return move

    def _add(self, state: tuple) -> int:
        """The number of a state, a new one if need be."""
        known = self.number.get(state)
        if known is None:
            known = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, read byte by byte."""
        state, out, moves = 0, [], self.moves
        for byte in word:
            move = moves[state].get(byte)
            if move is None:
                if len(self.states) > self.max_states:  # within a long word: go on from the state in hand
                    here = self.states[state]
                    self._reset()
                    moves, state = self.moves, self._add(here)
                move = self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        out += self.states[state][-1][1][1:]
        return out


class Codec:
    """Texts to ids and back. The words of a text are found by the vocabulary's pattern."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.transducer = Transducer(load_ranks(path))
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for the null and the empty text. Names of special tokens are ordinary text."""
        out: list[int] = []
        known, encode = self.known, self.transducer.encode_word
        for word in self.words.findall(text or ""):
            ids = known.get(word)
            if ids is None:
                ids = encode(word.encode())
                if len(word) <= CACHED_LENGTH:
                    if len(known) >= MAX_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 come out as U+FFFD."""
        return "".join(utf8_stream(self.transducer.token[i] for i in ids))


def _ranges(first: int) -> tuple[tuple[int, int], ...] | None:
    """Allowed ranges of the bytes after a first byte of 2 to 4 bytes of UTF-8; none if it begins nothing."""
    tail = (0x80, 0xBF)
    if 0xC2 <= first <= 0xDF:
        return (tail,)
    if 0xE0 <= first <= 0xEF:
        return ((0xA0, 0xBF) if first == 0xE0 else (0x80, 0x9F) if first == 0xED else tail, tail)
    if 0xF0 <= first <= 0xF4:
        return ((0x90, 0xBF) if first == 0xF0 else (0x80, 0x8F) if first == 0xF4 else tail, tail, tail)
    return None


def utf8_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Characters of a stream of bytes whose chunks may end within a character.

    The state is the bytes begun and the ranges that the next ones must be in. A wrong byte ends a begun character as one
    U+FFFD and is looked at anew; so does the end of the stream.
    """
    begun, expected = bytearray(), ()
    for chunk in chunks:
        if not begun and chunk.isascii():
            yield chunk.decode("ascii")
            continue
        out = []
        for byte in chunk:
            if begun:
                low, high = expected[0]
                if low <= byte <= high:
                    begun.append(byte)
                    expected = expected[1:]
                    if not expected:
                        out.append(begun.decode())
                        begun.clear()
                    continue
                out.append("�")
                begun.clear()
            if byte < 0x80:
                out.append(chr(byte))
                continue
            ranges = _ranges(byte)
            if ranges is None:
                out.append("�")
            else:
                begun.append(byte)
                expected = ranges
        yield "".join(out)
    if begun:
        yield "�"


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, built once in each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]



def encode_texts(df: DataFrame, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``out``, array<int>: the ids of each text, without special tokens.

    Null and empty texts have the empty list; a column ``out`` that was there is replaced; repeated rows stay repeated; texts
    are encoded whole, whatever their length. ``path`` is a vocabulary file that every worker can read. No shuffle.
    """
    path = path or vocabulary_path()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return spread(df).select(*[F.col(f"`{c}`") for c in df.columns if c not in (text, out)], encode(F.col(f"`{text}`")).alias(out))


def decode_ids(df: DataFrame, ids: str, out: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without ``ids`` and with ``out``: the text of each list of ids. A null list gives the empty text."""
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.decode(x or []) for x in lists.to_pylist()], pa.string())

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ids, out)], decode(F.col(f"`{ids}`")).alias(out))
