"""Byte-level BPE of a whole corpus with a public vocabulary.

Each piece of the pre-tokenizer is encoded by backtracking over Aho-Corasick matches: from the
left, take the longest vocabulary entry that may follow the last one; two entries may be
neighbours only if their own merges would never have crossed the boundary (pair compatibility).
Where no entry fits, step back. The work is linear in the bytes and gives exactly the ids that
the merges give.

The vocabulary becomes three small arrays (bounded by the vocabulary, not by the corpus), which
the driver broadcasts; the corpus is only read by the tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64


def compatible(pairs: dict, left: np.ndarray, right: np.ndarray, a: int, b: int) -> bool:
    """Whether entries a, b can stand side by side: no merge across their boundary comes first."""
    limit = 1 << 31
    while True:
        merged = pairs.get((a, b))
        if merged is not None and merged < limit:
            return False
        if a > b:
            limit, a = a, int(right[a])
            if a == limit:
                limit, b = b + 1, int(left[b])
                if b + 1 == limit:
                    return True
        else:
            limit, b = b + 1, int(left[b])
            if b + 1 == limit:
                limit, a = a, int(right[a])
                if a == limit:
                    return True


class Vocabulary:
    """Entries as bytes plus, for each entry, the two parts it merges and its longest proper prefix."""

    def __init__(self, entries: list[bytes], left: np.ndarray, right: np.ndarray, prefix: np.ndarray):
        self.entries, self.left, self.right, self.prefix = entries, left, right, prefix

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            ranked = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        entries = sorted(ranked, key=ranked.__getitem__)
        if [ranked[e] for e in entries] != list(range(len(entries))):
            raise ValueError("the ids of a rank file must be 0, 1, 2, ...")
        left = np.arange(len(entries), dtype=np.int32)
        right = left.copy()
        prefix = np.full(len(entries), -1, np.int32)
        pairs: dict[tuple[int, int], int] = {}
        for k, e in enumerate(entries):
            for cut in range(len(e) - 1, 0, -1):
                a = ranked.get(e[:cut])
                if a is None:
                    continue
                if prefix[k] < 0:
                    prefix[k] = a
                b = ranked.get(e[cut:])
                if b is not None and a < k and b < k and left[k] == k and compatible(pairs, left, right, a, b):
                    left[k], right[k] = a, b
                    pairs[a, b] = k
        return cls(entries, left, right, prefix)

    def encoder(self) -> Encoder:
        return Encoder(self)

    def decoder(self) -> Decoder:
        return Decoder(self.entries)


def _first_plane(regex):
    """The split pattern for texts without characters beyond U+FFFF, in the faster standard module.

    Letters, numbers and white space are listed as the ranges in which the other module finds them.
    """

    def ranges(kind: str) -> str:
        hits = (m.span() for m in regex.compile(kind + "+").finditer("".join(map(chr, range(0x10000)))))
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in hits)

    letter, number = ranges(r"\p{L}"), ranges(r"\p{N}")
    space = ranges(r"\s")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class Encoder:
    def __init__(self, v: Vocabulary):
        import ahocorasick
        import regex

        self.left, self.right = v.left.tolist(), v.right.tolist()
        self.pairs = {(a, b): k for k, (a, b) in enumerate(zip(self.left, self.right)) if a != k}
        self.prefix, self.length = v.prefix.tolist(), [len(e) for e in v.entries]
        self.matches = ahocorasick.Automaton()
        for k, e in enumerate(v.entries):
            self.matches.add_word(e.decode("latin-1"), (k, len(e)))
        self.matches.make_automaton()
        self.any_plane, self.first_plane = regex.compile(PATTERN).findall, _first_plane(regex)
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.known: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def fit(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 4 * CACHE_ENTRIES:
                self.fits.clear()
            got = self.fits[a, b] = compatible(self.pairs, self.left, self.right, a, b)
        return got

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace").decode("latin-1")
        n, longest, lengths = len(raw), {}, self.length
        for end, (k, size) in self.matches.iter(raw):
            longest[end - size + 1] = k  # a later match from the same start is longer
        dead, out, at, k = bytearray(n + 1), [], 0, longest[0]
        while k is not None:
            while True:
                end = at + lengths[k]
                if not dead[end] and (not out or self.fit(out[-1], k)):
                    out.append(k)
                    at = end
                    k = longest.get(at)
                    break
                if self.prefix[k] >= 0:
                    k = self.prefix[k]
                    continue
                dead[at] = 1
                k = out.pop()
                at -= lengths[k]
        return out

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        text = text or ""
        split = self.first_plane if text.isascii() or not self.beyond(text) else self.any_plane
        for w in split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.piece(w)
                if len(w) <= CACHE_CHARS:
                    if len(known) > CACHE_ENTRIES:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


class Decoder:
    """All entries in one string of bytes with an offset table; an entry is a slice."""

    def __init__(self, entries: list[bytes]):
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(e) for e in entries])])

    def __call__(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.blob[np.repeat(start, size) + within].tobytes().decode("utf-8", "replace")


def _broadcast(spark: SparkSession, path: str):
    v = _loaded(path)
    return spark.sparkContext.broadcast((v.entries, v.left, v.right, v.prefix))


@lru_cache(4)
def _loaded(path: str) -> Vocabulary:
    return Vocabulary.load(path)


_workers: dict[str, Encoder] = {}


def _encoder(shared, path: str) -> Encoder:
    """One encoder in each Python worker, kept between tasks."""
    if path not in _workers:
        _workers[path] = Vocabulary(*shared.value).encoder()
    return _workers[path]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) for each row of df; rows stay as they are, with duplicates and null keys.

    A null or empty text has the empty list. Texts are encoded whole, whatever their length.
    The strings of special tokens are ordinary text. Other columns of df are not read, so a
    column ``ids`` of df does no harm. An empty df gives an empty result.
    """
    shared = _broadcast(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, vocabulary)
        for b in batches:
            ids, ends = [], [0]
            for t in b.column(1).to_pylist():
                ids += encoder(t)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "ids"])

    slim = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens bigint) for each row of df; 0 for a null or empty text. Only counts leave the tasks."""
    shared = _broadcast(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, vocabulary)
        for b in batches:
            sizes = [len(encoder(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    slim = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from lists of ids; a null list gives null, an empty one the empty text."""
    shared = _broadcast(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value[0])
        for b in batches:
            texts = [None if x is None else decoder(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    slim = df.select(F.col(key).alias(key), F.col(ids).alias("_ids"))
    return slim.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
