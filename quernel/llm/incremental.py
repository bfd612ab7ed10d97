"""New batches against all that was accepted before: incremental record linkage.

The state of a collection is a folder of tables: the rows taken so far with their words and their
representative, and the blocking keys that find them. A batch is reduced to one row for each exact
text, its keys are probed in the key table, the pairs found are scored with learned weights, and
only the clusters that the batch touches change, by mapping their rows to the earliest one. Batches
that wait together are probed, compared and scored in one run, so that the history is read once for
all of them; which row represents which is then settled batch after batch, from the links alone.

Blocking keys are runs of locally rare words, two to four of them, more in longer texts: a word is
rare at its place if no word within three places is as rare in the collection's first batch. An edit
changes only the keys around it, whatever the order of the paragraphs, and common phrases give no
keys. A replaced word that is rarer than its neighbours breaks every run over it, so the words that
the first batch had at most RARE_WORD times are keys on their own, as far as they are among the rarest
of the text of which a repetition must share one. A pair is a candidate if it shares any key and if
the lengths allow the exact check. Rows that repeat an earlier one have their keys in tables of their own:
a new row that repeats none of the rows that represent themselves is held against these too, so that
a link through any row of a cluster is found, and a hot group of near copies is met once.

A key of more than SMALL_BUCKET rows of a batch is hot. Its rows are compared with its first row, and
those that repeat it are done. The others go by finer keys, each made of the hot key and one of the
words of which two texts with SHARED_WORDS in common share one at least, so that no pair is lost. In a
finer bucket that is still large, LEADERS rows after the other are compared with all that come after
them and repeat none of them yet. The history keeps the finer keys of a key that was hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.lookalikes import skeleton
from quernel.session import shared_dir

CELLS = 1 << 17
REACH = 3
SMALL_BUCKET = 1_000  # rows of a batch with one key above which the key is hot
LEADERS = 1_000  # rows of a large bucket that are compared at once with all the rows after them
RARE_WORD = 16  # a word that the first batch has at most so many times is a key on its own
BROADCAST_ROWS = 500_000  # a side of at most so many rows of two numbers is broadcast; beyond it the join shuffles
WIDE = 4  # rows with sketches count so many times
WORDY = 50  # rows with the words of a text
SHARED_WORDS = 0.83  # what a repetition shares at least: with an eighth of the words changed, seven eighths; some tolerance
SCORED = 0.75  # pairs that can't share so many of their words are dropped without a score
CELLS_OF_TEXT = 256  # cells into which the words of a text are counted to see how many two texts can share
SKETCH = ("s0", "s1", "s2", "s3")  # which of these cells have words, 64 bits a column
SIDE = ("uid", "b", "m", *SKETCH)  # what goes with a key: the row, its batch, its number of words and its sketch
SIDE_TYPES = f"uid bigint, b int, m int, {', '.join(f'{c} bigint' for c in SKETCH)}"
LINK, EARLIER, KNOWN, MEMBER = range(4)  # kinds of pairs: within a batch, over batches of one run, with a row of the history that represents itself, with one that repeats another
TRAINING_ROWS = 400  # rows of each table from which training pairs are made

_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]{1,4}-\d+|[^\W㐀-鿿]+")
_CODE = re.compile(r"[^\W\d_]{1,4}-\d+$")
# the same for texts of ASCII characters, of which most have no product code
_ASCII_WORD, _ASCII_CODE = re.compile(r"[a-zA-Z]{1,4}-\d+|\w+", re.ASCII), re.compile(r"[a-zA-Z]-\d")
_BLANKS = {i: " " for i in range(128) if not re.match(r"\w", chr(i))}


def _token(word: str, before: str = "") -> int:
    """A word as a number: its letters in any order, so that swapped letters are the same word; the lowest bit says if it has digits."""
    exact = any(c.isdigit() for c in word)
    name = f"{''.join(sorted(before))} {word}" if before else word if exact else "".join(sorted(word))
    return crc32(name.encode()) & ~1 | exact


class _Tokens(dict):
    """The numbers of words met before; None for product codes, whose number depends on the word before them."""

    def __missing__(self, word: str) -> int | None:
        if len(self) >= 500_000:
            self.clear()
        self[word] = got = None if _CODE.match(word) else _token(word)
        return got


_tokens = _Tokens()


def words(text: str) -> np.ndarray:
    """The words of a text, in its form and case free look; a product code is one with the name before it."""
    text = skeleton(text).casefold()
    if not text.isascii():
        found = _WORD.findall(text)
    else:
        found = _ASCII_WORD.findall(text) if _ASCII_CODE.search(text) else text.translate(_BLANKS).split()
    numbers = list(map(_tokens.__getitem__, found))
    for i, n in enumerate(numbers) if None in numbers else ():
        if n is None:
            numbers[i] = _token(found[i], found[i - 1] if i else "")
    return np.array(numbers, np.uint32)


def _spread(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each word of a text by how rare the word is, the rarest first."""
    return counts[w % CELLS].astype(np.int64) * (1 << 32) + w


def _telling(n: np.ndarray) -> np.ndarray:
    """How many words of texts of n words are telling."""
    return n - np.ceil(SHARED_WORDS * n).astype(np.int64) + 1


def telling(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest words of a text, so many that two texts with SHARED_WORDS in common share one of them."""
    return w[np.argsort(_spread(w, counts), kind="stable")[: _telling(np.array(len(w)))]]


def keys(w: np.ndarray, ends: np.ndarray, counts: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocking keys of texts whose words stand in ``w`` one text after the other, and the text of each key, in order.

    Texts with one rare word or none have one key, of all their words.
    """
    n = np.diff(ends)
    text = np.repeat(np.arange(len(n)), n)
    f, salts = _spread(w, counts), salts.astype(np.uint64)
    # texts are REACH places apart, so that none sees another's words
    at = np.arange(len(w)) + REACH * (text + 1)
    padded = np.full(len(w) + REACH * (len(n) + 1), 1 << 62)
    padded[at] = f
    low = np.ones(len(w), bool)
    for k in range(1, REACH + 1):
        low &= (f < padded[at - k]) & (f <= padded[at + k])
    rare, of = w[low].astype(np.uint64), text[low]
    m = np.bincount(of, minlength=len(n))
    starts = np.cumsum(m) - m
    out, texts = [], []

    def add(columns: list[np.ndarray], own: np.ndarray, kind: int) -> None:
        out.append(_mixed(columns, salts[own] + np.uint64(kind)))
        texts.append(own)

    single = np.flatnonzero(f < RARE_WORD + 1 << 32)
    single = single[np.lexsort((f[single], text[single]))]
    s = text[single]
    many = np.bincount(s, minlength=len(n))
    rank = np.arange(len(s)) - (np.cumsum(many) - many)[s]
    first = rank < _telling(n)[s]  # they are the first of the telling words
    add([w[single[first]].astype(np.uint64)], s[first], 1)
    short = np.flatnonzero(m < 2)
    out.append(np.array([crc32(np.sort(w[ends[i] : ends[i + 1]]).tobytes(), int(salts[i])) + (int(n[i]) << 32) for i in short], np.int64))
    texts.append(short)
    for size in range(2, 7):
        own = np.flatnonzero(m == size)
        grid, (i, j) = rare[starts[own][:, None] + np.arange(size)] if len(own) else np.zeros((0, size), np.uint64), _PAIRS[size]
        add([np.minimum(grid[:, i], grid[:, j]).ravel(), np.maximum(grid[:, i], grid[:, j]).ravel()], np.repeat(own, len(i)), 0)
    # the lengths overlap, so that texts a little longer or shorter than each other have keys of one kind
    place = np.arange(len(rare)) - starts[of]
    for size, least, most in ((2, 5, 12), (3, 9, 24), (4, 19, 1 << 60)):
        p = np.flatnonzero((m[of] >= max(least, size)) & (m[of] <= most) & (place <= m[of] - size))
        add([rare[p + k] for k in range(size)], of[p], size)
    got, texts = np.concatenate(out), np.concatenate(texts)
    order = np.lexsort((got, texts))
    got, texts = got[order], texts[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (texts[1:] != texts[:-1])
    return got[new], texts[new]


_PAIRS = [np.triu_indices(m, 1) for m in range(7)]


def _mixed(columns: list[np.ndarray], salt: int | np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), salt, np.uint64)
    with np.errstate(over="ignore"):
        for x in columns:
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ x
            h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _grams(w: np.ndarray) -> np.ndarray:
    if len(w) < 3:
        return w.astype(np.uint64)
    x = w.astype(np.uint64)
    with np.errstate(over="ignore"):
        return (x[:-2] * np.uint64(31) + x[1:-1]) * np.uint64(1_000_003) + x[2:]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two bags."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def features(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Fields of a pair: shared words of the longer and the shorter text, shared triples, shared numbers, equal numbers."""
    most, least = max(len(a), len(b), 1), max(min(len(a), len(b)), 1)
    both = _overlap(a, b)
    ga, gb = _grams(a), _grams(b)
    da, db = a[a & 1 == 1], b[b & 1 == 1]
    digits = _overlap(da, db)
    return [both / most, both / least, _overlap(ga, gb) / max(len(ga), len(gb), 1), digits / max(len(da), len(db), 1) if len(da) or len(db) else 1.0, float(digits == len(da) == len(db))]


def learn(texts: list[np.ndarray], strict: bool, seed: int = 5, rounds: int = 2) -> np.ndarray:
    """Weights of the fields by logistic regression on pairs made from a bounded sample of texts.

    A repetition has up to an eighth of its words changed, added or dropped and its halves may be
    swapped; with ``strict`` its numbers stay. Another text shares about half or less, here up to
    three quarters, to set the bound in the middle between the two; with ``strict`` also one in which
    a single number or product differs. Texts of fewer than eight words teach nothing; where there are
    none else, texts of made-up words stand in, since the fields are shares, whatever the words.
    """
    r = np.random.default_rng(seed)
    texts = [t for t in texts if len(t) >= 8] or [r.integers(0, 1 << 31, 40).astype(np.uint32) << 1 | (r.random(40) < 0.1) for _ in range(50)]
    texts = (texts * (1 + 100 // len(texts)))[: max(len(texts), 100)]
    pool = np.concatenate(texts)
    plain = pool[pool & 1 == 0]
    plain = plain if len(plain) else pool
    x, y = [], []
    for _ in range(rounds):
        for t in texts:
            cut, w = int(r.integers(len(t))), t.copy()
            spots = np.flatnonzero(w & 1 == 0) if strict else np.arange(len(w))
            edits = r.permutation(spots)[: int(r.uniform(0, 0.125) * len(w) + r.integers(2))]
            third = np.array_split(edits, 3)
            w[third[0]] = r.choice(plain, len(third[0]))
            w = np.insert(np.delete(w, third[1]), np.minimum(third[2], max(0, len(w) - len(third[1]))), r.choice(plain, len(third[2])))
            x.append(features(t, np.roll(w, cut) if r.random() < 0.3 else w))
            y.append(1)
            other = max((texts[i] for i in r.integers(len(texts), size=4)), key=lambda o: _overlap(t, o))
            keep = int(r.uniform(0, 0.75) * len(t))
            start = int(r.integers(len(t) - keep + 1))
            x.append(features(t, np.concatenate([t[start : start + keep], np.resize(other, len(t) - keep)])))
            y.append(0)
            if strict and len(at := np.flatnonzero(t & 1)):
                w = t.copy()
                w[r.choice(at)] ^= 0x5A5A00
                x.append(features(t, w))
                y.append(0)
    m, y = np.column_stack([np.ones(len(x)), x]), np.array(y, float)
    beta, ridge = np.zeros(m.shape[1]), np.diag([1e-6] + [1e-2] * (m.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p) + 1e-9)[:, None]).T @ m + ridge, m.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class History:
    """The persisted tables of a collection below one folder, and what was learned from its first batch."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.batches, self.hot_batches, self.settled, self.moved = spark, path or shared_dir(spark, "history"), [], [], [], 0
        self.member_keys = 0
        self.counts = None  # a broadcast table of CELLS numbers
        self.weights: dict[int, np.ndarray] = {}

    def _read(self, name: str, schema: str, batches: list) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}-{n}" for n in batches])

    def rows(self, batches: list | None = None) -> DataFrame:
        """Each exact text once; uid is 2 * id + (0 for documents, 1 for memories)."""
        return self._read("rows", f"exact binary, w binary, {SIDE_TYPES}, keys array<bigint>", self.batches if batches is None else batches)

    def reps(self) -> DataFrame:
        """(uid, rep) of the rows that repeat an earlier one; all others represent themselves."""
        return _small(self._read("reps", "uid bigint, rep bigint", self.settled), self.moved)

    def keyed(self) -> DataFrame:
        """(key, uid, b, m, s0, …) of the rows that represent themselves; in runs with hot keys these are replaced by finer ones."""
        own = lambda df: df.join(self.reps().select("uid"), "uid", "left_anti")
        plain = [n for n in self.batches if n not in self.hot_batches]
        parts = [_exploded(own(self.rows(plain)))] if plain else []
        for n in self.hot_batches:
            parts.append(_exploded(own(self.rows([n]))).join(self._read("hot", "key bigint", [n]), "key", "left_anti"))
            parts.append(own(self._read("finer", f"key bigint, {SIDE_TYPES}", [n])).select("key", *SIDE))
        return reduce(DataFrame.unionByName, parts)

    def members(self) -> DataFrame:
        """(key, uid, b, m, s0, …) of the rows that repeat an earlier one, in the same form."""
        return self._read("members", f"key bigint, {SIDE_TYPES}", self.batches)

    def member_words(self) -> DataFrame:
        """(uid, w) of these rows."""
        return self._read("memberwords", "uid bigint, w binary", self.batches)


def _put(df: DataFrame, path: str, **counts) -> tuple[DataFrame, dict]:
    """The table written to a folder, its number of rows as ``n``, and other aggregates of it; all counted while it is written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items())).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _settled(df: DataFrame, purpose: str, **counts) -> tuple[DataFrame, dict]:
    return _put(df, shared_dir(df.sparkSession, purpose), **counts)


def _exploded(rows: DataFrame) -> DataFrame:
    """(key, uid, b, m, s0, …) of rows with keys."""
    return rows.select(F.explode("keys").alias("key"), *SIDE)


def _sweep(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of queries that have ended only when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcasting if it was counted to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _slim(joined: DataFrame, small: DataFrame, rows: int, on, how: str = "inner") -> DataFrame:
    return joined.join(_small(small, rows), on, how)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts of a column one after the other, and where each text ends, from 0 on."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(column.buffers()[2] or b"", np.uint32)[ends[0] : ends[-1]], ends - ends[0]


def _count_words(batch: DataFrame) -> np.ndarray:
    """How often words occur, over all rows, in a table of a fixed number of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0))[0] % CELLS, minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in batch.select("w").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    return out


def read(rows: DataFrame) -> DataFrame:
    """(batch_no, uid, exact, w) of rows(kind, id, domain, batch_no, text), kind 0 or 1; null ids and wordless texts have none.

    ``exact`` names the domain and the bag of words, so it is equal whatever the order, case and spacing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, i, domain, n, text in zip(*(c.to_pylist() for c in b.columns)):
                w = words(text)
                if not len(w) and text.strip():
                    w = np.array([crc32(skeleton(text).encode()) & ~1], np.uint32) if skeleton(text) else w
                if len(w):
                    exact = blake2b(np.sort(w).tobytes(), digest_size=16, key=blake2b(f"{kind} {domain}".encode(), digest_size=8).digest()).digest()
                    out.append((n, 2 * i + kind, exact, w.tobytes(), crc32(f"{kind} {domain}".encode())))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["batch_no", "uid", "exact", "w", "salt"])

    fine = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    slim = fine.select(F.col("kind").cast("int"), F.col("id").cast("bigint"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "batch_no int, uid bigint, exact binary, w binary, salt bigint")


def _keyed(firsts: DataFrame, counts) -> DataFrame:
    """(exact, w, uid, b, m, s0, …, keys): the number of words, the sketch and the blocking keys added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                got, texts = keys(*_flat(b.column(1)), counts.value, b.column(4).to_numpy())
                ends = np.searchsorted(texts, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(got))
                cells = _cells(b.column(1))
                bits = np.packbits(cells > 0, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cells.sum(1).astype(np.int32)), *(pa.array(x) for x in bits.T.copy()), lists], ["exact", "w", *SIDE, "keys"])

    return firsts.select("exact", "w", "uid", "b", "salt").mapInArrow(run, f"exact binary, w binary, {SIDE_TYPES}, keys array<bigint>")


def _finer(rows: DataFrame, counts) -> DataFrame:
    """(key, uid, b, m, s0, …) of rows(uid, w, b, m, s0, …, keys), whose keys are hot: each hot key with each of the telling words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = [np.zeros(0, np.int64)], []
            for i, (w, hot) in enumerate(zip(b.column("w").to_pylist(), b.column("keys").to_pylist())):
                own = np.unique(telling(np.frombuffer(w, np.uint32), counts.value)).astype(np.uint64)
                found += [_mixed([np.full(len(own), k, np.int64).view(np.uint64), own], 1) for k in hot]
                at += [i] * (len(own) * len(hot))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(b.column(c).take(pa.array(at, pa.int64())) for c in SIDE)], ["key", *SIDE])

    return rows.select("w", *SIDE, "keys").mapInArrow(run, f"key bigint, {SIDE_TYPES}")


def _near(old: DataFrame, new: DataFrame, kind: int | None = None) -> DataFrame:
    """(old, new, b, kind), b being the batch of new, not distinct yet, of two tables (key, uid, b, m, s0, …) that meet in a key.

    ``kind`` is that of pairs with the history; without it both tables are of the run, and old comes before new.
    Pairs whose lengths and sketches show that too few words can be shared are dropped, so that the words
    travel for few pairs only: a cell that one text has and the other lacks is at least one word not shared.
    """
    side = lambda df, name: df.select("key", F.col("uid").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in SIDE[1:]))
    lacks = lambda a, b: sum(F.bit_count(F.col(f"{a}_{c}").bitwiseAND(F.bitwise_not(f"{b}_{c}"))) for c in SKETCH)
    most = F.greatest("old_m", "new_m")
    fits = (F.least("old_m", "new_m") >= SHARED_WORDS * most) & (lacks("old", "new") <= F.col("old_m") - SCORED * most) & (lacks("new", "old") <= F.col("new_m") - SCORED * most)
    order = (F.col("old_b") < F.col("new_b")) | (F.col("old_b") == F.col("new_b")) & (F.col("old") < F.col("new"))
    found = side(old, "old").join(side(new, "new"), "key").where(fits & order if kind is None else fits)
    return found.select("old", "new", F.col("new_b").alias("b"), _kind() if kind is None else F.lit(kind).alias("kind"))


def _kind() -> Column:
    return F.when(F.col("old_b") == F.col("new_b"), LINK).otherwise(EARLIER).alias("kind")


def _cells(column: pa.Array) -> np.ndarray:
    """The words of each text of a column counted into CELLS_OF_TEXT cells."""
    w, ends = _flat(column)
    at = np.repeat(np.arange(len(column)), np.diff(ends)) * CELLS_OF_TEXT + (w >> 1) % CELLS_OF_TEXT
    return np.bincount(at, minlength=len(column) * CELLS_OF_TEXT).reshape(len(column), CELLS_OF_TEXT)


def _score(pairs: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """(old, new, b, kind) of pairs(old, new, wo, wn, b, kind) whose score is above zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                x, y = _cells(b.column(2)), _cells(b.column(3))
                keep = np.minimum(x, y).sum(1) >= SCORED * np.maximum(x.sum(1), y.sum(1))
                for i in np.flatnonzero(keep):
                    beta = weights[b.column(1)[i].as_py() & 1]
                    fields = features(*(np.frombuffer(b.column(c)[i].as_py(), np.uint32) for c in (2, 3)))
                    keep[i] = beta[0] + np.dot(beta[1:], fields) > 0
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 1, 4, 5)], ["old", "new", "b", "kind"])

    return pairs.select("old", "new", "wo", "wn", "b", "kind").mapInArrow(run, "old bigint, new bigint, b int, kind int")


def _verified(pairs: DataFrame, known: DataFrame, firsts: DataFrame, weights: dict) -> tuple[DataFrame, dict]:
    """The settled pairs (old, new, b, kind) that score as repetitions, with their number ``n`` and that of ``links`` within a batch.

    ``known`` has the words of ``old``, ``firsts`` those of ``new``.
    """
    near, seen = _settled(pairs.distinct(), "near")
    with_old = _slim(known.select(F.col("uid").alias("old"), F.col("w").alias("wo")), near, seen["n"], "old")
    with_both = _slim(firsts.select(F.col("uid").alias("new"), F.col("w").alias("wn")), with_old, seen["n"] * WORDY, "new")
    return _settled(_score(with_both, weights), "edges", links=F.count_if(F.col("kind") == LINK))


def _smallest(edges: DataFrame, n: int = 1 << 62) -> DataFrame:
    """(uid, rep) for the nodes of the settled edges(a, b), n many: the smallest uid that each is connected with; union by the smaller label until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("rep"))
    while True:
        near = _slim(both, labels.select(F.col("a").alias("b"), "rep"), n, "b").groupBy("a").agg(F.min("rep").alias("near"))
        # the label of the label halves long chains
        jump = labels.select(F.col("a").alias("rep"), F.col("rep").alias("far"))
        step = _slim(_slim(labels, near, n, "a"), jump, n, "rep", "left").select("a", F.least("rep", "near", F.coalesce("far", "rep")).alias("rep"), F.col("rep").alias("was"))
        step, seen = _settled(step, "labels", moved=F.count_if(F.col("rep") != F.col("was")))
        if not seen["moved"]:
            return step.select(F.col("a").alias("uid"), "rep")
        labels = step.select("a", "rep")


def _led(rest: DataFrame, fresh: DataFrame, weights: dict) -> DataFrame | None:
    """(old, new, b, kind) inside large buckets rest(key, uid, b, m, s0, …): LEADERS rows after the other are compared with all that are left."""
    found = None
    rest, seen = _settled(rest, "rest")
    while seen["n"]:
        first = F.row_number().over(Window.partitionBy("key").orderBy("b", "uid"))
        leaders, many = _settled(rest.withColumn("no", first).where(F.col("no") <= LEADERS).drop("no"), "leaders")
        edges, _ = _verified(_near(_small(leaders, many["n"] * WIDE), rest), fresh, fresh, weights)
        found = edges if found is None else found.unionByName(edges)
        gone = edges.select(F.col("new").alias("uid")).distinct()
        rest, seen = _settled(rest.join(leaders.select("key", "uid"), ["key", "uid"], "left_anti").join(gone, "uid", "left_anti"), "rest")
    return found


def _settle_batches(history: History, edges: DataFrame, n: int, links: int, number: int, batches: list[int]) -> DataFrame:
    """(uid, rep) of the rows of a run that repeat an earlier one, from its edges(old, new, b, kind), n many with links within a batch; batch after batch.

    A cluster of a batch belongs to the earliest of the rows before it that one of its rows repeats. A row
    before it that repeats another stands for that one, but only where the row has no other link.
    """
    spark, own = history.spark, edges.where(f"kind = {LINK}")
    moved = _smallest(own.select(F.col("old").alias("a"), F.col("new").alias("b")), links) if links else spark.createDataFrame([], "uid bigint, rep bigint")
    nodes = edges.select(F.col("new").alias("uid"), "b").unionByName(own.select(F.col("old").alias("uid"), "b")).distinct()
    nodes, seen = _settled(_slim(nodes, moved, 2 * links, "uid", "left").select("uid", F.coalesce("rep", "uid").alias("label"), "b"), "nodes")
    done = []
    for b in batches if seen["n"] else [number]:
        old = edges.where(F.col("b") == b)
        if done:
            old = _slim(old, history._read("reps", "uid bigint, rep bigint", done).withColumnRenamed("uid", "old"), seen["n"], "old", "left")
        else:
            old = old.withColumn("rep", F.lit(None).cast("bigint"))
        plain = (F.col("kind") == KNOWN) | (F.col("kind") == EARLIER) & F.col("rep").isNull()
        through = (F.col("kind") == MEMBER) | (F.col("kind") == EARLIER) & F.col("rep").isNotNull()
        each = old.groupBy(F.col("new").alias("uid")).agg(F.min(F.when(plain, F.col("old"))).alias("plain"), F.min(F.when(through, F.coalesce("rep", "old"))).alias("through"), F.count_if(F.col("kind") == LINK).alias("linked"))
        each = each.select("uid", F.coalesce("plain", F.when(F.col("linked") == 0, F.col("through"))).alias("earlier")).where("earlier IS NOT NULL")
        mine = nodes.where(F.col("b") == b)
        earliest = _slim(mine, each, n, "uid").groupBy("label").agg(F.min("earlier").alias("earlier"))
        reps = _slim(mine, earliest, n, "label", "left").select("uid", F.coalesce("earlier", "label").alias("rep")).where("uid != rep")
        done.append(f"{number}-{b}")
        history.moved += _put(reps, f"{history.path}/reps-{done[-1]}")[1]["n"]
    history.settled += done
    return history._read("reps", "uid bigint, rep bigint", done)


def take(history: History, batch: DataFrame, number: int, rows: int | None = None, batches: list[int] | None = None) -> DataFrame:
    """Add a run of batches (rows of ``read``) to the history; gives (uid, rep), rep being the earlier row that uid repeats, for the rows that repeat one.

    ``batches`` are the values of batch_no in the run, in order; without them all rows are one batch. The
    rows come in order of batch and uid, all after the rows of the history. ``batch`` is read several
    times and should be a table; ``rows`` is their number, if known. What counts as rare and as a
    repetition is learned from the first run, which should be one batch.
    """
    spark, rows = history.spark, batch.count() if rows is None else rows
    if history.counts is None:
        history.counts = spark.sparkContext.broadcast(_count_words(batch))
        for kind in (0, 1):
            few = batch.where(f"uid % 2 = {kind}").orderBy(F.xxhash64("uid")).limit(TRAINING_ROWS)
            history.weights[kind] = learn([np.frombuffer(r["w"], np.uint32) for r in few.collect()], strict=kind == 1)
    # one row for each exact text that the history doesn't have
    batch = batch.withColumn("b", F.col("batch_no") if batches else F.lit(number))
    order = F.struct("b", "uid") if batches else F.col("uid")
    fresh = batch.groupBy("exact").agg(*(F.min_by(c, order).alias(c) for c in ("uid", "b", "w", "salt")))
    if history.batches:
        seen = _slim(history.rows().select("exact"), batch.select("exact"), rows, "exact", "left_semi")
        fresh = _slim(fresh, seen, rows, "exact", "left_anti")
    fresh, own = _put(_keyed(fresh, history.counts), f"{history.path}/rows-{number}", keys=F.coalesce(F.sum(F.size("keys")), F.lit(0)))
    _sweep(spark)
    mine = _exploded(fresh)
    sizes = mine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets, seen = _settled(sizes, "buckets", hot=F.count_if(F.col("n") > SMALL_BUCKET), rows=F.coalesce(F.sum("n"), F.lit(0)))
    shared, hot_now = _slim(mine, buckets, seen["n"], "key"), seen["hot"]
    some = shared.where(f"n <= {SMALL_BUCKET}").drop("n")
    pairs, asked, many, finer = _near(_small(some, seen["rows"] * WIDE), some), mine, own["keys"], None
    held = lambda uids, n, how: _exploded(_slim(fresh, uids, n, "uid", how))  # noqa: E731  the keys of the run's rows that are, or aren't, among uids
    kept = held
    if hot_now:
        large = shared.where(f"n > {SMALL_BUCKET}").select("key", F.col("uid").alias("new"), F.col("b").alias("new_b"))
        first = large.groupBy("key").agg(F.min(F.struct(F.col("new_b").alias("b"), F.col("new").alias("uid"))).alias("first"))
        to_first = _slim(large, first, hot_now, "key").selectExpr("first.uid AS old", "first.b AS old_b", "new", "new_b").where("old != new")
        pairs = pairs.unionByName(to_first.select("old", "new", F.col("new_b").alias("b"), _kind()))
    if hot_now or history.hot_batches:
        hot = buckets.where(f"n > {SMALL_BUCKET}").select("key")
        if history.hot_batches:
            hot = hot.unionByName(history._read("hot", "key bigint", history.hot_batches[-1:])).distinct()
        hot, seen = _put(hot, f"{history.path}/hot-{number}")
        hot_keys = seen["n"]
        owners, seen = _settled(_slim(mine.select("key", "uid"), hot, seen["n"], "key").groupBy("uid").agg(F.collect_set("key").alias("keys")), "owners")
        finer, seen = _put(_finer(_slim(fresh.drop("keys"), owners, seen["n"], "uid"), history.counts), f"{history.path}/finer-{number}")
        asked, many = mine.unionByName(finer), many + seen["n"]
        fine = lambda uids, n, how: _slim(finer, uids, n, "uid", how).select("key", *SIDE)
        held = lambda uids, n, how, coarse=held: coarse(uids, n, how).unionByName(fine(uids, n, how))
        kept = lambda uids, n, how, coarse=kept: _slim(coarse(uids, n, how), hot, hot_keys, "key", "left_anti").unionByName(fine(uids, n, how))
    known = fresh.select("uid", "w")
    if history.batches:
        pairs = pairs.unionByName(_near(history.keyed(), _small(asked, many * WIDE), KNOWN))
        known = known.unionByName(history.rows().select("uid", "w"))
    edges, seen = _verified(pairs, known, fresh, history.weights)
    _sweep(spark)
    if hot_now:
        # of the rows with hot keys those that repeat none yet meet under finer keys
        left = finer.join(edges.select(F.col("new").alias("uid")).distinct(), "uid", "left_anti")
        left, _ = _settled(left.join(left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "left")
        few = left.where(f"n <= {SMALL_BUCKET}").drop("n")
        more, _ = _verified(_near(few, few), fresh, fresh, history.weights)
        led = _led(left.where(f"n > {SMALL_BUCKET}").drop("n"), fresh, history.weights)
        edges, seen = _settled(reduce(DataFrame.unionByName, [e for e in (edges, more, led) if e is not None]), "edges", links=F.count_if(F.col("kind") == LINK))
    if history.moved or hot_now:
        # rows without a link so far meet those that repeat another: of the history, and of the run where not all pairs of a key were compared
        done = edges.select(F.col("new").alias("uid")).distinct()
        rest = held(done, seen["n"], "left_anti")
        through, texts = [], []
        if history.moved:
            through, texts = [_near(_small(history.members(), history.member_keys * WIDE), rest, MEMBER)], [history.member_words()]
        if hot_now:
            through, texts = [*through, _near(kept(done, seen["n"], "left_semi"), rest)], [*texts, fresh.select("uid", "w")]
        more, also = _verified(reduce(DataFrame.unionByName, through), reduce(DataFrame.unionByName, texts), fresh, history.weights)
        if history.moved:
            more = more.join(history.reps().withColumnRenamed("uid", "old"), "old", "left").select(F.coalesce("rep", "old").alias("old"), "new", "b", "kind")
        edges, seen = edges.unionByName(more), {k: seen[k] + also[k] for k in ("n", "links")}
    before = history.moved
    gone = _settle_batches(history, edges, seen["n"], seen["links"], number, batches or [number]).select("uid")
    n = history.moved - before
    history.member_keys += _put(kept(gone, n, "left_semi"), f"{history.path}/members-{number}")[1]["n"]
    _slim(fresh.select("uid", "w"), gone, n, "uid", "left_semi").write.option("compression", "zstd").parquet(f"{history.path}/memberwords-{number}")
    history.batches.append(number)
    if finer is not None:
        history.hot_batches.append(number)
    _sweep(spark)
    return repeating(history, batch)


def repeating(history: History, rows: DataFrame) -> DataFrame:
    """(uid, rep) for those of rows(uid, exact), all taken before, that repeat an earlier row."""
    known = history.rows().select("exact", F.col("uid").alias("first")).join(history.reps().withColumnRenamed("uid", "first"), "first", "left")
    return rows.select("uid", "exact").join(known.select("exact", F.coalesce("rep", "first").alias("rep")), "exact").where("uid != rep").select("uid", "rep").distinct()


def repeats(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: each row and the accepted row it repeats, batch after batch.

    rows(kind, id, domain, batch_no, text). The first batch makes the history, all others wait and are one
    run. Repeated ids count once. An empty input gives an empty result.
    """
    path = shared_dir(spark, "words")
    read(rows).write.option("compression", "zstd").partitionBy("batch_no").parquet(path)
    schema = "uid bigint, exact binary, w binary, salt bigint, batch_no int"
    whole = spark.read.schema(schema).parquet(path)
    sizes = [(r["batch_no"], r["n"]) for r in whole.groupBy("batch_no").agg(F.count("*").alias("n")).orderBy("batch_no").collect()]
    if not sizes:
        return spark.createDataFrame([], "tbl string, id_a bigint, id_b bigint")
    history = History(spark)
    for run in (sizes[:1], sizes[1:]):
        if run:
            first, last = run[0][0], run[-1][0]
            take(history, whole.where(F.col("batch_no").between(first, last)), first, sum(n for _, n in run), [b for b, _ in run])
    out = repeating(history, whole)
    name = F.when(F.col("uid") % 2 == 0, "documents").otherwise("memories")
    a, b = F.shiftright("uid", 1), F.shiftright("rep", 1)
    return out.select(name.alias("tbl"), F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).where("id_a != id_b").distinct()
