"""Texts into containers of a fixed number of tokens.

The plan needs only how many items there are of each size, at most ``capacity`` numbers: first the
dominance reduction of Martello and Toth fixes small sets that no other way of filling a container
with its largest item can beat; then best fit fills the rest, largest first. The plan is a list of
runs (size, first item, items, first container, items a container), whose number depends on the
sizes and not on the items. Spark ranks the items of each size in salted groups and looks up the
container of each rank.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm import tokenizer
from quernel.session import settle


class Plan:
    """Runs in the order of (size, first item); ``containers`` is the number of containers."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.containers, self.runs = capacity, 0, []
        self.left = {s: n for s, n in counts.items() if n and 0 < s <= capacity}
        self.used = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.fixed = self._reduce()
        self._best_fit()
        self.runs.sort()

    def _take(self, size: int, items: int, container: int, each: int = 1) -> None:
        self.runs.append((size, self.used[size], items, container, each))
        self.used[size] += items
        self.left[size] -= items
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def _largest(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The largest size that fits into room, when the items of ``without`` are taken; 0 if none does."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0 and self.left[self.sizes[at]] <= without.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def _smallest(self, how_many: int, above: int, without: tuple[int, ...]) -> int | None:
        """The sum of the ``how_many`` smallest items larger than ``above``; None if there are fewer."""
        total = 0
        for s in self.sizes[bisect_right(self.sizes, above) :]:
            n = min(how_many, self.left[s] - without.count(s))
            total, how_many = total + max(0, n) * s, how_many - max(0, n)
            if not how_many:
                return total
        return None

    def _dominant(self, j: int) -> tuple[int, ...] | None:
        """A set with j that dominates every other feasible set with j, or None."""
        room = self.capacity - j
        r = self._largest(room, (j,))
        if not r:
            return (j,)
        two, three = self._smallest(2, 0, (j,)), self._smallest(3, 0, (j,))
        if r == room or two is None or two > room:
            return (j, r)
        if three is None or three > room:  # two others at most
            b = self._largest(room - r, (j, r))
            over = self._smallest(2, b, (j,))
            if over is None or over > room:  # the smaller one of any pair is at most b, the larger one at most r
                return (j, r, b) if b else (j, r)
        return None

    def _reduce(self) -> int:
        start, at = self.containers, len(self.sizes) - 1
        while at >= 0:
            j = self.sizes[at]
            best = self._dominant(j)
            if best is None:
                at -= 1
                continue
            m = min(self.left[s] // best.count(s) for s in best)
            for s in sorted(set(best)):
                self._take(s, m * best.count(s), self.containers, best.count(s))
            self.containers += m
            at = min(bisect_right(self.sizes, j), len(self.sizes)) - 1
        return self.containers - start

    def _best_fit(self) -> None:
        rooms: list[int] = []  # sorted rooms of open containers
        opened: dict[int, list[list[int]]] = {}  # room -> runs of containers [first, how many]

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in opened:
                    insort(rooms, room)
                opened.setdefault(room, []).append([first, n])

        while self.sizes:
            s = self.sizes[-1]
            n = self.left[s]
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = min(self.capacity // s, n)
                m = n // each
                self._take(s, m * each, self.containers, each)
                keep(self.capacity - s * each, self.containers, m)
                self.containers += m
                continue
            room = rooms[at]
            each = min(room // s, n)
            first, have = opened[room][-1]
            m = min(have, n // each)
            if m == have:
                opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[at]
            else:
                opened[room][-1] = [first + m, have - m]
            self._take(s, m * each, first, each)
            keep(room - s * each, first, m)


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, n_tokens): one row a text, or full pieces and a rest where a text exceeds the capacity."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    last = F.greatest(F.floor((n - 1) / capacity), F.lit(0))
    cut = sizes.select(F.col(key).alias(key), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    return cut.select(key, F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def fill(items: DataFrame, key: str, capacity: int, salt_rows: int = 100_000) -> DataFrame:
    """(key, piece, n_tokens, container) from items(key, piece, n_tokens).

    Container numbers run from 0 without gaps; no container holds more than ``capacity``. Items of size 0
    take no room and go to container 0. Repeated rows and null keys are items of their own.
    """
    items = settle(items.select(key, "piece", "n_tokens"), "items")
    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity)
    runs = np.array(plan.runs, np.int64).reshape(-1, 5)
    order = runs[:, 0] * (1 << 40) + runs[:, 1]
    salts = 1 + max(counts.values(), default=0) // salt_rows
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    upto = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).select("n_tokens", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(key, "piece")) - 1
    ranked = salted.withColumn("within", within).join(offsets, ["n_tokens", "salt"]).select(key, "piece", "n_tokens", (F.col("within") + F.col("offset")).alias("rank"))
    shared = items.sparkSession.sparkContext.broadcast((runs, order))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, order = shared.value
        for b in batches:
            size, rank = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            container = np.zeros(len(size), np.int64)
            at = np.flatnonzero(size > 0)
            if len(at):
                run = runs[np.searchsorted(order, size[at] * (1 << 40) + rank[at], side="right") - 1]
                container[at] = run[:, 3] + (rank[at] - run[:, 1]) // run[:, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(container)], [key, "piece", "n_tokens", "container"])

    return ranked.mapInArrow(place, f"`{key}` {items.schema[key].dataType.simpleString()}, piece int, n_tokens int, container bigint")


def containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = tokenizer.VOCABULARY) -> DataFrame:
    """(key, piece, n_tokens, container): every text of df in a container of ``capacity`` tokens.

    A text is whole in one container (piece 0) unless it alone exceeds the capacity; then its full
    pieces have containers of their own and the rest is an item like others. Null and empty texts
    have 0 tokens and go to container 0.
    """
    return fill(pieces(tokenizer.count_tokens(df, key, text, vocabulary), key, capacity), key, capacity)
