"""A memory table with trust and validity: gates, search, idempotent adding, similar pairs, feedback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.config import DEFAULTS, Config
from quernel.functions import text
from quernel.operators import retrieval
from quernel.session import settle


def valid(now: Column) -> Column:
    """Half open: valid from valid_at on, until before invalid_at; null bounds are open."""
    return (F.col("valid_at").isNull() | (F.col("valid_at") <= now)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > now))


def active(memories: DataFrame, now: Column, trust: str = "draft") -> DataFrame:
    """Rows not deleted, valid now, and of this trust or more. An unknown trust ranks below draft."""
    return memories.where(~F.coalesce("is_deleted", F.lit(False)) & valid(now) & (text.trust_rank(F.col("trust")) >= text.trust_rank(F.lit(trust))))


def domain() -> Column:
    """Scope and owner in one key, a null owner being one of its own."""
    return F.concat_ws("|", "scope", F.coalesce(F.concat(F.lit("u:"), "owner_user_id"), F.lit("-")))


def add(memories: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts(scope, owner_user_id, content) that are new in their domain, each once: adding them twice changes nothing."""
    key = [domain().alias("domain"), text.sha(F.col("content")).alias("hash")]
    known = memories.where(~F.coalesce("is_deleted", F.lit(False))).select(*key)
    new = facts.where("content IS NOT NULL").select("*", *key)
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy("domain", "hash").orderBy("fact_id"))).where("_n = 1").drop("_n")
    return once.join(known, ["domain", "hash"], "left_anti").drop("hash")


def search(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k most similar memories of the same scope and owner for queries(query_id, scope, owner_user_id, embedding).

    Domains of few memories share a part, so that neither small domains cost a task each nor a large one a
    task alone: a domain is cut into parts of bounded size by a hash, and a query goes to the parts of its domain.
    """
    rows = settle(memories.select(domain().alias("domain"), F.col("memory_id").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("v")), "memories")
    sizes = rows.groupBy("domain").agg(F.ceil(F.count("*") / retrieval.PART).cast("int").alias("cuts"))
    groups = max(1, -(-rows.count() // retrieval.PART))
    place = lambda cut: F.pmod(F.xxhash64("domain", cut), F.lit(groups)).cast("int")
    left = rows.join(sizes, "domain").select("domain", "chunk_id", "v", place(F.pmod(F.xxhash64("chunk_id"), F.col("cuts")).cast("int")).alias("part"))
    asked = queries.select(domain().alias("domain"), F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("v")).join(sizes, "domain")
    right = asked.select("domain", "query_id", "v", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")).select("domain", "query_id", "v", place(F.col("cut")).alias("part")).distinct()

    def score(some: pa.Table, few: pa.Table) -> pa.Table:
        found = [retrieval._best(np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), k, -2.0)]
        for name in few["domain"].unique().to_pylist() if some.num_rows and few.num_rows else []:
            own, asked = some.filter(pa.compute.equal(some["domain"], name)), few.filter(pa.compute.equal(few["domain"], name))
            for at in range(0, asked.num_rows if own.num_rows else 0, retrieval.BLOCK):
                q = asked.slice(at, retrieval.BLOCK)
                s = np.round(retrieval._matrix(q["v"], q.num_rows) @ retrieval._matrix(own["v"], own.num_rows).T, 6)
                found.append(retrieval._best(s, q["query_id"].to_numpy(), own["chunk_id"].to_numpy(), k, -2.0))
        return pa.concat_tables(found)

    return retrieval.ranked(left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(score, "query_id bigint, chunk_id bigint, score double"), k)


def similar(memories: DataFrame, cfg: Config = DEFAULTS, bits: int = 14, tables: int = 56, seed: int = 5) -> DataFrame:
    """(memory_id, matched_id, similarity): pairs of one domain with a cosine of cfg.similarity or more.

    Rows meet if the signs of ``bits`` fixed projections agree in one of ``tables`` tables, and are then
    compared exactly. With a cosine of 0.92 they meet with odds of 0.9998; the tests hold this against
    brute force. Equal vectors of a domain are compared once and matched with their smallest id.
    """
    rows = memories.where(text.usable(F.col("embedding"), cfg.dimension)).select("memory_id", domain().alias("domain"), "embedding")
    same = rows.groupBy("domain", "embedding").agg(F.min("memory_id").alias("rep"))
    planes = np.random.default_rng(seed).normal(size=(cfg.dimension, tables * bits))
    place = (1 << np.arange(bits)).astype(np.int64)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                code = ((x @ planes >= 0).reshape(len(x), tables, bits) @ place) * tables + np.arange(tables)
                at = pa.array(np.repeat(np.arange(len(x)), tables))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(code.ravel())], ["domain", "rep", "bucket"])

    ids = same.select("domain", "rep", "embedding").mapInArrow(buckets, "domain string, rep bigint, bucket bigint")
    pairs = ids.withColumnRenamed("rep", "a").join(ids.withColumnRenamed("rep", "b"), ["domain", "bucket"]).where("a < b").select("a", "b").distinct()
    left, right = same.select(F.col("rep").alias("a"), F.col("embedding").alias("va")), same.select(F.col("rep").alias("b"), F.col("embedding").alias("vb"))
    near = pairs.join(left, "a").join(right, "b").select("a", "b", F.round(text.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))
    twins = rows.join(same, ["domain", "embedding"]).where("memory_id != rep").select(F.col("rep").alias("a"), F.col("memory_id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.where(F.col("similarity") >= cfg.similarity).unionByName(twins).select(F.col("a").alias("memory_id"), F.col("b").alias("matched_id"), "similarity")


def outcome(ok: Column, trust: Column, fails: Column, most_fails: int = 2) -> Column:
    """promote to the next level of trust after a success, invalidate from ``most_fails`` failures on, else noop; as struct(action, trust)."""
    t = F.lower(F.trim(trust))
    up = F.when(t == "draft", "verified").otherwise("curated")
    act = F.when(ok, "promote").when(fails >= most_fails, "invalidate").otherwise("noop")
    return F.struct(act.alias("action"), F.when(ok, up).alias("trust"))


def decide(known: Column, similarity: Column, matched: Column, cfg: Config = DEFAULTS) -> Column:
    """NOOP for a content that is known by its hash, UPDATE of the most similar memory if it is similar enough, else ADD; as struct(op, target)."""
    near = F.coalesce(similarity >= cfg.similarity, F.lit(False))
    op = F.when(known, "NOOP").when(near, "UPDATE").otherwise("ADD")
    return F.struct(op.alias("op"), F.when(~known & near, matched).alias("target"))


def promote(trust: Column, support: Column, needed: int = 2) -> Column:
    """A draft with enough support is verified; others stay."""
    return F.when((text.trust_rank(trust) == 1) & (support >= needed), "verified").otherwise(F.lower(F.trim(trust)))


def feedback(events: DataFrame, most_fails: int = 2) -> DataFrame:
    """(key, level, fails, invalidated) folded from events(key, ok, at, seq): one level up for a success (3 at most), invalid from the second failure on, after which nothing counts."""
    w = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("live", F.count_if(~F.col("ok")).over(w) < most_fails)
    run = events.withColumn("fails", F.count_if(~F.col("ok")).over(w)).withColumn("wins", F.count_if(F.col("ok") & F.col("live")).over(w))
    return run.groupBy("key").agg(F.least(F.lit(3), 1 + F.max("wins")).alias("level"), F.max("fails").alias("fails"), F.min(F.when(F.col("fails") >= most_fails, F.col("seq"))).alias("invalidated"))
