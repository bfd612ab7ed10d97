"""Evidence behind answers: citations, faithfulness, web evidence, research references, evaluation measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.config import DEFAULTS, Config
from quernel.functions import text


def once(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def cited(answers: DataFrame) -> DataFrame:
    """(answer_id, cites, valid, invalid, stripped) of answers(answer_id, text, sources): which [n] point to a source."""
    n = F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0))
    cites = text.citations(F.col("text"))
    rows = answers.select("answer_id", "text", n.alias("n"), cites.alias("cites"))
    ok = lambda x: (x >= 1) & (x <= F.col("n"))
    rows = rows.select("answer_id", "text", "cites", F.filter("cites", ok).alias("valid"), F.array_sort(F.array_distinct(F.filter("cites", lambda x: ~ok(x)))).alias("invalid"))
    alternatives = F.concat(F.lit(r"\[("), F.concat_ws("|", F.transform("invalid", lambda x: x.cast("string"))), F.lit(r")\]"))
    stripped = F.when(F.size("invalid") == 0, F.coalesce("text", F.lit(""))).otherwise(F.regexp_replace(F.coalesce("text", F.lit("")), alternatives, F.lit("")))
    return rows.select("answer_id", "cites", "valid", "invalid", stripped.alias("stripped"))


def judged(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, supported): each sentence of an answer held against its contexts.

    The default judge: a sentence is supported if half of its terms or more are in one context of
    contexts(answer_id, context). Another judge can take its place on the same rows.
    """
    s = answers.select("answer_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    terms = s.select("answer_id", "sentence_no", F.array_distinct(text.tokenize(F.col("sentence"))).alias("terms"))
    c = contexts.select("answer_id", F.array_distinct(text.tokenize(F.col("context"))).alias("have"))
    share = F.size(F.array_intersect("terms", "have")) / F.greatest(F.size("terms"), F.lit(1))
    return terms.join(c, "answer_id", "left").groupBy("answer_id", "sentence_no").agg((F.coalesce(F.max(share), F.lit(0.0)) >= 0.5).alias("supported"))


#: Fixed value: how a refusal begins.
REFUSAL = "根据现有资料无法回答"


def refused(answer: Column) -> Column:
    """An empty answer, or one that begins with the refusal."""
    return F.coalesce((answer == "") | answer.startswith(REFUSAL) | F.trim(answer).startswith(REFUSAL) & (F.trim(answer) == REFUSAL), F.lit(True))


def faithfulness(answers: DataFrame, verdicts: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """(answer_id, claims, supported, faithfulness, hallucination, grounded, refusal, low_confidence), one row for each of answers(answer_id, text).

    verdicts(answer_id, supported) has a row for each claim. A refusal has nulls and isn't grounded; an
    answer without claims has a faithfulness of 0.
    """
    counts = verdicts.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"))
    no = refused(F.col("text"))
    rows = answers.select("answer_id", no.alias("refusal")).join(counts, "answer_id", "left")
    count = lambda c: F.when(F.col("refusal"), 0).otherwise(F.coalesce(c, F.lit(0)))
    rows = rows.select("answer_id", "refusal", count("claims").alias("claims"), count("supported").alias("supported"))
    share = F.when(F.col("claims") > 0, F.col("supported") / F.col("claims")).otherwise(0.0)
    grounded = ~F.col("refusal") & (share >= cfg.grounded)
    return rows.select(
        "answer_id", "claims", "supported", F.when(~F.col("refusal"), F.round(share, 4)).alias("faithfulness"), F.when(~F.col("refusal"), F.round(1 - share, 4)).alias("hallucination"),
        grounded.alias("grounded"), "refusal", (~F.col("refusal") & ~grounded).alias("low_confidence"),
    )


def web_evidence(results: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """(result_id, url, content, trust): safe results with a cleaned, cut and sanitized snippet; the first of each URL."""
    safe = results.where(text.safe_url(F.col("url")) & (F.trim(F.coalesce("snippet", F.lit(""))) != ""))
    return once(safe, "url", ["result_id"]).select("result_id", "url", text.clean_web(F.col("snippet"), cfg.web_chars).alias("content"), F.lit("draft").alias("trust"))


def references(claims: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(…, ref): each source numbered from 1 within ``key`` by its first appearance."""
    first = claims.groupBy(key, "source").agg(F.min(F.struct(*order)).alias("_first"))
    numbered = first.withColumn("ref", F.row_number().over(Window.partitionBy(key).orderBy("_first"))).drop("_first")
    return claims.join(numbered, [key, "source"])


def remap(content: Column, numbers: Column) -> Column:
    """Local [n] marks replaced by numbers[n] at once; marks without a number stay."""
    parts = F.split(content, r"\[\d+\]", -1)
    marks = F.regexp_extract_all(content, F.lit(r"\[(\d+)\]"), F.lit(1))
    new = F.transform(marks, lambda m: F.concat(F.lit("["), F.coalesce(F.try_element_at(numbers, m.cast("int")).cast("string"), m), F.lit("]")))
    return F.array_join(F.transform(F.arrays_zip(parts.alias("p"), new.alias("m")), lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")


def ir_metrics(ranks: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row for each query of relevant(query_id, item): recall, precision, reciprocal rank and nDCG of ranks(query_id, item, rank).

    Recall, precision and nDCG look at the first k ranks, the reciprocal rank at all; a query without
    any found item has zeros.
    """
    total = relevant.groupBy("query_id").agg(F.countDistinct("item").alias("total"))
    hit = ranks.join(relevant.select("query_id", "item").distinct(), ["query_id", "item"])
    per = hit.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return total.join(per, "query_id", "left").select(
        "query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("total"), 6).alias("recall"), F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def bootstrap(values: DataFrame, resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row (n, mean, low, high) of values(i, v), i being unique: percentile bounds of the mean by resampling.

    Each row comes into each resample as often as a Poisson variable of mean 1, taken from a hash of
    (seed, resample, i), so that the draws are the same everywhere, no row is numbered, and sums are
    formed before the shuffle. Resamples without any row don't count.
    """
    draws = values.select("i", "v", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))  # resamples is a parameter
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    times, below, chance = F.lit(0), 0.0, math.exp(-1)
    for k in range(12):
        below, chance = below + chance, chance / (k + 1)
        times = times + (u >= below).cast("int")
    means = draws.select("b", "v", times.alias("times")).groupBy("b").agg((F.sum(F.col("v") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("m")).where("m IS NOT NULL")
    place = F.row_number().over(Window.orderBy("m", "b")) - 1  # over the resamples, whose number is a parameter
    low, high = int((1 - confidence) / 2 * resamples), min(int((1 + confidence) / 2 * resamples) - 1, resamples - 1)
    bounds = means.withColumn("place", place).agg(F.max(F.when(F.col("place") <= low, F.col("m"))).alias("low"), F.max(F.when(F.col("place") <= high, F.col("m"))).alias("high"))
    return values.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).crossJoin(F.broadcast(bounds)).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def worst_outcome(outcome: Column) -> Column:
    """The outcome of repeated attempts by precedence: wrong, conflict, correct, abstain."""
    rank = F.min(F.when(outcome == "wrong", 1).when(outcome == "conflict", 2).when(outcome == "correct", 3).otherwise(4))
    return F.element_at(F.array(*map(F.lit, ("wrong", "conflict", "correct", "abstain"))), rank)
