"""Building and judging answers: contexts, costs, flags, outcomes, claims and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import evidence

#: Between the blocks of a context, and what marks a principle rather than a fact.
SEPARATOR = "\n\n---\n\n"
PLAYBOOK_HINTS = ("原则", "建议", "风险", "预案", "打法", "经验", "教训", "必做", "必须", "应当")
#: How actions begin that are invalid, and those that call no tool.
INVALID_ACTIONS = ("invalid", "unknown:", "error:", "invalid_args:")
NO_TOOL = (*INVALID_ACTIONS, "awaiting_approval:", "rejected:", "timeout:", "unavailable:", "duplicate:", "forbidden:", "unknown_outcome:")


def context_blocks(passages: DataFrame, guard: bool = True) -> DataFrame:
    """(answer_id, context) of passages(answer_id, pos, source, content): numbered blocks in order; with ``guard`` injected instructions are filtered."""
    body = text.sanitize(F.col("content")) if guard else F.col("content")
    rows = passages.select("answer_id", F.struct("pos", F.concat(F.lit("] (来源: "), F.coalesce("source", F.lit("")), F.lit(")\n"), F.coalesce(body, F.lit(""))).alias("b")).alias("x"))
    blocks = F.transform(F.array_sort(F.collect_list("x")), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), x["b"]))
    return rows.groupBy("answer_id").agg(F.array_join(blocks, SEPARATOR).alias("context"))


def history(turns: DataFrame, last: int) -> DataFrame:
    """(key, lines) of turns(key, at, id, role, content): the last ones as lines of speaker and text."""
    w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("id"))
    who = F.when(F.col("role") == "user", "用户").otherwise("助手")
    rows = turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last).select("key", F.struct((-F.col("n")).alias("n"), F.concat(who, F.lit(": "), F.trim(F.coalesce("content", F.lit("")))).alias("line")).alias("x"))
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"))


def estimate_tokens(k: Column, chars: Column) -> Column:
    """System text, k passages of so many characters at 1.2 a token, and the output."""
    return F.floor(500 + k * (chars / 1.2) + 400).cast("bigint")


def over_budget(k: Column, chars: Column, budget: int) -> Column:
    """Whether the estimate is over the budget; a budget of 0 or less is none."""
    return F.lit(False) if budget <= 0 else estimate_tokens(k, chars) > budget


def mentions(answer: Column, value: Column) -> Column:
    """Whether the value stands in the text, not within a longer number."""
    pattern = F.concat(F.lit(r"(?<!\d)\Q"), value, F.lit(r"\E(?!\d)"))
    return F.coalesce(F.regexp_like(F.coalesce(answer, F.lit("")), pattern), F.lit(False))


def classify(answer: Column, correct: Column, wrong: Column) -> Column:
    c, w = mentions(answer, correct), mentions(answer, wrong)
    return F.when(c & w, "conflict").when(w, "wrong").when(c, "correct").otherwise("abstain")


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """One row of counts and rates of outcomes(outcome); the rate of wrong ones is that of contamination. Zeros for none."""
    kinds = ("correct", "wrong", "conflict", "abstain")
    counts = outcomes.agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))
    return counts.select("n", *kinds, *(F.round(F.coalesce(F.col(k) / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias(f"{k}_rate") for k in kinds))


def quality(refusal: Column, low: Column, grounded: Column) -> Column:
    """The signal that is counted for an answer."""
    return F.when(refusal, "refusal").when(low, "low_confidence").when(grounded, "grounded").otherwise("none")


def flags(answers: DataFrame, faithful: DataFrame) -> DataFrame:
    """(answer_id, invalid, hash, faithfulness, grounded, refusal, low_confidence, quality): an answer with its invalid marks taken out and judged."""
    c = evidence.cited(answers).select("answer_id", F.concat_ws(",", "invalid").alias("invalid"), text.sha(F.col("stripped")).alias("hash"))
    f = faithful.select("answer_id", "faithfulness", "grounded", "refusal", "low_confidence")
    return c.join(f, "answer_id").withColumn("quality", quality(F.col("refusal"), F.col("low_confidence"), F.col("grounded")))


def refusal_rates(answers: DataFrame) -> DataFrame:
    """One row (n, refusal_accuracy, over_refusal) of answers(expected, predicted)."""
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    e, p = F.col("expected"), F.col("predicted")
    return answers.agg(F.count("*").alias("n"), share(F.count_if(e == p), F.count("*")).alias("refusal_accuracy"), share(F.count_if(~e & p), F.count_if(~e)).alias("over_refusal"))


def level(claim: Column) -> Column:
    """playbook if a word of principle, advice or risk is in it, else fact."""
    return F.when(F.coalesce(claim.rlike("|".join(PLAYBOOK_HINTS)), F.lit(False)), "playbook").otherwise("fact")


def claim_trust(trusts: Column) -> Column:
    """verified if there are sources and all are verified or curated, else draft."""
    fine = (F.size(trusts) > 0) & F.forall(trusts, lambda t: F.coalesce(t.isin("verified", "curated"), F.lit(False)))
    return F.when(fine, "verified").otherwise("draft")


def claims_to_facts(claims: DataFrame, references: DataFrame) -> DataFrame:
    """(claim_id, content, source_ref, level) of claims(claim_id, topic, claim, refs) and references(ref, source): the source is the first that is known, else ``research``."""
    each = claims.select("claim_id", F.posexplode("refs").alias("pos", "ref")).join(references.dropDuplicates(["ref"]), "ref")
    first = each.groupBy("claim_id").agg(F.min_by("source", "pos").alias("source"))
    rows = claims.join(first, "claim_id", "left")
    return rows.select("claim_id", F.concat("topic", F.lit("："), "claim").alias("content"), F.coalesce("source", F.lit("research")).alias("source_ref"), level(F.col("claim")).alias("level"))


def invalid_action(action: Column) -> Column:
    return action.isNull() | action.rlike("^(" + "|".join(INVALID_ACTIONS) + ")")


def tool_sequence(steps: DataFrame, expected: DataFrame, forbidden: list[str]) -> DataFrame:
    """(run_id, matches, forbidden_calls) of steps(run_id, step, action) and expected(run_id, tools): the tools called, in order, against those expected."""
    tool = F.when(F.col("action").isNotNull() & (F.col("action") != "final") & ~F.col("action").rlike("^(" + "|".join(NO_TOOL) + ")"), F.struct("step", "action"))
    runs = steps.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(tool)), lambda x: x["action"]).alias("called"), F.count_if(F.col("action").isin(forbidden)).alias("forbidden_calls"))
    return runs.join(expected, "run_id").select("run_id", (F.col("called") == F.col("tools")).alias("matches"), "forbidden_calls")


def where_given(rows: DataFrame, **wanted) -> DataFrame:
    """Only rows that equal the values given; a None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def tagged(tags: Column, wanted: dict[str, str]) -> Column:
    """Whether JSON tags contain all the wanted entries."""
    read = F.from_json(tags, "map<string,string>")
    has = F.lit(True)
    for k, v in wanted.items():
        has = has & (F.try_element_at(read, F.lit(k)) == v)
    return F.coalesce(has, F.lit(False))


def reflected(first: DataFrame, more: DataFrame) -> DataFrame:
    """(query_id, chunk_id, place) of two results (query_id, chunk_id, rank): the second adds what the first lacks, behind it."""
    both = first.select("query_id", "chunk_id", F.lit(0).alias("round"), "rank").unionByName(more.select("query_id", "chunk_id", F.lit(1).alias("round"), "rank"))
    once = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("round", "rank")).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id"))).select("query_id", "chunk_id", "place")
