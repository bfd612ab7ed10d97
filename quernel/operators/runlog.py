"""Logs of runs and time series of service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated(steps: DataFrame) -> DataFrame:
    """(run_id, step, repeated): whether the same action with the same arguments came earlier in the run."""
    w = Window.partitionBy("run_id", "action", "args").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("run_id", "step", (F.count("*").over(w) > 0).alias("repeated"))


def compact(steps: DataFrame, keep: int, most_chars: int) -> DataFrame:
    """(run_id, kept, summarized, dropped) of steps(run_id, step, chars): the newest ``keep`` steps stay and older ones are summarized,
    as long as the characters, from the newest on, are within the budget; beyond it the oldest are dropped, recent ones too."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("step"))
    s = steps.withColumn("n", F.row_number().over(newest)).withColumn("total", F.sum("chars").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("total") > most_chars, "dropped").when(F.col("n") <= keep, "kept").otherwise("summarized")
    return s.withColumn("state", state).groupBy("run_id").agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("kept", "summarized", "dropped")))


def replay(steps: DataFrame, after: int | None = None) -> DataFrame:
    """(run_id, event_id, kind, action): two events a step, numbered in each run; those after an id, or all."""
    events = steps.select("run_id", "step", "action", F.posexplode(F.array(F.lit("started"), F.when(F.col("failed"), "failed").otherwise("done"))).alias("half", "kind"))
    numbered = events.withColumn("event_id", F.row_number().over(Window.partitionBy("run_id").orderBy("step", "half")))
    return numbered.where(F.lit(True) if after is None else F.col("event_id") > after).select("run_id", "event_id", "kind", "action")


def ledger(events: DataFrame) -> DataFrame:
    """(key, state, attempts) of operations from events(key, kind, at, seq): the last kind decides, failed ones may start again."""
    last = F.max_by("kind", F.struct("at", "seq"))
    state = F.when(last == "error", "failed").when(last == "purchase", "succeeded").otherwise("unknown")
    return events.groupBy("key").agg(state.alias("state"), F.count("*").alias("attempts"))


def trajectory(steps: DataFrame) -> DataFrame:
    """One row: runs, steps, invalid actions over steps, mean steps over runs, mean latency over measured steps."""
    runs = steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if("failed").alias("failed"), F.sum("latency").alias("latency"), F.count("latency").alias("measured"))
    return runs.agg(
        F.count("*").alias("runs"), F.sum("steps").alias("steps"), F.round(F.sum("failed") / F.sum("steps"), 6).alias("invalid_rate"), F.round(F.avg("steps"), 6).alias("avg_steps"),
        F.round(F.sum("latency") / F.sum("measured"), 4).alias("avg_latency"), F.round(F.count_if(F.col("failed") == 0) / F.count("*"), 6).alias("clean_rate"),
    )


def fixed_window(events: DataFrame, limit: int, unit: str) -> DataFrame:
    """(user_id, slot, allowed, rejected): the first ``limit`` events of a user in each unit of time pass."""
    start = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    n = events.groupBy("user_id", start.alias("slot")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("slot").cast("timestamp_ntz").alias("slot"), F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def sliding(events: DataFrame, bad: Column, size_s: int, step_s: int) -> DataFrame:
    """(slot, n, bad, ratio) of sliding windows over events(ts), by the start of the window."""
    w = F.window(F.col("ts").cast("timestamp"), f"{size_s} seconds", f"{step_s} seconds")
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("slot"), "n", "bad", F.round(F.col("bad") / F.greatest(F.col("n"), F.lit(1)), 6).alias("ratio"))


def held(series: DataFrame, breach: Column, times: int) -> DataFrame:
    """(slot, breach, alert): an alert holds if the condition held in each of the last ``times`` windows. The series must be
    one of windows, whose number the time span bounds; it goes through one task."""
    w = Window.orderBy("slot").rowsBetween(1 - times, 0)
    s = series.select("slot", breach.alias("breach"))
    return s.select("slot", "breach", (F.bool_and("breach").over(w) & (F.count("*").over(w) == times)).alias("alert"))


def histogram(events: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """One row for each group and bound: (kind, le, cumulative)."""
    counts = events.groupBy("kind").agg(*(F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    return counts.select("kind", F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)))).alias("h")).select("kind", "h.le", "h.cumulative")


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """(kind, q) by linear interpolation in the first bucket that reaches the quantile."""
    w = Window.partitionBy("kind").orderBy("le")
    h = hist.select("kind", "le", "cumulative", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.coalesce(F.lag("cumulative").over(w), F.lit(0)).alias("before"), F.max("cumulative").over(Window.partitionBy("kind")).alias("total"))
    first = h.where(F.col("cumulative") >= q * F.col("total")).groupBy("kind").agg(F.min_by(F.struct("le", "low", "cumulative", "before", "total"), "le").alias("b"))
    inside = (q * F.col("b.total") - F.col("b.before")) / F.greatest(F.col("b.cumulative") - F.col("b.before"), F.lit(1))
    return first.select("kind", F.round(F.col("b.low") + (F.col("b.le") - F.col("b.low")) * inside, 4).alias("q"))
