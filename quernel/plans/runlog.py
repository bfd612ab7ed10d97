"""Queries of run logs and service levels over the event stream: a user is a run, an event a step, an error a failed one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.operators import runlog
from quernel.session import table

BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def steps(spark, sf_dir):
    e = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("run_id"), n.alias("step"), F.col("event_type").alias("action"), F.col("props").alias("args"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("latency"), F.length("props").cast("bigint").alias("chars"))


def duplicate_actions(spark, sf_dir):
    return runlog.repeated(steps(spark, sf_dir)).groupBy("run_id").agg(F.count_if("repeated").alias("repeated"), F.count("*").alias("n"))


def compact_history(spark, sf_dir):
    return runlog.compact(steps(spark, sf_dir), 6, 200)


def event_replay(spark, sf_dir):
    return runlog.replay(steps(spark, sf_dir), 20)


def ledger_state(spark, sf_dir):
    e = events(spark, sf_dir).select(F.concat_ws(":", "user_id", "props").alias("key"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return runlog.ledger(e)


def trajectory_summary(spark, sf_dir):
    return runlog.trajectory(steps(spark, sf_dir).withColumn("latency", F.round(F.col("latency") * 100).cast("bigint")))


def rate_limit(spark, sf_dir):
    return runlog.fixed_window(events(spark, sf_dir), 2, "day")


def error_ratio(spark, sf_dir):
    return runlog.sliding(events(spark, sf_dir), F.col("event_type") == "error", 3600, 1800)


def alert_hold(spark, sf_dir):
    return runlog.held(error_ratio(spark, sf_dir), F.col("ratio") > 0.05, 3)


def latency_histogram(spark, sf_dir):
    return runlog.histogram(events(spark, sf_dir).withColumnRenamed("event_type", "kind"), F.col("value"), BOUNDS)


def latency_p95(spark, sf_dir):
    return runlog.quantile(latency_histogram(spark, sf_dir), 0.95)


QUERIES = {f.__name__: f for f in (duplicate_actions, compact_history, event_replay, ledger_state, trajectory_summary, rate_limit, error_ratio, alert_hold, latency_histogram, latency_p95)}

_STEPS = "s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS action, props AS args, event_type = 'error' AS failed, value AS latency, length(props) AS chars FROM events)"
_RATIO = "WITH w AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts) AS t FROM events), x AS (SELECT event_type, t AS slot FROM w UNION ALL SELECT event_type, t - INTERVAL 30 MINUTES FROM w) SELECT slot, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM x GROUP BY 1"
_HIST = f"SELECT event_type AS kind, le, count(*) FILTER (value <= le) AS cumulative FROM events, (SELECT unnest({BOUNDS}::DOUBLE[]) AS le) GROUP BY 1, 2"
SQL = {
    "duplicate_actions": f"WITH {_STEPS}, r AS (SELECT run_id, count(*) OVER (PARTITION BY run_id, action, args ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS r FROM s) SELECT run_id, count(*) FILTER (r) AS repeated, count(*) AS n FROM r GROUP BY 1",
    "compact_history": f"WITH {_STEPS}, n AS (SELECT run_id, row_number() OVER w AS n, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step DESC)), t AS (SELECT run_id, CASE WHEN total > 200 THEN 'dropped' WHEN n <= 6 THEN 'kept' ELSE 'summarized' END AS state FROM n) SELECT run_id, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state = 'summarized') AS summarized, count(*) FILTER (state = 'dropped') AS dropped FROM t GROUP BY 1",
    "event_replay": f"WITH {_STEPS}, e AS (SELECT run_id, step, 0 AS half, 'started' AS kind, action FROM s UNION ALL SELECT run_id, step, 1, CASE WHEN failed THEN 'failed' ELSE 'done' END, action FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, half) AS event_id FROM e) SELECT run_id, event_id, kind, action FROM n WHERE event_id > 20",
    "ledger_state": "WITH l AS (SELECT concat_ws(':', user_id, props) AS key, arg_max(event_type, (ts, event_id)) AS last, count(*) AS attempts FROM events GROUP BY 1) SELECT key, CASE last WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'unknown' END AS state, attempts FROM l",
    "trajectory_summary": f"WITH {_STEPS}, r AS (SELECT run_id, count(*) AS steps, count(*) FILTER (failed) AS failed, sum(round(latency * 100)::BIGINT) AS latency, count(latency) AS measured FROM s GROUP BY 1) SELECT count(*) AS runs, sum(steps)::BIGINT AS steps, round(sum(failed) / sum(steps), 6) AS invalid_rate, round(avg(steps), 6) AS avg_steps, round(sum(latency) / sum(measured), 4) AS avg_latency, round(count(*) FILTER (failed = 0) / count(*), 6) AS clean_rate FROM r",
    "rate_limit": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS slot, least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2",
    "error_ratio": _RATIO,
    "alert_hold": f"WITH r AS ({_RATIO}), b AS (SELECT slot, ratio > 0.05 AS breach FROM r) SELECT slot, breach, bool_and(breach) OVER w AND count(*) OVER w = 3 AS alert FROM b WINDOW w AS (ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "latency_histogram": _HIST,
    "latency_p95": f"WITH h AS ({_HIST}), l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS before, max(cumulative) OVER (PARTITION BY kind) AS total FROM h WINDOW w AS (PARTITION BY kind ORDER BY le)) SELECT kind, round(low + (le - low) * (0.95 * total - before) / greatest(cumulative - before, 1), 4) AS q FROM l WHERE cumulative >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY kind ORDER BY le) = 1",
}
