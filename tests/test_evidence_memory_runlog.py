import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.config import Config
from quernel.operators import evidence, memory, runlog


def test_citations(spark):
    s = "array<struct<id:bigint>>"
    df = spark.createDataFrame([(1, "a[1][2][7] b[7]", [(5,), (6,), (7,)]), (2, "x[9]", [(1,), (2,)]), (3, None, None)], f"answer_id bigint, text string, sources {s}")
    got = {r.answer_id: r for r in evidence.cited(df).collect()}
    assert got[1].invalid == [7] and got[1].stripped == "a[1][2] b" and got[2].stripped == "x" and got[3].cites == []


def test_faithfulness(spark):
    a = spark.createDataFrame([(1, "x. y."), (2, "x"), (3, "根据现有资料无法回答。"), (4, None), (5, "!"), (6, "")], "answer_id bigint, text string")
    v = spark.createDataFrame([(1, True), (1, False), (2, True)], "answer_id bigint, supported boolean")
    got = {r.answer_id: (r.claims, r.faithfulness, r.grounded, r.refusal, r.low_confidence) for r in evidence.faithfulness(a, v).collect()}
    assert got[1] == (2, 0.5, False, False, True) and got[2] == (1, 1.0, True, False, False) and got[5] == (0, 0.0, False, False, True)
    assert got[3] == got[4] == got[6] == (0, None, False, True, False)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 5, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)], "query_id bigint, item bigint, rank int")
    rel = spark.createDataFrame([(1, 5), (2, 1), (2, 2), (3, 9)], "query_id bigint, item bigint")
    got = {r.query_id: r for r in evidence.ir_metrics(ranks, rel, 3).collect()}
    assert got[1].mrr == pytest.approx(1 / 3, abs=1e-6) and got[2].ndcg == 1.0 and got[2].recall == 1.0 and got[2].precision == pytest.approx(2 / 3, abs=1e-6)
    assert (got[3].recall, got[3].mrr, got[3].ndcg) == (0, 0, 0)


def test_references_and_marks(spark):
    rows = [("q", 1, 0, "a"), ("q", 1, 1, "b"), ("q", 2, 0, "b"), ("q", 2, 1, "c")]
    got = evidence.references(spark.createDataFrame(rows, "query string, answer_id int, pos int, source string"), "query", ["answer_id", "pos"])
    assert {(r.answer_id, r.pos): r.ref for r in got.collect()} == {(1, 0): 1, (1, 1): 2, (2, 0): 2, (2, 1): 3}
    df = spark.createDataFrame([("a[2] b[1] c[2] d[3]", [2, 1])], "t string, n array<int>")
    assert df.select(evidence.remap(F.col("t"), F.col("n")).alias("r")).first().r == "a[1] b[2] c[1] d[3]"


def test_bootstrap(spark):
    one = spark.createDataFrame([(0, 0.42)], "i bigint, v double")
    r = evidence.bootstrap(one, 50).first()
    assert (r.low, r.high) == (0.42, 0.42)
    many = spark.createDataFrame([(i, float(i % 7)) for i in range(80)], "i bigint, v double")
    r = evidence.bootstrap(many, 100).first()
    assert r.low < r.mean < r.high


def test_outcomes(spark):
    df = spark.createDataFrame([(1, "correct"), (1, "wrong"), (2, "correct"), (2, "conflict"), (3, "correct"), (3, "abstain")], "q int, o string")
    assert {r.q: r.w for r in df.groupBy("q").agg(evidence.worst_outcome(F.col("o")).alias("w")).collect()} == {1: "wrong", 2: "conflict", 3: "correct"}


def test_validity_and_trust(spark):
    rows = [(1, None, None, "verified", False), (2, "2030-01-01", None, "verified", False), (3, None, "2026-01-01", "verified", False), (4, "2026-01-01", None, " CURATED", False), (5, None, None, "draft", None), (6, None, None, "odd", False), (7, None, None, "verified", True)]
    df = spark.createDataFrame(rows, "i int, v string, w string, trust string, is_deleted boolean").select("i", "trust", "is_deleted", F.to_timestamp("v").alias("valid_at"), F.to_timestamp("w").alias("invalid_at"))
    now = F.lit("2026-01-01").cast("timestamp")
    assert sorted(r.i for r in memory.active(df, now, "verified").collect()) == [1, 4]
    assert sorted(r.i for r in memory.active(df, now).collect()) == [1, 4, 5]


def test_adding_twice(spark):
    kind = "fact_id bigint, scope string, owner_user_id string, content string, is_deleted boolean"
    known = spark.createDataFrame([(1, "personal", "a", "x", False), (2, "knowledge", None, "k", False), (3, "personal", "a", "gone", True)], kind)
    facts = spark.createDataFrame([(10, "personal", "a", "x", False), (11, "personal", "b", "x", False), (12, "personal", "b", "x", False), (13, "knowledge", None, "k", False), (14, "personal", "a", None, False), (15, "personal", "a", "gone", False)], kind)
    new = memory.add(known, facts)
    assert sorted(r.fact_id for r in new.collect()) == [11, 15]
    assert memory.add(known.unionByName(new.select(*known.columns)), facts).count() == 0


def test_similar_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 64))
    m = np.vstack([base, base + 0.25 * r.normal(size=base.shape), base[:5]]).astype(np.float32)
    rows = [(i, "personal", "u", [float(x) for x in v]) for i, v in enumerate(m)]
    got = {(x.memory_id, x.matched_id) for x in memory.similar(spark.createDataFrame(rows, "memory_id bigint, scope string, owner_user_id string, embedding array<float>")).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if round(float(u[i] @ u[j]), 6) >= Config().similarity} | {(i, 80 + i) for i in range(5)}
    assert len(want) > 20 and got <= want and len(got) >= 0.95 * len(want)


def test_feedback(spark):
    rows = [("a", True, 1, 1), ("a", True, 2, 2), ("b", False, 1, 3), ("c", False, 1, 4), ("c", True, 2, 5), ("c", False, 3, 6)]
    got = {r.key: (r.level, r.fails, r.invalidated) for r in memory.feedback(spark.createDataFrame(rows, "key string, ok boolean, at int, seq bigint")).collect()}
    assert got == {"a": (3, 0, None), "b": (1, 1, None), "c": (2, 2, 6)}


def test_run_log(spark):
    rows = [(1, s, "a" if s % 2 else "b", "{}", s == 3, 10) for s in range(1, 9)]
    steps = spark.createDataFrame(rows, "run_id int, step int, action string, args string, failed boolean, chars bigint")
    assert [r.repeated for r in runlog.repeated(steps).orderBy("step").collect()] == [False, False] + [True] * 6
    assert tuple(runlog.compact(steps, 3, 50).first()) == (1, 3, 2, 3)
    assert tuple(runlog.compact(steps, 3, 9).first()) == (1, 0, 0, 8)  # the budget drops recent steps too
    assert runlog.replay(steps, 14).count() == 2 and runlog.replay(steps).count() == 16
    assert runlog.replay(steps).where("kind = 'failed'").first().event_id == 6


def test_windows_and_quantiles(spark):
    e = spark.createDataFrame([(1, f"2026-01-01 00:00:0{i // 6}", "x", float(i)) for i in range(12)], "user_id int, ts string, kind string, value double")
    w = runlog.fixed_window(e.withColumn("ts", F.to_timestamp("ts")), 5, "second").orderBy("slot").collect()
    assert [(r.allowed, r.rejected) for r in w] == [(5, 1), (5, 1)]
    h = runlog.histogram(e, F.col("value"), [5.0, 11.0])
    assert runlog.quantile(h, 0.5).first().q == 5.0
    s = spark.createDataFrame([(i, i >= 2) for i in range(6)], "slot int, b boolean")
    assert [r.alert for r in runlog.held(s, F.col("b"), 3).orderBy("slot").collect()] == [False, False, False, False, True, True]


def test_web_evidence_keeps_4000_characters(spark):
    long = "word " * 1000
    rows = [(1, "https://a.example/1", "same start " * 30 + "one"), (2, "https://a.example/2", "same start " * 30 + "two"), (3, "https://a.example/3", long)]
    got = {r.result_id: r.content for r in evidence.web_evidence(spark.createDataFrame(rows, "result_id bigint, url string, snippet string")).collect()}
    assert got == {1: rows[0][2], 2: rows[1][2], 3: long[:4000]}
