import pytest
from pyspark.sql import functions as F

from quernel.config import Config
from quernel.functions import parse
from quernel.operators import answers as ops
from quernel.operators import ingest, memory, retrieval


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_verdicts(spark):
    assert not one(spark, parse.verdict, "NOT_SUPPORTED") and one(spark, parse.verdict, "  supported. ") and not one(spark, parse.verdict, None) and not one(spark, parse.verdict, "not supported")
    assert not one(spark, parse.sufficient, "INSUFFICIENT") and one(spark, parse.sufficient, "SUFFICIENT") and not one(spark, parse.sufficient, "maybe")


def test_facts(spark):
    rows = [('x [{"content": "a", "scope": "personal"}] y', 1), ("", 0), ("no list", 0), ("[broken", 0), ('[{"content": " ", "scope": "knowledge"}, {"content": "b", "scope": "odd"}]', 0), ('[{"content": "c", "level": "odd"}]', 1)]
    for raw, n in rows:
        got = one(spark, parse.facts, raw)
        assert len(got) == n and all(f.level == "fact" for f in got)


def test_conflict_outline_action(spark):
    assert tuple(one(spark, parse.conflict, 'so {"conflict": true, "explanation": "two ports"}')) == (True, "two ports")
    assert tuple(one(spark, parse.conflict, "true, they differ")) == (True, "true, they differ") and tuple(one(spark, parse.conflict, None)) == (False, "")
    assert one(spark, lambda c: parse.outline(c, 2), 'x ["a", " ", "b", "c"]') == ["a", "b"] and one(spark, lambda c: parse.outline(c, 2), "none") == []
    assert one(spark, parse.action, 'do {"tool": "search", "n": 2}') == {"tool": "search", "n": "2"} and one(spark, parse.action, "no") is None
    assert one(spark, parse.canonical, '{"b": "x", "a": 1}') == '{"a": 1, "b": "x"}' and one(spark, parse.canonical, None) == "{}"
    assert tuple(one(spark, parse.tool_ref, "mcp__files__read__all")) == ("files", "read__all") and one(spark, parse.tool_ref, "files__read") is None
    assert one(spark, parse.scopes, "a b  a") == ["a", "b"]


def test_outcomes_and_budget(spark):
    c = lambda t: one(spark, lambda x: ops.classify(x, F.lit("900"), F.lit("9000")), t)
    assert [c("it is 900."), c("it is 9000"), c("900 or 9000"), c("none"), c(None)] == ["correct", "wrong", "conflict", "abstain", "abstain"]
    o = spark.createDataFrame([("wrong",), ("correct",), ("conflict",), ("correct",)], "outcome string")
    r = ops.outcome_report(o).first()
    assert (r.n, r.wrong_rate, r.conflict_rate, r.correct_rate) == (4, 0.25, 0.25, 0.5) and ops.outcome_report(o.limit(0)).first().wrong_rate == 0
    over = lambda k, b: spark.range(1).select(ops.over_budget(F.lit(k), F.lit(500), b).alias("x")).first().x
    assert over(20, 1000) and not over(5, 100000) and not over(20, 0)
    rates = ops.refusal_rates(spark.createDataFrame([(True, True), (False, True), (False, False), (True, False)], "expected boolean, predicted boolean")).first()
    assert (rates.refusal_accuracy, rates.over_refusal) == (0.5, 0.5)


def test_memory_decisions(spark):
    d = lambda known, s: tuple(spark.range(1).select(memory.decide(F.lit(known), F.lit(s), F.lit(7)).alias("x")).first().x)
    assert d(False, 0.98) == ("UPDATE", 7) and d(False, 0.7) == ("ADD", None) and d(True, 0.98) == ("NOOP", None) and d(False, None) == ("ADD", None)
    o = lambda ok, t, n: tuple(spark.range(1).select(memory.outcome(F.lit(ok), F.lit(t), F.lit(n)).alias("x")).first().x)
    assert o(True, "draft", 0) == ("promote", "verified") and o(True, "verified", 0) == ("promote", "curated") and o(False, "draft", 1) == ("noop", None) and o(False, "draft", 2) == ("invalidate", None)


def test_claims_and_tools(spark):
    claims = spark.createDataFrame([(1, "t", "必须 do", [9, 2]), (2, "t", "x", []), (3, "t", "x", None)], "claim_id int, topic string, claim string, refs array<int>")
    got = {r.claim_id: (r.content, r.source_ref, r.level) for r in ops.claims_to_facts(claims, spark.createDataFrame([(2, "doc")], "ref int, source string")).collect()}
    assert got == {1: ("t：必须 do", "doc", "playbook"), 2: ("t：x", "research", "fact"), 3: ("t：x", "research", "fact")}
    steps = spark.createDataFrame([(1, 1, "kb"), (1, 2, "error: x"), (1, 3, "web"), (1, 4, "final"), (2, 1, None)], "run_id int, step int, action string")
    want = spark.createDataFrame([(1, ["kb", "web"]), (2, ["kb"])], "run_id int, tools array<string>")
    assert {r.run_id: (r.matches, r.forbidden_calls) for r in ops.tool_sequence(steps, want, ["web"]).collect()} == {1: (True, 1), 2: (False, 0)}
    first, more = (spark.createDataFrame(x, "query_id int, chunk_id int, rank int") for x in ([(1, 5, 1), (1, 6, 2)], [(1, 6, 1), (1, 7, 2)]))
    assert [r.chunk_id for r in ops.reflected(first, more).orderBy("place").collect()] == [5, 6, 7]


def test_chunks_stay_below_the_budget(spark):
    docs = spark.createDataFrame([(1, "a" * 1200 + "\n" + "b" * 1199), (2, None), (3, "  "), (4, " 一二三 "), (5, "一" * 100)], "doc_id bigint, text string")
    got = {(r.doc_id, r.parent_no): r.content for r in ingest.chunk(docs, Config(parent_tokens=600)).where("child_no IS NULL").collect()}
    assert len(got[1, 0]) == 1200 and len(got[1, 1]) == 1199 and got[4, 0] == "一二三" and not any(d in (2, 3) for d, _ in got)
    plain = ingest.chunk_text(docs, 10, 0).where("doc_id = 5").collect()
    assert all(len(r.content) <= 10 for r in plain) and sum(len(r.content) for r in plain) == 100


def test_postings_are_rebuilt_for_changed_rows_only(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "")], "chunk_id bigint, content string")
    index = retrieval.postings(rows)
    new = spark.createDataFrame([(1, "a b"), (2, "d"), (4, "a")], "chunk_id bigint, content string")
    changed = spark.createDataFrame([(2,), (3,), (4,)], "chunk_id bigint")
    assert retrieval.rebuilt(index, rows, (3, 3, 0), (3, 3, 0)) is index
    assert sorted(map(tuple, retrieval.rebuilt(index, new, (3, 3, 0), (3, 4, 1), changed).collect()), key=str) == sorted(map(tuple, retrieval.postings(new).collect()), key=str)
    found = retrieval.bm25(spark.createDataFrame([(-1, "a")], "query_id bigint, content string"), new, 5)
    assert sorted(r.chunk_id for r in found.collect()) == [1, 4]


def test_settled_folders_are_cleared(spark):
    from quernel import session

    df = session.settle(spark.range(3), "some")
    assert df.count() == 3
    path = session._made[-1]
    session.clear(spark)
    import os

    assert not os.path.exists(path)
