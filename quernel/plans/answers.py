"""Queries of answers, claims, writeback and what models say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import parse, text
from quernel.operators import answers as ops
from quernel.operators import evidence, memory
from quernel.plans import evidence as ev
from quernel.plans import memory as mem
from quernel.session import table

BUDGET = 1500


def _passages(spark, sf_dir):
    a = ev.answers(spark, sf_dir).select("answer_id", F.posexplode("sources").alias("pos", "s")).select("answer_id", "pos", F.col("s.id").alias("chunk_id"), F.col("s.source").alias("source"))
    return a.join(table(spark, sf_dir, "chunks").select("chunk_id", "content"), "chunk_id")


def finalize_flags(spark, sf_dir):
    return ops.flags(ev.answers(spark, sf_dir), ev.faithfulness(spark, sf_dir))


def refusal_rates(spark, sf_dir):
    a = ev.answers(spark, sf_dir).where("is_refusal IS NOT NULL")
    return ops.refusal_rates(a.select(F.col("is_refusal").alias("expected"), evidence.refused(F.col("text")).alias("predicted")))


def context_blocks(spark, sf_dir):
    c = ops.context_blocks(_passages(spark, sf_dir))
    return c.select("answer_id", F.length("context").alias("chars"), text.sha(F.col("context")).alias("hash"))


def answer_history(spark, sf_dir):
    """The last four turns of each question's log."""
    a = ev.answers(spark, sf_dir).where("query IS NOT NULL").select(F.col("query").alias("key"), F.col("created_at").alias("at"), "answer_id", "query", "text")
    user = a.select("key", "at", (2 * F.col("answer_id")).alias("id"), F.lit("user").alias("role"), F.col("query").alias("content"))
    said = a.select("key", "at", (2 * F.col("answer_id") + 1).alias("id"), F.lit("assistant").alias("role"), F.col("text").alias("content"))
    return ops.history(user.unionByName(said), 4).select("key", text.sha(F.col("lines")).alias("hash"))


def answer_costs(spark, sf_dir):
    """The estimated tokens of each answer's sources, and whether they are over the budget."""
    c = _passages(spark, sf_dir).groupBy("answer_id").agg(F.count("*").alias("k"), F.sum(F.length("content")).alias("chars"))
    mean = F.floor(F.col("chars") / F.col("k"))
    return c.select("answer_id", "k", ops.estimate_tokens(F.col("k"), mean).alias("tokens"), ops.over_budget(F.col("k"), mean, BUDGET).alias("degrade"))


def _outcomes(spark, sf_dir):
    """Answers against the first number of their first source, the wrong value being the same with a nought."""
    first = _passages(spark, sf_dir).where("pos = 0").select("answer_id", F.regexp_extract(F.coalesce("content", F.lit("")), r"([0-9]+)", 1).alias("correct")).where("correct != ''")
    a = ev.answers(spark, sf_dir).join(first, "answer_id")
    return a.select("answer_id", "query", ops.classify(F.col("text"), F.col("correct"), F.concat("correct", F.lit("0"))).alias("outcome"))


def answer_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("answer_id", "outcome")


def outcome_report(spark, sf_dir):
    worst = _outcomes(spark, sf_dir).groupBy("query").agg(evidence.worst_outcome(F.col("outcome")).alias("outcome"))
    return ops.outcome_report(worst)


def decide_ops(spark, sf_dir):
    """What writing every fiftieth later memory back would do, by its hash and the most similar memory of the first batch in its scope and owner."""
    m = mem.memories(spark, sf_dir)
    old = m.where("batch_no = 0 AND NOT coalesce(is_deleted, FALSE)")
    new = m.where("batch_no > 0 AND memory_id % 50 = 0 AND content IS NOT NULL").withColumn("domain", memory.domain())
    known = old.where("content IS NOT NULL").select(memory.domain().alias("domain"), text.sha(F.col("content")).alias("h")).distinct().withColumn("known", F.lit(True))
    near = memory.search(new.where(text.usable(F.col("embedding"), 64)).withColumnRenamed("memory_id", "query_id"), old.where(text.usable(F.col("embedding"), 64)), 1)
    rows = new.withColumn("h", text.sha(F.col("content"))).join(known, ["domain", "h"], "left").join(near.select(F.col("query_id").alias("memory_id"), "chunk_id", F.col("score")), "memory_id", "left")
    return rows.select("memory_id", memory.decide(F.coalesce("known", F.lit(False)), F.col("score"), F.col("chunk_id")).alias("d")).select("memory_id", "d.op", "d.target")


def writeback_ops(spark, sf_dir):
    """How often each of these comes."""
    return decide_ops(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"))


def outcome_actions(spark, sf_dir):
    """What the use of each memory asks for: its last use counts as a success if it had more of them than failures."""
    ok = F.coalesce(F.col("use_success") > F.col("use_fail"), F.lit(False))
    m = mem.memories(spark, sf_dir).select(F.lower(F.trim("trust")).alias("was"), memory.outcome(ok, F.col("trust"), F.coalesce("use_fail", F.lit(0))).alias("o"))
    return m.groupBy("was", "o.action", F.col("o.trust").alias("trust")).agg(F.count("*").alias("n"))


def memory_facts(spark, sf_dir):
    """The memories of each kind written as a list in JSON and read again as facts, by scope and level."""
    m = mem.memories(spark, sf_dir).select("memory_id", F.to_json(F.array(F.struct("content", "scope", "kind", "level"))).alias("raw"))
    f = m.select("memory_id", F.explode(parse.facts(F.concat(F.lit("facts: "), "raw"))).alias("f"))
    return f.select("memory_id", "f.scope", "f.level", text.sha(F.col("f.content")).alias("hash"))


def snippet_outline(spark, sf_dir):
    g = table(spark, sf_dir, "golden").select("question_id", F.to_json("gold_snippets").alias("raw"))
    return g.select("question_id", F.size(parse.outline(F.col("raw"), 2)).alias("titles"))


def event_arguments(spark, sf_dir):
    """How often each tool comes with the same arguments, by their hash."""
    e = table(spark, sf_dir, "events").select("event_type", parse.args_hash(F.col("props")).alias("args"))
    return e.groupBy("event_type", "args").agg(F.count("*").alias("n"))


def verdicts(spark, sf_dir):
    """What judges would be taken to say, were the quality of ratings their words."""
    said = F.when(F.col("quality") >= 3, " supported. ").when(F.col("quality") == 2, "NOT SUPPORTED").when(F.col("quality") == 1, "unsure")
    v = table(spark, sf_dir, "labels").select(F.col("quality"), parse.verdict(said).alias("supported"))
    return v.groupBy("quality", "supported").agg(F.count("*").alias("n"))


def published_days(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select("published") for t in ("extracted", "search_results")]
    return parts[0].unionByName(parts[1]).groupBy(parse.published(F.col("published")).cast("string").alias("day")).agg(F.count("*").alias("n"))


def tagged_memories(spark, sf_dir):
    """Memories of one scope and level with two tags; an owner isn't asked for."""
    m = ops.where_given(mem.memories(spark, sf_dir), scope="personal", level="fact", owner_user_id=None)
    return m.where(ops.tagged(F.col("tags"), {"type": "crew", "season": "q3"})).select("memory_id")


def claim_sources(spark, sf_dir):
    """Answers as claims about their questions, and the first source that is known among the documents."""
    a = ev.answers(spark, sf_dir).where("query IS NOT NULL AND text IS NOT NULL AND sources IS NOT NULL").select(F.col("answer_id").alias("claim_id"), F.col("query").alias("topic"), F.col("text").alias("claim"), F.col("sources.id").alias("refs"))
    known = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("ref"), "source").where("source IS NOT NULL")
    return ops.claims_to_facts(a, known).select("claim_id", text.sha(F.col("content")).alias("hash"), "source_ref", "level")


def claim_trusts(spark, sf_dir):
    """The trust of a question's claims from that of the memories that name the same source."""
    s = ev.answers(spark, sf_dir).select("answer_id", F.explode("sources.source").alias("source_ref")).where("source_ref IS NOT NULL").distinct()
    t = mem.memories(spark, sf_dir).where("source_ref IS NOT NULL").groupBy("source_ref").agg(F.max(text.trust_rank(F.col("trust"))).alias("rank"))
    name = F.when(F.col("rank") == 3, "curated").when(F.col("rank") == 2, "verified").otherwise("draft")
    return s.join(t, "source_ref", "left").groupBy("answer_id").agg(F.collect_list(name).alias("trusts")).select("answer_id", ops.claim_trust(F.col("trusts")).alias("trust"))


def known_sources(spark, sf_dir):
    """The sources of answers that are active children, each once."""
    s = ev.answers(spark, sf_dir).select("answer_id", F.explode("sources.id").alias("chunk_id")).distinct()
    return s.join(ev.base.live(spark, sf_dir).select("chunk_id"), "chunk_id", "left_semi").groupBy("answer_id").agg(F.count("*").alias("known"))


def tool_sequences(spark, sf_dir):
    """Each user's events against the tools that were expected, the first three kinds in order; errors call no tool, purchases are forbidden."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), F.when(F.col("event_type") == "error", F.concat(F.lit("error:"), "props")).otherwise(F.col("event_type")).alias("action"))
    e = e.where("step <= 3")
    return ops.tool_sequence(e, e.select("run_id").distinct().withColumn("tools", F.array(F.lit("view"), F.lit("click"), F.lit("view"))), ["purchase"])


def token_usage(spark, sf_dir):
    """Tokens of the chunks of each source, by what was counted or estimated."""
    c = table(spark, sf_dir, "chunks")
    return c.groupBy("source").agg(F.sum(F.coalesce(F.col("token_count").cast("bigint"), text.approx_tokens(F.col("content")).cast("bigint"))).alias("tokens"), F.count_if(F.col("token_count").isNull()).alias("estimated"))


QUERIES = {
    f.__name__: f
    for f in (
        finalize_flags, refusal_rates, context_blocks, answer_history, answer_costs, answer_outcomes, outcome_report, decide_ops, writeback_ops, outcome_actions, memory_facts, snippet_outline, event_arguments, verdicts, published_days,
        tagged_memories, claim_sources, claim_trusts, known_sources, tool_sequences, token_usage,
    )
}

_A, _RANK, _DOMAIN = ev._A, mem._RANK, mem._DOMAIN
_P = "p AS (SELECT answer_id, pos, x.source AS source, content FROM (SELECT answer_id, unnest(sources) AS x, generate_subscripts(sources, 1) AS pos FROM a) JOIN chunks c ON c.chunk_id = x.id)"
_REFUSED = "(coalesce(text, '') = '' OR starts_with(text, '根据现有资料无法回答') OR trim(text, ' ') = '根据现有资料无法回答')"
_OUT = f"{_A}, {_P}, n AS (SELECT answer_id, query, list_contains(regexp_extract_all(coalesce(text, ''), '[0-9]+'), v) AS c, list_contains(regexp_extract_all(coalesce(text, ''), '[0-9]+'), v || '0') AS w FROM a JOIN (SELECT answer_id, regexp_extract(coalesce(content, ''), '([0-9]+)', 1) AS v FROM p WHERE pos = 1) USING (answer_id) WHERE v <> ''), o AS (SELECT answer_id, query, CASE WHEN c AND w THEN 'conflict' WHEN w THEN 'wrong' WHEN c THEN 'correct' ELSE 'abstain' END AS outcome FROM n)"
_DECIDE = f"WITH old AS (SELECT *, {_DOMAIN} AS d FROM memories WHERE batch_no = 0 AND NOT coalesce(is_deleted, FALSE)), new AS (SELECT *, {_DOMAIN} AS d FROM memories WHERE batch_no > 0 AND memory_id % 50 = 0 AND content IS NOT NULL), u AS (SELECT memory_id, d, embedding::DOUBLE[] AS v FROM old WHERE {mem._USABLE}), s AS (SELECT n.memory_id, b.memory_id AS other, {mem._COS.replace('a.v', 'n.v')} AS score FROM (SELECT memory_id, d, embedding::DOUBLE[] AS v FROM new WHERE {mem._USABLE}) n JOIN u b ON n.d = b.d AND n.memory_id <> b.memory_id), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, other) = 1), k AS (SELECT new.memory_id, EXISTS (SELECT 1 FROM old WHERE old.d = new.d AND old.content = new.content) AS known FROM new) SELECT memory_id, CASE WHEN known THEN 'NOOP' WHEN coalesce(score, 0) >= 0.92 THEN 'UPDATE' ELSE 'ADD' END AS op, CASE WHEN NOT known AND score >= 0.92 THEN other END AS target FROM k LEFT JOIN t USING (memory_id)"

SQL = {
    "finalize_flags": f"WITH f AS ({ev.SQL['faithfulness']}), c AS ({ev.SQL['citations']}) SELECT answer_id, invalid, hash, faithfulness, grounded, refusal, low_confidence, CASE WHEN refusal THEN 'refusal' WHEN low_confidence THEN 'low_confidence' WHEN grounded THEN 'grounded' ELSE 'none' END AS quality FROM c JOIN f USING (answer_id)",
    "refusal_rates": f"WITH {_A} SELECT count(*) AS n, round(avg((is_refusal = {_REFUSED})::INT), 4) AS refusal_accuracy, round(coalesce(avg({_REFUSED}::INT) FILTER (NOT is_refusal), 0), 4) AS over_refusal FROM a WHERE is_refusal IS NOT NULL",
    "context_blocks": f"WITH {_A}, {_P}, b AS (SELECT answer_id, pos, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS i, source, {ev._sanitized('content')} AS content FROM p), c AS (SELECT answer_id, string_agg('[' || i || '] (来源: ' || coalesce(source, '') || ')' || chr(10) || coalesce(content, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context FROM b GROUP BY 1) SELECT answer_id, length(context) AS chars, sha256(context) AS hash FROM c",
    "answer_history": f"WITH {_A}, t AS (SELECT query AS key, created_at AS t0, 2 * answer_id AS id, '用户' AS who, query AS content FROM a WHERE query IS NOT NULL UNION ALL SELECT query, created_at, 2 * answer_id + 1, '助手', text FROM a WHERE query IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t0 DESC, id DESC) AS n FROM t) SELECT key, sha256(string_agg(who || ': ' || trim(coalesce(content, ''), ' '), chr(10) ORDER BY n DESC)) AS hash FROM l WHERE n <= 4 GROUP BY key",
    "answer_costs": f"WITH {_A}, {_P}, c AS (SELECT answer_id, count(*) AS k, floor(sum(length(content)) / count(*)) AS mean FROM p GROUP BY 1) SELECT answer_id, k, floor(900 + k * (mean / 1.2))::BIGINT AS tokens, floor(900 + k * (mean / 1.2)) > {BUDGET} AS degrade FROM c",
    "answer_outcomes": f"WITH {_OUT} SELECT answer_id, outcome FROM o",
    "outcome_report": f"WITH {_OUT}, q AS (SELECT query, CASE WHEN bool_or(outcome = 'wrong') THEN 'wrong' WHEN bool_or(outcome = 'conflict') THEN 'conflict' WHEN bool_or(outcome = 'correct') THEN 'correct' ELSE 'abstain' END AS r FROM o GROUP BY 1) SELECT count(*) AS n, {', '.join(f'''count(*) FILTER (r = '{k}') AS {k}, round(coalesce(avg((r = '{k}')::INT), 0), 6) AS {k}_rate''' for k in ('correct', 'wrong', 'conflict', 'abstain'))} FROM q",
    "decide_ops": _DECIDE,
    "writeback_ops": f"SELECT op, count(*) AS n FROM ({_DECIDE}) GROUP BY 1",
    "outcome_actions": "WITH m AS (SELECT lower(trim(trust, ' ')) AS was, coalesce(use_success > use_fail, FALSE) AS ok, coalesce(use_fail, 0) AS f FROM memories) SELECT was, CASE WHEN ok THEN 'promote' WHEN f >= 2 THEN 'invalidate' ELSE 'noop' END AS action, CASE WHEN ok THEN CASE WHEN was = 'draft' THEN 'verified' ELSE 'curated' END END AS trust, count(*) AS n FROM m GROUP BY ALL",
    "memory_facts": "SELECT memory_id, lower(trim(coalesce(scope, 'knowledge'), ' ')) AS scope, CASE WHEN lower(trim(level, ' ')) = 'playbook' THEN 'playbook' ELSE 'fact' END AS level, sha256(trim(content, ' ')) AS hash FROM memories WHERE trim(coalesce(content, ''), ' ') <> '' AND lower(trim(coalesce(scope, 'knowledge'), ' ')) IN ('personal', 'knowledge')",
    "snippet_outline": "SELECT question_id, least(2, len(list_filter(coalesce(gold_snippets, []), lambda x: trim(coalesce(x, ''), ' ') <> '')))::INT AS titles FROM golden",
    "event_arguments": "SELECT event_type, substr(sha256('{\"k\": ' || json_extract_string(props, '$.k') || '}'), 1, 16) AS args, count(*) AS n FROM events GROUP BY ALL",
    "verdicts": "SELECT quality, coalesce(quality >= 3, FALSE) AS supported, count(*) AS n FROM labels GROUP BY ALL",
    "published_days": "WITH p AS (SELECT trim(published, ' ') AS t FROM extracted UNION ALL SELECT trim(published, ' ') FROM search_results) SELECT coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(left(t, 10), '%Y/%m/%d'), try_strptime(t, '%d.%m.%Y'), try_strptime(t, '%b %d, %Y'))::DATE::VARCHAR AS day, count(*) AS n FROM p GROUP BY 1",
    "tagged_memories": "SELECT memory_id FROM memories WHERE scope = 'personal' AND level = 'fact' AND json_extract_string(tags, '$.type') = 'crew' AND json_extract_string(tags, '$.season') = 'q3'",
    "claim_sources": f"WITH {_A}, c AS (SELECT answer_id, query || '：' || text AS content, text, sources FROM a WHERE query IS NOT NULL AND text IS NOT NULL AND sources IS NOT NULL), r AS (SELECT answer_id, arg_min(k.source, pos) AS source FROM (SELECT answer_id, unnest(sources).id AS id, generate_subscripts(sources, 1) AS pos FROM c) JOIN chunks k ON k.chunk_id = id WHERE k.source IS NOT NULL GROUP BY 1) SELECT answer_id AS claim_id, sha256(content) AS hash, coalesce(source, 'research') AS source_ref, CASE WHEN regexp_matches(text, '原则|建议|风险|预案|打法|经验|教训|必做|必须|应当') THEN 'playbook' ELSE 'fact' END AS level FROM c LEFT JOIN r USING (answer_id)",
    "claim_trusts": f"WITH {_A}, s AS (SELECT DISTINCT answer_id, unnest(sources).source AS source_ref FROM a), t AS (SELECT source_ref, max({_RANK}) AS r FROM memories WHERE source_ref IS NOT NULL GROUP BY 1) SELECT answer_id, CASE WHEN bool_and(coalesce(r, 0) >= 2) THEN 'verified' ELSE 'draft' END AS trust FROM s LEFT JOIN t USING (source_ref) WHERE source_ref IS NOT NULL GROUP BY 1",
    "known_sources": f"WITH {_A}, live AS ({ev.base._LIVE}), s AS (SELECT DISTINCT answer_id, unnest(sources).id AS chunk_id FROM a) SELECT answer_id, count(*) AS known FROM s JOIN live USING (chunk_id) GROUP BY 1",
    "tool_sequences": "WITH e AS (SELECT user_id AS run_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT run_id, coalesce(list(event_type ORDER BY step) FILTER (event_type <> 'error'), []) = ['view', 'click', 'view'] AS matches, count(*) FILTER (event_type = 'purchase') AS forbidden_calls FROM e WHERE step <= 3 GROUP BY 1",
    "token_usage": "SELECT source, sum(coalesce(token_count, CASE WHEN content = '' THEN 0 ELSE floor(h + 0.25 * (length(content) - h)) + 1 END))::BIGINT AS tokens, count(*) FILTER (token_count IS NULL) AS estimated FROM (SELECT *, length(content) - length(regexp_replace(content, '[\\x{4E00}-\\x{9FFF}]', '', 'g')) AS h FROM chunks) GROUP BY 1",
}
