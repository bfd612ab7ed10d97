"""Queries of evidence, web results, references and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import evidence, retrieval
from quernel.plans import retrieval as base
from quernel.session import table


def answers(spark, sf_dir):
    """Logged answers, those delivered twice once."""
    return table(spark, sf_dir, "answers").dropDuplicates(["answer_id"])


def citations(spark, sf_dir):
    c = evidence.cited(answers(spark, sf_dir))
    return c.select("answer_id", F.size("cites").alias("cites"), F.size("valid").alias("valid"), F.concat_ws(",", "invalid").alias("invalid"), text.sha(F.col("stripped")).alias("hash"))


def sentence_counts(spark, sf_dir):
    return answers(spark, sf_dir).select("answer_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


def contexts(spark, sf_dir):
    used = answers(spark, sf_dir).select("answer_id", F.explode("sources.id").alias("chunk_id"))
    return used.join(table(spark, sf_dir, "chunks").select("chunk_id", F.col("content").alias("context")), "chunk_id")


def faithfulness(spark, sf_dir):
    a = answers(spark, sf_dir)
    return evidence.faithfulness(a, evidence.judged(a.where(~evidence.refused(F.col("text"))), contexts(spark, sf_dir)))


def generation_metrics(spark, sf_dir):
    a = answers(spark, sf_dir)
    mean = F.round(F.avg("faithfulness"), 4)
    out = a.agg(F.count("*").alias("n"), mean.alias("faithfulness"), F.count_if("is_refusal").alias("refusals"), F.count_if("low_confidence").alias("low"), F.avg(F.col("grounded").cast("int")).alias("g"))
    return out.select("n", "faithfulness", F.round(1 - F.col("faithfulness"), 4).alias("hallucination"), "refusals", "low", F.round("g", 6).alias("grounded"))


def answer_sources(spark, sf_dir):
    """How often each source is cited."""
    s = answers(spark, sf_dir).select("answer_id", F.explode("sources").alias("s")).select("answer_id", F.col("s.source").alias("source"), F.col("s.score").alias("score"))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("answer_id").alias("answers"), F.sum(F.round(F.col("score") * 10000).cast("bigint")).alias("score_e4"))


def injection_scan(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(c).alias("t")) for t, c in (("documents", "text"), ("search_results", "snippet"), ("extracted", "text"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("tbl").agg(F.count("*").alias("n"), F.count_if(text.injected(F.col("t"))).alias("flagged"), F.count_if(text.injected(text.sanitize(F.col("t")))).alias("after"))


def safe_urls(spark, sf_dir):
    u = table(spark, sf_dir, "search_results").select("url").unionByName(table(spark, sf_dir, "extracted").select("url"))
    return u.groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(text.safe_url(F.col("url"))).alias("safe"))


def web_evidence(spark, sf_dir):
    return evidence.web_evidence(table(spark, sf_dir, "search_results"))


def reference_ids(spark, sf_dir):
    """The sources of all answers to one question, numbered by first appearance."""
    s = answers(spark, sf_dir).select("query", "answer_id", F.posexplode("sources").alias("pos", "s")).select("query", "answer_id", "pos", F.col("s.source").alias("source")).where("source IS NOT NULL")
    return evidence.references(s, "query", ["answer_id", "pos"]).select("answer_id", "pos", "source", "ref")


def evidence_merge(spark, sf_dir):
    """Passages that answers and search results give for one question, each text once, answers first."""
    kb = answers(spark, sf_dir).select("query", F.explode("sources").alias("s")).select("query", F.col("s.id").alias("chunk_id")).distinct()
    kb = kb.join(table(spark, sf_dir, "chunks"), "chunk_id").select("query", F.lit("kb").alias("source_type"), F.trim("content").alias("content"), F.col("chunk_id").alias("id"))
    web = evidence.web_evidence(table(spark, sf_dir, "search_results")).join(table(spark, sf_dir, "search_results").select("result_id", "query").distinct(), "result_id")
    web = web.select("query", F.lit("web").alias("source_type"), F.trim("content").alias("content"), F.col("result_id").alias("id"))
    both = kb.unionByName(web)
    first = both.groupBy("query", "content").agg(F.min(F.struct("source_type", "id")).alias("f"))
    return first.groupBy("query").agg(F.count_if(F.col("f.source_type") == "kb").alias("kb"), F.count_if(F.col("f.source_type") == "web").alias("web"))


def _relevant(spark, sf_dir):
    return base.golden_queries(spark, sf_dir).where("gold_source IS NOT NULL").select("query_id", F.col("gold_source").alias("item"))


def _by_source(found):
    """Chunk ranks folded to the first appearance of each source."""
    first = found.groupBy("query_id", "source").agg(F.min("rank").alias("r"))
    from pyspark.sql import Window

    return first.select("query_id", F.col("source").alias("item"), F.row_number().over(Window.partitionBy("query_id").orderBy("r")).alias("rank"))


def ir_metrics(spark, sf_dir):
    rows = base.live(spark, sf_dir)
    found = retrieval.bm25(base.golden_queries(spark, sf_dir), rows, 30).join(rows.select("chunk_id", "source"), "chunk_id")
    return evidence.ir_metrics(_by_source(found), _relevant(spark, sf_dir), 10).withColumnRenamed("query_id", "golden_id")


def ir_summary(spark, sf_dir):
    m = ir_metrics(spark, sf_dir)
    return m.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")), F.round(F.coalesce(F.stddev_samp("recall"), F.lit(0.0)), 6).alias("recall_std"))


def bootstrap_ci(spark, sf_dir):
    m = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("i")).agg(F.avg("quality").alias("v"))
    return evidence.bootstrap(m)


def outcome_repeats(spark, sf_dir):
    """Answers to one question as repeated attempts."""
    a = answers(spark, sf_dir)
    o = F.when(F.col("is_refusal"), "abstain").when(F.col("hallucination_rate") > 0.5, "wrong").when(F.col("low_confidence"), "conflict").otherwise("correct")
    each = a.select("query", o.alias("o")).groupBy("query").agg(evidence.worst_outcome(F.col("o")).alias("outcome"), F.count("*").alias("attempts"))
    return each.groupBy("outcome").agg(F.count("*").alias("questions"), F.sum("attempts").alias("attempts"))


def pass_pow_k(spark, sf_dir):
    a = answers(spark, sf_dir).groupBy("query").agg(F.bool_and(F.coalesce("grounded", F.lit(False))).alias("passed"))
    return a.agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_k"))


QUERIES = {
    f.__name__: f
    for f in (
        citations, sentence_counts, faithfulness, generation_metrics, answer_sources, injection_scan, safe_urls, web_evidence, reference_ids, evidence_merge, ir_metrics, ir_summary, bootstrap_ci, outcome_repeats, pass_pow_k,
    )
}

_A = "a AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY answer_id) = 1)"
_TOK = base.tokens_sql
_S = "list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\[\\d+\\]', '', 'g'), '[。！？!?；;\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 2)"
_PLACE = "lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''))"
_HOST = f"CASE WHEN {_PLACE} LIKE '[%' THEN regexp_extract({_PLACE}, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract({_PLACE}, '^([^:]*)', 1) END"
_OCTETS = f"list_transform(string_split({_HOST}, '.'), lambda x: TRY_CAST(x AS INT))"
_LITERAL = f"(regexp_matches({_HOST}, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AND NOT regexp_matches({_HOST}, '(^|\\.)0[0-9]') AND len(list_filter({_OCTETS}, lambda x: x IS NULL OR x > 255)) = 0)"
_O1, _O2, _O3 = (f"{_OCTETS}[{i}]" for i in (1, 2, 3))
_CLOSED4 = f"({_O1} IN (0, 10, 127) OR {_O1} >= 224 OR ({_O1} = 169 AND {_O2} = 254) OR ({_O1} = 172 AND {_O2} BETWEEN 16 AND 31) OR ({_O1} = 192 AND {_O2} = 168) OR ({_O1} = 192 AND {_O2} = 0 AND {_O3} IN (0, 2)) OR ({_O1} = 198 AND {_O2} IN (18, 19)) OR ({_O1} = 198 AND {_O2} = 51 AND {_O3} = 100) OR ({_O1} = 203 AND {_O2} = 0 AND {_O3} = 113))"
_SAFE = f"(coalesce(regexp_matches(url, '(?i)^https?://'), FALSE) AND ({_HOST}) NOT IN ('', 'localhost', 'metadata', 'instance', 'metadata.google.internal') AND NOT ({_LITERAL} AND {_CLOSED4}) AND (NOT contains({_HOST}, ':') OR regexp_matches({_HOST}, '^[23][0-9a-f]{{3}}:')))"
#: The patterns in the dialect of the SQL, written out anew.
_PATTERNS = ["(?i)ignore\\s+(all\\s+)?(previous|above|prior)\\s+instructions", "(?i)忽略(以上|上述|之前)(的)?(所有)?指令", "(?i)disregard\\s+the\\s+system\\s+prompt", "(?i)new\\s+instructions\\s*:", "(?i)\\bsystem\\s+prompt\\b", "(?im)^\\s*(system|assistant)\\s*:", "<\\|.*?\\|>", "(?i)</?s>"]


def _sanitized(t: str) -> str:
    for p in _PATTERNS:
        t = f"regexp_replace({t}, '{p}', '[filtered]', 'g')"
    return t


def _injected(t: str) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({t}, '{p}'), FALSE)" for p in _PATTERNS) + ")"


_CLEAN = "left(trim(regexp_replace(snippet, '\\s+', ' ', 'g'), ' '), 4000)"
_WEB = f"web AS (SELECT result_id, url, {_sanitized(_CLEAN)} AS content, 'draft' AS trust FROM (SELECT * FROM search_results WHERE {_SAFE} AND trim(coalesce(snippet, ''), ' ') <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY result_id) = 1))"
_IR = f"""WITH live AS ({base._LIVE}), {base._bm25(base._GOLD).replace('rank <= 20', 'rank <= 30')},
f AS (SELECT query_id, source AS item, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM lex JOIN live USING (chunk_id) GROUP BY query_id, source),
rel AS (SELECT DISTINCT -question_id AS query_id, gold_source AS item FROM golden WHERE question_id IS NOT NULL AND gold_source IS NOT NULL),
tot AS (SELECT query_id, count(*) AS total FROM rel GROUP BY 1),
per AS (SELECT query_id, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM f JOIN rel USING (query_id, item) GROUP BY 1)
SELECT query_id AS golden_id, round(coalesce(hits, 0) / total, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM tot LEFT JOIN per USING (query_id)"""

#: Chances that a Poisson variable of mean 1 is at most 0, 1, ….
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
SQL = {
    "citations": f"WITH {_A}, c AS (SELECT answer_id, text, len(coalesce(sources, [])) AS n, list_transform(regexp_extract_all(coalesce(text, ''), '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT) AS cites FROM a), i AS (SELECT *, list_sort(list_distinct(list_filter(cites, lambda x: x < 1 OR x > n))) AS bad FROM c) SELECT answer_id, len(cites) AS cites, len(list_filter(cites, lambda x: x >= 1 AND x <= n)) AS valid, array_to_string(bad, ',') AS invalid, sha256(CASE WHEN len(bad) = 0 THEN coalesce(text, '') ELSE regexp_replace(text, '\\[(' || array_to_string(bad, '|') || ')\\]', '', 'g') END) AS hash FROM i",
    "sentence_counts": f"WITH {_A} SELECT answer_id, len({_S}) AS sentences FROM a",
    "faithfulness": f"WITH {_A}, k AS (SELECT *, coalesce(text, '') = '' OR starts_with(text, '根据现有资料无法回答') OR trim(text, ' ') = '根据现有资料无法回答' AS refusal FROM a), s AS (SELECT answer_id, unnest({_S}) AS s, generate_subscripts({_S}, 1) AS no FROM k WHERE NOT refusal), t AS (SELECT answer_id, no, list_distinct({_TOK('s')}) AS terms FROM s), ctx AS (SELECT answer_id, list_distinct({_TOK('content')}) AS have FROM (SELECT answer_id, unnest(sources).id AS chunk_id FROM a) JOIN chunks USING (chunk_id)), v AS (SELECT answer_id, no, coalesce(max(len(list_intersect(terms, have)) / greatest(len(terms), 1)), 0) >= 0.5 AS ok FROM t LEFT JOIN ctx USING (answer_id) GROUP BY ALL), c AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (ok) AS supported FROM v GROUP BY 1), r AS (SELECT k.answer_id, refusal, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, CASE WHEN coalesce(claims, 0) > 0 THEN supported / claims ELSE 0.0 END AS f FROM k LEFT JOIN c USING (answer_id)) SELECT answer_id, claims, supported, CASE WHEN NOT refusal THEN round(f, 4) END AS faithfulness, CASE WHEN NOT refusal THEN round(1 - f, 4) END AS hallucination, NOT refusal AND f >= 0.6 AS grounded, refusal, NOT refusal AND f < 0.6 AS low_confidence FROM r",
    "generation_metrics": f"WITH {_A} SELECT count(*) AS n, round(avg(faithfulness), 4) AS faithfulness, round(1 - round(avg(faithfulness), 4), 4) AS hallucination, count(*) FILTER (is_refusal) AS refusals, count(*) FILTER (low_confidence) AS low, round(avg(grounded::INT), 6) AS grounded FROM a",
    "answer_sources": f"WITH {_A}, s AS (SELECT answer_id, unnest(sources) AS s FROM a) SELECT s.source AS source, count(*) AS n, count(DISTINCT answer_id) AS answers, sum(round(s.score * 10000)::BIGINT)::BIGINT AS score_e4 FROM s GROUP BY 1",
    "injection_scan": f"SELECT tbl, count(*) AS n, count(*) FILTER ({_injected('t')}) AS flagged, count(*) FILTER ({_injected(_sanitized('t'))}) AS after FROM (SELECT 'documents' AS tbl, text AS t FROM documents UNION ALL SELECT 'search_results', snippet FROM search_results UNION ALL SELECT 'extracted', text FROM extracted) GROUP BY 1",
    "safe_urls": f"SELECT {_HOST} AS host, count(*) AS n, count(*) FILTER ({_SAFE}) AS safe FROM (SELECT url FROM search_results UNION ALL SELECT url FROM extracted) GROUP BY 1",
    "web_evidence": f"WITH {_WEB} SELECT * FROM web",
    "reference_ids": f"WITH {_A}, s AS (SELECT query, answer_id, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS pos FROM a), t AS (SELECT query, answer_id, pos::INT AS pos, s.source AS source FROM s WHERE s.source IS NOT NULL), f AS (SELECT query, source, min((answer_id, pos)) AS f FROM t GROUP BY ALL), n AS (SELECT query, source, row_number() OVER (PARTITION BY query ORDER BY f) AS ref FROM f) SELECT answer_id, pos, source, ref FROM t JOIN n USING (query, source)",
    "evidence_merge": f"WITH {_A}, {_WEB}, kb AS (SELECT DISTINCT query, unnest(sources).id AS chunk_id FROM a), b AS (SELECT query, 'kb' AS st, trim(content, ' ') AS content FROM kb JOIN chunks USING (chunk_id) UNION ALL SELECT query, 'web', trim(content, ' ') FROM web JOIN (SELECT DISTINCT result_id, query FROM search_results) USING (result_id)), f AS (SELECT query, content, min(st) AS st FROM b GROUP BY ALL) SELECT query, count(*) FILTER (st = 'kb') AS kb, count(*) FILTER (st = 'web') AS web FROM f GROUP BY 1",
    "ir_metrics": _IR,
    "ir_summary": f"SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(coalesce(stddev_samp(recall), 0), 6) AS recall_std FROM ({_IR})",
    "bootstrap_ci": f"WITH v AS (SELECT doc_id AS i, avg(quality) AS v FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1), d AS (SELECT b, v, len(list_filter({_POISSON}::DOUBLE[], lambda p: ('0x' || substr(md5('42-' || b || '-' || i), 1, 8))::BIGINT / 4294967296.0 >= p)) AS times FROM v, range(1000) t(b)), m AS (SELECT b, sum(v * times) / nullif(sum(times), 0) AS m FROM d GROUP BY 1), r AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS place FROM m WHERE m IS NOT NULL) SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(max(m) FILTER (place <= 25), 6) AS low, round(max(m) FILTER (place <= 974), 6) AS high FROM r",
    "outcome_repeats": f"WITH {_A}, o AS (SELECT query, CASE WHEN is_refusal THEN 4 WHEN hallucination_rate > 0.5 THEN 1 WHEN low_confidence THEN 2 ELSE 3 END AS o FROM a), g AS (SELECT query, min(o) AS o, count(*) AS n FROM o GROUP BY 1) SELECT ['wrong', 'conflict', 'correct', 'abstain'][o] AS outcome, count(*) AS questions, sum(n)::BIGINT AS attempts FROM g GROUP BY 1",
    "pass_pow_k": f"WITH {_A}, g AS (SELECT query, bool_and(coalesce(grounded, FALSE)) AS p FROM a GROUP BY 1) SELECT count(*) AS n, round(avg(p::INT), 6) AS pass_k FROM g",
}
