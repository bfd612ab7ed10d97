"""Queries of the memory table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import memory, retrieval
from quernel.session import table

#: The moment for which validity is asked.
NOW = "2026-03-01 00:00:00"


def memories(spark, sf_dir):
    return table(spark, sf_dir, "memories")


def memory_active(spark, sf_dir):
    return memory.active(memories(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), "verified").select("memory_id", "scope", text.trust_rank(F.col("trust")).alias("trust"))


def memory_counts(spark, sf_dir):
    m = memories(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp_ntz")
    return m.groupBy("scope", F.lower(F.trim("trust")).alias("trust")).agg(F.count("*").alias("n"), F.count_if("is_deleted").alias("deleted"), F.count_if(memory.valid(now)).alias("valid"), F.countDistinct("owner_user_id").alias("owners"))


def memory_hash_state(spark, sf_dir):
    m = memories(spark, sf_dir).where("content IS NOT NULL")
    h = F.lower(F.trim(F.coalesce("content_hash", F.lit(""))))
    return m.groupBy(F.when(h == "", "missing").when(h == text.short_hash(F.col("content")), "right").otherwise("stale").alias("state")).agg(F.count("*").alias("n"))


def memory_add(spark, sf_dir):
    """What the later batches add to the first one."""
    m = memories(spark, sf_dir)
    facts = m.where("batch_no > 0").withColumn("fact_id", F.col("memory_id"))
    return memory.add(m.where("batch_no = 0"), facts).select("fact_id", "domain")


def memory_search(spark, sf_dir):
    """Every fiftieth memory as a query over the active, verified memories of its scope and owner."""
    m = memory.active(memories(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), "verified").where(text.usable(F.col("embedding"), 64))
    q = memories(spark, sf_dir).where(text.usable(F.col("embedding"), 64) & (F.col("memory_id") % 50 == 0))
    found = memory.search(q.withColumnRenamed("memory_id", "query_id"), m, 5)
    return found.withColumnRenamed("chunk_id", "memory_id")


def memory_similar(spark, sf_dir):
    return memory.similar(memories(spark, sf_dir))


def memory_promoted(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.groupBy(F.lower(F.trim("trust")).alias("was"), memory.promote(F.col("trust"), F.col("support")).alias("trust")).agg(F.count("*").alias("n"))


def memory_feedback(spark, sf_dir):
    """Outcomes of answers as feedback on the sources they used."""
    a = table(spark, sf_dir, "answers").dropDuplicates(["answer_id"]).select("answer_id", "created_at", F.coalesce("grounded", F.lit(False)).alias("ok"), F.explode("sources").alias("s"))
    e = a.select(F.col("s.source").alias("key"), "ok", F.col("created_at").alias("at"), F.col("answer_id").alias("seq")).where("key IS NOT NULL").distinct()
    return memory.feedback(e)


def playbook(spark, sf_dir):
    """Of each owner the ids by level, in order."""
    m = memories(spark, sf_dir).where(~F.coalesce("is_deleted", F.lit(False)) & F.col("owner_user_id").isNotNull())
    ids = lambda level: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("memory_id")))), lambda x: x.cast("string")))
    return m.groupBy("owner_user_id").agg(ids("fact").alias("facts"), ids("playbook").alias("playbooks"))


def memory_latest(spark, sf_dir):
    """The newest three memories of each owner."""
    w = Window.partitionBy("owner_user_id").orderBy(F.desc("updated_at"), F.desc("memory_id"))
    m = memories(spark, sf_dir).where("owner_user_id IS NOT NULL")
    return m.select("owner_user_id", "memory_id", F.row_number().over(w).alias("n")).where("n <= 3")


QUERIES = {f.__name__: f for f in (memory_active, memory_counts, memory_hash_state, memory_add, memory_search, memory_similar, memory_promoted, memory_feedback, playbook, memory_latest)}

_RANK = "CASE lower(trim(trust, ' ')) WHEN 'draft' THEN 1 WHEN 'verified' THEN 2 WHEN 'curated' THEN 3 ELSE 0 END"
_VALID = f"((valid_at IS NULL OR valid_at <= TIMESTAMP '{NOW}') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{NOW}'))"
_DOMAIN = "concat_ws('|', scope, coalesce('u:' || owner_user_id, '-'))"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COS = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"

SQL = {
    "memory_active": f"SELECT memory_id, scope, {_RANK} AS trust FROM memories WHERE NOT coalesce(is_deleted, FALSE) AND {_VALID} AND {_RANK} >= 2",
    "memory_counts": f"SELECT scope, lower(trim(trust, ' ')) AS trust, count(*) AS n, count(*) FILTER (is_deleted) AS deleted, count(*) FILTER ({_VALID}) AS valid, count(DISTINCT owner_user_id) AS owners FROM memories GROUP BY 1, 2",
    "memory_hash_state": "SELECT CASE WHEN h = '' THEN 'missing' WHEN h = substr(sha256(content), 1, 32) THEN 'right' ELSE 'stale' END AS state, count(*) AS n FROM (SELECT content, lower(trim(coalesce(content_hash, ''), ' ')) AS h FROM memories WHERE content IS NOT NULL) GROUP BY 1",
    "memory_add": f"WITH k AS (SELECT {_DOMAIN} AS d, sha256(content) AS h FROM memories WHERE batch_no = 0 AND NOT coalesce(is_deleted, FALSE)), f AS (SELECT memory_id AS fact_id, {_DOMAIN} AS d, sha256(content) AS h FROM memories WHERE batch_no > 0 AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_DOMAIN}, sha256(content) ORDER BY memory_id) = 1) SELECT fact_id, d AS domain FROM f WHERE (d, h) NOT IN (SELECT (d, h) FROM k WHERE h IS NOT NULL)",
    "memory_search": f"WITH q AS (SELECT memory_id, {_DOMAIN} AS d, embedding::DOUBLE[] AS v FROM memories WHERE {_USABLE} AND memory_id % 50 = 0), r AS (SELECT memory_id, {_DOMAIN} AS d, embedding::DOUBLE[] AS v FROM memories WHERE {_USABLE} AND NOT coalesce(is_deleted, FALSE) AND {_VALID} AND {_RANK} >= 2) SELECT * FROM (SELECT a.memory_id AS query_id, b.memory_id, {_COS} AS score, row_number() OVER (PARTITION BY a.memory_id ORDER BY {_COS} DESC, b.memory_id) AS rank FROM q a JOIN r b ON a.d = b.d AND a.memory_id <> b.memory_id) WHERE rank <= 5",
    "memory_promoted": f"SELECT lower(trim(trust, ' ')) AS was, CASE WHEN {_RANK} = 1 AND support >= 2 THEN 'verified' ELSE lower(trim(trust, ' ')) END AS trust, count(*) AS n FROM memories GROUP BY 1, 2",
    "memory_feedback": "WITH e AS (SELECT DISTINCT s.source AS key, ok, created_at, answer_id FROM (SELECT answer_id, created_at, coalesce(grounded, FALSE) AS ok, unnest(sources) AS s FROM (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY answer_id) = 1)) WHERE s.source IS NOT NULL), w0 AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY key ORDER BY created_at, answer_id ROWS UNBOUNDED PRECEDING) AS fails FROM e), w AS (SELECT *, count(*) FILTER (ok AND fails < 2) OVER (PARTITION BY key ORDER BY created_at, answer_id ROWS UNBOUNDED PRECEDING) AS wins FROM w0) SELECT key, least(3, 1 + max(wins)) AS level, max(fails) AS fails, min(answer_id) FILTER (fails >= 2) AS invalidated FROM w GROUP BY 1",
    "playbook": "SELECT owner_user_id, array_to_string(coalesce(list_sort(list(memory_id) FILTER (level = 'fact')), []), ',') AS facts, array_to_string(coalesce(list_sort(list(memory_id) FILTER (level = 'playbook')), []), ',') AS playbooks FROM memories WHERE NOT coalesce(is_deleted, FALSE) AND owner_user_id IS NOT NULL GROUP BY 1",
    "memory_latest": "SELECT * FROM (SELECT owner_user_id, memory_id, row_number() OVER (PARTITION BY owner_user_id ORDER BY updated_at DESC, memory_id DESC) AS n FROM memories WHERE owner_user_id IS NOT NULL) WHERE n <= 3",
}
