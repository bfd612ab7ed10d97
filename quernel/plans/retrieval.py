"""Queries of ingestion and retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.config import DEFAULTS
from quernel.functions import text
from quernel.operators import ingest, retrieval
from quernel.session import table

#: Queries are all rows whose id is divisible by this, against all rows.
QUERY_STEP = 50
BITS = 1 << 24  # of the table of the starts that snippets have

_LIVE = "SELECT c.chunk_id, c.document_id, c.source, c.content, c.embedding::DOUBLE[] AS v FROM chunks c JOIN documents d ON d.doc_id = c.document_id WHERE NOT coalesce(d.is_deleted, FALSE) AND len(c.embedding) = 64 AND len(list_filter(c.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(c.embedding, lambda x: x <> 0)) > 0"
_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\x{{4E00}}-\\x{{9FFF}}]|(?:[\\p{{N}}]|[^\\P{{L}}\\x{{4E00}}-\\x{{9FFF}}])+')"
_COS = "round(list_dot_product({0}.v, {1}.v) / (sqrt(list_dot_product({0}.v, {0}.v)) * sqrt(list_dot_product({1}.v, {1}.v))), 6)"


def tokens_sql(column: str) -> str:
    return _TOKENS.format(column)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.active_children(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("chunk_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "content", "embedding")


def golden_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions under negative ids, so that they can't be taken for chunks."""
    return table(spark, sf_dir, "golden").where("question_id IS NOT NULL").select((-F.col("question_id")).alias("query_id"), F.col("question").alias("content"), "gold_source", "gold_snippets")


def bm25_topk(spark, sf_dir):
    found = retrieval.bm25(golden_queries(spark, sf_dir), live(spark, sf_dir), 10)
    return found.select((-F.col("query_id")).alias("question_id"), "chunk_id", "score", "rank")


def lexical_stats(spark, sf_dir):
    return retrieval.lexical_stats(live(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def term_df(spark, sf_dir):
    return retrieval.postings(live(spark, sf_dir)).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def vector_topk(spark, sf_dir):
    rows = live(spark, sf_dir)
    return retrieval.dense(asked(rows), rows, 10)


def embedding_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(text.usable(F.col("embedding"), 64)).select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    found = retrieval.dense(rows.where(F.col("chunk_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "embedding"), rows, 10)
    return found.withColumnRenamed("chunk_id", "vec_id")


def rrf_hybrid(spark, sf_dir):
    rows = live(spark, sf_dir)
    legs = [retrieval.dense(asked(rows), rows, DEFAULTS.candidate_n), retrieval.bm25(asked(rows), rows, DEFAULTS.candidate_n)]
    return retrieval.fused(legs, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank_0", "rank_1", "rank")


def rrf_weighted(spark, sf_dir):
    rows = live(spark, sf_dir)
    legs = [retrieval.dense(asked(rows), rows, DEFAULTS.candidate_n), retrieval.bm25(asked(rows), rows, DEFAULTS.candidate_n)]
    return retrieval.fused(legs, 10, [2.0, 1.0]).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def rerank_topk(spark, sf_dir):
    rows = live(spark, sf_dir)
    found = retrieval.dense(asked(rows), rows, DEFAULTS.candidate_n)
    return retrieval.rerank(found, asked(rows), rows, DEFAULTS.candidate_n, DEFAULTS.top_k).select("query_id", "chunk_id", "before", "score", "rank")


def rerank_needed(spark, sf_dir):
    """Whether the best dense score is too low to do without reranking."""
    rows = live(spark, sf_dir)
    best = retrieval.dense(asked(rows), rows, 1)
    return best.select("query_id", "score", (F.col("score") < 0.9).alias("needs_rerank"))


def retrieve_hybrid(spark, sf_dir):
    rows = live(spark, sf_dir)
    found = retrieval.retrieve(asked(rows), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))
    return found.select("query_id", "chunk_id", "score", "score_type", "rank", "parent_id", text.sha(F.col("context")).alias("context_hash"))


def expand_parents(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    children = live(spark, sf_dir).select("chunk_id")
    return retrieval.expand_parents(children, chunks).select("chunk_id", "parent_id", F.length("context").alias("context_chars"))


def doc_hash_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said, true = F.lower(F.regexp_replace(F.coalesce("doc_hash", F.lit("")), "^sha256:", "")), text.sha(F.col("text"))
    state = F.when(F.col("text").isNull(), "no text").when(F.trim(said) == "", "missing").when(F.trim(said) == true, "right").otherwise("stale")
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def doc_hash_dups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(text.sha(F.col("text")).alias("hash"))
    return d.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def upsert_actions(spark, sf_dir):
    return ingest.versions(table(spark, sf_dir, "documents"))


def upsert_counts(spark, sf_dir):
    return ingest.versions(table(spark, sf_dir, "documents")).groupBy("batch_no", "action").agg(F.count("*").alias("n"))


def soft_delete(spark, sf_dir):
    """The snapshot after the documents of the last batch are taken back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "batch_no", "is_deleted")
    out = ingest.soft_delete(d, d.where("batch_no = 8").select("doc_id"), "doc_id")
    return out.groupBy("batch_no").agg(F.count_if("is_deleted").alias("deleted"), F.count("*").alias("n"))


def fingerprint(spark, sf_dir):
    """Of the active children, so that a changed chunk is noticed."""
    rows = live(spark, sf_dir).select("chunk_id").join(table(spark, sf_dir, "chunks").select("chunk_id", "created_at"), "chunk_id")
    return ingest.fingerprint(rows, "chunk_id", "created_at")


def documents_paging(spark, sf_dir):
    """The third page of documents with their chunk counts, largest id first."""
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks")
    role = F.get_json_object("metadata", "$.role")
    n = c.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_chunks"), F.count_if(role == "parent").alias("n_parents"), F.count_if(role == "child").alias("n_children"))
    return d.where(~F.coalesce("is_deleted", F.lit(False))).select("doc_id", "source").join(n, "doc_id").orderBy(F.desc("doc_id")).offset(40).limit(20)


def source_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_deleted").alias("deleted"), F.count_if(F.col("text").isNull()).alias("without_text"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def approx_tokens(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("chunk_id", text.approx_tokens(F.col("content")).alias("tokens"))


def chunk_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.size(ingest.units(F.col("text"))).alias("units"))


def overlap_blocks(spark, sf_dir):
    """Lines of documents, each with the tail of the one before."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))
    return ingest.with_overlap(d, 5).select("doc_id", "pos", text.sha(F.col("block")).alias("hash"))


def chunk_documents(spark, sf_dir):
    """How many parents and children the chunker makes of each document."""
    c = ingest.chunk(table(spark, sf_dir, "documents"))
    return c.groupBy("doc_id").agg(F.count_if(F.col("child_no").isNull()).alias("parents"), F.count("child_no").alias("children"), F.max("token_count").alias("most_tokens"))


def _anchors(rows: DataFrame, key: str, bits: np.ndarray | None = None) -> DataFrame:
    """(key, source, anchor) of rows(key, source, content): a hash of the first 1, 2, 4, … characters of the content, the longest such start; with ``bits`` of those of all its pieces of these lengths whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, t in enumerate(b.column(2).to_pylist()):
                c, size = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1), 1
                with np.errstate(over="ignore"):
                    while len(c):
                        here = c * np.uint64(0x9E3779B97F4A7C15)
                        here = (here ^ (here >> np.uint64(32))).view(np.int64)
                        longest = len(t) < 2 * size
                        if bits is not None:
                            found.append(np.unique(here[bits[here & len(bits) - 1]]))
                        elif longest:
                            found.append(here[:1])
                        else:
                            found.append(here[:0])
                        at.append(np.full(len(found[-1]), i))
                        if longest:
                            break
                        c = c[:-size] * np.uint64(0xBF58476D1CE4E5B9) + (c[size:] ^ (c[size:] >> np.uint64(29))) + np.uint64(size)
                        size *= 2
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(found))], [key, "source", "anchor"])

    return rows.select(F.col(key).cast("bigint"), "source", "content").where("content IS NOT NULL").mapInArrow(run, f"{key} bigint, source string, anchor bigint")


def containing(g: DataFrame, c: DataFrame) -> DataFrame:
    """(question_id, chunk_id): chunks c(chunk_id, source, content) of a source that ends in the ``gold`` of g(question_id, gold, snippet) and that contain the snippet.

    The distinct sources meet by their ends, chunks and snippets by source and the longest start of the snippet
    of 1, 2, 4, … characters; pieces of chunks that no snippet starts with are dropped where they are
    made, and the texts travel once.
    """
    ends = c.select("source").distinct().select("source", F.explode(F.transform(F.sequence(F.lit(1), F.length("source")), lambda i: F.substring("source", i, F.lit(1 << 20)))).alias("gold"))
    named = g.join(ends, "gold").select("question_id", "source", "snippet")
    starts = _anchors(g.select(F.xxhash64("snippet").alias("key"), F.lit("").alias("source"), F.col("snippet").alias("content")).distinct(), "key").select("key", "anchor")
    bits = np.zeros(BITS, bool)
    bits[starts.select(F.col("anchor").bitwiseAND(F.lit(BITS - 1)).alias("at")).distinct().toArrow()["at"].to_numpy()] = True
    shared = g.sparkSession.sparkContext.broadcast(bits)
    pieces = _anchors(c, "chunk_id", _Shared(shared))
    wanted = named.withColumn("key", F.xxhash64("snippet")).join(starts, "key").drop("key")
    pairs = wanted.join(pieces, ["source", "anchor"]).select("question_id", "chunk_id", "snippet").distinct()
    return pairs.join(c.select("chunk_id", "content"), "chunk_id").where(F.contains("content", "snippet")).select("question_id", "chunk_id").distinct()


class _Shared:
    """A broadcast array, read in the task."""

    def __init__(self, shared):
        self.shared = shared

    def __len__(self) -> int:
        return len(self.shared.value)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.shared.value[at]


def label_relevance(spark, sf_dir):
    """Chunks of a source that ends in the golden one and contains a golden snippet, white space aside."""
    g = golden_queries(spark, sf_dir).select((-F.col("query_id")).alias("question_id"), F.col("gold_source").alias("gold"), F.explode("gold_snippets").alias("snippet"))
    g = g.select("question_id", "gold", text.squeeze(F.col("snippet")).alias("snippet")).where("length(snippet) > 0 AND gold != ''")
    return containing(g, live(spark, sf_dir).select("chunk_id", "source", text.squeeze(F.col("content")).alias("content")))


def source_suffix(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").endswith(".md")).groupBy("source").agg(F.count("*").alias("n"))


def chunk_text(spark, sf_dir):
    """How many blocks the plain chunker makes of each document."""
    c = ingest.chunk_text(table(spark, sf_dir, "documents"))
    return c.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("token_count").alias("most_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, lexical_stats, term_df, vector_topk, embedding_topk, rrf_hybrid, rrf_weighted, rerank_topk, rerank_needed, retrieve_hybrid, expand_parents, doc_hash_state, doc_hash_dups, upsert_actions,
        upsert_counts, soft_delete, fingerprint, documents_paging, source_counts, approx_tokens, chunk_units, overlap_blocks, chunk_documents, chunk_text, label_relevance, source_suffix,
    )
}

_DENSE = f"""live AS ({_LIVE}),
dense AS (SELECT * FROM (SELECT q.chunk_id AS query_id, c.chunk_id, {_COS.format('q', 'c')} AS score, row_number() OVER (PARTITION BY q.chunk_id ORDER BY {_COS.format('q', 'c')} DESC, c.chunk_id) AS rank
  FROM live q JOIN live c ON q.chunk_id <> c.chunk_id WHERE q.chunk_id % 50 = 0) WHERE rank <= 20)"""
_BM25 = """terms AS (SELECT chunk_id, unnest({tokens}) AS term FROM live),
lens AS (SELECT chunk_id, len({tokens}) AS length FROM live), stats AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
post AS (SELECT t.chunk_id, term, count(*) AS tf, any_value(l.length) AS length FROM terms t JOIN lens l USING (chunk_id) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), qterms AS ({queries}),
scored AS (SELECT query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score
  FROM qterms JOIN post p USING (term) JOIN df USING (term), stats WHERE query_id <> p.chunk_id GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20)"""
_OWN = f"SELECT DISTINCT chunk_id AS query_id, unnest({tokens_sql('content')}) AS term FROM live WHERE chunk_id % 50 = 0"
_GOLD = f"SELECT DISTINCT -question_id AS query_id, unnest({tokens_sql('question')}) AS term FROM golden WHERE question_id IS NOT NULL"


def _bm25(queries: str) -> str:
    return _BM25.format(tokens=tokens_sql("content"), queries=queries)


_RRF = "fused AS (SELECT query_id, chunk_id, round(sum(part), 9) AS s, min(r0) AS rank_0, min(r1) AS rank_1 FROM (SELECT query_id, chunk_id, {0} / (60 + rank) AS part, rank AS r0, NULL AS r1 FROM dense UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM lex) GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, chunk_id) AS rank FROM fused)"
_OVERLAP = f"round(len(list_intersect(list_distinct({tokens_sql('q.content')}), list_distinct({tokens_sql('c.content')}))) / greatest(len(list_distinct({tokens_sql('q.content')})), 1)::DOUBLE, 6)"

SQL = {
    "bm25_topk": f"WITH live AS ({_LIVE}), {_bm25(_GOLD)} SELECT -query_id AS question_id, chunk_id, score, rank FROM lex WHERE rank <= 10",
    "lexical_stats": f"WITH live AS ({_LIVE}) SELECT count(*) AS n, round(avg(len({tokens_sql('content')})), 6) AS avgdl FROM live",
    "term_df": f"WITH live AS ({_LIVE}), t AS (SELECT chunk_id, unnest({tokens_sql('content')}) AS term FROM live) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM t GROUP BY term",
    "vector_topk": f"WITH {_DENSE} SELECT * FROM dense WHERE rank <= 10",
    "embedding_topk": f"WITH live AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id, {_COS.format('q', 'c')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format('q', 'c')} DESC, c.vec_id) AS rank FROM live q JOIN live c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
    "rrf_hybrid": f"WITH {_DENSE}, {_bm25(_OWN)}, {_RRF.format('1.0::DOUBLE')} SELECT query_id, chunk_id, round(s, 6) AS score, rank_0, rank_1, rank FROM best WHERE rank <= 10",
    "rrf_weighted": f"WITH {_DENSE}, {_bm25(_OWN)}, {_RRF.format('2.0::DOUBLE')} SELECT query_id, chunk_id, round(s, 6) AS score, rank FROM best WHERE rank <= 10",
    "rerank_topk": f"WITH {_DENSE}, s AS (SELECT d.query_id, d.chunk_id, d.rank AS before, {_OVERLAP} AS score FROM dense d JOIN live q ON q.chunk_id = d.query_id JOIN live c ON c.chunk_id = d.chunk_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s) WHERE rank <= 5",
    "rerank_needed": f"WITH {_DENSE} SELECT query_id, score, score < 0.9 AS needs_rerank FROM dense WHERE rank = 1",
    "retrieve_hybrid": f"WITH {_DENSE}, {_bm25(_OWN)}, {_RRF.format('1.0::DOUBLE')}, s AS (SELECT b.query_id, b.chunk_id, b.rank AS before, {_OVERLAP} AS score FROM best b JOIN live q ON q.chunk_id = b.query_id JOIN live c ON c.chunk_id = b.chunk_id WHERE b.rank <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s) SELECT query_id, r.chunk_id, score, 'overlap' AS score_type, rank, c.parent_id, sha256(coalesce(p.content, c.content)) AS context_hash FROM r JOIN chunks c USING (chunk_id) LEFT JOIN chunks p ON p.chunk_id = c.parent_id WHERE rank <= 5",
    "expand_parents": f"WITH live AS ({_LIVE}) SELECT l.chunk_id, c.parent_id, length(coalesce(p.content, c.content)) AS context_chars FROM live l JOIN chunks c USING (chunk_id) LEFT JOIN chunks p ON p.chunk_id = c.parent_id",
    "doc_hash_state": "SELECT CASE WHEN text IS NULL THEN 'no text' WHEN trim(h) = '' THEN 'missing' WHEN trim(h) = sha256(text) THEN 'right' ELSE 'stale' END AS state, count(*) AS n FROM (SELECT text, lower(regexp_replace(coalesce(doc_hash, ''), '^sha256:', '')) AS h FROM documents) GROUP BY ALL",
    "doc_hash_dups": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "upsert_actions": "WITH h AS (SELECT source, batch_no, doc_id, CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN sha256(text) END AS own FROM documents), w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY batch_no, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM h) SELECT source, batch_no, doc_id, CASE WHEN own IS NULL THEN 'empty' WHEN was IS NULL THEN 'created' WHEN was = own THEN 'skipped' ELSE 'updated' END AS action FROM w",
    "soft_delete": "SELECT batch_no, count(*) FILTER (is_deleted OR batch_no = 8) AS deleted, count(*) AS n FROM documents GROUP BY batch_no",
    "fingerprint": f"WITH live AS ({_LIVE}) SELECT count(*) AS n, coalesce(max(chunk_id), 0) AS max_id, coalesce(epoch_us(max(created_at)), 0) AS max_epoch FROM live JOIN chunks USING (chunk_id)",
    "documents_paging": "SELECT d.doc_id, d.source, count(*) AS n_chunks, count(*) FILTER (json_extract_string(c.metadata, '$.role') = 'parent') AS n_parents, count(*) FILTER (json_extract_string(c.metadata, '$.role') = 'child') AS n_children FROM documents d JOIN chunks c ON c.document_id = d.doc_id WHERE NOT coalesce(d.is_deleted, FALSE) GROUP BY ALL ORDER BY doc_id DESC LIMIT 20 OFFSET 40",
    "source_counts": "SELECT source, count(*) AS n, count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (text IS NULL) AS without_text, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source",
    "approx_tokens": "SELECT chunk_id, CASE WHEN content = '' THEN 0 ELSE floor(h + 0.25 * (length(content) - h))::INT + 1 END AS tokens FROM (SELECT chunk_id, content, length(content) - length(regexp_replace(content, '[\\x{4E00}-\\x{9FFF}]', '', 'g')) AS h FROM chunks)",
    "chunk_units": "WITH t AS (SELECT doc_id, text, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS p, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, (CASE WHEN len(p) > 1 THEN len(p) WHEN len(l) > 1 THEN len(l) WHEN regexp_matches(text, '\\S') THEN 1 ELSE 0 END)::INT AS units FROM t",
    "overlap_blocks": "WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL), l AS (SELECT *, lag(block) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b) SELECT doc_id, pos::INT AS pos, sha256(CASE WHEN before IS NULL THEN block ELSE trim(right(before, list_max(list_filter(range(0, 21), lambda i: length(right(before, i)) + 3 * (length(right(before, i)) - length(regexp_replace(right(before, i), '[\\x{4E00}-\\x{9FFF}]', '', 'g'))) <= 20))) || chr(10) || block, ' ') END) AS hash FROM l",
    "label_relevance": f"WITH live AS ({_LIVE}), g AS (SELECT question_id, gold_source, regexp_replace(unnest(gold_snippets), '\\s+', '', 'g') AS snippet FROM golden WHERE question_id IS NOT NULL) SELECT DISTINCT question_id, chunk_id FROM g JOIN live ON suffix(source, gold_source) AND gold_source <> '' WHERE length(snippet) > 0 AND contains(regexp_replace(content, '\\s+', '', 'g'), snippet)",
    "source_suffix": "SELECT source, count(*) AS n FROM documents WHERE source LIKE '%.md' GROUP BY source",
}
SQL["upsert_counts"] = f"SELECT batch_no, action, count(*) AS n FROM ({SQL['upsert_actions']}) GROUP BY ALL"
