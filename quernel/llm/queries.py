"""The queries of this subpackage: name -> callable(spark, sf_dir), and name -> SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import boilerplate, defects, incremental, lookalikes, neighbours, packing, tokenizer, toxicity
from quernel.session import settle, table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, v) of the usable vectors of chunks and memories."""
    chunks = neighbours.usable(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", 64)
    memories = neighbours.usable(table(spark, sf_dir, "memories"), "memory_id", "embedding", 64)
    return chunks.select(F.lit("chunks").alias("tbl"), "id", "v").unionByName(memories.select(F.lit("memories").alias("tbl"), "id", "v"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs(neighbours.neighbours(vectors(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "answers").select(F.col("answer_id").alias("id"), "query", "text", F.col("is_refusal").alias("refusal"))
    return defects.defects(answers).withColumnRenamed("id", "answer_id")


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, look, stored) of the texts of chunks, golden and memories."""
    columns = {"chunks": ("chunk_id", "content"), "golden": ("question_id", "question"), "memories": ("memory_id", "content")}
    parts = [lookalikes.looks(table(spark, sf_dir, t), *c).select(F.lit(t).alias("tbl"), "id", "look", "stored") for t, c in columns.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.alike(settle(looks(spark, sf_dir), "looks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.lit(0).alias("kind"), F.col("doc_id").alias("id"), F.lit("").alias("domain"), "batch_no", "text")
    domain = F.concat(F.coalesce("scope", F.lit("?")), F.lit(" "), F.coalesce(F.concat(F.lit("of "), "owner_user_id"), F.lit("")))
    memories = table(spark, sf_dir, "memories").select(F.lit(1).alias("kind"), F.col("memory_id").alias("id"), domain.alias("domain"), "batch_no", F.col("content").alias("text"))
    return incremental.repeats(documents.unionByName(memories), spark)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = table(spark, sf_dir, "extracted").select(F.lit("extracted").alias("tbl"), F.col("page_id").alias("row_id"), "url", "text")
    results = table(spark, sf_dir, "search_results").select(F.lit("search_results").alias("tbl"), F.col("result_id").alias("row_id"), "url", F.col("snippet").alias("text"))
    return boilerplate.main_text(extracted.unionByName(results))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flagged(scored(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(scored(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found, "p8_rates": p8_rates, "p8_scores": p8_scores}

SQL: dict[str, str] = {}
