"""Documents in, chunks out: upsert classification, soft deletion, parent and child chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.config import DEFAULTS, Config
from quernel.functions import text


def classify(staged: DataFrame, active: DataFrame) -> DataFrame:
    """(source, doc_hash, action) of staged(source, text) against active(source, doc_hash).

    empty: blank text, nothing is written; skipped: same hash; updated: another one; created: no such
    source. Only sources and hashes meet in the join.
    """
    new = staged.select("source", text.sha(F.col("text")).alias("doc_hash"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    old = active.select("source", F.col("doc_hash").alias("was")).dropDuplicates(["source"])
    action = F.when(F.col("blank"), "empty").when(F.col("was").isNull(), "created").when(F.col("was") == F.col("doc_hash"), "skipped").otherwise("updated")
    return new.join(old, "source", "left").select("source", "doc_hash", action.alias("action"))


def versions(documents: DataFrame) -> DataFrame:
    """(source, batch_no, doc_id, action) of every document against the one before it of its source, in order of (batch_no, doc_id).

    A blank text writes nothing, so the next one is held against the last that wasn't blank. Only
    hashes are shuffled and sorted; the window of a source streams its rows and holds none.
    """
    own = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", text.sha(F.col("text")))
    rows = documents.select("source", "batch_no", "doc_id", own.alias("own"))
    w = Window.partitionBy("source").orderBy("batch_no", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("was", F.last("own", ignorenulls=True).over(w))
    action = F.when(F.col("own").isNull(), "empty").when(F.col("was").isNull(), "created").when(F.col("was") == F.col("own"), "skipped").otherwise("updated")
    return rows.select("source", "batch_no", "doc_id", action.alias("action"))


def upsert(chunks: DataFrame, fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """The new snapshot of chunks: those of updated sources replaced, of created ones added. Re-running it changes nothing."""
    touched = actions.where("action IN ('created', 'updated')").select("source")
    return chunks.join(touched, "source", "left_anti").unionByName(fresh.join(touched, "source", "left_semi"), allowMissingColumns=True)


def soft_delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """is_deleted set for the keys, the rest unchanged."""
    gone = keys.select(F.col(key), F.lit(True).alias("_gone")).dropDuplicates([key])
    return rows.join(gone, key, "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).drop("_gone").select(*rows.columns)


def units(content: Column) -> Column:
    """Paragraphs if there are more than one, else lines if more than one, else the whole; blank parts are dropped."""
    kept = lambda sep: F.filter(F.split(content, sep), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")
    return F.when(F.size(kept("\n\n")) > 1, kept("\n\n")).when(F.size(kept("\n")) > 1, kept("\n")).otherwise(F.filter(F.array(content), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""))


def with_overlap(blocks: DataFrame, tokens: int) -> DataFrame:
    """(doc_id, pos, block) with the tail of the block before it (as it was) put in front: the longest within ``tokens``, a Han character counting 1, others a quarter."""
    before = F.lag("block").over(Window.partitionBy("doc_id").orderBy("pos"))
    han = lambda x: F.length(x) - F.length(F.regexp_replace(x, text.CJK, ""))
    fits = F.filter(F.sequence(F.lit(0), F.lit(4 * tokens)), lambda i: F.length(F.right(before, i)) + 3 * han(F.right(before, i)) <= 4 * tokens)
    tail = F.right(before, F.array_max(fits))
    return blocks.select("doc_id", "pos", F.when(before.isNull(), F.col("block")).otherwise(F.trim(F.concat(tail, F.lit("\n"), F.col("block")))).alias("block"))


def _weight(s: str) -> float:
    return sum(1.0 if "一" <= c <= "鿿" else 0.25 for c in s)


def _pieces(unit: str, budget: int) -> Iterator[str]:
    """Cuts of at most ``budget`` tokens."""
    start, total = 0, 0.0
    for i, c in enumerate(unit):
        w = 1.0 if "一" <= c <= "鿿" else 0.25
        if total + w > budget and i > start:
            yield unit[start:i]
            start, total = i, 0.0
        total += w
    if unit[start:]:
        yield unit[start:]


def _packed(value: str, limit: int, budget: int) -> list[str]:
    """Units cut to ``limit`` tokens and packed, as long as the whole tokens of them together, counted up, are within ``budget``."""
    for sep in ("\n\n", "\n", None):
        parts = [p for p in (value.split(sep) if sep else [value]) if p.strip()]
        if len(parts) > 1 or sep is None:
            break
    out: list[str] = []
    for piece in (x for p in parts for x in _pieces(p, limit)):
        if out and _weight(out[-1]) + _weight(piece) + 0.25 < budget:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
    return out


def _tail(value: str, budget: int) -> str:
    total, i = 0.0, len(value)
    while i and total + (w := 1.0 if "一" <= value[i - 1] <= "鿿" else 0.25) <= budget:
        total, i = total + w, i - 1
    return value[i:]


def chunk(documents: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """(doc_id, parent_no, child_no, content, token_count): parents have child_no null, children follow them.

    Parents hold up to ``parent_tokens``, children within them up to ``child_tokens`` with an overlap.
    Null and blank texts have no chunks. Each text is cut by one task, whole.
    """
    budget = min(cfg.child_tokens, cfg.parent_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not value or not value.strip():
                    continue
                for p, parent in enumerate(_packed(value.strip(), cfg.parent_tokens, cfg.parent_tokens)):
                    rows.append((i, p, None, parent.strip(), int(_weight(parent)) + 1))
                    own = _packed(parent, budget, max(1, budget - cfg.overlap_tokens))
                    for c, child in enumerate(own):
                        if c and cfg.overlap_tokens:
                            child = (_tail(own[c - 1], cfg.overlap_tokens) + "\n" + child).strip()
                        if child.strip():
                            rows.append((i, p, c, child.strip(), int(_weight(child)) + 1))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "parent_no", "child_no", "content", "token_count"])

    slim = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, parent_no int, child_no int, content string, token_count int")


def chunk_text(documents: DataFrame, tokens: int = 300, overlap: int = 50) -> DataFrame:
    """(doc_id, no, content, token_count): paragraphs, else their lines, else cuts, packed and with the tail of the block before.

    Null and blank texts have no chunks. Each text is cut by one task, whole.
    """

    def blocks(value: str) -> Iterator[str]:
        small: list[str] = []
        for para in [x for x in value.split("\n\n") if x.strip()]:
            for line in [para] if _weight(para) < tokens else [x for x in para.split("\n") if x.strip()]:
                small += [line] if _weight(line) < tokens else _pieces(line, tokens)
        out: list[str] = []
        for x in small:
            if out and _weight(out[-1]) + _weight(x) + 0.25 < max(1, tokens - overlap):
                out[-1] += "\n" + x
            else:
                out.append(x)
        for before, x in zip([None, *out], out):
            yield x if before is None or overlap <= 0 else (_tail(before, overlap) + "\n" + x).strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, x.strip(), int(_weight(x)) + 1) for i, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if value and value.strip() for n, x in enumerate(blocks(value.strip())) if x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.string(), pa.int32()))], ["doc_id", "no", "content", "token_count"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, no int, content string, token_count int")


def fingerprint(rows: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """One row (n, max_id, max_epoch): whether a derived index is up to date."""
    epoch = F.unix_micros(F.max(at).cast("timestamp"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.max(key), F.lit(0)).alias("max_id"), F.coalesce(epoch, F.lit(0)).alias("max_epoch"))
