"""Files as (path, text, media_type) rows, and JSON sources of golden items and search results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("md", "txt", "html", "htm", "docx", "pdf")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(value: str) -> str:
    """The text nodes, without scripts and styles, a line each."""
    p = _Text()
    p.feed(value)
    p.close()
    return "\n".join(p.parts)


def docx_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def pdf_text(raw: bytes) -> str:
    """Pages parted by blank lines; needs the optional package."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF files needs pypdf") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, media_type, error) of the files below path; a file that can't be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
                try:
                    if kind not in KINDS:
                        raise ValueError(f"no such kind of file: {kind or 'none'}")
                    if kind == "docx":
                        value = docx_text(raw)
                    elif kind == "pdf":
                        value = pdf_text(raw)
                    else:
                        value = raw.decode("utf-8", "ignore")
                        value = html_text(value) if kind in ("html", "htm") else value
                    rows.append((name, value, kind, None))
                except Exception as e:  # noqa: BLE001  one broken file must not end the job
                    rows.append((name, None, kind, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], ["path", "text", "media_type", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string, media_type string, error string")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(question, gold_source, gold_snippets) from JSON lines; blank lines and lines without a question are left out."""
    rows = spark.read.schema("question string, gold_source string, gold_snippets array<string>").json(path)
    return rows.where("question IS NOT NULL")


def search_results(pages: DataFrame, most: int = 10) -> DataFrame:
    """(query, rank, title, url, snippet) from pages(query, body), body being a JSON answer of a search engine.

    Results without a URL are left out, ``most`` of the rest stay, the first of each URL.
    """
    kind = "results array<struct<title:string,url:string,content:string,publishedDate:string>>"
    each = pages.select("query", F.posexplode(F.from_json("body", kind)["results"]).alias("pos", "r")).where("r.url IS NOT NULL AND r.url != ''")
    from pyspark.sql import Window

    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("query", "r.url").orderBy("pos"))).where("_n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where(F.col("rank") <= most)
    return ranked.select("query", "rank", F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.content").alias("snippet"))


def server_sent(events: DataFrame) -> DataFrame:
    """(run_id, event_id, frame): events as text frames with an id to resume from."""
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "kind", F.lit("\ndata: "), F.to_json(F.struct("run_id", "action")), F.lit("\n\n"))
    return events.select("run_id", "event_id", frame.alias("frame"))


def safe_name(value: str) -> str:
    return re.sub(r"[^\w.-]+", "_", value)
