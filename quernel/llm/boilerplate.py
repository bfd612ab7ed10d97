"""The main text of web pages, by differencing pages that are neighbours by URL.

Pages are put in the order of their hosts and URL paths and cut into ranges of bounded size, with a few
pages of overlap. Each page is compared with its nearest pages: their lines are aligned by longest common
subsequence (numbers and the host's name masked), and what neighbours share is deleted. A line that
was shared once is known as furniture on all pages of its host, and if several hosts taught it, on
all pages; the short parts of such lines are known as words of navigation, by which breadcrumbs are
found. Nothing is known that no two neighbours shared: there are no lists of phrases.

After the last line that has the form of main text - running text, an item, a row of a table, a
command - come titles of other pages and comments, which are new on every page; they are deleted too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import settle

RANGE_PAGES = 4_000  # pages of a range
NEIGHBOURS = 5  # on each side
SHARED = 0.5  # share of the compared pages that have a line which is deleted amid main text
FIRM = 0.15  # share of the pages with a line on which it was so
TAUGHT_PAGES = 2  # pages of a host on which neighbours shared a line that is known on all its pages, at least,
TAUGHT = 0.5  # and their share of the pages that have it, so that what comes again by chance isn't known in a large host
TAUGHT_HOSTS = 2  # hosts that know a line which is known on all hosts
HEADING_PAGES = 3  # a heading with nothing below it comes on so many pages of its host; a title doesn't
BROADCAST_ROWS = 500_000  # a side of at most so many rows is broadcast; beyond it the join shuffles

_NUMBER = re.compile(r"\d+")
_PARTS = re.compile(r"\s+[>»›/|·→•]\s+|\s?[»›|]\s?|\s{2,}")
_CLOSED = re.compile(r"[.!?。!?…:;:][\"'”»）)\]]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–·‣▪]|\d+[.)]|[a-z][.)])\s+\S")
_LABEL = re.compile(r"^[^:：\t|]{2,30}[:：]")
_LINES = "host string, tbl string, row_id bigint, page bigint, line_no bigint, i int, n int, key bigint, first boolean, hits int, compared int, sentence boolean, anchor boolean, item boolean, labelled boolean, parts array<bigint>, words array<bigint>"


def mask(line: str, host: str = "") -> str:
    line = " ".join(line.split()).casefold()
    if host:
        line = line.replace(host, "~")
    return _NUMBER.sub("#", line)


def mask_spaced(line: str, host: str) -> str:
    line = line.strip().casefold()
    return _NUMBER.sub("#", line.replace(host, "~") if host else line)


def _parts(line: str) -> list[str]:
    return [w for w in (x.strip() for x in _PARTS.split(line)) if w]


def common(a: list[tuple], at: dict[tuple, int]) -> list[int]:
    """Indexes of a in a longest common subsequence of a and b, whose items are unique within each; ``at`` gives their places in b.

    (A line and how often it came before are one item; then the subsequence is a longest increasing
    one of positions, found in n log n.)
    """
    ends: list[int] = []
    last: list[int] = []
    back: dict[int, int] = {}
    for i, x in enumerate(a):
        if (p := at.get(x)) is None:
            continue
        k = bisect_left(ends, p)
        ends[k : k + 1] = [p]
        last[k : k + 1] = [i]
        back[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def numbered(lines: Iterable[str]) -> list[tuple]:
    seen: Counter = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def sentence(line: str) -> bool:
    """A line of running text: closed by a mark, and longer than a label."""
    line = line.strip()
    wide = sum(c > "⺀" for c in line)
    return bool(_CLOSED.search(line)) and not line.endswith((":", "：")) and (len(line.split()) >= 5 or wide >= 8)


def anchor(line: str) -> bool:
    """A line that only main text has: running text, an item of a list, a row of a table, a command."""
    return "\t" in line.strip() or bool(_ITEM.match(line)) or line.lstrip().startswith(("|", "```")) or bool(re.match(r"^\s*\S+(?:\s\S+)?=\S+$", line)) or bool(re.match(r"^\s*(?:set|apply|get|run)\s[-\w.]+", line)) or sentence(line)


@lru_cache(200_000)
def _number(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def aligned(pages: list[dict], neighbours: int = NEIGHBOURS) -> list[tuple]:
    """The non-blank lines (_LINES) of pages {host, path, tbl, row_id, text, own} in URL order, held against up to ``neighbours`` pages on each side; of the pages with ``own``.

    A line is compared by its masked text, or, if it begins with a label and a colon and isn't running text, by the label.
    """
    lines = [[(n, x) for n, x in enumerate(p["text"].split("\n")) if x.strip()] for p in pages]
    masked = [[mask(x, p["host"]) for _, x in ls] for p, ls in zip(pages, lines)]
    told = [[(k, sentence(x), _LABEL.match(k)) for k, (_, x) in zip(ks, ls)] for ks, ls in zip(masked, lines)]
    keys = [[label[0] if label and not whole else k for k, whole, label in ts] for ts in told]
    items = [numbered(k) for k in keys]
    places = [{x: i for i, x in enumerate(xs)} for xs in items]
    hits, compared = [Counter() for _ in pages], [0] * len(pages)
    for n, p in enumerate(pages):
        near, m = 0, n + 1
        while near < neighbours and m < len(pages) and pages[m]["host"] == p["host"]:
            if pages[m]["text"] != p["text"]:
                near += 1
                same = common(items[n], places[m])
                hits[n].update(same)
                hits[m].update(places[m][items[n][i]] for i in same)
                # a short page, like a snippet, can't show that a line of a long one is its own
                compared[n] += len(keys[m]) * 3 >= len(keys[n])
                compared[m] += len(keys[n]) * 3 >= len(keys[m])
            m += 1
    out = []
    for n, p in enumerate(pages):
        if not p["own"]:
            continue
        page = _number(p["path"] + "\n" + p["text"])
        for i, ((line_no, x), (k, whole, label)) in enumerate(zip(lines[n], told[n])):
            item, parts, words = bool(_ITEM.match(x)), [], []
            if not (whole or item or "\t" in x or x.lstrip().startswith(("|", "```"))):
                parts = [_number(w) for w in _parts(mask_spaced(x, p["host"]))]
            key = keys[n][i]
            if not _CLOSED.search(key):
                words = [_number(w) for w in {key, *_parts(key)} if w and len(w.split()) <= 3]
            out.append((p["host"], p["tbl"], p["row_id"], page, line_no, i, len(lines[n]), _number(key), items[n][i][1] == 0, hits[n][i], compared[n], whole, anchor(x), x.lstrip().startswith(("- ", "* ")), bool(label) and not whole, parts, words))
    return out


def _ranges(pages: DataFrame, neighbours: int) -> DataFrame:
    """(host, path, tbl, row_id, text, part, own): ranges of the URL order, each with the pages next to it, of which ``own`` is false."""
    order = ["host", "path", "tbl", "row_id"]
    count = -(-pages.count() // RANGE_PAGES)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if b.num_rows:
                tail = pa.concat_batches([last, b]) if last is not None else b
                last = tail.slice(max(0, tail.num_rows - neighbours))
                yield _placed(b, part, True)
                if part and seen < neighbours:
                    yield _placed(b.slice(0, neighbours - seen), part - 1, False)
                seen += b.num_rows
        if last is not None:
            yield _placed(last, part + 1, False)

    ranged = pages.repartitionByRange(max(1, count), *order).sortWithinPartitions(*order, F.xxhash64("text"))
    return ranged.mapInArrow(edges, "host string, path string, tbl string, row_id bigint, text string, part int, own boolean")


def _placed(b: pa.RecordBatch, part: int, own: bool) -> pa.RecordBatch:
    n = b.num_rows
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array([own] * n, pa.bool_())], [*b.schema.names, "part", "own"])


def lines(pages: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """_LINES of all pages(host, path, tbl, row_id, text)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda p: (p["host"], p["path"], p["tbl"], p["row_id"], p["text"], not p["own"]))
        fine = [p for i, p in enumerate(rows) if not i or any(p[c] != rows[i - 1][c] for c in ("host", "path", "tbl", "row_id", "text"))]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.bool_()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = list(zip(*aligned(fine, neighbours))) or [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _LINES.split(", ")])

    return _ranges(pages, neighbours).groupBy("part").applyInArrow(run, _LINES)


def _slim(side: DataFrame) -> DataFrame:
    """A settled side, broadcast if it was counted to be small."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def main_text(pages: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(tbl, row_id, line_no) of the non-blank main lines, from pages(tbl, row_id, url, text).

    Lines are parted by a line feed and counted from 0, blank ones included. Null, empty and blank
    texts and null ids have no rows; rows delivered twice count once; pages without a URL form a host
    of their own.
    """
    url = F.coalesce("url", F.lit(""))
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("")), F.lit(""))
    path = F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", "")
    fine = F.col("row_id").isNotNull() & F.col("text").isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    slim = pages.where(fine).select(host.alias("host"), path.alias("path"), "tbl", F.col("row_id").cast("bigint").alias("row_id"), F.col("text").cast("string").alias("text"))
    each = settle(lines(slim, neighbours), "lines")
    # what differencing taught of each line of each host
    shared = (F.col("compared") > 0) & (F.col("hits") >= SHARED * F.col("compared")) & (F.col("hits") > (F.col("compared") > 1).cast("int"))
    stats = each.groupBy("host", "key").agg(F.count_if("first").alias("have"), F.count_if(F.col("hits") > 0).alias("taught"), F.count_if(shared).alias("deleted"), F.first("words").alias("words"))
    stats = settle(stats.where(f"taught > 0 OR have >= {HEADING_PAGES}"), "stats")
    here = (F.col("taught") >= TAUGHT_PAGES) & (F.col("taught") >= TAUGHT * F.col("have"))
    hosts = stats.where(here).groupBy("key").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= TAUGHT_HOSTS).select("key", F.lit(True).alias("wide"))
    firm = (F.col("deleted") >= TAUGHT_PAGES) & (F.col("deleted") >= FIRM * F.col("have"))
    seen = stats.select("host", "key", "have", "deleted", here.alias("here"), firm.alias("firm"))
    marked = each.join(_slim(seen), ["host", "key"], "left").join(_slim(settle(hosts, "hosts")), "key", "left")
    known = F.coalesce(F.col("here") | F.col("firm"), F.lit(False)) | F.coalesce("wide", F.lit(False))
    marked = settle(marked.select(*[c for c in each.columns if c != "compared"], known.alias("known"), F.coalesce("firm", F.lit(False)).alias("firm"), F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("deleted", F.lit(0)).alias("deleted")), "marked")
    words = _slim(settle(marked.where("known").select("host", F.explode("words").alias("word")).distinct(), "navigation"))
    # the first two parts of a line as words of navigation; lines without parts get keys of their own, so that they don't meet in one task
    part = lambda n: F.coalesce(F.try_element_at("parts", F.lit(n)), F.xxhash64("row_id", "page", "i", F.lit(n)))
    told = marked.withColumns({"p1": part(1), "p2": part(2)})
    for p in ("p1", "p2"):
        told = told.join(words.select("host", F.col("word").alias(p), F.lit(True).alias(f"{p}_known")), ["host", p], "left")
    size, one, two = F.size("parts"), F.coalesce("p1_known", F.lit(False)), F.coalesce("p2_known", F.lit(False))
    crumb = (size >= 3) | (size == 2) & (one | two) | (size == 1) & one
    return _kept(told.select("tbl", "row_id", "page", "line_no", "i", "n", "known", "firm", "have", "deleted", "sentence", "anchor", "item", "labelled", crumb.alias("crumb"), size.alias("size"))).distinct()


def _kept(told: DataFrame) -> DataFrame:
    """(tbl, row_id, line_no) of the lines that stay; each page is one window."""
    page = Window.partitionBy("tbl", "row_id", "page")
    place = lambda which, of: of(F.when(which, F.col("i"))).over(page)
    own = F.col("anchor") & ~F.col("known")
    framed = told.withColumn("inside", F.coalesce((place(own, F.min) < F.col("i")) & (F.col("i") < place(own, F.max)), F.lit(False)))
    inside: Column = F.col("inside")
    # amid main text a line that some pages share is a heading
    firmly = F.col("firm") & inside & (F.col("sentence") | F.col("labelled") | (F.col("deleted") >= 0.6 * F.col("have")))
    gone = F.col("crumb") & ~(inside & (F.col("size") == 1)) | ~F.col("item") & (F.col("known") & ~inside | firmly)
    cut = framed.withColumn("gone", gone).withColumns({"last": place(F.col("anchor") & ~F.col("gone"), F.max), "top": F.coalesce(place(~F.col("gone"), F.min), F.lit(0))})
    heading = (F.col("i") == F.col("last") + 1) & (F.col("have") >= HEADING_PAGES)
    below = F.when(F.col("last").isNotNull(), (F.col("i") > F.col("last")) & ~heading).otherwise((F.col("n") > 4) & (F.col("i") > F.col("top")))
    return cut.where(~F.col("gone") & ~below).select("tbl", "row_id", "line_no")
