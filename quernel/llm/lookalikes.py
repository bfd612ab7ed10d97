"""One form for texts that look the same but are stored with different characters.

The skeleton of a text: decompose it, replace every character by the prototype of its look, and
decompose again. Texts with equal skeletons look the same. Case, accents, raised or circled
figures and styled letters stay, since they are seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts and what they look like.
LATIN_LOOKS = {
    "cyrillic": ("аеорсухіѕјһԁԛԝѵгАВЕЅІЈКМНОРСТУХԌԚԜ", "aeopcyxisjhdqwvrABESIJKMHOPCTYXGQW"),
    "greek": ("αονρικϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aovpikcjABEZHIKMNOPTYXCJ"),
    "armenian": ("օոսցհզյՍՏՕԼ", "onughqjUSOL"),
    "latin": ("ɑɡıɩꓐꓚꓓꓰꓖꓧꓙꓗꓡꓟꓠꓳꓑꓢꓔꓴꓦꓪꓫꓬꓜ", "agiiBCDEGHJKLMNOPSTUVWXYZ"),
}
#: Signs and what they look like.
SIGN_LOOKS = {"‐": "-", "‑": "-", "﹣": "-", "‒": "–", "−": "–", "⁄": "/", "∕": "/", "․": ".", "‚": ",", "∶": ":", "꞉": ":", "ǃ": "!", "ʼ": "’", "‛": "‘", "∙": "·", "⋅": "·", "‧": "·", "∗": "*", "ꓺ": "..", "⸺": "——"}
#: Simplified radicals of the supplement block, which have no decomposition.
RADICAL_LOOKS = ("⻅⻆⻉⻋⻓⻔⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰", "见角贝车长门韦页风飞食马骨鬼鱼鸟麦黄齐齿龙")
#: Names of characters whose compatibility form is only another way to store the same look.
SAME_LOOK = re.compile(r"LIGATURE|DIGRAPH|ROMAN NUMERAL|KANGXI RADICAL|CJK RADICAL|DOT LEADER|ELLIPSIS|MICRO SIGN|QUAD|SPACE|HANGUL LETTER|LATIN SMALL LETTER (?:DZ|LJ|NJ)|LATIN CAPITAL LETTER (?:DZ|LJ|NJ|L WITH SMALL LETTER J|N WITH SMALL LETTER J|D WITH SMALL LETTER Z)|FORM$")
_JOINER = re.compile("[‌‍]")


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """The look-alike table for ``str.translate``, from the rules of the character database and the fixed values.

    Wide, narrow and no-break forms have their plain form; of the other compatibility forms only those
    named by SAME_LOOK. Characters without a look (format characters, controls, selectors) vanish.
    """
    out: dict[int, str] = {}
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if c in "\n\r\v\f\x85  ":
            out[i] = "\n"
        elif kind == "Zs" or c == "\t":
            out[i] = " "
        elif kind in ("Cf", "Cc") and i not in (0x200C, 0x200D) or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[i] = ""
        elif form := unicodedata.decomposition(c):
            tag = form.split(" ")[0]
            if tag in ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>") or tag == "<compat>" and SAME_LOOK.search(unicodedata.name(c, "")):
                out[i] = unicodedata.normalize("NFKD", c)
    for written, look in [*LATIN_LOOKS.values(), RADICAL_LOOKS]:
        out |= {ord(a): b for a, b in zip(written, look, strict=True)}
    out |= {ord(a): b for a, b in SIGN_LOOKS.items()}
    return {i: form for i, s in out.items() if (form := "".join(out.get(ord(c), c) for c in s)) != chr(i)}


def _joins(c: str) -> bool:
    """Whether a joiner beside c can be seen: scripts with joined letters, and pictures."""
    return "؀" <= c <= "෿" or "က" <= c <= "႟" or "ក" <= c <= "᢯" or c >= "\U0001f000" or unicodedata.category(c) in ("So", "Sk")


def skeleton(text: str) -> str:
    if text.isascii() and (text.isprintable() or text.replace("\n", "").isprintable()):
        return _trimmed(text) if " \n" in text else text.strip()
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
    if _JOINER.search(text):
        bare = text.translate({i: "" for i in (*range(0xFE00, 0xFE10), 0x200B, 0x2060, 0xFEFF, 0xAD, 0x200E, 0x200F)})
        text = _JOINER.sub(lambda m: m[0] if 0 < m.start() < len(bare) - 1 and _joins(bare[m.start() - 1]) and _joins(bare[m.start() + 1]) else "", bare)
    if found := prototypes().keys() & map(ord, set(text)):
        # no prototype has a character that has one itself, so the order is free
        for i in found:
            text = text.replace(chr(i), prototypes()[i])
        text = unicodedata.normalize("NFD", text)
    return _trimmed(text)


def _trimmed(text: str) -> str:
    """Without the blanks at the ends of lines and around the text."""
    return "\n".join(map(str.rstrip, text.split("\n"))).strip()


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) for each row: the skeleton in composed characters; null for a null text, '' for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [None if t is None else unicodedata.normalize("NFC", skeleton(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string())], [key, "form"])

    slim = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, form string")


def looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, look, stored): 16-byte hashes of the skeleton and of the string; without null ids, null and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = lambda t: blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            rows = [(i, h(s), h(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (s := skeleton(t))]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["id", "look", "stored"])

    slim = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, "id bigint, look binary, stored binary")


def alike(seen: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b, from seen(tbl, id, look, stored): rows that look the same but differ as strings.

    Rows with the same string are copies, of which the smallest id represents the rest: each row is
    paired with the representative of every other string of its look, so that no link between different
    strings is lost and copies aren't multiplied with each other. Only looks with two or more strings
    reach the join; a hot look is split by the adaptive skew join, its other side being one row a string.
    """
    strings = seen.groupBy("tbl", "look", "stored").agg(F.min("id").alias("rep"))
    mixed = strings.groupBy("tbl", "look").agg(F.count("*").alias("strings")).where("strings > 1").select("tbl", "look")
    rows = seen.join(mixed, ["tbl", "look"], "left_semi")
    reps = strings.join(mixed, ["tbl", "look"], "left_semi").withColumnRenamed("stored", "other")
    found = rows.join(reps, ["tbl", "look"]).where("stored != other AND id != rep")
    return found.select("tbl", F.least("id", "rep").alias("id_a"), F.greatest("id", "rep").alias("id_b")).distinct()
