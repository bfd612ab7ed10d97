"""Text functions on columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4E00}-\x{9FFF}]"

#: What an instruction hidden in a text looks like, and what replaces it.
INJECTION = (
    r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions",
    r"(?i)忽略(以上|上述|之前)(的)?(所有)?指令",
    r"(?i)disregard\s+the\s+system\s+prompt",
    r"(?i)new\s+instructions\s*:",
    r"(?i)\bsystem\s+prompt\b",
    r"(?im)^\s*(system|assistant)\s*:",
    r"<\|.*?\|>",
    r"(?i)</?s>",
)
FILTERED = "[filtered]"


def sha(text: Column) -> Column:
    """SHA-256 in hexadecimal; null for null."""
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(sha(text), 1, 32)


def approx_tokens(text: Column) -> Column:
    """Han characters count 1, others a quarter; the floor of the sum plus 1; 0 for an empty text."""
    han = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.floor(han + 0.25 * (F.length(text) - han)).cast("int") + 1)


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, Han characters one by one; an empty list for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CJK + r"|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+"), F.lit(0))


def squeeze(text: Column) -> Column:
    """Without white space, for containment."""
    return F.regexp_replace(text, r"\s+", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def injected(text: Column) -> Column:
    """Whether any pattern of INJECTION occurs; false for null."""
    hit = F.lit(False)
    for p in INJECTION:
        hit = hit | F.coalesce(text.rlike(p), F.lit(False))
    return hit


def sanitize(text: Column) -> Column:
    """The patterns replaced one after the other."""
    for p in INJECTION:
        text = F.regexp_replace(text, p, FILTERED)
    return text


def clean_web(text: Column, limit: int) -> Column:
    """White space collapsed, cut to ``limit`` characters, then sanitized (so the result may be longer)."""
    return sanitize(F.left(collapse(text), F.lit(limit)))


def citations(text: Column) -> Column:
    """The numbers of [n] marks in order, with repetitions."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    return F.transform(found, lambda x: x.cast("int"))


def sentences(text: Column) -> Column:
    """Sentences without marks of citation, two characters or longer. A full stop of the Latin script ends none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\d+\]", ""), "[。！？!?；;\\n]+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 2)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; a literal IPv6 address without its brackets."""
    place = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    bare = F.lower(F.regexp_replace(place, r"^.*@", ""))
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1))


#: Hosts that are never asked.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata", "instance", "")
#: Literal addresses that are private, of loopback, link-local, reserved, for documents and tests, or multicast.
_PART = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
IPV4 = rf"^{_PART}(\.{_PART}){{3}}$"
PRIVATE_IPV4 = r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[2-5]\d\.)"
GLOBAL_IPV6 = r"^[23][0-9a-f]{3}:"
PRIVATE_IPV6 = r"^(2001:0?db8:|2001:(:|0{0,2}[0-9a-f]{1,2}:|0?1[0-9a-f]{2}:)|2002:|3fff:0?[0-9a-f]{1,3}:)"


def safe_url(url: Column) -> Column:
    """http(s) in any case, and neither a blocked host nor a literal address that isn't public. Names are never resolved."""
    h = host(url)
    address = F.when(h.rlike(IPV4), ~h.rlike(PRIVATE_IPV4)).when(F.contains(h, F.lit(":")), h.rlike(GLOBAL_IPV6) & ~h.rlike(PRIVATE_IPV6)).otherwise(F.lit(True))
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)) & ~h.isin(*BLOCKED_HOSTS) & address


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a vector is null or of zeros, or the lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(x) == F.size(y), dot / F.nullif(norm(x) * norm(y), F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, p: s + p * p))


def usable(v: Column, dimension: int) -> Column:
    """Whether a vector has ``dimension`` finite values that are not all zero."""
    fine = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def trust_rank(trust: Column) -> Column:
    """draft 1, verified 2, curated 3, in any case and spacing; others 0."""
    t = F.lower(F.trim(trust))
    return F.when(t == "draft", 1).when(t == "verified", 2).when(t == "curated", 3).otherwise(0)
