"""What judges, extractors and planners say, read as columns. A text that can't be read gives the stated default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACT = "array<struct<content:string,scope:string,kind:string,level:string,tags:map<string,string>>>"


def _said(raw: Column) -> Column:
    return F.coalesce(raw, F.lit(""))


def verdict(raw: Column) -> Column:
    """Whether a claim is supported; false if nothing or NOT_SUPPORTED is said."""
    u = F.replace(F.upper(F.trim(_said(raw))), F.lit(" "), F.lit("_"))
    return F.contains(u, F.lit("SUPPORTED")) & ~F.contains(u, F.lit("NOT_SUPPORTED"))


def sufficient(raw: Column) -> Column:
    """Whether a context is said to be enough; false if nothing or INSUFFICIENT is said."""
    u = F.upper(_said(raw))
    return F.contains(u, F.lit("SUFFICIENT")) & ~F.contains(u, F.lit("INSUFFICIENT"))


def _between(raw: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket; null without them."""
    found = F.regexp_extract(_said(raw), rf"(?s)\{opening}.*\{closing}", 0)
    return F.nullif(found, F.lit(""))


def conflict(raw: Column) -> Column:
    """struct(conflict, note) of {"conflict": …, "explanation": …}; of other texts the first 200 characters and whether they say so."""
    found = _between(raw, "{", "}")
    flag, note = F.get_json_object(found, "$.conflict"), F.coalesce(F.get_json_object(found, "$.explanation"), F.lit(""))
    read = found.isNotNull() & F.try_parse_json(found).isNotNull()
    low = F.lower(_said(raw))
    says = F.contains(F.replace(low, F.lit(" "), F.lit("")), F.lit('"conflict":true')) | F.trim(low).startswith("true")
    return F.when(read, F.struct((F.coalesce(flag, F.lit("false")).isin("false", "0", "", "null") == F.lit(False)).alias("conflict"), F.left(note, F.lit(300)).alias("note"))).otherwise(F.struct(says.alias("conflict"), F.left(_said(raw), F.lit(200)).alias("note")))


def facts(raw: Column) -> Column:
    """The facts of a JSON list: those with a content and a scope of personal or knowledge; another level than playbook is fact."""
    read = F.coalesce(F.from_json(_between(raw, "[", "]"), FACT), F.array().cast(FACT))
    scope = lambda x: F.lower(F.trim(F.coalesce(x["scope"], F.lit("knowledge"))))
    fine = F.filter(read, lambda x: x.isNotNull() & (F.trim(F.coalesce(x["content"], F.lit(""))) != "") & scope(x).isin("personal", "knowledge"))
    level = lambda x: F.when(F.lower(F.trim(x["level"])) == "playbook", "playbook").otherwise("fact")
    return F.transform(fine, lambda x: F.struct(F.trim(x["content"]).alias("content"), scope(x).alias("scope"), F.coalesce(x["kind"], F.lit("fact")).alias("kind"), level(x).alias("level"), x["tags"].alias("tags")))


def outline(raw: Column, most: int) -> Column:
    """The first ``most`` titles of a JSON list that aren't blank."""
    read = F.coalesce(F.from_json(_between(raw, "[", "]"), "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(read, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), 1, most)


def action(raw: Column) -> Column:
    """The object of a JSON text as a map; null if there is none."""
    return F.from_json(_between(raw, "{", "}"), "map<string,string>")


def scopes(raw: Column) -> Column:
    """The distinct scopes of a string parted by spaces."""
    return F.array_distinct(F.filter(F.split(_said(raw), r"\s+"), lambda x: x != ""))


def canonical(arguments: Column) -> Column:
    """A flat JSON object with its keys in order, in the spacing ``{"a": 1, "b": "x"}``; ``{}`` for what can't be read."""
    entries = F.array_sort(F.map_entries(F.from_json(arguments, "map<string,string>")))
    quoted = lambda v: F.when(v.rlike(r"^(-?\d+(\.\d+)?|true|false|null)$"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    parts = F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")), F.lit("{}"))


def args_hash(arguments: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of the canonical arguments."""
    return F.substring(F.sha2(canonical(arguments), 256), 1, 16)


def tool_ref(ref: Column, prefix: str = "mcp__") -> Column:
    """struct(server, tool) of prefix + server__tool, parted at the first double underscore; null if it has another form."""
    rest = F.substring(ref, F.lit(len(prefix) + 1), F.length(ref))
    server, tool = F.regexp_extract(rest, r"^((?:(?!__).)+)__(.+)$", 1), F.regexp_extract(rest, r"^((?:(?!__).)+)__(.+)$", 2)
    return F.when(ref.startswith(prefix) & (server != ""), F.struct(server.alias("server"), tool.alias("tool")))


def published(raw: Column) -> Column:
    """The day of a date in one of the forms 2026-01-31, 2026/01/31 10:01, 31.01.2026 and Jan 31, 2026; null for others."""
    t = F.trim(raw)
    forms = (("yyyy-MM-dd", t), ("yyyy/MM/dd", F.left(t, F.lit(10))), ("dd.MM.yyyy", t), ("MMM dd, yyyy", t))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(x, F.lit(f))) for f, x in forms))
