"""Texts of transcripts, calls and tools as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTION = r"(?s)<think>((?:(?!<think>).)*?)</think>\s*<(tool_call|answer)>(.*?)</\2>"


def transcript_actions(text: Column) -> Column:
    """(think, kind, body) of the successive actions of a transcript; what lies between them is skipped."""
    found = F.regexp_extract_all(text, F.lit(ACTION), F.lit(0))
    part = lambda a, k: F.regexp_extract(a, ACTION, k)
    return F.transform(found, lambda a: F.struct(part(a, 1).alias("think"), part(a, 2).alias("kind"), F.trim(part(a, 3)).alias("body")))


def _literal(v: Column) -> Column:
    return F.when(v.rlike(r"^-?\d+(\.\d+)?$") | v.isin("True", "False", "None"), v).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'")))


def call_text(name: Column, arguments: Column, canonical: bool = False) -> Column:
    """f(a=1, b='x') of a call's name and argument map; null for a call without a name. ``canonical`` sorts the arguments."""
    entries = F.map_entries(arguments)
    entries = F.array_sort(entries) if canonical else entries
    return F.when(name.isNotNull(), F.concat(name, F.lit("("), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), _literal(e["value"]))), ", "), F.lit(")")))


def after_marker(text: Column, marker: str) -> Column:
    """The JSON list behind a marker that occurs exactly once, else null."""
    parts = F.split(text, "\\Q" + marker + "\\E", -1)
    return F.when(F.size(parts) == 2, F.regexp_extract(F.element_at(parts, 2), r"(?s)^\s*(\[.*\])", 1)).otherwise(F.lit(None).cast("string"))


def ordered_tags(text: Column, tags: list[str]) -> Column:
    """A map of the bodies of top-level tags that occur once each in this order with nothing but space between, else null."""
    pattern = r"(?s)^\s*" + r"\s*".join(f"<{t}>(.*?)</{t}>" for t in tags) + r"\s*$"
    once = F.lit(True)
    for t in tags:
        once = once & (F.size(F.split(text, f"<{t}>")) == 2)
    body = F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[F.trim(F.regexp_extract(text, pattern, k + 1)) for k in range(len(tags))]))
    return F.when(text.rlike(pattern) & once, body)


def header_swapped(text: Column, marker: str, header: str) -> Column:
    """A prompt with another header before a marker; without the marker it stays."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.concat(F.lit(header), F.substr(text, at))).otherwise(text)


def outcome(result: Column, negatives: list[str]) -> Column:
    """HARD_ERROR for an error, DOMAIN_NEGATIVE for a known refusal, else SUCCESS."""
    refused = F.lit(False)
    for n in negatives:
        refused = refused | F.contains(F.lower(result), F.lit(n.lower()))
    return F.when(result.rlike(r'(?i)^\s*(?:error\b|\{\s*"error")'), F.when(refused, "DOMAIN_NEGATIVE").otherwise("HARD_ERROR")).otherwise("SUCCESS")


def dotted(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text."""
    return F.get_json_object(json, "$." + path)


def argument_errors(arguments: Column, types: dict[str, str], required: list[str]) -> Column:
    """Sorted errors of an argument map: unknown names, missing ones, values not of the type (integer, number, boolean, string)."""
    known = F.array(*[F.lit(t) for t in types])
    unknown = F.transform(F.filter(F.map_keys(arguments), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown:"), k))
    missing = F.array(*[F.when(~F.map_contains_key(arguments, r), F.lit(f"missing:{r}")) for r in required])
    forms = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?$", "boolean": "^(true|false)$", "string": r"(?s)^.*$"}
    wrong = F.array(*[F.when(~F.try_element_at(arguments, F.lit(n)).rlike(forms[t]), F.lit(f"type:{n}")) for n, t in types.items()])
    return F.array_sort(F.filter(F.concat(unknown, missing, wrong), lambda e: e.isNotNull()))


def too_complex(values: Column, most_chars: int = 200, most_items: int = 5) -> Column:
    """Whether a list of texts has too many items or one that is too long."""
    return (F.size(values) > most_items) | F.exists(values, lambda v: F.length(v) > most_chars)


def dispatched(source: Column, scorers: dict[str, Column], failure: float | None = None) -> Column:
    """The score of the source's scorer; an unknown source raises, or gets ``failure`` where that is given. A null score is a failure too."""
    other = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double") if failure is None else F.lit(failure)
    out = None
    for name, score in scorers.items():
        score = score if failure is None else F.coalesce(score, F.lit(failure))
        out = F.when(source == name, score) if out is None else out.when(source == name, score)
    return out.otherwise(other)


def at_last_token(score: Column, lengths: Column) -> Column:
    """A list of token rewards: zero but for the last valid token."""
    return F.transform(F.sequence(F.lit(1), lengths), lambda k: F.when(k == lengths, score).otherwise(0.0))


def spam_scaled(score: Column, text: Column, tag: str, most: int = 10) -> Column:
    """A quarter of the score where a tag occurs more often than ``most``."""
    return F.when(F.size(F.split(text, "\\Q" + tag + "\\E", -1)) - 1 > most, score / 4).otherwise(score)


def query_contract(text: Column, most: int, forbidden: list[str]) -> Column:
    """Failures of a user text: empty, too long, a template slot left, a forbidden phrase."""
    failures = [F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, F.lit("empty")), F.when(F.length(text) > most, F.lit("too_long")), F.when(text.rlike(r"\{\{.*?\}\}|<[A-Z_]+>"), F.lit("open_slot"))]
    failures += [F.when(F.contains(F.lower(text), F.lit(p.lower())), F.lit(f"phrase:{p}")) for p in forbidden]
    return F.filter(F.array(*failures), lambda f: f.isNotNull())
