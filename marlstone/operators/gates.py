"""Validation gates: named rules over records, kept as the array of rules that a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gated(rows: DataFrame, rules: dict[str, Column], failures: str = "failures") -> DataFrame:
    """Adds ``failures`` (names of the rules that aren't true; null counts as broken) and ``passed``."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn(failures, F.array_compact(broken)).withColumn("passed", F.size(failures) == 0)


def routed(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Records that pass, and the rejected ones with their failures."""
    judged = gated(rows, rules)
    return judged.where("passed").drop("failures", "passed"), judged.where("NOT passed").drop("passed")


def unique_extremum(rows: DataFrame, keys: list[str], value: str, item: str, largest: bool = True) -> DataFrame:
    """keys, item, ties, resolved: the extreme item of each group, resolved only where it is the only one."""
    w = Window.partitionBy(*keys)
    best = (F.max(value) if largest else F.min(value)).over(w)
    return rows.withColumn("_best", best).where(F.col(value) == F.col("_best")).groupBy(*keys).agg(F.min(item).alias(item), F.count("*").alias("ties")).withColumn("resolved", F.col("ties") == 1)


def contiguous(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Rows of groups whose indices are exactly 0 to n - 1; other groups go whole."""
    w = Window.partitionBy(*keys)
    ok = (F.min(index).over(w) == 0) & (F.max(index).over(w) == F.count("*").over(w) - 1) & (F.size(F.collect_set(index).over(w)) == F.count("*").over(w))
    return rows.withColumn("_ok", ok).where("_ok").drop("_ok")


def entailed(anchors: Column, evidence: Column) -> Column:
    """Whether the evidence has all anchors; the missing ones are array_except(anchors, evidence)."""
    return F.size(F.array_except(anchors, evidence)) == 0


def first_failure(rows: DataFrame, keys: list[str], order: str, error: str) -> DataFrame:
    """keys, failed_at, error of the earliest failing row; groups without one are valid with nulls."""
    return rows.groupBy(*keys).agg(F.min(F.when(F.col(error).isNotNull(), F.col(order))).alias("failed_at"), F.min_by(error, F.when(F.col(error).isNotNull(), F.col(order))).alias("error"))


def leaked(names: Column, text: Column) -> Column:
    """The names that occur in a text as whole words, case ignored."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.filter(names, lambda n: F.array_contains(words, F.lower(n)))


def visible_truth(visible: Column, truth: Column) -> Column:
    """Whether the visible prompt holds the truth's JSON text."""
    return F.coalesce(F.contains(visible, truth) & (F.length(truth) > 0), F.lit(False))


def idle_turn_violations(gold: Column, calls: Column) -> Column:
    """Numbers of the turns that should have no calls and have some; both are arrays of arrays of call texts."""
    bad = F.zip_with(gold, calls, lambda g, c: (F.coalesce(F.size(g), F.lit(0)) == 0) & (F.coalesce(F.size(c), F.lit(0)) > 0))
    return F.filter(F.transform(bad, lambda b, i: F.when(b, i)), lambda i: i.isNotNull())


def uniquely_recoverable(rows: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """keys, candidates, recoverable: a withheld value is recoverable if exactly one candidate is on hand."""
    return rows.groupBy(*keys).agg(F.count_distinct(candidate).alias("candidates")).withColumn("recoverable", F.col("candidates") == 1)


def alignment_deltas(a: Column, b: Column) -> Column:
    """Position by position the absolute difference of two arrays of counts; the shorter one is padded with 0."""
    return F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))


def units_allowed(quantities: Column, allowed: list[str]) -> Column:
    """Whether all quantities (structs with ``unit``) have an allowed unit."""
    return F.forall(quantities, lambda q: q["unit"].isin(allowed))


def argument_failures(arguments: Column, allowed: Column, required: Column, most_chars: int = 200) -> Column:
    """Of map<string, string> arguments: unknown, missing and overlong names, as ``kind:name``."""
    names = F.map_keys(arguments)
    tag = lambda kind, found: F.transform(found, lambda n: F.concat(F.lit(kind + ":"), n))
    return F.array_sort(F.concat(tag("unknown", F.array_except(names, allowed)), tag("missing", F.array_except(required, names)), tag("long", F.filter(names, lambda n: F.length(arguments[n]) > most_chars))))


def terminal_contract(status: Column, candidate: Column, reason: Column) -> dict[str, Column]:
    """Rules of a terminal record: a known status, a candidate exactly if it succeeded, a reason exactly if it was dropped."""
    return {
        "status": status.isin("SUCCEEDED", "DROPPED"),
        "candidate": (status == "SUCCEEDED") == candidate.isNotNull(),
        "reason": (status == "DROPPED") == reason.isNotNull(),
    }


def kept_in_order(part: Column, whole: Column) -> Column:
    """Whether the texts of ``part`` that aren't blank occur in ``whole`` in order: each is looked for behind the one found before, a missing one fails but moves nothing."""
    step = lambda a, x: F.struct(F.coalesce(F.array_position(F.slice(whole, a["at"] + 1, F.greatest(F.size(whole) - a["at"], F.lit(0))), x), F.lit(0)).cast("int").alias("hit"), a["at"].alias("at"), a["ok"].alias("ok"))
    after = lambda s: F.struct((s["at"] + s["hit"]).alias("at"), (s["ok"] & (s["hit"] > 0)).alias("ok"))
    asked = F.filter(part, lambda x: F.trim(x) != "")
    return F.aggregate(asked, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, x: F.transform(F.array(step(a, x)), after)[0])["ok"]


def preservation_audit(rows: DataFrame, category: str, part: str, whole: str) -> DataFrame:
    """category, records, exact (equal lists), kept (all that isn't blank kept in order)."""
    return rows.groupBy(category).agg(F.count("*").alias("records"), F.count_if(F.col(part) == F.col(whole)).alias("exact"), F.count_if(kept_in_order(F.col(part), F.col(whole))).alias("kept"))
