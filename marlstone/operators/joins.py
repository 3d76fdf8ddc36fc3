"""Joins of runs: paired differences, pair agreement, intervals, latest prior matches, multisets, assignments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import map_groups


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value_a, value_b, difference over keys in both; the last row of a key (by ``order``) counts."""
    last = lambda d, n: d.groupBy(key).agg(F.max_by(value, order).alias(f"{value}_{n}"))
    return last(a, "a").join(last(b, "b"), key).withColumn("difference", F.col(f"{value}_b") - F.col(f"{value}_a"))


def positional(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """Rows of equal number side by side; shared columns must agree and counts match, else it raises."""
    shared = [c for c in b.columns if c in a.columns and c != row]
    right = b.select(row, *[F.col(c).alias(f"_b_{c}") for c in shared], *[c for c in b.columns if c not in a.columns], F.lit(True).alias("_b"))
    both = a.withColumn("_a", F.lit(True)).join(right, row, "full_outer")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in shared:
        ok &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return both.where(F.when(ok, True).otherwise(F.raise_error(F.lit("rows don't match")))).drop("_a", "_b", *[f"_b_{c}" for c in shared])


def required(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of wanted keys; a wanted key without rows raises."""
    found = wanted.select(key).distinct().join(rows.withColumn("_there", F.lit(True)), key, "left")
    return found.where(F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("missing key "), F.col(key).cast("string"))))).drop("_there")


def pair_agreement(rows: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """group, pairs, agreement: how often a and b order two items alike, weighted by the gap in a."""
    left, right = rows.select(group, F.col(item).alias("i"), F.col(a).alias("a1"), F.col(b).alias("b1")), rows.select(group, F.col(item).alias("j"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    pairs = left.join(right, group).where("i < j")
    gap = F.abs(F.col("a1") - F.col("a2"))
    same = F.signum(F.col("a1") - F.col("a2")) == F.signum(F.col("b1") - F.col("b2"))
    return pairs.groupBy(group).agg(F.count("*").alias("pairs"), F.try_divide(F.sum(F.when(same, gap).otherwise(0.0)), F.sum(gap)).alias("agreement"))


def winner_loser(rows: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """group, winner, loser, margin of the best two; ties go to the smaller item."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item))).where("_n <= 2")
    out = ranked.groupBy(group).agg(F.max(F.when(F.col("_n") == 1, F.col(item))).alias("winner"), F.max(F.when(F.col("_n") == 2, F.col(item))).alias("loser"), (F.max(F.when(F.col("_n") == 1, F.col(score))) - F.max(F.when(F.col("_n") == 2, F.col(score)))).alias("margin"))
    return out.where("loser IS NOT NULL")


def in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside half-open spans of the same key.

    Spans are dealt to cells of ``width``, so the join is on (key, cell) and no key's points meet all its spans.
    """
    cells = spans.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, [key, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def latest_prior(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the latest value before each row that isn't null, in one window and without a self-join."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(before))


def multiset_missing(wanted: DataFrame, given: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Wanted values that aren't given, each given one consumed once: keys, value, missing."""
    w, g = wanted.groupBy(*keys, value).agg(F.count("*").alias("_w")), given.groupBy(*keys, value).agg(F.count("*").alias("_g"))
    return w.join(g, [*keys, value], "left").withColumn("missing", F.col("_w") - F.coalesce("_g", F.lit(0))).where("missing > 0").drop("_w", "_g")


def optimal_assignment(pairs: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """keys, left, right, weight: in each group the one-to-one matching of the greatest total weight.

    Pairs of weight 0 or less are never matched. A group is one user turn, whose calls are few by nature. The
    algorithm is successive shortest augmenting paths with potentials.
    """

    def solve(key: tuple, found: list[tuple]) -> Iterator[tuple]:
        rows, cols = sorted({r[0] for r in found}), sorted({r[1] for r in found})
        n, m = len(rows), max(len(cols), len(rows))
        at_row, at_col = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
        cost = [[0.0] * m for _ in range(n)]
        for x, y, w in found:
            cost[at_row[x]][at_col[y]] = min(cost[at_row[x]][at_col[y]], -max(0.0, float(w)))
        of_col = _least_cost(cost)
        for j in range(len(cols)):
            if of_col[j] is not None and cost[of_col[j]][j] < 0:
                yield (*key, rows[of_col[j]], cols[j], -cost[of_col[j]][j])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in [*keys, left, right])
    return map_groups(pairs.where(F.col(weight).isNotNull()), keys, [left, right, weight], solve, f"{kinds}, {weight} double")


def _least_cost(cost: list[list[float]]) -> list[int | None]:
    """The row of each column in an assignment of least cost; as many columns as rows at least."""
    n, m, far = len(cost), len(cost[0]), float("inf")
    of_row, of_col = [0.0] * n, [0.0] * m
    match: list[int | None] = [None] * m
    for start in range(n):
        distance, via, done = [far] * m, [None] * m, [False] * m
        row, column, shift = start, None, 0.0
        while row is not None:
            nearest = None
            for j in range(m):
                if not done[j]:
                    d = shift + cost[row][j] - of_row[row] - of_col[j]
                    if d < distance[j]:
                        distance[j], via[j] = d, column
                    if nearest is None or distance[j] < distance[nearest]:
                        nearest = j
            column, shift = nearest, distance[nearest]
            done[column] = True
            row = match[column]
        for j in range(m):
            if done[j]:
                if match[j] is not None:
                    of_row[match[j]] += shift - distance[j]
                of_col[j] -= shift - distance[j]
        of_row[start] += shift
        while column is not None:
            before = via[column]
            match[column] = start if before is None else match[before]
            column = before
    return match


def reconciled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, status: both, missing (in a only) or extra (in b only)."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both").alias("status"))
