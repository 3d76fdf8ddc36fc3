"""Rewards from diagnostic codes, call similarity, losses and schedules as columns.

Codes: -3 parse error, -2 format error, -1 execution error, 0 wrong, 1 right.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_code(codes: Column, code: int) -> Column:
    return F.size(F.filter(codes, lambda c: c == code))


def progress(codes: Column) -> Column:
    """Right answers over judged ones; 0 where none is judged."""
    return F.coalesce(F.try_divide(n_code(codes, 1), n_code(codes, 0) + n_code(codes, 1)), F.lit(0.0))


def fixed_progress(codes: Column, expected: Column) -> Column:
    """Right answers over the expected turns; more judged turns than expected raise."""
    judged = n_code(codes, 0) + n_code(codes, 1)
    return F.when(judged > expected, F.raise_error(F.lit("more terminal turns than expected"))).otherwise(F.coalesce(F.try_divide(n_code(codes, 1), expected), F.lit(0.0)))


def format_rate(codes: Column) -> Column:
    """The share of codes that aren't parse errors; 0 of none."""
    return F.coalesce(1 - F.try_divide(n_code(codes, -3), F.size(codes)), F.lit(0.0))


def stage_one_score(codes: Column) -> Column:
    """I * (F + Q): any tool use, times the format rate plus the rate of executions without error."""
    ran = F.size(F.filter(codes, lambda c: c >= -1))
    quality = F.coalesce(F.try_divide(ran - n_code(codes, -1), ran), F.lit(0.0))
    return (ran > 0).cast("int") * (format_rate(codes) + quality)


def codes_of_counts(counts: dict[int, Column]) -> Column:
    """The code list that the counts stand for, in ascending order of codes."""
    return F.flatten(F.array(*[F.array_repeat(F.lit(code), n) for code, n in sorted(counts.items())]))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Least over greatest counts; 1 for equal lists (both empty too), 0 if one is empty."""
    values = F.array_union(a, b)
    count = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    least = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    most = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.greatest(count(a, v), count(b, v)))
    return F.when(F.size(values) == 0, 1.0).otherwise(least / most)


def call_similarity(name: Column, arguments: Column, gold_name: Column, gold_arguments: Column) -> Column:
    """0 unless names agree ignoring case; else (1 + Jaccard of argument names + equal values) / (2 + gold arguments).

    Arguments are map<string, string> of canonical JSON values.
    """
    keys, gold = F.map_keys(arguments), F.map_keys(gold_arguments)
    named = F.when((F.size(keys) == 0) & (F.size(gold) == 0), 1.0).otherwise(F.size(F.array_intersect(keys, gold)) / F.size(F.array_union(keys, gold)))
    equal = F.size(F.filter(gold, lambda k: arguments[k] == gold_arguments[k]))
    return F.when(F.lower(name) == F.lower(gold_name), (1 + named + equal) / (2 + F.size(gold))).otherwise(0.0)


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to limit - buffer, then falling by ``factor`` over the buffer."""
    return F.least(-(length - (limit - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def kl_penalty(logp: Column, reference: Column, kind: str = "k1") -> Column:
    """Estimators of the divergence of one token; k3's exponent is clamped to 20 and its result to 10."""
    d = logp - reference
    if kind == "k1":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "k2":
        return d * d / 2
    if kind == "k3":
        r = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(r) - r - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"unknown kind {kind}")


def clipped_loss(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float | None = 3.0) -> Column:
    """The clipped surrogate; with ``dual`` negative advantages are bounded too."""
    loss = F.greatest(-advantage * ratio, -advantage * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
    return loss if dual is None else F.when(advantage < 0, F.least(loss, -advantage * dual)).otherwise(loss)


def value_loss(value: Column, old: Column, target: Column, clip: float = 0.5) -> Column:
    near = F.greatest(F.least(value, old + clip), old - clip)
    return F.greatest((value - target) ** 2, (near - target) ** 2) / 2


def preference_loss(margin: Column, beta: float = 0.1, kind: str = "sigmoid") -> Column:
    """Of the chosen over the rejected answer's log-ratio margin."""
    return F.log1p(F.exp(-beta * margin)) if kind == "sigmoid" else (margin - 1 / (2 * beta)) ** 2


def warmup_cosine(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine down to ``least``."""
    share = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(least + (1 - least) * (1 + F.cos(math.pi * share)) / 2)


def unit(vector: Column) -> Column:
    """The vector at length one; null for a zero vector."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length))


def age_at(born: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, born) / 12).cast("int")


def in_market_hours(text: Column, opens: int = 570, closes: int = 960) -> Column:
    """Whether ``hh:mm AM`` lies in the closed interval of minutes; null for other texts."""
    t = F.try_to_timestamp(text, F.lit("hh:mm a"))
    return (F.hour(t) * 60 + F.minute(t)).between(opens, closes)


#: Factors to the base unit of each kind.
UNITS = {
    "distance": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mi": 1609.344, "ft": 0.3048, "in": 0.0254},
    "mass": {"kg": 1.0, "g": 0.001, "lb": 0.45359237, "oz": 0.028349523125},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.785411784},
    "speed": {"mps": 1.0, "kmh": 1 / 3.6, "mph": 0.44704},
}


def converted(value: Column, source: str, target: str) -> Column:
    """A value in another unit of the same kind; temperatures are affine."""
    temperature = {"c": (1.0, 0.0), "f": (5 / 9, -32.0), "k": (1.0, -273.15)}
    if source in temperature and target in temperature:
        (a, b), (c, d) = temperature[source], temperature[target]
        return (value + b) * a / c - d
    for factors in UNITS.values():
        if source in factors and target in factors:
            return value * factors[source] / factors[target]
    raise ValueError(f"no conversion from {source} to {target}")
