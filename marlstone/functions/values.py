"""Values of rows: rewards, losses, spans, arithmetic, comparable texts, sequences and argument checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn_score(expected: Column, answered: Column, state_equal: Column, response_equal: Column) -> Column:
    """-1 without expected calls, 0 without an answer or with a wrong state or response, else 1."""
    return F.when(~expected, -1.0).when(answered & state_equal & response_equal, 1.0).otherwise(0.0)


def kl_shaped(score: Column, penalty: Column, beta: float, mask: Column) -> Column:
    """Token reward less beta times the KL penalty on response tokens."""
    return score - beta * penalty * mask


def ratio_reward(score: Column, logp: Column, reference: Column, ratio: float) -> Column:
    return score - (logp - reference) * ratio


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of a list of logits."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + x * F.exp(x - top)) / z
    return top + F.log(z) - mean


def log_probability(logits: Column, token: Column) -> Column:
    """Log probability of a token (from 0) under the softmax of a list of logits."""
    top = F.array_max(logits)
    return F.get(logits, token) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def squared_preference_loss(logp: Column, reference: Column, score: Column, eta: float) -> Column:
    """(log ratio - eta * (score - one half)) squared."""
    return F.pow(logp - reference - eta * (score - 0.5), 2)


def reward_cross_entropy(score: Column, label: Column, beta: float) -> Column:
    """Binary cross entropy of a scaled score, in its stable form."""
    x = score * beta
    return F.greatest(x, F.lit(0.0)) - x * label + F.log1p(F.exp(-F.abs(x)))


def same_sign(score: Column, label: Column) -> Column:
    """1 where the score is on the label's side of zero (label 0 or 1)."""
    return (F.signum(score) == F.signum(label * 2.0 - 1)).cast("double")


def clip_fraction(ratio: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """1 where a probability ratio is outside its clip range."""
    return ((ratio < 1 - low) | (ratio > 1 + high)).cast("double")


def span_or_null(start: Column, end: Column, length: Column) -> Column:
    """(start, end) where 0 <= start < end <= length, else null."""
    return F.when((start >= 0) & (start < end) & (end <= length), F.struct(start.alias("start"), end.alias("end")))


def relative_span(start: Column, end: Column, prompt: Column, response: Column) -> Column:
    """start, end (clipped to the response) and reliable (it lay wholly inside and isn't empty)."""
    a, b = start - prompt, end - prompt
    return F.struct(F.greatest(a, F.lit(0)).alias("start"), F.least(b, response).alias("end"), ((a >= 0) & (a < b) & (b <= response)).alias("reliable"))


def calculated(a: Column, b: Column, operation: str) -> Column:
    """(result, error) of an arithmetic tool; division by zero is an error."""
    forms = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b), "power": F.pow(a, b), "abs": F.abs(a), "round": F.bround(a, 2)}
    error = F.when(b == 0, "Cannot divide by zero") if operation == "divide" else F.lit(None).cast("string")
    return F.struct(forms[operation].cast("double").alias("result"), error.alias("error"))


def exchanged(value: Column, direct: Column, inverse: Column) -> Column:
    """By the direct rate, else by the inverse one rounded to two digits, else null."""
    return F.when(direct.isNotNull(), value * direct).otherwise(F.bround(value / inverse, 2))


def comparable(text: Column) -> Column:
    """number, at (time): what a text compares as; ISO times or month/day/year."""
    at = F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")), F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy"))))
    return F.struct(F.when(text.rlike(r"^\s*[-+]?\$?[\d,]*\.?\d+\s*$"), F.regexp_replace(text, r"[\s$,]", "").try_cast("double")).alias("number"), at.alias("at"))


def contains_answer(answer: Column, golds: Column) -> Column:
    """Whether a normal answer contains any of the normal gold answers."""
    return F.exists(golds, lambda g: F.contains(answer, g))


def sub_match_score(answer: Column, golds: Column, score: float = 1.0, form: float = 0.0) -> Column:
    """0 without an answer, the full score where it contains a gold answer, else the score of its form."""
    return F.when(answer.isNull(), 0.0).when(contains_answer(answer, golds), score).otherwise(form)


def geometry_score(text: Column, right: Column, weight: float = 0.9) -> Column:
    """Accuracy and format mixed: thoughts in their tags followed by a boxed answer."""
    formed = text.rlike(r"(?s)^\s*<think>.*</think>.*\\boxed\{.*\}.*$")
    return weight * right.cast("double") + (1 - weight) * formed.cast("double")


def char_count_score(answer: Column, gold: Column) -> Column:
    """1 where the boxed answer is the gold one as text, else 0; null counts as wrong."""
    return F.coalesce((F.trim(answer) == F.trim(gold)).cast("double"), F.lit(0.0))


_NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()


def number_mentioned(number: Column, text: Column) -> Column:
    """A whole number in a text: in digits (thousands marked or not, ordinal or not) or, up to twelve, in words."""
    shown = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?<![0-9.,])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:st|nd|rd|th)?(?![0-9]|[.,][0-9])"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    word = F.when((number >= 0) & (number < len(_NUMBER_WORDS)), F.get(F.array(*[F.lit(w) for w in _NUMBER_WORDS]), number.cast("int")))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))
    return F.array_contains(shown, number.cast("long").cast("string")) | F.coalesce(F.array_contains(words, word), F.lit(False))


def singular(token: Column) -> Column:
    """A token without its plural ending: -ies to -y, -sses to -ss, else one -s less (not -ss)."""
    low = F.lower(token)
    return (
        F.when(low.rlike("^.{2,}ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(low, "es$", ""))
        .when(low.rlike("^.{3,}[^s]s$"), F.regexp_replace(low, "s$", "")).otherwise(low)
    )


def leaks_name(text: Column, name: Column) -> Column:
    """A function's name in a text: as it is, or its parts as words."""
    words = F.regexp_replace(name, "_+", " ")
    return F.contains(F.lower(text), F.lower(name)) | (F.contains(name, F.lit("_")) & F.contains(F.lower(text), F.lower(words)))


def truncated(ids: Column, most: int, side: str = "left") -> Column:
    """At most so many ids: without the left, right or middle ones too many, or an error."""
    n = F.size(ids)
    cut = {
        "left": F.slice(ids, F.greatest(n - most + 1, F.lit(1)), most), "right": F.slice(ids, 1, most),
        "middle": F.concat(F.slice(ids, 1, most // 2), F.slice(ids, F.greatest(n - (most - most // 2) + 1, F.lit(1)), most - most // 2)),
        "error": F.when(n <= most, ids).otherwise(F.raise_error(F.lit(f"more than {most} ids")).cast("array<int>")) if side == "error" else None,
    }[side]
    return cut if side == "error" else F.when(n <= most, ids).otherwise(cut)


def padded_to(ids: Column, length: int, pad: int, left: bool = True) -> Column:
    """Ids up to a length."""
    more = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(more, ids) if left else F.concat(ids, more)


def without_padding(ids: Column, mask: Column) -> Column:
    """The last ids, as many as the mask counts."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    return F.slice(ids, F.size(ids) - n + 1, n)


def content_segments(text: Column) -> Column:
    """(type, text) of a message's parts: <image> and <video> marks apart from the text between."""
    parts = F.filter(F.split(text, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(p.isin("<image>", "<video>"), F.lit(None)).otherwise(p).alias("text")))


def first_tool_score(name: Column, arguments: Column, gold_name: Column, gold_arguments: Column) -> Column:
    """0 for another tool, 1 where all gold arguments are given with equal values, else one half if all are given."""
    given = F.forall(F.map_keys(gold_arguments), lambda k: F.map_contains_key(arguments, k))
    equal = F.forall(F.map_entries(gold_arguments), lambda e: F.element_at(arguments, e["key"]).eqNullSafe(e["value"]))
    return F.when(~name.eqNullSafe(gold_name), 0.0).when(given & equal, 1.0).when(given, 0.5).otherwise(0.0)


def schedule(step: Column, kind: str, warmup: int, total: int, stable: float = 0.9, least: float = 0.0) -> Column:
    """Learning-rate ratio: constant, or warm-up, stable part and decay by a half cosine (wsd)."""
    ramp = step / float(max(1, warmup))
    if kind == "constant":
        return F.when(step < warmup, ramp).otherwise(1.0)
    held = int(stable * (total - warmup)) + warmup
    along = (step - held) / float(max(1, total - held))
    return F.when(step < warmup, ramp).when(step < held, 1.0).when(step < total, least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * along))).otherwise(least)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the unmasked token vectors."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    total = F.aggregate(kept, F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(kept))


def flat_merge(base: Column, patch: Column) -> Column:
    """Two maps; the patch's values win where they aren't null."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(patch, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
