"""Grading of short mathematical answers: the last boxed expression, canonical text, numeric equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Braces may nest this deep inside a boxed expression.
DEPTH = 5


def _braced(depth: int) -> str:
    return r"[^{}]*" if depth == 0 else rf"(?:[^{{}}]|\{{{_braced(depth - 1)}\}})*"


def last_boxed(text: Column) -> Column:
    """What the last ``\\boxed{...}`` or ``\\fbox{...}`` holds; null without one or where braces nest too deep."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"\\f?box(?:ed)?\s*\{{({_braced(DEPTH)})\}}"), F.lit(1)), F.lit(-1))


#: What is written away, in this order.
REWRITES = [
    (r"\\(?:left|right|displaystyle|,|!|;|:|\s)", ""),
    (r"\\(?:text|mathrm|mbox|textbf)\s*\{([^{}]*)\}", "$1"),
    (r"\\[dt]frac", r"\\frac"),
    (r"\\frac\s*([0-9])\s*([0-9])", r"\\frac{$1}{$2}"),
    (r"\\sqrt\s*([0-9a-z])", r"\\sqrt{$1}"),
    (r"\\?(?:%|\$)", ""),
    (r"\^\s*\\circ|\^\s*\{\\circ\}", ""),
    (r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", ""),
    (r"(?<![0-9])\.(?=[0-9])", "0."),
    (r"\s+", ""),
    (r"^[a-zA-Z]=", ""),
    (r"\.$", ""),
]


def canonical(text: Column) -> Column:
    """An answer without layout commands, units of layout, thousands separators and spaces."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), REWRITES, text)


def as_number(text: Column) -> Column:
    """The number that a canonical answer is: decimal, fraction a/b or \\frac{a}{b}; null for anything else."""
    t = canonical(text)
    number = r"-?[0-9]+(?:\.[0-9]+)?"
    plain = F.when(t.rlike(f"^{number}$"), t.try_cast("double"))
    slash = F.regexp_extract(t, rf"^({number})/({number})$", 1), F.regexp_extract(t, rf"^({number})/({number})$", 2)
    frac = F.regexp_extract(t, rf"^(-?)\\frac\{{({number})\}}\{{({number})\}}$", 2), F.regexp_extract(t, rf"^(-?)\\frac\{{({number})\}}\{{({number})\}}$", 3)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return F.coalesce(plain, F.try_divide(slash[0].try_cast("double"), slash[1].try_cast("double")), sign * F.try_divide(frac[0].try_cast("double"), frac[1].try_cast("double")))


def equal(answer: Column, gold: Column, tolerance: float = 1e-4, percent: bool = True) -> Column:
    """Whether two answers are the same text or number; a percentage may stand for its fraction. Null is equal to nothing.

    Symbolic equality isn't tried: expressions that differ in form only count as unequal.
    """
    a, b = as_number(answer), as_number(gold)
    close = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(y), F.lit(1e-12))
    numeric = close(a, b) | close(a, b / 100) | close(a, b * 100) if percent else close(a, b)
    return F.coalesce(canonical(answer) == canonical(gold), F.lit(False)) | F.coalesce(numeric, F.lit(False))


def score(response: Column, gold: Column, right: float = 1.0, wrong: float = 0.0) -> Column:
    """Of a response by its last boxed expression."""
    return F.when(equal(last_boxed(response), gold), right).otherwise(wrong)


def choice(text: Column) -> Column:
    """The letter of a multiple-choice answer: after ``answer``, in brackets, or alone; null without one."""
    named = F.regexp_extract(text, r"(?i)\banswer\b[^A-Za-z]{0,12}(?:is\s*)?[(\[]?([A-J])\b", 1)
    bracketed = F.try_element_at(F.regexp_extract_all(text, F.lit(r"[(\[]([A-J])[)\]]"), F.lit(1)), F.lit(-1))
    alone = F.regexp_extract(F.trim(text), r"^([A-J])[.)]?$", 1)
    return F.upper(F.coalesce(F.nullif(named, F.lit("")), bracketed, F.nullif(alone, F.lit(""))))


def cleaned_choice(text: Column) -> Column:
    """A completion task's text without bracketed notes, title marks and double spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), " {2,}", " "))
