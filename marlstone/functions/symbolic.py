"""Grading of mathematical answers by form and by value.

Forms are chains of Spark's text functions. Where forms differ, both expressions are parsed (precedence climbing
over LaTeX or plain text, nothing is evaluated as code) and compared at seeded random points.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Texts written away one after the other before answers are compared by form.
LAYOUT = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
DECIMALS = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]

# Of quantitative answers, what is replaced and then what is removed.
SUBSTITUTED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]

# Units and number words of answers that are compared by value.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
SCALES = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]

#: Points at which two expressions are compared, how many must be defined, and how close values must be.
POINTS, LEAST, CLOSE = 8, 3, 1e-9
#: Longest expression that is parsed.
MOST = 500


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), pairs, text)


def last_boxed(text: Column, spaced: bool = True) -> Column:
    """What the last ``\\boxed{...}`` (else ``\\fbox{...}``) holds, at any depth of braces; null without one or where it isn't closed.

    ``spaced``: a ``\\boxed`` before a space goes first and holds what follows up to a dollar sign.
    """
    if spaced:
        tail = F.coalesce(*[F.when(F.contains(text, F.lit(x)), F.substring_index(text, x, -1)) for x in ("\\boxed", "\\fbox")])
    else:
        tail = F.when(F.contains(text, F.lit("\\boxed{")), F.concat(F.lit("{"), F.substring_index(text, "\\boxed{", -1)))

    def step(a: Column, c: Column) -> Column:
        here = a["at"] + 1
        ended = F.when((c == "}") & (a["open"] == 1), here).otherwise(0)
        return F.when(a["end"] > 0, a).otherwise(F.struct(here.alias("at"), (a["open"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("open"), ended.alias("end")))

    def inside(t: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("end"))
        closed = F.when(t.startswith("{"), F.aggregate(F.split(t, ""), start, step)["end"])
        return _let(closed, lambda end: F.when(end > 0, F.substring(t, F.lit(2), end - 2)))

    held = _let(tail, inside)
    if not spaced:
        return held
    after = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    return F.when(F.contains(text, F.lit("\\boxed ")), after).otherwise(held)


def plain_form(text: Column) -> Column:
    """An answer without layout, units and spaces, fractions and roots in braces; null where a root or fraction has nothing behind it."""
    whole = r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$"
    rules: list[Callable[[Column], Column]] = [
        lambda t: F.when(F.size(F.split(t, r"\\text\{ ")) <= 2, F.substring_index(t, "\\text{ ", 1)),  # several units have no form
        lambda t: F.regexp_replace(_replaced(t, DECIMALS), r"^\.", "0."),
        lambda t: F.when(t.rlike("^[^=]{0,2}=[^=]*$"), F.substring_index(t, "=", -1)).otherwise(t),
        lambda t: F.when(~t.rlike(r"\\sqrt(\\sqrt|$)"), F.replace(F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))),
        lambda t: F.when(t.rlike(r"\\frac(\\frac|$)"), None).when(t.rlike(r"\\frac[^{](\\frac|$)"), t).otherwise(F.regexp_replace(F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")),
        lambda t: F.when(t == "0.5", "\\frac{1}{2}").otherwise(F.regexp_replace(t, whole, r"\\frac{$1}{$2}")),
    ]
    return reduce(_let, rules, _replaced(text, LAYOUT))


def same_form(a: Column, b: Column) -> Column:
    """Whether two answers have the same plain form (the same text, if one of them has none); two nulls are the same."""
    both = F.struct(plain_form(a).alias("one"), plain_form(b).alias("other"))
    forms = _let(both, lambda x: F.when(x["one"].isNotNull() & x["other"].isNotNull(), x["one"] == x["other"]).otherwise(a == b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(forms)


def boxed_score(response: Column, gold: Column) -> Column:
    """1 if the last boxed answer has the form of ``gold``, else 0."""
    return _let(last_boxed(response), lambda held: F.when(held.isNotNull() & same_form(held, gold), 1.0).otherwise(0.0))


def quantity_form(answer: Column) -> Column:
    """A quantitative answer: what follows the last =, without words of units, wrappers and separators."""
    t = _replaced(_replaced(F.substring_index(answer, "=", -1), SUBSTITUTED), [(x, "") for x in REMOVED])
    t = F.regexp_replace(t, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for wrapper in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, rf"\\{wrapper}\{{(.*?)\}}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{(.*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    return _let(t, lambda t: F.trim(F.when(t.rlike(r"^,*[0-9][0-9,]*$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)))


def verified(response: Column, gold: Column, strict: bool = False) -> Column:
    """score (1 or -1), right and answer of a response's last 300 characters.

    Strict: the last box of its last 100 characters must be ``gold`` to the letter. Else the last ``Answer:`` line
    counts, [INVALID] without one, and quantity forms are compared.
    """
    tail = F.substring(response, -300, 300)
    if strict:
        answer, wanted = last_boxed(F.substring(tail, -100, 100), spaced=False), gold
    else:
        answer = quantity_form(F.coalesce(F.try_element_at(F.regexp_extract_all(tail, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]")))
        wanted = quantity_form(gold)

    def told(x: Column) -> Column:
        right = F.coalesce(x == wanted, F.lit(False))
        return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("right"), x.alias("answer"))

    return _let(answer, told)


TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\\([a-zA-Z]+)|([a-zA-Z]+)|(.))", re.S)
FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log, "exp": math.exp, "abs": abs}
SIGNS = {"cdot": "*", "times": "*", "div": "/", "pi": "π", "left": "", "right": "", "dfrac": "frac", "tfrac": "frac", "infty": "∞"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out = []
    for number, command, word, sign in TOKEN.findall(text):
        if number:
            out.append(("number", number))
        elif command or word:
            name = SIGNS.get(command, command) if command else word
            if name in FUNCTIONS or name == "frac":
                out.append(("function", name))
            elif name in ("pi", "π"):
                out.append(("name", "π"))
            elif len(name) == 1 and name in "*/":
                out.append(("sign", name))
            elif command and name:
                raise ValueError(f"unknown command {name}")
            else:
                out += [("name", c) for c in name]
        elif sign.strip():
            out.append(("name", sign) if sign in "π" else ("function", "sqrt") if sign == "√" else ("sign", {"·": "*", "×": "*", "−": "-", "{": "(", "}": ")"}.get(sign, sign)))
    return out


class Parser:
    """Precedence climbing to nested tuples: sums, products (also by standing side by side), signs, powers, atoms."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        found = self.peek()
        if found[0] == "end" or sign and found != ("sign", sign):
            raise ValueError(f"expected {sign or 'more'}")
        self.at += 1
        return found

    def whole(self):
        found = self.sum()
        if self.peek()[0] != "end":
            raise ValueError("more than an expression")
        return found

    def sum(self):
        left = self.product()
        while self.peek() in (("sign", "+"), ("sign", "-")):
            left = (self.take()[1], left, self.product())
        return left

    def product(self):
        left = self.signed()
        while True:
            kind, sign = self.peek()
            if (kind, sign) in (("sign", "*"), ("sign", "/")):
                left = (self.take()[1], left, self.signed())
            elif kind in ("number", "name", "function") or (kind, sign) == ("sign", "("):
                left = ("*", left, self.power())
            else:
                return left

    def signed(self):
        if self.peek() in (("sign", "-"), ("sign", "+")):
            return ("neg", self.signed()) if self.take()[1] == "-" else self.signed()
        return self.power()

    def power(self):
        base = self.atom()
        if self.peek() == ("sign", "^"):
            self.take()
            return ("^", base, self.signed())
        return base

    def argument(self):
        """What a fraction or root takes: a group, or one sign; of several digits the first one."""
        kind, text = self.peek()
        if kind == "number" and len(text) > 1:
            self.tokens[self.at] = ("number", text[1:])
            return float(text[0])
        return self.atom()

    def atom(self):
        kind, text = self.take()
        if kind == "number":
            return float(text)
        if kind == "name":
            return ("name", text)
        if kind == "function" and text == "frac":
            return ("/", self.argument(), self.argument())
        if kind == "function":
            if text == "sqrt" and self.peek() == ("sign", "["):
                self.take()
                root = self.sum()
                self.take("]")
                return ("^", self.argument(), ("/", 1.0, root))
            return ("call", text, self.atom() if self.peek() == ("sign", "(") else self.power())
        if text == "(":
            inner = self.sum()
            self.take(")")
            return inner
        raise ValueError(f"unexpected {text}")


def _evaluate(node, values: dict[str, float]) -> float:
    if isinstance(node, float):
        return node
    kind, *rest = node
    if kind == "name":
        return values[rest[0]]
    if kind == "call":
        return FUNCTIONS[rest[0]](_evaluate(rest[1], values))
    x = [_evaluate(r, values) for r in rest]
    if kind == "neg":
        return -x[0]
    if kind == "^":
        found = x[0] ** x[1]
        if isinstance(found, complex):
            raise ValueError("no real power")
        return found
    return x[0] + x[1] if kind == "+" else x[0] - x[1] if kind == "-" else x[0] * x[1] if kind == "*" else x[0] / x[1]


def same_value(a: str, b: str, seed: int = 7) -> bool:
    """Whether two expressions agree at seeded points where both are defined; anything that can't be read agrees with nothing."""
    if max(len(a), len(b)) > MOST:
        return False
    try:
        one, other = Parser(a).whole(), Parser(b).whole()
    except (ValueError, RecursionError):
        return False
    draw, names, defined = random.Random(seed), sorted(set(re.findall(r"[a-zA-Z]", a + b))), 0
    for _ in range(POINTS):
        values = {n: draw.uniform(0.2, 3.0) for n in names} | {"π": math.pi}
        try:
            x, y = _evaluate(one, values), _evaluate(other, values)
        except (ArithmeticError, ValueError, KeyError, RecursionError):
            continue
        if not (math.isfinite(x) and math.isfinite(y)):
            continue
        if abs(x - y) > CLOSE * max(1.0, abs(x), abs(y)):
            return False
        defined += 1
    return defined >= LEAST


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _without_thousands(text: str) -> str:
    while (found := re.sub(r"(\d),(\d{3})(?!\d)", r"\1\2", text)) != text:
        text = found
    return text


def _integer(text: str) -> int | None:
    value = _float(_without_thousands(text))
    return round(value) if value is not None and math.isfinite(value) and abs(value - round(value)) <= 1e-7 else None


def value_form(text: str) -> str:
    """An answer without units, wrappers and layout, in lower case, ready to be split and parsed."""
    wrapped = re.search(r"^\\text\{(.+?)\}$", text)
    text = wrapped[1] if wrapped else text
    for sign in ("\\%", "%", "\\$", "$"):
        text = text.replace(sign, "")
    for word, sign in [(" or ", " , "), (" and ", " , "), *SCALES]:
        text = text.replace(word, sign)
    for unit in UNITS:
        text = re.sub(rf"{unit}(es)?s? *(\^[0-9]+)?", "", text)
    text = re.sub(r"\^ *\\circ", "", text)
    text = text[1:-1] if text[:1] == "{" and text[-1:] == "}" else text
    text = re.sub(r",\\! *", "", text)
    if "\\" not in text and (value := _float(text)) is not None and math.isfinite(value) and abs(value - round(value)) <= 1e-7:
        text = str(round(value))
    text = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub(r"([0-9]) *\\[dt]?frac", r"\1+\\frac", re.sub(r"- *", "-", text))).lower().strip()
    whole = _integer(text)
    return str(whole) if whole is not None else text


def _parts(text: str) -> list[str]:
    text = _without_thousands(text)
    inside = len(text) > 2 and text[0] in "()[]" and text[-1] in "()[]" and not set(text[1:-1]) & set("()[]")
    return [x.strip() for x in text[1:-1].split(",")] if inside else [text] if text else []


def graded(given: str | None, gold: str | None) -> bool:
    """Whether an answer is right by value: part by part of a tuple or interval, whose ends must be the same."""
    if given is None or gold is None:
        return False
    given, gold = value_form(given), value_form(gold)
    if given == gold:
        return True
    mine, theirs = _parts(given), _parts(gold)
    if not mine or len(mine) != len(theirs) or len(theirs) > 1 and (given[0], given[-1]) != (gold[0], gold[-1]):
        return False
    for x, y in zip(mine, theirs, strict=True):
        fractions = [re.search(r"^-?[0-9]+/0*[1-9][0-9]*$", t) for t in (x, y)]
        both = f"({y})-({x})"
        letters = {c for c in re.sub(r"sqrt|frac|pi", "", both) if c.isalpha()}
        # fractions must be the same, integers stand for integers only, powers are single digits
        if all(fractions) and x != y or (_integer(x) is None) != (_integer(y) is None) or len(letters) > 2 or re.search(r"\^[{(]|\^[0-9]+\^|\^[0-9][0-9]", both):
            return False
        if x != y and not same_value(x, y):
            return False
    return True


@F.arrow_udf(BooleanType())
def _graded(given: pa.Array, gold: pa.Array) -> pa.Array:
    return pa.array([graded(a, b) for a, b in zip(given.to_pylist(), gold.to_pylist(), strict=True)], pa.bool_())


def grade(given: Column, gold: Column) -> Column:
    """Whether an answer has the form of the expected one or its value; a null answer is wrong."""
    return F.coalesce(given.isNotNull() & same_form(given, gold), F.lit(False)) | _graded(given, gold)
