import pytest

from marlstone.functions import symbolic as S


def column(spark, rows, f, schema="a string, b string"):
    data = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r[0] for r in data.select("k", f(data).alias("x")).orderBy("k").select("x").collect()]


def test_last_boxed(spark):
    cases = [(r"\boxed{1} and \boxed{a{b{c{d{e{f{g}}}}}}}", "a{b{c{d{e{f{g}}}}}}"), (r"\boxed 5$ more", "5"), (r"\fbox{x}", "x"), (r"\boxed{open", None), ("none", None), (None, None), (r"\boxed{}", ""), (r"\boxed x and \boxed{2}", "x and \\boxed{2}")]
    assert column(spark, cases, lambda d: S.last_boxed(d["a"])) == [w for _, w in cases]
    strict = [(r"\boxed{1}\boxed{2}", "2"), (r"\boxed 3", None), (r"\fbox{3}", None), (r"\boxed{{}", None)]
    assert column(spark, strict, lambda d: S.last_boxed(d["a"], spaced=False)) == [w for _, w in strict]


def test_plain_forms(spark):
    cases = [
        (r"\dfrac12", r"\frac{1}{2}"), (r"\tfrac{1}{2}", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), ("0.5", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}"), ("03/4", "03/4"), ("-3/4", r"\frac{-3}{4}"), ("a/b", "a/b"), ("1/2/3", "1/2/3"), (r"\sqrt3", r"\sqrt{3}"), (r"\sqrt{3}+\sqrt a", r"\sqrt{3}+\sqrt{}a"),
        ("x = 5", "5"), ("xyz=5", "xyz=5"), (r"5\text{ cm}", "5"), (r"\left( 1,2 \right)", "(1,2)"), (r"90^\circ", "90"), (r"50\%", "50"), (r"\$5", "5"), (".5x", "0.5x"), ("{.5}", "{0.5}"), ("a\nb", "ab"), ("", ""), (r"\sqrt", None), (r"\frac", None), (r"\frac1", r"\frac1"), (r"1\text{ a}\text{ b}", None), (None, None),
    ]
    assert column(spark, cases, lambda d: S.plain_form(d["a"])) == [w for _, w in cases]


def test_same_form_and_scores(spark):
    cases = [("0.5", r"\frac12", True), ("1/2", r"\dfrac{1}{2}", True), ("2", "3", False), (None, None, True), (None, "1", False), (r"\sqrt", r"\sqrt", True), (r"\sqrt", "x", False)]
    assert column(spark, cases, lambda d: S.same_form(d["a"], d["b"]), "a string, b string, w boolean") == [w for *_, w in cases]
    scored = [(r"so \boxed{\frac{3}{4}}.", "3/4", 1.0), ("no box", "1", 0.0), (None, "1", 0.0), (r"\boxed{2}", None, 0.0)]
    assert column(spark, scored, lambda d: S.boxed_score(d["a"], d["b"]), "a string, b string, w double") == [w for *_, w in scored]


def test_verified(spark):
    cases = [
        ("work\nAnswer: 1,234 dollars", "1234", True, "1234"), ("Answer: 5\nanswer : $x = \\frac12$", "frac{1}{2}", False, "\\frac{1}{2}"), ("Answer: $\\text{blue}$", "blue", True, "blue"), ("nothing", "5", False, "[INVALID]"),
        ("Answer: 7" + " " * 400, "7", False, "[INVALID]"), ("Answer: a dozen sqrt2", "dozensqrt{2}", True, "dozensqrt{2}"), (None, "1", False, "[INVALID]"),
    ]
    got = column(spark, cases, lambda d: S.verified(d["a"], d["b"]), "a string, b string, w boolean, x string")
    assert [(r["right"], r["answer"], r["score"]) for r in got] == [(w, x, 1.0 if w else -1.0) for *_, w, x in cases]
    strict = [(r"\boxed{ 5}", " 5", True), (r"\boxed{5}", "5.0", False), (r"\boxed{5}" + "x" * 100, "5", False), ("5", "5", False)]
    assert [r["right"] for r in column(spark, strict, lambda d: S.verified(d["a"], d["b"], strict=True), "a string, b string, w boolean")] == [w for *_, w in strict]


@pytest.mark.parametrize(("a", "b", "same"), [
    ("x^2+2x+1", "(x+1)^2", True), ("2x", "x*2", True), ("x(x+1)", "x^2+x", True), ("-x^2", "(-x)^2", False), ("2^3^2", "512", True), ("1/2x", "x/2", True), (r"\frac{x}{2}", "x/2", True), (r"\frac12", "0.5", True), (r"\sqrt{8}", r"2\sqrt{2}", True),
    (r"\sqrt[3]{27}", "3", True), ("√4", "2", True), (r"2\pi", "2π", True), ("sin(x)^2+cos(x)^2", "1", True), ("x", "y", False), ("x/0", "x/0", False), ("(1", "1", False), ("1 2 +", "1", False), ("ln(exp(x))", "x", True), (r"3 \cdot 4", "12", True), ("--2", "2", True), ("a" * 600, "a" * 600, False), ("(" * 3000, "(" * 3000, False),
    (r"\left(x\right)", "x", True), ("sqrt(-1-x)", "sqrt(-1-x)", False), (r"\unknown{x}", "x", False),
])
def test_same_value(a, b, same):
    assert S.same_value(a, b) is same


@pytest.mark.parametrize(("given", "gold", "right"), [
    ("1/2", "2/4", False), ("3/4", "3/4", True), ("0.5", "1/2", True), ("4", "8/2", False), ("(1, x+1)", "(1,1+x)", True), ("(1,2)", "[1,2]", False), ("[1,2]", "[1, 2]", True), ("(1,2,3)", "(1,2)", False), ("1,000", "1000", True), ("5 cm", "5", True), ("3 million", "3000000", False), (r"\text{yes}", "yes", True),
    ("x+y", "y+x", True), ("x+y+z", "z+y+x", False), ("x^{2}", "x*x", False), ("x^12", "x^6*x^6", False), ("7 3/4", "31/4", True), (r"7\frac{3}{4}", "7.75", True), ("50%", "50", True), ("5.0", "5", True), (None, "1", False), ("1", None, False), ("", "1", False), ("2sqrt(3)", "sqrt(12)", True), ("90 degrees", "90", True), (r"60^\circ", "60", True),
])
def test_graded(given, gold, right):
    assert S.graded(given, gold) is right


def test_grade_column(spark):
    cases = [("0.5", r"\frac12", True), ("x+1", "1+x", True), (None, None, False), ("2", "3", False)]
    assert column(spark, cases, lambda d: S.grade(d["a"], d["b"]), "a string, b string, w boolean") == [w for *_, w in cases]
