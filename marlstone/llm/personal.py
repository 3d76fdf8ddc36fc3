"""Personal data: fixed patterns, and spans added by a classifier trained on weak labels; DataFrame functions only.

Candidates (long tokens with digits) get votes of regex, gazetteer, context and shape labelers, which may
abstain. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; the
resulting probabilities train a logistic span classifier on coarse features. Both see only counts by pattern,
whose number is bounded by the labelers and features, never by the corpus; the counts cover all documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone"]
#: Possessive and anchored forms of the contract's patterns: the same leftmost matches in linear time, without deep stacks.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{9,}+"
#: The gazetteer: words before a span that name what it is, in English, German, French and Spanish.
WORDS = [
    "account", "api", "auth", "bearer", "credential", "iban", "key", "licence", "license", "passport", "passwd", "password", "pin", "secret", "ssn", "tax", "token",
    "ausweis", "geheimnis", "kennwort", "konto", "kontonummer", "passwort", "reisepass", "schl\u00fcssel", "steuernummer", "zugangscode",
    "cl\u00e9", "compte", "identifiant", "jeton", "motdepasse", "passeport", "num\u00e9ro fiscal",
    "clave", "contrase\u00f1a", "cuenta", "pasaporte", "secreto", "tarjeta",
]
_MARK, _OTHER = "\u0001", "\u0002"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,hit:string,before:string>>"


def _pieces(text: Column, pattern: str, maybe: Column) -> Column:
    """What lies between matches and the matches, in turn."""
    return F.when(maybe, F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)).otherwise(F.array(F.lit("")))


def _spans(pieces: Column, kind: str, rank: int) -> Column:
    """start, rank, end (code points), kind, hit and the 32 characters before, from pieces."""
    hits = F.sequence(F.lit(2), F.size(pieces), F.lit(2))

    def add(acc: Column, i: Column) -> Column:
        gap, hit = F.element_at(pieces, i - 1), F.element_at(pieces, i)
        start = acc["at"] + F.length(gap)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(hit)).alias("end"), F.lit(kind).alias("kind"), hit.alias("hit"), F.right(gap, F.lit(32)).alias("before"))
        return F.struct((start + F.length(hit)).alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("spans"))
    return F.when(F.size(pieces) > 1, F.aggregate(hits, start, add, lambda acc: acc["spans"])).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _holds(kind: str) -> callable:
    """The test that a match must pass."""
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return lambda s: F.forall(F.split(s["hit"], r"\."), small)
    if kind == "card":
        return lambda s: F.length(_digits(s["hit"])).between(12, 19) & _luhn(_digits(s["hit"]))
    if kind == "phone":
        return lambda s: F.length(_digits(s["hit"])).between(9, 15)
    return lambda s: F.lit(True)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``base`` (spans by start, then kind) and ``doc_text`` (null as empty, the split mark replaced)."""
    text = F.col("doc_text")
    maybe = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": F.contains(text, F.lit("+"))}
    out = docs.withColumn("doc_text", F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _MARK, _OTHER))
    out = out.select("*", *[_pieces(text, PATTERNS[k], maybe[k]).alias(f"pieces_{k}") for k in KINDS])
    out = out.select(*[c for c in out.columns if not c.startswith("pieces_")], *[F.filter(_spans(F.col(f"pieces_{k}"), k, n), _holds(k)).alias(f"spans_{k}") for n, k in enumerate(KINDS)])
    return out.select(*[c for c in out.columns if not c.startswith("spans_")], F.array_sort(F.concat(*[F.col(f"spans_{k}") for k in KINDS])).alias("base"))


def candidates(found: DataFrame) -> DataFrame:
    """Adds ``extra``: candidate spans that touch no base span, each with votes and features."""
    text = F.col("doc_text")
    out = found.withColumn("pieces_x", _pieces(text, CANDIDATE, text.rlike(r"[0-9][A-Za-z0-9_+/=-]{4}")))
    out = out.withColumn("spans_x", F.filter(_spans(F.col("pieces_x"), "secret", len(KINDS)), lambda s: F.length(_digits(s["hit"])) >= 5))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return out.withColumn("extra", F.transform(F.filter("spans_x", free), _described)).drop("pieces_x", "spans_x")


def _described(s: Column) -> Column:
    hit, before = s["hit"], F.lower(s["before"])
    size, digits = F.length(hit), F.length(_digits(hit))
    hexed, plain = hit.rlike("^[0-9a-fA-F]{24,}$"), hit.rlike("^[0-9-]+$")
    named = before.rlike(r"(?U)\b(?:" + "|".join(WORDS) + r")\b[^a-z0-9]{0,6}$")
    quoted = before.rlike(r"""["'`]$""")
    assigned = before.rlike(r"""[=:]\s{0,3}["'`]?$""")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(2)
    votes = [
        vote(hexed | hit.rlike("^[A-Za-z]{2}[0-9]{2}[A-Z0-9]{11,30}$") | hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), hit.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") | hit.rlike("^[A-Za-z]{5,}-?[0-9]+$")),
        vote(named, F.lit(False)),
        vote(assigned | quoted, ~assigned & ~quoted),
        vote((size >= 20) & (digits * 5 >= size), size < 12),
    ]
    features = [hexed, plain, named, quoted, assigned, size >= 16, size >= 24, size >= 36, digits * 4 >= size, digits * 2 >= size]
    return F.struct(
        s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.when(plain, "id").otherwise("secret").alias("kind"),
        F.concat(*[v.cast("string") for v in votes]).alias("votes"), F.concat(*[F.when(f, "1").otherwise("0") for f in features]).alias("features"),
    )


def reliabilities(counts: dict[str, float], rounds: int = 60) -> dict[str, float]:
    """Expectation-maximisation over counts of vote patterns: the probability of each pattern's spans to be personal."""
    n = len(next(iter(counts), ""))
    post = {}
    for votes in counts:  # begin with the majority
        yes, no = votes.count("1"), votes.count("0")
        post[votes] = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        total = sum(counts.values())
        share = min(0.98, max(0.02, (sum(c * post[v] for v, c in counts.items()) + 1) / (total + 2)))
        seen = [[[1.0] * 3, [1.0] * 3] for _ in range(n)]
        for v, c in counts.items():
            for k, x in enumerate(v):
                seen[k][1][int(x)] += c * post[v]
                seen[k][0][int(x)] += c * (1 - post[v])
        rate = [[[x / sum(row) for x in row] for row in pair] for pair in seen]
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(rate[k][1][int(x)] / rate[k][0][int(x)]) for k, x in enumerate(v) if x != "2")
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def span_classifier(counts: dict[tuple[str, str], float], rounds: int = 400) -> list[float]:
    """Logistic weights (bias last) over features, trained on the probabilities of the vote patterns."""
    by_votes: dict[str, float] = {}
    for (votes, _), c in counts.items():
        by_votes[votes] = by_votes.get(votes, 0) + c
    post, total = reliabilities(by_votes), sum(counts.values())
    size = len(next(iter(counts))[1])
    rows: dict[str, list[float]] = {}
    for (votes, features), c in counts.items():
        row = rows.setdefault(features, [0.0, 0.0])
        row[0] += c / total
        row[1] += c * post[votes] / total
    w = [0.0] * (size + 1)
    for _ in range(rounds):
        g = [1e-3 * x for x in w]
        for features, (c, y) in rows.items():
            on = [k for k, x in enumerate(features) if x == "1"] + [size]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[k] for k in on)))))
            for k in on:
                g[k] += c * p - y
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """The span classifier of a corpus, from counts over all its documents; none without candidates."""
    found = candidates(base_spans(docs.select(F.col(f"`{text_col}`")), text_col)).select(F.explode("extra").alias("x"))
    counts = {(r.votes, r.features): float(r["count"]) for r in found.groupBy("x.votes", "x.features").count().orderBy("votes", "features").collect()}  # 3^4 * 2^10 patterns at most
    return span_classifier(counts) if counts else None


def personal_spans(docs: DataFrame, weights: list[float] | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``base`` and ``all_spans`` (arrays of start, rank, end, kind; code points, end exclusive).

    Null and empty texts have no spans. Base spans always stay; the classifier adds candidates of probability one
    half or more that touch no base span. Repeated rows are judged row by row.
    """
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = base_spans(rows, "text")
    if weights is None:
        return found.select("row.*", F.transform("base", plain).alias("base"), F.transform("base", plain).alias("all_spans"))
    *ws, bias = weights

    def chosen(s: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.substring(s["features"], k + 1, 1) == "1", F.lit(w)).otherwise(0.0) for k, w in enumerate(ws)], F.lit(bias)) >= 0

    added = candidates(found).withColumn("extra", F.transform(F.filter("extra", chosen), plain))
    return added.select("row.*", F.transform("base", plain).alias("base"), F.array_sort(F.concat(F.transform("base", plain), "extra")).alias("all_spans"))


def as_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_spans(docs, fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("all_spans").alias("spans"))


def redacted(docs: DataFrame, weights: list[float] | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    found = personal_spans(docs, weights, text_col)
    text = F.col(f"`{text_col}`")

    def add(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    whole = F.aggregate("all_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    cleaned = F.when(F.size("all_spans") > 0, whole).otherwise(text)
    return found.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; every document stays."""
    return redacted(docs, fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def brute_force(text: str | None) -> dict:
    """The contract's base spans read literally, for tests."""
    import re

    text = text or ""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d: str) -> bool:
        return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    out = []
    for n, k in enumerate(KINDS):
        for m in re.finditer(patterns[k], text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), n, m.end(), k))
    return {"spans": ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))} | {f"n_{k}": sum(x[3] == k for x in out) for k in KINDS}
