import itertools
import re

from marlstone.llm import audit

LABELS = {"good_lost": "good", "toxic_lost": "toxic"}


def brute(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)}, order by order over all documents."""
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    rows = []
    for d, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = d is not None and any((x or "") == t and k is not None and k < d for k, x, _ in docs)
        rows.append((lang or "", fails, d in good, d in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                own = [r for r in rows if r[0] == part and r[1][f]]
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(own) - len(gone), sum(sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(rows):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows.collect()}


def audited(docs, labels, size=None):
    index = audit.bitmap_index(audit.judged(docs, labels), [*audit.FILTERS, "good", "toxic"])
    return audit.interactions(audit.survivor_counts(index, [*audit.FILTERS], ["good", "toxic"]), [*audit.FILTERS], LABELS)


long, dull = " ".join(f"w{k}" for k in range(250)), "same " * 300
DOCS = [
    (1, long, "en"), (2, long, "de"), (3, long + " #", "en"), (4, long.upper(), "en"), (5, dull, "en"), (6, dull, None), (7, None, None), (8, "", ""), (9, "", "en"),
    (9, "", "en"), (9, long, "fr"), (None, long, "en"), (None, None, "en"), (10, "A B C D #", "en"), (11, "tab\tand\x0bform\x0c" * 90, "en"), (12, "é" * 97 + "AAA", "fr"), (13, "é" * 97 + "AAAA", "fr"), (14, "x " * 60_000, "en"),
]
MARKS = [(1, 1, 0), (3, 1, 1), (3, 0, None), (4, None, 1), (9, 1, 0), (None, 1, 1), (14, 1, 1), (99, 1, 1)]


def frames(spark, docs=DOCS, marks=MARKS):
    d = spark.createDataFrame([(*x, "x", True) for x in docs], "doc_id long, text string, lang string, key string, A boolean")
    return d.repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    assert result(audited(*frames(spark))) == brute(DOCS, MARKS)


def test_small_packs(spark, monkeypatch):
    """Many packs and flushed parts give the same as one pack (run in this process, as a task would)."""
    import pyarrow as pa

    rows = audit.judged(*frames(spark)).select("part", *audit.FILTERS, "good", "toxic")
    batch = pa.Table.from_pandas(rows.toPandas()).to_batches()[0]
    found = {}

    class Rows:
        """Applies what would run in tasks to batches of two rows."""

        def __init__(self, batches):
            self.batches = batches

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return Rows(list(f(iter(self.batches))))

        def groupBy(self, *_):
            for b in self.batches:
                for r in b.to_pylist():
                    key = r.pop("part"), r.pop("chosen")
                    found[key] = [x + y for x, y in zip(found.get(key, [0, 0, 0]), r.values(), strict=True)]
            return self

        def agg(self, *_):
            return found

    monkeypatch.setattr(audit, "ROWS", 2)
    monkeypatch.setattr(audit, "PARTS", 2)
    small = audit.survivor_counts(audit.bitmap_index(Rows([batch.slice(k, 2) for k in range(0, len(batch), 2)]), [*audit.FILTERS, "good", "toxic"]), [*audit.FILTERS], ["good", "toxic"])
    index = audit.bitmap_index(rows, [*audit.FILTERS, "good", "toxic"])
    want = {(r["part"], r["chosen"]): [r["n"], r["good"], r["toxic"]] for r in audit.survivor_counts(index, [*audit.FILTERS], ["good", "toxic"]).collect()}
    assert small == want


def test_empty_tables(spark):
    docs, marks = frames(spark)
    assert audited(docs.where("false"), marks).count() == 0
    assert result(audited(docs, marks.where("false"))) == brute(DOCS, [])


def test_other_filters_and_labels(spark):
    """Any boolean columns may be filters: two of them, one label, a null counts as passed."""
    rows = spark.createDataFrame([("p", True, None, True), ("p", True, True, False), ("p", False, True, True), (None, False, False, True)], "part string, x boolean, y boolean, kept_label boolean")
    counts = audit.survivor_counts(audit.bitmap_index(rows, ["x", "y", "kept_label"]), ["x", "y"], ["kept_label"])
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["lost"], r["shapley"]) for r in audit.interactions(counts, ["x", "y"], {"lost": "kept_label"}).collect()}
    assert got["p", "xy", 1] == (1, 2, 0, 1, 1, 3) and got["p", "xy", 2] == (0, 1, 1, 1, 1, 3) and got["", "yx", 2] == (1, 0, 0, 0, 0, 0) and len(got) == 8
