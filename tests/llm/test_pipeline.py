"""The stages of the corpus pipeline on a small table with odd rows."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontaminate, neardup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_what_they_should(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    item = max(items, key=lambda r: len(r["text"] or ""))["text"]
    base = words(200)
    texts = [base, base, base + " more", None, "", "one", words(8000), item, words(30) + " mail a.b@c.example today", base.upper()]
    rows = [(1000 + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5]], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]
    for name in list(stages)[:-1]:
        got = stages[name](spark, docs, SF)
        assert got.columns == docs.columns
        kept = {r.doc_id: r.text for r in got.collect()}
        if name == "near_duplicates":
            want = neardup.brute_force([r[:2] for r in rows], neardup.STAGE_PERCENT)
            assert set(kept) == {d for d, v in want.items() if v[2]}
        elif name == "decontamination":
            want = decontaminate.brute_force([r[:2] for r in rows], [(r["item_id"], r["text"]) for r in items])
            assert set(kept) == {d for d, v in want.items() if not v[-1]} and 1007 not in kept
        elif name == "personal_data":
            assert set(kept) == {r[0] for r in rows} and kept[1003] is None and kept[1000] == base and "a.b@c" not in kept[1008]
        else:
            assert {1000, 1004, 1005, 1006} <= set(kept)
    last = stages["sentencepiece"](spark, docs, SF).collect()
    assert len(last) == len(rows) + 1 and all(r.n_tokens == len(r.token_ids) for r in last)
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), SF).count() == 0


def test_another_text_of_a_dropped_id_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (None, a, "en", "s", 1)], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in neardup.stage(spark, docs, SF).collect()) == sorted([(1, a), (5, b), (0, a)])


def test_toxicity_keeps_a_column_named_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(7.0))
    kept = toxicity.stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and {r.score for r in kept.collect()} == {7.0}
