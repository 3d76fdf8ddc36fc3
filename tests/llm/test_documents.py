"""The document operators on small fixtures with odd rows, against brute force."""

import hashlib
import random

import pytest

from marlstone.llm import decontaminate, neardup, passages, personal, pieces, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, doc_text string, score double, gone string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def fixture():
    rng = random.Random(5)
    base, other, passage = words(rng, 300), words(rng, 120), words(rng, 60)
    edited = base.split()
    edited[40] = "changed"
    twice = edited[:]
    twice[200] = "again"
    texts = [base, base, " ".join(edited), " ".join(twice), base.upper(), other, None, "", " \n\t", "one two", "one two", "ONE  two", "a", words(rng, 30) + " " + passage, passage + " " + words(rng, 30), words(rng, 80), "ä" * 60, "ä" * 49 + " x", "x" * 500, "x" * 20000, words(rng, 6000), "\x00\x01" + other[:80]]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, "r", "d", "t", 0.5, "g") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, fixture()).repartition(3)


def test_substrings_equal_brute_force(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.substring_dedup(docs).collect()}
    assert got == suffixes.brute_force(fixture())


def test_substrings_of_repeated_rows_and_no_ids(spark):
    text = "abcdefghij" * 8
    got = suffixes.substring_dedup(frame(spark, [(2, text), (2, text), (None, text), (3, text + "z")])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (2, 0), (2, 0), (3, 80)]
    assert all(r.kept == text.encode() for r in got if r.doc_id == 2)


def test_substrings_over_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    data = bytes(random.Random(3).randrange(97, 100) for _ in range(3000)).decode()
    rows = [(1, data), (2, data[700:1500] + "q" + data[100:160]), (3, data[30:90])]
    texts = [t.encode() for _, t in rows]
    import numpy as np

    spans = suffixes.stretches(np.frombuffer(texts[0], dtype=np.uint8), np.full(len(texts[0]), len(texts[0])))
    assert sum(spans[3] - spans[2] + 1) == len(texts[0]) - 49


def test_near_duplicates_equal_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == neardup.brute_force(fixture())


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(11)
    base, rows = words(rng, 150).split(), []
    for d in range(60):
        w = base[:]
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, words(rng, 90)) for d in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == neardup.brute_force(rows)


def test_near_duplicates_of_eighty_percent_in_the_stage(spark):
    rng, rows = random.Random(80), []
    for k in range(6):
        w = words(rng, 200, 4000).split()
        edited = w[:]
        for at in (30, 70, 110, 150):
            edited[at] = "edit"  # 176 of 216 shingles: 0.815
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(edited))]
    want = neardup.brute_force(rows, 80)
    assert not any(want[2 * k + 1][2] for k in range(6))
    assert {r.doc_id for r in neardup.stage(spark, frame(spark, rows), "").collect()} == {d for d, v in want.items() if v[2]}
    assert all(v[2] for v in neardup.brute_force(rows).values()) and [neardup.shared_least(p, n) for p in (80, 85) for n in (32, 128)] == [13, 79, 16, 87]


def test_passages_cover_repeats_and_spare_others(docs):
    rows = fixture()
    got = {r.doc_id: r.class_id for r in passages.passage_classes(docs).collect()}
    want = passages.brute_force([r for r in rows if r[0] not in (20,)])
    assert {d: c for d, c in got.items() if d in want} == want and got[20] == 20


def test_passages_lose_no_pair(spark):
    """Pairs at the threshold, a third of them around a line that all these have; signatures by chance lost one of the 600."""
    rng = random.Random(29)
    line, rows = words(rng, 12), []
    for k in range(600):
        w = words(rng, 50, 100_000).split()
        if k % 3 == 0:
            w[:12] = line.split()
        y = w[:]
        y[rng.randrange(13, 45)] = "changed"
        rows += [(2 * k, words(rng, 8, 100_000) + " " + " ".join(w)), (2 * k + 1, " ".join(y) + " " + words(rng, 8, 100_000))]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(frame(spark, rows)).collect()}
    assert [d for d, c in got.items() if c != d - d % 2] == []


def test_alike_passages_share_a_first_token():
    """Also passages that repeat tokens, whatever the order: one has the token among those that count, and not both ask."""
    rng = random.Random(31)
    alone = 0
    for trial in range(400):
        w = words(rng, 50, (4, 12, 5000)[trial % 3]).split()
        if trial % 2:
            w[20:] = (w[20 - trial % 7 : 20] * 40)[:30] if trial % 7 else w[20:]
        y = w[:]
        y[rng.randrange(50)] = "changed"
        if trial % 4 == 0:
            y = y[trial % 6 :] + y[: trial % 6]
        x, y = (passages.rolling(passages.Words().numbers([" ".join(t).encode()])[0], passages.SIZE) for t in (w, y))
        if not 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
            continue
        alone += 1
        order = passages.Order(passages.np.unique(x)[::5])
        seen = []
        for t in (x, y):
            parts = list(passages.compact_windows(t, passages.np.full(len(t), len(t) - 1), order.of(t), 80))
            seen.append({(s, a) for signature, _, _, _, asks in parts for s, a in zip(signature.tolist(), asks.tolist(), strict=True)})
        assert any((s, False) in seen[1] or (not a and (s, True) in seen[1]) for s, a in seen[0])
    assert alone > 50


def test_passages_alike_at_any_start():
    rng = random.Random(17)
    numbers = lambda text: passages.rolling(passages.Words().numbers([text.encode()])[0], passages.SIZE)
    for trial in range(60):
        w = words(rng, 52 - trial % 3).split()
        edited = w[:]
        if trial % 2:
            edited[rng.randrange(len(w))] = "edit"
        elif trial % 4:
            edited.insert(25, "more")
        one, two = (" ".join([words(rng, rng.randrange(60)), *v, words(rng, rng.randrange(60))]) for v in (w, edited))
        if trial % 5 == 0:
            one, two = "ä " * rng.randrange(40, 60) + one[:60], one[:30] + " ä" * rng.randrange(40, 60)
        x, y = numbers(one), numbers(two)
        want = passages.brute_force([(1, one), (2, two)])[2] == 1
        for offsets in ([], [0, 7]):
            at = passages.alike(x, y, offsets, 80)
            assert (at is not None) == want
            if at:
                p, q = set(x[at[0] : at[0] + passages.SPAN].tolist()), set(y[at[1] : at[1] + passages.SPAN].tolist())
                assert 100 * len(p & q) >= 80 * len(p | q)


def test_passages_of_fifty_words_with_one_edit(spark):
    rng, rows = random.Random(50), []
    for k in range(40):
        w = words(rng, 50, 4000).split()
        edited = w[:]
        edited[20] = "edit"
        rows += [(2 * k + c, " ".join([words(rng, 40, 4000), *v, words(rng, 40, 4000)])) for c, v in enumerate((w, edited))]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(frame(spark, rows)).collect()}
    want = passages.brute_force(rows)
    assert sum(want[d] != d for d in want) == 40
    assert sum(got[d] == want[d] for d in want if want[d] != d) >= 39 and all(got[d] in (d, want[d]) for d in want)


def test_decontamination_equals_brute_force(spark, docs):
    rng = random.Random(5)
    texts = dict(fixture())
    items = [(1, " ".join(texts[0].split()[50:80])), (2, "One, TWO!"), (3, None), (4, ""), (5, words(rng, 40) + " unique end"), (10, " ".join(texts[5].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    digest = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, digest(r["items"]), r.contaminated) for r in found.collect()}
    want = decontaminate.brute_force(fixture(), items)
    assert got == want
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[-1]}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = [(k, " ".join(dict(fixture())[0].split()[k * 20 : k * 20 + 25])) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()} == whole
    empty = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(empty) == len(fixture()) and all(r.n_hit == 0 and not r.contaminated for r in empty)


PERSONAL = [
    "mail a.b+c@mail.example.co.uk, x@y, a@b.c_x@y.z and .@x.y", "10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 001.2.3.004 99999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 12345678901",
    "+1 (017) 555-7713 +49 30 1234567- +1 23 +123456789012345678", "\u0001\u0001 ä\u0001 a@b.cd é +44 (20) 7946-0958", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and key: 9f86d081884c7d659a2feaa0c55ad015', None, "", "9" * 3000, "a." * 2000 + "@", "x" * 50000 + "@y.zz", "1 " * 4000, "no data here, 2024-01-01 or chapter12345",
]


def test_personal_data_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    weights = personal.fit(docs)
    got = personal.personal_spans(docs, weights).withColumn("b", personal.as_text("base")).withColumn("s", personal.as_text("all_spans")).collect()
    for r in got:
        want = personal.brute_force(PERSONAL[r.doc_id])
        assert r.b == want["spans"]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    by = {r.doc_id: r.s for r in got}
    assert by[5].count("secret:") == 2 and by[12] == ""
    clean = {r.doc_id: r.text for r in personal.redacted(docs, weights).collect()}
    assert clean[0].startswith("mail [EMAIL], x@y, [EMAIL]") and clean[6] is None and "04dbebab" not in clean[5] and clean[12] == PERSONAL[12]
    assert personal.fit(docs.limit(0)) is None and personal.personal_spans(docs.limit(0), None).count() == 0


def test_digits_late_in_a_token_are_candidates(spark):
    token = "a" * 70 + "3f9c1b7d5e2a4086" * 2
    texts = ['key: "' + token + '"', 'key: "' + token[:60] + token[-32:] + '"'] + PERSONAL
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = personal.candidates(personal.base_spans(docs, "text")).select("doc_id", "extra").collect()
    assert [len(r.extra) for r in sorted(found)[:2]] == [1, 1]


def test_weak_labels_find_the_reliable_labeler():
    post = personal.reliabilities({"1112": 40, "0002": 40, "1102": 5, "0012": 5, "2221": 1})
    assert post["1112"] > 0.9 and post["0002"] < 0.1


def test_pieces_equal_the_library(spark, docs):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.model_path())
    texts = dict(fixture())
    rows = pieces.tokenized(docs, pieces.model_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pieces_on_random_strings():
    from sentencepiece import SentencePieceProcessor

    sp, codec = SentencePieceProcessor(model_file=pieces.model_path()), pieces.Codec(pieces.Vocabulary(pieces.model_path()))
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice("abcdehtionrs  ▁\n.,019éüß中\x00😀") for _ in range(rng.randrange(60)))
        assert codec.encode(text) == sp.encode(text, add_eos=True) and codec.decode(codec.encode(text)) == sp.decode(sp.encode(text))


def test_toxicity_learns_markers_and_never_sees_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 40) + (" vile scum" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(labelled)
    fresh = spark.createDataFrame([(1, words(rng, 50) + " vile scum", 7.0), (2, words(rng, 50), 7.0), (3, None, 7.0), (4, "", 7.0), (4, "", 7.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.scored(fresh, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] < 0.5
    none = toxicity.fit(labelled.limit(0))
    assert {r.score for r in toxicity.scored(fresh, none).collect()} == {0.5}
    assert toxicity.scored(fresh.limit(0), model).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, 2100) + (" vile scum" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(120)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame([(1, words(rng, 50) + " vile scum"), (2, words(rng, 50))], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > got[2]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert suffixes.substring_dedup(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert passages.passage_classes(empty).count() == 0
    assert pieces.tokenized(empty, pieces.model_path()).count() == 0


def test_rows_without_ids(spark):
    rows = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (0, None)])
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect() if r.doc_id is not None)
    assert got == [(False, 0, 0, True), (False, 1, 1, True)]
    assert all(r.kept and r.component_id is None for r in neardup.near_duplicates(rows).where("doc_id IS NULL").collect())


def test_passages_with_a_word_substituted_inserted_or_deleted(spark):
    rng, rows = random.Random(51), []
    for k in range(90):
        w = words(rng, 50, 4000).split()
        edited, at = w[:], rng.randrange(12, 38)
        if k % 3 == 0:
            edited[at] = "edit"
        elif k % 3 == 1:
            edited.insert(at, "edit")
        else:
            edited = edited[:at] + edited[at + 1 :] + ["tail"]
        rows += [(2 * k + c, " ".join([words(rng, 40, 4000), *v, words(rng, 40, 4000)])) for c, v in enumerate((w, edited))]
    texts = dict(rows)
    want = [k for k in range(90) if passages.brute_force([(0, texts[2 * k]), (1, texts[2 * k + 1])])[1] == 0]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(frame(spark, rows)).collect()}
    assert len(want) > 80 and sum(got[2 * k + 1] == 2 * k for k in want) >= 0.93 * len(want)
    assert all(got[d] in (d, d - 1) for d in got)


def test_passages_whose_signatures_smaller_documents_take(spark):
    rng, rows = random.Random(52), []
    for k in range(0, 80, 4):
        w = words(rng, 60, 4000).split()
        parts = (w[:40], w[20:], w, w)  # the first two share too little with any other one
        rows += [(k + c, " ".join([words(rng, 30, 4000), *p, words(rng, 30, 4000)])) for c, p in enumerate(parts)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.passage_classes(frame(spark, rows)).collect()}
    assert all(got[k] == (k, 0) and got[k + 1] == (k + 1, 0) and got[k + 3] == (k + 2, 1) for k in range(0, 80, 4))


def test_ftrl_equals_a_plain_loop():
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, 8, replace=False)).astype(np.int32), int(k % 3 == 0)) for k in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 1.0
    z, n, order = {}, {}, np.random.default_rng(7)  # None is the bias, without penalties

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i is None:
            return -zi / ((beta + math.sqrt(ni)) / alpha)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(2):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            on = [*x.tolist(), None]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in on:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    kept, got, bias = toxicity.ftrl(rows, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    want = {i: weight(i) for i in z if i is not None and weight(i)}
    assert set(kept.tolist()) == set(want) and all(abs(want[i] - v) < 1e-9 for i, v in zip(kept.tolist(), got, strict=True)) and abs(bias - weight(None)) < 1e-9


def test_held_out_labels_change_no_score(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    import zlib

    for r in labels:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            r["toxic"] = 1 - r["toxic"] if r["toxic"] is not None else 1
    pq.write_table(pa.Table.from_pylist(labels), tmp_path / "labels.parquet")
    pq.write_table(pq.read_table(f"{sf}/documents.parquet"), tmp_path / "documents.parquet")
    scores = lambda at: {r.doc_id: r.score for r in toxicity.query(spark, str(at)).collect()}
    assert scores(sf) == scores(tmp_path)


def test_pairs_without_a_rich_passage_are_left_out_together():
    """Of many pairs at once just those stay that the comparison of one pair would go on with, and every alike one."""
    rng, span = passages.np.random.default_rng(7), passages.SPAN
    parts, want, alike = [], [], []
    for k in range(150):
        x = rng.integers(0, int(rng.choice([30, 200, 10**6])), int(rng.integers(span, 3 * span))).astype(passages.np.uint64)
        y = x[int(rng.integers(0, len(x) - span + 1)) :].copy()
        other = rng.random(len(y)) < rng.choice([0, 0.05, 0.15, 0.5])
        y[other] = rng.integers(0, 10**6, other.sum())
        sides = [(t, passages.np.arange(len(t)) + 7 * (passages.np.arange(len(t)) > 2 * span)) for t in (x, y)]
        real = [at[span - 1 :] - at[: len(at) - span + 1] == span - 1 for _, at in sides]
        before = [passages._earlier(t) for t, _ in sides]
        rich = [(100 * passages._distinct(b, passages.np.isin(t, u)) >= 80 * passages._distinct(b)) & r for b, t, u, r in zip(before, (x, y), (y, x), real, strict=True)]
        parts.append([c for t, at in sides for c in (t, k << 32 | at)])
        want.append(all(r.any() for r in rich))
        alike.append(passages.alike(x, y, [], 80, *real) is not None)
    got = passages.possible(*(passages.np.concatenate(c) for c in zip(*parts, strict=True)), len(parts), 80).tolist()
    assert got == want and all(g for g, a in zip(got, alike, strict=True) if a) and 0 < sum(alike) < len(alike) and not all(got)


def test_sketches_turn_away_no_alike_windows():
    rng, span, np = passages.np.random.default_rng(5), passages.SPAN, passages.np
    windows = []
    for k in range(150):
        x = rng.integers(0, 2**63, int(rng.integers(span, 2 * span))).astype(np.uint64)
        x = x[rng.integers(0, 9, len(x))] if k % 5 == 0 else x  # repeats tokens
        y = x.copy()
        y[rng.integers(0, len(y), int(rng.integers(0, 12)))] = rng.integers(0, 2**63)
        windows += [x, y]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
    told = passages.bounds(np.concatenate(windows), starts)
    i, j = (np.concatenate(c) for c in zip((np.arange(0, 300, 2), np.arange(1, 300, 2)), (np.arange(0, 298, 2), np.arange(3, 300, 2)), strict=True))
    may = passages.may_be_alike(i, j, *told, 80)
    alike = np.array([passages.alike(windows[a], windows[b], [], 80) is not None for a, b in zip(i, j, strict=True)])
    assert alike[:150].any() and not (alike & ~may).any() and may[150:].mean() < 0.1
