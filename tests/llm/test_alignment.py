import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marlstone.llm import alignment

PATHS = alignment.tokenizer_paths()


def brute(rows):
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of (key, text) rows, byte by byte on whole texts."""
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    made = []
    for key, text in rows:
        want = (" " + (text or "")).encode()
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            made.append((key, 0, 0, 0, [], ""))
            continue
        at_a, at_b = [k for k, t in enumerate(a_bytes) for _ in t], [k for k, t in enumerate(b_bytes) for _ in t]
        links = [(a_ids[x], b_ids[y]) for x, y in dict.fromkeys(zip(at_a, at_b, strict=True))]
        groups, left, right = [], [], []
        for k in range(len(want)):
            end_a, end_b = k + 1 == len(want) or at_a[k + 1] != at_a[k], k + 1 == len(want) or at_b[k + 1] != at_b[k]
            left += [str(a_ids[at_a[k]])] * end_a
            right += [str(b_ids[at_b[k]])] * end_b
            if end_a and end_b:
                groups.append(",".join(left) + "|" + ",".join(right))
                left, right = [], []
        made.append((key, len(a_ids), len(b_ids), len(groups), links, ";".join(groups)))
    counts = Counter(x for row in made for x in set(row[4]))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    return sorted(((key, n_a, n_b, n, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), told) for key, n_a, n_b, n, links, told in made), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def held(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return alignment.aligned(docs, alignment.Tokenizers(*PATHS), groups=True, **more)


def same(spark, rows):
    got = held(spark, rows).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == brute(rows)
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b\t c  d", "　 x", "end. ", "tab\tend\t",
    "<|endoftext|> <s> </s> <unk> <0x41> are text", "it's we'll THE'RE", "12345 6 789", "▁ and a▁b", "▁", "naïve façade Größe Ωμέγα 東京 タワー",
    "é combined ‍ zero ​ width", "emoji 😀😀 👩‍👩‍👧 end", "\x00 nul \x01\x1f ctrl \x1c x \x85 y", "a" * 500, ("word " * 3000).strip(), "no spaces" * 400, "   many    gaps   ",
]


def test_equals_brute_force(spark):
    same(spark, [*enumerate(TEXTS), (4, "a"), (4, "other"), (None, "a a b"), (None, None)])


def test_random_texts(spark):
    draw = random.Random(5)
    signs = "aaabcdeé  \n\t.,!#'sT0127ß日😀  <>|_-"
    same(spark, [(k, "".join(draw.choice(signs) for _ in range(draw.randrange(60)))) for k in range(400)])


@pytest.mark.parametrize(("block", "words"), [(1, 1), (4000, 10)])
def test_blocks_and_forgetting(spark, monkeypatch, block, words):
    """Blocks of a document each and words forgotten between blocks give the same; the constants reach the tasks by the closure's module."""
    rows = [(k, t) for k, t in enumerate(t * 3 for t in TEXTS if t)] + [(100 + k, "shared words of many texts") for k in range(300)]
    tokenizers = alignment.Tokenizers(*PATHS)
    aligner = alignment.Aligner(tokenizers)
    monkeypatch.setattr(alignment, "WORDS", words)
    import pyarrow as pa

    total, seen = Counter(), []
    for start in range(0, len(rows), max(1, block // 200)):
        part = rows[start : start + max(1, block // 200)]
        made = alignment.Block(aligner)
        made.add(pa.RecordBatch.from_pydict({"doc_text": pa.array([t for _, t in part])}), True)
        out = made.result(0, [pa.array([{"doc_id": k} for k, _ in part])])
        total.update(dict(zip(out.column("pairs")[0].as_py(), out.column("docs")[0].as_py(), strict=True)))
        seen += [(k, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) for (k, _), r in zip(part, out.to_pylist(), strict=True)]
    want = brute(rows)
    assert sorted(seen, key=repr) == sorted(((*x[:5], x[7]) for x in want), key=repr)
    same(spark, rows)
    assert sum(total.values()) >= 300


def test_empty_table_and_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, alignment.Tokenizers(*PATHS)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, row string, n_a int")
    got = alignment.aligned(docs, alignment.Tokenizers(*PATHS)).first()
    assert (got["row"], got["text"], got["n_a"], got["n_best"], got["count_sum"]) == ("x", "a b", 2, 2, 2)
    kept = alignment.aligned(docs, alignment.Tokenizers(*PATHS), keep=["doc_id"])
    assert kept.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark):
    got = alignment.query(spark, "/root/testdata/sf0.001").collect()
    want = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    digest = lambda told: hashlib.sha256(told.encode()).hexdigest() if told else ""
    assert sorted(tuple(r[c] for c in COLUMNS[:-1]) + (r["groups_sha256"],) for r in got) == sorted((*x[:-1], digest(x[-1])) for x in want)
