import random
import zlib
from collections import defaultdict

import pytest

from marlstone.llm import sharding


def parts(groups, capacity):
    """Number of shards that groups in order take, greedily."""
    n, held = 1, 0
    for g in groups:
        if g > capacity:
            return len(groups) + 1
        n, held = (n, held + g) if held + g <= capacity else (n + 1, g)
    return n


def least(groups, shards):
    """The smallest capacity, by trying all runs of groups through a plain search."""
    low, high = max(groups), sum(groups)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if parts(groups, middle) <= shards else (middle + 1, high)
    return low


def expected(rows, shards):
    """{row number: shard} of (group, order, size) rows: oversized groups alone, the rest cut greedily at the least capacity."""
    size, of = defaultdict(int), defaultdict(list)
    for k, (g, _, s) in enumerate(rows):
        size[g] += s or 0
        of[g].append(k)
    ordered, free, alone = sorted(size, key=lambda g: (g is not None, g)), shards, []
    while free > 1:
        left = sum(size[g] for g in ordered if g not in alone)
        over = [g for g in ordered if g not in alone and size[g] * free > left]
        if not over:
            break
        alone += over
        free -= len(over)
    rest, out = [g for g in ordered if g not in alone], {}
    if rest:
        capacity, shard, held = least([size[g] for g in rest], free), 0, 0
        for g in rest:
            if held + size[g] > capacity:
                shard, held = shard + 1, 0
            held += size[g]
            out.update(dict.fromkeys(of[g], shard))
    for k, g in enumerate(g for g in ordered if g in alone):
        out.update(dict.fromkeys(of[g], free + k))
    return out


def run(spark, rows, shards):
    data = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, g string, o int, s long").repartition(3)
    return sharding.sharded(data, shards, ["g"], ["o", "row"], "s").collect()


CASES = {
    "even": ([(f"{k:04}", k, 10) for k in range(48)], 6),
    "mixed": ([(f"{k % 37:03}", k, (k * 7919) % 113 + 1) for k in range(400)], 7),
    "hot": ([("hot" if k % 3 == 0 else f"{k:04}", k, 9) for k in range(300)], 8),
    "several hot": ([(f"h{k % 3}" if k % 2 else f"{k:04}", k, k % 11) for k in range(300)], 9),
    "few groups": ([(f"{k % 3}", k, 5) for k in range(12)], 8),
    "nulls": ([(None, k, None if k % 2 else 3) for k in range(10)] + [("", 0, 4), ("a", 1, 4), ("a", 1, 4)], 3),
    "zeros": ([(f"{k:02}", k, 0 if k % 4 else 6) for k in range(40)], 4),
    "nothing but zeros": ([(f"{k:02}", k, 0) for k in range(5)], 4),
    "one": ([("a", 1, 7)], 5),
    "one shard": ([(f"{k}", k, k) for k in range(9)], 1),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_search(spark, case):
    rows, shards = CASES[case]
    got = run(spark, rows, shards)
    assert {r["row"]: r["shard"] for r in got} == expected(rows, shards)
    slots = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["g"] is not None, r["g"], r["o"], r["row"])):
        slots[r["shard"]].append(r["slot"])
    assert all(x == list(range(len(x))) for x in slots.values())


def test_search_by_stretches(spark, monkeypatch):
    """With few pieces a stretch the search takes several rounds, and gives the same."""
    monkeypatch.setattr(sharding, "PIECES", 4)
    monkeypatch.setattr(sharding, "LEAST", 2)
    draw = random.Random(3)
    for n, shards in ((300, 5), (120, 24)):
        rows = [(f"{k:05}", 0, draw.choice([1, 5, 40, 300])) for k in range(n)]
        assert {r["row"]: r["shard"] for r in run(spark, rows, shards)} == expected(rows, shards)


def test_known_ends_against_a_plain_search():
    """The driver's half of the search, over random group sizes, fed from a list."""
    draw = random.Random(1)
    for _ in range(60):
        groups, shards = [draw.randrange(1, draw.choice([3, 30, 3000])) for _ in range(draw.randrange(1, 200))], draw.randrange(1, 12)
        ends, at = [], 0
        for g in groups:
            ends.append(at := at + g)

        def inside(_, stretches, ends=ends):
            out = {}
            for lo, hi in stretches:
                pieces = defaultdict(list)
                for e in ends:
                    if lo < e < hi:
                        pieces[(e - lo) // max(1, (hi - lo) // 3)].append(e)
                out[lo, hi] = [(p[0], p[-1], len(p)) for p in pieces.values()]
            return out

        plain, sharding._inside = sharding._inside, inside
        try:
            cuts = sharding.minimax_cuts(None, at, max(groups), shards)
        finally:
            sharding._inside = plain
        loads = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
        assert cuts[-1] == at and len(cuts) <= shards and set(cuts) <= set(ends) and max(loads) == least(groups, shards)


def test_documents(spark):
    rows = [(1, "a"), (2, None), (3, "é"), (4, "a"), (4, "a"), (5, ""), (6, "x" * 100_000), (None, "b"), (7, None)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, shard int, key string")
    got = sharding.documents_in_shards(docs, 3).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got if r["text_crc32"] is not None) == sorted((k or 0, len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in rows if t is not None)
    assert all(r["size"] == 8 for r in got if r["text_crc32"] is None) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in of.values()) and len(got) == len(rows)


def test_empty(spark):
    assert sharding.documents_in_shards(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        sharding.documents_in_shards(spark.createDataFrame([], "doc_id long, text string"), 0)
