import pytest

from marlstone.operators import microbatches as M


def rows(spark, *shares):
    """One batch a share list: {rank: lengths}."""
    return spark.createDataFrame([(b, r, 100 * r + k, n) for b, share in enumerate(shares) for r, ns in share.items() for k, n in enumerate(ns)], "batch int, rank int, item int, n int")


def parts(found):
    out = {}
    for r in found.collect():
        out.setdefault((r["batch"], r["rank"]), {}).setdefault(r["part"], []).append(r["item"] % 100)
    return {k: [sorted(v[p]) for p in sorted(v)] for k, v in out.items()}


def test_counts(spark):
    data = rows(spark, {0: [5, 5, 5, 5], 1: [9]}, {0: [1, 1]})
    got = lambda **more: {(r["batch"], r["rank"]): r["parts"] for r in M.micro_counts(data, ["batch"], "rank", "n", 10, **more).collect()}
    assert got() == {(0, 0): 2, (0, 1): 2, (1, 0): 1} and got(alike=False) == {(0, 0): 2, (0, 1): 1, (1, 0): 1}
    assert got(multiple=3) == {(0, 0): 3, (0, 1): 3, (1, 0): 3} and got(least=4, multiple=2) == {(0, 0): 4, (0, 1): 4, (1, 0): 4}


def test_parts_of_like_totals(spark):
    got = parts(M.micro_batches(rows(spark, {0: [8, 7, 6, 5], 1: [4, 4, 4]}), ["batch"], "rank", "item", "n", 13))
    assert sorted(map(len, got[0, 0])) == [2, 2] and sorted(sum((8, 7, 6, 5)[i] for i in p) for p in got[0, 0]) == [13, 13] and sorted(map(len, got[0, 1])) == [1, 2]
    for bad, message in (({0: [20]}, "above the cap"), ({0: [5, 5, 5], 1: [1]}, "can't fill")):
        with pytest.raises(Exception, match=message):
            M.micro_batches(rows(spark, bad), ["batch"], "rank", "item", "n", 10).collect()


def test_strict_parts_split_the_fullest(spark):
    got = parts(M.strict_micro_batches(rows(spark, {0: [6, 5, 4, 3, 2], 1: [1, 1, 1, 9]}), ["batch"], "rank", "item", "n", 10))
    assert got[0, 0] == [[0, 2], [1, 3, 4]] and got[0, 1] == [[0, 3], [1, 2]]
    got = parts(M.strict_micro_batches(rows(spark, {0: [6, 5, 4, 3, 2], 1: [1, 1, 1, 9]}), ["batch"], "rank", "item", "n", 10, multiple=4))
    assert got[0, 0] == [[0], [1, 3], [2], [4]] and got[0, 1] == [[3], [1], [0], [2]]
    with pytest.raises(Exception, match="can't fill"):
        M.strict_micro_batches(rows(spark, {0: [6, 6], 1: [1]}), ["batch"], "rank", "item", "n", 10).collect()


def test_order_is_a_permutation(spark):
    data = rows(spark, {0: [9, 1, 8, 2, 7, 3]})
    found = M.balanced_order(data, ["batch"], "item", "n", 3).collect()
    assert sorted(r["position"] for r in found) == list(range(6)) and all(r["rank"] == r["position"] // 2 for r in found)
    loads = [sum((9, 1, 8, 2, 7, 3)[r["item"]] for r in found if r["rank"] == k) for k in range(3)]
    assert loads == [10, 10, 10]
    with pytest.raises(Exception, match="dealt evenly"):
        M.balanced_order(data, ["batch"], "item", "n", 4).collect()
    assert M.balanced_order(data.where("false"), ["batch"], "item", "n", 4).count() == 0
