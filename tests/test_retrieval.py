import numpy as np

from marlstone.operators import retrieval


def test_blocks_and_lengths(spark, monkeypatch):
    draw = np.random.default_rng(4)
    data = [(k, [float(x) for x in draw.normal(size=3 if k % 4 else 2)]) for k in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (None, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    queries = rows.where("id % 3 = 0")
    whole = sorted(tuple(r) for r in retrieval.nearest(rows, queries, "id", "v", 4).collect())
    vectors = {k: np.array(v) / np.linalg.norm(v) for k, v in data if k is not None and v and any(v)}
    want = []
    for q in (k for k in vectors if k % 3 == 0):
        near = sorted((-round(float(vectors[q] @ v), 9), k) for k, v in vectors.items() if k != q and len(v) == len(vectors[q]))[:4]
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(near)]
    close = lambda a, b: [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])
    assert close(whole, sorted(want))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    assert close(sorted(tuple(r) for r in retrieval.nearest(rows, queries, "id", "v", 4).collect()), sorted(want))
    assert retrieval.nearest(rows, queries.where("false"), "id", "v").count() == 0


def test_a_task_holds_a_tile_of_products():
    """Memory of a full block of queries follows the tile, not the batch."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    class Taken(Exception):
        pass

    class Rows:
        def mapInArrow(self, function, schema):
            self.function = function
            raise Taken

    n, rows = 4096, Rows()
    x = np.random.default_rng(5).normal(size=(n, 8))
    with np.testing.assert_raises(Taken):
        retrieval._search(rows, SimpleNamespace(value={8: (np.arange(n), x)}), 10)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * 8, 8, dtype=np.int32)), pa.array(x.ravel()))], names=["id", "v"])
    tracemalloc.start()
    out = list(rows.function(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].num_rows == 10 * n and peak < 60e6


def test_lexical_search_reads_documents_once(spark, monkeypatch):
    from marlstone.operators import rows as R

    docs = spark.createDataFrame([(1, "red Red fox"), (2, "a fox, a hen"), (3, ""), (4, None), (2, "hen"), (5, "blue")], "d int, text string")
    queries = spark.createDataFrame([(7, "Fox red fox"), (8, "hen"), (9, None), (10, "none")], "q int, text string")
    found = R.lexical_search(docs, queries, "d", "q", "text")
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert [(r[0], r[1], r[3]) for r in got] == [(7, 1, 1), (7, 2, 2), (8, 2, 1)]
    monkeypatch.setattr(R, "ASKED", 0)
    assert sorted(map(tuple, R.lexical_search(docs, queries, "d", "q", "text").collect())) == got
