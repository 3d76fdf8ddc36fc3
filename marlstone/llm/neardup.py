"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets are one class from the start. Each class is posted under its
(coordinate, value) pairs. A pair above the threshold shares ``least`` of the POSTED coordinates but for a chance
below 1e-6, so a class needs only the rarest of its postings (prefix filter), and none at all if fewer than
``least`` of its pairs occur elsewhere (skip). In every posting list the most widely shared class is the hub:
candidates are first counted and confirmed against hubs, which is linear in the postings and merges copies
around their original. Only lists that still span several components are then compared pair by pair: short
ones over longer signatures, each pair in one list alone; long ones, clustered so that no pair comes twice, in
blocks of bounded size that yield only links between components. All links are confirmed on full shingle sets.
"""

from __future__ import annotations

import math
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, steps, table, texts
from .components import connected_components
from .shingles import Words, shingle_sets

#: Coordinates that are posted; bytes of the longer signature; the chance with which a linked pair may share too few of either.
POSTED, LONG, MISS = 32, 128, 1e-6
#: Similarity of the pipeline's stage; the query has 85.
STAGE_PERCENT = 80
#: Members of a short posting list, and of one part of a cluster of long ones.
BLOCK = 256
#: Shingles in such a part, so that long texts make smaller parts.
BLOCK_SHINGLES = 200_000


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_least(percent: int, n: int) -> int:
    """The most of n coordinates that a pair of this similarity falls short of with a chance below MISS only."""
    tail, k = 0.0, 0
    while k < n:
        tail += math.comb(n, k) * (percent / 100) ** k * (1 - percent / 100) ** (n - k)
        if tail >= MISS:
            break
        k += 1
    return max(k, 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """doc, n (shingles), set_a, set_b (128 bits that name the set), posted (POSTED ints), long (LONG bytes), and the text's SHA-256 where it is asked for."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, multipliers = Words(), _multipliers(LONG)
        for whole in batches:
            for batch in steps(whole, "doc_text"):
                read = texts(batch, "doc_text")
                sets = shingle_sets(*words.numbers(read))
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                least = np.zeros((len(sets), LONG), dtype=np.uint64)
                names = np.zeros((len(sets), 2), dtype=np.uint64)
                if len(some):
                    flat = np.concatenate([sets[k] for k in some])
                    at = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    for k, m in enumerate(multipliers):
                        least[some, k] = np.minimum.reduceat(flat * m, at)
                    names[some, 0] = np.add.reduceat(flat * (flat | np.uint64(1)), at)
                    names[some, 1] = np.bitwise_xor.reduceat((flat ^ (flat >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25), at)
                posted = (least[:, :POSTED] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                longer = np.ascontiguousarray((least * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(size, pa.int64()), pa.array(names[:, 0].view(np.int64)), pa.array(names[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * POSTED, pa.int32()), pa.array(posted.ravel())), pa.array([x.tobytes() for x in longer], pa.binary()), *[pa.array([hashlib.sha256(t).digest() for t in read], pa.binary())] * digest],
                    names=["doc", "n", "set_a", "set_b", "posted", "long", *["digest"] * digest],
                )

    return rows.mapInArrow(sign, f"doc {rows.schema['doc'].dataType.simpleString()}, n long, set_a long, set_b long, posted array<int>, long binary" + ", digest binary" * digest)


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are alike enough."""
    left = held.select(F.col("doc").alias("a"), F.col("doc_text").alias("text_a"))
    right = held.select(F.col("doc").alias("b"), F.col("doc_text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, of_last = Words(), None, None
        for whole in batches:
            for batch in steps(whole, "text_b"):
                a, b = batch.column("a"), batch.column("b")
                sets = shingle_sets(*words.numbers(texts(batch, "text_b")))
                firsts, keep = batch.column("text_a").cast(pa.binary()), np.zeros(len(a), dtype=bool)
                for k, key in enumerate(a.to_pylist()):
                    if of_last is None or key != last:
                        last, of_last = key, shingle_sets(*words.numbers([firsts[k].as_py()]))[0]
                    both = len(np.intersect1d(of_last, sets[k], assume_unique=True))
                    keep[k] = 100 * both >= percent * (len(of_last) + len(sets[k]) - both)
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(confirm, f"a {kind}, b {kind}")


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, long_a, long_b) the pairs with ``least`` equal coordinates."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, LONG) for c in ("long_a", "long_b"))
            keep = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _by_block(batches: Iterator[pa.RecordBatch], solve, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``solve`` over the rows of each block, which come sorted by block and are few by construction."""
    held: list[tuple] = []
    schema = None

    def out() -> pa.RecordBatch:
        a, b = solve(held)
        return pa.RecordBatch.from_arrays([pa.array(a, schema.field("doc").type), pa.array(b, schema.field("doc").type)], names=["a", "b"])

    for whole in batches:
        schema = whole.schema
        for batch in steps(whole, columns[3]):  # few rows become Python objects at a time
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield out()
                    held = []
                held.append(row)
    if held:
        yield out()


def _counted_pairs(rows: list[tuple], least: int) -> tuple[list, list]:
    """Of one short list the pairs across components that agree enough, each in the first list that both are in."""
    docs, components, slot = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=object), rows[0][6]
    x = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(-1, LONG)
    prefixes, posted = np.array([r[4] for r in rows], dtype=np.int64), np.array([r[5] for r in rows], dtype=np.int32)
    bits, a, b = np.int64(1) << np.arange(POSTED, dtype=np.int64), [], []
    for k in range(len(rows) - 1):
        agree = k + 1 + np.flatnonzero((x[k] == x[k + 1 :]).sum(1) >= least)
        agree = agree[(components[agree] != components[k]).astype(bool)]
        if len(agree):
            common = ((posted[k] == posted[agree]) @ bits) & prefixes[k] & prefixes[agree]
            agree = agree[(common & -common) == np.int64(1) << slot]
            a += [docs[k]] * len(agree)
            b += [docs[j] for j in agree.tolist()]
    return a, b


def _linked_blocks(percent: int):
    """Of two parts of a cluster of long lists: links on full sets that join components, at most one for each row."""
    words = Words()

    def solve(rows: list[tuple]) -> tuple[list, list]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sets = shingle_sets(*words.numbers([(r[3] or "").encode() for r in rows]))
        size = np.array([len(s) for s in sets], dtype=np.int64)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = times[column] > 1
        _, column = np.unique(column[shared], return_inverse=True)
        row = row[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(rows), len(rows)), dtype=np.float32)
        for start in range(0, int(column.max(initial=-1)) + 1, 4096):
            p, q = np.searchsorted(column, (start, start + 4096))
            part = np.zeros((len(rows), 4096), dtype=np.float32)
            part[row[p:q], column[p:q] - start] = 1
            both += part @ part.T
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        a, b = [], []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
            x, y = find(rows[i][2]), find(rows[j][2])
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(rows[i][1])
                b.append(rows[j][1])
        return a, b

    return solve


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, digest: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id, kept and, where asked for, digest (the text's SHA-256) for every row.

    Words are split at ASCII white space after lower-casing A-Z; shingles have five words, fewer words are one
    shingle. Rows are linked when 100 * intersection >= percent * union; a component's id is its smallest id.
    Null, empty and wordless texts have no shingles and are alone. Rows without an id are alone, have a null
    component and stay. Repeated rows share a component. The thresholds on signatures follow ``percent``.
    Further columns are not read.
    """
    least, long_least = shared_least(percent, POSTED), shared_least(percent, LONG)
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = scratch.cut(signatures(docs, id_col, text_col, digest))
    some = base.where("n > 0 AND doc IS NOT NULL")
    classes = some.groupBy("set_a", "set_b", "n").agg(F.min("doc").alias("doc"), F.min("posted").alias("posted"), F.min("long").alias("long"))
    classes = scratch.cut(classes.select("doc", "set_a", "set_b", "n", "posted", "long"))
    # postings that occur twice at least, then each class's rarest ones
    postings = classes.select("doc", F.posexplode("posted").alias("slot", "value"))
    shared = postings.groupBy("slot", "value").agg(F.count("*").alias("df")).where("df > 1")
    prefix = (
        postings.join(shared.hint("merge"), ["slot", "value"]).groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("df", "slot", "value"))).alias("p"), F.sum("df").alias("fame"))  # POSTED at most
        .where(F.size("p") >= least).withColumn("p", F.expr(f"slice(p, 1, size(p) - {least - 1})"))
        .withColumn("slots", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.pow(F.lit(2.0), x["slot"]).cast("long")))
    )
    prefix = scratch.cut(prefix.select("doc", "fame", "slots", F.transform("p", lambda x: F.struct(x["slot"].alias("slot"), x["value"].alias("value"))).alias("p")))
    lists = prefix.select("doc", "fame", F.explode("p").alias("key"))
    hubs = lists.groupBy("key").agg(F.max_by("doc", F.struct("fame", F.hash("doc"), "doc")).alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    pairs = lists.join(hubs, "key").where("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    signs = classes.select("doc", "long")
    kind = classes.schema["doc"].dataType.simpleString()
    pairs = pairs.join(signs.select(F.col("doc").alias("b"), F.col("long").alias("long_b")), "b").join(signs.select(F.col("doc").alias("a"), F.col("long").alias("long_a")), "a")
    pairs = scratch.cut(pairs.select("a", "b", "long_a", "long_b").mapInArrow(lambda x: _counted(x, long_least), f"a {kind}, b {kind}"))
    # texts of what may still be compared are set aside once
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))
    held = scratch.cut(source.join(prefix.select("doc").hint("merge"), "doc"))  # merged at any size, so that growth shows
    links = scratch.cut(_confirmed(pairs, held, percent))
    groups = connected_components(links, "a", "b", scratch)
    labelled = prefix.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    lists = scratch.cut(labelled.select("doc", "component", "slots", F.explode("p").alias("key")))
    open_lists = lists.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key", "members")
    # short lists that span components: all pairs of the list, by signatures and then full sets
    short = lists.join(open_lists.where(F.col("members") <= BLOCK).select("key"), "key").join(classes.select("doc", "long", "posted").hint("merge"), "doc")
    short = short.select(F.concat_ws(":", "key.slot", "key.value").alias("block"), "doc", "component", "long", "slots", "posted", F.col("key.slot").alias("slot"))
    columns = ("block", "doc", "component", "long", "slots", "posted", "slot")
    found = short.repartition("block").sortWithinPartitions("block").mapInArrow(lambda x: _by_block(x, lambda rows: _counted_pairs(rows, long_least), columns), f"a {kind}, b {kind}")
    more = scratch.cut(_confirmed(scratch.cut(found), held, percent))
    # long ones: lists with common documents are one cluster, dealt to parts; each pair of parts is one block, which
    # yields only links that join components, a row for each of its documents at most
    long = scratch.cut(lists.join(open_lists.where(F.col("members") > BLOCK).select("key"), "key").select("key", "doc", "component"))
    if not long.isEmpty():
        stars = long.join(long.groupBy("key").agg(F.min("doc").alias("first")), "key").select("doc", "first")
        # Components of more than a part have parts of their own, small ones share parts; parts of one component are not
        # held against each other, so most of a cluster meets only what is not yet linked to it.
        labels = long.select("doc", F.col("component").alias("of")).distinct()
        clusters = connected_components(stars, "doc", "first", scratch).select(F.col("node").alias("doc"), F.col("component").alias("cluster")).join(classes.select("doc", "n"), "doc").join(labels, "doc")
        large = clusters.groupBy("cluster", "of").agg(F.when(F.count("*") > BLOCK, F.concat(F.lit("of:"), F.col("of").cast("string"))).otherwise("").alias("group"))
        clusters = scratch.cut(clusters.join(large, ["cluster", "of"]))
        sizes = clusters.groupBy("cluster", "group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
        every = Window.partitionBy("cluster")  # a row for each BLOCK documents at most
        sizes = sizes.withColumns({"total": F.sum("parts").over(every).cast("int"), "first": F.coalesce(F.sum("parts").over(every.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")})
        dealt = clusters.join(sizes, ["cluster", "group"]).withColumn("part", F.col("first") + F.pmod(F.hash("doc"), F.col("parts")))
        met = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda other: (F.col("group") == "") | (other < F.col("first")) | (other >= F.col("first") + F.col("parts")))
        blocks = F.transform(met, lambda other: F.concat_ws(":", "cluster", F.least("part", other), F.greatest("part", other)))
        rows = dealt.withColumn("block", F.explode(blocks)).select("block", "doc", F.col("of").alias("component")).join(held.hint("merge"), "doc").select("block", "doc", "component", "doc_text")
        solve = _linked_blocks(percent)
        joined = rows.repartition("block").sortWithinPartitions("block").mapInArrow(lambda x: _by_block(x, solve, ("block", "doc", "component", "doc_text")), f"a {kind}, b {kind}")
        more = scratch.cut(more.unionByName(joined))
    if not more.isEmpty():
        groups = connected_components(links.unionByName(more), "a", "b", scratch)
    of_class = classes.select("doc", "set_a", "set_b", "n").join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("set_a", "set_b", "n", F.coalesce("component", "doc").alias("component_id"))
    out = base.select("doc", "n", "set_a", "set_b", *["digest"] * digest).join(of_class, ["set_a", "set_b", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"), *["digest"] * digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity STAGE_PERCENT stays, that of the smallest doc_id.

    A row goes by its id and its text: another text of the same id is judged for itself. Repeated rows and rows
    without words stay.
    """
    dropped = near_duplicates(docs, percent=STAGE_PERCENT, digest=True).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "digest").distinct()
    own = F.unhex(F.sha2(docs["text"].cast("string").cast("binary"), 256))
    return docs.join(dropped, (docs["doc_id"] == F.col("_gone")) & (own == F.col("digest")), "left_anti")


def brute_force(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """The contract read literally, for small fixtures."""
    import re

    sets = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
