"""Alignment of two tokenizers by byte-owner arrays.

For each byte of a text an array says which token of tokenizer A owns it, another one which token of B does
(token numbers repeated over the tokens' bytes). Where the pair of owners changes, another overlap begins: the
consecutive distinct pairs are the links. Where both owners change at once, both tokenizers end a token, which
cuts the text into groups.

No token of either tokenizer crosses a space that follows another character, so each distinct word of a block
of texts is encoded and aligned once. How many documents hold a link is counted over all blocks with Spark;
the counts come back to each block by a join on the links that the block has.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, steps, table, texts

MARK = "▁"
#: Text bytes of a block: the words and links that a task holds at a time. A longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Words that a worker remembers from one block to the next, and text bytes of a step.
WORDS, STEP = 400_000, 4 << 20
#: Where a text may be cut: at a space after a character that is no white space, and not at the end.
CUT, ODD = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r" (?<=\s )")
#: How a byte-level vocabulary writes a byte that has no visible character: from this code point on.
BYTE_SHIFT = 256


class Tokenizers:
    """The two vocabularies, read on the driver and broadcast: a few MB, whatever the corpus."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in visible} | {chr(BYTE_SHIFT + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        special = {t["content"] for t in model["added_tokens"]}
        self.a = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        if model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{a_path} is no byte-level tokenizer without normaliser and prefix space")
        with open(b_path, "rb") as file:
            self.b_model = file.read()


class Numbers(dict):
    """Numbers words as they are asked for; ``fresh`` holds those that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = found = len(self)
        return found


class Aligner:
    """Encodes and aligns words, and remembers up to WORDS of them from block to block."""

    def __init__(self, tokenizers: Tokenizers):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizers.a, special_tokens={}).encode_ordinary
        self.b = SentencePieceProcessor(model_proto=tokenizers.b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark after other characters; words can't be encoded apart")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.zeros(max(tokenizers.a.values()) + 1, np.int64)
        self.a_size[list(tokenizers.a.values())] = [len(t) for t in tokenizers.a]
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_size))], [str(i) for i in range(len(self.b_size))]
        self.forget()

    def forget(self) -> None:
        self.index, self.told = Numbers(), []  # a word's number, its groups as text
        self.n = np.zeros((4, 0), np.int64)  # tokens of A and B, groups, links by word
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # all words' links as a << 32 | b, and where a word's end

    def words(self, text: str) -> list[str]:
        """The parts of space+text, each without its first space."""
        if not text:
            return []
        return CUT.split(text) if text[0] == " " or text[-1] == " " or ODD.search(text) else text.split(" ")

    def numbered(self, read: list[str]) -> list[list[int]]:
        """The numbers of each text's words; new words are aligned."""
        found = [list(map(self.index.__getitem__, self.words(t))) for t in read]
        fresh, self.index.fresh = self.index.fresh, []
        if fresh:
            *n, told, links = self.align(fresh)
            self.told += told
            self.n, self.links = np.concatenate([self.n, np.array(n)], axis=1), np.concatenate([self.links, links])
            self.ends = np.cumsum(self.n[3])
        return found

    def links_of(self, words: np.ndarray) -> np.ndarray:
        many = self.n[3][words]
        return self.links[np.repeat(self.ends[words] - np.cumsum(many), many) + np.arange(many.sum())]

    def align(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of each word: n_a, n_b, number of groups, number of links and groups as text; and all links as a << 32 | b.

        A word that B doesn't give back has -1 tokens and no link.
        """
        sides = [[self.encode_a(" " + w) for w in words], self.b.encode(words, num_threads=1)]
        want = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        flat, n = zip(*[(np.fromiter(chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64)) for x in sides], strict=True)
        size, given = np.fromiter(map(len, want), np.int64), np.concatenate([[0], np.cumsum(self.b_size[flat[1]])])
        bad, upto = np.zeros(len(words), bool), np.cumsum(n[1])
        if (given[upto] - given[upto - n[1]] != size).any() or b"".join([self.b_bytes[i] for i in flat[1].tolist()]) != b"".join(want):
            bad = np.array([b"".join([self.b_bytes[i] for i in ids]) != w for w, ids in zip(want, sides[1], strict=True)])
            flat, n = [x[np.repeat(~bad, k)] for x, k in zip(flat, n, strict=True)], [np.where(bad, 0, k) for k in n]
        (a_ids, b_ids), size = flat, np.where(bad, 0, size)
        own_a, own_b = np.repeat(np.arange(len(a_ids)), self.a_size[a_ids]), np.repeat(np.arange(len(b_ids)), self.b_size[b_ids])
        new_a, new_b = np.diff(own_a, prepend=-1) != 0, np.diff(own_b, prepend=-1) != 0
        at = np.flatnonzero(new_a | new_b)  # an overlap begins
        cuts = np.flatnonzero(new_a & new_b)  # a group begins
        links = a_ids[own_a[at]] << 32 | b_ids[own_b[at]]
        word_of = np.repeat(np.arange(len(words)), size)
        n_links, n_groups = np.bincount(word_of[at], minlength=len(words)), np.bincount(word_of[cuts], minlength=len(words))
        from_a, from_b = [*own_a[cuts].tolist(), len(a_ids)], [*own_b[cuts].tolist(), len(b_ids)]
        names_a, names_b = [self.a_text[i] for i in a_ids.tolist()], [self.b_text[i] for i in b_ids.tolist()]
        groups = [f"{names_a[i] if j - i == 1 else ','.join(names_a[i:j])}|{names_b[k] if m - k == 1 else ','.join(names_b[k:m])}" for i, j, k, m in zip(from_a, from_a[1:], from_b, from_b[1:], strict=False)]
        told, start = [], 0
        for many in n_groups.tolist():
            told.append(groups[start] if many == 1 else ";".join(groups[start : start + many]))
            start += many
        return np.where(bad, -1, n[0]), np.where(bad, -1, n[1]), n_groups, n_links, told, links


class Block:
    """The words and links of some documents."""

    def __init__(self, aligner: Aligner):
        if len(aligner.index) > WORDS:
            aligner.forget()
        self.aligner, self.bytes, self.held, self.rows = aligner, 0, [], []

    def add(self, batch: pa.RecordBatch, grouped: bool) -> None:
        aligner, read = self.aligner, [t.decode("utf-8", "replace") for t in texts(batch, "doc_text")]
        self.bytes += sum(map(len, read))
        for numbers in aligner.numbered(read):
            words = np.array(numbers, np.int32)
            n_a, n_b, n_groups, n_links = aligner.n[:, words]
            if not len(words) or n_a.min() < 0:
                self.rows.append((0, 0, 0, 0, "", "" if grouped else None, words[:0]))
                continue
            told = ";".join(map(aligner.told.__getitem__, numbers))
            self.rows.append((int(n_a.sum()), int(n_b.sum()), int(n_groups.sum()), int(n_links.sum()), hashlib.sha256(told.encode()).hexdigest(), told if grouped else None, words))
            self.held.append(np.unique(aligner.links_of(np.unique(words))))

    def result(self, number: int, rows: list[pa.StructArray]) -> pa.RecordBatch:
        """A row for each document; the first one also holds the block's links, how many of its documents hold each, and the links of each word."""
        *cols, words = zip(*self.rows, strict=True)
        used = np.zeros(len(self.aligner.index), bool)
        for w in words:
            used[w] = True
        own, used = np.cumsum(used, dtype=np.int32) - 1, np.flatnonzero(used)
        pairs, n_docs = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        position = np.searchsorted(pairs, self.aligner.links_of(used)).astype(np.int32)
        first = lambda x, kind: pa.array([x, *[None] * (len(self.rows) - 1)], kind)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(self.rows), pa.int64()), pa.array(range(len(self.rows)), pa.int32()), pa.concat_arrays(rows), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array([own[w].tobytes() for w in words], pa.binary()),
             first(pairs, pa.list_(pa.int64())), first(n_docs.astype(np.int32), pa.list_(pa.int32())), first(position.tobytes(), pa.binary()), first(self.aligner.n[3][used].astype(np.int32).tobytes(), pa.binary())],
            names=NAMES,
        )


#: The aligner that a worker has made; a reused worker keeps its memory of words.
_ALIGNER: dict[str, Aligner] = {}

NAMES = ["block", "nth", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "words", "pairs", "docs", "positions", "counts"]
KINDS = "block long, nth int, row {row}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, words binary, pairs array<bigint>, docs array<int>, positions binary, counts binary"


def blocks(docs: DataFrame, tokenizers: Tokenizers, text_col: str = "text", groups: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Documents encoded and aligned, a row each, with what their block needs to be told the links' counts."""
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizers), uuid.uuid4().hex
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns if c not in RESULTS]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _ALIGNER.get(key), TaskContext.get().partitionId() << 32
        if aligner is None:
            _ALIGNER.clear()
            aligner = _ALIGNER[key] = Aligner(shared.value)
        block, held = Block(aligner), []
        for whole in batches:
            for batch in steps(whole, "doc_text", STEP):
                block.add(batch, groups)
                held.append(batch.column("row"))
                if block.bytes >= BLOCK_BYTES:
                    yield block.result(number, held)
                    block, held, number = Block(aligner), [], number + 1
        if held:
            yield block.result(number, held)

    return rows.mapInArrow(align, KINDS.format(row=rows.schema["row"].dataType.simpleString()))


RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def link_counts(made: DataFrame) -> DataFrame:
    """a, b, pair, n_docs (documents that hold the link) and best (whether no other link of a is in more documents)."""
    counted = made.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n_docs"))
    counted = counted.withColumn("a", F.shiftright("pair", 32).cast("int"))
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(F.broadcast(most), "a").select("a", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))  # a row for each id of A


def aligned(docs: DataFrame, tokenizers: Tokenizers, text_col: str = "text", groups: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if none are named) and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``groups`` also the groups.

    Null and empty texts, and texts that B doesn't give back byte for byte (those with a space mark of B's own),
    have zeros and an empty digest. Whole texts of any length are encoded; rows of equal id or text count as
    documents each; an empty table gives an empty result; a column of ``docs`` that has the name of a result
    is replaced. Memory of a task follows BLOCK_BYTES and its longest text. The kept columns pass through a written
    table and a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    made = scratch.cut(blocks(docs, tokenizers, text_col, groups, keep))
    counts = scratch.cut(link_counts(made).select("pair", "n_docs", "best"))
    asked = made.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts.hint("merge"), "pair").select("of", "at", "n_docs", "best")
    kept = [c for c in NAMES if c not in ("pairs", "docs")]
    final = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    row = made.schema["row"].dataType.simpleString()

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        at = right.column("at").to_numpy()
        n_docs, best = np.zeros((2, len(at)), np.int64)
        n_docs[at], best[at] = right.column("n_docs").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        head = left.filter(pa.compute.equal(left.column("nth"), 0)).select(["positions", "counts"]).to_pylist()[0]
        links, many = np.frombuffer(head["positions"], np.int32), np.frombuffer(head["counts"], np.int32)
        ends = np.cumsum(many, dtype=np.int64)
        by_word = []
        for values in (n_docs, best):
            upto = np.concatenate([[0], np.cumsum(values[links])])
            by_word.append(upto[ends] - upto[ends - many])
        words = [np.frombuffer(w.as_py(), np.int32) for w in left.column("words")]
        out = {"count_sum": [int(by_word[0][w].sum()) for w in words], "n_best": [int(by_word[1][w].sum()) for w in words]}
        return pa.table({"row": left.column("row"), **{c: pa.array(out[c], pa.int64()) if c in out else left.column(c) for c in final}})

    schema = f"row {row}, " + ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in final)
    by_block = made.select(*kept).groupBy("block").cogroup(told.groupBy("of"))
    return by_block.applyInArrow(sums, schema).select("row.*", *final)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, Tokenizers(*tokenizer_paths()), keep=["doc_id"])
