"""SentencePiece encoding and decoding by a merge-type prefix table.

For each prefix of a run of characters the table holds the one token that ends the prefix's encoding. The
candidates are the vocabulary pieces that end there (an Aho-Corasick automaton finds them); the right one is
the piece that is compatible with the token that ends the prefix before it, two tokens being compatible when
their concatenation encodes to exactly these two. The ids are then recovered backwards from the last prefix.

Texts are cut where no piece can cross (before a run of the space mark), so frequent chunks are encoded once
a worker. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table, texts

MARK = "▁"
#: Chunks remembered by a worker, and the longest chunk that is remembered.
MEMORY, MEMORY_CHARS = 700_000, 48


class Vocabulary:
    """What the model file holds: pieces and scores by id, byte pieces, the end id. Small, so it is broadcast."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.scores = [sp.get_score(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i)}
        self.end_id = sp.eos_id()
        normal = [i for i in ids if i not in self.special and not sp.is_byte(i)]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a space mark after other characters; chunks can't be encoded apart")
        self.normal = normal


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.id_of = {vocabulary.pieces[i]: i for i in vocabulary.normal}
        self.plain = set(vocabulary.normal)
        self.single = {p for p in self.id_of if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        self.compatible: dict[int, bool] = {}
        self.chunks: dict[str, tuple[str, int, str]] = {}
        self.byte_of = {i: b for b, i in vocabulary.byte_ids.items()}
        for piece, i in self.id_of.items():
            if self.merged(piece) == [i]:  # others can't come out of merges
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[int]:
        """The merges themselves, best score first and then leftmost; only for strings of one or two pieces."""
        parts, id_of, scores = list(text), self.id_of, self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [id_of.get(p, -1) for p in parts]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.compatible.get(key)
        if found is None:
            found = self.compatible[key] = self.merged(self.v.pieces[a] + self.v.pieces[b]) == [a, b]
        return found

    def run(self, text: str) -> list[int]:
        """Ids of a run of characters that all have pieces."""
        last, size, compatible = [0] * (len(text) + 1), [0] * (len(text) + 1), self.compatible
        for end, (i, n) in self.automaton.iter(text):  # at each end longest first
            end += 1
            if size[end]:
                continue
            if n != end:
                if not size[end - n]:
                    continue
                before = last[end - n]
                fits = compatible.get(before << 32 | i)
                if not (self.fits(before, i) if fits is None else fits):
                    continue
            last[end], size[end] = i, n
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def chunk(self, text: str) -> list[int]:
        if self.single.issuperset(text):
            return self.run(text)
        ids: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.single:
                if k > start:
                    ids += self.run(text[start:k])
                ids += [self.v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                start = k + 1
        return ids + self.run(text[start:]) if start < len(text) else ids

    def surface(self, ids: list[int]) -> str:
        """What ids stand for, space marks as spaces; runs of byte pieces are read as UTF-8."""
        if self.plain.issuperset(ids):
            return "".join([self.v.pieces[i] for i in ids]).replace(MARK, " ")
        pieces, special, by_id, out, held = self.v.pieces, self.v.special, self.byte_of, [], bytearray()
        for i in ids:
            if i in by_id:
                held.append(by_id[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in special:
                out.append(pieces[i].replace(MARK, " "))
        return "".join(out) + held.decode("utf-8", "replace")

    def known(self, key: str) -> tuple[str, int, str]:
        """Of the chunk that is a space mark and ``key``: ids as text, their number, their surface."""
        ids = self.chunk(MARK + key)
        found = (" ".join(map(str, ids)), len(ids), self.surface(ids))
        if len(key) <= MEMORY_CHARS:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[key] = found
        return found

    def keys(self, text: str) -> list[str]:
        """The text's chunks, each without its first space mark."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if marked[0] != MARK and marked[-1] != MARK and MARK * 2 not in marked:
            return marked.split(MARK)
        return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]

    def encode(self, text: str) -> list[int]:
        return [i for key in self.keys(text) for i in self.chunk(MARK + key)] + [self.v.end_id]

    def decode(self, ids: list[int]) -> str:
        found = self.surface(ids)
        return found[1:] if found[:1] == " " else found

    def both(self, text: str) -> tuple[str, int, str]:
        """Ids (with the end id) as text, their number, and the decoded text."""
        get, known = self.chunks.get, self.known
        found = [get(k) or known(k) for k in self.keys(text)]
        ids = " ".join([x[0] for x in found] + [str(self.v.end_id)])
        decoded = "".join([x[2] for x in found])
        return ids, sum([x[1] for x in found]) + 1, decoded[1:] if decoded[:1] == " " else decoded


#: The codec that a worker has made; a reused worker keeps its memory of chunks.
_CODEC: dict[str, Codec] = {}


def tokenized(docs: DataFrame, model_path: str, text_col: str = "text", ids: bool = True, text: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens``, ``token_ids`` (array, end id last), ``decoded``, ids_sha256, decoded_sha256.

    Null texts are encoded as empty: the end id alone, decoded to an empty text. Whole texts of any length are
    encoded; repeated rows give repeated results, an empty table an empty one. A column of ``docs`` that has the
    name of a result column is replaced.
    """
    results = ["n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"]
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    key = uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in results]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))
    wanted = [("n_tokens", pa.int64()), *([("token_ids", pa.list_(pa.int32()))] if ids else []), *([("decoded", pa.string())] if text else []), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = {"n_tokens": "bigint", "token_ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[n]}" for n, _ in wanted)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODEC.get(key)
        if codec is None:
            _CODEC.clear()
            codec = _CODEC[key] = Codec(shared.value)
        for whole in batches:
            for batch in steps(whole, "doc_text"):
                made: dict[str, list] = {n: [] for n, _ in wanted}
                for t in texts(batch, "doc_text"):
                    as_text, n, decoded = codec.both(t.decode("utf-8", "replace"))
                    made["n_tokens"].append(n)
                    made["ids_sha256"].append(hashlib.sha256(as_text.encode()).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                    if ids:
                        made["token_ids"].append([int(x) for x in as_text.split(" ")])
                    if text:
                        made["decoded"].append(decoded)
                yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(made[n], kind) for n, kind in wanted]], names=["row", *[n for n, _ in wanted]])

    return rows.mapInArrow(encode, schema).select("row.*", *[n for n, _ in wanted])


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenized(docs, model_path(), ids=False, text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: the documents' ids and number of tokens beside what they decode to."""
    return tokenized(docs, model_path()).select("doc_id", "lang", "source", "n_tokens", "token_ids", F.col("decoded").alias("text"))
