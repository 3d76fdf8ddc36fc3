"""Python-like call texts as rows: a table function that parses and never evaluates."""

from __future__ import annotations

import ast
import json
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Arithmetic between constants that is folded; anything else stays text.
FOLDED = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
MOST_TEXT = 10_000
SCHEMA = "kind string, call int, name string, consumer string, arguments string, depth int, error string"


def _name(call: ast.Call) -> str:
    """The dotted name that is called; empty where it is no name."""
    parts, at = [], call.func
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join(reversed([*parts, at.id])) if isinstance(at, ast.Name) else ".".join(reversed(parts))


def _folded(node: ast.BinOp):
    left, right = _value(node.left), _value(node.right)
    numbers = all(isinstance(x, int | float) and not isinstance(x, bool) for x in (left, right))
    texts = isinstance(node.op, ast.Add) and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (node.left, node.right))
    if type(node.op) in FOLDED and (numbers or texts):
        try:
            return FOLDED[type(node.op)](left, right)
        except ArithmeticError:
            pass
    return ast.unparse(node)


def _value(node: ast.expr):
    """What an argument stands for: constants, containers, names as text, calls with keywords as {name: arguments}."""
    match node:
        case ast.Constant():
            v = node.value
            return v if v is None or isinstance(v, bool | int | float | str) else "..." if v is Ellipsis else repr(v)
        case ast.List() | ast.Tuple():
            return [_value(x) for x in node.elts]
        case ast.Dict():
            return {x if isinstance(x := _value(k), str) else json.dumps(x): _value(v) for k, v in zip(node.keys, node.values, strict=True) if k is not None}
        case ast.Name():
            return node.id
        case ast.UnaryOp(op=ast.USub() | ast.UAdd()):
            x = _value(node.operand)
            return (-x if isinstance(node.op, ast.USub) else x) if isinstance(x, int | float) and not isinstance(x, bool) else ast.unparse(node)
        case ast.Call() if node.keywords:
            return {_name(node): _arguments(node)}
        case ast.BinOp():
            return _folded(node)
        case ast.Call() | ast.Subscript() | ast.Attribute():
            return ast.unparse(node)
    raise ValueError(f"unsupported: {type(node).__name__}")


def _arguments(call: ast.Call) -> dict:
    return {k.arg: _value(k.value) for k in call.keywords if k.arg}


def _edges(call: ast.Call) -> Iterator[tuple[str, str]]:
    """(producer, consumer) of the call in or nearest below each part of a call, and so on inside."""
    for part in ast.iter_child_nodes(call):
        inner = part if isinstance(part, ast.Call) else next((x for x in ast.walk(part) if isinstance(x, ast.Call)), None)
        if inner is not None:
            yield _name(inner) or "<unknown>", _name(call) or "<unknown>"
            yield from _edges(inner)


def _depth(call: ast.Call) -> int:
    """1 and the depth of what is nested: direct arguments where any is a call, else calls anywhere in the parts."""
    parts = list(ast.iter_child_nodes(call))
    inner = [x for x in parts if isinstance(x, ast.Call)] or [y for x in parts for y in ast.walk(x) if isinstance(y, ast.Call)]
    return 1 + max(map(_depth, inner), default=0)


def parsed(text: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA of a text: its calls and their edges in order, or one error."""
    if text is None:
        return
    try:
        if len(text) > MOST_TEXT:
            raise ValueError(f"longer than {MOST_TEXT} characters")
        body = ast.parse(text.strip("[]'"), mode="eval").body
        calls = [body] if isinstance(body, ast.Call) else getattr(body, "elts", None)
        if calls is None or not all(isinstance(c, ast.Call) for c in calls):
            raise ValueError("no call")
        rows = []
        for k, c in enumerate(calls):
            rows.append(("call", k, _name(c).strip(), None, json.dumps(_arguments(c), ensure_ascii=False), _depth(c), None))
            rows += [("edge", k, producer, consumer, None, None, None) for producer, consumer in _edges(c)]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield "error", 0, None, None, None, None, f"{type(e).__name__}: {str(e)[:200]}"
        return
    yield from rows


#: String literals, or whole numbers that stand alone as an argument or item; the rest of a text is its shape.
PLACES = re.compile(r"""('[^']*'|"[^"]*")|([=(\[,:]\s*-?)([1-9][0-9]{0,14})(?=\s*(?:[,)\]}]|\Z))""")
#: Numbers that stand for those of a shape: longer than any of them.
STAND_INS, MOST_SHAPES = 730_000_000_000_000_000, 4096


def _shape(bare: str) -> list[tuple] | None:
    """(row, pieces of its arguments, places of the numbers between them) of the texts alike but for their numbers; None where a number has a say in more than its own place."""
    put: list[int] = []

    def stand_in(m: re.Match) -> str:
        if m[3] is None:
            return m[0]
        put.append(STAND_INS + len(put))
        return f"{m[2]}{put[-1]}"

    text = PLACES.sub(stand_in, bare)
    rows = list(parsed(text)) if len(text) <= MOST_TEXT else []
    if not rows or any(str(n) in str(r[c]) for n in put for r in rows for c in (2, 3, 6)):
        return None
    if rows[0][0] != "error":
        told = " ".join(r[4] for r in rows if r[4])
        if any(told.count(str(n)) != 1 for n in put):
            return None
        for node in ast.walk(ast.parse(text, mode="eval")):  # numbers that are folded, or part of a key, are no places
            inside = [node] if isinstance(node, ast.BinOp) else [k for k in node.keys if k is not None] if isinstance(node, ast.Dict) else []
            if any(isinstance(x, ast.Constant) and type(x.value) is int and x.value in put for part in inside for x in ast.walk(part)):
                return None
    found = re.compile("|".join(map(str, put)) or r"(?!)")
    return [(r, found.split(r[4] or ""), [int(n) - STAND_INS for n in found.findall(r[4] or "")]) for r in rows]


def parsed_alike(text: str | None, shapes: dict) -> list[tuple]:
    """The rows of ``parsed``; ``shapes`` remembers those of texts that differ in numbers alone, so each shape is parsed once."""
    if text is None or len(text) > MOST_TEXT or any(x in text for x in ("\\", "#", "\0", "'''", '"""')):
        return list(parsed(text))
    bare = text.strip("[]'")
    parts = PLACES.split(bare)
    numbers = [x for x in parts[3::4] if x]
    del parts[3::4]
    key = tuple(parts)
    if key not in shapes:
        if len(shapes) >= MOST_SHAPES:
            shapes.clear()
        shapes[key] = _shape(bare)
    if shapes[key] is None:
        return list(parsed(text))
    return [(*r[:4], pieces[0] + "".join(numbers[k] + x for k, x in zip(at, pieces[1:], strict=True)), *r[5:]) if at else r for r, pieces, at in shapes[key]]


@F.udtf(returnType=SCHEMA)
class call_rows:
    """The table function for SQL and lateral joins: rows of a call text, a text at a time."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from parsed(text)


def with_calls(rows: DataFrame, text: str) -> DataFrame:
    """Columns of ``rows`` but those of SCHEMA, and a row for each call, each edge and each text that can't be read.

    kind call: call (place in the text), name, arguments (JSON of the keywords), depth; kind edge: name (producer),
    consumer; kind error: error. Null texts give nothing. Texts of more than MOST_TEXT characters are errors. What
    ``call_rows`` gives, in Arrow batches.
    """
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in SCHEMA.split(", ")]
    kept = [c for c in rows.columns if c not in names]
    packed = rows.select(F.struct(*kept).alias("row"), F.col(text).cast("string").alias("doc")).where("doc IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict = {}
        for batch in batches:
            at, found = [], []
            for k, t in enumerate(batch.column("doc").to_pylist()):
                told = parsed_alike(t, shapes)
                at += [k] * len(told)
                found += told
            cols = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["row", *names])

    return packed.mapInArrow(read, f"row {packed.schema['row'].dataType.simpleString()}, {SCHEMA}").select("row.*", *names)


def canonical_calls(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """keys, call_idx (from 0 over the texts of a key), name, arguments, valid (has a name); unreadable texts have none of them but an error."""
    found = with_calls(rows.select(*keys, F.col(order).alias("_order"), F.col(text).alias("_text")), "_text").where("kind != 'edge'")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "call")) - 1
    return found.select(*keys, at.alias("call_idx"), "name", "arguments", F.coalesce(F.length("name") > 0, F.lit(False)).alias("valid"), "error")


def structural_profile(turns: DataFrame, calls: DataFrame, catalog: DataFrame, seed: str, turn: str, order: str, text: str) -> DataFrame:
    """seed, turns, calls_per_turn, classes_per_turn (sorted, distinct), edges, depth, unreadable of each seed.

    ``turns``: seed, turn; ``calls``: seed, turn, order, text; ``catalog``: name, class. A turn without calls counts 0.
    """
    turns, calls = turns.withColumn("_turn", F.col(turn)), calls.select(seed, F.col(turn).alias("_turn"), F.col(order).alias("_order"), F.col(text).alias("_text"))
    found = with_calls(calls, "_text")
    named = found.where("kind = 'call' AND call = 0").join(catalog.select(F.col("name"), F.col("class")), "name")
    classes = named.groupBy(seed, "_turn").agg(F.sort_array(F.collect_set("class")).alias("_classes"))
    counts = calls.groupBy(seed, "_turn").agg(F.count("*").alias("_n"))
    per = turns.select(seed, "_turn").distinct().join(counts, [seed, "_turn"], "left").join(classes, [seed, "_turn"], "left")
    per = per.groupBy(seed).agg(F.array_sort(F.collect_list(F.struct(F.col("_turn").alias("t"), F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_classes", F.array().cast("array<string>")).alias("c")))).alias("_t"))
    edge = F.struct(F.col("_turn").alias("turn"), F.col("_order").alias("position"), F.col("name").alias("producer"), "consumer")
    rest = found.groupBy(seed).agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "edge", edge))).alias("edges"), F.max("depth").alias("_depth"), F.count_if(F.col("kind") == "error").alias("_bad"))
    return per.join(rest, seed, "left").select(
        seed, F.size("_t").alias("turns"), F.col("_t.n").alias("calls_per_turn"), F.col("_t.c").alias("classes_per_turn"), F.coalesce("edges", F.array().cast(rest.schema["edges"].dataType)).alias("edges"), F.coalesce("_depth", F.lit(0)).alias("depth"), F.coalesce("_bad", F.lit(0)).alias("unreadable")
    )


def _keyword_call(text: str) -> tuple[str, str] | None:
    try:
        node = ast.parse(text, mode="eval").body
        if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name) or node.args or any(k.arg is None for k in node.keywords):
            return None
        return node.func.id, json.dumps({k.arg: ast.literal_eval(k.value) for k in node.keywords}, ensure_ascii=False, default=repr)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return None


def first_keyword_calls(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """keys, name, arguments (JSON), source: the first text that is a call of a plain name with literal keywords alone; keys without one don't occur."""

    @F.arrow_udf("struct<name: string, arguments: string>")
    def read(texts: pa.Array) -> pa.Array:
        found = [None if t is None or len(t) > MOST_TEXT else _keyword_call(t) for t in texts.to_pylist()]
        return pa.array([x and {"name": x[0], "arguments": x[1]} for x in found], pa.struct([("name", pa.string()), ("arguments", pa.string())]))

    told = rows.select(*keys, F.struct(*order).alias("_at"), F.col(text).alias("_source"), read(F.col(text)).alias("_c")).where("_c.name IS NOT NULL")
    return told.groupBy(*keys).agg(F.min_by(F.struct("_c", "_source"), "_at").alias("_b")).select(*keys, "_b._c.name", "_b._c.arguments", F.col("_b._source").alias("source"))
