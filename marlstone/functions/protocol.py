"""Columns that parse agent messages: strict actions, tool calls, answers, quantities."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four block tags of a message.
TAGS = ["think", "tool_call", "answer", "tool_response"]


def _count(text: Column, tag: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rf"<{tag}>"), F.lit(0))) + F.size(F.regexp_extract_all(text, F.lit(rf"</{tag}>"), F.lit(0)))


def _body(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def action(text: Column) -> Column:
    """struct(attempted, error, body): a message must be one think block and then one tool_call or answer block, with
    nothing outside; a tool call's body must be JSON. ``error`` is the first rule broken, null for a valid message;
    ``attempted`` is what the message tries, valid or not. Null and empty messages are ``empty``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    think, call, answer = _count(t, "think"), _count(t, "tool_call"), _count(t, "answer")
    residue = F.regexp_replace(t, r"(?s)<(think|tool_call|answer)>.*?</\1>|\s", "")
    error = (
        F.when(t == "", "empty")
        .when(think == 0, "no_think")
        .when(think != 2, "think_not_one")
        .when((call > 0) & (answer > 0), "call_and_answer")
        .when((call == 0) & (answer == 0), "no_action")
        .when((call + answer) != 2, "action_not_one")
        .when(~t.rlike(r"(?s)^<think>.*</think>"), "think_not_first")
        .when(residue != "", "text_outside")
        .when((call > 0) & F.try_parse_json(_body(t, "tool_call")).isNull(), "bad_json")
    )
    attempted = F.when(call > 0, "tool_call").when(answer > 0, "answer").otherwise("none")
    return F.struct(attempted.alias("attempted"), error.alias("error"), F.when(call > 0, _body(t, "tool_call")).when(answer > 0, _body(t, "answer")).alias("body"))


def tool_calls(body: Column) -> Column:
    """array(struct(name, arguments JSON text, valid)) of a JSON object or array of calls; empty for anything else."""
    kind = "array<struct<name:string,arguments:string>>"
    many = F.from_json(F.when(F.trim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), kind)
    named = F.transform(many, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments"), (F.coalesce(c["name"], F.lit("")) != "").alias("valid")))
    return F.coalesce(named, F.expr("cast(array() as array<struct<name:string,arguments:string,valid:boolean>>)"))


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def exact_match(answer: Column, gold: Column) -> Column:
    """1 where the normal answer equals any gold answer's, else 0."""
    return F.exists(gold, lambda g: normal_answer(g) == normal_answer(answer)).cast("int")


def last_answer(text: Column) -> Column:
    """The body of the last answer block; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))


def final_number(text: Column, strict: bool = False) -> Column:
    """The number after the last ####, or flexibly the last number; commas and dollar signs dropped; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"####\s*(-?[0-9.,]+)"), F.lit(1)) if strict else F.regexp_extract_all(text, F.lit(r"(-?\$?[0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")


def identifier_words(name: Column) -> Column:
    """The distinct lower-case words of a camelCase or snake_case identifier."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.transform(F.regexp_extract_all(spaced, F.lit(r"[A-Za-z]+|[0-9]+"), F.lit(0)), F.lower))


def failed(results: Column) -> Column:
    """Whether any tool result is an error: by prefix, or by an ``error`` key in its JSON."""
    return F.exists(results, lambda r: F.lower(F.trim(r)).startswith("error") | F.get_json_object(r, "$.error").isNotNull())


def quantities(text: Column) -> Column:
    """array(struct(value, unit)) of the numbers with a unit word or a dollar sign."""
    values = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%]+)"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%]+)"), F.lit(2))
    return F.zip_with(values, units, lambda v, u: F.struct(v.cast("double").alias("value"), F.lower(u).alias("unit")))


def position_list(text: Column) -> Column:
    """Positions of ``1,3,5-7``; an open range gives null."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: F.split(p, "-"))
    whole = F.forall(parts, lambda p: F.forall(p, lambda x: x.rlike("^[0-9]+$")))
    return F.when(whole, F.flatten(F.transform(parts, lambda p: F.sequence(F.element_at(p, 1).cast("int"), F.element_at(p, -1).cast("int")))))


def passages_text(docs: Column) -> Column:
    """Retrieved passages as one numbered text."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(": "), d)), "\n")


def role_mask(messages: Column, lengths: Column, trained: str = "assistant") -> Column:
    """The loss mask of a conversation: each message's role repeated over its tokens, 1 for the trained one."""
    return F.flatten(F.zip_with(messages, lengths, lambda m, n: F.array_repeat((m == trained).cast("int"), n)))


def action_metrics(text: Column, tools: Column) -> Column:
    """Flags of a message against the tools on offer (an array of structs of name and required, an array of names).

    valid_tool_call_block; json_parse_ok (its body is JSON); and, where there is a call, whether all calls have
    function_name_ok (a tool's name), arguments_object_ok (an object) and required_arguments_ok (all that the tool
    asks for; nothing of an unknown one); direct_answer_without_tool; malformed_output.
    """

    def flags(a: Column) -> Column:
        called, answered = a["error"].isNull() & (a["attempted"] == "tool_call"), a["error"].isNull() & (a["attempted"] == "answer")
        body = F.when(called, F.try_parse_json(F.concat(F.lit("["), a["body"], F.lit("]"))).cast("array<variant>")[0])
        return F.transform(F.array(F.struct(called.alias("called"), answered.alias("answered"), body.alias("body"))), of_body)[0]

    def of_body(m: Column) -> Column:
        called, answered, body = m["called"], m["answered"], m["body"]
        listed = F.when(F.schema_of_variant(body).startswith("ARRAY"), body.cast("array<variant>")).when(body.isNotNull(), F.array(body))
        objects = F.filter(listed, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
        arguments = lambda v: F.try_variant_get(v, "$.arguments", "variant")
        known = F.coalesce(F.transform(objects, lambda v: F.struct(F.try_variant_get(v, "$.name", "string").alias("name"), F.coalesce(F.schema_of_variant(arguments(v)).startswith("OBJECT"), F.lit(False)).alias("given"), F.json_object_keys(F.to_json(arguments(v))).alias("keys"))), F.array().cast("array<struct<name:string,given:boolean,keys:array<string>>>"))

        def of_calls(calls: Column) -> Column:
            some = F.size(calls) > 0
            required = lambda c: F.flatten(F.transform(F.filter(tools, lambda t: t["name"] == c["name"]), lambda t: F.coalesce(t["required"], F.array().cast("array<string>"))))
            all_of = lambda test: (some & F.coalesce(F.forall(calls, test), F.lit(False))).cast("int")
            return F.struct(
                called.cast("int").alias("valid_tool_call_block"), F.coalesce(called & body.isNotNull(), F.lit(False)).cast("int").alias("json_parse_ok"), all_of(lambda c: F.coalesce(F.exists(tools, lambda t: t["name"] == c["name"]), F.lit(False))).alias("function_name_ok"),
                all_of(lambda c: c["given"]).alias("arguments_object_ok"), all_of(lambda c: F.size(F.array_except(required(c), F.coalesce(c["keys"], F.array().cast("array<string>")))) == 0).alias("required_arguments_ok"),
                answered.cast("int").alias("direct_answer_without_tool"), (~called & ~answered).cast("int").alias("malformed_output"),
            )

        return F.transform(F.array(known), of_calls)[0]

    return F.transform(F.array(action(text)), flags)[0]


#: Fixed value: what follows the tools in a message that restores them.
RESTORED = "I have updated some more functions"


def restored_tools(text: Column) -> Column:
    """tools (JSON text of the array that a message begins with) and error; null for messages without the notice RESTORED.

    The notice must follow the array; each of its items must be an object with a name.
    """

    @F.arrow_udf("struct<tools: string, error: string>")
    def read(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None or RESTORED not in t:
                out.append(None)
                continue
            try:
                tools, end = json.JSONDecoder().raw_decode(t.lstrip())
                named = isinstance(tools, list) and tools and all(isinstance(x, dict) and isinstance(x.get("name"), str) for x in tools)
                error = None if named and RESTORED in t.lstrip()[end:] else "no named tools" if not named else "no notice behind the tools"
                out.append({"tools": None if error else json.dumps(tools, ensure_ascii=False, separators=(",", ":")), "error": error})
            except (ValueError, RecursionError) as e:
                out.append({"tools": None, "error": str(e)[:200]})
        return pa.array(out, pa.struct([("tools", pa.string()), ("error", pa.string())]))

    return read(text)
