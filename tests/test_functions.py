"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import protocol, scoring
from marlstone.operators import select


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def codes(*c):
    return F.array(*[F.lit(x) for x in c]) if c else F.expr("cast(array() as array<int>)")


ACTIONS = [
    ('<think>x</think><tool_call>{"name": "f"}</tool_call>', "tool_call", None), ("<think>x</think> <answer>y</answer> ", "answer", None), ("", "none", "empty"), (None, "none", "empty"),
    ("<answer>y</answer>", "answer", "no_think"), ("<think>a</think><think>b</think><answer>y</answer>", "answer", "think_not_one"), ("<think>a</think>", "none", "no_action"),
    ("<think>a</think><answer>y</answer><answer>z</answer>", "answer", "action_not_one"), ("<think>a</think><answer>y</answer><tool_call>{}</tool_call>", "tool_call", "call_and_answer"),
    ("<answer>y</answer><think>a</think>", "answer", "think_not_first"), ("<think>a</think>loose<answer>y</answer>", "answer", "text_outside"), ("<think>a</think><tool_call>{nope</tool_call>", "tool_call", "bad_json"),
]


def test_actions(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(ACTIONS)], "k int, t string")
    got = {r.k: r.a for r in df.select("k", protocol.action(F.col("t")).alias("a")).collect()}
    assert [(got[k].attempted, got[k].error) for k in range(len(ACTIONS))] == [(a, e) for _, a, e in ACTIONS]


def test_tool_calls(spark):
    r = one(spark, protocol.tool_calls(F.lit('[{"name":"f","arguments":"{}"},{"arguments":"{}"}]')), protocol.tool_calls(F.lit("nope")), protocol.tool_calls(F.lit('{"name":"g","arguments":{"a":1}}')))
    assert [(c.name, c.valid) for c in r.c0] == [("f", True), (None, False)]
    assert r.c2[0].name == "g" and r.c2[0].arguments == '{"a":1}'


def test_answers(spark):
    r = one(
        spark, protocol.normal_answer(F.lit("The  quick, a Fox!")), protocol.exact_match(F.lit("a Dog"), F.array(F.lit("cat"), F.lit("dog."))), protocol.last_answer(F.lit("<answer>1</answer><answer>2\n</answer>")),
        protocol.last_answer(F.lit("none")), protocol.final_number(F.lit("so 1,200 then $3.50")), protocol.final_number(F.lit("x #### 1,234"), True), protocol.identifier_words(F.lit("getUserName_fromID2")),
        protocol.position_list(F.lit("1,3,5-7")), protocol.position_list(F.lit("1-")), protocol.failed(F.array(F.lit("ok"), F.lit('{"error": "x"}'))), protocol.role_mask(F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit(1), F.lit(2))),
    )
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5) == ("quick fox", 1, "2\n", None, "3.50", "1234")
    assert r.c6 == ["get", "user", "name", "from", "id", "2"] and r.c7 == [1, 3, 5, 6, 7] and r.c8 is None and r.c9 and r.c10 == [0, 1, 1]


def test_code_rewards(spark):
    r = one(spark, scoring.progress(codes(1, 0, 1, -3)), scoring.progress(codes()), scoring.stage_one_score(codes(-3, -1, 1, 0)), scoring.fixed_progress(codes(1, 1, 0), F.lit(4)), scoring.codes_of_counts({1: F.lit(2), -3: F.lit(1)}))
    assert (round(r.c0, 6), r.c1, round(r.c2, 6), r.c3, r.c4) == (0.666667, 0.0, round(0.75 + 2 / 3, 6), 0.5, [-3, 1, 1])
    with pytest.raises(Exception, match="terminal"):
        one(spark, scoring.fixed_progress(codes(1, 1), F.lit(1)))


def test_similarity(spark):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv]) if kv else F.expr("cast(map() as map<string,string>)")
    r = one(
        spark, scoring.call_similarity(F.lit("f"), m("a", "1", "b", "2"), F.lit("F"), m("a", "9", "b", "8")), scoring.call_similarity(F.lit("LOOKUP"), m(), F.lit("lookup"), m()), scoring.call_similarity(F.lit("f"), m(), F.lit("g"), m()),
        scoring.multiset_jaccard(codes(1, 1, 2), codes(1, 2, 2)), scoring.multiset_jaccard(codes(), codes()), scoring.multiset_jaccard(codes(1), codes()),
    )
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5) == (0.5, 1.0, 0.0, 0.5, 1.0, 0.0)


def test_capability(spark):
    r = one(spark, *[select.capability(F.lit(x)) for x in (0.1, 0.2, 0.85, 0.9)], select.boundary_priority(F.lit(0.5)))
    assert list(r) == ["too_hard", "boundary", "boundary", "mastered", 1.0]
    with pytest.raises(Exception, match="range"):
        one(spark, select.capability(F.lit(1.5)))


def test_units_dates_and_schedules(spark):
    r = one(
        spark, scoring.converted(F.lit(100.0), "c", "f"), scoring.converted(F.lit(1.0), "mi", "km"), scoring.in_market_hours(F.lit("09:30 AM")), scoring.in_market_hours(F.lit("04:01 PM")), scoring.in_market_hours(F.lit("soon")),
        scoring.age_at(F.to_date(F.lit("2000-03-01")), F.to_date(F.lit("2018-02-28"))), scoring.warmup_cosine(F.lit(5), 10, 110), scoring.warmup_cosine(F.lit(60), 10, 110), scoring.unit(F.array(F.lit(3.0), F.lit(4.0))),
    )
    assert (round(r.c0, 6), round(r.c1, 6), r.c2, r.c3, r.c4, r.c5, r.c6, round(r.c7, 6), r.c8) == (212.0, 1.609344, True, False, None, 17, 0.5, 0.5, [0.6, 0.8])
