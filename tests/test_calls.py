import json

import pytest

from marlstone.functions import calls as C
from marlstone.operators import checkers as K


def rows(text):
    return list(C.parsed(text))


@pytest.mark.parametrize(("text", "name", "arguments"), [
    ("f(a=1, b='x')", "f", {"a": 1, "b": "x"}), ("['m.n.f(a=[1, -2.5, (True, None)], b={1: \"y\", \"k\": ...})']", "m.n.f", {"a": [1, -2.5, [True, None]], "b": {"1": "y", "k": "..."}}),
    ("f(x, 3)", "f", {}), ("f(a=g(b=2), c=h(), d=v, e=v[0], f=o.p)", "f", {"a": {"g": {"b": 2}}, "c": "h()", "d": "v", "e": "v[0]", "f": "o.p"}),
    ("f(a=2+3*4, b='x'+'y', c=1/0, d=2**9, e=+7)", "f", {"a": 14, "b": "xy", "c": "1 / 0", "d": "2 ** 9", "e": 7}), ("f(a=b'x', b=1j)", "f", {"a": "b'x'", "b": "1j"}),
])
def test_arguments(text, name, arguments):
    kind, call, got, _, told, _, error = rows(text)[0]
    assert (kind, call, got, error) == ("call", 0, name, None) and json.loads(told) == arguments


@pytest.mark.parametrize("text", ["", "f(", "1 + 2", "x", "f(a=lambda: 1)", "f(a=__import__('os').system('x') if 1 else 2)", "f(" * 5000, "f(a='" + "x" * 20_000 + "')", "f(\0)", "[1, f()]"])
def test_unreadable(text):
    assert [r[0] for r in rows(text)] == ["error"] and rows(text)[0][6]


def test_several_calls_and_edges():
    got = rows("[f(a=1), g(h(), b=[i(j=1), k()], c=l(m(n=o())))]")
    assert [r[1:3] for r in got if r[0] == "call"] == [(0, "f"), (1, "g")] and [r[5] for r in got if r[0] == "call"] == [1, 2]
    assert [(r[2], r[3]) for r in got if r[0] == "edge"] == [("h", "g"), ("i", "g"), ("l", "g"), ("m", "l"), ("o", "m")]
    assert rows("f(a=g(h(x=1)))")[0][5] == 3 and rows("f(1)(2)")[0][2] == "" and rows(None) == []


def test_shapes_change_no_result(monkeypatch):
    """Texts alike but for their numbers are parsed once, and numbers that have a say in more than their place each time."""
    forms = [
        "shop.buy(part={0}, note='x {0} y', back=-{1}, gift=True)", "send(what=find(part={0}, where=locate(supplier={1})), times={0}*{1})", "pack(items=[find(part={0}), 'box'], tag={{'k': None}})", "broken({0}", "[f(a={0}), g(b=[{1}, -{0}])]",
        "f(a={{({0}): 1, ({1}): 2}}, b={{'x,{0},': 1, 'x,{1},': 2}})", "f(a=({0})%({1}), b=({0})+0, c=-({1}))", "f(a=h({0}, {1}), b=v[{0}], c={0}.5, d={0}e2, e=0{1})", "f(a={0}, a={1})", "'f(a={0})', 'g(a={1})'", "f(a='it\\'s,{0},', b={1})", "f(a={0}) # {1}", "f(a={{h({0}): 1, h({1}): 2}})", "f({0})({1})", "f(a=f'{{x:{0}}}', b={1})", "f(a='{0}', b=- {1}, c = {0} )", "f(a={0}\n,b={1})", "f(a=g(b=({0}).real), c=({1},))",
    ]
    for form in forms:
        shapes = {}
        for a, b in [(7, 9), (9, 7), (5, 5), (0, 12), (730000000000000000, 730000000000000001), (123456789012345, 1), (10**30, 3), (7, 9)]:
            text = form.format(a, b)
            assert C.parsed_alike(text, shapes) == rows(text), text
    calls, whole = [], C.parsed
    monkeypatch.setattr(C, "parsed", lambda t: calls.append(t) or whole(t))
    shapes = {}
    for k in range(1, 100):
        C.parsed_alike(forms[0].format("4", k), shapes), C.parsed_alike(forms[3].format(k), shapes)
    assert len(calls) == 2


def test_table_function(spark):
    data = spark.createDataFrame([(1, 0, "f(a=1)", 9), (1, 1, "g(b=f(a=2)), h()", 9), (2, 0, "bad(", 9), (3, 0, None, 9)], "id int, nth int, text string, call int")
    got = C.with_calls(data, "text")
    assert got.columns == ["id", "nth", "text", "kind", "call", "name", "consumer", "arguments", "depth", "error"]
    assert sorted((r["id"], r["kind"], r["call"], r["name"] or "", r["consumer"] or "") for r in got.collect()) == [(1, "call", 0, "f", ""), (1, "call", 0, "g", ""), (1, "call", 1, "h", ""), (1, "edge", 0, "f", "g"), (2, "error", 0, "", "")]
    canonical = sorted((r["id"], r["call_idx"], r["name"], r["valid"]) for r in C.canonical_calls(data, ["id"], "nth", "text").collect())
    assert canonical == [(1, 0, "f", True), (1, 1, "g", True), (1, 2, "h", True), (2, 0, None, False)]
    assert C.with_calls(data.where("false"), "text").count() == 0
    spark.udtf.register("call_rows", C.call_rows)
    data.createOrReplaceTempView("call_texts")
    lateral = spark.sql("SELECT t.id, c.kind, c.name, c.consumer FROM call_texts t, LATERAL call_rows(t.text) c").collect()
    assert sorted(map(tuple, lateral), key=repr) == sorted(((r["id"], r["kind"], r["name"], r["consumer"]) for r in got.collect()), key=repr)


def test_profile(spark):
    turns = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "seed int, turn int")
    calls = spark.createDataFrame([(1, 0, 0, "f(a=g(b=1))"), (1, 0, 1, "x.y(1)"), (1, 2, 0, "oops("), (1, 2, 1, "g()")], "seed int, turn int, nth int, text string")
    catalog = spark.createDataFrame([("f", "Files"), ("g", "Graphs"), ("x.y", "Files")], "name string, class string")
    got = {r["seed"]: r for r in C.structural_profile(turns, calls, catalog, "seed", "turn", "nth", "text").collect()}
    assert got[1]["calls_per_turn"] == [2, 0, 2] and got[1]["classes_per_turn"] == [["Files"], [], ["Graphs"]] and got[1]["depth"] == 2 and got[1]["unreadable"] == 1
    assert [tuple(e) for e in got[1]["edges"]] == [(0, 0, "g", "f")] and (got[2]["turns"], got[2]["calls_per_turn"], got[2]["edges"], got[2]["depth"]) == (1, [0], [], 0)


def checked(spark, model, gold, states=()):
    """Conversations from {id: [[results of a turn], ...]} of model and gold, and (id, turn, class, place, attribute, model, gold) of states."""
    table = lambda x: spark.createDataFrame([(i, t, v) for i, turns in x.items() for t, vs in enumerate(turns) for v in vs], "id int, turn int, value string")
    turns = spark.createDataFrame([(i, t, len(gold[i][t]), len(vs)) for i, turns in model.items() for t, vs in enumerate(turns)], "id int, turn int, gold_calls int, model_calls int")
    state = lambda k: spark.createDataFrame([(s[0], s[1], s[2], s[3], s[4], s[k]) for s in states if s[k] != "absent"], "id int, turn int, class string, place int, attribute string, value string")
    wrong = K.state_mismatches(state(5), state(6), ["id", "turn"])
    missing = K.missing_responses(table(model), table(gold), ["id"], "turn", "value")
    return {r["id"]: (r["valid"], r["turn"], r["error"], r["subject"]) for r in K.checked_turns(turns, wrong, missing, ["id"]).collect()}, sorted((r["id"], r["turn"], r["value"], r["missing"]) for r in missing.collect()), sorted(tuple(r) for r in K.idle_turn_failures(turns, ["id"]).collect())


def test_first_failure_counts(spark):
    model = {1: [["a", "b"], ["c"]], 2: [["a"], ["x"]], 3: [["a"], []], 4: [["z"], ["a"]], 5: [["q"], ["a"]], 6: [["a"], ["b"]], 7: [["a", "a"], ["b"]]}
    gold = {1: [["b"], ["a", "c"]], 2: [["a"], ["a", "a"]], 3: [["a"], ["a"]], 4: [[], ["z", "a"]], 5: [["q"], ["a"]], 6: [["a"], ["b"]], 7: [["a"], ["a", "a", "b"]]}
    states = [(5, 1, "B", 1, "x", "1", "2"), (5, 1, "A", 0, "y", None, "2"), (6, 0, "A", 0, "_private", "1", "2"), (6, 1, "A", 0, "same", None, None), (1, 0, "A", 0, "gone", "absent", "1")]
    got, missing, idle = checked(spark, model, gold, states)
    assert got == {1: (False, 0, "state_mismatch", "A"), 2: (False, 1, "response_mismatch", None), 3: (False, 1, "empty_response", None), 4: (True, None, None, None), 5: (False, 1, "state_mismatch", "A"), 6: (True, None, None, None), 7: (True, None, None, None)}
    assert missing == [(2, 1, "a", 1)] and idle == [(4, 0)]


def test_forced_scores(spark):
    data = [(0, "answer", 0, 1.0), (0, "tool_call", 0, 0.0), (0, "parse_error", 0, -3.0), (0, "parse_error", 5, 0.0), (2, "parse_error", 5, 0.5), (2, "parse_error", 4, -3.0), (2, "tool_call", 0, None), (2, "answer", 0, None)]
    rows = spark.createDataFrame(data, "gold int, response string, attempts int, want double")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", K.forced_score(rows["gold"], rows["response"], rows["attempts"], 5, K.F.lit(0.5))).collect())
