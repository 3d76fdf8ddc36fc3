import json

from marlstone.functions import calls as C
from marlstone.operators import nested as N
from marlstone.operators import sequences as S


def test_masks_and_batches(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "say it"), (1, 0, "user", "ask  me"), (2, 0, None, None)], "c int, turn int, role string, text string")
    got = {r["c"]: r for r in S.conversation_tokens(rows, ["c"], "turn", "role", "text").collect()}
    assert got[1]["tokens"] == ["<|user|>", "ask", "me", "<|end|>", "<|assistant|>", "say", "it", "<|end|>"] and got[1]["mask"] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert got[2]["tokens"] == ["<||>", "<|end|>"] and got[2]["mask"] == [0, 0]
    cut = S.fixed_batches(S.conversation_tokens(rows, ["c"], "turn", "role", "text"), ["tokens", "mask"], 3).where("c = 1").orderBy("batch").collect()
    assert [(r["batch"], len(r["tokens"]), r["mask"]) for r in cut] == [(0, 3, [0, 0, 0]), (1, 3, [0, 0, 1]), (2, 2, [1, 1])]
    assert S.fixed_batches(spark.createDataFrame([([],)], "x array<int>"), ["x"], 2).count() == 0


def test_decoded(spark):
    cases = ["plain", None, '{"a": "[1, 2]"}', "{'a': (1, None), 'b': \"{'c': True}\"}", "[not a list]", "(1, 2)", '"[1]"', "[" * 400 + "]" * 400, "{1: 2}", "__import__('os')", "{[]: 1}"]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r["k"]: r["x"] and json.loads(r["x"]) for r in rows.select("k", N.decoded(rows["t"]).alias("x")).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)] == ["plain", None, {"a": [1, 2]}, {"a": [1, None], "b": {"c": True}}, "[not a list]", [1, 2], '"[1]"', {"1": 2}, "__import__('os')", "{[]: 1}"]


def test_merged(spark):
    cases = [('{"a": {"b": 1, "c": 2}}', '{"a": {"b": 2.5}, "d": null}', {"a": {"b": 2.5, "c": 2}, "d": None}, None), ('{"a": 1}', '{"a": {"b": 1}}', None, "$.a"), ('{"a": {"b": {}}}', '{"a": {"b": 1}}', None, "$.a.b"), ('{"a": true}', '{"a": 1}', None, "another type"), ('{"a": null}', '{"a": "x"}', {"a": "x"}, None), ('{"a": [1]}', '{"a": [2, 3]}', {"a": [2, 3]}, None), ("[1]", "{}", None, "no object"), (None, "{}", None, None), ("{", "{}", None, "")]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: r["x"] for r in rows.select("k", N.merged(rows["a"], rows["b"]).alias("x")).collect()}
    for k, (_, _, value, error) in enumerate(cases):
        assert (got[k]["value"] and json.loads(got[k]["value"])) == value and (got[k]["error"] is None if error is None else error in got[k]["error"]), k


def test_first_keyword_calls(spark):
    rows = spark.createDataFrame([(1, 0, "f(1)"), (1, 1, "g(a=h())"), (1, 2, "m.n(a=1)"), (1, 3, "k(a=[1, 'x'])"), (1, 4, "z(a=1)"), (2, 0, "bad("), (2, 1, None), (3, 0, "k(**x)"), (3, 1, "ok()")], "g int, n int, t string")
    assert sorted(tuple(r) for r in C.first_keyword_calls(rows, ["g"], ["n"], "t").collect()) == [(1, "k", '{"a": [1, "x"]}', "k(a=[1, 'x'])"), (3, "ok", "{}", "ok()")]
