import json

from marlstone.functions import protocol as P
from marlstone.operators import gates


def test_action_metrics(spark):
    tools = [("f", ["a", "b"]), ("g", None)]
    call = lambda x: f"<think>t</think><tool_call>{json.dumps(x)}</tool_call>"
    cases = [
        (call({"name": "f", "arguments": {"a": 1, "b": 2, "c": 3}}), (1, 1, 1, 1, 1, 0, 0)), (call([{"name": "g", "arguments": {}}, {"name": "f", "arguments": {"a": 1}}]), (1, 1, 1, 1, 0, 0, 0)), (call({"name": "none", "arguments": {}}), (1, 1, 0, 1, 1, 0, 0)),
        (call({"name": "g", "arguments": "{}"}), (1, 1, 1, 0, 1, 0, 0)), (call([1, "x"]), (1, 1, 0, 0, 0, 0, 0)), ("<think>t</think><answer>x</answer>", (0, 0, 0, 0, 0, 1, 0)), ("<think>t</think><tool_call>{</tool_call>", (0, 0, 0, 0, 0, 0, 1)), ("", (0, 0, 0, 0, 0, 0, 1)), (None, (0, 0, 0, 0, 0, 0, 1)), (call({"name": "f"}), (1, 1, 1, 0, 0, 0, 0)),
    ]
    rows = spark.createDataFrame([(k, t, tools) for k, (t, _) in enumerate(cases)], "k int, t string, tools array<struct<name: string, required: array<string>>>")
    got = {r["k"]: tuple(r["m"]) for r in rows.select("k", P.action_metrics(rows["t"], rows["tools"]).alias("m")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_restored_tools(spark):
    notice = P.RESTORED
    cases = [(f'  [{{"name": "f"}}] {notice}.', '[{"name":"f"}]', None), ("nothing", None, None), (None, None, None), (f"{notice}", None, "Expecting"), (f'[1] {notice}', None, "no named"), (f'[{{"name": "{notice}"}}]', None, "no notice"), (f"[] {notice}", None, "no named")]
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(cases)], "k int, t string")
    got = {r["k"]: r["x"] for r in rows.select("k", P.restored_tools(rows["t"]).alias("x")).collect()}
    for k, (_, tools, error) in enumerate(cases):
        assert (got[k] and got[k]["tools"]) == tools and (error in got[k]["error"] if error else not got[k] or got[k]["error"] is None), k


def test_preservation(spark):
    cases = [(["a", "b"], ["x", "a", "y", "b"], True), (["b", "a"], ["a", "b"], False), (["a", "a"], ["a"], False), ([" ", "a"], ["a"], True), ([], [], True), (["a", "b"], ["a", "b"], True), (["z", "a"], ["a"], False)]
    rows = spark.createDataFrame([(k, p, w) for k, (p, w, _) in enumerate(cases)], "k int, p array<string>, w array<string>")
    got = {r["k"]: r["x"] for r in rows.select("k", gates.kept_in_order(rows["p"], rows["w"]).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [x for *_, x in cases]
    assert tuple(gates.preservation_audit(rows.selectExpr("'c' AS c", "p", "w"), "c", "p", "w").first()) == ("c", 7, 2, 4)
