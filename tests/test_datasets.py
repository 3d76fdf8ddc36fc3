import hashlib
import json

import pytest

from marlstone.sources import datasets as D


def test_prompts(spark, tmp_path):
    for k, names in enumerate((["prompt", "n"], ["prompt", "n"], ["prompt", "m"])):
        spark.createDataFrame([(f"p{k}", k)], names).write.parquet(f"{tmp_path}/{k}")
    assert sorted(r["prompt"] for r in D.prompts(spark, f"{tmp_path}/0", f"{tmp_path}/1").collect()) == ["p0", "p1"]
    with pytest.raises(ValueError, match="not the columns"):
        D.prompts(spark, f"{tmp_path}/0", f"{tmp_path}/2")


def test_nested_keys_pairs_and_messages(spark):
    rows = spark.createDataFrame([(({"q": {"text": "ask"}}), {"a": "say"}, "c", "r", 1)], "prompt struct<q: struct<text: string>>, response map<string, string>, chosen string, rejected string, extra int")
    assert [tuple(r) for r in D.prompt_responses(rows, prompt_keys=["q", "text"], response_keys=["a"]).collect()] == [("ask", "say")]
    assert D.prompt_responses(rows, prompt_keys=["q", "text"], response_keys=["none"]).first()["response"] is None
    assert D.preference_pairs(rows).columns == ["prompt", "chosen", "rejected"]
    with pytest.raises(ValueError, match="no column"):
        D.preference_pairs(rows.drop("chosen"))
    talk = spark.createDataFrame([([("user", "hi")],)], "messages array<struct<role: string, content: string>>")
    assert D.conversations(talk).first().asDict() == {"messages": [("user", "hi")], "tools": None, "thinking": None}
    more = talk.selectExpr("messages", "array(named_struct('name', 'f')) AS tools", "true AS enable_thinking", "1 AS other")
    assert D.conversations(more).first()["tools"] == '[{"name":"f"}]' and D.conversations(more).first()["thinking"] is True
    with pytest.raises(ValueError, match="no messages"):
        D.conversations(rows.withColumnRenamed("chosen", "messages"))


def test_length_and_labels(spark):
    rows = spark.createDataFrame([("a b  c", "x"), (" one ", ""), (None, None), ("", "y")], "text string, label string")
    assert {r["text"] for r in D.within_length(rows, rows["text"], 2).collect()} == {"", " one ", None}
    assert sorted(r["label"] for r in D.labelled(rows).collect()) == ["x", "y"]


def test_json_records(spark, tmp_path):
    (tmp_path / "lines").write_text('{"a": 1}\n\n  {"b": [2]}\r\n')
    (tmp_path / "array").write_text('[{"c": 3},\n {"d": null}]')
    (tmp_path / "one").write_text('{\n"e": "x"\n}')
    (tmp_path / "empty").write_text("")
    got = sorted((r["file"].rsplit("/", 1)[1], r["place"], json.loads(r["record"])) for r in D.json_records(spark, *(f"{tmp_path}/{n}" for n in ("lines", "array", "one", "empty"))).collect())
    assert got == [("array", 0, {"c": 3}), ("array", 1, {"d": None}), ("lines", 0, {"a": 1}), ("lines", 1, {"b": [2]}), ("one", 0, {"e": "x"})]
    (tmp_path / "bad").write_text('{"a": 1}\nnope\n[1]')
    with pytest.raises(Exception, match="no JSON object"):
        D.json_records(spark, f"{tmp_path}/bad").collect()
    assert D.json_records(spark, f"{tmp_path}/bad", strict=False).count() == 1


def test_asset_checks(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"content")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/t")
    digest = hashlib.sha256(b"content").hexdigest()
    assets = [(f"{tmp_path}/f", digest.upper(), None), (f"{tmp_path}/none", digest, 1), (f"{tmp_path}/t", None, 7)]
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in D.asset_checks(spark, assets).collect()} == {"f": "ok", "none": "missing", "t": "ok"}
    wrong = [(f"{tmp_path}/f", "0" * 64, None), (f"{tmp_path}/t", None, 8)]
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in D.asset_checks(spark, wrong).collect()} == {"f": "digest", "t": "rows"}


def test_replay(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(json.dumps(x) for x in [{"role": "judge", "text": "j0"}, {"role": "planner", "response": "p0"}, {"role": "judge", "text": "j1"}]))
    given = D.recorded(D.json_records(spark, f"{tmp_path}/log"))
    asked = spark.createDataFrame([(1, "judge"), (2, "judge"), (3, "planner"), (4, "judge"), (5, "nobody")], "id int, role string")
    assert {r["id"]: r["text"] for r in D.replayed(asked, given, "role", ["id"], ["file", "place"]).collect()} == {1: "j0", 2: "j1", 3: "p0", 4: None, 5: None}
    (tmp_path / "broken").write_text('{"role": "judge"}')
    with pytest.raises(Exception, match="invalid replay record"):
        D.recorded(D.json_records(spark, f"{tmp_path}/broken")).collect()


def test_side_columns_and_united_keys(spark):
    batch = spark.createDataFrame([(0, "a"), (1, "b")], "row int, text string")
    side = lambda *v: spark.createDataFrame(list(enumerate(v)), "row int, value int")
    assert D.with_side_columns(batch, {"score": side(5, 6), "short": side(1)}, "row").columns == ["row", "text", "score"]
    parts = [spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2.5,)], "c double")]
    whole = D.united_by_keys(parts)
    assert whole.columns == ["a", "b", "c"] and sorted(tuple(r) for r in whole.collect()) == [("", "", "2.5"), ("x", "1", "")]
