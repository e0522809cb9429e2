import pytest

from rankframe.functions.code import longest_code, needed_code
from rankframe.plans import engines, registry, run


def test_arguments_are_bound_to_types():
    parameters = [{"name": "a", "type": "int"}, {"name": "b", "type": "float"}]
    assert engines.bind("1, 2", parameters) == {"a": 1, "b": 2.0} and type(engines.bind("1, 2", parameters)["b"]) is float
    assert engines.bind("b=1.5, a=3.0", parameters) == {"b": 1.5, "a": 3}
    assert engines.bind("", parameters) == {} and engines.bind("1, 2, 3", parameters)["_pos_2"] == 3
    for bad in ("open('x')", "a b", "1 +", "*x"):
        assert engines.bind(bad, parameters) is None


def test_first_call_of_a_known_tool():
    tools = {"add": {"name": "add", "parameters": []}}
    said = "TOOL_CALL: other(1)\nTOOL_CALL: add(x)\nTOOL_CALL: add(a=1)\nrest"
    assert engines.find_call(said, tools) == ("TOOL_CALL: other(1)\nTOOL_CALL: add(x)\nTOOL_CALL: add(a=1)", "add", {"a": 1})
    assert engines.find_call("no call", tools) is None


def test_tool_loop_ends_and_reports_errors():
    skills = [{"skill_id": "s", "tools": [{"name": "f", "parameters": []}]}]
    asked = []

    def always(system, talk):
        asked.append(talk)
        return "TOOL_CALL: f(x=1)"

    got = engines.direct(always, "", "q", skills, functions={"f": lambda x: 1 / 0})
    assert len(asked) == engines.TOOL_ROUNDS and got.transcript.count("TOOL_RESULT: Error: ZeroDivisionError") == engines.TOOL_ROUNDS
    assert engines.direct(lambda s, u: "", "", "q", skills).text == ""
    assert engines.direct(lambda s, u: "plain", "", "q", []).transcript is None


def test_skills_by_number_id_and_name():
    shelf = engines.Shelf([{"skill_id": "a", "name": "One", "content": "x"}, {"skill_id": "1", "name": "one", "content": "y"}, {"skill_id": "c", "name": "", "content": "z"}])
    assert [shelf.find(k)["skill_id"] for k in ("0", "1", "a", "ONE", "c")] == ["a", "1", "a", "a", "c"]
    assert shelf.find("7") is None and "no skill" in shelf.load("7") and shelf.loaded == []
    assert "Skill #2" in shelf.catalog() and "Skill loaded: Unnamed skill" in shelf.load("2")


def test_react_stops():
    steps = iter([" a\nAction 1: X[1]\nObservation 1: own", " b\nAction 2: Finish[2]"])
    got = engines.react(lambda s, u: next(steps), "", "q", [], execute=lambda a: "y" * 4000)
    assert got.text == "Thought 1: a\nAction 1: X[1]\nThought 2: b\nAction 2: Finish[2]"
    assert "... (truncated, 4000 chars total)" in got.transcript
    endless = engines.react(lambda s, u: " z\nAction: X[1]", "", "q", [])
    assert endless.text.count("Thought") == engines.REACT_STEPS


def test_every_grid_cell_has_an_engine():
    for e in run.EXPERIMENTS.values():
        for m in e.methods:
            for dataset in ("toolqa", "champ"):
                assert registry.ENGINES.get(m.engine_for(dataset))
            assert registry.PROVIDERS.get(m.provider)
    assert {"bm25", "tfidf", "linearrag", "rrf", "hybrid", "llm_rerank"} <= set(registry.RETRIEVERS.names())
    assert len({registry.EVALUATORS.get(n) for n in registry.EVALUATORS.names()}) == 6
    assert set(registry.listing()) == {"retriever", "provider", "engine", "evaluator"}


CODE = """Sure!
```python
import os
from a import b

LIMIT = 3

@dec
def decorated():
    return LIMIT

def helper(x):
    return x + LIMIT

def unused():
    return 1

class Main:
    def run(self):
        return helper(2)
```
Good luck."""


def test_code_that_an_entry_point_needs():
    got = needed_code(CODE, "Main")
    assert got == "import os\nfrom a import b\nLIMIT = 3\ndef helper(x):\n    return x + LIMIT\nclass Main:\n    def run(self):\n        return helper(2)"
    assert "unused" in needed_code(CODE, None) and "decorated" not in needed_code(CODE, None)
    assert longest_code("x = 1\ny = 2\nsome plain text!\nz = 3") == "x = 1\ny = 2"
    assert longest_code("no code at all") == "no code at all" and needed_code("", "f") == "" and needed_code(None, None) == ""


def test_evaluation_stops_at_an_unknown_dataset(spark):
    from rankframe.operators.answers import evaluate_answers

    instances = spark.createDataFrame([("1", "nothing", "q", "a", None, None, None, None, None, None)], "instance_id string, dataset string, question string, answer string, answer_type string, task_type string, output_type string, calculator_id int, lower_limit string, upper_limit string")
    records = spark.createDataFrame([("1", "x")], "instance_id string, raw_output string")
    with pytest.raises(Exception, match="no judge for dataset nothing"):
        evaluate_answers(records, instances)[0].collect()


def test_summary_of_one_dataset(spark):
    from rankframe.operators import metrics

    rows = spark.createDataFrame([("a", True), ("a", False)], "dataset string, correct boolean")
    assert metrics.summary(rows).first()["accuracy"] == 0.5
    with pytest.raises(Exception, match="one dataset"):
        metrics.summary(rows.union(spark.createDataFrame([("b", True)], rows.schema))).collect()


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from rankframe.streaming.scoring import windowed_counts

    source = str(tmp_path / "events")
    rows = [(f"2024-01-01 00:0{m}:30", "click" if m % 2 else "view", float(m)) for m in range(10)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) AS ts", "event_type", "value")
    df.write.parquet(source)
    out = windowed_counts(spark.readStream.schema(df.schema).parquet(source))
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window"].start.minute, r.event_type): (r.n, r.value) for r in spark.table("windows").collect()}
    assert got == {(0, "view"): (3, 6.0), (0, "click"): (2, 4.0), (5, "view"): (2, 14.0), (5, "click"): (3, 21.0)}


def test_occurrences_in_one_pass(monkeypatch):
    from rankframe.operators import matching

    text, names = "aaa aa aaaa baab Aa", ["aa", "aaa", "b", "Aa", "aab"]
    want = [text.count(x) for x in names]
    assert matching.occurrences(text, names) == want
    monkeypatch.setattr(matching, "ONE_PASS", 0)
    assert matching.occurrences(text, names) == want


def test_containing(spark):
    import numpy as np

    from rankframe.operators.containment import containing

    rng = np.random.default_rng(2)
    docs = [(k, "".join(rng.choice(list("abé "), 60))) for k in range(40)] + [(99, None), (98, "")]
    asked = [(k, docs[k][1][5 : 5 + int(rng.integers(2, 9))]) for k in range(20)] + [(50, "zzz"), (51, None), (52, "ab")]
    got = containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"))
    want = {(q, d) for q, x in asked for d, t in docs if x is not None and t is not None and x in t}
    assert {(r.query_id, r.doc_id) for r in got.collect()} == want
