import json

import pytest
from pyspark.sql import functions as F

from rankframe.operators import tools
from rankframe.plans import registry, run
from rankframe.sources import io
from rankframe.streaming import scoring

ROWS = [("9", "x"), ("10", "y"), (None, "z")]


@pytest.fixture
def data(spark):
    return tools.as_strings(spark.createDataFrame(ROWS, "n string, t string"))


def test_filter_is_lexicographic_and_reverts(data):
    out, said = tools.filter_db(data, "n>2")
    assert sorted(r.n for r in out.collect()) == ["9", "nan"] and "2 rows" in said
    out, said = tools.filter_db(data, "t='x', n=5")
    assert out.count() == 3 and "incorrect" in said
    out, said = tools.filter_db(data, "t=x, nope=1")
    assert out.count() == 1 and "failed" in said
    assert tools.filter_db(data, "no operator")[0].count() == 3
    assert "failed" in tools.filter_db(data, "n =9")[1]


def test_session(spark, data):
    nodes = spark.createDataFrame([("PaperNet", "1", "P", {"y": "1"}), ("PaperNet", "2", "Q", {"y": "2"})], "graph string, id string, name string, attrs map<string,string>")
    edges = spark.createDataFrame([("PaperNet", "1", "2", {"w": "3"})], "graph string, src string, dst string, attrs map<string,string>")
    s = tools.ToolSession(spark, lambda name: data, lambda name: (nodes, edges))
    assert "columns: n, t" in s.execute("LoadDB[demo]")
    assert "1 rows" in s.execute("FilterDB[t=x]")
    assert s.execute("GetValue[n]") == "9"
    s.execute("LoadDB[demo]")
    assert s.execute("GetValue[n]") == ", ".join(r.n for r in tools.as_strings(data).collect())  # as the rows come
    assert s.execute("SQLInterpreter[SELECT count(*) AS c FROM demo.demo_data]") == "c: 3"
    assert s.execute("Calculate[(-17)-(-7)]") == "-10"
    s.execute("LoadGraph[dblp]")
    assert s.execute("NeighbourCheck[PaperNet, Q]") == "['P']"
    assert "3" in s.execute("EdgeCheck[PaperNet, Q, P]")
    assert "multiple" in s.execute("A[1], B[2]") and "Invalid" in s.execute("Nope[1]") and "empty" in s.execute("")
    assert s.execute("Calculate[__import__('os')]").startswith("Error")
    assert s.execute("Finish[done]") == "done"


def test_corpus_and_retrieval_round_trip(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps([{"skill_id": "a", "name": "1"}, {"skill_id": "b"}, {"skill_id": "a", "name": "2"}]))
    rows = io.read_corpus(spark, str(path))
    assert {r.skill_id: r.name for r in io.keyed_corpus(rows).collect()} == {"a": "2", "b": None}
    assert io.first_rows(rows, 2).count() == 2 and io.first_rows(rows, 0).count() == 0
    ranked = spark.createDataFrame([("q", "a", 1, 2.0), ("q", "b", 2, 1.0)], "instance_id string, skill_id string, rank int, score double")
    gold = spark.createDataFrame([("q", ["a"]), ("r", ["b"])], "instance_id string, gold_skill_ids array<string>")
    metric = spark.createDataFrame([("recall_1", 0.5)], "metric string, value double")
    io.write_retrieval(ranked, gold, metric, str(tmp_path / "out"), "bm25", 2, 10)
    back, meta = io.read_retrieval(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("q", "a", 1, 2.0), ("q", "b", 2, 1.0)]
    assert meta.first()["metadata"]["n_queries"] == 2 and meta.first()["metadata"]["dataset"] is None
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))  # one document
    assert [(r["instance_id"], r["gold_skill_ids"], len(r["retrieved"])) for r in whole["results"]] == [("q", ["a"], 2), ("r", ["b"], 0)] and whole["metrics"] == {"recall_1": 0.5}
    io.write_retrieval(ranked.limit(0), gold.limit(0), metric, str(tmp_path / "none"), "bm25", 2, 10)
    assert io.read_retrieval(spark, str(tmp_path / "none"))[0].count() == 0


def test_torn_records_and_resume(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"instance_id": "a", "raw_output": "x"}\n\n{"instance_id": "b", "error": "E"}\n{"instance_id": "c", "raw')
    done = io.read_records(spark, str(tmp_path / "r.jsonl"))
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    assert [r.instance_id for r in run.pending(todo, done).collect()] == ["c"]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "emb")
    make = lambda *ids: spark.createDataFrame([(i, "t", [1.0]) for i in ids], "hash_id string, text string, embedding array<float>")
    io.upsert_embeddings(make("a", "b"), path)
    io.upsert_embeddings(make("b", "c"), path)
    assert sorted(r.hash_id for r in io.read_embeddings(spark, path).collect()) == ["a", "b", "c"]


def test_dense_ids(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "k long")
    assert [(r.k, r.pos) for r in io.dense_ids(rows, "k").orderBy("k").collect()] == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]


def test_run_many_keeps_errors_and_discloses(spark):
    inst = spark.createDataFrame([("a", "logicbench", "hi"), ("b", "logicbench", "bad")], "instance_id string, dataset string, question string")
    chosen = spark.createDataFrame([("a", 1, "s")], "instance_id string, place int, skill_id string")
    skills = spark.createDataFrame([("s", "Name", "d", "BODY")], "skill_id string, name string, description string, content string")

    def reply(system, user):
        if "bad" in user:
            raise ValueError("no")
        return "got body" if "BODY" in user else "LOAD_SKILL: name"

    got = {r.instance_id: r for r in run.run_many(inst, chosen, skills, reply, "progressive_disclosure").collect()}
    # the output is all that was said, the transcript also what was told in between
    assert got["a"].raw_output == "LOAD_SKILL: namegot body" and got["a"].transcript.endswith("got body") and "BODY" in got["a"].transcript
    assert got["b"].error == "ValueError: no" and got["a"].skill_ids_used == ["s"]


def test_grid_and_registry(spark):
    g = run.grid(spark, "main", ["champ", "toolqa"], {("champ", "bm25")})
    assert g.count() == 7 and len(run.EXPERIMENTS) == 9
    assert registry.runnable_datasets()[0] == ["bigcodebench", "champ", "logicbench", "medcalcbench", "theoremqa", "toolqa"]
    with pytest.raises(KeyError):
        registry.RETRIEVERS.get("nope")
    assert run.key_values(["k=1", "s=x"]) == {"k": 1, "s": "x"}


def test_stream_scoring(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "in"))
    q = scoring.score_stream(stream, lambda b: b.withColumn("n", F.length("text")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
