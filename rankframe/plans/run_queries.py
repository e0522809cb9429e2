"""Registered queries of answers, engines, runs and the whole graph retriever."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankframe.functions import prompts, text as T
from rankframe.functions.arithmetic import calculate
from rankframe.functions.code import code_column
from rankframe.operators import answers, dense, graph, matching, rerank, select, tools
from rankframe.plans import engines, run
from rankframe.plans.queries import _ENT, _net, BM25_10, EDGES, bm25_10, corpus, query, questions, table, top


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def _str(column: str) -> Column:
    return F.col(column).cast("string")


# ---- text functions ----------------------------------------------------------------------


@query("SELECT conv_id, turn, '[1] ' || role || ': ' || text || chr(10) || '[2] x: ' || role AS lines FROM conversations")
def candidate_lines(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.array(F.struct(F.col("role").alias("name"), F.col("text").alias("description")), F.struct(F.lit("x").alias("name"), F.col("role").alias("description")))
    return _talk(spark, sf).select("conv_id", "turn", T.candidate_lines(shown).alias("lines"))


@query("""SELECT o_orderkey, '{"n": ' || o_orderkey::VARCHAR || ', "s": "' || o_orderstatus || '", "t": true}' AS options FROM orders""")
def key_value_options(spark: SparkSession, sf: str) -> DataFrame:
    parse = F.pandas_udf(lambda n, s: pd.Series([json.dumps(run.key_values([f"n={a}", f"s={b}", "t=true"])) for a, b in zip(n, s)]), "string")
    return table(spark, sf, "orders").select("o_orderkey", parse("o_orderkey", "o_orderstatus").alias("options"))


_MODEL = "CASE p_partkey % 5 WHEN 0 THEN 'org/Qwen3-8B' WHEN 1 THEN 'a/b/GPT-5-mini' WHEN 2 THEN 'kimi-k2' WHEN 3 THEN 'zed/glm-5' ELSE 'meta/llama-' || p_size::VARCHAR END"


@query(f"""SELECT p_partkey, list_last(string_split({_MODEL}, '/')) AS short, CASE p_partkey % 5 WHEN 0 THEN '{{"chat_template_kwargs": {{"enable_thinking": ' || (p_size % 2 = 0)::VARCHAR || '}}}}' WHEN 1 THEN '{{"reasoning_effort": "minimal"}}' WHEN 2 THEN '{{"enable_thinking": ' || (p_size % 2 = 0)::VARCHAR || '}}' WHEN 3 THEN '{{"enable_thinking": ' || (p_size % 2 = 0)::VARCHAR || '}}' END AS flags FROM part""")
def model_flags(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    model = F.when(kind == 0, "org/Qwen3-8B").when(kind == 1, "a/b/GPT-5-mini").when(kind == 2, "kimi-k2").when(kind == 3, "zed/glm-5").otherwise(F.concat(F.lit("meta/llama-"), _str("p_size")))
    return table(spark, sf, "part").select("p_partkey", T.model_short_name(model).alias("short"), prompts.extra_body(model, F.col("p_size") % 2 == 0).alias("flags"))


_Q = "CASE turn % 3 WHEN 0 THEN 'When was it born? ' || role WHEN 1 THEN 'Tell the date and the capital.' ELSE text END"
_WORDS = "[" + ", ".join(f"'{w}'" for w in T.ATTRIBUTE_WORDS) + "]"


@query(rf"""SELECT conv_id, turn, list_has_any(string_split_regex(regexp_replace(lower(q), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), {_WORDS}) AS asks, len(list_filter({_WORDS}, lambda w: contains(lower(q), w) AND contains(lower(p), w)))::INT AS overlap
 FROM (SELECT conv_id, turn, {_Q} AS q, text || ' the Date and Capital where it was born' AS p FROM conversations)""")
def attribute_words(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("turn") % 3
    asked = F.when(kind == 0, F.concat(F.lit("When was it born? "), "role")).when(kind == 1, "Tell the date and the capital.").otherwise(F.col("text"))
    passage = F.concat("text", F.lit(" the Date and Capital where it was born"))
    return _talk(spark, sf).select("conv_id", "turn", T.asks_attribute(asked).alias("asks"), T.attribute_overlap(asked, passage).alias("overlap"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Problem:' || text || chr(10) || 'Solution:' || chr(10) || 'You are a science teacher' WHEN 1 THEN text ELSE text || chr(10) || 'one example' END AS head FROM benchmark""")
def retrieval_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What a question is searched by; of a long instruction the beginning."""
    kind = F.element_at(F.array(F.lit("theoremqa"), F.lit("logicbench"), F.lit("bigcodebench")), (F.col("item_id") % 3 + 1).cast("int"))
    full = prompts.retrieval_query(kind, F.col("text"), {"bigcodebench": "one example"})
    return table(spark, sf, "benchmark").select("item_id", F.regexp_replace(full, r"(?s)(You are a science teacher).*", "$1").alias("head"))


@query("""SELECT o_orderkey, 'add' AS name, '{"a": ' || o_orderkey::VARCHAR || ', "c": "x", "b": 2.0}' AS bound FROM orders""")
def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A call in a text, its arguments bound to typed parameters."""
    parameters = [{"name": "a", "type": "int"}, {"name": "b", "type": "float"}, {"name": "c", "type": "str"}]
    bind = F.pandas_udf(lambda args: pd.Series([json.dumps(engines.bind(a, parameters)) for a in args]), "string")
    said = F.concat(F.lit("first\nTOOL_CALL: add("), _str("o_orderkey"), F.lit(", c='x', b=2)\nTOOL_CALL: later(1)"))
    got = table(spark, sf, "orders").select("o_orderkey", T.tool_call(said).alias("call"))
    return got.select("o_orderkey", "call.name", bind("call.args").alias("bound"))


@query("SELECT conv_id, turn, 'I think of ' || role AS thought, 'Finish[' || conv_id::VARCHAR || ']' AS action FROM conversations")
def react_parts(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("Thought 3: I think of "), "role", F.lit("\nAction 3: Finish["), _str("conv_id"), F.lit("]\nObservation 3: made up\nAction 4: x"))
    own = T.own_observation_cut(said)
    return _talk(spark, sf).select("conv_id", "turn", T.thought_part(own).alias("thought"), T.action_part(own).alias("action"))


_TOKEN = "CASE turn % 4 WHEN 0 THEN (conv_id % 3)::VARCHAR WHEN 1 THEN 's' || (conv_id % 4)::VARCHAR WHEN 2 THEN upper(role) ELSE 'nothing' END"


@query(f"""WITH a AS (SELECT DISTINCT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, {_TOKEN} AS token FROM conversations),
 c(place, skill_id, name) AS (VALUES (0, 's1', 'user'), (1, 's2', 'Assistant'), (2, 's3', 'USER'))
 SELECT a.instance_id, token, coalesce((SELECT skill_id FROM c WHERE place::VARCHAR = token), (SELECT skill_id FROM c WHERE c.skill_id = token), (SELECT arg_min(skill_id, place) FROM c WHERE lower(name) = lower(token))) AS skill_id FROM a""")
def skill_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """LOAD_SKILL lines parsed and resolved by place, id or name."""
    kind = F.col("turn") % 4
    token = F.when(kind == 0, (F.col("conv_id") % 3).cast("string")).when(kind == 1, F.concat(F.lit("s"), (F.col("conv_id") % 4).cast("string"))).when(kind == 2, F.upper("role")).otherwise("nothing")
    key = F.concat(_str("conv_id"), F.lit("-"), _str("turn"))
    said = _talk(spark, sf).select(key.alias("instance_id"), F.concat(F.lit("I need one.\nLOAD_SKILL: "), token, F.lit("\nthen")).alias("t"))
    asked = said.select("instance_id", T.load_skill_argument("t").alias("token")).distinct()
    skills = spark.createDataFrame([(0, "s1", "user"), (1, "s2", "Assistant"), (2, "s3", "USER")], "place int, skill_id string, name string")
    shown = asked.select("instance_id").distinct().join(F.broadcast(skills), F.lit(True))
    return select.resolve_skills(asked, shown)


# ---- answers -----------------------------------------------------------------------------


@query("""SELECT p_partkey, 'import math' || chr(10) || 'def helper(x):' || chr(10) || '    return x + ' || p_size::VARCHAR || chr(10) || 'def main(y):' || chr(10) || '    return helper(y)' AS code FROM part""")
def code_answers(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("Here it is:\n```python\nimport math\ndef helper(x):\n    return x + "), _str("p_size"), F.lit("\n\ndef unused():\n    return 0\n\ndef main(y):\n    return helper(y)\n```\nIt works!"))
    return table(spark, sf, "part").select("p_partkey", code_column(said, F.lit("main")).alias("code"))


_DATASETS = "['toolqa', 'logicbench', 'medcalcbench', 'champ', 'theoremqa']"


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Answers in five styles, and instances for those not divisible by 9."""
    orders = table(spark, sf, "orders")
    key, kind = _str("o_orderkey"), F.col("o_orderkey") % 5
    said = (
        F.when(kind == 0, F.concat("o_orderpriority", F.lit("\nAction 2: Finish["), key, F.lit("]")))
        .when(kind == 1, F.concat("o_orderpriority", F.lit(". So the answer is "), F.when(F.col("o_orderstatus") == "F", "no").otherwise("yes"), F.lit(".")))
        .when(kind == 2, F.concat("o_orderpriority", F.lit("\nANSWER: "), key))
        .when(kind == 3, F.concat("o_orderpriority", F.lit("\nANSWER: "), key, F.lit(".")))
        .otherwise(F.concat("o_orderpriority", F.lit(" Therefore, the answer is "), key, F.lit(".")))
    )
    records = orders.select(key.alias("instance_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<think>the answer is 0</think>"), said)).otherwise(said).alias("raw_output"))
    dataset = F.element_at(F.expr(_DATASETS.replace("[", "array(").replace("]", ")")), (kind + 1).cast("int"))
    right = F.when(F.col("o_orderkey") % 7 == 0, F.concat(key, F.lit("77"))).otherwise(key)
    truth = F.when(kind == 1, "no").otherwise(right)
    low, high = (F.col("o_orderkey") - 0.5).cast("string"), (F.col("o_orderkey") + 0.5).cast("string")
    wrong = F.col("o_orderkey") % 7 == 0
    instances = orders.filter("o_orderkey % 9 <> 0").select(
        key.alias("instance_id"), dataset.alias("dataset"), F.lit("q").alias("question"), truth.alias("answer"), F.lit("integer").alias("answer_type"), F.lit("BQA").alias("task_type"),
        F.lit("decimal").alias("output_type"), F.lit(2).alias("calculator_id"), F.when(wrong, "-2").otherwise(low).alias("lower_limit"), F.when(wrong, "-1").otherwise(high).alias("upper_limit"),
    )
    return records, instances


@query(f"""SELECT o_orderkey::VARCHAR AS instance_id, {_DATASETS}[(o_orderkey % 5 + 1)::INT] AS dataset,
 CASE WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'no' ELSE 'yes' END ELSE o_orderkey::VARCHAR END AS extracted_answer,
 CASE WHEN o_orderkey % 5 = 1 THEN o_orderstatus = 'F' ELSE o_orderkey % 7 <> 0 END AS correct FROM orders WHERE o_orderkey % 9 <> 0""")
def evaluate_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each record judged by its dataset's judge, texts with and without thoughts."""
    details, _ = answers.evaluate_answers(*_records(spark, sf))
    return details.select("instance_id", "dataset", F.regexp_replace("extracted_answer", r"\.$", "").alias("extracted_answer"), "correct")


@query("SELECT o_orderkey::VARCHAR AS instance_id FROM orders WHERE o_orderkey % 9 = 0")
def evaluate_missing(spark: SparkSession, sf: str) -> DataFrame:
    _, missing = answers.evaluate_answers(*_records(spark, sf))
    return missing.select("instance_id")


@query(r"""SELECT conv_id, turn, split_part(text, ' ', 1) AS tool, CASE WHEN contains(text, 'on') THEN 'yes' ELSE 'no' END AS logic, 'choice_' || (1 + length(text) % 5)::VARCHAR AS choice, length(text)::VARCHAR AS medcalc, role || ' (x)' AS champ, length(text)::VARCHAR AS theorem,
 CASE WHEN length(text) % 3 = 0 THEN 'exact' ELSE 'none' END AS tool_match, length(text) % 2 = 0 AS logic_right, length(text) <= 400 AS medcalc_right, CASE WHEN length(role) > 5 THEN 'exact' ELSE 'none' END AS champ_match, abs(length(text) - 300.5::DOUBLE) <= 300.5::DOUBLE * 0.04::DOUBLE AS theorem_right FROM conversations""")
def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every extractor and score over whole turns; what is right depends on the texts."""
    text, role = F.col("text"), F.col("role")
    size = F.length(text)
    first = F.substring_index(text, " ", 1)
    yes = F.when(text.contains("on"), "yes").otherwise("no")
    tool = answers.extract_toolqa(F.concat(text, F.lit("\nAction 3: Finish["), first, F.lit("]\nok")))
    logic = answers.extract_yes_no(F.concat(F.lit("No way to tell at first. "), text, F.lit(" So the answer is **"), yes, F.lit("**.")))
    choice = answers.extract_choice(F.concat(text, F.lit(" I take choice_"), (size % 5 + 1).cast("string"), F.lit(".")), F.lit("choice_1: a"))
    calc, kind = F.lit(2), F.lit("decimal")
    medcalc = answers.extract_medcalc(F.concat(text, F.lit("\nANSWER: **"), size.cast("string"), F.lit("**")), kind, calc)
    champ = answers.extract_champ(F.concat(text, F.lit("\nANSWER: "), role, F.lit(" (x)")))
    theorem = answers.extract_theorem(F.concat(text, F.lit(" Therefore, the answer is x = "), size.cast("string"), F.lit(" cm.")))
    got = _talk(spark, sf).select("conv_id", "turn", "role", first.alias("first"), yes.alias("yes"), size.alias("size"), tool.alias("tool"), logic.alias("logic"), choice.alias("choice"), medcalc.alias("medcalc"), champ.alias("champ"), theorem.alias("theorem"))
    size = F.col("size")
    other = F.when(F.col("yes") == "yes", "no").otherwise("yes")
    return got.select(
        "conv_id", "turn", "tool", "logic", "choice", "medcalc", "champ", "theorem",
        answers.score_toolqa(F.col("tool"), F.when(size % 3 == 0, F.concat(F.lit("The "), F.col("first"), F.lit("!"))).otherwise("zzz")).alias("tool_match"),
        answers.score_logic(F.col("logic"), F.when(size % 2 == 0, F.upper("yes")).otherwise(other)).alias("logic_right"),
        answers.score_medcalc(F.col("medcalc"), F.lit("0"), kind, calc, F.lit("0"), F.lit("800/2")).alias("medcalc_right"),
        answers.score_champ(F.col("champ"), F.when(F.length("role") > 5, F.concat(F.upper("role"), F.lit(" (X)."))).otherwise("zzz")).alias("champ_match"),
        answers.score_theorem(F.col("theorem"), F.lit("300.5"), F.lit("float")).alias("theorem_right"),
    )


# ---- tools -------------------------------------------------------------------------------


@query("""SELECT 1 AS step, 'We have successfully loaded the flights database, including the following columns: o_orderkey, o_orderstatus, o_orderpriority.' AS seen
 UNION ALL SELECT 2, 'We have successfully filtered the data (' || count(*)::VARCHAR || ' rows).' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority >= '3'
 UNION ALL SELECT 3, string_agg(o_orderkey::VARCHAR, ', ') FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority >= '3' AND o_orderkey::VARCHAR >= '9' ORDER BY o_orderkey LIMIT 3000)
 UNION ALL SELECT 4, 'o_orderstatus: F, n: ' || count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 5, 'You are sending multiple actions at once. Please send one action at a time.' UNION ALL SELECT 6, (max(o_orderkey) * 2)::VARCHAR FROM orders UNION ALL SELECT 7, 'done' UNION ALL SELECT 8, 'again 0'""")
def tool_session(spark: SparkSession, sf: str) -> DataFrame:
    """One conversation with the tools; after a reset the table is gone."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    session = tools.ToolSession(spark, lambda name: orders)
    most = orders.agg(F.max("o_orderkey")).first()[0]
    session.execute("LoadDB[flights]")
    said = [
        session.execute("LoadDB[flights]"), session.execute("FilterDB[o_orderstatus=F, o_orderpriority>=3]"), (session.execute("FilterDB[o_orderkey>=9]"), session.execute("GetValue[o_orderkey]"))[1],
        session.execute("SQLInterpreter[SELECT o_orderstatus, count(*) AS n FROM flights.flights_data WHERE o_orderstatus = 'F' GROUP BY o_orderstatus]"),
        session.execute("Calculate[1], Finish[2]"), session.execute(f"Calculate[{most}*2]"), session.execute("Finish[done]"),
    ]
    session.reset()
    said.append(f"again {int(session.table is not None)}")
    return spark.createDataFrame(list(enumerate(said, 1)), "step int, seen string")


@query("""WITH p AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), q AS (SELECT * FROM p UNION ALL SELECT b, a FROM p),
 n AS (SELECT n_name, r_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = (SELECT min(s_nationkey) FROM supplier))
 SELECT 1 AS step, 'DBLP data is loaded, including two graphs: AuthorNet and PaperNet.' AS seen UNION ALL SELECT 2, '[' || string_agg(chr(39) || b || chr(39), ', ' ORDER BY b) || ']' FROM q JOIN n ON q.a = n_name
 UNION ALL SELECT 3, replace('{"key": "' || min(s_nationkey)::VARCHAR || '"}', '"', chr(39)) FROM supplier UNION ALL SELECT 4, replace('{"key": "' || n_regionkey::VARCHAR || '"}', '"', chr(39)) FROM n
 UNION ALL SELECT 5, 'Error executing LoadGraph: unknown graph other' UNION ALL SELECT 6, 'agenda: who?' UNION ALL SELECT 7, 'scirex: what?'""")
def tool_session_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The graph and text tools of one conversation, over all nodes and edges."""
    net = _net(spark, sf)
    session = tools.ToolSession(spark, lambda name: net[0], lambda name: net, lambda name, question: f"{name}: {question}")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    least = table(spark, sf, "supplier").agg(F.min("s_nationkey")).first()[0]
    row = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter(F.col("n_nationkey") == least).first()
    asked = ["LoadGraph[dblp]", f"NeighbourCheck[net, {row['n_name']}]", f"NodeCheck[net, {row['n_name']}]", f"EdgeCheck[net, {row['r_name']}, {row['n_name']}]", "LoadGraph[other]", "RetrieveAgenda[who?]", "RetrieveScirex[what?]"]
    return spark.createDataFrame([(i, session.execute(a)) for i, a in enumerate(asked, 1)], "step int, seen string")


@query("SELECT 'o' || l_orderkey::VARCHAR AS a, 's' || l_suppkey::VARCHAR AS b, string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey) AS papers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def edge_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose list of ids becomes a list of titles in its order."""
    lines = table(spark, sf, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    edges = lines.groupBy(F.concat(F.lit("o"), _str("l_orderkey")).alias("a"), F.concat(F.lit("s"), _str("l_suppkey")).alias("b")).agg(ids.alias("papers"))
    papers = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return tools.titled_papers(edges, papers).select("a", "b", F.array_join("papers", ", ").alias("papers"))


# ---- rankings ----------------------------------------------------------------------------


@query(f"""WITH {BM25_10}, k AS (SELECT doc_id FROM documents WHERE source <> 'src1'), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS back FROM bm25 SEMI JOIN k USING (doc_id) WHERE query_id % 2 = 0)
 SELECT query_id, doc_id, back::INT AS rank, round(1.0::DOUBLE / back, 6) AS score FROM c WHERE back <= 4 UNION ALL SELECT query_id, doc_id, rank, score FROM bm25 WHERE query_id % 2 = 1 AND rank <= 4""")
def rerank_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Even questions are reranked (backwards) among known documents; odd ones pass through."""
    source = bm25_10(spark, sf)
    known = table(spark, sf, "documents").filter("source <> 'src1'").select("doc_id")
    shown = source.filter("query_id % 2 = 0").join(known, "doc_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    said = shown.select("query_id", F.array_join(F.reverse(F.sequence(F.lit(1), F.col("n").cast("int"))).cast("array<string>"), " > ").alias("text"))
    again = rerank.listwise(source.filter("query_id % 2 = 0").join(known, "doc_id", "left_semi"), said)
    return rerank.rerank_or_pass(again, source, 4)


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 <> 0")
def rerank_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Questions still to be reranked, after a run for the same k that did every third."""
    asked = questions(spark, sf).select("query_id")
    done = asked.filter("query_id % 3 = 0")
    same, other = run.rerank_pending(asked, done, 10, 10), run.rerank_pending(asked, done, 5, 10)
    return same.join(other, "query_id", "left_semi")


# ---- encoding and the whole graph retriever ----------------------------------------------

#: Letters that the stand-in encoder counts.
LETTERS = "etaonish"


def letter_counts(texts: pd.Series) -> pd.Series:
    """A stand-in encoder: how often some letters occur, and one for the text itself."""
    return pd.Series([[1.0, *(float(t.count(c)) for c in LETTERS)] for t in texts.fillna("").str.lower()])


def encode(texts: DataFrame, key: str) -> DataFrame:
    return dense.encode(texts, key, letter_counts)


def _vec(text: str) -> str:
    """SQL of the same vector before scaling."""
    return "[1.0::DOUBLE, " + ", ".join(f"(length({text}) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


@query(f"SELECT doc_id, array_to_string(list_transform({_unit('v')}, lambda x: round(x, 4)::DECIMAL(9, 4)::VARCHAR), ',') AS vec FROM (SELECT doc_id, {_vec('text')} AS v FROM documents)")
def encode_texts(spark: SparkSession, sf: str) -> DataFrame:
    got = encode(corpus(spark, sf), "doc_id")
    return got.select("doc_id", F.array_join(F.transform("vec", lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")), ",").alias("vec"))


@query(f"SELECT DISTINCT item_id AS query_id, lower(entity) AS entity FROM (SELECT item_id, unnest({_ENT}) AS entity FROM benchmark)")
def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.question_entities(questions(spark, sf))


#: Rounds of PageRank in the registered queries: what later rounds would add is under 2e-4.
ROUNDS = 12
_SENTENCES = r"unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)))"
_QV = f"qv AS MATERIALIZED (SELECT item_id AS query_id, {_unit(_vec('text'))} AS v, text AS qt, list_has_any(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), {_WORDS}) AS asks FROM benchmark)"
_DV = f"dv AS MATERIALIZED (SELECT doc_id, {_unit(_vec('text'))} AS v, text AS dt FROM documents)"
_COS = "co AS MATERIALIZED (SELECT query_id, doc_id, list_dot_product(qv.v, dv.v) AS score, qt, asks, dt FROM qv, dv)"
# occurrences of activated entities, lower-cased, in all passages
_COUNTS = """ec AS MATERIALIZED (SELECT * FROM (SELECT entity, doc_id, (length(lt) - length(replace(lt, le, ''))) / length(le) AS n FROM (SELECT DISTINCT entity, lower(entity) AS le FROM la), (SELECT doc_id, lower(text) AS lt FROM documents)) WHERE n > 0),
 bo AS (SELECT query_id, doc_id, ln(1.0::DOUBLE + sum(last * ln(1.0::DOUBLE + n) / greatest(tier, 1))) AS bonus FROM la JOIN ec USING (entity) GROUP BY 1, 2)"""
_WEIGHTED = "(SELECT *, max(score) OVER (PARTITION BY query_id) AS hi, min(score) OVER (PARTITION BY query_id) AS lo FROM co) LEFT JOIN bo USING (query_id, doc_id)"
_WEIGHT = "0.05::DOUBLE * (1.5::DOUBLE * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END + coalesce(bonus, 0))"


@query(f"WITH la AS (SELECT item_id AS query_id, unnest({_ENT}) AS entity, 0.8::DOUBLE AS last, 1 AS tier FROM benchmark), {_QV}, {_DV}, {_COS}, {_COUNTS} SELECT query_id, doc_id, round({_WEIGHT}, 6) AS weight FROM {_WEIGHTED}")
def passage_weights(spark: SparkSession, sf: str) -> DataFrame:
    """All entities of a question are activated; weights of all its passages."""
    docs = corpus(spark, sf)
    active = questions(spark, sf).select("query_id", F.explode(graph.entities("text")).alias("entity_id"), F.lit(0.8).alias("last"), F.lit(1).alias("tier"))
    counts = matching.name_counts(docs, active.select(F.col("entity_id").alias("entity"))).withColumnRenamed("entity", "entity_id")
    cosines = dense.dense_scores(encode(docs, "doc_id"), encode(questions(spark, sf), "query_id"), None, places=None)
    return graph.passage_weights(cosines, active, counts).withColumn("weight", F.round("weight", 6))


@query(f"WITH la AS (SELECT DISTINCT unnest({_ENT}) AS entity, 1.0::DOUBLE AS last, 1 AS tier, 0 AS query_id FROM documents WHERE doc_id % 20 = 0), {_COUNTS} SELECT entity, doc_id, n::INT AS n FROM ec")
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of every 20th passage, counted in all passages."""
    docs = corpus(spark, sf)
    return matching.name_counts(docs, docs.filter("doc_id % 20 = 0").select(F.explode(graph.entities("text")).alias("entity"))).select("entity", "doc_id", "n")


def _whole_sql(attributes: bool) -> str:
    """Seeds, two hops, passage weights, rounds of PageRank, and the cosine fallback."""
    hop = """l{h} AS (SELECT g.query_id, g.entity, g.act, m.sid, round(list_dot_product(qv.v, sv.v), 6) AS sim FROM g{p} g JOIN m USING (entity) JOIN qv USING (query_id) JOIN sv USING (sid) WHERE g.act >= 0.5{unused}),
 t{h} AS (SELECT DISTINCT query_id, sid FROM (SELECT query_id, sid, row_number() OVER (PARTITION BY query_id, entity ORDER BY sim DESC, sid) AS r FROM l{h}) WHERE r <= 1),
 a{h} AS (SELECT query_id, sid, sum(act) AS act, any_value(sim) AS sim FROM l{h} SEMI JOIN t{h} USING (query_id, sid) GROUP BY 1, 2),
 g{h} AS MATERIALIZED (SELECT query_id, entity, sum(act * sim) AS act, sum(act * sim) AS own FROM a{h} JOIN m USING (sid) GROUP BY 1, 2 HAVING sum(act * sim) > 0)"""
    boost = f" + CASE WHEN asks THEN 0.05::DOUBLE * 0.25::DOUBLE * ln(1 + len(list_filter({_WORDS}, lambda w: contains(lower(qt), w) AND contains(lower(dt), w)))) ELSE 0 END" if attributes else ""
    parts = [
        EDGES,
        _QV,
        "wt AS MATERIALIZED (SELECT doc_id, entity, n, n / sum(n) OVER (PARTITION BY doc_id) AS w FROM e)",
        f"en AS MATERIALIZED (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS eid, {_unit(_vec('entity'))} AS v FROM (SELECT DISTINCT entity FROM e))",
        f"qe AS (SELECT query_id, entity AS qent, {_unit(_vec('entity'))} AS v FROM (SELECT DISTINCT item_id AS query_id, lower(entity) AS entity FROM (SELECT item_id, unnest({_ENT}) AS entity FROM benchmark)))",
        "sd AS (SELECT query_id, qent, arg_min(entity, struct_pack(a := -s, b := eid)) AS entity, max(s) AS s FROM (SELECT query_id, qent, entity, eid, round(list_dot_product(qe.v, en.v), 6) AS s FROM qe, en) GROUP BY 1, 2)",
        f"st AS MATERIALIZED (SELECT DISTINCT 'sentence-' || md5(s) AS sid, s AS text FROM (SELECT {_SENTENCES} AS s FROM documents) WHERE trim(s) <> '')",
        f"sv AS MATERIALIZED (SELECT sid, {_unit(_vec('text'))} AS v FROM st)",
        f"m AS MATERIALIZED (SELECT DISTINCT sid, unnest({_ENT}) AS entity FROM st)",
        "g0 AS MATERIALIZED (SELECT query_id, entity, sum(s) AS act, max(s) AS own FROM sd GROUP BY 1, 2)",
        hop.format(h=1, p=0, unused=""),
        hop.format(h=2, p=1, unused=" AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.query_id = g.query_id AND t1.sid = m.sid)"),
        "ev AS (SELECT query_id, entity, own, 0 AS tier FROM g0 UNION ALL SELECT query_id, entity, own, 1 FROM g1 UNION ALL SELECT query_id, entity, own, 2 FROM g2)",
        "ac AS MATERIALIZED (SELECT query_id, entity, sum(own) AS act FROM ev GROUP BY 1, 2)",
        "la AS MATERIALIZED (SELECT query_id, entity, arg_max(own, tier) AS last, max(tier) AS tier FROM ev WHERE tier = 0 OR own >= 0.5 GROUP BY 1, 2)",
        _DV,
        _COS,
        _COUNTS,
        f"pw AS (SELECT query_id, doc_id, {_WEIGHT}{boost} AS w FROM {_WEIGHTED})",
        "r0 AS (SELECT query_id, 'p' || doc_id::VARCHAR AS id, w FROM pw WHERE query_id IN (SELECT query_id FROM ac) UNION ALL SELECT query_id, 'e' || entity, act FROM ac)",
        "x0 AS MATERIALIZED (SELECT query_id, id, sum(w) AS x FROM r0 WHERE w > 0 GROUP BY 1, 2)",
        "ed AS (SELECT 'p' || doc_id::VARCHAR AS src, 'e' || entity AS dst, w FROM wt), eb AS (SELECT * FROM ed UNION ALL SELECT dst, src, w FROM ed), sp AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM eb)",
    ]
    # y = reset + 0.5 * y P; nodes without edges would only scale it
    for i in range(ROUNDS):
        parts.append(f"x{i + 1} AS MATERIALIZED (SELECT query_id, id, sum(x) AS x FROM (SELECT * FROM x0 UNION ALL SELECT query_id, dst, 0.5::DOUBLE * x * p FROM x{i} JOIN sp ON sp.src = x{i}.id) GROUP BY 1, 2)")
    parts.append(f"fs AS (SELECT query_id, substr(id, 2)::BIGINT AS doc_id, round(x / total, 6) AS score FROM (SELECT *, sum(x) OVER (PARTITION BY query_id) AS total FROM x{ROUNDS}) WHERE id LIKE 'p%' UNION ALL SELECT query_id, doc_id, round(score, 6) FROM co WHERE query_id NOT IN (SELECT query_id FROM ac))")
    return f"WITH {', '.join(parts)}, {top('fs', 10)} SELECT * FROM r"


@query(_whole_sql(False))
def graph_retriever(spark: SparkSession, sf: str) -> DataFrame:
    return graph.linear_rag(corpus(spark, sf), questions(spark, sf), encode, 10, iterations=ROUNDS, least=1e-12)


@query(_whole_sql(True))
def graph_retriever_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.linear_rag(corpus(spark, sf), questions(spark, sf), encode, 10, attributes=True, iterations=ROUNDS, least=1e-12)


# ---- engines -----------------------------------------------------------------------------


def _numbers(spark: SparkSession, sf: str, dataset: str) -> DataFrame:
    """An instance for every turn: its question is a number."""
    key = F.concat(_str("conv_id"), F.lit("-"), _str("turn"))
    return _talk(spark, sf).select(key.alias("instance_id"), F.lit(dataset).alias("dataset"), (F.col("conv_id") * 10 + F.col("turn")).cast("string").alias("question"))


def _shelf(spark: SparkSession, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    tool = "struct<name:string,description:string,parameters:array<struct<name:string,type:string>>,implementation:string>"
    rows = [("s1", "Poet", "rhymes", "roses", []), ("s2", "Adder", "adds", "add them", [("add", "a + b", [("a", "int"), ("b", "float")], "")])]
    skills = spark.createDataFrame(rows, f"skill_id string, name string, description string, content string, tools array<{tool}>")
    places = spark.createDataFrame([(1, "s1"), (2, "s2")], "place int, skill_id string")
    return instances.select("instance_id").join(F.broadcast(places), F.lit(True)), skills


FUNCTIONS: dict[str, Callable] = {"add": lambda a, b: a + b}


def _calling(system: str, talk: str) -> str:
    if "TOOL_RESULT: " in talk:
        return "So it is " + talk.rpartition("TOOL_RESULT: ")[2]
    number = talk.split("\n\n", 1)[1].split("\n")[0]
    return f"I add.\nTOOL_CALL: add({number}, b=2)\nnot read"


@query("""SELECT instance_id, 'I add.' || chr(10) || 'TOOL_CALL: add(' || q || ', b=2)So it is ' || n || '.0' AS raw_output,
 'I add.' || chr(10) || 'TOOL_CALL: add(' || q || ', b=2)' || chr(10) || 'TOOL_RESULT: ' || n || '.0' || chr(10) || 'So it is ' || n || '.0' AS transcript, 's1,s2' AS used
 FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, (conv_id * 10 + turn)::VARCHAR AS q, (conv_id * 10 + turn + 2)::VARCHAR AS n FROM conversations)""")
def run_tools(spark: SparkSession, sf: str) -> DataFrame:
    """One answer with a tool loop; arguments are given their types."""
    asked = _numbers(spark, sf, "logicbench")
    got = run.run_many(asked, *_shelf(spark, asked), _calling, functions=FUNCTIONS)
    return got.select("instance_id", "raw_output", "transcript", F.array_join("skill_ids_used", ",").alias("used"))


def _reading(system: str, talk: str) -> str:
    if "TOOL_RESULT: " in talk:
        return "It is " + talk.rpartition("TOOL_RESULT: ")[2]
    if "Skill loaded: Adder" in talk:
        return f"I add.\nTOOL_CALL: add({talk.split(chr(10))[0]}, 1.5)"
    return "I look.\nLOAD_SKILL: 1\nnot read" if "1: Adder: adds" in system else "lost"


@query("""SELECT instance_id, 'I look.' || chr(10) || 'LOAD_SKILL: 1I add.' || chr(10) || 'TOOL_CALL: add(' || q || ', 1.5)It is ' || n || '.5' AS raw_output, 's2' AS used
 FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, (conv_id * 10 + turn)::VARCHAR AS q, (conv_id * 10 + turn + 1)::VARCHAR AS n FROM conversations)""")
def run_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    """A skill is asked for from the catalog, then its tool is called."""
    asked = _numbers(spark, sf, "logicbench")
    got = run.run_many(asked, *_shelf(spark, asked), _reading, "progressive_disclosure", functions=FUNCTIONS)
    return got.select("instance_id", "raw_output", F.array_join("skill_ids_used", ",").alias("used"))


def _thinking(system: str, talk: str) -> str:
    number = talk.split("Question: ", 1)[1].split("\n")[0]
    if "Observation 2: " in talk:
        return f" It is there.\nAction 3: Finish[{talk.rpartition('Observation 2: ')[2].split(chr(10))[0]}]\nObservation 3: made up"
    if "Skill loaded: Adder" in talk or "LoadSkill" not in system:
        step = 2 if "Observation 1: " in talk else 1
        return f" I add.\nAction {step}: Calculate[{number}+2]"
    return " I look.\nAction 1: LoadSkill[adder]\nObservation 1: made up"


def _act(action: str) -> str:
    m = re.fullmatch(r"Calculate\[(.+)\]", action)
    return calculate(m[1]) if m else "unknown"


def _cell(spark: SparkSession, sf: str, label: str) -> DataFrame:
    method = next(m for m in run.EXPERIMENTS["main"].methods if m.label == label)
    asked = _numbers(spark, sf, "toolqa")
    return run.run_many(asked, *_shelf(spark, asked), _thinking, method.engine_for("toolqa"), execute=_act)


@query("""SELECT instance_id, 'Thought 1: I look.' || chr(10) || 'Action 1: LoadSkill[adder]' || chr(10) || 'Thought 2: I add.' || chr(10) || 'Action 2: Calculate[' || q::VARCHAR || '+2]' || chr(10) || 'Thought 3: It is there.' || chr(10) || 'Action 3: Finish[' || (q + 2)::VARCHAR || ']' AS raw_output,
 's2' AS used, (q + 2)::VARCHAR AS extracted FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, conv_id * 10 + turn AS q FROM conversations)""")
def run_grid_cell(spark: SparkSession, sf: str) -> DataFrame:
    """The cell of the experiment grid for tool questions with skills on demand."""
    got = _cell(spark, sf, "progressive_disclosure")
    return got.select("instance_id", "raw_output", F.array_join("skill_ids_used", ",").alias("used"), answers.extract_toolqa(F.col("raw_output")).alias("extracted"))


@query("""SELECT instance_id, 'Thought 1: I add.' || chr(10) || 'Action 1: Calculate[' || q::VARCHAR || '+2]' || chr(10) || 'Observation 1: ' || (q + 2)::VARCHAR AS transcript FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, conv_id * 10 + turn AS q FROM conversations)""")
def run_react(spark: SparkSession, sf: str) -> DataFrame:
    """Thought, action and observation in turn; the first step of each."""
    got = _cell(spark, sf, "oracle_skill")
    return got.select("instance_id", F.substring_index("transcript", "\nThought 2:", 1).alias("transcript"))


# ---- experiments -------------------------------------------------------------------------


@query("""WITH m(experiment, n) AS (VALUES ('main', 5), ('main_linearrag', 5), ('retrieval_comparison', 6), ('topk_sweep', 8), ('topk_sweep_injection', 4), ('topk_sweep_progressive_disclosure', 4), ('distractor', 8), ('distractor_injection', 4), ('distractor_progressive_disclosure', 4))
 SELECT experiment, source AS dataset, n::BIGINT AS n_runs FROM m, (SELECT DISTINCT source FROM documents)""")
def experiment_catalog(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select(F.col("source").alias("dataset"))
    return run.catalog(names).groupBy("experiment", "dataset").agg(F.count("*").alias("n_runs"))


@query("""SELECT p_partkey, 'w/retrieval/' || p_brand || '-bm25.json' AS retrieval, 'w/inference/m' || p_size::VARCHAR || '/' || p_type || '/' || p_brand || '.jsonl' AS inference, 'w/eval/m' || p_size::VARCHAR || '/' || p_type || '/' || p_brand || '.json' AS eval FROM part""")
def run_paths(spark: SparkSession, sf: str) -> DataFrame:
    model = F.concat(F.lit("org/m"), _str("p_size"))
    out = run.path_columns("w", F.col("p_brand"), model, F.col("p_type"), F.lit("bm25"))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in out.items()])
