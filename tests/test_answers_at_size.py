"""Work on answers: dealt to all tasks, texts cleaned once, whole numbers as ints."""

from fractions import Fraction

from rankframe.functions.algebra import parse
from rankframe.functions.arithmetic import evaluate
from rankframe.operators import answers
from rankframe.plans.all_queries import QUERIES


def _sf(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(1, 41)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, 1 + i % 7, float(i)) for i in range(1, 41)], "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_champ_rows_of_one_file_go_to_all_tasks(spark, tmp_path):
    got = QUERIES["answer_champ_symbolic"](spark, _sf(spark, tmp_path))
    assert got.rdd.getNumPartitions() == 4
    assert {(r[0], r[1]) for r in got.collect()} == {(i, "symbolic" if i % 3 == 0 else "none") for i in range(1, 41)}


def test_theorem_rows_of_one_file_go_to_all_tasks(spark, tmp_path):
    got = QUERIES["answer_theorem_latex"](spark, _sf(spark, tmp_path))
    assert got.rdd.getNumPartitions() == 4
    for key, line, value, even in got.collect():
        n = 1 + key % 7
        exact = Fraction(key, n + 2) + n**3
        assert line == n and abs(value - float(exact)) < 1e-6 and even == (exact.denominator == 1 and exact % 2 == 0)


def test_answer_texts_are_cleaned_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x^2 + 2 x + 1", "(x + 1)^2")], "a string, b string")
    out = df.select(answers.champ_texts(F.col("a"), F.col("b")).alias("t")).select(answers.score_champ_texts(F.col("t")).alias("m"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("equivalently|approximately") <= 8 and out.first()["m"] == "symbolic"


def test_whole_numbers_of_forms_are_ints():
    for text in ("(x + 2)^2", "4/2", "(1/2 + 1/2) x", "sqrt(9)"):
        top, bottom = parse(text)
        assert all(type(c) is int for part in (top, bottom) for c in part.values())
        assert all(type(e) is int for t in top for _, e in t)


def test_names_without_a_value():
    assert evaluate("2 * x") is None and evaluate("2 * pi") and evaluate("1 # remark") == 1 and evaluate("1e3") == 1000
