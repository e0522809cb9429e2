import pytest
from pyspark.sql import functions as F

from rankframe.operators import answers as A


def score(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if k == 'calc' else 'string'}" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("Finish[a] Finish[ b ]", "b"), ("the answer is: 5.\nx", "5"), ("one\n two \n\n", "two"), ("", "")])
def test_toolqa_extraction(spark, text, want):
    assert score(spark, A.extract_toolqa(F.col("t")), t=text) == want


@pytest.mark.parametrize("pred,truth,want", [("The $5 USD", "5", "exact"), ("5.0000001", "5", "numeric"), ("True", "yes", "boolean"), ("3d", "3", "none"), ("x", "y", "none")])
def test_toolqa_score(spark, pred, truth, want):
    assert score(spark, A.score_toolqa(F.col("p"), F.col("t")), p=pred, t=truth) == want


@pytest.mark.parametrize("text,want", [("The answer is no. The answer is: yes", "yes"), ("**Yes**, since", "yes"), ("we cannot conclude it", "no"), ("well yes or no", "no"), ("it is true", "yes"), ("all false", "no"), ("a\nMaybe", "maybe")])
def test_yes_no(spark, text, want):
    assert score(spark, A.extract_yes_no(F.col("t")), t=text) == want


@pytest.mark.parametrize("out,calc,want", [("x\nANSWER: **3.5**", 2, "3.5"), ('{"answer": "X.XX"} 7', 2, "7"), ('{"answer": "8"}', 2, "8"), ("on 3/4/2020", 13, "03/04/2020"), ("12 weeks, 3 days", 69, "(12, 3)"), ("", 2, "")])
def test_medcalc_extraction(spark, out, calc, want):
    assert score(spark, A.extract_medcalc(F.col("o"), F.lit("decimal"), F.col("calc")), o=out, calc=calc) == want


@pytest.mark.parametrize("pred,truth,calc,want", [("2.5", "2", 4, True), ("3.5", "4", 4, True), ("inf", "2", 4, False), ("3/4", "x", 2, True), ("2", "x", 2, False), ("1/2/2020", "01/02/2020", 13, True), ("12 weeks 3 days", "(12, 3)", 69, True)])
def test_medcalc_score(spark, pred, truth, calc, want):
    got = A.score_medcalc(F.col("p"), F.col("t"), F.lit("decimal"), F.col("calc"), F.lit("0.5"), F.lit("1"))
    assert score(spark, got, p=pred, t=truth, calc=calc) is want


@pytest.mark.parametrize("pred,truth,want", [("4.", "4", "exact"), ("no real solutions", "no solution", "canonical"), ("2^3", "8", "numeric"), ("sqrt(16)", "4", "numeric"), ("1.02", "1.01", "numeric"), ("252", "C(10, 5), or equivalently 252", "symbolic"), ("252", "ten over five, or equivalently 252", "exact_alt"), ("(x+1)^2", "x^2 + 2x + 1", "symbolic"), ("x+2", "z, or equivalently 2+x", "symbolic_alt"), ("That is false", "No", "yes_no"), ("x+1", "1+y", "none")])
def test_champ_score(spark, pred, truth, want):
    assert score(spark, A.score_champ(F.col("p"), F.col("t")), p=pred, t=truth) == want


@pytest.mark.parametrize("text,want", [("The answer is: unknown", "False"), ("so 3 then 4.5", "4.5"), ("the answer is: x = 7 cm.", "7"), ("The answer is: (b)", "(b)"), ("the answer is: 1. the answer is: 2\n\nThe answer is: 9", "2"), ("nothing here", "False")])
def test_theorem_extraction(spark, text, want):
    assert score(spark, A.extract_theorem(F.col("t")), t=text) == want


@pytest.mark.parametrize("pred,truth,kind,want", [("7", "7", "integer", True), ("7.4", "7", "integer", True), ("1.6", "1.0", "float", False), ("3.2", "3.1", "float", True), ("(2, 1)", "[1, 2]", "list of integer", True), ("(A)", "(a)", "option", True)])
def test_theorem_score(spark, pred, truth, kind, want):
    assert score(spark, A.score_theorem(F.col("p"), F.col("t"), F.col("k")), p=pred, t=truth, k=kind) is want


def test_evaluation_join(spark):
    records = spark.createDataFrame([("a", "<think>no</think>Finish[4]"), ("z", "x")], "instance_id string, raw_output string")
    inst = spark.createDataFrame([("a", "toolqa", "q", "4", None, None, None, None, None, None)], "instance_id string, dataset string, question string, answer string, answer_type string, task_type string, output_type string, calculator_id int, lower_limit string, upper_limit string")
    details, missing = A.evaluate_answers(records, inst)
    assert [r.correct for r in details.collect()] == [True] and [r.instance_id for r in missing.collect()] == ["z"]
