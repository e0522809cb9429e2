import re

import pytest
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.functions.arithmetic import calculate, evaluate, literals


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["Héllo, wörld! it's a_b 12.5", "", "...", "a b\tc\nd", None, "ÀÉ x-y"])
def test_tokens_like_python(spark, text):
    want = re.sub(r"[^\w\s]", " ", (text or "").lower()).split()
    assert one(spark, T.tokens("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("1_000", 1000.0), ("3d", None), ("inf", float("inf")), (" 3.5 ", 3.5), ("", None), ("1e3", 1000.0), (".5", 0.5), ("abc", None), ("5.", 5.0)])
def test_number(spark, text, want):
    assert one(spark, T.number("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("<think>a</think>  b", "b"), ("x<think>open", "x"), ("plain", "plain"), (" keep", " keep")])
def test_strip_think(spark, text, want):
    assert one(spark, T.strip_think("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("the answer is: 1\nTherefore, the answer is 42./.\nx", "42."), ("none", None), ("The answer is: 7.", "7"), ("The answer is: a/", "a")])
def test_after_trigger(spark, text, want):
    assert one(spark, T.after_trigger("t"), t=text) == want


def test_ranking_positions(spark):
    assert one(spark, T.ranking_positions("t", 5), t="[3] > [1], 9, 3, 2, 99999999999") == [2, 0, 1]
    assert one(spark, T.first_choice("t", 5), t="say 9 then 4") == 3
    assert one(spark, T.first_choice("t", 5), t="no") is None


def test_names_and_titles(spark):
    assert one(spark, T.display_name("t", F.lit(3)), t="  ") == "Skill #3"
    assert one(spark, T.display_name("t"), t=None) == "Unnamed skill"
    assert one(spark, T.drop_title("t"), t="Title\nbody") == "body"
    assert one(spark, T.drop_title("t"), t="only") == "only"
    assert one(spark, T.occurrences("t", F.lit("")), t="abc") == 0
    assert one(spark, T.action_argument("t"), t="FilterDB[a=b, c=d]") == "a=b, c=d"
    assert one(spark, T.tool_call("t"), t="x\nTOOL_CALL: f(1, 'a')")["args"] == "1, 'a'"


@pytest.mark.parametrize("text,want", [("(-17)-(-7)", "-10"), ("mean(247.0, nan, 253)", "250.0"), ("sqrt(2)", "1.414"), ("2**3", "8"), ("max(1, 5)", "5.0"), ("7/2", "3.5")])
def test_calculate(text, want):
    assert calculate(text) == want


@pytest.mark.parametrize("text", ["__import__('os')", "9**9**9**9", "a.b", "(1).real", "[1]", "'x'*9"])
def test_arithmetic_refuses(text):
    assert evaluate(text) is None


def test_literals():
    assert literals("1, 'a', [2]") == [1, "a", [2]]
    assert literals("f(x)") is None
