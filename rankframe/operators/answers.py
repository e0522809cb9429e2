"""Answer extraction and scoring by dataset, as ordered ``coalesce`` and ``when`` chains."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankframe.functions.algebra import latex_value_column, same_form
from rankframe.functions.arithmetic import evaluate, literals
from rankframe.functions.code import code_column
from rankframe.functions.text import TRIGGERS, after_trigger, last_line, let, number, strip, strip_think, within_eps

#: Calculators whose answers are dates, an age in weeks and days, or integers.
DATE_IDS, AGE_ID = [13, 68], 69
INTEGER_IDS = [4, 15, 16, 17, 18, 20, 21, 25, 27, 28, 29, 32, 33, 36, 43, 45, 48, 51, 69]
#: Answers that only repeat the answer format.
PLACEHOLDERS = ["str(short_and_direct_answer_of_the_question)", "str(value which is the answer to the question)", "X.XX"]
#: Wordings and their canonical form ($1 is the first group).
CANONICAL = [
    (r"^no\s+(?:\w+\s+)*solutions?$", "no solutions"),
    (r"^no\s+(?:\w+\s+)*(?:possible\s+)?values?$", "no such values"),
    (r"^no such values$", "no such values"),
    (r"^0 pairs$", "0"),
    (r"^0 roots$", "0"),
    (r"^(.+?)\s+is the only possible value.*$", "$1"),
    (r"^the limit exists and is equal to\s+(.+)$", "$1"),
    (r"^the limit does not exist$", "limit does not exist"),
    (r"^at most 0\b.*$", "0"),
    (r"^exactly one\b.*$", "1"),
    (r"^(\d+)\s+values?$", "$1"),
    (r"^(\d+)\s+inequalit(?:y|ies)$", "$1"),
]
#: Phrases that deny, and the choices of a multiple-choice answer.
DENIALS = [r"cannot\s+(?:be\s+)?(?:conclude|infer|say|determine)", r"not\s+necessarily\s+true", r"not\s+(?:possible|correct|true|valid)", r"cannot\s+(?:logically|necessarily|definitively)", r"\bno,\s"]
OPTIONS = ["(a)", "(b)", "(c)", "(d)", "(e)", "(f)"]

# Where answers stand, in the order tried. A rule is the part of the text that is
# looked at (whole, low: lower case, tail: its last 500 characters, end: last line), a pattern,
# its group, whether the first or the last match counts, and what a match stands for.
YES_NO = {"yes": "yes", "true": "yes", "no": "no", "false": "no"}
YES_NO_RULES = [
    ("low", r"(?:the\s+)?answer\s+is[:\s]*\**\s*(yes|no|true|false)\b", 1, "last", YES_NO),
    ("low", r"^\**(yes|no)\**[.,!\s]", 1, "first", YES_NO),
    ("tail", "|".join(f"(?:{d})" for d in DENIALS), 0, "first", "no"),
    ("tail", r"\b(yes|no)\b", 1, "last", YES_NO),
    ("tail", "true", 0, "first", "yes"),
    ("tail", "false", 0, "first", "no"),
]
CHOICE_RULES = [
    ("low", r"choice[_ ]?(\d+)", 1, "last", None),
    ("low", r"(?:answer|option)\s*(?:is)?[:\s]*\**\s*(?:choice[_ ]?)?(\d+)\b", 1, "first", None),
]
CHOICE_TEXT, CHOICE_DIGIT = r"(?i)choice_{i}:\s*(.+?)(?:\n|choice_|$)", r"\b([1-5])\b"
JSON_ANSWER = r'[Aa]nswer":\s*(.*?)\}'
DAY = r"(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(\d{4})"
AGE_IN_TEXT = r"\(?[\"']?(\d+)\s*(?:weeks?)?\s*,?\s*[\"']?(\d+)\s*(?:days?)?[\"']?\s*\)?"
AGE_GIVEN = r"\(?[\"']?(\d+)\s*(?:weeks?)?[\"']?,?\s*[\"']?(\d+)\s*(?:days?)?[\"']?\s*\)?"
LAST_NUMBER, LAST_DECIMAL = r"-?\d+\.?\d*", r"-?\d*\.?\d+"
FRACTION = r"^(-?\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$"
#: What is taken from answers before they are compared: pattern and replacement, in order.
REMARKS = [(r"\.+$", ""), (r"(?is),?\s*or\s+(?:equivalently|approximately)\s+.*$", ""), (r"(?i)\s+\((?:i\.e\.[,\s]|none\b)[^)]*\)\s*$", ""), (r"\s+", " ")]
OTHER_WORDING, OTHER_REMARKS = r"(?i),?\s*or\s+(?:equivalently|approximately)\s+(.+)$", [(r"\.+$", ""), (r"\s*\([^)]*\)\s*$", "")]
UNITS = [
    (r"\\pi", "\u03c0"), ("(?<![\\d}])\\\\?\u03c0", "3.14"), ("(\\d)(\\\\?\u03c0)", "$1*3.14"), ("\\{(\\\\?\u03c0)\\}", "3.14"), ("\\*(\\\\?\u03c0)", "*3.14"),
    ("%", "/100"), ("\\$|\u00a5|\u00b0C| C|\u00b0", ""),
]
TRUE_INSIDE, FALSE_INSIDE, OPTION_INSIDE = "yes|true", "no|false", r"\([a-f]\)"
NUMBER_AND_UNIT = r"^-?[\d\.]+\s\D+$|^-?[\d\.]+\s[^\s]+$"


def _as_double(text: str | None) -> float | None:
    value = evaluate(text) if text else None
    try:
        return None if value is None else float(value)
    except OverflowError:
        return None


def _evaluate(text: Column) -> Column:
    """Value of an arithmetic expression, in Arrow batches; null without one."""
    run = F.pandas_udf(lambda texts: pd.Series([_as_double(t) for t in texts], dtype="float64"), "double")
    return F.nanvl(run(text), F.lit(None).cast("double"))


def _parts(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {"whole": text, "low": low, "tail": F.substring(low, F.greatest(F.length(low) - 499, F.lit(1)), F.lit(500)), "end": F.lower(strip(F.substring_index(text, "\n", -1)))}


def _by_rules(parts: dict[str, Column], rules: list[tuple]) -> list[Column]:
    """What each rule finds (null: nothing), in the rules' order."""
    out = []
    for part, pattern, group, which, meaning in rules:
        found = _last(parts[part], pattern, group) if which == "last" else _first(parts[part], pattern, group)
        if isinstance(meaning, dict):
            found = F.element_at(F.create_map(*[F.lit(x) for kv in meaning.items() for x in kv]), found)
        elif meaning is not None:
            found = F.when(found.isNotNull(), meaning)
        out.append(found)
    return out


def _cleaned(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def _has(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), text)


def _last(text: Column, pattern: str, group: int = 0) -> Column:
    """Last match of a pattern, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(-1))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _answer_line(text: Column) -> Column:
    """What follows ``ANSWER:`` on the last line that begins with it, without stars."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.upper(x).startswith("ANSWER:"))
    return strip(F.regexp_replace(strip(F.substring(F.try_element_at(lines, F.lit(-1)), 8, 1 << 30)), r"^\*+|\*+$", ""))


# ---- toolqa ------------------------------------------------------------------------------


def extract_toolqa(text: Column) -> Column:
    return F.coalesce(strip(_last(text, r"Finish\[([^\]]*)\]", 1)), after_trigger(text), last_line(text))


def normalized(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles, currency word and extra blanks."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the|usd)\b", " "), r"\s+", " "))


def score_toolqa(extracted: Column, answer: Column) -> Column:
    """Kind of match: exact, numeric, boolean or none."""
    answer = strip(answer)
    boolean = F.when(F.lower(extracted) == "true", "yes").when(F.lower(extracted) == "false", "no")
    return F.when(normalized(extracted) == normalized(answer), "exact").when(F.abs(number(extracted) - number(answer)) < 1e-6, "numeric").when(boolean == F.lower(answer), "boolean").otherwise("none")


# ---- logicbench --------------------------------------------------------------------------


def extract_yes_no(text: Column) -> Column:
    parts = _parts(strip(text))
    return F.coalesce(*_by_rules(parts, YES_NO_RULES), parts["end"])


def extract_choice(text: Column, question: Column) -> Column:
    text = strip(text)
    parts = _parts(text)
    quoted = []
    for i in (5, 4, 3, 2, 1):
        pattern = CHOICE_TEXT.replace("{i}", str(i))
        words = F.substring(F.lower(strip(F.regexp_extract(question, pattern, 1))), 1, 40)
        quoted.append(F.when(question.rlike(pattern) & parts["tail"].contains(words), str(i)))
    rest = F.lower(strip(F.coalesce(after_trigger(text), last_line(text))))
    number = F.coalesce(*_by_rules(parts, CHOICE_RULES), *quoted, _first(rest, CHOICE_DIGIT, 1))
    return F.coalesce(F.concat(F.lit("choice_"), number), rest)


def score_logic(extracted: Column, answer: Column) -> Column:
    return F.lower(strip(extracted)) == F.lower(strip(answer))


# ---- medcalcbench ------------------------------------------------------------------------


def extract_medcalc(text: Column, output_type: Column, calculator: Column) -> Column:
    group = lambda pattern, i: F.regexp_extract(text, pattern, i)
    json = F.regexp_replace(F.regexp_replace(strip(group(JSON_ANSWER, 1)), r'^"+|"+$', ""), r"^'+|'+$", "")
    date = F.concat_ws("/", F.lpad(group(DAY, 1), 2, "0"), F.lpad(group(DAY, 2), 2, "0"), group(DAY, 3))
    age = F.format_string("(%s, %s)", group(AGE_IN_TEXT, 1), group(AGE_IN_TEXT, 2))
    ways = [
        _answer_line(text),
        F.when((json != "") & ~json.isin(PLACEHOLDERS), json),
        after_trigger(text),
        F.when(((output_type == "date") | calculator.isin(DATE_IDS)) & text.rlike(DAY), date),
        F.when((calculator == AGE_ID) & text.rlike(AGE_IN_TEXT), age),
        _last(text, LAST_NUMBER),
        last_line(text),
    ]
    return F.coalesce(*ways)


def _pair(text: Column, pattern: str, kind: str) -> Column:
    """The two numbers of a pattern as a struct; null without a match."""
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast(kind)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("a"), part(2).alias("b")))


def fraction(text: Column) -> Column:
    """A number, or the value of ``a/b``; null otherwise."""

    def parse(t: Column) -> Column:
        two = _pair(t, FRACTION, "double")
        return F.coalesce(number(t), F.try_divide(two["a"], two["b"]))

    return let(strip(text), parse)


def score_medcalc(extracted: Column, answer: Column, output_type: Column, calculator: Column, low: Column, high: Column) -> Column:
    """By kind of calculator: equal dates, equal (weeks, days), equal rounded integers
    (half to even), or a number inside the limits. Unreadable answers are wrong."""
    day = lambda x: F.try_to_timestamp(strip(x), F.lit("M/d/yyyy"))

    def judge(x: Column) -> Column:
        value = fraction(x)
        right = F.when(calculator.isin(DATE_IDS), day(x) == day(answer)).when(calculator == AGE_ID, _pair(x, AGE_GIVEN, "int") == _pair(answer, AGE_GIVEN, "int"))
        right = right.when(calculator.isin(INTEGER_IDS) | (output_type == "integer"), F.bround(value) == F.bround(fraction(answer)))
        return right.otherwise(let(value, lambda v: (v >= fraction(low)) & (v <= fraction(high))))

    return F.coalesce(let(extracted, judge), F.lit(False))


# ---- champ -------------------------------------------------------------------------------


def extract_champ(text: Column) -> Column:
    return F.coalesce(_answer_line(text), after_trigger(text), last_line(text))


def plain_answer(text: Column) -> Column:
    """Without a closing dot, an alternative wording and a bracketed remark."""
    return F.trim(_cleaned(strip(text), REMARKS))


def alternative(text: Column) -> Column:
    """The other wording after "or equivalently"; null without one."""
    part = strip(_cleaned(strip(F.regexp_extract(text, OTHER_WORDING, 1)), OTHER_REMARKS))
    return F.when(part != "", part)


def canonical(text: Column) -> Column:
    def rewrite(low: Column) -> Column:
        out = None
        for pattern, to in CANONICAL:
            hit = F.regexp_extract(low, pattern, 1) if to == "$1" else F.lit(to)
            out = F.when(low.rlike(pattern), hit) if out is None else out.when(low.rlike(pattern), hit)
        return out

    return F.coalesce(let(F.lower(strip(text)), rewrite), text)


def _arithmetic(text: Column) -> Column:
    """An expression to be evaluated (``^`` and ``sqrt`` allowed); null without a digit and for
    a number or fraction."""
    plain = F.regexp_replace(F.replace(text, F.lit("^"), F.lit("**")), r"\bsqrt\(([^)]+)\)", r"($1)**0.5")
    return F.when(text.rlike(r"[0-9]") & fraction(text).isNull(), plain)


def _compared(texts: Column) -> Column:
    """Of ``texts(a, b, c, sum_a, sum_b, sum_c)``, in Arrow batches: the values of the sums of
    a, b and c, and whether a, and whether c, has the canonical form of b."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = {f"value_{x}": pd.Series([_as_double(t) for t in rows[f"sum_{x}"]], dtype="float64") for x in "abc"}
        same = {f"same_{x}": pd.Series([same_form(p, q) for p, q in zip(rows[x], rows["b"])], dtype="bool") for x in "ac"}
        return pd.DataFrame({**values, **same})

    return F.pandas_udf(run, "value_a double, value_b double, value_c double, same_a boolean, same_c boolean")(texts)


def _number_match(truth: Column, pred: Column) -> Column:
    def compare(x: Column) -> Column:
        t, p = x["t"], x["p"]
        return F.when((t == F.floor(t)) & (F.abs(t) < 1e15), F.bround(p) == t).otherwise(within_eps(p, t))

    return let(F.struct(truth.alias("t"), pred.alias("p")), compare)


def champ_texts(extracted: Column, answer: Column) -> Column:
    """What ``score_champ_texts`` judges: ``truth, pred, other`` as said, ``a, b, c`` their
    canonical wordings, ``sum_a, sum_b, sum_c`` what is to be evaluated of those."""
    answer = strip(answer)
    parts = F.struct(plain_answer(answer).alias("truth"), plain_answer(extracted).alias("pred"), plain_answer(alternative(answer)).alias("other"))
    parts = let(parts, lambda x: F.struct(x["truth"], x["pred"], x["other"], canonical(x["truth"]).alias("a"), canonical(x["pred"]).alias("b"), canonical(x["other"]).alias("c")))
    return let(parts, lambda x: F.struct(*[x[c] for c in ("truth", "pred", "other", "a", "b", "c")], *[_arithmetic(x[c]).alias(f"sum_{c}") for c in "abc"]))


def score_champ(extracted: Column, answer: Column) -> Column:
    """Kind of match: exact, yes_no, canonical, numeric, symbolic (one canonical form), the
    same with ``_alt``, or none."""
    return score_champ_texts(champ_texts(extracted, answer))


def score_champ_texts(texts: Column) -> Column:
    """``score_champ`` of ``champ_texts``, which Spark takes once from a column of its own and
    twice (for Python's part and for the verdict) from an expression."""

    def judge(x: Column) -> Column:
        said, got = x["said"], x["got"]
        low, truth = F.lower(said["pred"]), F.lower(said["truth"])
        yes_no = F.when(low.contains("yes") | low.contains("true"), "yes").when(low.contains("no") | low.contains("false"), "no")
        asked = truth.isin("yes", "no") & yes_no.isNotNull()
        value = lambda c: F.coalesce(fraction(said[c]), F.nanvl(got[f"value_{c}"], F.lit(None).cast("double")))

        def match(c: str) -> Column:
            found = F.when(F.lower(said[c]) == F.lower(said["b"]), "canonical").when(_number_match(value(c), value("b")), "numeric")
            return F.coalesce(found, F.when(got[f"same_{c}"], "symbolic"))

        other = F.when(F.lower(said["other"]) == low, "exact_alt")
        out = F.when(truth == low, "exact").when(asked, F.when(yes_no == truth, "yes_no").otherwise("none"))
        return out.otherwise(F.coalesce(match("a"), other, F.concat(match("c"), F.lit("_alt")), F.lit("none")))

    return let(F.struct(texts.alias("said"), _compared(texts).alias("got")), judge)


# ---- theoremqa ---------------------------------------------------------------------------


def _units(text: Column) -> Column:
    return _cleaned(text, UNITS)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\.+$", ""), "/+$", "")


def extract_theorem(text: Column) -> Column:
    """Note that "yes", "true", "no" and "false" count inside words as well."""
    return theorem_answer(theorem_texts(text))


def theorem_texts(text: Column) -> Column:
    """What ``theorem_answer`` takes the answer from: ``flagged, pred, tail``. Spark takes it
    once from a column of its own and twice from an expression."""

    def first(t: Column) -> Column:
        repeated = sum((F.size(F.split(t, x)) > 2).cast("int") for x in TRIGGERS) > 0
        return F.when(repeated, F.substring_index(t, "\n\n", 1)).otherwise(t)

    def read(parts: Column) -> Column:
        pred = strip(_bare(F.regexp_replace(F.element_at(parts, -1), r"^\n+|\n+$", "")))
        return F.struct((F.size(parts) > 1).alias("flagged"), pred.alias("pred"))

    said = let(F.split(let(F.regexp_replace(text, r"^\n+|\n+$", ""), first), "|".join(TRIGGERS)), read)
    return let(said, lambda x: F.struct(x["flagged"], x["pred"], _units(strip(F.substring_index(x["pred"], "=", -1))).alias("tail")))


def theorem_answer(said: Column) -> Column:
    def judge(x: Column) -> Column:
        pred, tail = x["said"]["pred"], x["said"]["tail"]
        low = F.lower(pred)
        tail = F.coalesce(x["value"], F.when(tail.rlike(NUMBER_AND_UNIT), F.substring_index(tail, " ", 1)).otherwise(tail))
        free = F.coalesce(_last(pred, LAST_DECIMAL), F.lit(""))
        out = F.when(low.rlike(TRUE_INSIDE), "True").when(low.rlike(FALSE_INSIDE), "False").when(low.rlike(OPTION_INSIDE), pred)
        return _bare(out.when(x["said"]["flagged"], tail).otherwise(free))

    return let(F.struct(said.alias("said"), latex_value_column(said["tail"]).alias("value")), judge)


def _list_match(answer: str | None, truth: str | None) -> bool:
    """Sorted numbers of two literal lists agree, integers rounded, floats within 4 percent."""
    if not answer or not truth or not (answer.startswith("(") and answer.endswith(")")):
        return False
    a, t = literals(answer.strip("()")), literals(truth.strip().strip("[]()"))
    if a is None or t is None or len(a) != len(t) or any(not isinstance(x, (int, float)) for x in a + t):
        return False
    return all(round(x) == y if isinstance(y, int) else abs(x - y) <= max(abs(y) * 0.04, 1e-9) for x, y in zip(sorted(a), sorted(t)))


def _lists_agree(answer: Column, truth: Column) -> Column:
    run = F.pandas_udf(lambda a, t: pd.Series([_list_match(x, y) for x, y in zip(a, t)], dtype="bool"), "boolean")
    return run(answer, truth)


def score_theorem(extracted: Column, answer: Column, answer_type: Column) -> Column:
    def texts(x: Column) -> Column:
        plain = _units(x["pred"])
        known = number(plain)
        return F.struct(x["pred"], x["truth"], known.alias("known"), F.when(known.isNull() & x["pred"].rlike("[0-9]"), plain).alias("sum"))

    said = let(F.struct(extracted.alias("pred"), strip(answer).alias("truth")), texts)

    def judge(x: Column) -> Column:
        truth, pred = x["said"]["truth"], F.lower(x["said"]["pred"])
        low, value = F.lower(truth), F.coalesce(x["said"]["known"], x["value"])
        numeric = F.when(answer_type.isin("integer", "float"), _number_match(number(truth), value)).when(answer_type.contains("list"), x["agree"])
        return F.when(low.isin(OPTIONS), pred.contains(low)).when(pred == low, True).otherwise(F.coalesce(numeric, F.lit(False)))

    return let(F.struct(said.alias("said"), _evaluate(said["sum"]).alias("value"), _lists_agree(F.when(answer_type.contains("list"), extracted), strip(answer)).alias("agree")), judge)


# ---- all datasets ------------------------------------------------------------------------


Judge = Callable[[Column], tuple[Column, Column]]


def judge_toolqa(text: Column) -> tuple[Column, Column]:
    x = extract_toolqa(text)
    return x, score_toolqa(x, F.col("answer")) != "none"


def judge_logic(text: Column) -> tuple[Column, Column]:
    x = F.when(F.coalesce("task_type", F.lit("BQA")) == "BQA", extract_yes_no(text)).otherwise(extract_choice(text, F.col("question")))
    return x, score_logic(x, F.col("answer"))


def judge_medcalc(text: Column) -> tuple[Column, Column]:
    kind, calc = F.coalesce("output_type", F.lit("decimal")), F.coalesce("calculator_id", F.lit(0))
    x = extract_medcalc(text, kind, calc)
    return x, score_medcalc(x, F.col("answer"), kind, calc, F.col("lower_limit"), F.col("upper_limit"))


def judge_champ(text: Column) -> tuple[Column, Column]:
    x = extract_champ(text)
    return x, score_champ(x, F.col("answer")) != "none"


def judge_theorem(text: Column) -> tuple[Column, Column]:
    x = extract_theorem(text)
    return x, score_theorem(x, F.col("answer"), F.coalesce("answer_type", F.lit("float")))


def judge_code(text: Column) -> tuple[Column, Column]:
    """The code that the entry point needs; it isn't run, so nothing counts as right."""
    return code_column(text, F.col("entry_point")), F.lit(False)


#: What each dataset's answers are extracted and judged by.
JUDGES: dict[str, Judge] = {"toolqa": judge_toolqa, "logicbench": judge_logic, "medcalcbench": judge_medcalc, "champ": judge_champ, "theoremqa": judge_theorem, "bigcodebench": judge_code}


def evaluate_answers(records: DataFrame, instances: DataFrame, judges: dict[str, Judge] | None = None) -> tuple[DataFrame, DataFrame]:
    """Details of ``records(instance_id, raw_output)`` joined with ``instances(instance_id,
    dataset, question, answer, answer_type, task_type, output_type, calculator_id,
    lower_limit, upper_limit, entry_point)``, and the records without an instance. A dataset
    without a judge stops the run with an error."""
    judges = JUDGES if judges is None else judges
    if "entry_point" not in instances.columns:
        instances = instances.withColumn("entry_point", F.lit(None).cast("string"))
    rows = records.join(instances, "instance_id").withColumn("text", strip_think("raw_output"))
    details = None
    for name, judge in judges.items():
        answer, right = judge(F.col("text"))
        part = rows.filter(F.col("dataset") == name).withColumn("extracted_answer", answer)
        part = part.select("instance_id", "dataset", F.col("answer").alias("ground_truth"), "extracted_answer", F.coalesce(right, F.lit(False)).alias("correct"))
        details = part if details is None else details.unionByName(part)
    known = F.coalesce(F.col("dataset").isin(*judges), F.lit(False))
    stop = rows.filter(~known).select("instance_id", F.raise_error(F.concat(F.lit("no judge for dataset "), F.coalesce("dataset", F.lit("null")))).cast("string").alias("dataset"))
    details = details.unionByName(stop.select("instance_id", "dataset", *[F.lit(None).cast("string").alias(c) for c in ("ground_truth", "extracted_answer")], F.lit(False).alias("correct")))
    return details, records.join(instances, "instance_id", "left_anti")
