"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Phrases that announce an answer.
TRIGGERS = ("The answer is:", "the answer is:", "Therefore, the answer is", "therefore, the answer is")
#: Words that mark a question about an attribute.
ATTRIBUTE_WORDS = ["born", "birth", "where", "when", "located", "location", "founded", "founder", "died", "death", "nationality", "capital", "date", "year"]
MAX_PASSAGE, MAX_OBSERVATION = 4000, 3000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column | str) -> Column:
    """Lower-cased words, runs of letters, digits and ``_``. Null: no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(r"(?U)\w+"), 0)


def non_empty(x: Column | str) -> Column:
    return F.when(_c(x) != "", _c(x))


def retrieval_text(name: Column | str, description: Column | str, content: Column | str) -> Column:
    """Non-empty parts joined by line feeds."""
    return F.concat_ws("\n", non_empty(name), non_empty(description), non_empty(content))


def display_name(name: Column | str, index: Column | str | None = None) -> Column:
    """Trimmed name, else ``Skill #index``, else ``Unnamed skill``."""
    fallback = F.lit("Unnamed skill") if index is None else F.coalesce(F.concat(F.lit("Skill #"), _c(index).cast("string")), F.lit("Unnamed skill"))
    return F.coalesce(non_empty(F.trim(_c(name))), fallback)


def drop_title(text: Column | str) -> Column:
    """Without its first line, if that has at most 80 characters and more text follows."""
    t = _c(text)
    first = F.substring_index(t, "\n", 1)
    rest = F.substring(t, F.length(first) + 2, F.lit(1 << 30))
    return F.when((F.length(first) <= 80) & (F.trim(rest) != ""), rest).otherwise(t)


def passage_text(text: Column | str, most: int = MAX_PASSAGE) -> Column:
    return F.substring(_c(text), 1, most)


def content_id(text: Column | str, namespace: str) -> Column:
    return F.concat(F.lit(namespace + "-"), F.md5(_c(text)))


def strip_think(text: Column | str) -> Column:
    """Without ``<think>`` blocks, closed or open, and leading white space after them."""
    t = _c(text)
    cut = F.regexp_replace(F.regexp_replace(t, r"(?s)<think>.*?</think>\s*", ""), r"(?s)<think>.*", "")
    return F.when(t.contains("<think>"), F.regexp_replace(cut, r"^\s+", "")).otherwise(t)


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def after_trigger(text: Column | str) -> Column:
    """First line after the last trigger phrase, without closing dots and slashes; null without a phrase."""
    t = _c(text)
    pattern = "(?s).*(?:" + "|".join(TRIGGERS) + ")(.*)"
    line = strip(F.substring_index(F.regexp_extract(t, pattern, 1), "\n", 1))
    line = strip(F.regexp_replace(F.regexp_replace(line, r"\.+$", ""), "/+$", ""))
    return F.when(t.rlike("|".join(TRIGGERS)), line)


def last_line(text: Column | str) -> Column:
    """Last line that is not blank, trimmed; '' if there is none."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def number(text: Column | str) -> Column:
    """The double a plain number literal stands for, else null (no suffixes; ``_`` only between digits)."""

    def parse(t: Column) -> Column:
        ok = t.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$")
        word = t.rlike(r"^[+-]?(inf|infinity|nan)$")
        return F.when(ok, F.regexp_replace(t, "_", "").try_cast("double")).when(word, F.regexp_replace(t, "^\\+", "").try_cast("double"))

    return let(F.lower(strip(_c(text))), parse)


def within_eps(pred: Column, truth: Column, ratio: float = 0.04, floor: float = 1e-9) -> Column:
    eps = F.greatest(F.abs(truth) * ratio, F.lit(floor))
    return (pred >= truth - eps) & (pred <= truth + eps)


def ranking_positions(text: Column | str, n: Column | int) -> Column:
    """0-based positions from all integers of the text that lie in 1..n, first occurrence first."""
    n = F.lit(n) if isinstance(n, int) else n
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(r"\d+"), 0), lambda x: x.try_cast("int"))
    return F.transform(F.array_distinct(F.filter(found, lambda x: x.between(1, n))), lambda x: x - 1)


def first_choice(text: Column | str, n: Column | int) -> Column:
    """0-based position of the first integer in 1..n; null without one."""
    return F.try_element_at(ranking_positions(text, n), F.lit(1))


def candidate_lines(candidates: Column) -> Column:
    """``[i] name: description`` lines of an array of structs."""
    line = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["name"], F.lit("")), F.lit(": "), F.coalesce(x["description"], F.lit("")))
    return F.array_join(F.transform(candidates, line), "\n")


def occurrences(text: Column | str, part: Column | str) -> Column:
    """Non-overlapping occurrences; 0 for an empty part."""
    t, p = _c(text), _c(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def asks_attribute(question: Column | str) -> Column:
    return F.arrays_overlap(tokens(question), F.array(*[F.lit(w) for w in ATTRIBUTE_WORDS]))


def attribute_overlap(question: Column | str, passage: Column | str) -> Column:
    """Number of attribute words that both texts contain."""
    q, p = F.lower(_c(question)), F.lower(_c(passage))
    return sum((q.contains(w) & p.contains(w)).cast("int") for w in ATTRIBUTE_WORDS)


def action_type(action: Column | str) -> Column:
    return F.regexp_extract(strip(_c(action)), r"(?s)^(\w+)\[(.+)\]$", 1)


def action_argument(action: Column | str) -> Column:
    return F.regexp_extract(strip(_c(action)), r"(?s)^(\w+)\[(.+)\]$", 2)


def shortened(observation: Column | str, most: int = MAX_OBSERVATION) -> Column:
    o = _c(observation)
    return F.when(F.length(o) > most, F.concat(F.substring(o, 1, most), F.lit("... (truncated, "), F.length(o).cast("string"), F.lit(" chars total)"))).otherwise(o)


def own_observation_cut(response: Column | str) -> Column:
    """A model's step up to an observation that it made up itself."""
    return strip(F.regexp_extract(_c(response), r"(?s)^(.*?)(?:\n?\s*Observation\s*\d*\s*:|\z)", 1))


def thought_part(response: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_extract(_c(response), r"(?s)^(.*?)(?:\n?\s*Action\s*\d*\s*:|\z)", 1), r"^\s*Thought\s*\d*\s*:", ""))


def action_part(response: Column | str) -> Column:
    return strip(F.substring_index(F.regexp_extract(_c(response), r"(?s)Action\s*\d*\s*:\s*(.*)", 1), "\n", 1))


def load_skill_argument(response: Column | str) -> Column:
    return strip(F.regexp_extract(_c(response), r"(?m)LOAD_SKILL:\s*(.+)$", 1))


def tool_call(response: Column | str) -> Column:
    """Struct of name and argument text of the first ``TOOL_CALL: f(args)`` line; null without one."""
    pattern = r"(?m)^TOOL_CALL:\s*(\w+)\((.*)\)\s*$"
    r = _c(response)
    return F.when(r.rlike(pattern), F.struct(F.regexp_extract(r, pattern, 1).alias("name"), F.regexp_extract(r, pattern, 2).alias("args")))


def model_short_name(model: Column | str) -> Column:
    return F.element_at(F.split(_c(model), "/"), -1)
