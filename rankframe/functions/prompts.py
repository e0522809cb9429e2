"""Prompt columns by dataset; builders are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rankframe.functions.text import model_short_name

Builder = Callable[[Column], tuple[Column, Column]]
BUILDERS: dict[str, Builder] = {}


def register(name: str) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        BUILDERS[name] = f
        return f

    return add


# The datasets' published instructions. A question is searched by its whole
# prompt, so rankings depend on them.
THEOREM_SYSTEM = """You are a science teacher, you are supposed to provide a solution to a given problem. You need to output the answer in your final sentence like "Therefore, the answer is ...". The answer can only be one of the following forms:
1. a numerical value like 0.1, no symbol at all.
2. a list of number like [2, 3, 4].
3. True/False.
4. an option like (a), (b), (c), (d)"""
THEOREM_USER = ("Problem:", "\nSolution:")
CHAMP_SYSTEM = "You are an expert on mathematics."
CHAMP_USER = (
    "Solve the following problem. Make sure to show your work before giving the final answer.\n\n",
    """

After your solution, write your final answer on its own line in exactly this format:
ANSWER: <your answer>

The answer should be concise: a number, mathematical expression, Yes/No, or a brief phrase. Do not include explanations in the ANSWER line. Use plain text only — do not use LaTeX, dollar signs, or any other formatting (e.g., write n! not \\(n!\\) or $n!$).""",
)
MEDCALC_SYSTEM = "You are a helpful assistant for calculating a score for a given patient note. Please think step-by-step to solve the question and then generate the required score."
MEDCALC_USER = (
    "",
    """

Show your step-by-step calculation, then write your final answer on its own line in exactly this format:
ANSWER: <your answer>

For numeric answers, give the number only (e.g., 25.24). For date answers, use MM/DD/YYYY format. For scores, give the integer value. Do not include units or explanations in the ANSWER line.""",
)


def _around(system: str, user: tuple[str, str]) -> Builder:
    return lambda question: (F.lit(system), F.concat(F.lit(user[0]), question, F.lit(user[1])))


register("theoremqa")(_around(THEOREM_SYSTEM, THEOREM_USER))
register("champ")(_around(CHAMP_SYSTEM, CHAMP_USER))
register("medcalcbench")(_around(MEDCALC_SYSTEM, MEDCALC_USER))


@register("toolqa")
def _toolqa(question: Column) -> tuple[Column, Column]:
    return F.lit("Answer by alternating Thought, Action and Observation steps; end with Finish[answer]."), F.concat(F.lit("Question: "), question)


@register("logicbench")
@register("bigcodebench")
def _plain(question: Column) -> tuple[Column, Column]:
    return F.lit(""), question


def prompts(dataset: Column, question: Column, skills: Column | None = None) -> tuple[Column, Column]:
    """System and user prompt by dataset; ``skills``, an array of texts, goes before the user part."""
    system = user = None
    for name, build in BUILDERS.items():
        s, u = build(question)
        system = F.when(dataset == name, s) if system is None else system.when(dataset == name, s)
        user = F.when(dataset == name, u) if user is None else user.when(dataset == name, u)
    if skills is not None:
        block = F.concat(F.lit("Relevant Skill:\n"), F.array_join(skills, "\n---\n"), F.lit("\n\n"), user)
        user = F.when(F.size(skills) > 0, block).otherwise(user)
    return system, user


def retrieval_query(dataset: Column, question: Column, examples: dict[str, str] | None = None) -> Column:
    """Text a question is searched by: user part, the system part, and the worked
    ``examples`` of its dataset, where there are any."""
    system, user = prompts(dataset, question)
    shots = F.lit(None).cast("string")
    for name, text in (examples or {}).items():
        shots = F.when(dataset == name, F.lit(text)).otherwise(shots)
    return F.concat_ws("\n", user, F.when(system != "", system), shots)


def extra_body(model: Column, thinking: Column) -> Column:
    """Request flags of a model family as JSON, by the last part of its name; null: none."""
    name = F.lower(model_short_name(model))
    flag = F.when(thinking, "true").otherwise("false")
    # fixed values: the switches of the model families
    return (
        F.when(name.contains("qwen3"), F.concat(F.lit('{"chat_template_kwargs": {"enable_thinking": '), flag, F.lit("}}")))
        .when(name.contains("gpt-5"), F.lit('{"reasoning_effort": "minimal"}'))
        .when(name.contains("glm-5") | name.contains("kimi"), F.concat(F.lit('{"enable_thinking": '), flag, F.lit("}")))
    )
