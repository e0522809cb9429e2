"""Engines: how one instance is answered by a pluggable responder.

An engine is ``(responder, system, user, skills, execute=, functions=) -> Outcome``. It runs
inside a task, a row at a time, for a conversation goes step by step.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from rankframe.plans.registry import ENGINES

#: Rounds that an engine may take, and characters of an observation.
TOOL_ROUNDS, DISCLOSURE_ROUNDS, REACT_STEPS = 5, 10, 20
MAX_OBSERVATION = 3000

Responder = Callable[[str, str], str]

_CALL = re.compile(r"^TOOL_CALL:\s*(\w+)\(([^)]*)\)\s*$", re.M)
_LOAD = re.compile(r"^LOAD_SKILL:\s*(.+)$", re.M)
_ACTION = re.compile(r"Action\s*\d*\s*:\s*([^\n]*)")


@dataclass
class Outcome:
    text: str | None  # what the responder said
    transcript: str | None = None  # with what it was told in between
    used: list[str] = field(default_factory=list)


# ---- tools -------------------------------------------------------------------------------

_TYPES = {"int": int, "integer": int, "float": float, "number": float, "str": str, "string": str, "bool": bool, "boolean": bool}


def bind(arguments: str, parameters: list[dict]) -> dict | None:
    """Keyword arguments of a call written out with literals, given types by the tool's
    ``parameters(name, type)``; None where the text isn't such a call."""
    try:
        call = ast.parse(f"f({arguments})", mode="eval").body
        values = {parameters[i]["name"] if i < len(parameters) else f"_pos_{i}": ast.literal_eval(a) for i, a in enumerate(call.args)}
        values |= {k.arg: ast.literal_eval(k.value) for k in call.keywords}
    except (SyntaxError, ValueError, AttributeError, MemoryError, RecursionError):
        return None
    kinds = {p["name"]: _TYPES.get((p.get("type") or "").lower()) for p in parameters}
    for name, value in values.items():
        kind = kinds.get(name)
        # a whole number stands for a float, and a float without a fraction for a whole number
        if kind is float and type(value) is int or kind is int and type(value) is float and value == int(value):
            values[name] = kind(value)
    return values


def find_call(said: str, tools: dict[str, dict]) -> tuple[str, str, dict] | None:
    """What was said up to the first call of a known tool, the tool and its arguments."""
    for m in _CALL.finditer(said):
        if m[1] in tools and (values := bind(m[2].strip(), tools[m[1]].get("parameters") or [])) is not None:
            return said[: m.end()], m[1], values
    return None


def call(functions: dict[str, Callable], name: str, values: dict) -> str:
    try:
        return str(functions[name](**values))
    except Exception as e:  # the responder is told
        return f"Error: {type(e).__name__}: {e}"


def _tools_of(skills: list[dict]) -> dict[str, dict]:
    return {t["name"]: t for s in skills for t in s.get("tools") or ()}


def tool_loop(responder: Responder, system: str, user: str, tools: dict[str, dict], functions: dict[str, Callable], rounds: int = TOOL_ROUNDS) -> tuple[str, str]:
    """Text and transcript of a conversation in which calls of tools are answered."""
    talk, text, transcript = user, "", ""
    for _ in range(rounds):
        said = responder(system, talk)
        if not said:
            break
        found = find_call(said, tools)
        if found is None:
            return text + said, transcript + said
        head, name, values = found
        told = f"TOOL_RESULT: {call(functions, name, values)}"
        text += head
        transcript += f"{head}\n{told}\n"
        talk += f"\n{head}\n{told}"
    return text, transcript


@ENGINES.register("direct")
def direct(responder: Responder, system: str, user: str, skills: list[dict], execute: Callable[[str], str] | None = None, functions: dict[str, Callable] | None = None) -> Outcome:
    """One answer; a tool loop where a skill has tools."""
    used, tools = [s["skill_id"] for s in skills], _tools_of(skills)
    if not tools:
        return Outcome(responder(system, user), None, used)
    return Outcome(*tool_loop(responder, system, user, tools, functions or {}), used)


# ---- skills on demand --------------------------------------------------------------------


class Shelf:
    """Skills that may be asked for by number, id or name."""

    def __init__(self, skills: list[dict]):
        self.skills, self.loaded = skills, []

    def catalog(self) -> str:
        return "\n".join(f"{i}: {_name(s, i)}: {s.get('description') or ''}" for i, s in enumerate(self.skills))

    def find(self, key: str) -> dict | None:
        by_id = {str(s["skill_id"]): s for s in self.skills}
        by_name = {str(s.get("name") or "").lower(): s for s in reversed(self.skills)}
        number = self.skills[int(key)] if key.isdecimal() and int(key) < len(self.skills) else None
        return number or by_id.get(key) or by_name.get(key.lower())

    def load(self, key: str) -> str:
        skill = self.find(key)
        if skill is None:
            return f"There is no skill {key!r}. Go on."
        self.loaded.append(skill["skill_id"])
        return f"Skill loaded: {_name(skill)}\n---\n{skill.get('content') or ''}\n---\nGo on."


def _name(skill: dict, number: int | None = None) -> str:
    return (skill.get("name") or "").strip() or ("Unnamed skill" if number is None else f"Skill #{number}")


@ENGINES.register("progressive_disclosure")
def disclose(responder: Responder, system: str, user: str, skills: list[dict], execute: Callable[[str], str] | None = None, functions: dict[str, Callable] | None = None) -> Outcome:
    """Names and descriptions are shown first; ``LOAD_SKILL: x`` adds a skill's text and its
    tools. Loading comes before calling."""
    shelf = Shelf(skills)
    system = "\n\n".join(x for x in (system, "Skills (say LOAD_SKILL: number to read one):\n" + shelf.catalog()) if x)
    talk, text, transcript = user, "", ""
    for _ in range(DISCLOSURE_ROUNDS):
        said = responder(system, talk)
        if not said:
            break
        asked = _LOAD.search(said)
        if asked:
            head, told = said[: asked.end()], shelf.load(asked[1].strip())
        else:
            found = find_call(said, _tools_of([s for s in skills if s["skill_id"] in shelf.loaded]))
            if found is None:
                text, transcript = text + said, transcript + said
                break
            head, told = found[0], f"TOOL_RESULT: {call(functions or {}, *found[1:])}"
        text += head
        transcript += f"{head}\n{told}\n"
        talk += f"\n{head}\n{told}"
    return Outcome(text, transcript, shelf.loaded)


# ---- thought, action, observation --------------------------------------------------------


def _steps(responder: Responder, system: str, user: str, act: Callable[[str], str]) -> tuple[str, str]:
    pad, own = "", ""
    for step in range(1, REACT_STEPS + 1):
        said = responder(system, f"{user}{pad}\nThought {step}:").split("\nObservation")[0]  # an observation of its own making is cut
        pad += f"\nThought {step}:{said}"
        own += f"\nThought {step}:{said}"
        actions = _ACTION.findall(said)
        action = actions[-1].strip() if actions else ""
        if action.startswith("Finish[") or not action:
            break
        seen = act(action)
        if len(seen) > MAX_OBSERVATION:
            seen = f"{seen[:MAX_OBSERVATION]}... (truncated, {len(seen)} chars total)"
        pad += f"\nObservation {step}: {seen}"
    return own.strip("\n"), pad.strip("\n")


@ENGINES.register("react")
def react(responder: Responder, system: str, user: str, skills: list[dict], execute: Callable[[str], str] | None = None, functions: dict[str, Callable] | None = None) -> Outcome:
    """Thought and action in turn, with an observation from ``execute``, until Finish[...]."""
    act = execute or (lambda action: "no tools")
    return Outcome(*_steps(responder, system, user, act), [s["skill_id"] for s in skills])


@ENGINES.register("react_progressive_disclosure")
def react_disclose(responder: Responder, system: str, user: str, skills: list[dict], execute: Callable[[str], str] | None = None, functions: dict[str, Callable] | None = None) -> Outcome:
    """The same with an action ``LoadSkill[x]`` that shows a skill's text."""
    shelf = Shelf(skills)
    system = "\n\n".join(x for x in (system, "Skills (LoadSkill[number] shows one):\n" + shelf.catalog()) if x)

    def act(action: str) -> str:
        m = re.fullmatch(r"LoadSkill\[(.+)\]", action)
        if m:
            return shelf.load(m[1].strip())
        return execute(action) if execute else "no tools"

    return Outcome(*_steps(responder, system, user, act), shelf.loaded)
