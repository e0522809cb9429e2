"""Code in answers: parsed, never run."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings

import pandas as pd
from pyspark.sql import Column, functions as F

#: Lines that are parsed first from a start; as many more each time nothing in them is wrong.
WINDOW = 16
#: Errors that a text cut short may give although more lines would mend it.
_CUT_SHORT = ("was never closed", "unterminated triple-quoted", "unexpected EOF", "expected an indented block", "expected 'except'")


def _parse(code: str) -> tuple[ast.Module | None, int, bool]:
    """The tree, or the line at which no continuation can be right any more and whether the
    end of the text may be to blame."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(code), 0, False
        except SyntaxError as e:
            return None, e.lineno or 1, any(x in (e.msg or "") for x in _CUT_SHORT)
        except (ValueError, MemoryError, RecursionError):
            return None, 1, False


def _ends(lines: list[str]) -> list[bool]:
    """For each line whether a program may end with it: it ends a statement that isn't the
    head of a block or a decorator, and no ``try`` before it waits for its handlers."""
    state, ok, row, depth, waiting = True, [], 0, 0, set()
    first = last = None
    try:
        for kind, text, _, (end, _), _ in tokenize.generate_tokens(io.StringIO("\n".join(lines) + "\n").readline):
            if kind == tokenize.INDENT:
                depth += 1
            elif kind == tokenize.DEDENT:
                waiting.discard(depth)
                depth -= 1
            elif kind == tokenize.NEWLINE:
                if first == "try":
                    waiting.add(depth)
                elif first in ("except", "finally"):
                    waiting.discard(depth)
                state = last != ":" and first != "@" and not waiting
                ok += [False] * (end - 1 - row) + [state]
                row, first, last = end, None, None
            elif kind in (tokenize.NL, tokenize.COMMENT):
                if first is None and end > row:
                    ok += [state] * (end - row)
                    row = end
            else:
                first, last = first or text, text
    except (tokenize.TokenError, SyntaxError):
        pass  # an open bracket or string: no line after its first ends a statement
    return (ok + [False] * len(lines))[: len(lines)]


def _longest_from(lines: list[str], full: list[int], i: int) -> tuple[int, int, ast.Module | None]:
    """``(count, j, tree)`` of the range from line i that parses and has the most lines that
    aren't blank; a count of 0 where there is none."""
    size, rest = WINDOW, len(lines) - i
    while True:
        n = min(size, rest)
        tree, wrong, cut = _parse("\n".join(lines[i : i + n]))
        if n == rest or tree is None and wrong < n and not cut:
            break
        size *= 2
    most = n if tree is not None else min(wrong - 1, n - 1)
    if full[i + most] == full[i] or most < 1:
        return 0, 0, None
    if tree is None:
        # lines that hold nothing don't decide whether the lines before them parse
        ok = _ends(lines[i : i + most])
        for m in range(most, 0, -1):
            if ok[m - 1] and (tree := _parse("\n".join(lines[i : i + m]))[0]) is not None:
                most = m
                break
        else:
            return 0, 0, None
    count = full[i + most] - full[i]
    for m in range(2, most + 1):  # the shortest range with as many lines
        if full[i + m] - full[i] == count and (m == most or _parse("\n".join(lines[i : i + m]))[0] is not None):
            return count, i + m - 1, tree
    # one line that parses alone: with the next, if that is blank or a comment
    if i + 1 < len(lines) and most == 1 and _parse("\n".join(lines[i : i + 2]))[0] is not None:
        return full[i + 2] - full[i], i + 1, tree
    return 0, 0, None


def longest_code(text: str) -> str:
    """The range of two lines or more that parses and has the most lines that aren't blank
    (the first of equal ones); the first line where there is none.

    A start is left out if its line is indented (no program begins so), and if an earlier
    start's program has a statement ending before it, for then the earlier range that goes
    as far is as good. From the others one parse tells how far a range can reach at all, and
    only ends of statements are tried below that.
    """
    lines = text.split("\n")
    full = [0]
    for line in lines:
        full.append(full[-1] + bool(line.strip()))
    best, found, between = 0, (0, 0), set()
    for i, line in enumerate(lines[:-1]):
        if full[-1] - full[i] <= best:
            break
        if i in between or line[:1] in " \t\f" and line.strip() and line.strip()[0] != "#":
            continue
        count, j, tree = _longest_from(lines, full, i)
        if count > best:
            best, found = count, (i, j)
        if tree is not None:
            inside = set()
            for node in tree.body:
                start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
                inside.update(range(i + start, i + (node.end_lineno or node.lineno)))
            between.update(k for k in range(i + 1, j + 1) if k not in inside)
    return "\n".join(lines[found[0] : found[1] + 1])


def _defined(node: ast.stmt) -> str | None:
    """Name that a top-level statement defines."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return None if node.decorator_list else node.name
    if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
        return node.targets[0].id
    if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
        return node.target.id
    return None


def _named(node: ast.AST) -> set[str]:
    """Every name inside a statement."""
    out: set[str] = set()
    for x in ast.walk(node):
        out.update(v for k in ("id", "arg", "attr", "name") if isinstance(v := getattr(x, k, None), str))
    return out


def needed_code(text: str, entry: str | None) -> str:
    """Imports and those definitions that ``entry`` needs (all, without one) of the longest
    code in ``text``; of a name that is defined again the first definition. Where nothing
    is left, the longest code."""
    code = longest_code((text or "").strip())
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return longest_code(text or "")
    imports = [n for n in body if isinstance(n, (ast.Import, ast.ImportFrom))]
    defined: dict[str, ast.stmt] = {}
    for node in body:
        name = _defined(node)
        if name:
            defined.setdefault(name, node)
    reached, todo = set(), [entry] if entry else list(defined)
    while todo:
        name = todo.pop()
        if name in defined and name not in reached:
            reached.add(name)
            todo += _named(defined[name])
    kept = imports + [n for name, n in defined.items() if name in reached]
    out = "\n".join(ast.get_source_segment(code, n) or "" for n in kept).strip()
    return out or longest_code(text or "")


def code_column(text: Column, entry: Column) -> Column:
    """``needed_code`` in Arrow batches."""
    run = F.pandas_udf(lambda t, e: pd.Series([needed_code(a or "", b) for a, b in zip(t, e)]), "string")
    return run(text, entry)
