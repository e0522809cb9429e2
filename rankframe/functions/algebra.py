"""Expressions of answers: a fixed grammar of plain and LaTeX notation, and a canonical form
in which equal ones can be told. Nothing is run; what the grammar lacks has no value.

A form is a quotient of two sums of terms. A term is a rational number times powers of
atoms: variables, primes under roots, function values, and powers with an exponent that
isn't a number (by its parts: ``2^(n+1)`` is ``2 * 2^n``). Exponents are rational. Whole
factors and exponents are always ints, which also makes the names of forms canonical.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

#: Functions, constants, and names that aren't products of letters.
FUNCTIONS = ("sqrt", "sin", "cos", "tan", "log", "ln", "exp", "floor", "ceil", "abs", "max", "min", "gcd", "lcm", "phi", "binomial", "factorial")
NAMES = ("pi", "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "sigma", "omega", "epsilon")
SPACES = (r"\left", r"\right", r"\,", r"\;", r"\:", r"\!", r"\ ", "$")
TIMES, DIVIDED, FRACTIONS = (r"\cdot", r"\times", "*", "×", "·"), (r"\div", "/", "÷"), (r"\frac", r"\dfrac", r"\tfrac")

#: Sums of more terms, and larger exponents and roots, have no form.
MOST_TERMS, MOST_POWER = 400, 40
_TOKEN = re.compile(r"\s*(\d+\.\d*|\.\d+|\d+|\*\*|\\[A-Za-z]+|\\.|[A-Za-z]+|\S)")

#: Results kept in a worker: texts of answers repeat.
MOST_KEPT = 10_000

Term = tuple[tuple[object, int | Fraction], ...]
Sum = dict[Term, int | Fraction]
Form = tuple[Sum, Sum]
ONE: Sum = {(): 1}


class NoForm(ValueError):
    pass


# ---- arithmetic of forms ------------------------------------------------------------------


def _primes(n: int) -> dict[int, int]:
    """Prime powers of n; a large factor that small primes don't divide stays whole."""
    out, p = {}, 2
    while p * p <= n and p < 10_000:
        while n % p == 0:
            out[p], n = out.get(p, 0) + 1, n // p
        p += 1
    if n > 1:
        out[n] = out.get(n, 0) + 1
    return out


def _plain(x: int | Fraction) -> int | Fraction:
    return x.numerator if type(x) is Fraction and x.denominator == 1 else x


def _term(factor: int | Fraction, powers: dict[object, int | Fraction]) -> tuple[Term, int | Fraction]:
    """Whole powers of numbers go into the factor."""
    kept = {}
    for atom, e in powers.items():
        if isinstance(atom, int):
            whole = math.floor(e)
            if abs(whole) > MOST_POWER * 8:
                raise NoForm
            factor *= Fraction(atom) ** whole
            e -= whole
        if e:
            kept[atom] = _plain(e)
    return tuple(sorted(kept.items(), key=repr) if len(kept) > 1 else kept.items()), _plain(factor)


@lru_cache(MOST_KEPT)
def _joined(s: Term, t: Term) -> tuple[Term, int | Fraction]:
    """The product of two terms."""
    powers = dict(s)
    for atom, e in t:
        powers[atom] = powers.get(atom, 0) + e
    return _term(1, powers)


def _plus(a: Sum, b: Sum) -> Sum:
    out = dict(a)
    for t, c in b.items():
        out[t] = out[t] + c if t in out else c
    out = {t: _plain(c) for t, c in out.items() if c}
    if len(out) > MOST_TERMS:
        raise NoForm
    return out


def _times(a: Sum, b: Sum) -> Sum:
    if a is ONE or b is ONE:
        return b if a is ONE else a
    if len(a) * len(b) > MOST_TERMS * 4:
        raise NoForm
    out: Sum = {}
    for s, c in a.items():
        for t, d in b.items():
            term, factor = _joined(s, t) if s and t else (s or t, 1)
            factor = factor * c * d
            out[term] = out[term] + factor if term in out else factor
    return _plus(out, {})


def _form(top: Sum, bottom: Sum = ONE) -> Form:
    """A quotient; a bottom of one term goes into the top."""
    if not bottom:
        raise NoForm
    if len(bottom) == 1:
        (t, c), = bottom.items()
        if not t and c == 1:
            return top, ONE
        term, factor = _term(Fraction(1) / c, {a: -e for a, e in t})
        return _times(top, {term: factor}), ONE
    return top, bottom


def add(a: Form, b: Form) -> Form:
    if a[1] == b[1]:
        return _form(_plus(a[0], b[0]), a[1])
    return _form(_plus(_times(a[0], b[1]), _times(b[0], a[1])), _times(a[1], b[1]))


def multiply(a: Form, b: Form) -> Form:
    if a[1] is ONE and b[1] is ONE:
        return _times(a[0], b[0]), ONE
    return _form(_times(a[0], b[0]), _times(a[1], b[1]))


def divide(a: Form, b: Form) -> Form:
    return _form(_times(a[0], b[1]), _times(a[1], b[0]))


def number(x: Fraction | int) -> Form:
    return (ONE if x == 1 else {(): _plain(x)} if x else {}), ONE


def atom(x: object) -> Form:
    return {((x, 1),): 1}, ONE


def name_of(a: Form) -> str:
    return repr(sorted(a[0].items(), key=repr)) + "/" + repr(sorted(a[1].items(), key=repr))


def constant(a: Form) -> Fraction | None:
    if a[1] == ONE and set(a[0]) <= {()}:
        return a[0].get((), 0)
    return None


def _numeric_power(a: Form, e: Fraction) -> Form:
    if e.denominator == 1 and abs(e) <= MOST_POWER or e == 0:
        out = number(1)
        for _ in range(abs(int(e))):
            out = multiply(out, a)
        return out if e >= 0 else divide(number(1), out)
    if abs(e) > MOST_POWER and constant(a) not in (0, 1, 2, 10, -1) or abs(e) > 300:
        raise NoForm
    if a[1] == ONE and len(a[0]) == 1:
        (t, c), = a[0].items()
        if c > 0 and abs(c.numerator) < 10**12 and c.denominator < 10**12:
            powers: dict[object, int | Fraction] = {x: p * e for x, p in t}
            for value, sign in ((c.numerator, 1), (c.denominator, -1)):
                for p, n in _primes(value).items():
                    powers[p] = powers.get(p, 0) + sign * n * e
            term, factor = _term(1, powers)
            return {term: factor}, ONE
        if c < 0 and e.denominator == 1:
            whole = _numeric_power(({t: -c}, ONE), e)
            return multiply(whole, number(1 if e % 2 == 0 else -1))
    if not a[0]:
        if e > 0:
            return number(0)
        raise NoForm
    return {(("root " + name_of(a), _plain(e)),): 1}, ONE


def power(a: Form, b: Form) -> Form:
    e = constant(b)
    if e is not None:
        return _numeric_power(a, e)
    if b[1] != ONE:
        return atom(f"({name_of(a)})^({name_of(b)})")
    base = constant(a)
    bases = _primes(base.numerator) if base is not None and base > 1 and base.denominator == 1 and base < 10**12 else {name_of(a): 1}
    out = number(1)
    for t, c in b[0].items():
        if t == ():
            out = multiply(out, _numeric_power(a, c))
        else:
            for p, n in bases.items():
                out = multiply(out, ({((f"{p}^{t!r}", _plain(c * n)),): 1}, ONE))
    return out


def call(f: str, arguments: list[Form]) -> Form:
    values = [constant(a) for a in arguments]
    whole = all(v is not None and v.denominator == 1 and 0 <= v <= 200 for v in values)
    if f == "sqrt" and len(arguments) == 1:
        return _numeric_power(arguments[0], Fraction(1, 2))
    if f == "exp" and len(arguments) == 1:
        return power(atom("e"), arguments[0])
    if f == "factorial" and len(values) == 1 and whole:
        return number(math.factorial(int(values[0])))
    if f == "binomial" and len(values) == 2 and whole:
        return number(math.comb(int(values[0]), int(values[1])))
    return atom(f"{'ln' if f == 'log' else f}({','.join(map(name_of, arguments))})")


def equal(a: Form, b: Form) -> bool:
    if a[1] is ONE and b[1] is ONE:
        return a[0] == b[0]
    return not _plus(_times(a[0], b[1]), {t: -c for t, c in _times(b[0], a[1]).items()})


# ---- the grammar --------------------------------------------------------------------------


class Reader:
    """``sum := product (+|- product)*``, ``product := unary ((*|/|) unary)*``, ``unary := -
    unary | power``, ``power := primary (^ unary)?``, with postfix ``!``."""

    def __init__(self, text: str):
        self.tokens = [*(t for t in _TOKEN.findall(text) if t not in SPACES), None]
        self.at, self.decimal = 0, False

    def peek(self) -> str | None:
        return self.tokens[self.at]

    def take(self, *wanted: str) -> str | None:
        t = self.tokens[self.at]
        if t is None or wanted and t not in wanted:
            return None
        self.at += 1
        return t

    def need(self, wanted: str) -> None:
        if self.take(wanted) is None:
            raise NoForm

    def whole(self) -> Form:
        out = self.sum()
        if self.peek() is not None:
            raise NoForm
        return out

    def sum(self) -> Form:
        out = self.product()
        while sign := self.take("+", "-", "−"):
            right = self.product()
            out = add(out, right if sign == "+" else multiply(number(-1), right))
        return out

    def product(self) -> Form:
        out = self.unary()
        while True:
            if self.take(*TIMES):
                out = multiply(out, self.unary())
            elif self.take(*DIVIDED):
                out = divide(out, self.unary())
            elif (t := self.peek()) is not None and (t[0].isalnum() or t in ("(", "{") or t[0] == "\\" and t not in (r"\}", r"\{")):
                out = multiply(out, self.power())  # side by side
            else:
                return out

    def unary(self) -> Form:
        if self.take("-", "−"):
            return multiply(number(-1), self.unary())
        return self.unary() if self.take("+") else self.power()

    def power(self) -> Form:
        out = self.primary()
        while self.take("!"):
            out = call("factorial", [out])
        return power(out, self.unary()) if self.take("^", "**") else out

    def group(self) -> Form:
        """``{sum}``, or the next digit or primary as LaTeX takes it."""
        if self.take("{"):
            out = self.sum()
            self.need("}")
            return out
        t = self.peek() or ""
        if t.isdigit() and len(t) > 1:
            self.tokens[self.at : self.at + 1] = list(t)
        return self.primary()

    def arguments(self) -> list[Form]:
        close = {"(": ")", "{": "}"}.get(self.take("(", "{") or "")
        if close is None:
            return [self.power()]
        out = [self.sum()]
        while self.take(","):
            out.append(self.sum())
        self.need(close)
        return out

    def primary(self) -> Form:
        t = self.take()
        if t is None:
            raise NoForm
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            self.decimal |= "." in t
            return number(Fraction(t) if "." in t else int(t))
        if t in ("(", "{"):
            out = self.sum()
            self.need(")" if t == "(" else "}")
            return out
        if t in FRACTIONS:
            top = self.group()
            return divide(top, self.group())
        if t == r"\sqrt":
            degree = number(2)
            if self.take("["):
                degree = self.sum()
                self.need("]")
            return power(self.group(), divide(number(1), degree))
        if t == r"\binom":
            top = self.group()
            return call("binomial", [top, self.group()])
        name = t[1:] if t[0] == "\\" else t
        if name == "C" and self.peek() == "(":
            return call("binomial", self.arguments())
        if name in FUNCTIONS and (t[0] == "\\" or self.peek() == "("):
            return call(name, self.arguments())
        if not name.isalpha():
            raise NoForm
        if name in NAMES or len(name) == 1:
            return atom(name)
        if t[0] == "\\":
            raise NoForm
        self.tokens[self.at : self.at] = list(name[1:])  # letters side by side
        return atom(name[0])


def parse(text: str) -> Form:
    try:
        return Reader(text).whole()
    except (RecursionError, ZeroDivisionError, OverflowError):
        raise NoForm from None


def same_form(a: str | None, b: str | None) -> bool:
    """Whether two expressions have one canonical form; never where one has none."""
    try:
        return a is not None and b is not None and len(a) + len(b) < 2000 and equal(parse(a), parse(b))
    except NoForm:
        return False


@lru_cache(MOST_KEPT)
def latex_value(text: str | None) -> str | None:
    """A number's text, as Python prints it, for an expression of numbers; None for others.
    Roots that don't come out even have no value."""
    if not text or len(text) > 1000:
        return None
    reader = Reader(text)
    try:
        value = constant(reader.whole())
        if value is None:
            return None
        if reader.decimal:
            return repr(float(f"{float(value):.15g}"))
        return str(value.numerator) if value.denominator == 1 else repr(value.numerator / value.denominator)
    except (NoForm, RecursionError, ZeroDivisionError, OverflowError):
        return None


def same_form_column(a: Column, b: Column) -> Column:
    """``same_form`` in Arrow batches."""
    run = F.pandas_udf(lambda x, y: pd.Series([same_form(p, q) for p, q in zip(x, y)], dtype="bool"), "boolean")
    return run(a, b)


def latex_value_column(text: Column) -> Column:
    """``latex_value`` in Arrow batches; kept from being done again for each use of the column."""
    run = F.pandas_udf(lambda x: pd.Series([latex_value(p) for p in x], dtype="object"), "string")
    return run.asNondeterministic()(text)
