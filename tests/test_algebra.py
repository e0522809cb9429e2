import pytest

from rankframe.functions.algebra import NoForm, latex_value, latex_value_column, parse, same_form, same_form_column

SAME = [
    ("1/2", "0.5"), ("2x + 3x", "5x"), ("(a+b)^2", "a^2 + 2ab + b^2"), ("(x^2-1)/(x-1)", "x + 1"), (r"\frac{1}{2}", "1/2"), (r"\frac12", "0.5"), (r"\sqrt{8}", "2*sqrt(2)"), ("sqrt(6)", "sqrt(2)*sqrt(3)"),
    ("1/sqrt(2)", "sqrt(2)/2"), ("1/(1+sqrt(2))", "sqrt(2)-1"), (r"\sqrt[3]{27}", "3"), ("x**2", "x^2"), ("2^(n+1)", "2*2^n"), ("4^n", "2^(2n)"), ("5!", "120"), ("n!/n!", "1"), ("C(5,2)", "10"), (r"\binom{5}{2}", "10"),
    ("C(n,k)", r"\binom{n}{k}"), ("-(x-y)", "y - x"), ("sin(x)^2", "sin(x) sin(x)"), ("x^-1", "1/x"), ("x^{1/2} x^{1/2}", "x"), ("1/a + 1/b", "(a+b)/(a b)"), ("pi/2", r"\frac{\pi}{2}"), ("3 \\cdot 4", "12"), ("2\\times x", "x*2"),
    ("n(n+1)/2", "(n^2+n)/2"), ("2^{10}", "1024"), ("e^{x+1}", "e e^x"), ("xy", "y x"), ("(-2)^3", "-8"), ("x/(y/z)", "x z/y"), ("\\left(1+x\\right)", "x+1"), ("2^100", "2^50*2^50"), ("0^2", "0"), ("-2^2", "-4"),
]
APART = [("x", "y"), ("1/3", "0.333"), ("(a+b)^2", "a^2+b^2"), ("2^n", "n^2"), ("sqrt(2)", "1.41421356"), ("sin(x)", "cos(x)"), ("n!", "n"), ("x+", "x"), ("", ""), ("1/0", "1/0"), ("a,b", "a,b"), ("(x", "x"), ("{x)", "x"), ("2^n + 1", "2^(n+1)")]


@pytest.mark.parametrize("a, b", SAME)
def test_equal_forms(a, b):
    assert same_form(a, b) and same_form(b, a)


@pytest.mark.parametrize("a, b", APART)
def test_other_forms(a, b):
    assert not same_form(a, b)


def test_against_values():
    """Random expressions: equal where their values at random points are, and only there."""
    import random

    rng = random.Random(7)

    def made(depth):
        if depth == 0:
            return rng.choice(["x", "y", "2", "3", "1/2", "(x+1)"])
        a, b = made(depth - 1), made(rng.randrange(depth))
        return rng.choice([f"({a}) + ({b})", f"({a}) * ({b})", f"({a}) - ({b})", f"({a})^2", f"({a})/({b})"])

    values = lambda t: [eval(t.replace("^", "**"), {"x": x, "y": y}) for x, y in ((1.37, 2.91), (0.53, 1.71))]  # noqa: E731, S307  (made above)
    n = 0
    for _ in range(300):
        a, b = made(2), made(2)
        for c in (b, f"({a}) * 2 - ({a})", f"(({a}) * ({b})) / ({b})"):
            try:
                v, w = values(a), values(c)
                parse(a), parse(c)
            except (ZeroDivisionError, NoForm):
                continue
            close = all(abs(p - q) <= 1e-9 * max(1, abs(p)) for p, q in zip(v, w))
            assert same_form(a, c) == close, (a, c)
            n += close
    assert n > 400


def test_values_of_numbers():
    want = {
        r"\frac{1}{2}": "0.5", "3/4": "0.75", "42": "42", "-3": "-3", "1.0": "1.0", "3.50": "3.5", r"\frac{6}{3}": "2", "2^{10}": "1024", r"2 \times 3.5": "7.0", r"\sqrt{16}": "4", r"\sqrt{2}": None, "5 m": None, "x": None,
        "": None, None: None, "1,000": None, "(1, 2)": None, "007": "7", r"\frac{1}{0}": None, "10^{-3}": "0.001", "0.1+0.2": "0.3", "(" * 5000: None, "9^9^9^9": None, "2^300": str(2**300), "10^{400}": None,
    }
    assert {t: latex_value(t) for t in want} == want


def test_columns(spark):
    rows = [("1/2", "0.5"), (None, "1"), ("x", "y"), (r"\frac{3}{4}", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", same_form_column(df.a, df.b).alias("s"), latex_value_column(df.a).alias("v")).collect()
    assert [(r.s, r.v) for r in got] == [(True, "0.5"), (False, None), (False, None), (False, "0.75")]
