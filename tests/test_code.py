import ast
import random
import time
import warnings

from rankframe.functions.code import longest_code

PARTS = [
    "x = 1", "def f(a):", "    return a", "    # note", "# top", "", "   ", "try:", "    y = 2", "except E:", "    pass", "finally:", "else:", "if x:", "elif y:", "    if z:", "        w()", "@dec", "class C:",
    "    def m(self):", "        return 1", "'''", '"""doc', "f(", "    a,", ")", "x = [", "]", "Here is the code:", "```python", "```", "x = 1 \\", "    1", "for i in range(3): print(i)", "async def g():",
    "    await h()", "match x:", "    case 1:", "        pass", "print('a", "return 5", "  odd", "\tpass", "with a as b:", "    '''s", "s''' + t", "1 = 2", "from a import (b,", "    c)", "x = {'a': 1,", "'b': 2}",
    "try: x", "except: y", "f'{x", "print(a b)", "}", "x = (1,", "\f", "x=1;", "*a, = b", "assert x, (", "'m')",
]


def plain(text):
    """Every range of lines parsed."""
    lines, best, pair = text.split("\n"), 0, (0, 0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                try:
                    ast.parse("\n".join(lines[i : j + 1]))
                except (SyntaxError, ValueError):
                    continue
                n = sum(1 for line in lines[i : j + 1] if line.strip())
                if n > best:
                    best, pair = n, (i, j)
    return "\n".join(lines[pair[0] : pair[1] + 1])


def test_same_as_parsing_every_range():
    rng = random.Random(3)
    for _ in range(400):
        text = "\n".join(rng.choices(PARTS, k=rng.randrange(0, 22)))
        assert longest_code(text) == plain(text), repr(text)


def test_long_answers():
    body = "\n".join(f"def f{i}(a):\n    '''doc {i}'''\n    if a > {i}:\n        return a + {i}\n    return f{max(0, i - 1)}(a)\n" for i in range(830))
    prose = "\n".join(f"This is line {i} of some prose, not code." for i in range(2000))
    names = "\n".join(f"    x{i} = {i}" for i in range(5000))
    start = time.time()
    assert longest_code(f"{prose}\n{body}\n{prose}") == body.rstrip("\n")
    assert longest_code(f"{body}\n)\n{body}\nx = 1\n)\n{body}") == body + "\nx = 1"
    assert longest_code(f"try:\n{names}") == "try:" and longest_code("if x:\n" + "# c\n" * 5000 + "y") == "# c\n" * 4999 + "# c\ny"
    assert longest_code("'''\n" + "word\n" * 5000) == "word\n" * 4999 + "word"
    assert time.time() - start < 10  # some 35,000 lines
