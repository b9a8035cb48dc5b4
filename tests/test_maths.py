"""Equivalence of mathematical answers."""

import random
from fractions import Fraction

import pytest

from siftwell.functions.maths import Reader, quotient, same_answer
from siftwell.operators import scoring as S

EQUAL = [
    ("1/2", "0.5"), (r"\frac{2}{4}", "1/2"), (r"\frac12", "0.5"), ("(x+1)^2", "x^2+2x+1"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"),
    ("x=5", "5"), ("{1,2}", "{2,1}"), (r"\{1,2\}", "2, 1"), ("(1,2)", "(1, 2)"), ("[0,1)", r"\left[0,1\right)"), (r"(-\infty,3]\cup[5,\infty)", r"[5,\infty) \cup (-\infty,3]"),
    ("1,000", "1000"), ("50%", "0.5"), ("50", "50\\%"), (r"2\pi r", "2 r \\pi"), (r"\pm 2", "-2, 2"), ("y=2x+1", "2x - y + 1 = 0"), ("x<3", "3>x"), (r"$\boxed{\frac{3}{2}}$", "1.5"),
    (r"3\frac{1}{2}", "3.5"), ("0.333333", "1/3"), ("(x+1)^{500}", "(1+x)^{500}"), ("(x+y)^{60}*(x-y)^{60}", "(x^2-y^2)^{60}"), ("i^2", "-1"), (r"\sin^2 x", r"(\sin(x))^2"),
    ("e^{x}", r"\exp(x)"), (r"\log_2 8", r"\ln 8/\ln 2"), (r"\log 100", "2"), ("5!", "120"), ("|{-3}|", "3"), ("x_1+x_2", "x_2+x_1"), (r"12 \text{ cm}", "12"), (r"90^\circ", "90"), ("2^{-1}", "1/2"),
    (r"\sqrt[3]{16}", r"2\sqrt[3]{2}"), ("cats", "Cats"), (r"\frac{x^2-1}{x-1}", "x+1"), ("a/b/c", "a/(b c)"), ("2x^2y", "2 y x^2"), (r"-\frac{1}{2}", "-.5"), ("3.14", "3.140"), (r"\sqrt{x}\sqrt{x}", "x"),
]
DIFFERENT = [
    ("1/2", "1/3"), ("(1,2)", "(2,1)"), ("[0,1]", "[0,1)"), ("{1,2}", "{1,3}"), ("x+1", "x-1"), ("3.14", r"\pi"), ("x<3", "x>3"), ("dogs", "cats"), ("5", None), ("", "3"), ("1/0", "5"),
    ("x=5", "y"), ("0.33", "1/3"), ("(x+1)^{500}", "(1+x)^{499}"), ("sqrt(2)", "1.41"), ("2", "3"), ("a,b", "a"), (r"\frac{1}{2", "0.5"), (r"\sqrt{x^2}", "x"), ("(" * 5000, "1"),
]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert same_answer(a, b) and same_answer(b, a)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert not same_answer(a, b) and not same_answer(b, a)


def test_random_expressions_have_their_value():
    """Whole expressions without unknowns reduce to what exact fractions give."""
    rng = random.Random(5)

    def make(depth):
        if not depth:
            n = rng.randint(1, 9)
            return str(n), Fraction(n)
        (s, x), (t, y) = make(depth - 1), make(depth - 1)
        op = rng.choice("+-*/")
        if op == "/" and not y:
            op = "+"
        text = rf"\\frac{{{s}}}{{{t}}}".replace("\\\\", "\\") if op == "/" and rng.random() < 0.5 else f"({s}){op}({t})"
        return text, {"+": x + y, "-": x - y, "*": x * y}.get(op) if op != "/" else x / y

    for _ in range(200):
        text, value = make(4)
        num, den = quotient(Reader(text).whole())
        assert Fraction(num.get((), 0)) / den[()] == value, text


def test_pairs_are_judged_once(spark):
    rows = [(i, "1/2", "0.5") for i in range(50)] + [(50, "1/2", None), (51, None, None), (52, "x", "y")]
    df = spark.createDataFrame(rows, "i int, t string, a string")
    got = {r.i: r.same for r in S.same_answers(df, "t", "a").collect()}
    assert len(got) == 53 and all(got[i] for i in range(50)) and not any(got[i] for i in (50, 51, 52))
    assert S.same_answers(df.limit(0), "t", "a").count() == 0
