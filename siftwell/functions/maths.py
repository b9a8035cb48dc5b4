r"""Equivalence of mathematical answers written in plain or LaTeX notation.

``same_answer(truth, answer)`` reads both sides and compares their canonical forms:

* an expression is a quotient of two polynomials with rational coefficients.  Its unknowns are
  letters, constants, roots and function values of canonical arguments; powers of a root
  and of the imaginary unit fold.  Two quotients are equal if their cross products are.
* a set or a list of solutions is unordered, a tuple ordered, an interval has two ends that are
  open or closed, a union is an unordered list of those;
* an equation equals another one if the differences of their sides are multiples of each other; ``x = 5`` also
  equals ``5``.

Where expanding would take too many terms, both sides are evaluated at fixed points of a prime field
instead.  If a side has a decimal point, numbers are also compared after rounding to
six places.  What can't be read is compared as text.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from hashlib import blake2b

# Names of the notation.
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "exp")
CONSTANTS = {"\\pi": "pi", "π": "pi", "pi": "pi", "\\infty": "oo", "∞": "oo", "infty": "oo", "inf": "oo"}
DROPPED = ("\\left", "\\right", "\\displaystyle", "\\,", "\\;", "\\!", "\\:", "\\ ", "\\quad", "$", "^\\circ", "^{\\circ}", "°", "\\$", "\\limits", "\\bigl", "\\bigr", "\\big", "\\Big")
SAME = {"\\cdot": "*", "\\times": "*", "×": "*", "·": "*", "\\div": "/", "÷": "/", "**": "^", "−": "-", "–": "-", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\lbrace": "\\{", "\\rbrace": "\\}", "\\neq": "≠", "\\ne": "≠", "\\leq": "≤", "\\le": "≤", "\\geq": "≥", "\\ge": "≥", "<=": "≤", ">=": "≥", "\\lt": "<", "\\gt": ">", "∪": "\\cup", "\\%": "%", "√": "\\sqrt", "±": "\\pm"}
TOKEN = re.compile(r"\s*(\d+\.\d+|\.\d+|\d+|\\[{}|]|\\[a-zA-Z]+|[a-zA-Zα-ω]|≠|≤|≥|[-+*/^_(){}\[\]|,;=<>%!∞π])")
COMPARISONS = "=≠≤≥<>"
PRIME = (1 << 61) - 1
#: Terms beyond which polynomials are not expanded, and the points at which they are compared then.
MOST_TERMS, POINTS = 600, 4

Poly = dict  # monomial (sorted tuple of (unknown, power)) -> Fraction
Quotient = tuple  # (Poly, Poly)


class Unreadable(ValueError):
    """The text is not in the notation that is understood."""


class TooLarge(ValueError):
    """Expanding takes too many terms."""


# ---- notation ------------------------------------------------------------------------------


def _boxed(text: str) -> str:
    """The content of the last box, if there is one."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return text
    depth = 0
    for i in range(at + 6, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[at + 7 : i]
    return text


def _plain(text: str) -> str:
    text = _boxed(text).strip().rstrip(".").strip()
    text = re.sub(r"\\(?:text|mathrm|mbox|textbf|mathbf|operatorname)\s*\{([^{}]*)\}", lambda m: f" \\{m[1]} " if m[1] in FUNCTIONS else " ", text)
    for old in sorted(SAME, key=len, reverse=True):
        text = re.sub(re.escape(old) + (r"(?![a-zA-Z])" if old[-1].isalpha() else ""), lambda m, new=SAME[old]: new + " " if new[-1].isalpha() else new, text)
    for old in sorted(DROPPED, key=len, reverse=True):
        text = re.sub(re.escape(old) + (r"(?![a-zA-Z])" if old[-1].isalpha() else ""), " ", text)
    if re.search(r"[\[\](){}]", text):  # inside brackets a comma parts values
        return text
    return re.sub(r"(?<![\d,.])(\d{1,3}(?:,\d{3})+)(?![\d,])", lambda m: m[1].replace(",", ""), text)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = _plain(text)
    for word in (*FUNCTIONS, "sqrt", "pi", "infty", "inf"):
        text = re.sub(rf"(?<![\\a-zA-Z]){word}(?![a-zA-Z])", rf"\\{word} ", text)
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Unreadable(text[at:])
        out.append(m[1])
        at = m.end()
    return out


class Reader:
    """Reads tokens by precedence: comparisons, sums, products (written or not), signs, powers, atoms."""

    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]
        self.decimal = False

    def peek(self) -> str:
        return self.rest[-1] if self.rest else ""

    def take(self, want: str | None = None) -> str:
        if not self.rest or (want is not None and self.rest[-1] != want):
            raise Unreadable(want or "end")
        return self.rest.pop()

    def whole(self) -> tuple:
        parts = [self.relation()]
        while self.peek() and self.peek() in ",;":
            self.take()
            parts.append(self.relation())
        if self.rest:
            raise Unreadable(self.peek())
        return parts[0] if len(parts) == 1 else ("set", *parts)

    def relation(self) -> tuple:
        left = self.union()
        if self.peek() and self.peek() in COMPARISONS:
            sign = self.take()
            right = self.union()
            if sign in "=" and self.peek() == "=":  # a chain of equal values counts by its last
                while self.peek() == "=":
                    self.take()
                    right = self.union()
            return ("relation", sign, left, right)
        if self.peek() == "\\in":
            self.take()
            return self.union()
        return left

    def union(self) -> tuple:
        parts = [self.sum()]
        while self.peek() == "\\cup":
            self.take()
            parts.append(self.sum())
        return parts[0] if len(parts) == 1 else ("union", *parts)

    def sum(self) -> tuple:
        left = self.product()
        while self.peek() in ("+", "-", "\\pm"):
            sign = self.take()
            left = ({"+": "add", "-": "sub", "\\pm": "pm"}[sign], left, self.product())
        return left

    def product(self) -> tuple:
        left = self.signed()
        while True:
            if self.peek() in ("*", "/"):
                left = ({"*": "mul", "/": "div"}[self.take()], left, self.signed())
            elif self.peek() and (self.peek()[0].isalnum() or self.peek() in ("(", "\\{", "\\frac", "\\sqrt", "\\pi", "π", "∞", "\\infty") or self.peek()[1:] in FUNCTIONS or self.peek()[0] in "παβγθλμφωδ"):
                mixed = self.peek() == "\\frac" and left[0] == "number" and left[1].denominator == 1
                right = self.power()
                left = ("add" if mixed and right[0] == "div" and right[1][0] == right[2][0] == "number" else "mul", left, right)
            else:
                return left

    def bare(self) -> tuple:
        """The argument of a function without brackets: numbers, letters and fractions side by side."""
        out = self.signed()
        while self.peek() and (self.peek()[0].isalnum() or self.peek() in ("\\frac", "\\sqrt", "\\pi", "π")):
            out = ("mul", out, self.power())
        return out

    def signed(self) -> tuple:
        if self.peek() in ("+", "-", "\\pm"):
            sign = self.take()
            inner = self.signed()
            return {"+": inner, "-": ("sub", ("number", Fraction(0)), inner), "\\pm": ("pm", ("number", Fraction(0)), inner)}[sign]
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        while self.peek() in ("^", "!", "%"):
            sign = self.take()
            if sign == "^":
                exponent = self.group() if self.peek() == "{" else self.signed_atom()
                base = ("pow", base, exponent)
            elif sign == "!":
                base = ("call", "factorial", base)
            else:
                base = ("percent", base)
        return base

    def signed_atom(self) -> tuple:
        if self.peek() == "-":
            self.take()
            return ("sub", ("number", Fraction(0)), self.power())
        return self.power()

    def group(self) -> tuple:
        self.take("{")
        inner = self.sum()
        self.take("}")
        return inner

    def argument(self) -> tuple:
        """What follows a command: a group, or one digit or letter."""
        if self.peek() == "{":
            return self.group()
        if re.fullmatch(r"\d\d+", self.peek()):
            digits = self.take()
            self.rest.append(digits[1:])
            return ("number", Fraction(int(digits[0])))
        return self.atom()

    def atom(self) -> tuple:
        t = self.take()
        if re.fullmatch(r"\d*\.?\d+", t):
            self.decimal |= "." in t
            return ("number", Fraction(t if t[0] != "." else f"0{t}"))
        if t in CONSTANTS or t[1:] in CONSTANTS:
            return ("constant", CONSTANTS.get(t) or CONSTANTS[t[1:]])
        if t == "\\frac":
            return ("div", self.argument(), self.argument())
        if t == "\\sqrt":
            index = ("number", Fraction(2))
            if self.peek() == "[":
                self.take()
                index = self.sum()
                self.take("]")
            inner = self.argument()
            return ("pow", inner, ("div", ("number", Fraction(1)), index))
        if t[1:] in FUNCTIONS:
            return self.call(t[1:])
        if t in ("(", "[", "\\{", "{"):
            return self.bracket(t)
        if t in ("|", "\\|"):
            inner = self.sum()
            self.take(t)
            return ("call", "abs", inner)
        if t[0].isalpha() or (t[0] == "\\" and t[1:].isalpha() and t not in ("\\cup", "\\in", "\\pm")):
            if self.peek() == "_":
                self.take()
                sub = self.group() if self.peek() == "{" else self.atom()
                return ("symbol", f"{t}_{sub[1]}")
            return ("constant", "i") if t == "i" else ("constant", "e") if t == "e" else ("symbol", t)
        raise Unreadable(t)

    def call(self, name: str) -> tuple:
        power = base = None
        while self.peek() in ("^", "_"):
            mark = self.take()
            given = self.argument()
            power, base = (given, base) if mark == "^" else (power, given)
        inner = self.group() if self.peek() == "{" else self.power() if self.peek() == "(" else self.bare()
        if name == "exp":
            made = ("pow", ("constant", "e"), inner)
        elif name == "log":
            made = ("div", ("call", "ln", inner), ("call", "ln", base or ("number", Fraction(10))))
        else:
            made = ("call", name, inner)
        return made if power is None else ("pow", made, power)

    def bracket(self, opened: str) -> tuple:
        parts = [self.relation()]
        while self.peek() and self.peek() in ",;":
            self.take()
            parts.append(self.relation())
        closed = self.take()
        if opened in ("\\{", "{"):
            if closed not in ("\\}", "}"):
                raise Unreadable(closed)
            return parts[0] if opened == "{" and len(parts) == 1 else ("set", *parts)
        if closed not in (")", "]"):
            raise Unreadable(closed)
        if len(parts) == 1:
            return parts[0]
        if opened + closed == "()" and not (len(parts) == 2 and any(_infinite(p) for p in parts)):
            return ("tuple", *parts)
        if len(parts) != 2:
            raise Unreadable(closed)
        return ("interval", opened, closed, *parts)


def _infinite(node: tuple) -> bool:
    return node == ("constant", "oo") or (node[0] == "sub" and node[2] == ("constant", "oo"))


# ---- quotients of polynomials --------------------------------------------------------------


def _const(x: Fraction | int) -> Poly:
    return {(): Fraction(x)} if x else {}


ONE: Poly = {(): Fraction(1)}


def _plus(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        if v := out.get(m, 0) + sign * c:
            out[m] = v
        else:
            out.pop(m, None)
    return out


def _folded(powers: dict) -> tuple[tuple, Fraction]:
    """A monomial and the factor that its roots and imaginary units leave."""
    factor = Fraction(1)
    for name in list(powers):
        if name == "i":
            turns = powers[name] % 4
            factor *= -1 if turns in (2, 3) else 1
            powers[name] = turns % 2
        elif isinstance(name, tuple) and name[0] == "root" and isinstance(name[2], int) and powers[name] >= name[1]:
            factor *= Fraction(name[2]) ** (powers[name] // name[1])
            powers[name] %= name[1]
    return tuple(sorted(((k, v) for k, v in powers.items() if v), key=repr)), factor


def _times(a: Poly, b: Poly) -> Poly:
    if len(a) * len(b) > MOST_TERMS * 4:
        raise TooLarge
    out: Poly = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for k, v in n:
                powers[k] = powers.get(k, 0) + v
            key, factor = _folded(powers)
            out[key] = out.get(key, 0) + c * d * factor
    out = {m: c for m, c in out.items() if c}
    if len(out) > MOST_TERMS:
        raise TooLarge
    return out


def _number(q: Quotient) -> Fraction | None:
    num, den = q
    if all(m == () for m in num) and set(den) == {()}:
        return num.get((), Fraction(0)) / den[()]
    return None


def _named(q: Quotient) -> tuple:
    """A text-like key of a quotient, the same for equal ones whose denominators are numbers."""
    num, den = q
    lead = den[max(den, key=repr)]
    show = lambda p: tuple(sorted(((repr(m), c / lead) for m, c in p.items())))
    return show(num), show(den)


def _unknown(name) -> Quotient:
    return {((name, 1),): Fraction(1)}, ONE


def _root(value: Fraction, n: int) -> Quotient:
    """The n-th root of a number: the largest power taken out, the rest an unknown with value ** (1/n)."""
    if value < 0:
        inner = _root(-value, n)
        return _mul(inner, _unknown("i")) if n == 2 else (_plus({}, inner[0], -1), inner[1]) if n % 2 else _unknown(("power", value, n))
    whole, outside, inside = value.numerator * value.denominator ** (n - 1), 1, 1
    d = 2
    while d * d <= whole and d < 10_000:
        k = 0
        while whole % d == 0:
            whole //= d
            k += 1
        outside *= d ** (k // n)
        inside *= d ** (k % n)
        d += 1
    exact = round(whole ** (1 / n)) if whole < 1 << 52 else 0
    if exact and exact**n == whole:
        outside, whole = outside * exact, 1
    inside *= whole
    rest = _unknown(("root", n, inside)) if inside > 1 else (ONE, ONE)
    return _mul((_const(Fraction(outside, value.denominator)), ONE), rest)


def _mul(a: Quotient, b: Quotient) -> Quotient:
    return _times(a[0], b[0]), _times(a[1], b[1])


def _rooted(base: Quotient, n: int) -> Quotient | None:
    """The n-th root of a quotient of single terms: letters take broken powers; even powers under an even root stay."""
    (num, den), whole = base, []
    if len(num) != 1 or len(den) != 1:
        return None
    for m in (*num, *den):
        if any(not isinstance(name, str) or name == "i" or (n % 2 == 0 and k % 2 == 0) for name, k in m):
            return None
        whole.append(tuple((name, k / Fraction(n)) for name, k in m))
    (c,), (d,) = num.values(), den.values()
    return _mul(_root(c / d, n), ({whole[0]: Fraction(1)}, {whole[1]: Fraction(1)}))


def _logarithm(value: Fraction) -> Quotient:
    """The natural logarithm of a positive number as a sum over its prime factors."""
    out, sign = {}, 1
    for part in (value.numerator, value.denominator):
        d = 2
        while part > 1:
            d = part if d * d > part or d > 10_000 else d
            k = 0
            while part % d == 0:
                part //= d
                k += 1
            if k:
                out = _plus(out, {((("ln", d), 1),): Fraction(sign * k)})
            d += 1
        sign = -1
    return out, ONE


def _pow(base: Quotient, exponent: Quotient) -> Quotient:
    e, b = _number(exponent), _number(base)
    if e is None:
        return _unknown(("power", _named(base), _named(exponent)))
    if e < 0:
        if not base[0]:
            raise Unreadable("division by zero")
        base, e = (base[1], base[0]), -e
        b = _number(base)
    if e.denominator > 1:
        if b is not None:
            return _pow(_root(b, e.denominator), (_const(e.numerator), ONE))
        if (plain := _rooted(base, e.denominator)) is not None:
            return _pow(plain, (_const(e.numerator), ONE))
        rooted = _unknown(("root", e.denominator, _named(base)))
        whole = _pow(base, (_const(e.numerator // e.denominator), ONE))
        return _mul(whole, _pow(rooted, (_const(e.numerator % e.denominator), ONE)))
    if e > 4096:
        raise TooLarge
    out = (ONE, ONE)
    for bit in bin(int(e))[2:]:
        out = _mul(out, out)
        out = _mul(out, base) if bit == "1" else out
    return out


def quotient(node: tuple) -> Quotient:
    """The canonical form of an expression."""
    match node:
        case ("number", x):
            return _const(x), ONE
        case ("constant" | "symbol", name):
            return _unknown(name)
        case ("percent", x):
            n, d = quotient(x)
            return n, _times(d, _const(100))
        case ("add" | "sub" as what, a, b):
            (n, d), (m, e) = quotient(a), quotient(b)
            sign = 1 if what == "add" else -1
            return (_plus(n, m, sign), d) if d == e else (_plus(_times(n, e), _times(m, d), sign), _times(d, e))
        case ("mul", a, b):
            return _mul(quotient(a), quotient(b))
        case ("div", a, b):
            over = quotient(b)
            if not over[0]:
                raise Unreadable("division by zero")
            return _mul(quotient(a), (over[1], over[0]))
        case ("pow", a, b):
            return _pow(quotient(a), quotient(b))
        case ("call", name, a):
            inner = quotient(a)
            x = _number(inner)
            if name == "abs" and x is not None:
                return _const(abs(x)), ONE
            if name == "factorial" and x is not None and x.denominator == 1 and 0 <= x <= 200:
                return _const(math.factorial(int(x))), ONE
            if x == 0 and name in ("sin", "tan", "arcsin", "arctan", "sinh", "tanh"):
                return {}, ONE
            if (x == 0 and name in ("cos", "cosh")) or inner == _unknown("e") and name == "ln":
                return ONE, ONE
            if name == "ln" and x is not None and x > 0:
                return _logarithm(x)
            return _unknown((name, _named(inner)))
    raise Unreadable(node[0])


def _field(node: tuple, point: int) -> int:
    """Value in the prime field, unknowns at fixed places; what is no rational operation is an unknown of its own."""
    place = lambda name: int.from_bytes(blake2b(f"{point}:{name}".encode(), digest_size=8).digest(), "little") % PRIME
    match node:
        case ("number", x):
            return x.numerator * pow(x.denominator, -1, PRIME) % PRIME
        case ("constant" | "symbol", name):
            return place(name)
        case ("percent", x):
            return _field(x, point) * pow(100, -1, PRIME) % PRIME
        case ("add", a, b):
            return (_field(a, point) + _field(b, point)) % PRIME
        case ("sub", a, b):
            return (_field(a, point) - _field(b, point)) % PRIME
        case ("mul", a, b):
            return _field(a, point) * _field(b, point) % PRIME
        case ("div", a, b):
            return _field(a, point) * pow(_field(b, point), -1, PRIME) % PRIME
        case ("pow", a, b):
            e = _number(quotient(b))
            if e is not None and e.denominator == 1:
                return pow(_field(a, point), int(e), PRIME)
            return place(("power", _field(a, point), _field(b, point)))
        case ("call", name, a):
            return place((name, _field(a, point)))
    raise Unreadable(node[0])


def _float(node: tuple) -> float:
    """Value as a double, without unknowns."""
    known = {"pi": math.pi, "e": math.e, "oo": math.inf}
    match node:
        case ("number", x):
            return float(x)
        case ("constant", name) if name in known:
            return known[name]
        case ("percent", x):
            return _float(x) / 100
        case ("add", a, b):
            return _float(a) + _float(b)
        case ("sub", a, b):
            return _float(a) - _float(b)
        case ("mul", a, b):
            return _float(a) * _float(b)
        case ("div", a, b):
            return _float(a) / _float(b)
        case ("pow", a, b):
            return float(_float(a) ** _float(b))
        case ("call", "ln", a):
            return math.log(_float(a))
        case ("call", "abs", a):
            return abs(_float(a))
        case ("call", name, a) if hasattr(math, name.replace("arc", "a")):
            return getattr(math, name.replace("arc", "a"))(_float(a))
    raise Unreadable(node[0])


# ---- comparison ----------------------------------------------------------------------------


def _equal(a: tuple, b: tuple, rounded: bool) -> bool:
    """Whether two expressions have one value."""
    if rounded:
        try:
            x, y = _float(a), _float(b)
            return x == y or round(x, 6) == round(y, 6)
        except (ValueError, ZeroDivisionError, OverflowError, TypeError):
            pass
    try:
        (n, d), (m, e) = quotient(a), quotient(b)
        return _times(n, e) == _times(m, d)
    except TooLarge:
        return all(_field(a, k) == _field(b, k) for k in range(POINTS))


def _expanded(node: tuple) -> list[tuple]:
    """The values that a plus-or-minus sign stands for."""
    if node[0] in ("number", "symbol", "constant"):
        return [node]
    if node[0] in ("call", "percent"):
        return [(*node[:-1], x) for x in _expanded(node[-1])]
    if node[0] == "pm":
        return [(sign, a, b) for sign in ("add", "sub") for a in _expanded(node[1]) for b in _expanded(node[2])]
    return [(node[0], a, b) for a in _expanded(node[1]) for b in _expanded(node[2])]


def _matched(a: list[tuple], b: list[tuple], rounded: bool) -> bool:
    """Whether each member of one list has an equal one in the other."""
    return all(any(_same(x, y, rounded) for y in b) for x in a) and all(any(_same(x, y, rounded) for x in a) for y in b)


_TURNED = {"<": ">", "≤": "≥"}


def _difference(sign: str, left: tuple, right: tuple) -> tuple[str, tuple]:
    return (_TURNED[sign], ("sub", right, left)) if sign in _TURNED else (sign, ("sub", left, right))


def _multiples(a: tuple, b: tuple, positive: bool) -> bool:
    """Whether a is a number (a positive one) times b."""
    (n, d), (m, e) = quotient(a), quotient(b)
    x, y = _times(n, e), _times(m, d)
    if not x or not y:
        return x == y
    k = max(x, key=repr)
    ratio = x[k] / y[k] if k in y else Fraction(0)
    return (ratio > 0 or (ratio < 0 and not positive)) and x == {m: c * ratio for m, c in y.items()}


def _same(a: tuple, b: tuple, rounded: bool) -> bool:
    if a[0] == "relation" and b[0] == "relation":
        (s, x), (t, y) = _difference(*a[1:]), _difference(*b[1:])
        return s == t and _multiples(x, y, s not in "=≠")
    for one, other in ((a, b), (b, a)):
        if one[0] == "relation" and one[1] == "=":
            return one[2][0] in ("symbol", "call", "mul") and _same(one[3], other, rounded)
    kinds = ("set", "union", "tuple", "interval")
    if a[0] in kinds or b[0] in kinds:
        if a[0] == "interval" or b[0] == "interval":
            # (1, 2) is written alike as a pair and as an open interval
            ends = [(x[1] + x[2], list(x[3:])) if x[0] == "interval" else ("()", list(x[1:])) if x[0] == "tuple" else (None, []) for x in (a, b)]
            return ends[0][0] == ends[1][0] is not None and all(_same(x, y, rounded) for x, y in zip(ends[0][1], ends[1][1], strict=True))
        if "tuple" in (a[0], b[0]):
            return a[0] == b[0] and len(a) == len(b) and all(_same(x, y, rounded) for x, y in zip(a[1:], b[1:], strict=True))
        if "union" in (a[0], b[0]):
            return a[0] == b[0] and _matched(list(a[1:]), list(b[1:]), rounded)
        members = [[y for m in (x[1:] if x[0] == "set" else [x]) for y in (_expanded(m) if m[0] not in ("relation", *kinds) else [m])] for x in (a, b)]
        return _matched(members[0], members[1], rounded)
    x, y = _expanded(a), _expanded(b)
    if len(x) > 1 or len(y) > 1:
        return _matched(x, y, rounded)
    if _equal(a, b, rounded):
        return True
    marks = [z[0] == "percent" for z in (a, b)]  # 50 % stands for 50 and for one half
    return marks[0] != marks[1] and _equal(a[1] if marks[0] else a, b[1] if marks[1] else b, rounded)


def _as_text(text: str) -> str:
    return re.sub(r"\s+", "", _boxed(text)).strip("$.").lower()


def same_answer(truth: str | None, answer: str | None) -> bool:
    """Whether two written answers mean the same; nulls equal nothing, unreadable texts only themselves."""
    if truth is None or answer is None:
        return False
    if _as_text(truth) == _as_text(answer):
        return True
    try:
        left, right = Reader(truth), Reader(answer)
        a, b = left.whole(), right.whole()
        return _same(a, b, left.decimal or right.decimal)
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError, IndexError):
        return False

