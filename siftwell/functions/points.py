"""Decoding of 2-D points from free model output, and tests of points against masks and boxes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Points written as attributes or calls, with the scale of their numbers, and keys of points in records.
ATTRIBUTE_PATTERNS = (
    (r"Click\(([0-9]+\.[0-9]), ?([0-9]+\.[0-9])\)", 1.0),
    (r"\(([0-9]+\.[0-9]),? ?([0-9]+\.[0-9])\)", 1.0),
    (r'x\d*="\s*([0-9]+(?:\.[0-9]+)?)"\s+y\d*="\s*([0-9]+(?:\.[0-9]+)?)"', 1.0),
    (r"(?:\d+|p)\s*=\s*([0-9]{3})\s*,\s*([0-9]{3})", 10.0),
)
POINT_KEYS = ("point_2d", "points", "point", "coordinates")

Points = list[list[float]]
#: Marks of a scan: fence, tag, quoted text, number, word, bracket or sign; anything else is stray.
MARK = re.compile(r"""(?P<fence>```(?:json|python|html)?)|(?P<tag></?points?>)|(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+\.?\d*)|(?P<word>[^\W\d]+)|(?P<sign>[\[\](){}:,])|(?P<stray>\S)""", re.I)


@dataclass
class _Open:
    """A bracket that is not closed yet: its numbers, how many other things it holds, and the points inside, by key in a record."""

    kind: str = ""
    numbers: list[float] = field(default_factory=list)
    others: int = 0
    points: Points = field(default_factory=list)
    keyed: dict[str, Points] = field(default_factory=dict)
    key: str | None = None

    def add(self, points: Points) -> None:
        self.others += 1
        if self.key in POINT_KEYS and self.kind == "{":
            self.keyed[self.key] = points
        elif self.kind != "{":
            self.points += points

    def value(self) -> Points:
        """Its points when it is read as a value: a pair of numbers is one, a record counts by its first point key."""
        if self.kind == "{":
            return next((self.keyed[k] for k in POINT_KEYS if k in self.keyed), [])
        return [self.numbers] if len(self.numbers) == 2 and not self.others else self.points


class Scan:
    """One pass over a text's marks.

    It notes every pair of numbers that fills a bracket (``bracketed``), every two numbers with
    a comma between them (``bare``), and the points of the text read as one written value
    (``value``), which counts only if nothing stands beside it but a leading label.
    """

    def __init__(self, text: str):
        self.bracketed: Points = []
        self.bare: Points = []
        self.top = _Open()
        self.stack = [self.top]
        self.broken = text.count("```") % 2 == 1
        self.values = 0
        last: tuple[str, ...] = ("", "")  # the two marks before, for bare pairs
        for m in MARK.finditer(text):
            kind, word = m.lastgroup, m[0]
            if kind in ("fence", "tag"):
                continue
            self._mark(kind, word)
            if kind == "number" and last[1] == "," and last[0]:
                self.bare.append([float(last[0]), float(word)])
                word = ""
            last = (last[1] if word == "," else "", word if kind == "number" or word == "," else "")
        self.value = [] if self.broken or len(self.stack) > 1 or self.values > 1 else self.top.points

    def _mark(self, kind: str, word: str) -> None:
        inner = self.stack[-1]
        if kind == "number":
            inner.numbers.append(float(word))
            if inner is self.top:
                self.values += 1
        elif kind in ("quoted", "word"):
            inner.others += 1
            if kind == "quoted" and inner.kind == "{":
                inner.key = word[1:-1] if inner.key is None else inner.key
            if inner is self.top:
                self.values += kind == "quoted"
                self.broken |= kind == "word" and self.values > 0
        elif word in "[({":
            self.stack.append(_Open(word))
        elif word in "])}":
            self._close(inner)
        elif word == ":" and inner is self.top and not self.values | self.broken | len(inner.numbers):
            inner.others = 0  # a label before the value
        elif word == "," and inner.kind == "{":
            inner.key = None
        elif kind == "stray" or (word == ":" and inner.kind != "{"):
            inner.others += 1
            self.broken = True

    def _close(self, done: _Open) -> None:
        if done is self.top:
            self.broken = True
            return
        self.stack.pop()
        if done.kind != "{" and len(done.numbers) == 2 and not done.others:
            self.bracketed.append(done.numbers)
        self.values += self.stack[-1] is self.top
        if self.stack[-1] is self.top and self.top.others:
            self.broken = True
        self.stack[-1].add(done.value())
        if self.stack[-1] is self.top:
            self.top.others = 0


def written_points(text: str) -> Points:
    """Points of a text: those of the value that it writes, else its bracketed pairs, else its bare pairs.

    Where a point tag is closed, only what the first such tag holds is read.
    """
    opened = re.search(r"(?is)<points?>(.*?)</points?>", text)
    scan = Scan(opened[1] if opened else text)
    return scan.value or scan.bracketed or scan.bare


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _scanned(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: written_points(t) if isinstance(t, str) else [])


def _over(scale: float):
    return lambda v: v.cast("double") / scale


def attribute_points(text: Column) -> Column:
    """Points in the attributes of tags and in calls, as column expressions."""
    found = []
    for pattern, scale in ATTRIBUTE_PATTERNS:
        x, y = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
        scaled = [F.transform(v, _over(scale)) for v in (x, y)]
        found.append(F.zip_with(*scaled, lambda a, b: F.array(a, b)))
    return F.when(F.lower(text).contains("<point"), F.concat(*found))


def decode_points(text: str | Column) -> Column:
    """The points of a reply: those in attributes, else those written in it; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    marked = attribute_points(text)
    found = F.coalesce(F.size(marked) > 0, F.lit(False))
    return F.when(found, marked).otherwise(_scanned(F.when(~found, text)))


def to_pixel(p: Column, width: Column, height: Column) -> Column:
    """A point on the 0 to 1000 scale as clamped pixel coordinates."""
    at = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, F.bround(v / 1000 * (n - 1)).cast("int")))
    return F.array(at(p[0], width), at(p[1], height))


def count_in_box(points: Column, box: Column) -> Column:
    """struct(inside, total); coordinates are rounded half to even."""
    inside = F.filter(points, lambda p: F.bround(p[0]).between(box[0], box[2]) & F.bround(p[1]).between(box[1], box[3]))
    return F.struct(F.size(inside).alias("inside"), F.size(points).alias("total"))


@F.pandas_udf(T.StructType([T.StructField("inside", T.IntegerType()), T.StructField("total", T.IntegerType())]))
def count_in_mask(points: pd.Series, mask: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Points on a mask given as bytes in row order; rounded half to even, outside ones don't count."""
    rows = []
    for ps, m, w in zip(points, mask, width, strict=True):
        if ps is None or m is None or not len(ps):
            rows.append((0, 0))
            continue
        grid = np.frombuffer(m, np.uint8).reshape(-1, int(w))
        xy = np.rint(np.array([list(p) for p in ps], float)).astype(int)
        ok = (xy[:, 0] >= 0) & (xy[:, 0] < grid.shape[1]) & (xy[:, 1] >= 0) & (xy[:, 1] < grid.shape[0])
        rows.append((int((grid[xy[ok, 1], xy[ok, 0]] > 0).sum()), len(xy)))
    return pd.DataFrame(rows, columns=["inside", "total"])


@F.pandas_udf(T.StructType([T.StructField("covered", T.IntegerType()), T.StructField("total", T.IntegerType())]))
def masks_covered(points: pd.Series, masks: pd.Series, width: pd.Series) -> pd.DataFrame:
    """How many of a row's masks hold at least one point."""
    rows = []
    for ps, ms, w in zip(points, masks, width, strict=True):
        ps, ms = [] if ps is None else [list(p) for p in ps], [] if ms is None else list(ms)
        hit = 0
        for m in ms:
            grid = np.frombuffer(m, np.uint8).reshape(-1, int(w))
            hit += any(0 <= round(x) < grid.shape[1] and 0 <= round(y) < grid.shape[0] and grid[round(y), round(x)] > 0 for x, y in ps)
        rows.append((hit, len(ms)))
    return pd.DataFrame(rows, columns=["covered", "total"])
