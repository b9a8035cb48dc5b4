"""Vector and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps)."""
    n = norm(v) + eps
    return F.transform(v, lambda x: x.cast("double") / n)


def unit(v: Column, least: float = 1e-8) -> Column:
    """v / |v|; shorter vectors than ``least`` stay."""
    n = norm(v)
    return F.when(n < least, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.bround(x, digits))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]; invalid boxes and empty unions give 0."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inside = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inside
    valid = (F.size(a) == 4) & (F.size(b) == 4) & (a[2] > a[0]) & (a[3] > a[1]) & (b[2] > b[0]) & (b[3] > b[1])
    return F.when(F.coalesce(valid, F.lit(False)) & (union > 1e-12), inside / union).otherwise(0.0)


def in_box(p: Column, box: Column) -> Column:
    return (p[0] >= box[0]) & (p[0] <= box[2]) & (p[1] >= box[1]) & (p[1] <= box[3])


def in_polygon(p: Column, polygon: Column) -> Column:
    """Ray casting; the closing edge counts, boundary rules: min y < y <= max y, x <= max x, and x <= the crossing."""
    edges = F.transform(polygon, lambda v, i: F.struct(v.alias("a"), F.element_at(polygon, (F.pmod(i + 1, F.size(polygon)) + 1).cast("int")).alias("b")))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        at = (p[1] - ay) * (bx - ax) / F.when(by != ay, by - ay) + ax
        return F.coalesce((p[1] > F.least(ay, by)) & (p[1] <= F.greatest(ay, by)) & (p[0] <= F.greatest(ax, bx)) & (ay != by) & ((ax == bx) | (p[0] <= at)), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ramp(x: Column, perfect: float, zero: float) -> Column:
    """1 below perfect, 0 from zero on, linear between."""
    return F.when(x < perfect, 1.0).when(x < zero, 1 - (x - perfect) / (zero - perfect)).otherwise(0.0)


def nearest_mean(points: Column, truth: Column) -> Column:
    """Mean over points of the distance to the nearest true point; infinite if either is empty."""
    each = F.transform(points, lambda p: F.array_min(F.transform(truth, lambda t: distance(p, t))))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(points) > 0) & (F.size(truth) > 0), total / F.size(points)).otherwise(F.lit(float("inf")))


def resampled(track: Column, n: Column) -> Column:
    """Linear resampling to n points; one point is repeated, n <= 1 leaves the track as it is."""

    def at(i: Column) -> Column:
        place = i * (F.size(track) - 1) / (n - 1)
        low = F.least(F.floor(place).cast("int"), F.size(track) - 2)
        share = place - low
        a, b = F.element_at(track, low + 1), F.element_at(track, low + 2)
        return F.zip_with(a, b, lambda x, y: x + (y - x) * share)

    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(F.size(track) == 1, F.element_at(track, 1)).otherwise(at(i)))
    return F.when(n <= 1, track).otherwise(many)


def round_to_multiple(x: Column, factor: int) -> Column:
    """The nearest multiple, halves to the even one."""
    return (F.bround(x / factor) * factor).cast("long")


def smart_size(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """struct(height, width): multiples of a factor within a pixel budget; sides over 200:1 fail while running."""
    h, w = F.greatest(F.lit(factor), round_to_multiple(height, factor)), F.greatest(F.lit(factor), round_to_multiple(width, factor))
    shrink = F.sqrt(height * width / F.lit(float(most)))
    grow = F.sqrt(F.lit(float(least)) / (height * width))
    down = lambda x: F.greatest(F.lit(factor), (F.floor(x / shrink / factor) * factor).cast("long"))
    up = lambda x: (F.ceil(x * grow / factor) * factor).cast("long")
    hh = F.when(h * w > most, down(height)).when(h * w < least, up(height)).otherwise(h)
    ww = F.when(h * w > most, down(width)).when(h * w < least, up(width)).otherwise(w)
    bad = F.greatest(height, width) / F.least(height, width) > 200
    return F.when(bad, F.raise_error(F.lit("aspect ratio is over 200")).cast("struct<height: bigint, width: bigint>")).otherwise(F.struct(hh.alias("height"), ww.alias("width")))


def pixel_bounds(width: Column, height: Column, least: int, most: int) -> Column:
    """struct(width, height) after shrinking to most and then growing to least pixels, sides truncated."""
    def scaled(w: Column, h: Column, bound: int, when) -> tuple[Column, Column]:
        f = F.sqrt(F.lit(float(bound)) / (w * h))
        return F.when(when(w * h, bound), (w * f).cast("long")).otherwise(w), F.when(when(w * h, bound), (h * f).cast("long")).otherwise(h)

    w, h = scaled(width.cast("long"), height.cast("long"), most, lambda a, b: a > b)
    w, h = scaled(w, h, least, lambda a, b: a < b)
    return F.struct(w.alias("width"), h.alias("height"))


def ceil_div(a: Column, b: Column) -> Column:
    return -F.floor(-a / b)


def cosine_warmup(step: Column, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    """Linear warm-up, then a cosine from 1 down to a least ratio."""
    progress = (step - warmup) / F.greatest(F.lit(1), F.lit(total - warmup))
    wave = F.greatest(F.lit(0.0), F.cos(progress * 3.141592653589793 * cycles * 2) * (1 - least) / 2 + (1 + least) / 2)
    return F.when(step < warmup, least + (1 - least) * step / F.greatest(F.lit(1), F.lit(warmup))).otherwise(wave)


def normal_colour(n: Column) -> Column:
    """A unit normal as colour bytes: (n + 1) * 127.5, clipped and truncated."""
    return F.transform(n, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), ((x + 1) * 127.5).cast("int"))))
