"""Arithmetic around images and videos: frames, sizes, positions, message layouts.  Pixels stay outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_count(total: Column, video_fps: Column, fps: float = 2.0, least: int = 4, most: int = 768, factor: int = 2) -> Column:
    """Frames to sample: seconds * fps clamped to [least, most, total], floored to the factor; fails while running outside it."""
    low = F.ceil(F.lit(least) / factor) * factor
    high = F.floor(F.least(F.lit(most), total) / factor) * factor
    n = F.floor(F.least(F.greatest(total / video_fps * fps, low.cast("double")), high.cast("double"), total.cast("double")) / factor) * factor
    return F.when((n >= factor) & (n <= total), n.cast("long")).otherwise(F.raise_error(F.lit("no valid number of frames")).cast("long"))


def frame_range(total: Column, video_fps: Column, start: Column, end: Column) -> Column:
    """struct(first, last, frames) of a time range clamped to the video; fails while running if it is empty."""
    longest = total / video_fps
    first = F.when(start.isNull(), F.lit(0)).otherwise(F.ceil(F.least(F.greatest(start, F.lit(0.0)), longest) * video_fps)).cast("long")
    last = F.when(end.isNull(), total - 1).otherwise(F.least(F.floor(F.least(F.greatest(end, F.lit(0.0)), longest) * video_fps), total - 1)).cast("long")
    bad = F.raise_error(F.lit("the time range is empty")).cast("struct<first: bigint, last: bigint, frames: bigint>")
    return F.when(first >= last, bad).otherwise(F.struct(first.alias("first"), last.alias("last"), (last - first + 1).alias("frames")))


def evenly(first: Column, last: Column, n: Column) -> Column:
    """n evenly spaced frame numbers, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.bround(first + i * (last - first) / F.greatest(n - 1, F.lit(1))).cast("long"))


def target_size(width: Column, height: Column, multiple: int) -> Column:
    """Both sides scaled by the mean of the two rounded scales, to multiples; at least one multiple."""
    side = lambda n: F.greatest(F.bround(n / multiple) * multiple, F.lit(float(multiple)))
    scale = (side(width) / width + side(height) / height) / 2
    fit = lambda n: F.greatest(F.bround(n * scale / multiple) * multiple, F.lit(float(multiple))).cast("long")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def visual_tokens(grid: Column, merge: int = 2) -> Column:
    """Tokens of an image or video grid [t, h, w] after merging."""
    return F.floor(grid[0] * grid[1] * grid[2] / (merge * merge)).cast("int")


def timed_video(text: Column, grid: Column, seconds: Column, placeholder: str = "<video>", token: str = "<|video_pad|>", start: str = "<|vision_start|>", stop: str = "<|vision_end|>", merge: int = 2) -> Column:
    """The first video placeholder as one block of tokens per frame, each behind its time."""
    per = F.floor(grid[1] * grid[2] / (merge * merge)).cast("int")
    block = F.array_join(F.transform(seconds, lambda s: F.concat(F.lit("<"), F.format_number(s, 1), F.lit(" seconds>"), F.lit(start), F.repeat(F.lit(token), per), F.lit(stop))), "")
    at = F.instr(text, placeholder)
    return F.when(at == 0, text).otherwise(F.concat(F.left(text, at - 1), block, F.substring(text, at + len(placeholder), F.length(text))))


def rope_positions(kinds: str, grids: str) -> Column:
    """3-axis positions: array of struct(t, h, w) per token.

    kinds holds per token 0 for text and k > 0 for the k-th medium, whose grid is grids[k] =
    [t, h, w] after merging.  Text advances all axes by one; a medium's tokens run over its grid
    from the next free position, and the text after it goes on behind its largest position.
    """
    return F.expr(
        f"""aggregate({kinds}, named_struct('next', 0L, 'base', 0L, 'k', 0, 'i', 0L, 'out', cast(array() as array<struct<t: bigint, h: bigint, w: bigint>>)), (a, x) -> case
        when x = 0 then named_struct('next', a.next + 1, 'base', a.next + 1, 'k', 0, 'i', 0L, 'out', array_append(a.out, named_struct('t', a.next, 'h', a.next, 'w', a.next)))
        else named_struct(
          'next', greatest(a.next, if(a.k = x, a.base, a.next) + greatest(cast({grids}[x - 1][0] as bigint), cast({grids}[x - 1][1] as bigint), cast({grids}[x - 1][2] as bigint))),
          'base', if(a.k = x, a.base, a.next), 'k', x, 'i', if(a.k = x, a.i, 0L) + 1,
          'out', array_append(a.out, named_struct(
            't', if(a.k = x, a.base, a.next) + cast(floor(if(a.k = x, a.i, 0L) / ({grids}[x - 1][1] * {grids}[x - 1][2])) as bigint),
            'h', if(a.k = x, a.base, a.next) + cast(floor(if(a.k = x, a.i, 0L) / {grids}[x - 1][2]) % {grids}[x - 1][1] as bigint),
            'w', if(a.k = x, a.base, a.next) + cast(if(a.k = x, a.i, 0L) % {grids}[x - 1][2] as bigint)))) end, a -> a.out)"""
    )


def media_items(messages: str) -> Column:
    """All image and video items of array<struct<role, content: array<struct<type, value>>>>."""
    return F.expr(f"filter(flatten(transform({messages}, m -> m.content)), c -> c.type in ('image', 'video'))")


def split_media(messages: str) -> Column:
    """struct(images, videos) of the items' values."""
    items = f"flatten(transform({messages}, m -> m.content))"
    return F.expr(f"named_struct('images', transform(filter({items}, c -> c.type = 'image'), c -> c.value), 'videos', transform(filter({items}, c -> c.type = 'video'), c -> c.value))")


def split_placeholders(text: Column, placeholder: str, kind: str) -> Column:
    """A text as content items: its parts, and a medium between them."""
    parts = F.split(text, placeholder)
    items = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<type: string, value: string>>")), F.when(p != "", F.array(F.struct(F.lit("text").alias("type"), p.alias("value")))).otherwise(F.array().cast("array<struct<type: string, value: string>>"))))
    return F.flatten(items)


#: Fixed tails of questions by kind of problem.
QUESTION_TAILS = {
    "multiple choice": "Please provide only the single option letter (e.g., A, B, C, D, etc.) within the <answer> </answer> tags.",
    "numerical": "Please provide the numerical value within the <answer> </answer> tags.",
}


def question_text(problem: Column, kind: Column, options: Column, tails: dict[str, str] | None = None) -> Column:
    """The problem, its options if it is a multiple choice, and the tail of its kind."""
    listed = F.concat(F.lit("\nOptions:\n"), F.array_join(options, "\n"), F.lit("\n"))
    tail = F.lit("")
    for name, text in (tails or QUESTION_TAILS).items():
        tail = F.when(kind == name, F.lit("\n" + text)).otherwise(tail)
    return F.concat(problem, F.when((kind == "multiple choice") & (F.size(options) > 0), listed).otherwise(F.lit("")), tail)


def ordered_content(images: Column, videos: Column, text: Column) -> Column:
    """Content items: images, then videos, then the text."""
    item = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    none = F.array().cast("array<string>")
    return F.concat(F.transform(F.coalesce(images, none), item("image")), F.transform(F.coalesce(videos, none), item("video")), F.array(item("text")(text)))


def keep_short(df: DataFrame, length: str, most: int, videos: str | None = None) -> DataFrame:
    """Rows whose prompt isn't too long; rows with videos always stay."""
    ok = F.col(length) <= most
    return df.where(ok if videos is None else ok | (F.size(videos) > 0))
