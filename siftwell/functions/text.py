"""String, JSON and regex functions over answers, labels and model outputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_answer(text: Column) -> Column:
    """The first <answer> element, trimmed; an empty string if there is none."""
    return F.trim(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1), F.lit(" \t\n\r"))


def has_answer(text: Column) -> Column:
    return extract_answer(text) != ""


def clean_json(text: Column) -> Column:
    """Fences and quotes stripped, escaped line breaks and quotes restored, line breaks removed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"```(json)?", ""), r"'''", "")
    return F.regexp_replace(F.replace(F.replace(bare, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), r"\n", "")


def lenient_json(text: Column) -> Column:
    """A VARIANT, or null if the cleaned text is no JSON."""
    return F.try_parse_json(F.trim(clean_json(text)))


def json_candidate(text: Column) -> Column:
    """The first fenced block that is JSON, else the outermost object, else the outermost list."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    fenced = F.filter(F.transform(found, lambda x: F.trim(x, F.lit(" \t\n\r"))), lambda x: F.try_parse_json(x).isNotNull())
    return F.coalesce(F.get(fenced, F.lit(0)), _if_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), _if_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1)))


def _if_json(text: Column) -> Column:
    """The text if it is one JSON value; the parser alone would take a first value and ignore the rest."""
    whole = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1
    return F.when((text != "") & F.try_parse_json(text).isNotNull() & whole, text)


def normalize_number(text: Column) -> Column:
    """Commas stripped, then a plain decimal number; null for anything else."""
    bare = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), bare.cast("double"))


def same_choice(answer: Column, truth: Column) -> Column:
    """Equal, or the truth's letter followed by a separator starts the answer."""
    a, t = F.upper(F.trim(answer)), F.upper(F.trim(truth))
    return (a == t) | ((F.length(t) == 1) & a.startswith(t) & F.substring(a, 2, 1).isin(".", ")", ":", ",", " "))


def normalize_label(text: Column) -> Column:
    """Lower case, anything but letters, digits and spaces to a space, spaces squeezed, a plural s dropped."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))
    return F.when((F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss"), F.left(low, F.length(low) - 1)).otherwise(low)


def parse_labels(text: Column) -> Column:
    """Sorted distinct labels of a list separated by commas, line breaks, semicolons, slashes or bars."""
    parts = F.transform(F.split(text, r"[,\n;/|]"), normalize_label)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def fill_template(slot: str, **values: Column) -> Column:
    """Every {{name}} of a slot replaced once by its value."""
    out = F.lit(slot)
    for name, value in values.items():
        mark = "{{" + name + "}}"
        if mark in slot:
            out = F.concat(F.substring_index(out, mark, 1), value, F.substring(out, F.instr(out, mark) + len(mark), F.length(out)))
    return out


def data_uri(content: Column, path: Column, default: str = "image/jpeg") -> Column:
    """Base64 data URI; the media type follows from the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(default)
    for s, t in (("png", "image/png"), ("gif", "image/gif"), ("webp", "image/webp"), ("bmp", "image/bmp"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("mp4", "video/mp4"), ("webm", "video/webm"), ("mov", "video/quicktime")):
        kind = F.when(suffix == s, t).otherwise(kind)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def pixel_product(text: Column) -> Column:
    """'a*b' or a plain integer as a number of pixels."""
    return F.aggregate(F.split(F.replace(text, F.lit(" "), F.lit("")), r"\*"), F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))


def bracketed_points(text: Column) -> Column:
    """All number pairs in brackets or parentheses, else all bare pairs: array<array<double>>."""
    number = r"(-?\d+(?:\.\d+)?)"

    def pairs(pattern: str) -> Column:
        return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x, y: F.array(x.cast("double"), y.cast("double")))

    inner = pairs(rf"[\[(]\s*{number}\s*,\s*{number}\s*[\])]")
    return F.when(F.size(inner) > 0, inner).otherwise(pairs(rf"{number}\s*,\s*{number}"))


def answer_points(text: Column, key: str = "point_2d", size: int = 2) -> Column:
    """Points of a JSON answer: one object or a list of objects with a number list of a size under a key."""
    kind = f"array<struct<{key}: array<double>>>"
    parsed = F.from_json(F.trim(clean_json(text)), kind)
    return F.filter(F.transform(parsed, lambda x: x[key]), lambda p: p.isNotNull() & (F.size(p) == size) & ~F.exists(p, lambda v: v.isNull()))


def well_formed(response: Column, kind: Column) -> Column:
    """A non-empty answer; point and trace answers hold pairs, 3-D traces pairs with a depth, boxes four numbers."""
    answer = extract_answer(response)

    def listed(key: str, size: int, depth: bool = False) -> Column:
        fields = f"{key}: array<double>" + (", depth: double" if depth else "")
        parsed = F.from_json(F.trim(clean_json(answer)), f"array<struct<{fields}>>")
        ok = lambda p: p.isNotNull() & p[key].isNotNull() & (F.size(p[key]) == size) & ~F.exists(p[key], lambda v: v.isNull()) & (p["depth"].isNotNull() if depth else F.lit(True))
        return F.coalesce((F.size(parsed) > 0) & F.forall(parsed, ok), F.lit(False))

    body = F.when(kind.isin("point", "trace"), listed("point_2d", 2)).when(kind == "trace_3d", listed("point_2d", 2, True)).when(kind == "spatial grounding", listed("bbox_2d", 4)).otherwise(True)
    return (answer != "") & body
