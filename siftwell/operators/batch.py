"""Batch algebra on frames with an explicit row id.

Frames are unordered; whatever depends on a row's place takes a key that orders rows.  Positions
(``_pos``, from 0) come from ``with_position``: a range sort, local numbering, and one small table
of partition offsets, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.sources.scratch import materialise


def ranged_rows(df: DataFrame, cols: Sequence[Column]) -> DataFrame:
    """df in sorted range partitions, written once: _part numbers them and _local their rows.

    Numbers are made while the sorted rows are written, so nothing is shuffled or sorted again.
    """
    rows = materialise(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_rid", F.monotonically_increasing_id()), "ranged")
    return rows.withColumn("_part", F.shiftright("_rid", 33).cast("int")).withColumn("_local", F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_rid")


def with_position(df: DataFrame, *order: str | Column, name: str = "_pos") -> DataFrame:
    """Global row numbers in the given order, computed by range partitions."""
    ranged = ranged_rows(df, [F.col(c) if isinstance(c, str) else c for c in order])
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # one row per partition
    return ranged.join(offsets, "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def running_before(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The sum of value over the rows of a group that come before in order; no task sees a whole group.

    Inside a range partition a window sums a group's rows; what the partitions before hold of the
    group is one row per group and partition.
    """
    rows = ranged_rows(df.withColumn("_value", value), [F.col(group), F.col(order)])
    here = Window.partitionBy("_part", group).orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", F.col(group).alias("_group")).agg(F.sum("_value").alias("_sum"))
    carried = F.coalesce(F.sum("_sum").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_part").alias("_of"), "_group", carried.alias("_carried"))
    rows = rows.withColumn("_here", F.coalesce(F.sum("_value").over(here), F.lit(0)))
    rows = rows.join(parts, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return rows.withColumn(name, F.col("_here") + F.col("_carried")).drop("_part", "_local", "_value", "_here", "_of", "_group", "_carried")


def select(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A column subset; unknown names are ignored, None keeps all."""
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def pop(df: DataFrame, columns: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest); both keep the row key."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(key, *(c for c in columns if c != key)), df.drop(*(c for c in columns if c != key))


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def horizontal_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both by row key; a column in both must agree everywhere (checked while running)."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(r, key, "full")
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return joined.drop(*(f"_r_{c}" for c in shared))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of all rows by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def slice_rows(df: DataFrame, order: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python slice semantics over rows in the given order; negative bounds count from the end."""
    rows = with_position(df, order)
    n = df.count() if any(x is not None and x < 0 for x in (start, stop)) or step < 0 else None
    low, high, by = slice(start, stop, step).indices(n if n is not None else 2**62)
    if by > 0:
        return rows.where((F.col("_pos") >= low) & (F.col("_pos") < high) & ((F.col("_pos") - low) % by == 0)).drop("_pos")
    return rows.where((F.col("_pos") <= low) & (F.col("_pos") > high) & ((F.lit(low) - F.col("_pos")) % -by == 0)).drop("_pos")


def take_positions(df: DataFrame, order: str, positions: DataFrame) -> DataFrame:
    """Gather: positions has columns (at, source); the result's rows are ordered by at and may repeat."""
    rows = with_position(df, order)
    return positions.join(rows, positions["source"] == rows["_pos"]).drop("_pos", "source")


def chunk(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """Adds chunk (0..chunks-1): equal contiguous stretches; the row count must be divisible."""
    n = df.count()
    if n % chunks:
        raise ValueError(f"{n} rows can't be cut into {chunks} equal chunks")
    return with_position(df, order).withColumn("chunk", F.floor(F.col("_pos") / (n // chunks)).cast("int")).drop("_pos")


def split(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk: contiguous stretches of size rows, the last one may be shorter."""
    return with_position(df, order).withColumn("chunk", F.floor(F.col("_pos") / size).cast("int")).drop("_pos")


def repeat(df: DataFrame, order: str, times: int, interleave: bool = True) -> DataFrame:
    """Each row times times; _pos says where: a,a,b,b if interleaved, else a,b,a,b."""
    rows = with_position(df, order).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return rows.withColumn("_pos", F.col("_pos") * times + F.col("_copy"))
    n = df.count()
    return rows.withColumn("_pos", F.col("_copy") * F.lit(n) + F.col("_pos"))


def pad_to_divisor(df: DataFrame, order: str, divisor: int) -> DataFrame:
    """Head rows appended (again and again if need be) until the count is divisible; _pos orders, _padded marks."""
    n = df.count()
    rows = with_position(df, order).withColumn("_padded", F.lit(False))
    missing = -n % divisor if n else 0
    if not missing:
        return rows
    rounds = -(-missing // n)
    extra = rows.where(F.col("_pos") < missing).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_pos", F.lit(n) + F.col("_round") * F.lit(n) + F.col("_pos"))
    return rows.unionByName(extra.where(F.col("_pos") < n + missing).withColumn("_padded", F.lit(True)).drop("_round"))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_padded")).drop("_padded")


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """Rows moved to new positions: permutation has (new, old) over _pos."""
    return df.join(permutation, df["_pos"] == permutation["old"]).drop("_pos", "old").withColumnRenamed("new", "_pos")


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("old").alias("new"), F.col("new").alias("old"))


def fold_batch(df: DataFrame, order: str, size: int) -> DataFrame:
    """n rows to n / size rows that hold arrays of size values per column."""
    cut = split(df, order, size)
    cols = [c for c in df.columns]
    return cut.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in cols if c != order)))).alias("_s")).select("chunk", *(F.col(f"_s.{c}").alias(c) for c in cols))


def flatten_map(column: str, separator: str = "/") -> Column:
    """map<string, map<string, v>> to map<string, v> with joined keys."""
    return F.expr(f"map_from_entries(flatten(transform(map_entries({column}), e -> transform(map_entries(e.value), f -> struct(concat(e.key, '{separator}', f.key), f.value)))))")


def unflatten_map(column: str, separator: str = "/") -> Column:
    """map<string, v> with joined keys to map<string, map<string, v>> (first separator counts)."""
    head = f"substring_index(k, '{separator}', 1)"
    return F.expr(
        f"map_from_entries(transform(array_distinct(transform(map_keys({column}), k -> {head})), h -> struct(h, "
        f"map_from_entries(transform(filter(map_entries({column}), e -> substring_index(e.key, '{separator}', 1) = h), e -> struct(substr(e.key, length(h) + 2), e.value))))))"
    )


def merge_maps(a: str, b: str) -> Column:
    """Union of two maps; keys in both must have equal values."""
    return F.expr(
        f"if(forall(map_keys({a}), k -> not array_contains(map_keys({b}), k) or {a}[k] <=> {b}[k]), map_concat({a}, map_filter({b}, (k, v) -> not array_contains(map_keys({a}), k))), raise_error('a key has two values'))"
    )


def append_to_lists(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One list per key, in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("values"))


def check_consistent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails while running if array columns of a row differ in length."""
    sizes = [F.size(c) for c in columns]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    return df.withColumn(columns[0], F.when(same, F.col(columns[0])).otherwise(F.raise_error(F.lit("columns of a row differ in length"))))


#: Bytes of a value of fixed width.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def _held(value: Column, kind: T.DataType) -> Column:
    match kind:
        case T.ArrayType():
            fixed = _WIDTHS.get(kind.elementType.simpleString())
            inner = F.size(value).cast("long") * fixed if fixed else F.aggregate(F.transform(value, lambda x: _held(x, kind.elementType)), F.lit(0).cast("long"), lambda a, b: a + b)
        case T.MapType():
            inner = _held(F.map_keys(value), T.ArrayType(kind.keyType)) + _held(F.map_values(value), T.ArrayType(kind.valueType))
        case T.StructType():
            inner = sum((_held(value[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
        case T.StringType() | T.BinaryType() | T.VarcharType() | T.CharType():
            inner = F.octet_length(value).cast("long")
        case _:
            inner = F.lit(_WIDTHS.get(kind.simpleString(), 16)).cast("long")
    return F.when(value.isNotNull(), inner).otherwise(F.lit(0).cast("long"))


def held_bytes(df: DataFrame) -> DataFrame:
    """column, bytes: what the values of each column take up, nulls nothing; one map-side aggregation."""
    sums = df.agg(F.array(*(F.struct(F.lit(f.name).alias("column"), F.coalesce(F.sum(_held(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType)), F.lit(0)).alias("bytes")) for f in df.schema.fields)).alias("s"))
    return sums.select(F.inline("s"))
