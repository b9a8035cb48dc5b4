"""Arrow IPC files and ASCII PLY points on any Hadoop file system.

PLY files are read and written by Spark's own text source: a file of any size comes in many splits, and a
line's number follows from the lines of the splits before it.  Arrow files come through
its ``binaryFile`` source, one row a file (under 2 GB: they can't be split), and are decoded batch by batch.
Nothing is opened by a local path.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from siftwell.sources.scratch import discard, materialise

#: The property types of the points that are written.
PLY_TYPES = {"x": "float", "y": "float", "z": "float", "red": "uchar", "green": "uchar", "blue": "uchar", "nx": "float", "ny": "float", "nz": "float", "class_id": "int", "instance_id": "int"}


def _contents(spark: SparkSession, paths: Sequence[str], suffix: str) -> DataFrame:
    """path and content of files, and of those with the suffix below directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    return files.where(F.lower("path").endswith(suffix)) if suffix else files


def _open_arrow(content: bytes):
    try:
        return pa.ipc.open_file(pa.BufferReader(content))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(content))


def _arrow_batches(content: bytes) -> Iterator[pa.RecordBatch]:
    with _open_arrow(content) as r:
        if hasattr(r, "num_record_batches"):
            for i in range(r.num_record_batches):
                yield r.get_batch(i)
        else:
            yield from r


def read_arrow(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Arrow IPC files and streams with one schema, that of the first file."""
    files = _contents(spark, paths, ".arrow")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with _open_arrow(content.as_py()) as r:
                    yield pa.RecordBatch.from_arrays([pa.array([r.schema.serialize().to_pybytes()], pa.binary())], names=["schema"])

    first = files.orderBy("path").limit(1).mapInArrow(heads, "schema binary").first()
    if first is None:
        raise ValueError(f"no Arrow files under {list(paths)}")
    schema = pa.ipc.read_schema(pa.BufferReader(bytes(first["schema"])))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _arrow_batches(content.as_py())

    return files.mapInArrow(decode, from_arrow_schema(schema))


def ply_header(lines: Sequence[str], name: str = "file") -> tuple[list[str], int, int]:
    """Property names of the vertices, the line that the first one stands in, and how many there are, of an ASCII PLY file.

    Elements before the vertices take one line each.
    """
    names, start, count, skipped = [], 0, 0, 0
    element = ""
    if not lines or lines[0].strip() != "ply":
        raise ValueError(f"{name} is no PLY file")
    for at, line in enumerate(lines):
        match line.split():
            case ["format", kind, *_] if kind != "ascii":
                raise ValueError(f"{name} is not ASCII")
            case ["element", element, n]:
                count = int(n) if element == "vertex" else count
                start = skipped if element == "vertex" else start
                skipped += int(n)
            case ["property", *_, prop] if element == "vertex":
                names.append(prop)
            case ["end_header"]:
                return names, at + 1 + start, count
    raise ValueError(f"{name} has no end of header")


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))
def _headers(files: pd.Series, lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ply_header(list(x), f) for f, x in zip(files, lines, strict=True)], columns=["names", "first", "n"])


def read_ply(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per vertex with the file's name, all properties as doubles; the first file (by path) names the properties.

    One scan counts the lines of each split and picks out the header lines (data lines start with a number); a
    second one keeps the vertices.  What is broadcast has one row a split.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).where(F.lower("path").endswith(".ply"))
    head = F.when(F.col("value").rlike("^[a-z]"), F.struct("id", "value"))
    splits = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_id"), F.array_sort(F.collect_list(head)).alias("head"))
    splits = materialise(splits, "splits")
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("block")) - F.col("lines")
    offsets = splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), (before - F.col("first_id")).alias("shift"))
    ordered = splits.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "head"))), lambda s: s["head"]["value"])).alias("all"))
    end = F.array_position("all", "end_header").cast("int")
    headers = materialise(ordered.select("path", F.when(end > 0, F.slice("all", F.lit(1), end)).otherwise(F.col("all")).alias("all")).select("path", _headers("path", "all").alias("h")).select(F.col("path").alias("_of"), "h.*"), "headers")
    first = headers.orderBy("_of").first()
    if first is None:
        raise ValueError(f"no PLY files under {list(paths)}")
    rows = lines.join(F.broadcast(offsets), (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block"))).join(F.broadcast(headers), F.col("path") == F.col("_of"))
    number = F.col("id") + F.col("shift")
    rows = rows.where((number >= F.col("first")) & (number < F.col("first") + F.col("n")))
    words = F.split(F.trim("value"), r"\s+")
    named = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), words.alias("words"), "names")
    place = lambda n: F.nullif(F.array_position("names", n).cast("int"), F.lit(0))
    return named.select("file", *(F.try_element_at("words", place(n)).cast("double").alias(n) for n in first["names"]))


def write_ply(points: DataFrame, path: str) -> None:
    """ASCII PLY files points-*.ply, one a partition that holds points; what stood under the path goes.

    The files are written and named in a folder beside it, which takes the path's name when all are there.
    """
    spark, names = points.sparkSession, points.columns
    rows = materialise(points.withColumn("_part", F.spark_partition_id()), "points")
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition

    def block(part: int, at: int, text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(text), pa.int32()), pa.array(range(at, at + len(text)), pa.int64()), pa.array(text, pa.string())], names=["part", "at", "value"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            parts = batch.column("_part").to_pylist()
            cols = [[f"{v:.6f}" if PLY_TYPES.get(n, "float") == "float" else str(int(v)) for v in batch.column(n).to_pylist()] for n in names]
            text = [" ".join(r) for r in zip(*cols, strict=True)]
            first = 0
            while first < len(text):
                part = parts[first]
                last = bisect.bisect_right(parts, part)
                if part != current:
                    head = ["ply", "format ascii 1.0", f"element vertex {counts[part]}", *(f"property {PLY_TYPES.get(n, 'float')} {n}" for n in names), "end_header"]
                    yield block(part, 0, head)
                    current, at = part, len(head)
                yield block(part, at, text[first:last])
                at, first = at + last - first, last

    made = rows.repartitionByRange(max(len(counts), 1), "_part").sortWithinPartitions("_part").mapInArrow(lines, "part int, at long, value string")
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    made.sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(draft)
    discard(rows)
    _name_files(spark, draft)
    there, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, draft))
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(there, True)
    if not fs.rename(new, there):
        raise OSError(f"{draft} is complete but could not take the name {path}")


def _name_files(spark: SparkSession, path: str) -> None:
    """part=N/part-*.txt becomes points-N.ply: one rename a file, by any file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = hadoop(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(base):
        name = folder.getPath().getName()
        if name.startswith("part="):
            for file in fs.listStatus(folder.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), hadoop(f"{path}/points-{name.removeprefix('part=')}.ply"))
            fs.delete(folder.getPath(), True)
