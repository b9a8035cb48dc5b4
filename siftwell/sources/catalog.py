"""Dataset catalog: names to files, columns and tags, and reading them.

A catalog is a dict (or a JSON or YAML-like file of one) of entries; an entry names a file or a
directory, its layout, and which columns hold what.  Reading is lazy; formats follow from the
extension.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.convert import alpaca, sharegpt
from siftwell.operators.mix import resample
from siftwell.sources.files import read_arrow, read_ply

#: Extensions and their readers.
READERS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "jsonl", "txt": "text", "orc": "orc", "arrow": "arrow", "ply": "ply"}


@dataclass(frozen=True)
class Entry:
    """One dataset: where it is, its layout (alpaca or sharegpt), and its column and tag names."""

    path: str
    layout: str = "alpaca"
    ranking: bool = False
    split: str = "train"
    num_samples: int | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)


def listed(spark: SparkSession, path: str) -> list[str] | None:
    """File names under a path of any Hadoop file system; None if it is no directory."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return None
    return sorted(f.getPath().getName() for f in fs.listStatus(p))


def reader_of(path: str, spark: SparkSession | None = None) -> str:
    """The reader that a path's own extension names, else the one that all files of a directory map to."""
    own = READERS.get(path.rstrip("/").rsplit(".", 1)[-1].lower()) if "." in path.rstrip("/").rsplit("/", 1)[-1] else None
    if own is not None:
        return own
    spark = spark or SparkSession.getActiveSession()
    inside = listed(spark, path) if spark is not None else None
    names = [path] if inside is None else [n for n in inside if not n.startswith((".", "_"))]
    kinds = {READERS.get(n.rsplit(".", 1)[-1].lower()) if "." in n else None for n in names}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(f"no single reader for {path}: {sorted(map(str, kinds))}")
    return kinds.pop()


def read(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, kind: str | None = None) -> DataFrame:
    """Files of one kind; any Hadoop path. JSON files hold one document (a list), JSON lines one a line."""
    paths = [path] if isinstance(path, str) else list(path)
    kind = kind or reader_of(paths[0], spark)
    if kind in ("ply", "arrow"):
        return (read_ply if kind == "ply" else read_arrow)(spark, paths)
    r = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json":
        return r.option("multiLine", True).json(paths)
    if kind == "jsonl":
        return r.json(paths)
    if kind == "csv":
        return r.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    return r.format(kind).load(paths)


def load_catalog(source: Mapping | str) -> dict[str, Entry]:
    """Entries by name.  A columns or tags block replaces all defaults of its kind."""
    raw = source
    if isinstance(source, str):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise ValueError("reading a catalog file needs a session")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return {}
        raw = json.loads(spark.read.text(source, wholetext=True).first()[0])
    out = {}
    for name, e in raw.items():
        path = e.get("cloud_file_name") or e.get("file_name") or e.get("path")
        if path is None:
            raise ValueError(f"dataset {name} names no file")
        out[name] = Entry(path, e.get("formatting", "alpaca"), bool(e.get("ranking", False)), e.get("split", "train"), e.get("num_samples") or e.get("size"), e.get("columns", {}), e.get("tags", {}))
    return out


def dataset_name(path: str) -> str:
    """A file's stem."""
    return os.path.basename(path.rstrip("/")).split(".")[0]


def with_dataset_name(df: DataFrame, column: str = "dataset_name") -> DataFrame:
    """The stem of the file that each row came from."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))


def canonical(df: DataFrame, entry: Entry, key: str, kind: str = "sft") -> DataFrame:
    """The entry's rows in the canonical form of its layout."""
    c = dict(entry.columns)
    if entry.layout == "sharegpt":
        t = entry.tags
        names = {"user": t.get("user_tag", "human"), "assistant": t.get("assistant_tag", "gpt"), "observation": t.get("observation_tag", "observation"), "function": t.get("function_tag", "function_call"), "system": t.get("system_tag", "system")}
        return sharegpt(df, key, c.get("messages", "conversations"), t.get("role_tag", "from"), t.get("content_tag", "value"), names, c.get("system"), c.get("tools"), c.get("chosen") if entry.ranking else None, c.get("rejected") if entry.ranking else None, c.get("kto_tag"), c.get("images"), c.get("videos"), c.get("audios"))
    return alpaca(df, key, c.get("prompt", "instruction"), c.get("query", "input"), c.get("response", "output"), c.get("history"), c.get("system"), c.get("tools"), "ranking" if entry.ranking else kind, c.get("chosen", "chosen"), c.get("rejected", "rejected"), c.get("kto_tag", "label"), c.get("images"), c.get("videos"), c.get("audios"))


def load_datasets(spark: SparkSession, catalog: Mapping[str, Entry], names: Sequence[str], base: str = "", ranking: bool = False) -> dict[str, DataFrame]:
    """The named datasets, raw; whether they rank must match the stage."""
    out = {}
    for n in names:
        if n not in catalog:
            raise KeyError(f"no dataset {n}; there are {sorted(catalog)}")
        e = catalog[n]
        if e.ranking != ranking:
            raise ValueError(f"dataset {n} does not fit this stage")
        path = e.path if "://" in e.path or os.path.isabs(e.path) or not base else f"{base.rstrip('/')}/{e.path}"
        out[n] = read(spark, path)
    return out


def _named_rows(df: DataFrame, name: str) -> DataFrame:
    """df with _row: the dataset's name, a digest of the row's content, and a number among rows of that content.

    So a row keeps its name on any file split; equal rows are counted map-side and numbered as they are laid out again.
    """
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
    counted = df.groupBy(F.md5(F.to_json(whole)).alias("_digest")).agg(F.first(whole).alias("_whole"), F.count(F.lit(1)).alias("_times"))
    again = counted.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return again.select("_whole.*", F.concat_ws("#", F.lit(name), "_digest", F.col("_time").cast("string")).alias("_row"))


def merged_datasets(spark: SparkSession, catalog: Mapping[str, Entry], names: Sequence[str], base: str = "", ranking: bool = False, kind: str = "sft", seed: int = 42) -> DataFrame:
    """The named datasets in canonical form as one frame: _dataset names each row's, _row tells its rows apart.

    Each entry's number of samples takes effect: fewer are drawn without replacement, more repeat
    drawn rows (_draw numbers them).
    """
    out = None
    for name, df in load_datasets(spark, catalog, names, base, ranking).items():
        entry = catalog[name]
        rows = _named_rows(df, name)
        rows = canonical(rows, entry, "_row", kind)
        rows = resample(rows, "_row", entry.num_samples, seed) if entry.num_samples else rows.withColumn("_draw", F.lit(0).cast("long"))
        rows = rows.withColumn("_dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no datasets are named")
    return out


def with_common_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Missing columns added (arrays empty, others null), all cast, in the schema's order."""
    cols = []
    for f in schema.fields:
        missing = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)
        cols.append((F.col(f.name).cast(f.dataType) if f.name in df.columns else missing).alias(f.name))
    return df.select(*cols)


def load_common(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Files of records with differing columns as one frame with the file's name in each row."""
    out = None
    for p in paths:
        df = read(spark, p).withColumn("dataset_name", F.lit(dataset_name(p)))
        df = with_common_columns(df, schema)
        out = df if out is None else out.unionByName(df)
    return out


def list_media(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("png", "jpg", "jpeg", "bmp", "webp", "tiff"), recursive: bool = False) -> DataFrame:
    """path, length and modification time of media files; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    return df.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))


def leaf_folders(media: DataFrame) -> DataFrame:
    """Folders that directly hold media and have no subfolder that does."""
    folders = media.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    parts = F.split("folder", "/")
    parents = folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    return folders.join(parents, "folder", "left_anti")


def override(entry: Entry, **changes) -> Entry:
    return replace(entry, **changes)
