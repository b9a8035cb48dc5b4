"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that a finished query's shuffle files go at once, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; without it a folder of this machine in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = existing.get() if existing.isDefined() else None
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/checkpoints"
    return where


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df and read it back: every reader sees one result, and lost executors cost no lineage.

    Nothing reads the shuffles of the write once the table stands, so their files go with its end.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over four tasks a core: a small file is one task, however much work its rows take."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete written intermediate tables that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, path)
