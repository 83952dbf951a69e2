"""Intermediate tables of driver loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of our own in the shared folder, spark.checkpoint.dir; only a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back.

    Cuts the lineage like checkpoint() and also the plan's inferred constraints, which grow with every round.
    """
    spark = df.sparkSession
    path = new_path(spark, "loop")
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more, such as those of a loop's earlier rounds."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
