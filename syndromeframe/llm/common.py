"""Shared folder, tables and batch limits used by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts reach some hundred kilobytes, so the default of 10,000 rows is too many.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python by BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; one of our own only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete a table of stored() that nothing reads any more, such as that of a loop's round before the last."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that clash with none of `columns`, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_fold(doc_id: str, folds: int):
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def first_by_hash(rows: DataFrame, key: str, n: int, counts: dict) -> DataFrame:
    """The n rows of each key with the least hash of doc_id; counts: rows by key (a few labels or languages).

    A cut of the hash that about 2n + 1000 rows of a key pass comes first, so that no task gets all of a
    frequent key's rows.
    """
    share = F.lit(None).cast("double")
    for value, count in counts.items():
        share = F.when(F.col(key) == value, min(1.0, (2 * n + 1000) / max(count, 1))).otherwise(share)
    h = F.xxhash64("doc_id")
    few = rows.filter(F.shiftrightunsigned(h, 11) / float(1 << 53) < share)
    (rank,) = fresh(rows.columns, "rank")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.shiftrightunsigned(h, 11), "doc_id"))).filter(F.col(rank) <= n).drop(rank)


#: A key with this part of all rows or more is frequent; so there are at most as many frequent keys.
FREQUENT = 200


def join_frequent(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with classes (one row a key, `size` of them in rows), with no task for a frequent key alone.

    The at most FREQUENT classes that hold a FREQUENT-th of all rows are broadcast, the others shuffled.
    """
    least = max(1, -(-total // FREQUENT))
    often = F.broadcast(classes.filter(F.col(size) >= least).drop(size))
    rest = rows.join(F.broadcast(classes.filter(F.col(size) >= least).select(keys)), keys, "left_anti")
    return rows.join(often, keys).unionByName(rest.join(classes.filter(F.col(size) < least).drop(size), keys))
