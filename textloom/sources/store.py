"""Tables derived from other tables, kept in the shared folder and made again only when their input changed.

A derived table is written beside its place and moved there by one rename, so that a reader sees all of it or
nothing; of two writers the first wins. Its name holds a signature of the input files (paths, sizes, times).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a session of one machine gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-store-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Move ``made`` to ``path`` in one step; False if something is there already, which stays."""
    fs, source = file_system(spark, made)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(target.getParent())
    # renaming into an existing folder would nest, so the place must be free
    return not fs.exists(target) and fs.rename(source, target)


def signature(rows: DataFrame) -> str | None:
    """What the files behind a table are: a sum over their paths, sizes and times; None for a table without files."""
    try:
        files = rows.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    except AnalysisException:
        return None
    r = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("p", "s", "t")).alias("h")).first()
    return f"{r.n}-{(r.h or 0) & (2**64 - 1):016x}"


def derived(rows: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """Path of what ``build(path)`` derives from ``rows``; it is called only if no equal input was met before."""
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/textloom-derived"
    sign = signature(rows)
    path = f"{root}/{name}-{sign or uuid.uuid4().hex}"
    if sign is None or not exists(spark, path):
        made = f"{root}/.{name}-{uuid.uuid4().hex}"
        try:
            build(made)
            publish(spark, made, path)
        finally:
            delete(spark, made)
    return path
