"""Helpers shared by the training-data operators.

Nothing here keeps rows on the driver or in a machine-local folder. Intermediate tables go to the
folder that the session names in ``spark.checkpoint.dir``. Where it is unset, a session of one machine
(master local) gets a temporary folder, and any other session an error.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a batch that goes to Python; texts reach 100 KB and more, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}


def prepare(spark: SparkSession) -> str:
    """Bound the Arrow batches and return the shared scratch folder of this session."""
    for name, most in _LIMITS.items():
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one operator call in the shared folder, deleted together by ``drop``.

    A table written here survives the loss of executors and cuts the lineage, as a checkpoint does,
    but is compressed and read by column. What was shuffled to write it is not needed any more, so its
    files go at once. A table has no more files than a few for each core or one for each FILE_BYTES of the input, whichever
    is more: a shuffle of many small partitions would leave as many small files.
    """

    FILE_BYTES, FILES_A_CORE = 16 << 20, 4

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None):
        self.spark = spark
        self.root = f"{prepare(spark)}/textloom-{uuid.uuid4().hex}"
        self.n = 0
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if docs is not None else 1 << 62
        self.files = max(spark.sparkContext.defaultParallelism * self.FILES_A_CORE, min(-(-size // self.FILE_BYTES), 1 << 30))

    def few_files(self, df: DataFrame) -> DataFrame:
        return df.coalesce(self.files)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(_CLEAN, None)
        try:
            self.spark.conf.set(_CLEAN, "true")
            self.few_files(df).write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before) if before else self.spark.conf.unset(_CLEAN)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_scratch(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Give the operator (docs, ..., scratch) its Scratch, checkpoint its compact result, and delete the
    tables it was made from, also when it fails."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: Any, **named: Any) -> DataFrame:
        scratch = Scratch(docs.sparkSession, docs)
        try:
            return scratch.few_files(operator(docs, *args, scratch=scratch, **named)).checkpoint()
        finally:
            scratch.drop()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def utf8(col: str = "text") -> Column:
    """UTF-8 bytes of the whole text; null counts as empty."""
    return F.encode(text_or_empty(col), "UTF-8")


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD_PATTERN)).cast("long")


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8"))


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed constants), element by element."""
    x = x ^ (x >> _S33)
    x *= _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


class WordHashes(dict):
    """64-bit hashes of words; the table is a cache of bounded size, never state that results need."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def whole_groups(batches, keys: int):
    """Tables of complete groups from batches that are sorted by their first ``keys`` columns (longs or ints)."""
    import pyarrow as pa

    held: list = []
    for b in batches:
        t = pa.Table.from_batches([*held, b])
        if not t.num_rows:
            continue
        cols = [t.column(i).to_numpy() for i in range(keys)]
        last = np.ones(t.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        held = t.slice(cut).combine_chunks().to_batches()
        if cut:
            yield t.slice(0, cut)
    if held:
        yield pa.Table.from_batches(held)


def group_cuts(table, keys: int) -> list[int]:
    """Row numbers at which the groups of a sorted table begin, and its end."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for i in range(keys):
        c = table.column(i).to_numpy()
        new |= c[1:] != c[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
