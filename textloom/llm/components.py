"""Connected components by alternating large-star and small-star steps, in DataFrame operations.

Up to FEW distinct edges (some 5 MB, counted first) are joined in one task instead, which spares the rounds; the
result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch

FEW = 300_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = down.join(least, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        ids = np.array(sorted(up), np.int64)
        found = np.array([root(x) for x in ids.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], ["id", "component"])

    return edges.repartition(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """edges (a, b), undirected -> id, component: the least id that each id reaches. Ids without an
    edge are absent. Each round halves what is far from its least id, so rounds grow with the
    logarithm of the longest path; only a count and a checksum come to the driver."""
    edges = scratch.keep(edges.select("a", "b").where("a != b").distinct())
    if edges.count() <= few:
        return scratch.keep(_joined(edges))
    last = None
    while True:
        edges = scratch.keep(_small(_large(edges)))
        now = _mark(edges)
        if now == last or not now[0]:
            break
        last = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
