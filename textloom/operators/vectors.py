"""Vector index: inverted lists round k-means centres, as a table partitioned by list.

A search reads the partitions of some lists only. Which ones is decided from the centres, of which there are at most
``MOST_LISTS``: either the ``probes`` nearest (approximate; how many it takes for a recall of ``RECALL`` is measured when the
index is made), or all that can hold a vector of the least similarity asked for (exact): no vector of a list is nearer to
the query than the angle to its centre less the list's radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.scalars import cosine
from textloom.sources import store

#: Lists at most, and vectors that the centres are fitted on at most; every vector is in a list.
MOST_LISTS, SAMPLE = 4096, 50_000
#: The recall of the best BEST that the measured number of probes reaches, over so many vectors asked for.
RECALL, BEST, ASKED = 0.97, 20, 64


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # list, id, embedding
    centres: DataFrame  # list, centre, radius (of an angle), size, probes (the same in all rows)


def _norm(col: str) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def write_vectors(rows: DataFrame, id_col: str, path: str, lists: int | None = None, seed: int = 1) -> None:
    """rows (id, embedding; other columns ignored). Vectors that are null, empty, zero or not finite have no direction and are in no list;
    about the square root of their number is the number of lists, unless it is given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    norm = _norm("embedding")
    usable = rows.select(F.col(id_col).alias("id"), "embedding").withColumn("norm", norm).where("norm > 0 AND norm < double('Infinity')").drop("norm")
    n = usable.count()
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(n)))
    share = min(1.0, SAMPLE / max(1, n))
    drawn = usable if share == 1 else usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    vector = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    if n == 0:
        usable.withColumn("list", F.lit(0)).write.parquet(f"{path}/vectors")
        spark.createDataFrame([], "list int, centre array<double>, radius double, size long, probes int").write.parquet(f"{path}/centres")
        return
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=10, featuresCol="v", predictionCol="list").fit(drawn.withColumn("v", vector))
    placed = model.transform(usable.withColumn("v", vector)).select("id", "embedding", "list")
    placed.repartition("list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/vectors")
    rows_of = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = spark.createDataFrame(rows_of, "list int, centre array<double>")
    held = spark.read.parquet(f"{path}/vectors").join(F.broadcast(centres), "list")  # at most MOST_LISTS rows
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col("embedding"), F.col("centre")))))
    held = held.groupBy("list").agg(F.max(angle).alias("radius"), F.count(F.lit(1)).alias("size"))
    probes = _probes_needed(spark.read.parquet(f"{path}/vectors"), np.array([c for _, c in rows_of]))
    centres.join(held, "list").withColumn("probes", F.lit(probes)).write.parquet(f"{path}/centres")


def _angles(centre: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(centre @ q / (np.linalg.norm(centre, axis=1) * np.linalg.norm(q)), -1, 1))


def _probes_needed(vectors: DataFrame, centre: np.ndarray) -> int:
    """The least number of probes that finds RECALL of the exact best of ASKED of the vectors, compared with all."""
    asked = np.array([r.embedding for r in vectors.orderBy(F.xxhash64("id")).limit(ASKED).select("embedding").collect()], float)
    unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), float)
                near = unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                top = np.argsort(-near, axis=1, kind="stable")[:, :BEST]
                q, lists = np.repeat(np.arange(len(unit)), top.shape[1]), b.column(0).to_numpy()[top.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(lists.astype(np.int32)), pa.array(near[q, top.ravel()])], ["q", "list", "near"])

    found = vectors.select("list", "embedding").mapInArrow(best, "q int, list int, near double")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.col("near").desc(), "list"))
    found = found.withColumn("n", first).where(F.col("n") <= BEST).select("q", "list").collect()  # ASKED * BEST rows
    place = {q: np.argsort(np.argsort(_angles(centre, asked[q]), kind="stable")) for q in {r.q for r in found}}
    return int(np.quantile([place[r.q][r.list] + 1 for r in found], RECALL, method="higher"))


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres"))


def vectors_of(rows: DataFrame, id_col: str) -> VectorIndex:
    """The index of a table's column ``embedding``, made when it is first asked for."""
    path = store.derived(rows, f"vectors-{id_col}", lambda at: write_vectors(rows, id_col, at))
    return open_vectors(rows.sparkSession, path)


def lists_for(index: VectorIndex, vector: list[float], least: float, probes: int | str | None = None) -> list[int]:
    """The lists to read: the ``probes`` nearest ("measured": as many as RECALL takes), or all that can hold a
    similarity of ``least``."""
    q = np.asarray(vector, float)
    size = np.linalg.norm(q)
    rows = index.centres.collect()  # at most MOST_LISTS
    if not rows or not size:
        return []
    centre = np.array([r.centre for r in rows])
    angle = _angles(centre, q)
    if probes is not None:
        return [rows[i].list for i in np.argsort(angle, kind="stable")[: rows[0].probes if probes == "measured" else probes]]
    # similarities are compared after they are rounded to six digits
    reach = math.acos(max(-1.0, min(1.0, least - 1e-6))) + 1e-6
    return [r.list for r, a in zip(rows, angle, strict=True) if a - r.radius <= reach]


def nearest(index: VectorIndex, vector: list[float], k: int, least: float = -1.0, probes: int | str | None = None, gate: DataFrame | None = None) -> DataFrame:
    """id, embedding, similarity: the best k (1..50) from ``least`` on, by ``search.cosine_topk`` over the lists read. ``gate`` (id)
    holds the ids that count; it is applied inside the lists, before the best are taken."""
    from textloom.operators.search import cosine_topk

    rows = index.vectors.where(F.col("list").isin(lists_for(index, vector, least, probes)))
    if gate is not None:
        rows = rows.join(gate, "id", "left_semi")
    return cosine_topk(rows.drop("list"), vector, k, least, "id")
