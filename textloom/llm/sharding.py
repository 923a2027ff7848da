"""Sharding by histogram sort: near-equal bytes a shard, with one exchange.

Rows have the key (hash of the text, doc_id, row number). Splitters start as unknown; each round counts
the exact bytes of the rows below 256 candidate boundaries inside every interval that still holds an
unsettled splitter, and narrows those intervals to one candidate bin, until each splitter is within
tolerance of its share. Only counts (at most 256 an unsettled splitter and round) come to the driver.
Equal texts share the first part of the key, so a boundary falls inside a group of copies only where
that group alone is too large, and then between doc_ids, or between rows that nothing tells apart.
Whole rows move once, to their final shard (``write_shards``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, text_or_empty, with_scratch

SIGN = -(2**63)
KEYS = ("k1", "k2", "k3")
DIGITS = 8 * len(KEYS)  # 64-bit parts in digits of 8 bits
#: Of one shard's share, in bytes.
TOLERANCE = 0.002


def _digit(level: int) -> Column:
    part, place = KEYS[level // 8], level % 8
    return F.shiftrightunsigned(F.col(part).bitwiseXOR(F.lit(SIGN)), 56 - 8 * place).bitwiseAND(F.lit(255)).cast("int")


def _starts_with(bits: int, level: int) -> Column:
    """Whether the first ``level`` digits of a row's key are those of ``bits``."""
    x, out = bits << 8 * (DIGITS - level), F.lit(True)
    for i, part in enumerate(KEYS):
        n = min(8, level - 8 * i)
        if n > 0:
            v = x >> 64 * (len(KEYS) - 1 - i) & 2**64 - 1
            same = F.col(part) == F.lit(v - 2**63) if n == 8 else F.shiftrightunsigned(F.col(part).bitwiseXOR(F.lit(SIGN)), 64 - 8 * n) == F.lit(v >> 64 - 8 * n)
            out = out & same
    return out


@dataclass
class Splitter:
    target: float
    bits: int = 0  # leading digits of the bin that holds it
    level: int = 0
    below: int = 0  # bytes of the rows below that bin
    settled: bool = False

    def bound(self) -> tuple[int, ...]:
        """The first key of the upper side, as signed parts."""
        x = min(self.bits << 8 * (DIGITS - self.level), 2 ** (8 * DIGITS) - 1)
        return tuple((x >> 64 * i & 2**64 - 1) - 2**63 for i in reversed(range(len(KEYS))))


def find_splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """rows (k1, k2, k3, size) -> shards - 1 lower bounds of the upper shards, ascending.

    A splitter settles when the bytes below it are within tolerance of its target, or when its bin
    holds one row, at the nearer side of that row.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    found = [Splitter(total * i / shards) for i in range(1, shards)]
    slack = tolerance * total / shards
    for level in range(DIGITS):
        open_ = sorted({s.bits for s in found if not s.settled})
        if not open_:
            break
        at = F.lit(0)
        if level:
            at = F.when(_starts_with(open_[0], level), 0)
            for i, bits in enumerate(open_[1:], 1):
                at = at.when(_starts_with(bits, level), i)
        counts: dict[int, list[tuple[int, int, int]]] = {i: [] for i in range(len(open_))}
        bins = rows.select(at.alias("at"), _digit(level).alias("digit"), "size").where("at IS NOT NULL")
        for i, digit, b, n in bins.groupBy("at", "digit").agg(F.sum("size"), F.count(F.lit(1))).collect():
            counts[i].append((digit, b, n))
        for s in (s for s in found if not s.settled):
            below, chosen, held, n = s.below, 0, 0, 0
            for digit, b, n_ in sorted(counts[open_.index(s.bits)]):
                below, chosen, held, n = below + held, digit, b, n_
                if below + held > s.target:
                    break
            after, last = below + held, n <= 1 or level == DIGITS - 1
            s.bits, s.level = s.bits << 8 | chosen, level + 1
            if abs(after - s.target) < abs(s.target - below):
                near, up = after, 1
            else:
                near, up = below, 0
            if last or abs(near - s.target) <= slack:
                s.bits, s.below, s.settled = s.bits + up, near, True
            else:
                s.below = below
    return sorted(s.bound() for s in found)


def _keyed(docs: DataFrame) -> list[Column]:
    k2 = F.coalesce(F.col("doc_id").cast("long"), F.lit(SIGN))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return [F.xxhash64("text").alias("k1"), k2.alias("k2"), F.monotonically_increasing_id().alias("k3"), size.alias("size")]


def _shard(splitters: list[tuple[int, ...]]) -> Column:
    shard = F.lit(0)
    for a, b, c in splitters:
        last = (F.col("k2") > b) | ((F.col("k2") == b) & (F.col("k3") >= c))
        shard = shard + F.when((F.col("k1") > a) | ((F.col("k1") == a) & last), 1).otherwise(0)
    return shard.cast("int")


@with_scratch
def histogram_sort(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text plus 1 (null text: 1). Slots number the rows of a shard
    without gaps, by the hash of the text, then doc_id; null ids sort first. Equal rows (same text, same
    id) are told apart by where they were read, so however many there are they split like others.
    Fewer rows than shards leave shards empty; an empty table gives an empty result.
    """
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    rows = scratch.keep(docs.select("doc_id", crc.alias("text_crc32"), *_keyed(docs)))
    rows = rows.withColumn("shard", _shard(find_splitters(rows, shards, tolerance)))
    order = ["shard", *KEYS]
    rows = scratch.keep(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))  # at most ranges + shards rows
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEYS)) - 1
    out = rows.withColumn("place", place).join(F.broadcast(starts), ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = TOLERANCE) -> None:
    """Write all columns of docs to a folder for each shard, rows in the order of histogram_sort. Splitters are
    found on narrow rows, then whole rows are exchanged once. Rows are as in histogram_sort; an empty
    table gives an empty folder. docs may not have columns named k1, k2, k3 or shard."""
    clash = {*KEYS, "shard"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    scratch = Scratch(docs.sparkSession)
    try:
        splitters = find_splitters(scratch.keep(docs.select(*_keyed(docs))), shards, tolerance)
    finally:
        scratch.drop()
    rows = docs.withColumns({k: c for k, c in zip(KEYS, _keyed(docs), strict=False)})
    rows = rows.withColumn("shard", _shard(splitters)).repartitionByRange("shard", *KEYS)
    rows.sortWithinPartitions("shard", *KEYS).drop(*KEYS).write.partitionBy("shard").parquet(path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
