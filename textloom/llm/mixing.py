"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document of source s is expected ``target_s / source_size_s`` times. The whole part of that is
taken with certainty as whole copies; the rest is an inclusion probability p. Documents are ranked by
Pareto's q = odds(u) / odds(p), u uniform from the id, and the lowest ranks are taken until the words
still missing from the target are filled (the last document only if it brings the sum nearer), so the
size of each sample is fixed in words. Where p is 0, and for documents without words, nothing is drawn.

The cut is found without gathering a source in one task: words are summed by (source, coarse bin of
q), the bin that holds the cut is refined once more, and only the few ranks of one fine bin are
ordered exactly. What results is one row a source, its plan; each document is then decided where it
lies. A source that holds a third of all rows costs the same, and so do any number of sources: their
order, too, is made of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, with_scratch, word_count

COARSE, FINE = 1024, 4096
#: Tables of one row a source are broadcast up to this many rows (some 10 MB), shuffled beyond.
FEW = 50_000
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def uniform(id_col: Column, text_col: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of an MD5, so that any engine can repeat it. Rows without an id draw by their text."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(seed), F.when(id_col.isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """rows with ``sums`` over the rows before each, in a total order: ranges of it are summed apart, and
    a window over one row a range (at most spark.sql.shuffle.partitions of them) gives where each begins."""
    ranged = scratch.keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = parts.select("_range", *[F.coalesce(F.sum(n).over(first), F.lit(0)).alias(f"_{n}") for n in sums])
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.join(F.broadcast(parts), "_range")
    return ranged.select(*rows.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(n) for n, c in sums.items()])


@with_scratch
def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT, *, scratch: Scratch) -> DataFrame:
    """source, source_size (one row a source) -> also target: shares by cycled weights in code point order
    (null last), capped at ``cap`` times the source's size, excess reshared by weight until none is above.

    Reshared targets have the form min(cap * size, level * weight); with sources in ascending order
    of cap * size / weight the level is the largest of (what is left) / (weights left). A source of size 0
    has target 0; an empty table gives an empty result.
    """
    by_name = F.col("source").asc_nulls_last()
    x = _running(sizes.select("source", "source_size"), [by_name], {"place": F.lit(1)}, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    x = x.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    x = scratch.keep(x.withColumn("at", F.col("most") / F.col("weight")))
    total, all_weight = x.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    run = _running(x, [F.col("at"), by_name], {"full": F.col("most"), "heavy": F.col("weight")}, scratch)
    level = run.agg(F.max((F.lit(total) - F.col("full")) / (F.lit(all_weight) - F.col("heavy")))).first()[0]
    return x.select("source", "source_size", F.least(F.col("most"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def _cut(rows: DataFrame, by: str) -> DataFrame:
    """Per source: the first bin at which the words taken so far exceed ``rem``, and the words before it."""
    bins = rows.groupBy("source", by).agg(F.sum("size").alias("words"), F.max("rem").alias("rem"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(by))
    bins = bins.withColumn("upto", upto).where("upto > rem")
    first = F.min(F.struct(F.col(by), (F.col("upto") - F.col("words")).alias("b")))
    return bins.groupBy("source").agg(first.alias("f")).select("source", F.col(f"f.{by}").alias(f"{by}_cut"), F.col("f.b").alias(f"{by}_before"))


def _with(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """Left join with one row a source; rows stay where they are if the sources are few (counted)."""
    right = right.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if few else right
    return left.join(right, left["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def _ranked(x: DataFrame) -> DataFrame:
    """x (u, p) -> also q and its bins, null where p is 0."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    x = x.withColumn("q", F.when(F.col("p") > 0, odds))
    r = F.col("q") / (1 + F.col("q")) * COARSE
    coarse = F.least(F.floor(r), F.lit(COARSE - 1)).cast("int")
    return x.withColumn("coarse", coarse).withColumn("fine", F.least(F.floor((r - F.col("coarse")) * FINE), F.lit(FINE - 1)).cast("int"))


def _key() -> Column:
    return F.struct(F.col("q").alias("q"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("size").alias("size"))


def _plan(base: DataFrame, weights: tuple[int, ...], cap: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """base (doc_id, source, size, u) -> one row a source: its size, target, whole copies, p, and the cut of its ranks
    (bins, and the last key taken in the bin of the cut); and whether the sources are few."""
    sizes = scratch.keep(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = sizes.count() <= FEW
    plan = source_targets(sizes, weights, cap)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(expected)).withColumn("p", expected - F.col("whole"))
    plan = plan.withColumn("rem", F.col("target") - F.col("whole") * F.col("source_size"))
    x = _ranked(_with(base.where("size > 0"), plan.select("source", "p", "rem"), few).where("p > 0"))
    coarse = scratch.keep(_cut(x, "coarse"))
    edge = _with(x, coarse, few).where("coarse = coarse_cut").withColumn("rem", F.col("rem") - F.col("coarse_before"))
    edge = scratch.keep(edge.select("source", "doc_id", "size", "rem", "q", "fine"))
    fine = scratch.keep(_cut(edge, "fine"))
    last = _with(edge, fine, few).where("fine = fine_cut").withColumn("key", _key())
    last = last.groupBy("source", "key").agg(F.sum("size").alias("words"), F.max(F.col("rem") - F.col("fine_before")).alias("rem"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("before", F.coalesce(before, F.lit(0))).where("before + words / 2 <= rem")
    last = last.groupBy("source").agg(F.max("key").alias("last"))
    for cut in (coarse.select("source", "coarse_cut"), fine.select("source", "fine_cut"), last):
        plan = _with(plan, cut, few)
    return scratch.keep(plan.drop("rem")), few


@with_scratch
def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT, seed: str = "|mix", *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text, source; other columns ignored) -> one row a source, for ``copies``.

    Null and empty texts have no words and add nothing; a null source is a source, the last one. Repeated rows count each
    time. An empty table gives no rows.
    """
    base = docs.select("doc_id", "source", word_count().alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    return _plan(scratch.keep(base), weights, cap, scratch)[0]


def copies(docs: DataFrame, plan: DataFrame, seed: str = "|mix", few: bool | None = None) -> DataFrame:
    """docs -> doc_id, source, size, source_size, target, copies and ``row``, all columns of docs under their own names, so none of
    them clashes. ``plan`` is that of the same docs.

    Rows are kept one by one, null ids and repeated rows too; rows of one source with equal ids, texts and sizes are taken alike.
    Documents without words get no copies. An empty table gives no rows.
    """
    few = plan.count() <= FEW if few is None else few
    x = docs.select("doc_id", "source", word_count().alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _decided(x, plan, few)


def _decided(x: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    x = _ranked(_with(x, plan, few))
    at_fine = F.coalesce(_key() <= F.col("last"), F.lit(False))
    at_coarse = F.coalesce(F.col("fine") < F.col("fine_cut"), F.lit(True)) | ((F.col("fine") == F.col("fine_cut")) & at_fine)
    below = F.col("coarse_cut").isNull() | (F.col("coarse") < F.col("coarse_cut")) | ((F.col("coarse") == F.col("coarse_cut")) & at_coarse)
    extra = F.when((F.col("p") > 0) & below, 1).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0)).cast("long").alias("copies")
    return x.select("doc_id", "source", "size", "source_size", "target", taken, *[c for c in ("row",) if c in x.columns])


@with_scratch
def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT, seed: str = "|mix", *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text, source; other columns ignored) -> doc_id, size, source_size, target, taken, copies.

    Null text has size 0; null sources form one source, ranked last; a null id draws by its text.
    Rows of one source with equal ids and sizes (for null ids, equal texts) draw alike and are taken
    alike. A source without words has target 0, and documents without words are taken 0 times. An
    empty table gives an empty result.
    """
    base = scratch.keep(docs.select("doc_id", "source", word_count().alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u")))
    plan, few = _plan(base, weights, cap, scratch)
    out = _decided(base, plan, few)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pareto_mix(docs).drop("copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix' || CASE WHEN doc_id IS NULL THEN coalesce(text, '') ELSE '' END), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(e) AS whole, e - floor(e) AS p, target - floor(e) * source_size AS rem FROM x),
z AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 'inf'::DOUBLE END AS q FROM y),
g AS (SELECT source, q, doc_id, size, sum(size) AS words FROM z WHERE p > 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT z.doc_id, z.size, z.source_size, z.target, CAST(z.size * (whole + CASE WHEN p > 0 AND before + words / 2.0::DOUBLE <= rem THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z LEFT JOIN r ON z.source IS NOT DISTINCT FROM r.source AND z.q = r.q AND z.doc_id IS NOT DISTINCT FROM r.doc_id AND z.size = r.size
"""
