"""Corpus audit: counts against a planned inventory, duplicates, gaps, malformed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import dedupe_key
from textloom.operators.order import dense_violations, gaps, occurrence_suffix, repeated


def inventory(expected: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Every expected key with how many rows it has, and whether it has none."""
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    out = expected.join(found, key, "left")
    return out.withColumn("missing", F.col("found").isNull()).na.fill(0, ["found"]).select(*key, "found", "missing")


def planned(chapters: DataFrame, only: int | None = None, batch: int = 10) -> DataFrame:
    """chapters (book, n) -> book, chapter, batch: the planned inventory in batches of requests."""
    from pyspark.sql import Window

    rows = chapters.where(F.col("book") == only) if only is not None else chapters
    before = F.sum("n").over(Window.orderBy("book").rowsBetween(Window.unboundedPreceding, -1))  # one row a book
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where("n > 0")
    rows = rows.select("book", "before", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("chapter"))
    return rows.select("book", "chapter", F.floor((F.col("before") + F.col("chapter") - 1) / batch).cast("int").alias("batch"))


def audit(verses: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """verses (book, chapter, ref, ordinal, printed, deva), expected (book, chapter) -> detail frames and a summary row."""
    blank = F.trim(F.coalesce("deva", F.lit(""))) == ""
    keyed = occurrence_suffix(verses, ["ref"], [F.col("book"), F.col("chapter"), F.col("ordinal")])
    bodies, _ = repeated(verses.where(~blank).withColumn("body", dedupe_key("deva")), ["body"], "ref")
    out = {
        "missing_chapters": inventory(expected, verses, ["book", "chapter"]).where("missing"),
        "duplicate_refs": keyed.where("occurrence > 1").select("ref"),
        "empty": verses.where(blank).select("ref"),
        "malformed": verses.where(~F.col("ref").rlike(r"^\d+(\.\d+)*[a-z]?$")).select("ref"),
        "suffixed": verses.where(F.col("ref").rlike("[a-z]$")).select("ref"),
        "gaps": gaps(verses, ["book", "chapter"], "printed"),
        "sparse_ordinals": dense_violations(verses, ["book", "chapter"], [F.col("ordinal"), F.col("ref")], "ordinal").select("ref", "ordinal"),
        "leftover_markup": verses.where(F.col("deva").rlike(r"\{\{|\}\}|\[\[|\]\]|<[a-zA-Z/]")).select("ref"),
        "duplicate_bodies": bodies,
    }
    summary = verses.agg(F.count(F.lit(1)).alias("verses"))
    for name, df in list(out.items()):
        summary = summary.join(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return out | {"summary": summary}
