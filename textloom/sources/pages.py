"""Saved answers of a wiki's page API (no network): one JSON file a request, on any file system Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MOVE = "array<struct<`from`: string, `to`: string>>"
_PAGE = "struct<title: string, missing: string, pageid: bigint, revid: bigint, revisions: array<struct<revid: bigint, slots: map<string, map<string, string>>, content: string, `*`: string>>>"


def read_saved_pages(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Rows (kind, source, target, title, pageid, revid, wikitext): pages, and the normalisations and
    redirects that lead to them. Pages come as a list or as an object by id; missing ones are left out."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    none = lambda *names: [F.lit(None).cast("long" if n.endswith("id") else "string").alias(n) for n in names]

    def moves(kind: str, key: str) -> DataFrame:
        x = files.select(F.explode(F.from_json(F.get_json_object("value", f"$.query.{key}"), _MOVE)).alias("m"))
        return x.select(F.lit(kind).alias("kind"), F.col("m.from").alias("source"), F.col("m.to").alias("target"), *none("title", "pageid", "revid", "wikitext"))

    pages = F.get_json_object("value", "$.query.pages")
    listed = F.when(F.startswith(pages, F.lit("[")), F.from_json(pages, f"array<{_PAGE}>")).otherwise(F.map_values(F.from_json(pages, f"map<string, {_PAGE}>")))
    p = files.select(F.explode(listed).alias("p")).where("p.missing IS NULL AND p.title IS NOT NULL").select("p.*", F.get("p.revisions", F.lit(0)).alias("r"))
    main = F.try_element_at("r.slots", F.lit("main"))
    text = F.coalesce(F.try_element_at(main, F.lit("content")), F.try_element_at(main, F.lit("*")), F.col("r.content"), F.col("r.`*`"))
    found = p.select(F.lit("page").alias("kind"), *none("source", "target"), "title", "pageid", F.col("r.revid").alias("revid"), text.alias("wikitext"))
    return moves("normalized", "normalized").unionByName(moves("redirect", "redirects")).unionByName(found)


def batches(titles: DataFrame, size: int = 10, a_part: int = 10_000) -> DataFrame:
    """Titles (title) in numbered requests of at most ``size``. Inventories of more than ``a_part`` titles are numbered
    in parts, so that no task holds them all."""
    from pyspark.sql import Window

    parts = max(1, -(-titles.count() // a_part))
    part = F.pmod(F.xxhash64("title"), F.lit(parts))
    n = F.row_number().over(Window.partitionBy(part).orderBy("title"))
    return titles.withColumn("batch", (F.floor((n - 1) / size) * parts + part).cast("int"))
