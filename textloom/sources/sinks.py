"""Writers: gated exports, key-value stores of bundles, chapters, embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.merge import upsert_latest
from textloom.sources import store


def export_bundles(bundles: DataFrame, uncleared: DataFrame, path: str) -> None:
    """The members of each work's bundle as JSON lines in a folder of its slug, those that all works share in one of their own;
    refused while any exported row lacks rights."""
    if uncleared.limit(1).count():
        raise PermissionError("rows without cleared rights are in the export")
    bundles.write.mode("overwrite").partitionBy("slug").json(path)


def kv_put(store: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert_latest(store, rows, ["key"], [F.col("value")])


def kv_get(store: DataFrame, key: str | None = None, prefix: str | None = None) -> DataFrame:
    return store.where(F.col("key") == key) if key is not None else store.where(F.col("key").startswith(prefix))


def remove_download(store: DataFrame, slug: str, chapter_keys: DataFrame) -> DataFrame:
    """Without the chapters of a work (keys by its contents) and without its own keys."""
    own = F.col("key").isin(f"toc:{slug}", f"meta:{slug}")
    for kind in ("edition", "section", "verse", "story", "mention", "cross_reference"):
        own = own | F.col("key").startswith(f"{kind}:{slug}:")
    return store.join(chapter_keys.select("key"), "key", "left_anti").where(~own)


def write_chapters(verses: DataFrame, path: str) -> None:
    """verses (book, chapter, ordinal, ...) as one JSON document a chapter, in folders by both."""
    fields = [c for c in verses.columns if c not in ("book", "chapter")]
    g = verses.groupBy("book", "chapter").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in fields if c != "ordinal"]))).alias("verses"))
    g.write.mode("overwrite").partitionBy("book", "chapter").json(path)


def write_manifest(verses: DataFrame, path: str) -> None:
    """verses (book, chapter, ...) -> one JSON line a book: its chapters in order with their numbers of verses, and the total."""
    n = verses.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("verses"))
    g = n.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", "verses"))).alias("chapters"), F.sum("verses").alias("total"))
    g.write.mode("overwrite").json(path)


def write_works(works: DataFrame, path: str) -> None:
    """works (slug, ...) as one JSON document a work, in a folder of its slug."""
    works.write.mode("overwrite").partitionBy("slug").json(path)


def write_markdown(verses: DataFrame, path: str) -> None:
    """verses (book, chapter, ordinal, ref, deva, ...) as one Markdown text a chapter, in folders by both: a heading and a
    numbered paragraph a verse."""
    line = F.concat(F.lit("**"), "ref", F.lit("** "), F.coalesce("deva", F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("v")))), lambda x: x["v"]), "\n\n")
    head = F.concat(F.lit("# "), F.col("book").cast("string"), F.lit("."), F.col("chapter").cast("string"), F.lit("\n\n"))
    g = verses.groupBy("book", "chapter").agg(lines.alias("v"))
    g.select("book", "chapter", F.concat(head, "v", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("book", "chapter").text(path)


def resumable_load(rows: DataFrame, key: str, path: str, size: int = 400) -> int:
    """Append rows to the table at ``path`` in batches of about ``size``, each at most once, and return how many batches
    were left to do. A batch is a range of hashes of ``key``; how many there are is kept beside the table by the first run, so
    a row is in the same batch after a failure, also if the input has grown meanwhile. The batches that are wholly written
    are those whose folder is there, as a batch's folder appears when the job commits."""
    spark = rows.sparkSession
    plan = f"{path.rstrip('/')}.batches"
    if not store.exists(spark, plan):
        made = f"{plan}-{uuid.uuid4().hex}"
        spark.createDataFrame([(max(1, -(-rows.count() // size)),)], "batches long").coalesce(1).write.parquet(made)
        if not store.publish(spark, made, plan):
            store.delete(spark, made)
    batches = spark.read.parquet(plan).first().batches
    placed = rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    if store.exists(spark, path):
        done = spark.read.parquet(path).select("batch").distinct()
        placed = placed.join(done, "batch", "left_anti")
    left = placed.select("batch").distinct().count()
    if left:
        placed.repartition("batch").write.mode("append").partitionBy("batch").parquet(path)
    return left


def embed(contents: DataFrame, model: Callable[[list[str]], list[list[float]]], name: str, batch: int = 64) -> DataFrame:
    """contents (id, ref, body) -> rows of embeddings by an injected model, called with ``batch`` texts at a time."""
    text = F.concat_ws(" ", "ref", "body")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"verse_content_id": part.id, "model": name, "chunk_index": 0, "chunk_text": part.chunk_text, "embedding": model(part.chunk_text.tolist())})

    return contents.select("id", text.alias("chunk_text")).mapInPandas(run, "verse_content_id string, model string, chunk_index int, chunk_text string, embedding array<float>")


def missing_embeddings(contents: DataFrame, done: DataFrame, model: str) -> DataFrame:
    return contents.join(done.where(F.col("model") == model).select(F.col("verse_content_id").alias("id")), "id", "left_anti")


def table(spark, path: str, columns: list[str], where: Column | None = None, order: list[Column] | None = None, limit: int = 1000):  # noqa: ANN001, ANN201
    """A scan as the table API gives it: projection, filter, order, and a cap of 1000 rows."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    df = df if order is None else df.orderBy(*order)
    return df.select(*columns).limit(min(limit, 1000))


def single(df: DataFrame):  # noqa: ANN201
    """The only row; more or fewer is an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{len(rows)} rows where one was asked for")
    return rows[0]


def maybe_single(df: DataFrame):  # noqa: ANN201
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise LookupError("several rows where at most one was asked for")
    return rows[0] if rows else None
