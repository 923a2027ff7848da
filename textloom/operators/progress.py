"""Reading activity: streaks, daily selection, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(days: DataFrame, user: str, day: str, today: Column) -> DataFrame:
    """Length of each user's run of consecutive days that ends today or yesterday (else 0)."""
    d = days.select(user, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(user).orderBy(day)))
    runs = d.withColumn("_i", island).groupBy(user, "_i").agg(F.count(F.lit(1)).alias("n"), F.max(day).alias("end"))
    alive = (F.col("end") <= today) & (F.col("end") >= F.date_sub(today, 1))
    return runs.groupBy(user).agg(F.max(F.when(alive, F.col("n")).otherwise(0)).alias("streak"))


def interval_lookup(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the half-open [start, end) of their key that holds them; null where none does.

    The axis is cut into bins of ``width``, and of its doubles for longer intervals, so that an interval lies in two
    bins at most, however long it is. A point looks into one bin of each width in use (64 at most): an equi-join, not a
    nested loop. Empty intervals hold nothing."""
    length = F.col(end) - F.col(start)
    cells = intervals.where(length > 0).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(width)))).cast("int"))
    size = lambda level: F.lit(width) * F.pow(F.lit(2.0), level)
    cells = cells.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size("_level")), F.floor((F.col(end) - 1) / size("_level"))))).withColumnRenamed(key, "_key")
    levels = cells.select(F.col("_level").alias("_l")).distinct()  # 64 at most, so they go to each task
    looks = points.join(F.broadcast(levels), F.lit(True)).withColumn("_b", F.floor(F.col(at) / size("_l")))
    hit = (looks[key] == cells["_key"]) & (looks["_l"] == cells["_level"]) & (looks["_b"] == cells["_bin"]) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    found = looks.join(cells, hit).drop("_bin", "_key", "_level", "_l", "_b")
    seen = found.select(F.col(key).alias("_k"), F.col(at).alias("_a")).distinct()
    missing = points.join(seen, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_a")), "left_anti")  # key and place decide
    return found.unionByName(missing, allowMissingColumns=True)


def loop_target(segments: DataFrame, verse: str, track: str, at_ms: int) -> DataFrame:
    """Where to seek when a verse is looped: the start of its first segment that has been passed."""
    x = segments.where((F.col("verse_id") == verse) & (F.col("track_id") == track) & (F.lit(at_ms) >= F.col("end_ms")))
    return x.orderBy("start_ms").limit(1).select(F.col("start_ms").alias("seek_ms"))


def upsert_progress(progress: DataFrame, reads: DataFrame, verses: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """updates (user_id, work_id, verse_id, at) -> progress, verse reads, and refused updates.

    Updates without a user, or whose verse is not in the work, are refused. verses (id, work_id, ref) are
    those that readers see, so that percents don't depend on who asks. The latest update of a work wins;
    the first read of a verse stays.
    """
    from textloom.functions.text import ref_parts
    from textloom.operators import merge, order

    placed = order.progress(verses.withColumn("parts", ref_parts("ref")), ["work_id"], [F.col("parts")])
    placed = placed.select(F.col("id").alias("verse_id"), "work_id", "percent")
    known = updates.join(placed, ["verse_id", "work_id"], "left")
    ok = F.col("user_id").isNotNull() & F.col("percent").isNotNull()
    good = known.where(ok)
    new = good.select("user_id", "work_id", "verse_id", "percent", F.col("at").alias("last_read_at"))
    done = merge.upsert_latest(progress, new, ["user_id", "work_id"], [F.col("last_read_at").desc(), F.col("verse_id")])
    seen = merge.upsert_first(reads, good.select("user_id", "verse_id", F.col("at").alias("read_at")), ["user_id", "verse_id"], [F.col("read_at")])
    return done, seen, known.where(~ok).select(*updates.columns)


def sync(local: DataFrame, server: DataFrame, key: list[str], at: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to push (dirty here), and the local table after the pull: clean tombstones purged, a strictly
    newer server row wins, and what was pushed is clean."""
    from textloom.operators import merge

    push = local.where("dirty")
    pulled = merge.last_writer_wins(merge.purge_tombstones(local), server, key, at, fields)
    return push, pulled.withColumn("dirty", F.lit(False))


def daily_pick(chapters: DataFrame, part: list[str], day: Column) -> DataFrame:
    """chapters (part..., ordinal, section_id, size): the section and offset of the day's verse, counted
    through all chapters in order."""
    from pyspark.sql import Window as W

    from textloom.functions.scalars import day_index
    from textloom.operators.order import running_offsets

    x = running_offsets(chapters, part, [F.col("ordinal")], "size")
    pick = day_index(day, F.sum("size").over(W.partitionBy(*part)))
    x = x.withColumn("pick", pick).where("pick >= first AND pick < last")
    return x.select(*part, "section_id", (F.col("pick") - F.col("first")).alias("offset"))


def resume_target(works: DataFrame, progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """work_id, section_id: where the reader stopped, else the first chapter, else null."""
    from textloom.operators.order import first_rows

    first = first_rows(chapters, ["work_id"], [F.col("ordinal")]).select("work_id", F.col("id").alias("_first"))
    at = progress.select("work_id", F.col("section_id").alias("_at"))
    return works.select("work_id").join(at, "work_id", "left").join(first, "work_id", "left").select("work_id", F.coalesce("_at", "_first").alias("section_id"))
