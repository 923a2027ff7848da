"""Upserts, merges and change capture over plain tables, keyed and idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.order import first_rows


def upsert_latest(current: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """do update: within the batch the first row under ``order`` wins, and over the current row."""
    batch = first_rows(batch, key, order)
    return current.join(batch.select(*key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def upsert_first(current: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """do nothing: rows whose key exists stay as they are."""
    fresh = first_rows(batch, key, order).join(current.select(*key), key, "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge of maps; keys of ``new`` win, null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects: members of ``new`` replace those of ``old``, values of any type are kept as they are;
    null and what is no object count as empty. Members come in the order of their names."""
    kind, none = "map<string, variant>", F.map_from_entries(F.array().cast("array<struct<key: string, value: variant>>"))
    members = lambda c: F.coalesce(F.from_json(c, kind), none)
    a, b = members(old), members(new)
    rest = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    joined = F.map_concat(rest, b)
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1)  # noqa: E731 - quoted as JSON quotes it
    member = lambda k: F.concat(name(k), F.lit(":"), F.to_json(F.element_at(joined, k)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(joined)), member), ","), F.lit("}"))


def merge_prefer(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], override: tuple[str, ...] = (), keep_old: bool = True) -> DataFrame:
    """Full outer merge: an old value, where there is one, wins field by field; ``override`` fields
    follow the old row even if null. Old rows without a new one stay only with ``keep_old``."""
    o = old.select(*key, *[F.col(f).alias(f"_o_{f}") for f in fields], F.lit(True).alias("_o"))
    n = new.select(*key, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_n"))
    out = o.join(n, key, "full" if keep_old else "right")
    pick = lambda f: F.when(F.col("_o"), F.col(f"_o_{f}")).otherwise(F.col(f"_n_{f}")) if f in override else F.coalesce(f"_o_{f}", f"_n_{f}")
    return out.select(*key, *[pick(f).alias(f) for f in fields])


def local_wins(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    return local.unionByName(remote.join(local.select(key), key, "left_anti"), allowMissingColumns=True)


def last_writer_wins(local: DataFrame, server: DataFrame, key: list[str], at: str, fields: list[str]) -> DataFrame:
    """A strictly newer server row replaces the local one; the source is told."""
    a = local.select(*key, F.col(at).alias("_l"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = server.select(*key, F.col(at).alias("_s"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    newer = F.col("_l").isNull() | F.coalesce(F.col("_s") > F.col("_l"), F.lit(False))
    cols = [F.when(newer, F.col(f"_s_{f}")).otherwise(F.col(f"_l_{f}")).alias(f) for f in fields]
    return a.join(b, key, "full").select(*key, F.when(newer, F.col("_s")).otherwise(F.col("_l")).alias(at), *cols, F.when(newer, "server").otherwise("local").alias("origin"))


def diff_snapshots(old: DataFrame, new: DataFrame, key: list[str], actor: str) -> DataFrame:
    """Audit rows: I, U or D with both row images as JSON; unchanged rows give none."""
    image = lambda df, n: df.select(*key, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(n))
    both = image(old, "old_data").join(image(new, "new_data"), key, "full")
    action = F.when(F.col("old_data").isNull(), "I").when(F.col("new_data").isNull(), "D").when(F.col("old_data") != F.col("new_data"), "U")
    return both.withColumn("action", action).where("action IS NOT NULL").withColumn("actor", F.lit(actor))


def count_deltas(log: DataFrame, field: str) -> DataFrame:
    """value, delta: by how much each value of ``field`` gains and loses rows by an audit log (action, old_data, new_data)."""
    ends = F.array(
        F.struct(F.get_json_object("old_data", f"$.{field}").alias("value"), F.lit(-1).alias("delta")),
        F.struct(F.get_json_object("new_data", f"$.{field}").alias("value"), F.lit(1).alias("delta")),
    )
    x = log.select(F.explode(ends).alias("e")).select("e.*").where("value IS NOT NULL")
    return x.groupBy("value").agg(F.sum("delta").cast("long").alias("delta")).where("delta <> 0")


def keep_counts(rows: DataFrame, key: str, count: str, log: DataFrame, field: str) -> DataFrame:
    """rows with their ``count`` brought up to date by the log alone; nothing is counted again. Values that no row has are left out."""
    deltas = count_deltas(log, field).select(F.col("value").cast(rows.schema[key].dataType).alias(key), "delta")
    return rows.join(deltas, key, "left").withColumn(count, F.coalesce(count, F.lit(0)) + F.coalesce("delta", F.lit(0))).drop("delta").select(*rows.columns)


def touch(changed: DataFrame, at: Column) -> DataFrame:
    return changed.withColumn("updated_at", at)


def delta_since(df: DataFrame, at: str, since: str | None, deleted: str | None = None) -> DataFrame:
    """Rows later than the high-water mark (all for none), tombstones included and marked."""
    out = df if since is None else df.where(F.col(at) > F.lit(since).cast(df.schema[at].dataType))
    return out.withColumn("is_deleted", F.col(deleted) if deleted else F.lit(False))


def pending_targets(wanted: DataFrame, known: DataFrame, target: str, source: str) -> DataFrame:
    """Targets that do not exist yet, by source; computed anew each time, so resolved ones vanish."""
    missing = wanted.join(known.select(target).distinct(), target, "left_anti")
    return missing.groupBy(source).agg(F.array_sort(F.collect_set(target)).alias("pending"))


def soft_delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marked = df.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    gone = F.coalesce("_gone", F.lit(False))
    return marked.withColumns({"deleted": F.col("deleted") | gone, "dirty": F.col("dirty") | gone}).drop("_gone")


def purge_tombstones(df: DataFrame) -> DataFrame:
    return df.where(~(F.col("deleted") & ~F.col("dirty")))


def newest(df: DataFrame, at: str, tie: str, most: int, text: str, length: int) -> DataFrame:
    """A capped newest-first log with clipped messages."""
    return df.withColumn(text, F.substring(text, 1, length)).orderBy(F.col(at).desc(), F.col(tie).desc()).limit(most)


def guarded_updates(rows: DataFrame, changes: DataFrame, key: str, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """Applied table and refused changes: ``allowed`` is judged on the change joined to its row."""
    judged = changes.join(rows, key).withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    fields = [c for c in changes.columns if c != key]
    good = judged.where("_ok").select(key, *[F.col(c) for c in fields])
    bad = judged.where("NOT _ok").select(key, *fields)
    keep = [c for c in rows.columns if c != key]
    to = {f.removeprefix("new_"): f for f in fields}
    out = rows.join(good, key, "left").select(key, *[F.coalesce(to[c], c).alias(c) if c in to else F.col(c) for c in keep])
    return out, bad


def is_distinct(a: Column, b: Column) -> Column:
    """``a is distinct from b``: nulls are equal to each other and to nothing else."""
    return ~a.eqNullSafe(b)
