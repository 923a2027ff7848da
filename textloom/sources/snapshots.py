"""Loads of many tables at once: data folders first, then one rename publishes all of them.

Version n of a store is a manifest, the folder ``versions/n``: which data folder each table is in, a token, and notes (a high-water
mark, for one). Manifests are numbered without gaps and never replaced, so readers that resolve tables through the
newest one see a whole load or none of it, and of two writers that start from one version only one publishes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.merge import last_writer_wins, upsert_latest
from textloom.sources import store


class Conflict(RuntimeError):
    """Another writer has published the version that this one would have been."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: Mapping[str, str] = field(default_factory=dict)  # table: data folder
    token: str | None = None
    notes: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Snapshots:
    spark: SparkSession
    root: str

    def versions(self) -> list[int]:
        fs, where = store.file_system(self.spark, f"{self.root}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []

    def version(self, number: int | None = None) -> Version:
        """A version, the newest by default; version 0 is empty."""
        known = self.versions()
        if not known or number == 0:
            return Version()
        number = known[-1] if number is None else number
        text = self.spark.read.text(f"{self.root}/versions/{number}", wholetext=True).first().value
        return Version(number, **json.loads(text))

    def read(self, table: str, at: Version | None = None) -> DataFrame | None:
        folder = (at or self.version()).tables.get(table)
        return self.spark.read.parquet(folder) if folder else None

    def commit(self, tables: Mapping[str, DataFrame], base: Version | None = None, token: str | None = None, notes: Mapping[str, str] | None = None) -> Version:
        """Publish new contents of ``tables``; the others stay as in ``base`` (the newest version by default). A load whose
        ``token`` a version already carries is not published again."""
        base = base or self.version()
        if token is not None:
            for n in reversed(self.versions()):
                done = self.version(n)
                if done.token == token:
                    return done
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
        every = {**base.tables, **{name: f"{folder}/{name}" for name in tables}}
        new = Version(base.number + 1, every, token, {**base.notes, **(notes or {})})
        made = f"{self.root}/data/{uuid.uuid4().hex}"
        text = json.dumps({"tables": every, "token": token, "notes": dict(new.notes)})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(made)
        if not store.publish(self.spark, made, f"{self.root}/versions/{new.number}"):
            for left in (made, folder):
                store.delete(self.spark, left)
            raise Conflict(f"version {new.number} is there already")
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data that no version of the last ``keep`` names, also what failed loads have left; how many folders went."""
        fs, where = store.file_system(self.spark, f"{self.root}/data")
        if not fs.exists(where):
            return 0
        held = {f.rsplit("/", 2)[-2] for n in self.versions()[-keep:] for f in self.version(n).tables.values()}
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in held]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def load_tables(into: Snapshots, loaded: Mapping[str, DataFrame], keys: Mapping[str, list[str]], token: str | None = None, order: list[Column] | None = None) -> Version:
    """Upsert all tables of a load by their natural keys and publish them together. Refused while the load has rows of
    ``violations``."""
    bad = loaded.get("violations")
    if bad is not None and not bad.isEmpty():
        raise ValueError(f"the load breaks its rules: {[tuple(r) for r in bad.limit(5).collect()]}")
    base, merged = into.version(), {}
    for name, key in keys.items():
        old = into.read(name, base)
        new = loaded[name].dropDuplicates(key) if order is None else loaded[name]
        merged[name] = new if old is None else upsert_latest(old, new, key, order or [F.lit(0)])
    return into.commit(merged, base, token)


def pull(into: Snapshots, tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]], at: str, late: str = "0 seconds", push: Callable[[str, DataFrame], None] | None = None) -> Version:
    """One round of a client's sync, exactly once: what changed on the server since the persisted mark is merged, a strictly newer
    row wins, and rows and mark are published together, so a round that failed is simply run again.

    Tables hold ``at``, ``deleted`` and fields; a client's rows also ``dirty``. Tombstones come as rows. Rows that reach the
    server up to ``late`` after their time are met by looking back that far: merging a row twice changes nothing. ``push`` gets
    the dirty rows of each table first and must bear repetition; they are clean afterwards.
    """
    base, merged, marks = into.version(), {}, []
    mark = base.notes.get("mark")
    for name, rows in tables.items():
        since = rows if mark is None else rows.where(F.col(at) > F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {late}"))
        marks.append(since.agg(F.max(at).alias("m")))
        fields = [c for c in rows.columns if c not in (*keys[name], at)]
        mine = into.read(name, base)
        if mine is None:
            merged[name] = since.withColumn("dirty", F.lit(False))
            continue
        if push is not None:
            push(name, mine.where("dirty").drop("dirty"))
        merged[name] = last_writer_wins(mine.drop("dirty"), since, keys[name], at, fields).drop("origin").withColumn("dirty", F.lit(False))
    newest = [m for m in (x.select(F.col("m").cast("string")).first()[0] for x in marks) if m]
    return into.commit(merged, base, notes={"mark": max([*newest, *([mark] if mark else [])])} if newest or mark else {})


def sync_pull(tables: Mapping[str, DataFrame], uid: str | None, since: str | None, at: str, now: Column) -> DataFrame:
    """server_time, table, row (JSON): what a user owns and what changed later than ``since``, deletions included; of all tables in one
    result. Nothing for callers without an id."""
    out = None
    for name, rows in tables.items():
        own = rows.where(F.col("user_id") == F.lit(uid))
        own = own if since is None else own.where(F.col(at) > F.lit(since).cast(rows.schema[at].dataType))
        part = own.select(now.alias("server_time"), F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
