"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ) with exact confirmation.

Each unit vector o is rotated and kept as the signs of its coordinates with one stored correction
factor f = <signs / sqrt(D), o>. For a second vector q, in 4-bit quantised form, <signs / sqrt(D), q> / f
estimates <o, q> without bias, and sqrt((1 - f^2) / f^2 / (D - 1)) scales its error. A pair whose
estimate plus EPSILON of those errors stays below the threshold is dropped; every other pair is
computed again in double precision from the vectors, so nothing below the threshold is linked.

Equal vectors of a label are one class, which its least vec_id stands for; its members link with each
other and with whatever it links with. So a group of copies costs one vector. Pairs of classes are only
looked for inside buckets: vectors of one label that share one of L keys of k signs of random
projections. k grows with the logarithm of the largest label's classes, L follows so that a pair at the
threshold shares no bucket with probability MISS. A pair counts in the first band that it shares, so
links need no deduplication. Buckets of up to DENSE vectors emit their few surviving pairs, whose
vectors are then fetched. In larger ones, blocks of vectors meet in pairs of blocks, and only link
counts per vector and a spanning forest leave the task; a group of near copies is never expanded into
pairs, and no task holds more than two blocks. As each of n near copies has its own number of links,
they are all compared: n * n / BLOCK rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import group_cuts, Scratch, whole_groups, with_scratch
from textloom.llm.components import components

COSINE = 0.93
MISS = 1e-4
EPSILON = 2.5
DENSE, BLOCK = 64, 512


def bands_for(largest: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Signs a key, and keys, for labels of up to ``largest`` vectors."""
    k = min(24, max(6, round(math.log2(max(largest, 1) / 4 + 1))))
    agree = (1 - math.acos(cosine) / math.pi) ** k
    return k, math.ceil(math.log(miss) / math.log1p(-agree))


def rotation(dim: int) -> np.ndarray:
    """D x dim, orthonormal columns, D at least 64 and a multiple of 64."""
    d = max(64, -(-dim // 64) * 64)
    return np.linalg.qr(np.random.default_rng(dim * 7 + 1).standard_normal((d, d)))[0][:, :dim]


def projections(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(dim * 7 + 2).standard_normal((n, dim))


def code_of(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, correction factors, and 4-bit coordinates with their lowest value and step."""
    r = units @ turn.T
    d = r.shape[1]
    factor = np.abs(r).sum(axis=1) / math.sqrt(d)
    low = r.min(axis=1)
    step = np.maximum((r.max(axis=1) - low) / 15, 1e-30)
    dither = np.random.default_rng(d).random(d)
    q = np.minimum(15, np.floor((r - low[:, None]) / step[:, None] + dither)).astype(np.uint8)
    return np.packbits(r >= 0, axis=1), factor, q[:, ::2] << 4 | q[:, 1::2], low, step


def estimates(code: np.ndarray, factor: np.ndarray, query: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All-pairs estimates within a block (mean of both directions) and their upper confidence bounds."""
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    d = signs.shape[1]
    q = np.empty(signs.shape, np.float32)
    q[:, ::2], q[:, 1::2] = query >> 4, query & 15
    q = q * step[:, None].astype(np.float32) + low[:, None].astype(np.float32)
    one = signs @ q.T / (math.sqrt(d) * factor[:, None])
    error = np.sqrt((1 - np.minimum(factor, 1) ** 2) / factor**2 / (d - 1) + (step / factor) ** 2 / 12)
    both = (one + one.T) / 2
    return both, both + EPSILON * np.maximum.outer(error, error)


def unit_vectors(values: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows can link, and their unit vectors: not null or zero, all components finite."""
    ok, out = np.zeros(len(values), bool), []
    for i, v in enumerate(values):
        if v and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top  # keeps the norm in range
                out.append(x / math.sqrt(float(x @ x)))
                ok[i] = True
    return ok, out


CODED = "vec_id long, group long, m long, dim int, unit binary, code binary, factor double, query binary, low double, step double, bands binary"
LEAN = ("vec_id", "group", "m", "code", "factor", "query", "low", "step", "bands")


def _encode(vectors: DataFrame, k: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in batches:
            ok, units = unit_vectors(b.column(3).to_pylist())
            if not units:
                continue
            ids, group, m = (b.column(i).to_numpy()[ok] for i in (0, 1, 2))
            size = np.array([len(u) for u in units])
            for dim in np.unique(size).tolist():
                if dim not in known:
                    known[dim] = rotation(dim), projections(dim, k * bands)
                i = np.flatnonzero(size == dim)
                u = np.stack([units[j] for j in i])
                code, factor, query, low, step = code_of(u, known[dim][0])
                signs = (u @ known[dim][1].T >= 0).reshape(len(u), bands, k)
                keys = (signs * (1 << np.arange(k))).sum(axis=2).astype("<u4")
                raw = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
                cols = [pa.array(ids[i]), pa.array(group[i]), pa.array(m[i]), pa.array(np.full(len(i), dim), pa.int32()), raw(u), raw(code), pa.array(factor), raw(query), pa.array(low), pa.array(step), raw(keys)]
                yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in CODED.split(", ")])

    return vectors.mapInArrow(run, CODED)


def _bucket_rows(coded: DataFrame, bands: int) -> DataFrame:
    schema = "vec_id long, group long, dim int, band int, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u4").astype(np.int64)
                i = pa.array(np.repeat(np.arange(b.num_rows), bands))
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(i) for k in range(3)], pa.array(np.tile(np.arange(bands), b.num_rows), pa.int32()), pa.array(keys)], [x.split(" ")[0] for x in schema.split(", ")])

    rows = coded.select("vec_id", "group", "dim", "bands").mapInArrow(run, schema)
    return rows.select("vec_id", "band", F.xxhash64("group", "dim", "band", "key").alias("bucket"))


def _columns(t: pa.Table, names: dict[str, int]) -> dict[str, np.ndarray]:
    out = {}
    for name, i in names.items():
        c = t.column(i)
        if pa.types.is_binary(c.type):
            x = c.to_pylist()
            kind = {"unit": np.float64, "bands": "<u4"}.get(name, np.uint8)
            out[name] = np.frombuffer(b"".join(x), kind).reshape(len(x), -1)
        else:
            out[name] = c.to_numpy()
    return out


def _candidates(x: dict[str, np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the codes do not rule out and that share no earlier band."""
    _, upper = estimates(x["code"], x["factor"], x["query"], x["low"], x["step"])
    i, j = np.nonzero(np.triu(upper >= COSINE, 1))
    ok = (x["group"][i] == x["group"][j]) & (x["vec_id"][i] != x["vec_id"][j])
    if band and len(i):
        ok &= ~(x["bands"][i, :band] == x["bands"][j, :band]).any(axis=1)
    return i[ok], j[ok]


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs of the buckets that fit one task."""
    rows = rows.select("bucket", "band", *LEAN).repartition("bucket").sortWithinPartitions("bucket")
    names = {n: i + 2 for i, n in enumerate(LEAN)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            cuts, band = group_cuts(t, 1), t.column(1).to_numpy()
            x = _columns(t, names)
            a, z = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                i, j = _candidates({n: v[s:e] for n, v in x.items()}, int(band[s]))
                a.append(x["vec_id"][s + i])
                z.append(x["vec_id"][s + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs at or above the threshold, from their vectors in double precision."""
    rows = pairs.join(units.select(F.col("vec_id").alias("a"), F.col("unit").alias("u")), "a").join(units.select(F.col("vec_id").alias("b"), F.col("unit").alias("v")), "b").select("a", "b", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = np.array([float(np.frombuffer(u) @ np.frombuffer(v)) for u, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], np.float64)
            yield b.select([0, 1]).filter(pa.array(cos >= COSINE, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on n nodes."""
    up, out = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _dense(rows: DataFrame, units: DataFrame) -> DataFrame:
    """kind 0: (a = vector, b = members of the classes it links with in a block pair); kind 1: (a, b) spanning links."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    rows = rows.withColumn("side", F.when(F.col("block") > F.col("other"), 1).otherwise(0)).withColumn("within", (F.col("block") == F.col("other")).cast("int"))
    rows = rows.join(units, "vec_id").select("bucket", "part", "band", "side", "within", *LEAN, "unit")
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    names = {n: i + 5 for i, n in enumerate((*LEAN, "unit"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            cuts = group_cuts(t, 2)
            kind, a, b = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                g = t.slice(s, e - s)
                x = _columns(g, names)
                side, within = g.column(3).to_numpy(), g.column(4).to_numpy()
                i, j = _candidates(x, int(g.column(2)[0].as_py()))
                ok = (side[i] != side[j]) | (within[i] == 1)
                i, j = i[ok], j[ok]
                if len(i):
                    ok = (x["unit"] @ x["unit"].T)[i, j] >= COSINE
                    i, j = i[ok], j[ok]
                links = np.bincount(np.concatenate([i, j]), x["m"][np.concatenate([j, i])], minlength=e - s).astype(np.int64)
                for k in np.flatnonzero(links).tolist():
                    kind.append(0)
                    a.append(int(x["vec_id"][k]))
                    b.append(int(links[k]))
                for p, q in forest(e - s, i, j):
                    kind.append(1)
                    a.append(int(x["vec_id"][p]))
                    b.append(int(x["vec_id"][q]))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    return rows.mapInArrow(run, "kind int, a long, b long")


@with_scratch
def near_vectors(vectors: DataFrame, *, scratch: Scratch) -> DataFrame:
    """vectors (vec_id, embedding, label; other columns ignored) -> vec_id, n_links, component_id, kept.

    Null labels, null or zero vectors, and vectors with null or non-finite components link with
    nothing; vectors of different lengths never link. A null vec_id links with nothing, has a null
    component_id and is kept. vec_id names one vector: rows that repeat it are one vector (the one
    with the least values) and each is returned. An empty table gives an empty result.
    """
    every = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    usable = every.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", F.xxhash64("x.label").alias("group"), "x.embedding")
    same = ["group", "e1", "e2"]
    usable = scratch.keep(usable.withColumns({"e1": F.xxhash64("embedding"), "e2": F.xxhash64(F.lit(1), "embedding")}))
    classes = usable.groupBy(*same).agg(F.min(F.struct("vec_id", "embedding")).alias("x"), F.count(F.lit(1)).alias("m"))
    classes = scratch.keep(classes.select(*same, F.col("x.vec_id").alias("rep"), "m", "x.embedding"))
    k, bands = bands_for(classes.groupBy("group").count().agg(F.max("count")).first()[0] or 0)
    coded = scratch.keep(_encode(classes.select(F.col("rep").alias("vec_id"), "group", "m", "embedding"), k, bands))
    placed = scratch.keep(_bucket_rows(coded, bands))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = scratch.keep(placed.join(sizes, "bucket"))
    lean, units = coded.select(*LEAN), coded.select("vec_id", "unit")
    pairs = _small_pairs(rows.where(F.col("n") <= DENSE).join(lean, "vec_id"))
    links = scratch.keep(_exact(pairs, units))
    dense = scratch.keep(_dense(rows.where(F.col("n") > DENSE).join(lean, "vec_id"), units))
    found = components(links.unionByName(dense.where("kind = 1").select("a", "b")), scratch)
    weight = coded.select("vec_id", "m")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("vec_id")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("vec_id")))
    counts = ends.join(weight, "vec_id").select("id", "m").unionByName(dense.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("m")))
    counts = counts.groupBy("id").agg(F.sum("m").alias("others")).withColumnRenamed("id", "_v")
    # one row a class of vectors that can link: the links of each member, and its component
    linked = weight.join(counts, F.col("vec_id") == F.col("_v"), "left").join(found, F.col("vec_id") == F.col("id"), "left")
    linked = linked.select(F.col("vec_id").alias("rep"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    member = usable.select("vec_id", *same).join(classes.select(*same, "rep"), same).join(linked, "rep").select(F.col("vec_id").alias("_m"), "n_links", "component")
    out = every.select("vec_id").join(member, F.col("vec_id") == F.col("_m"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM edge WHERE a = v.vec_id) AS n_links, min(other) AS component_id, v.vec_id = min(other) AS kept FROM v JOIN reach ON reach.vec_id = v.vec_id GROUP BY v.vec_id
"""
