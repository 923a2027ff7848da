"""MinHash near-duplicates with Odd sketches: banded candidates, sketch filter, exact confirmation.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Documents with equal sets form
a class, and one document stands for it from there on. Bands of ROWS MinHash samples, as many as the
threshold needs, give the band keys; the same samples, folded into a bitmap by parity (Odd sketch), let the population count of the
XOR of two bitmaps estimate high similarities precisely, so that few wrong candidates reach the
texts. Every link is confirmed on the full sets.

A bucket of documents that share a band key is never expanded into pairs. First each member is
compared with the least of its bucket; members found linked are one component. While a bucket still
holds more than BLOCK members outside its largest component, all its members are compared with about
BLOCK of them drawn by hash, up to ROUNDS times: rows in proportion to the bucket. At last, members
outside the largest component meet all others in blocks of bounded size, and only links that join
components leave a task. So groups of copies and near copies cost rows in proportion to their size; only
a bucket of many documents that stay unlinked costs more, and none of its links is given up. No link
between components is lost but by the samples themselves: a pair at the threshold shares no band with
probability below MISS: (1 - 0.85**5)**24 at 0.85, (1 - 0.80**5)**35 at 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import group_cuts, mix64, prepare, Scratch, utf8, whole_groups, with_scratch, WordHashes
from textloom.llm.components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
SKETCH_BITS = 512
#: Links need 100 * intersection >= threshold * union; this is the one of op1.
THRESHOLD = 85
MISS, MOST_BANDS = 1e-6, 64
#: Sketch estimates this many hundredths under the threshold are out: over four standard errors.
MARGIN = 15
#: Members a task of a star, and a block.
STAR, BLOCK = 2048, 256
ROUNDS = 3

_U = np.uint64
_words = WordHashes()
_rng = np.random.default_rng(20240601)
_A = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_A = np.append(_A, (_rng.integers(0, 2**31, (MOST_BANDS - BANDS) * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32))
_B = np.append(_B, _rng.integers(0, 2**32, (MOST_BANDS - BANDS) * ROWS, dtype=np.uint64).astype(np.uint32))
_P = _U(0x9E3779B97F4A7C15)


def bands_for(threshold: int) -> int:
    """The least number of bands that a pair at the threshold misses with a probability below MISS."""
    bands = int(np.ceil(np.log(MISS) / np.log1p(-((threshold / 100) ** ROWS))))
    if bands > MOST_BANDS:
        raise ValueError(f"a threshold of {threshold} needs {bands} bands, more than {MOST_BANDS}")
    return bands


def shingles(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ASCII-lower-cased words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, _U)
    w = _words.of(words)
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), _U)
    for i in range(min(len(w), width)):
        h = h * _P + w[i : i + n]
    return np.unique(mix64(h))


def samples(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    x = (s >> _U(32)).astype(np.uint32)
    n = bands * ROWS
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = _A[:n, None] * x[None, at : at + 2048]
        h += _B[:n, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(-1, ROWS)
    h = np.arange(1, len(rows) + 1, dtype=_U)
    for r in rows.T.astype(_U):
        h = mix64(h * _P + r)
    return h.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the samples that hash to b."""
    at = mix64((np.arange(len(m), dtype=_U) << _U(32)) | m.astype(_U)) % _U(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool))


def most_differing(threshold: int = THRESHOLD) -> int:
    """The largest XOR population count whose estimate is at most MARGIN under the threshold."""
    z = np.arange(SKETCH_BITS // 2)
    differing = -SKETCH_BITS / 2 * np.log1p(-2 * z / SKETCH_BITS)
    return int(z[1 - differing / (2 * bands_for(threshold) * ROWS) >= (threshold - MARGIN) / 100].max())


SIGNED = "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, bands, sketch = [], [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingles(raw)
                n.append(len(s))
                m = mix64(s + _P)
                h1.append(int(m.sum(dtype=_U).astype(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix64(m)).astype(np.int64)) if len(s) else 0)
                if len(s):
                    x = samples(s, n_bands)
                    bands.append(band_keys(x))
                    sketch.append(odd_sketch(x).tobytes())
                else:
                    bands.append(None)
                    sketch.append(None)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split(" ")[0] for x in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")).mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """pairs (c, rep), texts (doc_id, raw) -> the pairs (a, b) that link on their full sets.

    Members travel to their c in groups of about STAR, each of which starts with the text of c, so neither a
    pair nor a hot c is ever held as a whole: a task keeps one set and streams the rest.
    """
    salts = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts"))
    members = pairs.join(salts, "c").select("c", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"), "rep", F.lit(1).alias("second"))
    centres = members.select("c", "salt").distinct().select("c", "salt", F.col("c").alias("rep"), F.lit(0).alias("second"))
    rows = members.unionByName(centres).join(texts, F.col("rep") == F.col("doc_id")).select("c", "salt", "second", "rep", "raw")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, full = None, np.zeros(0, _U)
        for b in batches:
            links = []
            for c, second, rep, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                s = shingles(raw)
                if not second:
                    centre, full = c, s
                elif c == centre and _linked(full, s, threshold):
                    links.append((c, rep))
            a, z = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


GROUPED = ("key", "part", "band", "side", "rep", "component", "n", "sketch", "bands")


def _popcount(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)


def _candidates(t: pa.Table, most: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group (between its sides, or within its only side) that differ in component, share no
    earlier band and that sizes and sketches allow; and how many sketch bits differ."""
    rep, comp, n = (t.column(i).to_numpy() for i in (4, 5, 6))
    sketch = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(rep), -1)
    keys = np.frombuffer(b"".join(t.column(8).to_pylist()), np.int64).reshape(len(rep), -1)
    side, band = t.column(3).to_numpy(), t.column(2)[0].as_py()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(right) or not len(left)
    if within:
        left = right = np.arange(len(rep))
    ok = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum.outer(n[left], n[right]) >= threshold * np.maximum.outer(n[left], n[right]))
    if within:
        ok &= rep[left][:, None] < rep[right][None, :]
    bits = _popcount(sketch[left], sketch[right]) if ok.any() else np.zeros(ok.shape, np.int64)
    i, j = np.nonzero(ok & (bits <= most))
    bits, i, j = bits[i, j], left[i], right[j]
    if band and len(i):
        new = ~(keys[i, :band] == keys[j, :band]).any(axis=1)
        i, j, bits = i[new], j[new], bits[new]
    return i, j, bits


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "side")


def _promising(rows: DataFrame, most: int, threshold: int) -> DataFrame:
    """The members of the groups (key, part) that are in some candidate pair; pairs are not emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            cuts, keep = group_cuts(t, 2), np.zeros(t.num_rows, bool)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                i, j, _ = _candidates(t.slice(s, e - s), most, threshold)
                keep[s + i] = keep[s + j] = True
            yield from t.filter(pa.array(keep)).to_batches()

    rows = _by_group(rows.select(*GROUPED))
    return rows.mapInArrow(run, rows.schema)


def _links_across(rows: DataFrame, most: int, threshold: int) -> DataFrame:
    """rows of groups with their texts (raw): links between components, confirmed on the full sets. A
    group is at most two blocks; the likeliest pairs come first, pairs that the group has joined
    already are passed over, and only the links that join components leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            cuts, out = group_cuts(t, 2), []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                g = t.slice(s, e - s)
                i, j, bits = _candidates(g, most, threshold)
                rep, comp = g.column(4).to_numpy(), g.column(5).to_pylist()
                up: dict[int, int] = {}
                sets: dict[int, np.ndarray] = {}

                def root(x: int, up: dict[int, int] = up) -> int:
                    while (y := up.get(x, x)) != x:
                        x = y
                    return x

                for k in np.argsort(bits, kind="stable").tolist():
                    a, b = int(i[k]), int(j[k])
                    x, y = root(comp[a]), root(comp[b])
                    if x == y:
                        continue
                    for m in (a, b):
                        if m not in sets:
                            sets[m] = shingles(g.column(9)[m].as_py())
                    if _linked(sets[a], sets[b], threshold):
                        up[max(x, y)] = min(x, y)
                        out.append((int(rep[a]), int(rep[b])))
            a, z = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return _by_group(rows.select(*GROUPED, "raw")).mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(x) + len(y) - both)


@with_scratch
def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> doc_id, n_shingles, component_id, kept. Links need a
    similarity of ``threshold`` hundredths.

    Null and empty texts, and texts without words, have no shingles and link with nothing; texts of
    fewer than five words are one shingle. A null doc_id links with nothing: component_id is null and
    the row is kept. doc_id names one text; repeated rows count alike and each is returned. An empty
    table gives an empty result.
    """
    most = most_differing(threshold)
    signed = scratch.keep(signatures(docs, bands_for(threshold)))
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("x")
    classes = scratch.keep(usable.groupBy("h1", "h2").agg(first).select("h1", "h2", F.col("x.doc_id").alias("rep"), "x.n", "x.bands", "x.sketch"))
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = scratch.keep(keyed.join(shared, "key"))
    stars = buckets.where("rep != c").select("c", "rep").distinct()
    info = classes.select("rep", "n", "sketch")
    near = F.col("n") * 100 >= F.col("cn") * threshold
    near = near & (F.col("cn") * 100 >= F.col("n") * threshold)
    stars = stars.join(info, "rep").join(info.select(F.col("rep").alias("c"), F.col("n").alias("cn"), F.col("sketch").alias("cs")), "c").where(near)
    stars = scratch.keep(_sketched(stars, most).select("c", "rep"))
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.keep(docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")).join(wanted, "doc_id").dropDuplicates(["doc_id"]))
    links = scratch.keep(confirm(stars, texts, threshold))
    packed = classes.select("rep", "n", "sketch", _packed("bands").alias("bands"))
    mixed = buckets
    for seed in range(ROUNDS + 1):  # the same rounds at every size; a bucket that is one component is out of those after
        mixed = _mixed(mixed, components(links, scratch), scratch)
        rows = _in_blocks(mixed) if seed == ROUNDS else _beside_some(mixed.where(F.col("outside") > BLOCK), seed)
        rows = scratch.keep(_promising(rows.join(packed, "rep"), most, threshold))
        more = _links_across(rows.join(texts, F.col("rep") == F.col("doc_id")), most, threshold)
        links = scratch.keep(links.unionByName(more).distinct())
    found = components(links, scratch)
    by_class = classes.select("h1", "h2", "rep").join(found, F.col("rep") == F.col("id"), "left")
    by_class = by_class.select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    linked = F.col("n") > 0
    out = signed.select("doc_id", "n", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    component = F.when(linked & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(buckets: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets that hold several components: also ``component``, ``inside`` (the bucket's largest one)
    and ``outside``, the number of members that are not."""
    rows = buckets.select("key", "band", "rep", "members").join(found, F.col("rep") == F.col("id"), "left").select("key", "band", "rep", "members", F.coalesce("component", "rep").alias("component"))
    rows = scratch.keep(rows)
    size = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    top = size.groupBy("key").agg(F.max(F.struct("size", "component")).alias("x"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    rows = rows.join(top.select("key", F.col("x.component").alias("top"), F.col("x.size").alias("size")), "key")
    return scratch.keep(rows.select("key", "band", "rep", "members", "component", (F.col("component") == F.col("top")).alias("inside"), (F.col("members") - F.col("size")).alias("outside")))


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK)


def _beside_some(rows: DataFrame, seed: int) -> DataFrame:
    """Each bucket in blocks (side 1), and beside each block about BLOCK members drawn by hash (side 0)."""
    rows = rows.withColumn("blocks", _blocks(F.col("members")))
    own = rows.withColumns({"part": F.pmod(F.xxhash64("rep"), F.col("blocks")), "side": F.lit(1)})
    drawn = rows.where(F.pmod(F.xxhash64("rep", F.lit(seed + 1)), F.col("blocks")) == 0)
    return own.unionByName(drawn.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "side": F.lit(0)}))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of members outside the largest component, each beside every block of its bucket once."""
    out, in_ = _blocks(F.col("outside")), _blocks(F.col("members") - F.col("outside"))
    rows = rows.withColumns({"out": out, "blocks": out + in_})
    rows = rows.withColumn("block", F.when(F.col("inside"), F.col("out") + F.pmod(F.xxhash64("rep"), F.col("blocks") - F.col("out"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("out"))))
    last = F.when(F.col("inside"), F.col("out")).otherwise(F.col("blocks")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return rows.withColumns({"part": part, "side": F.when(F.col("block") > F.col("other"), 1).otherwise(0)})


def _packed(col: str) -> Column:
    """An array of longs as little-endian bytes."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x, "<i8").tobytes())

    return pack(col)


def _sketched(pairs: DataFrame, most: int) -> DataFrame:
    """Keep the pairs whose sketches differ in at most ``most`` bits (columns sketch, cs)."""
    schema = pairs.schema
    i, j = pairs.columns.index("sketch"), pairs.columns.index("cs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (i, j))
                yield b.filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= most))

    return pairs.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
