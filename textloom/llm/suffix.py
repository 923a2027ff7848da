"""Removal of byte strings of LENGTH that start in more than one place, by hash-compared suffix sort.

Beside what is removed, passages that repeat are marked: runs of bytes covered by strings of SHORT bytes
that start in more than one place, if they hold more than PASSAGE whole words.

Places are thinned first: of all GRAM-byte strings inside a SHORT-byte window the one with the least
hash is the window's anchor. The choice depends on the window's bytes alone, so equal windows have
equal anchors at equal offsets, and the windows of one anchor occurrence are consecutive. A window of
LENGTH bytes has the anchor of the SHORT bytes it begins with. Only anchor occurrences (about two in
SHORT - GRAM + 1 bytes) are exchanged.

* An anchor string that occurs once has no repeated window.
* Occurrences whose whole regions (all bytes of all their windows) have equal 128-bit BLAKE2b digests are
  repeated throughout.
* For the rest the regions are fetched. Among occurrences of one anchor string the suffixes that
  begin at the anchor are sorted by mergesort; a comparison finds the common extension by binary
  search over prefix polynomial hashes, so it costs the logarithm of the length. Extensions of
  neighbours in the order are verified byte by byte (a group in which a hash misled is sorted by its
  bytes). A window that begins d bytes before the anchor is repeated if the rest of it, after the anchor's
  first byte, lies in one run of the sorted order and the d bytes before are equal, byte by byte.
* Anchor strings with more than GROUP distinct regions are never brought into one task: their windows
  are dealt out by digest to groups of bounded size and counted there, which gives the same answer.

Texts travel compressed, once for the regions and once for the removal.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import group_cuts, mix64, Scratch, utf8, whole_groups, with_scratch

LENGTH, SHORT, GRAM, GROUP = 400, 256, 64, 512
#: Words that a repeated passage must exceed.
PASSAGE = 50

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240602).integers(0, 2**64, 256, dtype=_U)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        both = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.ones(size, _U)
            done = 1
            while done < size:
                x[done : 2 * done] = x[:done] * _U(pow(b, done, 2**64))
                done *= 2
            both.append(x)
        _powers[:] = [(both[0], both[1])]
    return _powers[0]


def prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H with H[i] over b[:i], and the inverse powers: b[s:e] has hash (H[e] - H[s]) * inverse[s]."""
    up, down = powers(len(b) + 1)
    h = np.zeros(len(b) + 1, _U)
    np.cumsum(_TABLE[b] * up[: len(b)], out=h[1:])
    return h, down


def digests(strings: list[bytes], salts: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two signed halves of the BLAKE2b digests."""
    one = lambda x, p: hashlib.blake2b(x, digest_size=16, person=p).digest()
    x = np.frombuffer(b"".join(map(one, strings, salts or [b""] * len(strings))), np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def anchors(raw: bytes) -> list[np.ndarray] | None:
    """Place, string hash, first and last start of SHORT windows, last start of LENGTH windows, and the
    two halves of the region's digest, of each anchor."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < SHORT:
        return None
    h, down = prefix_hashes(b)
    grams = len(b) - GRAM + 1
    g = mix64((h[GRAM:] - h[:-GRAM]) * down[:grams])
    width = SHORT - GRAM + 1
    windows = grams - width + 1
    x = np.full(-(-grams // width) * width, _U(2**64 - 1))
    x[:grams] = (g & _U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=_U)  # least hash, leftmost first
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _U(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:], [windows]]) - 1
    a = at[lo]
    shape = (np.stack([hi - lo, a - lo], 1).astype("<i4")).tobytes()
    r1, r2 = digests([raw[s : e + LENGTH] for s, e in zip(lo.tolist(), hi.tolist(), strict=True)], [shape[i : i + 8] for i in range(0, len(shape), 8)])
    return [a, g[a].view(np.int64), lo, hi, np.minimum(hi, len(b) - LENGTH), r1, r2]


class Suffixes:
    """Suffixes of a buffer that are compared by prefix hashes."""

    def __init__(self, raw: bytes, start: np.ndarray, length: np.ndarray):
        self.raw, self.b, self.start, self.length = raw, np.frombuffer(raw, np.uint8), start, length
        self.h, self.down = prefix_hashes(self.b)

    def between(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.h[e] - self.h[s]) * self.down[s]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, pair by pair, by binary search."""
        sx, sy = self.start[x], self.start[y]
        hi = np.minimum(self.length[x], self.length[y])
        lo = np.zeros_like(hi)
        for _ in range(int(hi.max()).bit_length() if len(hi) else 0):
            mid = (lo + hi + 1) >> 1
            same = self.between(sx, sx + mid) == self.between(sy, sy + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        lx, ly = self.length[x], self.length[y]
        ended = n == np.minimum(lx, ly)
        n = np.where(ended, 0, n)
        by_byte = self.b[np.minimum(self.start[x] + n, len(self.b) - 1)].astype(np.int64) - self.b[np.minimum(self.start[y] + n, len(self.b) - 1)]
        return np.where(ended, lx - ly, by_byte)

    def sort(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """first[i]: where the group of suffix i begins (groups are consecutive). The order within
        groups by bottom-up mergesort, all merges of a level at once, and each one's common extension
        with the one before it in its group (-1 for the first)."""
        n = len(first)
        place = np.arange(n)
        end = np.searchsorted(first, first, "right")
        order, width, largest = place.copy(), 1, int((end - first).max()) if n else 0
        while width < largest:
            inside = (place - first) % (2 * width)
            base = place - inside
            left = inside < width
            lo = np.where(left, np.minimum(base + width, end), base)
            hi = np.where(left, np.minimum(base + 2 * width, end), base + width)
            from_ = lo.copy()
            while len(i := np.flatnonzero(lo < hi)):
                mid = (lo[i] + hi[i]) >> 1
                c = self.compare(order[i], order[mid])
                up = np.where(left[i], c > 0, c >= 0)
                lo[i], hi[i] = np.where(up, mid + 1, lo[i]), np.where(up, hi[i], mid)
            merged = np.empty_like(order)
            merged[base + np.where(left, inside, inside - width) + lo - from_] = order
            order, width = merged, 2 * width
        shared = np.full(n, -1)
        i = np.flatnonzero(place > first)
        shared[i] = self.common(order[i - 1], order[i])
        for k in i.tolist():
            x, y, m = order[k - 1], order[k], int(shared[k])
            if not self._holds(int(x), int(y), m):  # a hash misled: sort this group by its bytes
                s, e = int(first[k]), int(end[k])
                mine = sorted(order[s:e].tolist(), key=lambda j: self.raw[self.start[j] : self.start[j] + self.length[j]])
                order[s:e] = mine
                for j in range(s + 1, e):
                    p, q = (self.raw[self.start[z] : self.start[z] + self.length[z]] for z in (order[j - 1], order[j]))
                    shared[j] = next((t for t, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))
        return order, shared

    def _holds(self, x: int, y: int, n: int) -> bool:
        sx, sy = int(self.start[x]), int(self.start[y])
        most = int(min(self.length[x], self.length[y]))
        return self.raw[sx : sx + n] == self.raw[sy : sy + n] and (n == most or self.raw[sx + n] < self.raw[sy + n])


def repeated_windows(regions: list[bytes], group: np.ndarray, before: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """regions[i] of anchor string group[i] (sorted) has its anchor at before[i] and windows that begin
    lo..hi bytes before it. For LENGTH and for SHORT, [i, d]: whether the window d bytes before the anchor
    is whole and has total weight 2."""
    raw = b"".join(regions)
    size = np.array([len(r) for r in regions])
    at = np.cumsum(size) - size + before
    s = Suffixes(raw, at, size - before)
    first = np.searchsorted(group, group, "left")
    order, shared = s.sort(first)
    most = int(hi.max()) + 1
    out = [np.zeros((len(regions), most), bool) for _ in range(2)]
    lo_, hi_, at_, weight_, length_ = lo[order], hi[order], at[order], weight[order], s.length[order]
    same = np.zeros(len(regions), np.int64)  # rows with equal numbers have the same d bytes before the anchor
    for d in range(most):
        if d:
            byte = np.where(at_ - d >= at_ - before[order], s.b[np.maximum(at_ - d, 0)], 256).astype(np.int64)
            _, same = np.unique(same * 257 + byte, return_inverse=True)
        for k, length in enumerate((LENGTH, SHORT)):
            i = np.flatnonzero((lo_ <= d) & (d <= hi_) & (length_ >= length - d))
            if len(i):
                run = np.cumsum(shared < length - d)[i]
                _, inverse = np.unique(same[i] * (len(regions) + 1) + run, return_inverse=True)
                out[k][order[i], d] = np.bincount(inverse, weight_[i])[inverse] >= 2
    return out[0], out[1]


_ANCHORS = "doc_id long, th long, a int, key long, lo int, hi int, top int, r1 long, r2 long, n int, more binary"
_REGIONS = "key long, doc_id long, th long, a int, lo int, hi int, n int, m long, region binary"
_SPANS = "doc_id long, th long, short boolean, lo int, hi int"


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _compressed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        z = ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(x) for x in b.column(2).to_pylist()], pa.binary())], ["doc_id", "th", "z"])

    return docs.mapInArrow(run, "doc_id long, th long, z binary")


def _plain(z: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(z) if z else b""


def _repeats(x: np.ndarray) -> bool:
    return len(np.unique(x)) < len(x)


def _all(x: np.ndarray) -> tuple[np.ndarray, ...]:
    n = np.arange(len(x))
    return x, n, n, np.ones(len(x), np.int64)


def _once(x: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Anchors of a text with each region once: its first place, how often it occurs, and the packed
    windows (first and last starts) of its other places. Periodic texts repeat one region very often."""
    _, first, of, n = np.unique(np.stack([x[5], x[6]], 1), axis=0, return_index=True, return_inverse=True, return_counts=True) if _repeats(x[5]) else _all(x[5])
    more: list[bytes | None] = [None] * len(first)
    order, end = np.argsort(of.ravel(), kind="stable"), np.cumsum(n)
    for k in np.flatnonzero(n > 1).tolist():
        i = order[end[k] - n[k] : end[k]]
        i = i[i != first[k]]
        more[k] = np.stack([x[2][i], x[3][i], x[4][i]], 1).astype("<i4").tobytes()
    return [*(c[first] for c in x), n], more


def _find_anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *_once(x)) for i, raw in enumerate(b.column(2).to_pylist()) if (x := anchors(raw))]
            if found:
                rows = pa.array(np.concatenate([np.full(len(x[0]), i) for i, x, _ in found]))
                cols = [np.concatenate([x[k] for _, x, _ in found]) for k in range(8)]
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                more = pa.array([m for *_, x in found for m in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *arrays, more], _names(_ANCHORS))

    return docs.mapInArrow(run, _ANCHORS)


def _with_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    return _compressed(docs).join(lists, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")), how)


def _fetch_regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "a", "lo", "hi", "n", "m")).alias("x"))
    rows = _with_text(docs, lists, "inner").select("doc_id", "th", "z", *[F.col(f"x.{k}").alias(k) for k in ("key", "a", "lo", "hi", "n", "m")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, z, *lists in zip(*[b.column(i).to_pylist() for i in range(9)], strict=True):
                raw = _plain(z)
                out += [(key, doc, th, a, lo, hi, n, m, raw[lo : hi + LENGTH]) for key, a, lo, hi, n, m in zip(*lists, strict=True)]
            if out:
                types = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _names(_REGIONS))

    return rows.mapInArrow(run, _REGIONS)


def _sorted_spans(regions: DataFrame) -> DataFrame:
    rows = regions.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            key, a, lo, hi, n = (t.column(i).to_numpy().astype(np.int64) for i in (0, 3, 4, 5, 6))
            for short, found in enumerate(repeated_windows(t.column(8).to_pylist(), key, a - lo, a - hi, a - lo, np.minimum(n, 2))):
                found[n > 1] = False  # those are known already
                edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                i, d = np.nonzero(edge == 1)
                _, e = np.nonzero(edge == -1)
                ids = [t.column(k).combine_chunks().take(pa.array(i)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(i), bool(short))), pa.array((a[i] - e + 1), pa.int32()), pa.array((a[i] - d), pa.int32())], _names(_SPANS))

    return rows.mapInArrow(run, _SPANS)


def _counted_windows(regions: DataFrame, group: int) -> DataFrame:
    """The same for anchor strings with more than ``group`` regions: doc_id, th, short, windows (packed starts).

    Each region deals its windows, as the halves of their digests, out to m / group groups by the first
    half, one row a group; equal windows meet in one group, and a group holds as much as ``group`` whole
    regions would.
    """
    schema = "key long, part int, doc_id long, th long, n int, starts binary, w1 binary, w2 binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, doc, th, _, lo, hi, n, m, region in zip(*[b.column(i).to_pylist() for i in range(9)], strict=True):
                for short, length in enumerate((LENGTH, SHORT)):
                    s = np.arange(min(hi - lo, len(region) - length) + 1)
                    if not len(s):
                        continue
                    w = digests([region[i : i + length] for i in s.tolist()])
                    part = (w[0].view(_U) % _U(-(-m // group))).astype(np.int64)
                    for p in np.unique(part).tolist():
                        i = part == p
                        out.append((key, 2 * p + short, doc, th, min(n, 2), (s[i] + lo).astype("<i4").tobytes(), w[0][i].tobytes(), w[1][i].tobytes()))
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _names(schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            cuts, n = group_cuts(t, 2), t.column(4).to_numpy()
            starts, w1, w2 = (t.column(i).to_pylist() for i in (5, 6, 7))
            keep, windows = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                size = np.array([len(x) // 4 for x in starts[s:e]])
                w = np.stack([np.frombuffer(b"".join(x[s:e]), np.int64) for x in (w1, w2)], 1)
                _, inverse = np.unique(w, axis=0, return_inverse=True)
                twice = np.bincount(inverse, np.repeat(n[s:e], size))[inverse] >= 2
                for i, at in zip(range(s, e), np.cumsum(size) - size, strict=True):
                    mine = np.frombuffer(starts[i], "<i4")[twice[at : at + len(starts[i]) // 4]]
                    if n[i] == 1 and len(mine):
                        keep.append(i)
                        windows.append(mine.tobytes())
            rows = pa.array(keep, pa.int64())
            doc, th = (t.column(i).combine_chunks().take(rows) for i in (2, 3))
            short = pa.array(t.column(1).to_numpy()[keep] % 2 == 1) if keep else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([doc, th, short, pa.array(windows, pa.binary())], ["doc_id", "th", "short", "windows"])

    dealt = regions.mapInArrow(deal, schema).repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(count, "doc_id long, th long, short boolean, windows binary")


def covered(n: int, length: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of n bytes, those in a window of ``length`` that starts in one of the ranges lo..hi."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, lo, 1)
    np.subtract.at(edges, hi + length, 1)
    return np.cumsum(edges[:-1]) > 0


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_PART = re.compile(rb"[^\x20\x09-\x0D]*")


def whole_words(raw: bytes, s: int, e: int) -> int:
    """Words of the text that lie inside s..e."""
    blank = b" \t\n\x0b\x0c\r"
    if s and raw[s - 1 : s] not in blank:
        s = min(e, _PART.match(raw, s).end())
    words = raw[s:e].split()
    return len(words) - (len(words) > 0 and e < len(raw) and raw[e - 1 : e] not in blank and raw[e : e + 1] not in blank)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, kept binary"


@with_scratch
def remove_repeats(docs: DataFrame, with_text: bool = False, group: int = GROUP, *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages
    and passage_words (repeated passages of more than PASSAGE words, and their words), and ``kept``, the
    remaining bytes, if asked.

    Null text counts as empty; texts under SHORT bytes hold no window and stay whole. Every row is a
    document of its own: repeated rows repeat each other's strings and lose them. Null ids are kept
    apart by their texts. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), utf8().alias("raw"))
    found = scratch.keep(_find_anchors(docs))
    twice = found.groupBy("key").agg(F.sum("n").alias("t")).where("t > 1").select("key")
    found = scratch.keep(found.join(twice, "key"))
    first = F.min(F.struct("doc_id", "th", "a", "lo", "hi")).alias("x")
    regions = scratch.keep(found.groupBy("key", "r1", "r2").agg(F.sum("n").alias("n"), first))
    open_ = regions.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("least = 1 AND m > 1").select("key", "m")
    wanted = regions.join(open_, "key").select("x.*", "key", F.least("n", F.lit(2)).cast("int").alias("n"), "m")
    equal = found.join(regions.where("n > 1").select("key", "r1", "r2"), ["key", "r1", "r2"], "left_semi").select("doc_id", "th", "lo", "hi", "top", "more")
    fetched = scratch.keep(_fetch_regions(docs, wanted))
    spans = equal.unionByName(_sorted_spans(fetched.where(F.col("m") <= group)), allowMissingColumns=True)
    spans = spans.unionByName(_counted_windows(fetched.where(F.col("m") > group), group), allowMissingColumns=True)
    fields = ("lo", "hi", "top", "more", "short", "windows")
    lists = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("x"))
    rows = _with_text(docs, lists, "left").select("doc_id", "z", *[F.col(f"x.{c}").alias(c) for c in fields])

    def windows_of(short: bool, lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """First and last starts of the repeated windows of one length. Rows of equal regions name no length."""
        ranges = []
        for lo, hi, top, more, which, starts in zip(*lists, strict=True):
            if starts is not None:
                if which == short:
                    one = np.frombuffer(starts, "<i4")
                    ranges.append(np.stack([one, one], 1))
            elif which is not None:
                if which == short:
                    ranges.append(np.array([[lo, hi]]))
            else:
                every = np.concatenate([[[lo, hi, top]], np.frombuffer(more or b"", "<i4").reshape(-1, 3)])
                ranges.append(every[:, [0, 1]] if short else every[every[:, 2] >= every[:, 0]][:, [0, 2]])
        both = np.concatenate([np.zeros((0, 2), np.int64), *ranges]).astype(np.int64)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for z, *lists in zip(*[b.column(i).to_pylist() for i in range(1, 8)], strict=True):
                raw = _plain(z)
                kept, n, runs, passages = raw, 0, 0, []
                if lists[0]:
                    gone = covered(len(raw), LENGTH, *windows_of(False, lists))
                    if gone.any():
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        n, runs = int(gone.sum()), len(runs_of(gone))
                    seen = covered(len(raw), SHORT, *windows_of(True, lists))
                    passages = [w for s, e in runs_of(seen) if (w := whole_words(raw, s, e)) > PASSAGE]
                out.append((len(raw), n, runs, hashlib.sha256(kept).hexdigest(), len(passages), sum(passages), kept if with_text else None))
            cols = [*zip(*out, strict=True)] or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], _names(_RESULT))

    out = rows.mapInArrow(run, _RESULT)
    return out if with_text else out.drop("kept")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
