"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` numbers) is packed on the driver: the
reduction fixes bins that provably belong to some optimal packing, best-fit decreasing packs what is
left, and equal bins are one pattern with a count. Patterns hold distinct lengths that sum to at most
the capacity (63 of them for 2048), and each length opens or splits at most two groups of bins, so
the plan is bounded whatever the corpus. Pieces then find their places in parallel: a piece is ranked
among those of its length (by salted counts, so that a hot length meets in no single task), and
length and rank decide sequence and offset.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import prepare, Scratch, utf8, with_scratch

CAPACITY = 2048
END_ID = 0
SALTS, ROWS_A_SALT = 256, 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Signs that end a chunk as a token run of their own if they follow an ASCII letter.
TAIL = b".,!?;:%&$#*|"


#: Words of small Latin-1 letters in UTF-8 need no normalising or splitting: the model alone decides.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _visible_bytes() -> dict[int, int]:
    """The byte-level alphabet of such tokenizers: printable Latin-1 stands for itself, the other bytes
    for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_VISIBLE = _visible_bytes()


class ChunkIds(dict):
    """Packed ids of white-space-free chunks. White space is dropped and no token spans it, so a text's
    ids are those of its chunks in order; nor does a token span a letter and signs of TAIL after it, so
    those parts are looked up apart. A cache in two generations of bounded size, of which the older
    goes when the younger is full; results never depend on it."""

    MOST = 30_000_000  # bytes a generation, about

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.held, self.older = 0, {}

    def __missing__(self, chunk: bytes) -> bytes:
        if self.held > self.MOST:
            self.older, self.held = dict(self), 0
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            stem = chunk.rstrip(TAIL)
            if len(stem) < len(chunk) and stem[-1:].isalpha():
                ids = self[stem] + self[chunk[len(stem) :]]
            else:
                ids = self._encode(chunk)
        self[chunk] = ids
        self.held += len(chunk) + len(ids) + 150
        return ids

    def _encode(self, chunk: bytes) -> bytes:
        if chunk.isalpha() and chunk.islower() and len(chunk) < 64:
            ids = [t.id for t in self.model.tokenize(chunk.decode())]
        elif len(chunk) < 64 and _WORD.fullmatch(chunk):
            ids = [t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(_VISIBLE))]
        else:
            ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def of(self, chunks: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, chunks))


_loaded: dict[str, ChunkIds] = {}


def chunks_of(raw: bytes) -> list[bytes]:
    """ASCII case goes first, as the tokenizer ignores it, but for texts that may hold special tokens."""
    return (raw if b"<|" in raw else raw.lower()).split()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> one row a piece; ``with_ids`` adds the ids as little-endian bytes.

    Null and empty texts are the end id alone. Texts longer than ``capacity`` ids are cut into pieces of that
    many, the last one shorter. Rows are independent: null and repeated ids each give their pieces, an empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    path = path or default_tokenizer()
    width = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = ChunkIds(path)
        known, end = _loaded[path], struct.pack("<I", END_ID)
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = known.of(chunks_of(raw)) + end
                for i, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = [*zip(*rows, strict=True)] or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


Pattern = tuple[list[tuple[int, int]], int]  # (length, copies) of a bin, and how many such bins


def _largest_at_most(counts: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def reduce_by_dominance(counts: np.ndarray) -> list[Pattern]:
    """Fix bins that dominate every other bin of one of their items; ``counts`` keeps the rest.

    For an item of length l with room r left beside it, k the largest other item that fits:
    nothing fits: {l}. k = r, or no two others fit, or no pair that fits exceeds k: {l, k} (whatever
    else shares a bin with l can swap places with k). At most two others fit, k is in the fullest
    pair {k, b}, and no pair that fits has a smaller member above b: {l, k, b}. All of these stay true
    while items are only removed, so a bin is fixed as often as its items last.
    """
    capacity, fixed, changed = len(counts) - 1, [], True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while counts[length]:
                counts[length] -= 1  # what else there is beside one such item
                room, left = capacity - length, counts
                fits = _largest_at_most(left[: room + 1])
                k = int(fits[room])
                few = []
                for s in np.flatnonzero(left[: room + 1])[:3] if k else ():
                    few += [int(s)] * min(3, int(left[s]))
                few = sorted(few)[:3]
                bin_ = None
                if not k:
                    bin_ = [length]
                elif k == room or len(few) < 2 or few[0] + few[1] > room:
                    bin_ = [length, k]
                elif len(few) < 3 or sum(few) > room:
                    best, second = (0, 0, 0), 0
                    for a in np.flatnonzero(left[: room + 1]):
                        a = int(a)
                        left[a] -= 1
                        b = int(_largest_at_most(left[: room - a + 1])[-1]) if room > a else 0
                        left[a] += 1
                        if b:
                            best = max(best, (a + b, max(a, b), min(a, b)))
                            second = max(second, min(a, b))
                    if best[0] <= k:
                        bin_ = [length, k]
                    elif best[1] == k and second <= best[2]:
                        bin_ = [length, k, best[2]]
                counts[length] += 1
                if bin_ is None:
                    break
                need = {x: bin_.count(x) for x in bin_}
                times = min(int(counts[x]) // n for x, n in need.items())
                for x, n in need.items():
                    counts[x] -= n * times
                fixed.append((sorted(need.items(), reverse=True), times))
                changed = True
    return fixed


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing over a histogram: bins alike in room and content move together."""
    capacity = len(counts) - 1
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by room: content, bins
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        room = length
        while n:
            while room <= capacity and not groups.get(room):
                room += 1
            if room <= capacity:
                content, bins = groups[room].pop()
            else:
                content, room = (), capacity
                bins = -(-n // (room // length))
            each = room // length
            full = min(bins, n // each)
            if full:
                groups.setdefault(room - each * length, []).append(((*content, (length, each)), full))
                n, bins = n - full * each, bins - full
            if bins and n:  # fewer than ``each`` items are left: one bin takes them
                groups.setdefault(room - n * length, []).append(((*content, (length, n)), 1))
                n, bins = 0, bins - 1
            if bins:
                groups.setdefault(room, []).append((content, bins))
            room = length
    return [([*content], bins) for held in groups.values() for content, bins in held]


def plan_bins(counts: np.ndarray) -> list[Pattern]:
    """counts[l]: pieces of length l. Patterns that hold each piece once."""
    counts = counts.copy()
    return reduce_by_dominance(counts) + best_fit(counts)


def places(patterns: list[Pattern]) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset, copies a sequence), by length and first rank."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for content, times in patterns:
        offset = 0
        for length, n in content:
            runs.append((length, used.get(length, 0), sequence, offset, n))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


@with_scratch
def pack(pieces: DataFrame, capacity: int = CAPACITY, *, scratch: Scratch) -> DataFrame:
    """pieces (doc_id, piece, length at most capacity, ...) -> the same plus sequence_id and offset.

    Equal pieces are told apart by doc_id, piece and checksum; whole duplicate rows take the places
    of equal pieces in any order. Columns other than sequence_id and offset may have any names. An empty
    table gives an empty result.
    """
    pieces = scratch.keep(pieces)
    salts = max(SALTS, pieces.count() // ROWS_A_SALT)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = scratch.keep(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_salt.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        counts[length] = n
    runs = places(plan_bins(counts))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__place", place).join(starts, ["length", "__salt"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col("__first") + F.col("__place")).alias("__rank"))
    keys = runs[:, 0] << 44 | runs[:, 1]
    at = pieces.columns.index("length")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(keys, length << 44 | rank, "right") - 1
            _, first, sequence, offset, n = runs[i].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence + nth // n), pa.array(offset + nth % n * length)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> sequence_id, ids: the packed training sequences themselves, as little-endian
    unsigned 32-bit ids. Rows are treated as by ``tokenize_pieces``; an empty table gives an empty result."""
    placed = pack(tokenize_pieces(docs, capacity, path, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens a group
    ids = F.aggregate(parts, F.encode(F.lit(""), "UTF-8"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(ids.alias("ids"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
