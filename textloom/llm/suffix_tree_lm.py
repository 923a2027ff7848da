"""Language-model scoring by a probabilistic suffix tree over words, beside a word-unigram base.

Symbols are the words of a text and one end sign, the tokens of the base. States are contexts of up to
DEPTH words. The root is the smoothed unigram of the base. A longer context is a state if it occurs
LEAST times, its suffix (one word shorter) is a state, and its counts diverge from the smoothed
distribution of its suffix by COST nats for each of its next symbols. None of this looks at the size of
the corpus, so the tree grows with it. Next symbols are smoothed by Witten-Bell towards the suffix:
(count + kinds * p) / (total + kinds), p the suffix's, down to the root, in which all words that
training does not hold share one place. A text is scored with the longest suffix state at each symbol.

The tree is grown one depth a round. Texts are kept once, as numbers of words, in chunks. In a round each chunk
sends its distinct (context, next word) pairs as sorted packed arrays to the ranges of the contexts'
hashes, where the counts of all chunks meet, and gets back the corpus counts of its own pairs and the
kinds and divergences of its own contexts. So neither a vocabulary nor a tree is broadcast or collected.
The number of ranges stops at PARTS, so rows grow in proportion to the chunks. A context with more than
a 4096th of all symbols is split by its next words; its parts meet in a table of at most 4096 rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import mix64, Scratch, utf8, whole_groups, with_scratch, WordHashes

DEPTH = 2
LEAST = 2
#: Nats that each next symbol of a context must earn, so that small corpora do not grow chance contexts.
COST = 1.0
CHUNK = 10_000_000  # bytes of text
PART_BYTES, PARTS = 4_000_000, 2048
#: Contexts with more occurrences than this, and than a 4096th of all symbols, are split.
HOT, MOST_HOT = 1 << 20, 4096
HELD_OUT = (7, 2)  # crc32(doc_id) mod 7 = 2

_U = np.uint64
_K, _S = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_words = WordHashes()
END = 0x5851F42D4C957F2D


def _zip(x: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    from zstandard import ZstdDecompressor

    return np.frombuffer(ZstdDecompressor().decompress(x), kind)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress better."""
    return _zip(x.view(np.uint8).reshape(len(x), -1).T if len(x) else x)


def _unplanes(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(_unzip(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=_U(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, _U), dtype=_U)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def _join(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def symbols(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text, and the end sign."""
    return np.append(_words.of(raw.lower().split()), _U(END))


def pack_pairs(f: dict[str, np.ndarray]) -> tuple[bytes, ...]:
    """Rows as of Chunk.pairs; of the contexts' hashes 48 bits, of the next words the steps within a context."""
    first = np.cumsum(f["kinds"]) - f["kinds"]
    step = np.diff(f["next"], prepend=np.uint32(0))
    step[first] = f["next"][first]
    return pack_keys(f["ctx"] >> _U(16)), _zip(f["kinds"]), _planes(step), _zip(f["n"]), _zip(f["q"]), _zip(f["places"]), _zip(f["names"])


def unpack_pairs(ctx: bytes, kinds: bytes, step: bytes, n: bytes, q: bytes, places: bytes, names: bytes) -> dict[str, np.ndarray]:
    size, steps = _unzip(kinds, np.uint32), _unplanes(step, np.uint32)
    first = np.cumsum(size) - size
    upto = np.cumsum(steps, dtype=np.uint32)
    return {
        "ctx": unpack_keys(ctx), "kinds": size, "next": upto - np.repeat(upto[first] - steps[first], size),
        "n": _unzip(n, np.uint32), "q": _unzip(q, np.uint8), "places": _unzip(places, np.uint32), "names": _unzip(names, _U),
    }


class Chunk:
    """The symbols of some texts, and for each of them what the rounds have found: the longest pair
    looked up (``seq``, into ``names`` and training ``counts``), the probability, and whether the context
    of the last round is a state."""

    def __init__(self, ids: list[int | None], size: np.ndarray, u: np.ndarray, of: np.ndarray, hot: int = HOT):
        """``u``: the sorted distinct symbols; ``of``: each symbol's number in it; ``size``: symbols a text."""
        self.ids, self.size, self.u, self.of, self.hot = ids, size.astype(np.int64), u, of.astype(np.int64), hot
        self.first = np.cumsum(self.size) - self.size
        self.out = np.array([held_out(i) for i in ids], bool)
        self.train = ~np.repeat(self.out, self.size)

    @classmethod
    def of_texts(cls, ids: list[int | None], texts: list[np.ndarray], hot: int = HOT) -> Chunk:
        return cls(ids, np.array([len(t) for t in texts]), *np.unique(np.concatenate(texts), return_inverse=True), hot)

    # ---- round 0: words

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct symbols, sorted, and their training counts here."""
        return self.u, np.bincount(self.of, self.train, len(self.u)).astype(np.uint32)

    def take_words(self, counts: np.ndarray, tokens: int, kinds: int) -> None:
        p = (counts + 1) / (tokens + kinds + 1)
        self.p = p[self.of]
        self.base, self.known = self.scores(np.log10(p)[self.of]), self.scores((counts > 0)[self.of].astype(np.int64))
        self.seq, self.names, self.counts = self.of, self.u, counts
        self.state = np.ones(len(self.of), bool)
        self.state[self.first] = False  # no context

    # ---- round k: contexts of k words

    def pairs(self, k: int) -> dict[str, np.ndarray]:
        """Distinct contexts that can be states, each with its next words: ``ctx``, ``kinds`` (next words of each),
        ``next``, training counts ``n`` here, ``q`` (-8 log2 of the probability by the suffix), and of the
        split contexts the places in ``ctx`` and their own names."""
        i = np.flatnonzero(self.state)
        i = i[self.seq[i - 1] >= 0]
        self.i = i = i[self.counts[self.seq[i - 1]] >= LEAST]
        key, pair = np.unique(self.seq[i - 1].astype(_U) << _U(32) | self.of[i].astype(_U), return_inverse=True)
        before, nxt = (key >> _U(32)).astype(np.int64), self.u[(key & _U(0xFFFFFFFF)).astype(np.int64)]
        name, total = self.names[before], self.counts[before]
        split = -(-total // self.hot)
        ctx = name
        if split.size and split.max() > 1:
            ctx = np.where(split > 1, mix64(name + (mix64(nxt) % split.astype(_U) + _U(1)) * _S), name)
        if k > 1 or ctx is not name:
            order = np.argsort(ctx, kind="stable")
            ctx, name, nxt, total, split = ctx[order], name[order], nxt[order], total[order], split[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pair = place[pair]
        self.pair, self.next = pair, nxt
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ctx)), bool), ctx[1:] != ctx[:-1]]))
        kinds = np.diff(np.append(first, len(ctx)))
        self.row = np.repeat(np.arange(len(first)), kinds)
        self.name, self.total, self.split = name[first], total[first], split[first] > 1
        q = np.ones(len(ctx))
        q[pair] = self.p[i]
        return {
            "ctx": ctx[first],
            "kinds": kinds.astype(np.uint32),
            "next": (nxt >> _U(32 if k == 1 else 40)).astype(np.uint32),
            "n": np.bincount(pair, self.train[i], len(ctx)).astype(np.uint32),
            "q": np.clip(np.round(-8 * np.log2(q)), 0, 255).astype(np.uint8),
            "places": np.flatnonzero(self.split).astype(np.uint32),
            "names": self.name[self.split],
        }

    def take(self, c: np.ndarray, kinds: np.ndarray, whole: dict[str, np.ndarray]) -> None:
        """Counts of the pairs, kinds of the contexts (0: not a state), and what is known of whole split contexts."""
        kinds, total = kinds.astype(np.float64), self.total.astype(np.float64)
        at = np.searchsorted(whole["name"], self.name[self.split])
        kinds[self.split] = whole["kinds"][at] * is_state(whole["kinds"][at], whole["gain"][at], total[self.split])
        mine = (kinds > 0)[self.row][self.pair]
        row, j = self.row[self.pair[mine]], self.i[mine]
        self.p[j] = (c[self.pair[mine]] + kinds[row] * self.p[j]) / (total[row] + kinds[row])
        self.names, self.counts = mix64(self.name[self.row] * _K + self.next), c
        self.seq = np.full(len(self.of), -1)
        self.seq[self.i] = self.pair
        self.state = np.zeros(len(self.of), bool)
        self.state[j] = True
        del self.i, self.pair, self.next, self.row, self.name, self.total, self.split

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Sums by text."""
        return np.add.reduceat(x, self.first)


def is_state(kinds: np.ndarray, gain: np.ndarray, total: np.ndarray) -> np.ndarray:
    """gain: sum of count * ln(count / q) over the next symbols."""
    return (gain - total * np.log(np.maximum(total, 1)) >= COST * kinds) & (total >= LEAST)


def meet_words(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    u, of = np.unique(_join(keys, _U), return_inverse=True)
    c = np.bincount(of, _join(counts, np.uint32), len(u)).astype(np.int64)
    return c, np.split(c[of], np.cumsum([len(k) for k in keys])[:-1])


def meet_pairs(rows: list[dict[str, np.ndarray]]) -> tuple[list[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """For rows as of Chunk.pairs: their counts ``c`` and ``kinds`` over all rows (0: not a state), and the split
    contexts with their kinds and gains here; whether those are states, the chunks find."""
    u, of = np.unique(_join([r["ctx"] for r in rows], _U), return_inverse=True)
    ctx = np.repeat(of, _join([r["kinds"] for r in rows], np.uint32))
    key, first, pair = np.unique(ctx.astype(_U) << _U(32) | _join([r["next"] for r in rows], np.uint32), return_index=True, return_inverse=True)
    c = np.bincount(pair, _join([r["n"] for r in rows], np.uint32), len(key)).astype(np.int64)
    of_pair = (key >> _U(32)).astype(np.int64)
    seen = c > 0
    ln_q = _join([r["q"] for r in rows], np.uint8)[first] * (-math.log(2) / 8)
    kinds = np.bincount(of_pair, seen, len(u)).astype(np.uint32)
    gain = np.bincount(of_pair, c * (np.log(np.where(seen, c, 1)) - ln_q), len(u))
    states = kinds * is_state(kinds, gain, np.bincount(of_pair, c, len(u)))
    cs = np.split(c[pair], np.cumsum([len(r["next"]) for r in rows])[:-1])
    ofs = np.split(of, np.cumsum([len(r["ctx"]) for r in rows])[:-1])
    back = [{"c": x, "kinds": states[o].astype(np.uint32)} for x, o in zip(cs, ofs, strict=True)]
    at, one = np.unique(_join([o[r["places"]] for r, o in zip(rows, ofs, strict=True)], np.int64), return_index=True)
    return back, {"name": _join([r["names"] for r in rows], _U)[one], "kinds": kinds[at].astype(np.float64), "gain": gain[at]}


# ---- tables

CHUNKS = "gid long, ids array<long>, size binary, symbols binary, part int, keys binary, counts binary, n long"
WORDS = "part int, gid long, counts binary, n long, v long"
PAIRS = "part int, gid long, ctx binary, kinds binary, next binary, n binary, q binary, places binary, names binary"
REPLIES = "part int, gid long, c binary, kinds binary, whole binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double"


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(schema))


def _ranges(u: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Part, begin and end of the sorted hashes by their leading bits."""
    of = u >> _U(65 - parts.bit_length()) if parts > 1 else np.zeros(len(u), _U)
    cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(u)] if len(u) else [0]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        yield int(of[s]), s, e


def _symbols(docs: DataFrame, parts: int) -> DataFrame:
    """One row a chunk, and one for each part of its words (``keys``, ``counts``; ``n`` symbols of training texts).

    Chunks are numbered by the partition of ``docs`` that they come from. It is a column, as a task that
    writes fewer files takes several partitions, and its own number is then the same for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, size = None, 0
        ids: list[int | None] = []
        texts: list[np.ndarray] = []

        def end() -> pa.RecordBatch:
            x = Chunk.of_texts(ids, texts)
            u, n = x.words()
            rows = [(gid, ids, _zip(x.size.astype(np.uint32)), _planes(x.of.astype(np.uint32)), None, None, None, None)]
            return _batch(rows + [(gid, None, None, None, p, pack_keys(u[s:e]), _zip(n[s:e]), int(n[s:e].sum())) for p, s, e in _ranges(u, parts)], CHUNKS)

        for b in batches:
            if gid is None and b.num_rows:
                gid = b.column(2)[0].as_py() << 24
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(symbols(raw))
                size += len(raw) + 1
                if size >= CHUNK:
                    yield end()
                    ids.clear()
                    texts.clear()
                    gid, size = gid + 1, 0
        if ids:
            yield end()

    return docs.withColumn("partition", F.spark_partition_id().cast("long")).mapInArrow(run, CHUNKS)


def _chunks(rows: DataFrame, groups: int, replies: list[DataFrame]) -> DataFrame:
    """All rows of a chunk together: its own (round -2), its words by part (-1), then the replies of each round by part."""
    none = lambda names: [F.lit(None).cast("binary").alias(n) for n in names]
    no_ids = F.lit(None).cast("array<long>").alias("ids")
    out = rows.where("part IS NULL").select("gid", F.lit(-2).alias("round"), F.lit(0).alias("part"), "ids", "size", "symbols", *none(["c", "kinds"]))
    out = out.unionByName(rows.where("part IS NOT NULL").select("gid", F.lit(-1).alias("round"), "part", no_ids, *none(["size", "symbols"]), F.col("keys").alias("c"), *none(["kinds"])))
    for k, r in enumerate(replies):
        fields = [F.col("counts").alias("c"), *none(["kinds"])] if k == 0 else ["c", "kinds"]
        out = out.unionByName(r.select("gid", F.lit(k).alias("round"), "part", no_ids, *none(["size", "symbols"]), *fields))
    return out.repartition(groups, "gid").sortWithinPartitions("gid", "round", "part")


def _each_chunk(batches: Iterator[pa.RecordBatch], rounds: int, totals: tuple[int, int, int], whole: list[dict[str, np.ndarray]]) -> Iterator[tuple[int, Chunk]]:
    """Chunks with all replies of the rounds taken, the words first."""

    def made(gid: int, own: tuple, got: dict[int, list]) -> tuple[int, Chunk]:
        ids, size, numbers = own
        u = _join([unpack_keys(c) for c, _ in got[-1]], _U)
        x = Chunk(ids, _unzip(size, np.uint32), u, _unplanes(numbers, np.uint32), totals[2])
        x.take_words(_join([_unzip(c, np.int64) for c, _ in got[0]], np.int64), totals[0], totals[1])
        for k in range(1, rounds):
            x.pairs(k)
            x.take(*(_join([_unzip(r[j], t) for r in got[k]], t) for j, t in enumerate((np.int64, np.uint32))), whole[k - 1])
        return gid, x

    gid, own, got = None, None, {}
    for b in batches:
        for g, k, _, *own_, c, kinds in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
            if k == -2:
                if own:
                    yield made(gid, own, got)
                gid, own, got = g, tuple(own_), {k: [] for k in range(-1, rounds)}
            else:
                got[k].append((c, kinds))
    if own:
        yield made(gid, own, got)


def _word_replies(rows: DataFrame, groups: int) -> DataFrame:
    """Corpus counts of each chunk's words, in their order; v: distinct training words, on one row a task's table."""
    rows = rows.where("part IS NOT NULL").select("part", "gid", "keys", "counts", "n")
    rows = rows.repartition(groups, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            part, gid, keys, counts, n = (t.column(i).to_pylist() for i in range(5))
            keys = [unpack_keys(k) for k in keys]
            c, back = meet_words(keys, [_unzip(x, np.uint32) for x in counts])
            v = [int((c > 0).sum())] + [0] * (len(part) - 1)
            yield _batch([*zip(part, gid, map(_zip, back), n, v, strict=True)], WORDS)

    return rows.mapInArrow(run, WORDS)


def _pair_rows(chunks: DataFrame, k: int, totals: tuple[int, int, int], whole: list, parts: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, x in _each_chunk(batches, k, totals, shared.value):
            f, rows = x.pairs(k), []
            after = np.concatenate([[0], np.cumsum(f["kinds"])])
            for p, s, e in _ranges(f["ctx"], parts):
                a, z = int(after[s]), int(after[e])
                i, j = np.searchsorted(f["places"], [s, e])
                rows.append((p, gid, *pack_pairs({"ctx": f["ctx"][s:e], "kinds": f["kinds"][s:e], **{c: f[c][a:z] for c in ("next", "n", "q")}, "places": f["places"][i:j] - np.uint32(s), "names": f["names"][i:j]})))
                if len(rows) == 256:
                    yield _batch(rows, PAIRS)
                    rows = []
            if rows:
                yield _batch(rows, PAIRS)

    return chunks.mapInArrow(run, PAIRS)


def _pair_replies(rows: DataFrame, groups: int) -> DataFrame:
    rows = rows.repartition(groups, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            part, gid, *cols = (t.column(i).to_pylist() for i in range(9))
            back, hot = meet_pairs([unpack_pairs(*r) for r in zip(*cols, strict=True)])
            whole = [np.concatenate([hot["name"].view(np.float64), hot["kinds"], hot["gain"]]).tobytes() if len(hot["name"]) else None] + [None] * (len(part) - 1)
            yield _batch([(p, g, _zip(x["c"]), _zip(x["kinds"]), w) for p, g, x, w in zip(part, gid, back, whole, strict=True)], REPLIES)

    return rows.mapInArrow(run, REPLIES)


def _whole(replies: DataFrame) -> dict[str, np.ndarray]:
    """Kinds and gains of the split contexts, of which there are at most MOST_HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                name, kinds, gain = np.frombuffer(x, np.float64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(kinds), pa.array(gain)], ["name", "kinds", "gain"])

    rows = replies.where("whole IS NOT NULL").select("whole").mapInArrow(run, "name long, kinds double, gain double")
    got = rows.groupBy("name").agg(F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain")).collect()
    got = sorted((r.name & 2**64 - 1, r.kinds, r.gain) for r in got)
    return {"name": np.array([x for x, *_ in got], _U), "kinds": np.array([x for _, x, _ in got], np.float64), "gain": np.array([x for *_, x in got], np.float64)}


@with_scratch
def score_texts(docs: DataFrame, *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> the columns of SCORED, one row a row.

    Null text counts as empty: its only token is the end. A null id counts as the empty text in the
    split. Repeated rows count each time. Very long texts are whole in one chunk. Without training texts
    all counts are 0 and every symbol has probability 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS, 1 << (size // PART_BYTES).bit_length())
    rows = scratch.keep(_symbols(docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")), parts))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, rows.where("part IS NULL").count())
    meets = max(least, min(parts, groups))
    replies = [scratch.keep(_word_replies(rows, meets))]
    tokens, kinds = replies[0].agg(F.sum("n"), F.sum("v")).first()
    totals = (tokens or 0, kinds or 0, max(HOT, -(-(tokens or 0) // MOST_HOT)))
    whole: list[dict[str, np.ndarray]] = []
    for k in range(1, DEPTH + 1):
        replies.append(scratch.keep(_pair_replies(_pair_rows(_chunks(rows, groups, replies), k, totals, whole, parts), meets)))
        whole.append(_whole(replies[k]))
    shared = spark.sparkContext.broadcast(whole)
    rounds = DEPTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _each_chunk(batches, rounds, totals, shared.value):
            score = x.scores(np.log10(x.p))
            cols = [pa.array(x.ids, pa.int64()), x.out, x.size, x.known, np.full(len(x.ids), totals[0], np.int64), x.base, score, score / x.size]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _names(SCORED))

    return _chunks(rows, groups, replies).mapInArrow(run, SCORED)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
