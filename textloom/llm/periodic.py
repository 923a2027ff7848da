"""Periodic runs of words: heavy/light lag counting, then island scans of the few lags that remain.

A run is a stretch of consecutive words with smallest period q and length at least max(6, 4 * q) that
no neighbouring word extends. Seen at lag q it is an island of positions i with word i = word i + q, at
least max(6 - q, 3 * q) of them on end, so a lag with fewer such positions in the whole text holds none.
How many each lag has is counted exactly without comparing the text with itself: frequent words by
autocorrelation of their indicators (one transform each, one inverse for all), rare words by the
differences of their positions. Lags with enough matches are probed by hashes of blocks of q words, two
equal blocks on end in each island, and scanned word by word around these alone.

Texts are independent rows, so nothing is shuffled and a text is the largest unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import crc_of_id, prepare, read, utf8

LEAST, TIMES = 6, 4
#: Odd multiplier of the block hashes (fixed value); equality of blocks is confirmed on the words.
_BASE = 0x9E3779B97F4A7C15


def word_codes(words: list[bytes]) -> np.ndarray:
    """Small numbers that are equal where words are."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


def lag_counts(x: np.ndarray, most: int) -> np.ndarray:
    """counts[q], q up to ``most``: positions i with x[i] == x[i + q]; exact."""
    n = len(x)
    counts = np.zeros(most + 1, np.int64)
    size = 1 << int(n + most).bit_length()
    times = np.bincount(x)
    heavy = np.flatnonzero(times * times > size * size.bit_length() // 2)  # dearer by pairs than by a transform
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for code in heavy:
            spectrum = np.fft.rfft(x == code, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(x, kind="stable")
    light = (times > 1) & ~np.isin(np.arange(len(times)), heavy)
    at = order[light[x[order]]]
    end = np.cumsum(np.bincount(x[at], minlength=len(times)))[x[at]] if len(at) else at  # past the positions of the same word
    here = np.arange(len(at))
    step = 1
    while len(here):
        here = here[here + step < end[here]]
        lag = at[here + step] - at[here]
        near = lag <= most  # positions ascend within a word: what is too far stays so
        here, lag = here[near], lag[near]
        counts += np.bincount(lag, minlength=most + 1)
        step += 1
    counts[0] = 0
    return counts


def _prefix_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes, modulo 2**64, and the powers of the base: h[b] - h[a] * power[b - a] is a block's."""
    from textloom.llm.common import mix64

    n = len(x)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))
        signs = mix64(x.astype(np.uint64) + np.uint64(0x1234567))
        h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(signs * inverse[1:])]) * power
    return h, power


def islands(x: np.ndarray, q: int, h: np.ndarray, power: np.ndarray, known: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Stretches [start, end) in which words q apart are equal, of at least max(LEAST, TIMES * q) words; those that are runs of
    ``known`` periods, which divide q, may be left out."""
    n, least = len(x), max(LEAST, TIMES * q)
    if q <= 8:  # blocks of a few words tell less than the scan itself
        spans = [(0, n - q)]
    else:
        cuts = np.arange(0, n - 2 * q + 1, q)
        with np.errstate(over="ignore"):
            block = h[cuts + q] - h[cuts] * power[q]
            after = h[cuts + 2 * q] - h[cuts + q] * power[q]
        cuts = cuts[block == after]
        for d in _divisors_of(q) if len(cuts) else ():
            if d in known:  # what holds two periods of q inside a run of d is part of that run
                starts, ends = known[d].T
                i = np.maximum(np.searchsorted(starts, cuts, "right") - 1, 0)
                cuts = cuts[(starts[i] > cuts) | (ends[i] < cuts + 2 * q)]
        if not len(cuts):
            return []
        new = np.flatnonzero(np.diff(cuts, prepend=cuts[0] - 2 * q) > q)
        last = np.append(new[1:], len(cuts)) - 1
        # an island holds two whole blocks or more, and less than a block on either side
        spans = [(max(0, int(cuts[a]) - q), min(n - q, int(cuts[b]) + 2 * q)) for a, b in zip(new, last, strict=True) if a < b]
    out = []
    for low, high in spans:
        same = np.zeros(high - low + 2, np.int8)
        same[1:-1] = x[low:high] == x[low + q : high + q]
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1) + low, np.flatnonzero(edge == -1) + low, strict=True):
            if b - a + q >= least:
                out.append((int(a), int(b) + q))
    return out


def _primes_of(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _divisors_of(q: int) -> list[int]:
    """Proper divisors."""
    low = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return sorted({*low, *(q // d for d in low)} - {q})


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n = len(x)
    most = n // TIMES
    if n < LEAST or not most:
        return []
    counts = lag_counts(x, most)
    q = np.arange(most + 1)
    lags = np.flatnonzero(counts >= np.maximum(np.maximum(LEAST - q, (TIMES - 1) * q), 1))
    h, power = _prefix_hashes(x) if len(lags) and lags[-1] > 8 else (x, x)
    found, known = [], {}
    for q in map(int, lags):
        # a smaller period of so long a stretch divides q; then the stretch is that period's run
        own = [(a, b) for a, b in islands(x, q, h, power, known) if not any(np.array_equal(x[a : b - q // p], x[a + q // p : b]) for p in _primes_of(q))]
        if own:
            known[q] = np.array(own)
            found += [(a, b - a, q) for a, b in own]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> doc_id, n_words, runs by start and period, and ``collapsed``: the words
    that stay if each run keeps its first period, joined by blanks.

    Whole texts; null and empty texts have no words, no runs and an empty ``collapsed``. Rows are independent: null ids,
    ties and repeated rows each give their row, an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, every, texts = [], [], []
            for raw in b.column(1).to_pylist():
                words = raw.split()
                runs = runs_of(word_codes(words)) if len(words) >= LEAST else []
                sizes.append(len(words))
                every.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                if runs:
                    words = [words[i] for i in np.flatnonzero(_kept(len(words), runs)).tolist()]
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(every, _RUN), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")).mapInArrow(run, RUNS)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, those whose id has a crc32 divisible by 10, rewritten so that their words from
    one place on repeat the first words there (contract of ``op13``). A null id has no decimal form, its text stays."""
    h = F.when(F.col("doc_id").isNotNull(), crc_of_id())
    g = F.floor(h / 10)
    x = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    x = x.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    x = x.withColumn("n", F.size("w").cast("long"))
    x = x.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    x = x.withColumns({"rest": rest.cast("int"), "p": (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")})
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int")))
    text: Column = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("rest"))), " ")
    return x.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of all documents, a tenth of them with repeated tails."""
    x = periodic_runs(repeated_tails(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    x = x.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return x.select(
        "doc_id", "n_words", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
