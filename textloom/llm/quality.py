"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are n-grams (n = 1, 2) of its lower-cased words and n-grams (n = 1, 2, 3) of the
words' shapes: runs of capitals, small letters and digits shrunk to one sign each, other signs kept,
and a mark on a word that equals the word one or two before it. A feature's value is its share of
the text's n-grams of that family, so long texts weigh no more than short ones. All are hashed into
2**BITS weights.

Training data: at most ``SAMPLE`` labelled documents and ``SAMPLE_BYTES`` of text, those with the lowest
hash of doc_id among rows whose crc32(doc_id) mod 3 is not 1, one row a doc_id; they are read by one task
that returns the weights (1 MB). Scoring sums weights over whole texts where the rows lie, without an
exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import crc_of_id, mix64, prepare, utf8

BITS = 18
SAMPLE, SAMPLE_BYTES = 8_000, 64_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 8.0
FAMILIES = 5

#: Signs of the shapes: A capitals, a other letters and all bytes beyond ASCII, 0 digits.
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
_RUNS = re.compile(rb"([Aa0])\1+")
_U = np.uint64
_SALT = [_U((i + 1) * 0xD1B54A32D192ED03 & 2**64 - 1) for i in range(FAMILIES)]


class WordCodes(dict):
    """raw word -> 64 bits: hash of the lower-cased word above, hash of its shape in the low 20."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.LIMIT:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
        value = xxh3_64_intdigest(word.lower()) & ~0xFFFFF | xxh3_64_intdigest(shape) & 0xFFFFF
        if len(word) < 256:
            self[word] = value
        return value


_codes = WordCodes()


def features(raw: bytes) -> list[np.ndarray]:
    """Hashed indices of the n-grams, by family; a text without words has none."""
    words = raw.split()
    n = len(words)
    if not n:
        return [np.zeros(0, np.int64)] * FAMILIES
    code = np.fromiter(map(_codes.__getitem__, words), _U, n)
    word = code >> _U(20)
    shape = code & _U(0xFFFFF)
    same = np.zeros(n, _U)
    same[1:] = word[1:] == word[:-1]
    same[2:] |= (word[2:] == word[:-2]).astype(_U) << _U(1)
    shape = shape << _U(2) | same
    k = _U(0x9E3779B97F4A7C15)
    grams = [word, word[:-1] * k + word[1:], shape, shape[:-1] * k + shape[1:]]
    grams.append(grams[3][:-1] * k + shape[2:])
    return [(mix64(g + _SALT[i]) >> _U(64 - BITS)).astype(np.int64) for i, g in enumerate(grams)]


def margin(w: np.ndarray, bias: float, found: list[np.ndarray]) -> float:
    return bias + SCALE * sum(float(w[f].mean()) for f in found if len(f))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal; the bias is a feature of value 1 without penalty. Rows in the order given."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    zb = nb = bias = 0.0
    rows = []
    for t in texts:
        index, value = [], []
        for f in features(t):
            if len(f):
                i, c = np.unique(f, return_counts=True)
                index.append(i)
                value.append(c * (SCALE / len(f)))
        i, at = np.unique(np.concatenate([np.zeros(0, np.int64), *index]), return_inverse=True)  # families may meet in a weight
        rows.append((i.astype(np.int32), np.bincount(at, np.concatenate([np.zeros(0), *value]), len(i))))
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(bias + wi @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - s * wi
            n[i] = ni + g * g
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * bias
            nb += gb * gb
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w.astype(np.float32), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """h, doc_id, raw, y: the labelled texts to learn from, one row a doc_id, bounded in rows and bytes."""
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(crc_of_id() % 3 != 1)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    chosen = chosen.orderBy("h", "doc_id").limit(sample)  # the documented bound, so it may be broadcast
    texts = docs.select("doc_id", utf8().alias("raw")).withColumn("th", F.xxhash64("raw"))
    sized = texts.join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "quality").agg(F.min(F.struct("th", F.octet_length("raw").alias("n"))).alias("x"))
    upto = F.sum("x.n").over(Window.orderBy("h", "doc_id"))  # over ``sample`` rows at most
    kept = sized.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("h", "doc_id", "x.th", F.col("quality").cast("int").alias("y"))
    return texts.join(F.broadcast(kept), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("h", "doc_id", "raw", "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """labels (doc_id, quality) joined to docs (doc_id, text). Null labels and ids are left out, of several
    labels of a doc_id the lowest counts, of several texts the one with the lowest hash; null text counts as
    empty. Without rows: weights 0."""
    prepare(docs.sparkSession)
    rows = sample_rows(docs, labels, sample, sample_bytes).repartition(1).sortWithinPartitions("h", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ys: list[int] = []
        for b in batches:
            texts += b.column(2).to_pylist()
            ys += b.column(3).to_pylist()
        w, bias = fit(texts, ys)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    got = rows.mapInArrow(run, "w binary, bias double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(bytes(got[0].w), np.float32), got[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """docs -> the columns ``keep`` plus score, the probability of label 1. Null text counts as empty;
    a text without words gets the score of the bias."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    pick = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], utf8().alias("raw"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in pick.schema.fields[:-1]] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            m = np.array([margin(w, bias, features(x)) for x in b.column(b.num_columns - 1).to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(m, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*b.schema.names[:-1], "score"])

    out = pick.mapInArrow(run, schema)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"k{i}", c)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
