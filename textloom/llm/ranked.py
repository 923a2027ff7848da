"""Ranked lexical search, score at a time over impact-ordered postings.

Scores are whole numbers: a term of weight w that occurs in a document adds w times an impact that depends on
its count and the document's length alone. Statistics of the collection (documents, terms, documents a
term) come first, from all documents. Then each task indexes its documents a block at a time: postings of a
term are grouped by exact impact, highest first. A query takes the groups of its terms in descending order of
what they add, and stops only when the bounds of what remains prove that no document outside a short list can
be among its best k; the scores of that list are then completed from the documents' own terms. The k-th
score of a task's earlier blocks is the bound that the later ones start from.

Queries are a stated set against all documents: they come to the driver in blocks of bounded bytes, documents
never do. A task returns at most k rows a query, and these are merged in two steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, prepare, read, utf8, with_scratch

K = 20
#: Bytes of queries that are searched together, and of the texts that are indexed together.
QUERY_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
#: What a query counts besides its text.
ROW_BYTES = 100
#: Documents that a query may complete at its end, besides its k.
SHORT = 60
#: A step takes all groups that add at least this share of the highest not yet taken.
STEP = 0.7
#: Second-level groups of the merge.
SALTS = 64
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")  # signs outside ASCII are bytes from 0x80 on in UTF-8
_LAST = np.iinfo(np.int64).max


def terms_of(raw: bytes) -> list[bytes]:
    return _TERM.findall(raw.lower())  # bytes.lower changes A-Z alone


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a unit of weight adds for ``tf`` occurrences in a document of n terms."""
    m = 75 + 25 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Block:
    """Postings of some documents, which go by their place."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray, size: int, vocabulary: int):
        """docs, terms and impact by posting, in order of docs; ``size`` documents."""
        self.size, self.taken = size, 0  # documents; postings that the last search has added up
        self.own_terms, self.own_impact = terms, impact
        self.own = np.searchsorted(docs, np.arange(size + 1))
        order = np.lexsort((-impact, terms))
        self.docs, t, u = docs[order], terms[order], impact[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
        self.group = np.append(np.flatnonzero(first), len(t))  # groups of exact impact
        self.impact = u[self.group[:-1]]
        self.term = np.searchsorted(t[self.group[:-1]], np.arange(vocabulary + 1))  # a term's groups

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, bound: tuple[int, int], ids: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of documents that may be among the best k, all that are included.

        ``bound`` is the k-th (score, id) already known, or (0, ...): what is not above it needs no place.
        ``dense`` is a zero for each term of the vocabulary, left so.
        """
        low, high = self.term[terms], self.term[terms + 1]
        some = (low < high) & (weight > 0)
        low, high, weight, terms = low[some], high[some], weight[some], terms[some]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        nxt = weight * self.impact[low] if len(low) else low  # the highest sum that each term can still add
        if not len(low) or nxt.sum() < bound[0]:
            return none
        scores, self.taken = np.zeros(self.size, np.int64), 0
        while True:
            least = max(1, int(nxt.max() * STEP))
            for i in np.flatnonzero(nxt >= least):
                a, b, w = low[i], high[i], weight[i]
                e = a + int(np.searchsorted(-self.impact[a:b], -(-(-least // w)), "right"))
                at = self.docs[self.group[a] : self.group[e]]  # a document occurs once in a term's postings
                self.taken += len(at)
                scores[at] += w * np.repeat(self.impact[a:e], np.diff(self.group[a : e + 1]))
                low[i] = e
                nxt[i] = w * self.impact[e] if e < b else 0
            rest = int(nxt.sum())
            kth = int(np.partition(scores, -k)[-k]) if self.size >= k else 0
            need = max(kth, bound[0], 1)
            listed = np.flatnonzero(scores + rest >= need)
            if not rest or len(listed) <= k + SHORT:
                break
        if rest:
            dense[terms] = weight
            scores = np.array([int((dense[self.own_terms[a:b]] * self.own_impact[a:b]).sum()) for a, b in zip(self.own[listed], self.own[listed + 1], strict=True)], np.int64)
            dense[terms] = 0
        else:
            scores = scores[listed]
        good = (scores > bound[0]) | ((scores == bound[0]) & (ids[listed] < bound[1]))
        good &= scores > 0
        return listed[good], scores[good]


def _statistics(docs: DataFrame, vocabulary: dict[bytes, int], scratch: Scratch) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each term of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(known.value) + 2, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                terms = terms_of(raw)
                held[-1] += len(terms)
                held[-2] += len(terms) > 0
                mine = known.value.keys() & set(terms)
                held[[known.value[t] for t in mine]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "n"])

    x = scratch.keep(docs.select("raw").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
    held = np.zeros(len(vocabulary) + 2, np.int64)
    for term, n in x.toLocalIterator():  # a row a term of the queries
        held[term] = n
    return int(held[-2]), int(held[-1]), held[:-2]


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))).astype(np.int64)


def _blocks(items: DataFrame, text: str) -> Iterator[list[tuple]]:
    """Rows (item, terms) in blocks of at most QUERY_BYTES, or of one row."""
    block, size = [], 0
    for item, raw in items.select(items.columns[0], utf8(text).alias("raw")).toLocalIterator():
        if block and size + len(raw) > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((item, terms_of(raw)))
        size += len(raw) + ROW_BYTES
    if block:
        yield block


@with_scratch
def top_documents(docs: DataFrame, items: DataFrame, k: int = K, *, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text; other columns ignored), items (item_id, text) -> item_id, rank, doc_id, score: the k documents of
    highest score above 0 for each row of items (fewer if there are no more), equal scores by ascending doc_id.

    Whole texts; null and empty texts have no terms and are found by nothing. Repeated rows of docs are documents of
    their own; a null doc_id comes after all others of its score. Each row of items is a query of its own, null ids included;
    one without terms finds nothing. An empty table on either side gives an empty result.
    """
    prepare(docs.sparkSession)
    items = items.select(F.col("item_id"), F.col("text"))
    kind = items.schema["item_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long"), utf8().alias("raw"))
    found = None
    for block in _blocks(items, "text"):
        x = scratch.keep(_search(docs, block, k, scratch))
        names = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {kind.simpleString()}")
        x = x.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row a query of the block
        found = x if found is None else found.unionByName(x)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")


def _search(docs: DataFrame, block: list[tuple], k: int, scratch: Scratch) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    for _, terms in block:
        for t in terms:
            vocabulary.setdefault(t, len(vocabulary))
    documents, length, holding = _statistics(docs, vocabulary, scratch)
    weight = weights(documents, holding)
    queries = []
    for _, terms in block:
        times = Counter(vocabulary[t] for t in terms)
        at = np.fromiter(times, np.int64, len(times))
        queries.append((at, np.fromiter(times.values(), np.int64, len(times)) * weight[at]))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, queries))  # bounded by QUERY_BYTES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = shared.value
        dense = np.zeros(len(known), np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)  # ids, scores: best first, at most k
        for ids, (place, term, tf, n) in _postings(batches, known):
            index = Block(place, term, impacts(tf, n, documents, length), len(ids), len(known))
            for q, (terms, weight) in enumerate(asked):
                old_ids, old_scores = best[q]
                bound = (int(old_scores[-1]), int(old_ids[-1])) if len(old_ids) == k else (0, _LAST)
                at, scores = index.search(terms, weight, k, bound, ids, dense)
                if len(at):
                    every, score = np.append(old_ids, ids[at]), np.append(old_scores, scores)
                    first = np.lexsort((every, -score))[:k]
                    best[q] = every[first], score[first]
        sizes = [len(i) for i, _ in best]
        columns = [np.repeat(np.arange(len(best), dtype=np.int32), sizes), np.concatenate([i for i, _ in best]), np.concatenate([s for _, s in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "doc_id", "score"])

    order = [F.col("score").desc(), F.col("doc_id")]
    x = docs.mapInArrow(search, "query int, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (["query", "salt"], ["query"]):
        x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return x.select("query", "rank", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "score")


def _postings(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of texts of about BLOCK_BYTES together: their ids (null as the highest), and by posting in their order the
    place of the document, the term, its count and the document's terms."""
    ids: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for b in batches:
        own: list[tuple[int, int, int, int]] = []
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            terms = terms_of(raw)
            times = Counter(map(known.get, terms))
            times.pop(None, None)
            own += [(len(ids), t, c, len(terms)) for t, c in times.items()]
            ids.append(_LAST if i is None else i)
            size += len(raw)
        if own:
            parts.append(np.array(own, np.int64).T)
        if size >= BLOCK_BYTES:
            if parts:
                yield np.array(ids, np.int64), np.concatenate(parts, 1)
            ids, parts, size = [], [], 0
    if parts:
        yield np.array(ids, np.int64), np.concatenate(parts, 1)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, term, CAST(len AS BIGINT) AS size, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * s.n) // s.l)))) AS BIGINT) AS score FROM i JOIN g USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= {K}"""
