"""Full-text index: positional postings with block maxima, and trigrams of the vocabulary.

Four tables: ``folded`` (id, folded text), ``postings`` (token, block, id, n, positions) in the order of token, block and
id, ``blocks`` (token, block, most, holders) with the highest count of a token among the documents of a block, and
``grams`` (gram, token) over the distinct tokens. Parquet statistics prune all of them by the sorted column, so a
query reads the row groups of its tokens and not the texts.

A substring is found through the vocabulary: each of its pieces is part of a token, the grams name the tokens that
may hold it, positions must follow each other, and only candidates with signs between their pieces are looked at as text.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources import store

#: Documents of a block, about.
BLOCK = 2048
#: Marks of a token's beginning and end inside grams; no token holds them.
HEAD, TAIL = "\x02", "\x03"
_LAST = chr(0x10FFFF)


@dataclass(frozen=True)
class TextIndex:
    folded: DataFrame
    postings: DataFrame
    blocks: DataFrame
    grams: DataFrame


def write_index(rows: DataFrame, id_col: str, body: str, path: str) -> None:
    """Write the tables of an index over ``body``; null bodies are empty texts. Ids must be unique."""
    spark = rows.sparkSession
    rows.select(F.col(id_col).alias("id"), T.fold(body).alias("folded")).write.parquet(f"{path}/folded")
    folded = spark.read.parquet(f"{path}/folded")
    blocks = max(1, -(-folded.count() // BLOCK))
    words = folded.select("id", F.posexplode(T.tokens("folded")).alias("position", "token"))
    posts = words.groupBy("token", "id").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    posts = posts.select("token", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", F.size("positions").alias("n"), "positions")
    posts.repartitionByRange("token", "block", "id").sortWithinPartitions("token", "block", "id").write.parquet(f"{path}/postings")
    posts = spark.read.parquet(f"{path}/postings").select("token", "block", "n")
    tops = posts.groupBy("token", "block").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("holders"))
    tops.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.parquet(f"{path}/blocks")
    tokens = spark.read.parquet(f"{path}/blocks").select("token").distinct()
    padded = F.concat(F.lit(HEAD), "token", F.lit(TAIL))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(padded, i, F.lit(3))))
    tokens.select(F.explode(grams).alias("gram"), "token").repartitionByRange("gram", "token").sortWithinPartitions("gram", "token").write.parquet(f"{path}/grams")


def open_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("folded", "postings", "blocks", "grams")))


def index_of(rows: DataFrame, id_col: str, body: str) -> TextIndex:
    """The index of a table's column, made when it is first asked for."""
    path = store.derived(rows, f"text-{id_col}-{body}", lambda at: write_index(rows, id_col, body, at))
    return open_index(rows.sparkSession, path)


def _begins(words: list[str]) -> Column:
    """Tokens that begin with one of the words, as ranges that statistics prune."""
    return functools.reduce(lambda a, b: a | b, [(F.col("token") >= w) & (F.col("token") < w + _LAST) for w in words], F.lit(False))


def term_hits(index: TextIndex, words: list[str]) -> DataFrame:
    """id, n: how many positions of each text begin with one of the words, for texts that have any."""
    return index.postings.where(_begins(words)).groupBy("id").agg(F.sum("n").alias("n"))


def term_topk(index: TextIndex, words: list[str], k: int) -> DataFrame:
    """id, n of texts that can be among the k with the most matching positions, all ties of the k-th included.

    A block's texts have at most the sum of its tokens' maxima, and one of them at least the largest; the k-th
    of these least values over the blocks is a bound that k texts reach. Postings of blocks below it are not read.
    """
    bounds = index.blocks.where(_begins(words)).groupBy("block").agg(F.sum("most").alias("bound"), F.max("most").alias("least"))
    kth = bounds.orderBy(F.col("least").desc()).limit(k).agg(F.when(F.count(F.lit(1)) == k, F.min("least")).otherwise(0).alias("need"))
    kept = bounds.join(F.broadcast(kth), F.col("bound") >= F.col("need")).select("block")  # ``kth`` is one row
    hits = index.postings.where(_begins(words)).join(kept, "block", "left_semi").groupBy("id").agg(F.sum("n").alias("n"))
    return hits


def _pieces(needle: str) -> list[tuple[str, bool, bool]]:
    """Words of a folded needle, and whether a token must begin or end with each."""
    return [(needle[a:b], a > 0, b < len(needle)) for a, b in T.word_runs(needle)]


def tokens_with(index: TextIndex, piece: str, begins: bool = False, ends: bool = False) -> DataFrame:
    """token: those of the vocabulary that hold a piece (at their beginning, at their end)."""
    padded = HEAD * begins + piece + TAIL * ends
    grams = sorted({padded[i : i + 3] for i in range(len(padded) - 2)})
    if grams:
        found = index.grams.where(F.col("gram").isin(grams)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("token")
    else:
        found = index.blocks.select("token").distinct()
    return found.where(F.concat(F.lit(HEAD), "token", F.lit(TAIL)).contains(padded))


def substring_candidates(index: TextIndex, pieces: list[tuple[str, bool, bool]]) -> DataFrame:
    """id of texts in which tokens with the pieces follow each other in their order."""
    found = None
    for i, piece in enumerate(pieces):
        own = index.postings.join(tokens_with(index, *piece), "token", "left_semi")
        if len(pieces) == 1:
            return own.select("id").distinct()
        own = own.select("id", F.explode("positions").alias("at")).select("id", (F.col("at") - i).alias("at")).distinct()
        found = own if found is None else found.join(own, ["id", "at"], "left_semi")
    return found.select("id").distinct()


def substring_hits(index: TextIndex, query: str) -> DataFrame:
    """id of texts whose folded form holds the folded query; an empty query is held by none."""
    needle = T.folded(query)
    if not needle:
        return index.folded.select("id").where(F.lit(False))
    pieces = _pieces(needle)
    if not pieces:
        return index.folded.where(F.col("folded").contains(needle)).select("id")
    found = substring_candidates(index, pieces)
    if len(pieces) == 1 and pieces[0][0] == needle:
        return found
    return index.folded.join(found, "id", "left_semi").where(F.col("folded").contains(needle)).select("id")


def text_hits(index: TextIndex, query: str) -> DataFrame:
    """id, rank of texts that a query finds by its terms or as a substring; ``search.score`` gives the same rank."""
    raw = query.strip()
    words = T.terms(raw)
    inside = substring_hits(index, raw).select("id", F.lit(0.9).alias("rank"))
    r = F.col("n") * F.lit(0.1)
    by_term = term_hits(index, words if raw else []).select("id", (r / (r + 1)).alias("rank"))
    return by_term.unionByName(inside).groupBy("id").agg(F.max("rank").alias("rank"))
