"""Ranked search over folded text, entity search, and retrieval for question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.scalars import cosine
from textloom.operators.index import TextIndex, substring_hits, text_hits
from textloom.operators.order import first_rows


def indexed(rows: DataFrame, body: str) -> DataFrame:
    """The derived column that searches of raw rows need, the folded text; ``index`` keeps it."""
    return rows.withColumn("folded", T.fold(body))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of an input that has fewer files than there are cores, dealt over all of them; larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def score(query: str, ref_hit: Column | None = None, entity_hit: Column | None = None, by_terms: bool = True) -> Column:
    """The best of: term rank, 0.9 for a substring, 1.0 for a reference, 0.6 for a linked entity."""
    folded = T.fold(F.lit(query.strip()))
    parts = [T.term_rank(F.col("folded"), T.terms(query) if by_terms else []), F.when(F.col("folded").contains(folded), 0.9).otherwise(0.0)]
    if ref_hit is not None:
        parts.append(F.when(ref_hit, 1.0).otherwise(0.0))
    if entity_hit is not None:
        parts.append(F.when(entity_hit, 0.6).otherwise(0.0))
    return F.greatest(*parts)


def search(rows: DataFrame, query: str, order: list[Column], limit: int = 20, offset: int = 0, ref_hit: Column | None = None, entity_hit: Column | None = None, by_terms: bool = True) -> DataFrame:
    """rows as from ``indexed``. An empty query finds nothing. Limits are clamped to 1..100."""
    if not query.strip():
        return rows.withColumn("rank", F.lit(0.0)).where(F.lit(False))
    hits = rows.withColumn("rank", score(query, ref_hit, entity_hit, by_terms).cast("float")).where("rank > 0")
    return hits.orderBy(F.col("rank").desc(), *order).offset(max(0, offset)).limit(max(1, min(limit, 100)))


def search_index(index: TextIndex, rows: DataFrame, id_col: str, query: str, order: list[Column], limit: int = 20, offset: int = 0, ref_hit: Column | None = None, entity_hit: Column | None = None, by_terms: bool = True) -> DataFrame:
    """``search`` of rows whose texts an index holds, equal to it; the texts are not read."""
    if not query.strip():
        return rows.withColumn("rank", F.lit(0.0)).where(F.lit(False))
    hits = text_hits(index, query) if by_terms else substring_hits(index, query).select("id", F.lit(0.9).alias("rank"))
    other = [F.when(hit, rank) for hit, rank in ((ref_hit, 1.0), (entity_hit, 0.6)) if hit is not None]
    found = rows.join(hits.withColumnRenamed("id", id_col), id_col, "left" if other else "inner")
    found = found.withColumn("rank", F.greatest(F.col("rank"), *other, F.lit(0.0)).cast("float")).where("rank > 0")
    return found.orderBy(F.col("rank").desc(), *order).offset(max(0, offset)).limit(max(1, min(limit, 100)))


def search_entities(names: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """names (kind, slug, matched): distinct matches of the folded query under a total order."""
    q = T.fold(F.lit(query.strip()))
    hits = names.where(T.fold("matched").contains(q)).distinct() if query.strip() else names.where(F.lit(False))
    return hits.orderBy("kind", "slug", "matched").limit(max(1, min(limit, 100)))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, least: float, id_col: str, gate: Column | None = None) -> DataFrame:
    """Exact top k (1..50) by cosine similarity; a TakeOrdered, so no full sort."""
    sim = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6)
    rows = vectors if gate is None else vectors.where(gate)
    return rows.withColumn("similarity", sim).where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), id_col).limit(max(1, min(k, 50)))


def hybrid(arms: list[DataFrame], key: list[str], position: str, most: int) -> DataFrame:
    """Union of retrieval arms; the first arm that holds a key wins; then arm order, then position."""
    every = None
    for i, a in enumerate(arms):
        a = a.withColumn("arm", F.lit(i))
        every = a if every is None else every.unionByName(a)
    return first_rows(every, key, [F.col("arm"), F.col(position)]).orderBy("arm", position, *key).limit(most)


def group_topk(hits: DataFrame, group: str, rank: str, k: int) -> DataFrame:
    """Groups by summed rank (in double), best k under a total order."""
    return hits.groupBy(group).agg(F.round(F.sum(F.col(rank).cast("double")), 6).alias("total")).orderBy(F.col("total").desc(), group).limit(k)


def grouped_page(hits: DataFrame, group: list[str], order: list[str], fields: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of hits in groups: group, hits in their order. The page is cut first, so no group is larger than it."""
    from textloom.operators.documents import nested

    page = hits.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 100)))
    return nested(page, group, order, fields, "hits")


def grouped_hits(hits: DataFrame, group: list[str], order: list[str], field: str, sep: str = ",", name: str = "hits") -> DataFrame:
    """All hits in groups: group, ``name``: ``field`` of its hits in the order of ``order``, joined. Ranges of the order are joined
    each by itself, so a group is never one list; only the texts of its ranges meet."""
    ranged = hits.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(field).cast("string").alias("v"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["v"]), sep)
    parts = ranged.where(F.col(field).isNotNull()).groupBy(*group, "_range").agg(joined(item).alias("_text"))
    return parts.groupBy(*group).agg(joined(F.struct(F.col("_range"), F.col("_text").alias("v"))).alias(name))


def history_window(rows: DataFrame, session: str, newest: list[Column], fetched: int = 6, most: int = 6, clamp: int = 600, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The newest ``fetched`` rows of a session, then blanks and other roles dropped, the last ``most``
    kept, oldest first (turn), whitespace collapsed and clipped."""
    w = Window.partitionBy(session).orderBy(*newest)
    x = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= fetched)
    x = x.withColumn("content", F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, clamp)).where((F.col("content") != "") & F.col("role").isin(*roles))
    x = x.withColumn("_m", F.row_number().over(Window.partitionBy(session).orderBy("_n"))).where(F.col("_m") <= most)
    return x.withColumn("turn_no", F.row_number().over(Window.partitionBy(session).orderBy(F.col("_m").desc()))).drop("_n", "_m")


def answers_today(messages: DataFrame, sessions: DataFrame, uid: str, now: Column, key: str = "session_id") -> DataFrame:
    mine = sessions.where(F.col("user_id") == uid).select(key)
    today = messages.where((F.col("role") == "assistant") & (F.col("created_at") >= F.date_trunc("DAY", now)))
    return today.join(mine, key, "left_semi").agg(F.count(F.lit(1)).alias("used"))


def cap_reached(signed_in: Column, cap: Column, used: Column) -> Column:
    """A cap of 0 disables the cap."""
    return signed_in & (cap > 0) & (used >= cap)


def offline_search(verses: DataFrame, mentions: DataFrame, entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """verses (ref, body, position): 1.0 for the reference, 0.9 for a substring of raw or folded text, 0.5
    for a mention of an entity whose name matches; best rank first, then position."""
    q = query.strip()
    if not q:
        return verses.withColumns({"rank": F.lit(0.0), "snippet": F.lit("")}).where(F.lit(False))
    folded = T.fold(F.lit(q))
    linked = mentions.join(entities.where(T.fold("name").contains(folded)).select("kind", "id"), ["kind", "id"], "left_semi").select("ref").distinct().withColumn("_m", F.lit(True))
    x = verses.withColumn("folded", T.fold("body")).join(linked, "ref", "left")
    rank = F.when(F.col("ref") == q, 1.0).when(F.col("body").contains(q) | F.col("folded").contains(folded), 0.9).when(F.col("_m"), 0.5)
    needle = " ".join(T.terms(q)) or q
    x = x.withColumns({"rank": rank, "snippet": T.snippet("body", "folded", needle)}).where("rank IS NOT NULL").drop("_m", "folded")
    return x.orderBy(F.col("rank").desc(), "position").limit(max(1, min(limit, 100)))
