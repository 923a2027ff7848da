"""Nested result documents: hierarchy, section payload, verse and entity detail, bundle, catalogue.

Children are aggregated by their key before they are joined, so each document costs one shuffle a
level; order inside is explicit (the sort key leads the struct). The tree of sections is held as intervals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import store


def nested(rows: DataFrame, key: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """key, name: array of structs of ``fields`` in the order of ``order``."""
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*fields).alias("v"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))


def with_children(parents: DataFrame, children: DataFrame, key: list[str], name: str) -> DataFrame:
    """Left join; parents without children get an empty array, not null."""
    kind = children.schema[name].dataType.simpleString()
    return parents.join(children, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def as_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _doubled(state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Rounds of ``step`` over rows (id, up, ...), each of which reaches twice as far up, until every row has passed its top."""
    n = state.count()
    for _ in range(n.bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            return state
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"up_{c}") for c in state.columns if c not in ("id", "up")])
        state = step(state, above).checkpoint()
    raise ValueError("the parents of some sections form a cycle")


def _sum_up(state: DataFrame, above: DataFrame) -> DataFrame:
    more = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("s"), F.sum("total").alias("t"))
    x = state.join(more, "id", "left").join(above.select("up", "next"), "up", "left")
    return x.select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), (F.col("total") + F.coalesce("t", F.lit(0))).alias("total"))


def _add_above(state: DataFrame, above: DataFrame) -> DataFrame:
    x, zero = state.join(above, "up", "left"), F.lit(0)
    low, depth = F.col("low") + F.coalesce("up_low", zero), F.col("depth") + F.coalesce("up_depth", zero)
    return x.select("id", F.col("next").alias("up"), low.alias("low"), depth.alias("depth"), (F.col("lost") | F.coalesce("up_lost", F.lit(False))).alias("lost"))


def _subtrees(sections: DataFrame, leaves: DataFrame) -> DataFrame:
    """The sections with ``up`` (their parent, if it is there), ``lost`` (it is not), ``size`` and ``total`` of their subtrees."""
    store.shared_folder(sections.sparkSession)
    there = sections.select(F.col("id").alias("parent_id"), F.lit(True).alias("found")).distinct()
    own = leaves.groupBy(F.col("section_id").alias("id")).agg(F.sum("n").cast("long").alias("total"))
    start = sections.join(there, "parent_id", "left").join(own, "id", "left")
    up, lost = F.when(F.col("found"), F.col("parent_id")), F.col("parent_id").isNotNull() & F.col("found").isNull()
    start = start.select(*sections.columns, up.alias("up"), lost.alias("lost"), F.lit(1).cast("long").alias("size"), F.coalesce("total", F.lit(0).cast("long")).alias("total")).checkpoint()
    sizes = _doubled(start.select("id", "up", "size", "total"), _sum_up).select("id", "size", "total")
    return start.drop("size", "total").join(sizes, "id")


def section_labels(sections: DataFrame, leaves: DataFrame) -> DataFrame:
    """sections (id, work_id, parent_id, ordinal, ref; other columns kept) with ``low``, ``high``, ``depth``, ``total``.

    ``low`` numbers the sections of a work in the order of reading, parents first; a section's subtree is exactly
    low <= x < high. ``depth`` counts from 1, ``total`` sums ``leaves`` (section_id, n) over the subtree. Sections under a
    parent that is not there are left out; a cycle is an error.

    Sums go up and offsets come down by doubling: a round holds one row a section, so the rounds grow with the
    logarithm of the depth and the rows not at all. Each round is checkpointed.
    """
    rows = _subtrees(sections, leaves)
    before = Window.partitionBy("work_id", "parent_id").orderBy("ordinal", "ref", "id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.when(F.col("up").isNull(), 0).otherwise(1)
    rows = rows.withColumn("low", offset).checkpoint()
    placed = _doubled(rows.select("id", "up", "low", F.lit(1).alias("depth"), "lost"), _add_above).where(~F.col("lost")).select("id", "low", "depth")
    out = rows.drop("low").join(placed, "id")
    return out.select(*sections.columns, "low", (F.col("low") + F.col("size")).alias("high"), "depth", "total")


def subtree_counts(sections: DataFrame, leaves: DataFrame) -> DataFrame:
    """section_id, total: rows of ``leaves`` (section_id, n) in each section's whole subtree, any depth, where there are any."""
    return _subtrees(sections, leaves).where("total > 0").select(F.col("id").alias("section_id"), "total")


def leaf_sections(sections: DataFrame) -> DataFrame:
    return sections.join(sections.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")


def toc(sections: DataFrame, verses: DataFrame) -> DataFrame:
    """work_id, contents: JSON of the top sections in order, each with its count and its own sections, any depth. Sections in the
    order of their labels open one after the other, and as many close as the next one lies higher."""
    labelled = section_labels(sections, verses.groupBy("section_id").agg(F.count(F.lit(1)).alias("n")))
    after = F.lead("depth").over(Window.partitionBy("work_id").orderBy("low"))
    closing = F.repeat(F.lit("]}"), F.col("depth") - F.coalesce(after, F.lit(1)) + 1)
    opening = F.concat(F.regexp_replace(F.to_json(F.struct("id", "ref", "ordinal", "total")), r"\}$", ""), F.lit(',"children":['))
    text = F.when(after > F.col("depth"), opening).otherwise(F.concat(opening, closing, F.when(after.isNotNull(), ",").otherwise("")))
    items = labelled.select("work_id", "low", text.alias("text")).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("low", "text"))).alias("items"))
    return items.select("work_id", F.concat(F.lit("["), F.array_join(F.col("items.text"), ""), F.lit("]")).alias("contents"))


def section_verses(verses: DataFrame, contents: DataFrame, editions: DataFrame, segments: DataFrame) -> DataFrame:
    """section_id, verses: each verse with renderings in edition order and its audio."""
    r = contents.join(editions.select(F.col("id").alias("edition_id"), "sort_order", "kind", "language_code"), "edition_id")
    r = nested(r, ["verse_id"], ["sort_order", "edition_id"], ["edition_id", "kind", "language_code", "body"], "renderings")
    a = nested(segments, ["verse_id"], ["track_id", "start_ms"], ["track_id", "start_ms", "end_ms"], "audio")
    v = with_children(with_children(verses.withColumnRenamed("id", "verse_id"), r, ["verse_id"], "renderings"), a, ["verse_id"], "audio")
    return nested(v, ["section_id"], ["ordinal"], ["verse_id", "ref", "ordinal", "kind", "renderings", "audio"], "verses")


def entity_union(tables: dict[str, DataFrame], name: dict[str, str]) -> DataFrame:
    """kind, id, slug, name over all entity tables, for polymorphic look-ups by (kind, id)."""
    out = None
    for kind, df in tables.items():
        x = df.select(F.lit(kind).alias("kind"), "id", "slug", F.col(name[kind]).alias("name"))
        out = x if out is None else out.unionByName(x)
    return out


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge from both of its ends, with its direction."""
    rest = [c for c in edges.columns if c not in (a, b)]
    out = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), F.lit("in").alias("direction"), *rest))


def dangling(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Polymorphic references (kind, id) that point at nothing."""
    return refs.join(entities.select("kind", "id"), ["kind", "id"], "left_anti")


def entity_detail(entities: DataFrame, mentions: DataFrame, verses: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, id, slug, name, verses in reference order, relations in and out."""
    from textloom.functions.text import ref_parts

    v = mentions.join(verses.select(F.col("id").alias("verse_id"), "ref").withColumn("parts", ref_parts("ref")), "verse_id")
    v = nested(v, ["kind", "id"], ["parts"], ["ref", "role"], "verses")
    o = nested(relations.select(F.col("from_kind").alias("kind"), F.col("from_id").alias("id"), "relation", "to_kind", "to_id"), ["kind", "id"], ["relation", "to_kind", "to_id"], ["relation", "to_kind", "to_id"], "relations_out")
    i = nested(relations.select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id"), "relation", "from_kind", "from_id"), ["kind", "id"], ["relation", "from_kind", "from_id"], ["relation", "from_kind", "from_id"], "relations_in")
    out = entities
    for child, name in ((v, "verses"), (o, "relations_out"), (i, "relations_in")):
        out = with_children(out, child, ["kind", "id"], name)
    return out


def verse_detail(verses: DataFrame, contents: DataFrame, mentions: DataFrame, entities: DataFrame, xrefs: DataFrame) -> DataFrame:
    """Every verse with renderings, mentions by name, cross references both ways, and its neighbours."""
    from textloom.functions.text import ref_parts
    from textloom.operators.order import neighbours

    v = neighbours(verses.withColumn("parts", ref_parts("ref")), ["work_id"], [F.col("parts")], "ref").drop("parts").withColumnRenamed("id", "verse_id")
    m = nested(mentions.join(entities, ["kind", "id"]), ["verse_id"], ["kind", "name"], ["kind", "slug", "name", "role"], "mentions")
    refs = verses.select(F.col("id").alias("other"), F.col("ref").alias("other_ref"))
    x = undirected(xrefs.select("from_verse_id", "to_verse_id", F.col("kind").alias("xref_kind")), "from_verse_id", "to_verse_id").join(refs, "other")
    x = nested(x.withColumnRenamed("node", "verse_id"), ["verse_id"], ["direction", "other_ref"], ["direction", "other_ref", "xref_kind"], "xrefs")
    c = nested(contents, ["verse_id"], ["edition_id"], ["edition_id", "body"], "renderings")
    for child, name in ((c, "renderings"), (m, "mentions"), (x, "xrefs")):
        v = with_children(v, child, ["verse_id"], name)
    return v


def catalogue(works: DataFrame, sections: DataFrame, verses: DataFrame) -> DataFrame:
    """Published works with live counts of leaf sections and verses, in order."""
    s = leaf_sections(sections).groupBy("work_id").agg(F.count(F.lit(1)).alias("sections"))
    v = verses.groupBy("work_id").agg(F.count(F.lit(1)).alias("verses"))
    w = works.where("status = 'published'").withColumnRenamed("id", "work_id").join(s, "work_id", "left").join(v, "work_id", "left")
    return w.na.fill(0, ["sections", "verses"]).orderBy("sort_order", "slug")
