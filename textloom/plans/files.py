"""Queries through files: what the tables give is written, read by the readers, loaded or streamed, and returned.

Each one works in a folder of its own beside the checkpoints, which goes when the result is checkpointed.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import gates, order
from textloom.operators import library as L
from textloom.plans.base import query
from textloom.plans.reader import LIBRARY, TODAY, visible
from textloom.sources import corpus, pages, sinks, store
from textloom.sources.snapshots import Snapshots, load_tables
from textloom.streaming import events


def in_folder(f):
    """Give the query a folder, and delete it when its result is a checkpoint."""

    @functools.wraps(f)
    def run(t) -> DataFrame:
        spark = t("region").sparkSession
        folder = f"{store.shared_folder(spark)}/textloom-files-{uuid.uuid4().hex}"
        try:
            return f(t, folder).checkpoint()
        finally:
            store.delete(spark, folder)

    return run


# ---- corpus files and the load

_NUMBERED = "numbered AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _written(t, folder: str) -> dict[str, DataFrame]:
    """Regions as works, nations as chapters, customers as verses: one JSON file each, read back and loaded."""
    spark = t("region").sparkSession
    works = t("region").select(
        F.lower("r_name").alias("slug"), F.upper(F.left("r_name", F.lit(2))).alias("short_code"), F.col("r_name").alias("title_iast"), F.array(F.struct(F.lit("s").alias("slug"), F.lit("book").alias("kind"), F.lit("Source").alias("title"))).alias("sources"),
        F.array(F.struct(F.lit("a").alias("key"), F.lit("s").alias("source"), F.when(F.col("r_regionkey") == 2, "pending").otherwise("open_license").alias("status"))).alias("rights"),
        F.array(F.struct(F.concat(F.lower("r_name"), F.lit("-text")).alias("slug"), F.lit("original").alias("kind"), F.lit("a").alias("rights"), F.lit(1).alias("sort_order"))).alias("editions"), F.col("r_regionkey").alias("file"),
    )
    works.write.partitionBy("file").json(f"{folder}/works")
    people = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("p"), "k").alias("slug"), F.concat(F.lit("Person "), "k").alias("name_iast"))))
    spark.range(10).withColumnRenamed("id", "k").agg(people.alias("people")).write.json(f"{folder}/graphs")
    v = order.renumbered(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), ["n_nationkey"], [F.col("c_custkey")], "k")
    chapter = F.concat_ws(".", F.col("n_regionkey") + 1, "n_nationkey")
    ref = lambda k: F.concat_ws(".", F.col("n_regionkey") + 1, "n_nationkey", k)
    verse = F.struct(
        F.col("k").alias("ordinal"), ref(F.col("k")).alias("ref"), F.when(F.col("c_custkey") % 9 == 0, "odd").otherwise("prose").alias("kind"), F.col("c_name").alias("deva"), F.col("c_mktsegment").alias("iast"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("en"),
        F.array(F.struct(F.lit("person").alias("kind"), F.concat(F.lit("p"), F.col("c_custkey") % 10).alias("slug"))).alias("mentions"), F.array(F.struct(ref(F.col("k") + 1).alias("to"))).alias("xrefs"),
    )
    section = F.struct(F.struct((F.col("n_regionkey") + 1).cast("string").alias("ref"), (F.col("n_regionkey") + 1).alias("ordinal")).alias("canto"), F.struct(chapter.alias("ref"), F.col("n_nationkey").alias("ordinal")).alias("chapter"))
    v.groupBy("n_nationkey", "n_regionkey").agg(F.array_sort(F.collect_list(verse)).alias("verses")).select(section.alias("section"), "verses", F.col("n_nationkey").alias("file")).write.partitionBy("file").json(f"{folder}/chapters")
    read = [f(spark, f"{folder}/{name}", "*.json") for f, name in ((corpus.read_works, "works"), (corpus.read_graphs, "graphs"), (corpus.read_chapters, "chapters"))]
    names = F.create_map(*[F.lit(x) for i, n in enumerate(("africa", "america", "asia", "europe", "middle east"), 1) for x in (str(i), n)])
    return corpus.load_work(*read, names[F.col("section.canto.ref")])


@query(f"""WITH {_NUMBERED} SELECT lower(r_name) AS slug, (r + 1) || '.' || n || '.' || k AS ref, CAST(k AS INTEGER) AS ordinal, CASE WHEN c % 9 = 0 THEN 'verse' ELSE 'prose' END AS kind, (r + 1) || '.' || n AS section, 'p' || c % 10 AS mention FROM numbered JOIN region ON r_regionkey = r""")
@in_folder
def loaded_verses(t, folder):
    loaded, into = _written(t, folder), Snapshots(t("region").sparkSession, f"{folder}/store")
    keys = {"works": ["slug"], "sections": ["work_id", "ref"], "verses": ["work_id", "ref"], "mentions": ["verse_id", "kind", "slug"], "cross_references": ["from_verse_id", "to_verse_id"]}
    for _ in range(2):  # the second load changes nothing
        load_tables(into, loaded, keys, "load")
    w = into.read("works").select(F.col("id").alias("work_id"), "slug")
    s = into.read("sections").select(F.col("id").alias("section_id"), F.col("ref").alias("section"))
    m = into.read("mentions").select(F.col("verse_id").alias("id"), F.col("slug").alias("mention"))
    return into.read("verses").join(w, "work_id").join(s, "section_id").join(m, "id").select("slug", "ref", "ordinal", "kind", "section", "mention")


@query(f"""WITH {_NUMBERED} SELECT (r + 1) || '.' || n || '.' || k AS source, (r + 1) || '.' || n || '.' || (k + 1) AS target, k < max(k) OVER (PARTITION BY n) AS known FROM numbered""")
@in_folder
def loaded_references(t, folder):
    loaded = _written(t, folder)
    ref = loaded["verses"].select("id", "ref")
    done = loaded["cross_references"].join(ref.select(F.col("id").alias("from_verse_id"), F.col("ref").alias("source")), "from_verse_id").join(ref.select(F.col("id").alias("to_verse_id"), F.col("ref").alias("target")), "to_verse_id")
    waiting = loaded["pending"].select(F.col("from_verse_id").alias("id"), F.explode("pending").alias("target")).join(ref, "id")
    return done.select("source", "target", F.lit(True).alias("known")).unionByName(waiting.select(F.col("ref").alias("source"), "target", F.lit(False).alias("known")))


@query(f"""WITH {_NUMBERED}, x AS (SELECT lower(r_name) || '-text' AS edition, r, n, k, c FROM numbered JOIN region ON r_regionkey = r)
SELECT 'edition ' || edition AS name, CASE WHEN any_value(r) = 2 THEN 'draft' ELSE 'published' END AS value FROM x GROUP BY edition
UNION ALL SELECT 'contents ' || l, CAST(n AS VARCHAR) FROM (SELECT 'deva' AS l, count(*) AS n FROM x UNION ALL SELECT 'iast', count(*) FROM x UNION ALL SELECT 'en', count(*) FROM x WHERE c % 2 = 0)
UNION ALL SELECT 'violations', '0' UNION ALL SELECT 'sections', CAST(count(DISTINCT n) + count(DISTINCT r) AS VARCHAR) FROM x UNION ALL SELECT 'sources', '1'""")
@in_folder
def loaded_rows(t, folder):
    loaded = _written(t, folder)
    n = lambda table, name: loaded[table].agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("name"), "value")
    out = loaded["editions"].select(F.concat(F.lit("edition "), "slug").alias("name"), F.col("status").alias("value"))
    by_language = loaded["verse_contents"].groupBy("language").agg(F.count(F.lit(1)).cast("string").alias("value"))
    out = out.unionByName(by_language.select(F.concat(F.lit("contents "), "language").alias("name"), "value"))
    return out.unionByName(n("violations", "violations")).unionByName(n("sections", "sections")).unionByName(n("sources", "sources"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey % 50 AS chapter, CAST(l_orderkey * 1000 + k * 10 + i AS INTEGER) AS number, 'part ' || l_partkey AS text FROM x, (SELECT unnest(range(0, 4)) AS i) WHERE i <= l_partkey % 4""")
@in_folder
def numbered_markdown(t, folder):
    x = order.renumbered(t("lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], "k")
    start = F.col("l_orderkey") * 1000 + F.col("k") * 10
    number = F.when(F.col("l_partkey") % 4 == 0, start.cast("string")).otherwise(F.concat_ws("-", start, start + F.col("l_partkey") % 4))
    line = F.concat(number, F.lit(". part "), "l_partkey", F.lit("[^3]"))
    seen = Observation()
    lines = x.observe(seen, F.max(start + F.col("l_partkey") % 4).alias("last")).select((F.col("l_orderkey") % 50).alias("chapter"), line.alias("value"))
    lines.repartition("chapter").write.partitionBy("chapter").text(f"{folder}/notes")
    # an INTEGER as in the twin, which has no result where a number is above that; a long there
    number = F.col("number").cast("int") if (seen.get["last"] or 0) < 1 << 31 else F.col("number")
    return corpus.read_numbered_markdown(t("region").sparkSession, f"{folder}/notes", r"chapter=(\d+)/").select(F.col("chapter").cast("long").alias("chapter"), number.alias("number"), "text")


@query("""SELECT 'x ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'T' || page_id END AS resolved, CASE WHEN page_id % 3 = 0 THEN NULL ELSE md5(html) END AS wikitext, page_id % 3 = 0 AS missing FROM pages""")
@in_folder
def saved_pages(t, folder):
    name = lambda p: F.concat(F.lit(p), "page_id")
    move = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    slots = F.create_map(F.lit("main"), F.create_map(F.lit("content"), F.md5("html")))
    page = F.when(F.col("page_id") % 3 != 0, F.struct(name("T").alias("title"), F.col("page_id").alias("pageid"), F.array(F.struct(F.col("page_id").alias("revid"), slots.alias("slots"))).alias("revisions")))
    moves = F.array(move(name("X"), name("Y")), move(name("Y"), name("Z")), move(name("Z"), F.when(F.col("page_id") % 3 == 0, name("X")).otherwise(name("T"))))  # a chain, or a circle
    rows = t("pages").select(F.floor(F.col("page_id") / 50).alias("request"), move(name("x "), name("X")).alias("n"), moves.alias("m"), page.alias("p"))
    asked = F.struct(F.struct(F.collect_list("n").alias("normalized"), F.flatten(F.collect_list("m")).alias("redirects"), F.collect_list("p").alias("pages")).alias("query"))
    rows.groupBy("request").agg(F.to_json(asked).alias("value")).repartition("request").write.partitionBy("request").option("compression", "none").text(f"{folder}/answers")
    got = pages.read_saved_pages(t("region").sparkSession, f"{folder}/answers", "*.txt")
    kind = lambda k: got.where(F.col("kind") == k)
    wanted = t("pages").select(name("x ").alias("title"))
    found = corpus.resolve_titles(wanted, kind("normalized"), kind("redirect"), kind("page").select("title", "wikitext"))
    return found.select("title", F.when(~F.col("missing"), F.col("resolved")).alias("resolved"), "wikitext", "missing")


@query("""SELECT conv_id AS chapter, turn AS verse, md5(coalesce(min(text) FILTER (role = 'assistant'), min(text) FILTER (role = 'user'), min(text), '')) AS text, string_agg(DISTINCT role, ',' ORDER BY role) AS authors FROM conversations GROUP BY 1, 2""")
@in_folder
def translations_read(t, folder):
    row = F.struct(F.col("conv_id").alias("chapter"), F.col("turn").alias("verse"), F.col("role").alias("author"), "text")
    listed = t("conversations").groupBy(F.floor(F.col("conv_id") / 10).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))  # ten conversations a file
    listed.repartition("file").write.partitionBy("file").text(f"{folder}/translations")
    x = corpus.read_translations(t("region").sparkSession, f"{folder}/translations")
    authors = F.array_join(F.array_sort(F.map_keys("texts")), ",")
    return x.select(F.col("chapter").cast("long").alias("chapter"), "verse", F.md5(F.coalesce(T.first_present("texts", ["assistant", "user"]), F.lit(""))).alias("text"), authors.alias("authors"))


# ---- sinks


@query("SELECT doc_id, lang, n_chars FROM documents")
@in_folder
def resumed_load(t, folder):
    rows, path = t("documents").select("doc_id", "lang", "n_chars"), f"{folder}/table"
    sinks.resumable_load(rows, "doc_id", path, 100)
    store.delete(rows.sparkSession, f"{path}/batch=1")  # as if the job had ended before it
    sinks.resumable_load(rows, "doc_id", path, 100)
    return rows.sparkSession.read.parquet(path).select("doc_id", "lang", "n_chars")


@query("SELECT n_regionkey AS book, n_nationkey AS chapter, count(*) AS verses, CAST(sum(count(*)) OVER (PARTITION BY n_regionkey) AS BIGINT) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
@in_folder
def chapter_manifest(t, folder):
    v = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("book"), F.col("n_nationkey").alias("chapter"))
    sinks.write_manifest(v, f"{folder}/manifest")
    x = t("region").sparkSession.read.schema("book int, chapters array<struct<chapter: int, verses: long>>, total long").json(f"{folder}/manifest")
    return x.select("book", F.explode("chapters").alias("c"), "total").select("book", "c.chapter", "c.verses", "total")


@query("SELECT n_regionkey AS book, n_nationkey AS chapter, c_custkey AS ordinal, c_name AS deva FROM customer JOIN nation ON n_nationkey = c_nationkey")
@in_folder
def chapter_files(t, folder):
    v = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("book"), F.col("n_nationkey").alias("chapter"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("deva"))
    sinks.write_chapters(v, f"{folder}/chapters")
    x = t("region").sparkSession.read.schema("verses array<struct<ordinal: int, deva: string>>, book int, chapter int").json(f"{folder}/chapters")
    return x.select("book", "chapter", F.explode("verses").alias("v")).select("book", "chapter", "v.ordinal", "v.deva")


@query(f"""WITH {LIBRARY} SELECT slug, 'meta' AS part, 1 AS n FROM works UNION ALL SELECT slug, 'edition', count(*) FROM works w JOIN editions e ON e.work_id = w.id GROUP BY 1 UNION ALL SELECT '__HIVE_DEFAULT_PARTITION__', 'person', count(*) FROM people""")
@in_folder
def exported_bundles(t, folder):
    seen = visible(t, gates.SecurityContext(role="anon", today=TODAY))
    parts = L.work_bundle(seen).where("part IN ('meta', 'edition', 'person')")
    public = seen.ctx.public_editions(seen.stored.editions, seen.stored.works, seen.stored.rights).select(F.col("edition_id").alias("id"))
    sinks.export_bundles(parts, seen.editions.join(public, "id", "left_anti"), f"{folder}/bundles")
    x = t("region").sparkSession.read.schema("part string, key string, value string, slug string").json(f"{folder}/bundles")
    return x.groupBy(F.coalesce("slug", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("slug"), "part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'section:' || lower(r_name) || ':' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey NOT IN (1)
UNION ALL SELECT 'toc:' || lower(r_name), 'old' FROM region WHERE r_regionkey <> 1""")
@in_folder
def key_value_store(t, folder):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(":", F.lit("section"), F.lower("r_name"), "n_nationkey").alias("key"), "n_nationkey", "n_regionkey")
    kv = n.select("key", F.lit("old").alias("value")).unionByName(t("region").select(F.concat(F.lit("toc:"), F.lower("r_name")).alias("key"), F.lit("old").alias("value")))
    kv = sinks.kv_put(kv, n.where("n_nationkey % 2 = 0").select("key", F.lit("new").alias("value")))
    chapters = sinks.kv_get(kv, prefix="section:america:").select("key")
    return sinks.remove_download(kv, "america", chapters)


@query("SELECT doc_id AS id, [length(doc_id || ' ' || coalesce(text, ''))::FLOAT, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::FLOAT][1] AS a, 'own' AS model FROM documents WHERE doc_id % 3 <> 0")
@in_folder
def embedded_contents(t, folder):
    model = lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts]
    done = t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("verse_content_id"), F.lit("own").alias("model"))
    rows = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("ref"), F.coalesce("text", F.lit("")).alias("body"))
    made = sinks.embed(sinks.missing_embeddings(rows, done, "own"), model, "own")
    made.write.parquet(f"{folder}/embeddings")
    x = t("region").sparkSession.read.parquet(f"{folder}/embeddings")
    return x.select(F.col("verse_content_id").cast("long").alias("id"), F.col("embedding")[0].cast("float").alias("a"), "model")


# ---- streams


@query("SELECT event_id AS id, event_type AS event FROM events WHERE event_id % 10 <> 0")
@in_folder
def streamed_events(t, folder):
    name = F.when(F.col("event_id") % 10 == 0, F.lit("Not A Name")).otherwise(F.col("event_type"))
    rows = t("events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), name.alias("event"), F.col("ts").alias("created_at"))
    rows.unionByName(rows.where("id % 7 = 0")).coalesce(4).write.json(f"{folder}/in")  # some come twice
    events.append(events.read_events(rows.sparkSession, f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/out").select(F.col("id").cast("long").alias("id"), "event")


@query("""WITH s AS (SELECT user_id, event_id AS segment, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_type = 'view')
SELECT event_id AS at_ms, coalesce('v' || segment, '-') AS verse_id FROM events p LEFT JOIN s ON s.user_id = p.user_id AND event_id >= a AND event_id < b WHERE event_type = 'click'""")
@in_folder
def streamed_positions(t, folder):
    from pyspark.sql import Window

    e = t("events").withColumn("track_id", F.col("user_id").cast("string"))
    s = e.where("event_type = 'view'").select("track_id", F.col("event_id").alias("start_ms"), F.lead("event_id").over(Window.partitionBy("track_id").orderBy("event_id")).alias("end_ms"), F.concat(F.lit("v"), "event_id").alias("verse_id")).where("end_ms IS NOT NULL")
    e.where("event_type = 'click'").select("track_id", F.col("event_id").alias("at_ms")).coalesce(4).write.json(f"{folder}/in")
    points = e.sparkSession.readStream.schema("track_id string, at_ms long").json(f"{folder}/in")
    events.segments_at(points, s, f"{folder}/out", f"{folder}/state", 256).awaitTermination()
    return e.sparkSession.read.parquet(f"{folder}/out").select("at_ms", F.coalesce("verse_id", F.lit("-")).alias("verse_id"))
