"""Queries of operators that a reader's client, its sync and its editors use one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.functions import text as T
from textloom.operators import audit, documents, gates, library, merge, order, progress, search
from textloom.plans.base import NOW, query, sql_fold
from textloom.plans.reader import LIBRARY, visible

# ---- documents


@query(f"""WITH {LIBRARY}, x AS (SELECT *, lag(ref) OVER w AS prev_ref, lead(ref) OVER w AS next_ref FROM verses WINDOW w AS (PARTITION BY work_id ORDER BY n_nationkey, id)),
m AS (SELECT verse_id, count(*) AS n FROM mentions m WHERE (kind = 'person' AND id IN (SELECT id FROM people)) OR (kind = 'topic' AND id IN (SELECT id FROM topics)) GROUP BY 1),
d AS (SELECT from_verse_id AS v, to_verse_id AS o, 'out' AS direction FROM xrefs UNION ALL SELECT to_verse_id, from_verse_id, 'in' FROM xrefs),
r AS (SELECT v, string_agg(direction || ' ' || ref, ',' ORDER BY direction, ref) AS refs FROM d JOIN verses o ON o.id = d.o GROUP BY 1),
c AS (SELECT verse_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY edition_id, id) AS bodies FROM contents GROUP BY 1)
SELECT x.id AS verse_id, coalesce(prev_ref, '-') AS prev_ref, coalesce(next_ref, '-') AS next_ref, coalesce(m.n, 0) AS mentions, coalesce(refs, '') AS refs, coalesce(bodies, '') AS bodies FROM x LEFT JOIN m ON m.verse_id = x.id LEFT JOIN r ON r.v = x.id LEFT JOIN c ON c.verse_id = x.id""")
def verse_details(t):
    lib = visible(t)
    x = documents.verse_detail(lib.verses, lib.contents.withColumn("edition_id", F.struct("edition_id", "id")), lib.mentions, lib.entities.drop("status", "work_id"), lib.xrefs)
    refs = F.array_join(F.array_sort(F.transform("xrefs", lambda r: F.concat_ws(" ", r["direction"], r["other_ref"]))), ",")
    bodies = F.array_join(F.transform("renderings", lambda r: r["edition_id"]["id"].cast("string")), ",")
    return x.select("verse_id", F.coalesce("prev_ref", F.lit("-")).alias("prev_ref"), F.coalesce("next_ref", F.lit("-")).alias("next_ref"), F.size("mentions").cast("long").alias("mentions"), refs.alias("refs"), bodies.alias("bodies"))


_RELATIONS = "SELECT DISTINCT 'person' AS from_kind, o_custkey % 10 AS from_id, 'knows' AS relation, 'topic' AS to_kind, o_orderkey % 200 AS to_id FROM orders"


@query(f"""WITH {LIBRARY}, e AS (SELECT 'person' AS kind, id, name FROM people UNION ALL SELECT 'topic', id, name FROM topics UNION ALL SELECT 'story', n_nationkey, n_name FROM nation WHERE n_nationkey % 6 <> 5), r AS ({_RELATIONS}),
v AS (SELECT m.kind, m.id, string_agg(ref, ',' ORDER BY v.work_id, v.n_nationkey, v.id) AS verses FROM mentions m JOIN verses v ON v.id = m.verse_id GROUP BY 1, 2),
o AS (SELECT from_kind AS kind, from_id AS id, count(*) AS n FROM r GROUP BY 1, 2), i AS (SELECT to_kind AS kind, to_id AS id, count(*) AS n FROM r GROUP BY 1, 2)
SELECT kind, id, name, coalesce(verses, '') AS verses, coalesce(o.n, 0) AS relations_out, coalesce(i.n, 0) AS relations_in FROM e LEFT JOIN v USING (kind, id) LEFT JOIN o USING (kind, id) LEFT JOIN i USING (kind, id)""")
def entity_pages(t):
    lib = visible(t)
    relations = t("orders").select(F.lit("person").alias("from_kind"), (F.col("o_custkey") % 10).alias("from_id"), F.lit("knows").alias("relation"), F.lit("topic").alias("to_kind"), (F.col("o_orderkey") % 200).alias("to_id")).distinct()
    x = documents.entity_detail(lib.entities, lib.mentions, lib.verses, relations)
    n = lambda c: F.size(c).cast("long").alias(c)
    return x.select("kind", "id", "name", F.array_join(F.transform("verses", lambda v: v["ref"]), ",").alias("verses"), n("relations_out"), n("relations_in"))


@query("SELECT l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_partkey % 7 = 0 OR l_suppkey % 5 = 0")
def dangling_references(t):
    known = t("part").where("p_partkey % 7 <> 0").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")).unionByName(t("supplier").where("s_suppkey % 5 <> 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))
    pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    refs = pairs.select("*", F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("id")))).alias("r")).select("l_partkey", "l_suppkey", "r.*")
    return documents.dangling(refs, known).select("l_partkey", "l_suppkey").distinct()


# ---- activity


@query("""WITH v AS (SELECT c_custkey AS id, c_nationkey AS work, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
u AS (SELECT user_id, v.work, v.id, round(100.0::DOUBLE * pos / n, 2) AS percent, event_id FROM events JOIN v ON v.id = event_id % 150 WHERE event_id % 9 <> 0)
SELECT user_id, work, arg_max(id, event_id) AS verse_id, arg_max(percent, event_id) AS percent, max(event_id) AS last_read_at FROM u GROUP BY 1, 2""")
def progress_upserts(t):
    verses = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("work_id"), F.col("c_custkey").cast("string").alias("ref"))
    e = t("events").withColumn("verse_id", F.col("event_id") % 150).join(verses.select(F.col("id").alias("verse_id"), "work_id"), "verse_id")
    updates = e.select(F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("user_id"), "work_id", "verse_id", F.col("event_id").alias("at"))
    old = updates.limit(0).select("user_id", "work_id", "verse_id", F.lit(0.0).alias("percent"), F.col("at").alias("last_read_at"))
    reads = updates.limit(0).select("user_id", "verse_id", F.col("at").alias("read_at"))
    done, _, _ = progress.upsert_progress(old, reads, verses, updates)
    return done.select("user_id", F.col("work_id").alias("work"), "verse_id", "percent", "last_read_at")


@query("SELECT user_id, event_id % 150 AS verse_id, min(event_id) AS read_at FROM events WHERE event_id % 9 <> 0 AND event_id % 150 IN (SELECT c_custkey FROM customer) GROUP BY 1, 2")
def first_reads(t):
    verses = t("customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("work_id"), F.col("c_custkey").cast("string").alias("ref"))
    updates = t("events").select(F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("user_id"), F.lit(1).alias("work_id"), (F.col("event_id") % 150).alias("verse_id"), F.col("event_id").alias("at"))
    old = updates.limit(0).select("user_id", "work_id", "verse_id", F.lit(0.0).alias("percent"), F.col("at").alias("last_read_at"))
    return progress.upsert_progress(old, updates.limit(0).select("user_id", "verse_id", F.col("at").alias("read_at")), verses, updates)[1]


@query("""WITH l AS (SELECT o_orderkey AS k, day(o_orderdate) AS d, 'l' || o_orderkey AS v, o_orderkey % 3 = 0 AS dirty, o_orderkey % 4 = 0 AS deleted FROM orders), s AS (SELECT k, d + (k % 5) - 2 AS d, 's' || k AS v FROM l WHERE k % 2 = 0),
p AS (SELECT * FROM l WHERE NOT (deleted AND NOT dirty))
SELECT coalesce(p.k, s.k) AS k, CASE WHEN p.k IS NULL OR s.d > p.d THEN s.v ELSE p.v END AS v, CASE WHEN p.k IS NULL OR s.d > p.d THEN 'server' ELSE 'local' END AS origin FROM p FULL JOIN s ON s.k = p.k""")
def synced_rows(t):
    local = t("orders").select(F.col("o_orderkey").alias("k"), F.dayofmonth("o_orderdate").alias("at"), F.concat(F.lit("l"), "o_orderkey").alias("v"), (F.col("o_orderkey") % 3 == 0).alias("dirty"), (F.col("o_orderkey") % 4 == 0).alias("deleted"))
    server = local.where("k % 2 = 0").select("k", (F.col("at") + F.col("k") % 5 - 2).cast("int").alias("at"), F.concat(F.lit("s"), "k").alias("v"))
    return progress.sync(local, server, ["k"], "at", ["v"])[1].select("k", "v", "origin")


@query("SELECT n_regionkey AS work_id, CASE WHEN n_regionkey % 2 = 0 THEN max(n_nationkey) ELSE min(n_nationkey) END AS section_id FROM nation GROUP BY 1")
def resume_targets(t):
    chapters = t("nation").select(F.col("n_regionkey").alias("work_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_nationkey").alias("id"))
    at = chapters.where("work_id % 2 = 0").groupBy("work_id").agg(F.max("id").alias("section_id"))
    return progress.resume_target(chapters.select("work_id").distinct(), at, chapters)


@query("""WITH x AS (SELECT *, sum(size) OVER (PARTITION BY w ORDER BY n) AS last, sum(size) OVER (PARTITION BY w) AS total FROM (SELECT n_regionkey AS w, n_nationkey AS n, n_nationkey % 4 + 1 AS size FROM nation)), p AS (SELECT *, (dayofyear(DATE '2024-05-17') - 1) % total AS pick FROM x)
SELECT w AS work_id, n AS section_id, CAST(pick - (last - size) AS BIGINT) AS "offset" FROM p WHERE pick >= last - size AND pick < last""")
def daily_picks(t):
    chapters = t("nation").select(F.col("n_regionkey").alias("work_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_nationkey").alias("section_id"), (F.col("n_nationkey") % 4 + 1).alias("size"))
    return progress.daily_pick(chapters, ["work_id"], F.lit("2024-05-17").cast("date"))


@query("""WITH u AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS used FROM conversations GROUP BY 1) SELECT conv_id, conv_id % 2 = 1 AND conv_id % 5 > 0 AND used >= conv_id % 5 AS refused FROM u""")
def caps_reached(t):
    u = t("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("used"))
    return u.select("conv_id", search.cap_reached(F.col("conv_id") % 2 == 1, F.col("conv_id") % 5, F.col("used")).alias("refused"))


@query("""SELECT event_id, CASE WHEN s IS NULL THEN 0.75::DOUBLE ELSE s END AS speed FROM (SELECT event_id, CASE WHEN v < 0.75 THEN 0.75 WHEN v < 1.0 THEN 1.0 WHEN v < 1.25 THEN 1.25 WHEN v < 1.5 THEN 1.5 END::DOUBLE AS s FROM (SELECT event_id, (event_id % 8) * 0.25::DOUBLE AS v FROM events))""")
def next_speeds(t):
    return t("events").select("event_id", S.next_speed((F.col("event_id") % 8) * F.lit(0.25), [0.75, 1.0, 1.25, 1.5]).alias("speed"))


@query("SELECT min(event_id) AS seek_ms FROM events WHERE event_type = 'view' AND user_id = 8 AND event_id + 5 <= 600 HAVING count(*) > 0")
def loop_seek(t):
    s = t("events").where("event_type = 'view'").select(F.col("user_id").cast("string").alias("verse_id"), F.lit("t").alias("track_id"), F.col("event_id").alias("start_ms"), (F.col("event_id") + 5).alias("end_ms"))
    return progress.loop_target(s, "8", "t", 600)


# ---- search on the device


@query(f"""WITH x AS (SELECT d.doc_id, text, {sql_fold("coalesce(text, '')")} AS f, coalesce(l.toxic, 0) = 1 AS linked FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT doc_id, CASE WHEN CAST(doc_id AS VARCHAR) = 'ring' THEN 1.0 WHEN contains(text, 'ring') OR contains(f, 'rng') THEN 0.9 WHEN linked THEN 0.5 END AS rank FROM x)
SELECT doc_id AS position, CAST(rank AS DOUBLE) AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank DESC, doc_id LIMIT 100""")
def offline_hits(t):
    verses = t("documents").select(F.col("doc_id").cast("string").alias("ref"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").alias("position"))
    mentions = t("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("ref"), F.lit("topic").alias("kind"), F.lit("r").alias("id"))
    names = t("region").where("r_regionkey = 0").select(F.lit("topic").alias("kind"), F.lit("r").alias("id"), F.lit("The Ring").alias("name"))
    return search.offline_search(verses, mentions, names, " ring ", 100).select("position", F.col("rank").cast("double").alias("rank"))


@query(f"""WITH {LIBRARY}, n AS (SELECT 'person' AS kind, id, slug, name, [name, more] AS names FROM people UNION ALL SELECT 'topic', id, slug, name, [name] FROM topics UNION ALL SELECT 'story', n_nationkey, 's' || n_nationkey, n_name, [n_name] FROM nation WHERE n_nationkey % 6 <> 5),
l AS (SELECT c_custkey AS id, 'Spring ' || c_mktsegment AS name FROM customer WHERE c_custkey < 10)
SELECT kind, id, slug, name, name AS matched, 'sa' AS language_code FROM n WHERE len(list_filter(names, lambda x: contains({sql_fold("x")}, 'rng'))) > 0 UNION SELECT 'person', l.id, people.slug, people.name, l.name, 'de' FROM l LEFT JOIN people ON people.id = l.id WHERE contains({sql_fold("l.name")}, 'rng') OR contains(l.name, 'ring')
ORDER BY kind, slug NULLS FIRST, id, matched, language_code LIMIT 100""")
def entity_names_found(t):
    return library.search_entities(visible(t), " ring ", 100)


@query("""SELECT event_id, '{' || CASE WHEN event_id % 2 = 0 THEN '"a":{"n":[' || event_id || ',null]},' ELSE '' END || '"k":' || CASE WHEN event_id % 3 = 0 THEN '"new"' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END || ',"z":true}' AS merged FROM events""")
def json_merge_typed(t):
    new = F.concat(F.lit('{"z":true'), F.when(F.col("event_id") % 3 == 0, ',"k":"new"').otherwise(""), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"a":{"n":['), "event_id", F.lit(",null]}"))).otherwise(""), F.lit("}"))
    return t("events").select("event_id", merge.merge_json(F.col("props"), new).alias("merged"))


# ---- editors


@query("""SELECT 'reader' AS role, doc_id FROM documents UNION ALL SELECT 'contributor', doc_id FROM documents WHERE doc_id % 4 > 1 UNION ALL SELECT 'editor', doc_id FROM documents WHERE false""")
def refused_writes(t):
    status = F.element_at(F.array(*map(F.lit, ("draft", "in_review", "published", "archived"))), (F.col("doc_id") % 4 + 1).cast("int"))
    changes = t("documents").select("doc_id", status.alias("status"))
    one = lambda role: gates.SecurityContext("u", role).rejected_writes(changes).select(F.lit(role).alias("role"), "doc_id")
    return one("reader").unionByName(one("contributor")).unionByName(one("editor"))


@query("""SELECT 'admin' AS role, count(*) AS events, 1 AS documents FROM events UNION ALL SELECT 'editor', 0, 1 UNION ALL SELECT 'reader', 0, 0 UNION ALL SELECT 'contributor', 0, 0""")
def role_views(t):
    out, rights = None, t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("permission_document_url"))
    for role in ("admin", "editor", "reader", "contributor"):
        ctx = gates.SecurityContext("u", role)
        shown = int("permission_document_url" in ctx.columns(rights).columns)
        x = ctx.events(t("events")).agg(F.count(F.lit(1)).alias("events")).select(F.lit(role).alias("role"), "events", F.lit(shown).alias("documents"))
        out = x if out is None else out.unionByName(x)
    return out


@query("""WITH v AS (SELECT n_regionkey AS b, n_nationkey AS ch, c_custkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 5 <> 3),
r AS (SELECT *, b || '.' || ch || '.' || CASE WHEN k % 10 = 0 THEN o - 1 ELSE o END || CASE WHEN k % 17 = 0 THEN 'b' ELSE '' END AS ref FROM v)
SELECT count(*) AS verses, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT ch FROM v)) AS missing_chapters, (SELECT count(*) FROM (SELECT ref, row_number() OVER (PARTITION BY ref) AS n FROM r) WHERE n > 1) AS duplicate_refs,
count(*) FILTER (k % 11 = 0) AS empty, 0::BIGINT AS malformed, count(*) FILTER (k % 17 = 0) AS suffixed, 0::BIGINT AS sparse_ordinals, count(*) FILTER (k % 13 = 0 AND k % 11 <> 0) AS leftover_markup FROM r""")
def audit_summary(t):
    x = t("customer").join(t("nation").where("n_nationkey % 5 <> 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = order.renumbered(x, ["n_nationkey"], [F.col("c_custkey")], "o")
    k = F.col("c_custkey")
    ref = F.concat(F.concat_ws(".", "n_regionkey", "n_nationkey", F.when(k % 10 == 0, F.col("o") - 1).otherwise(F.col("o"))), F.when(k % 17 == 0, "b").otherwise(""))
    deva = F.when(k % 11 == 0, " ").when(k % 13 == 0, F.concat(F.lit("{{"), "c_name")).otherwise(F.col("c_name"))
    verses = x.select(F.col("n_regionkey").alias("book"), F.col("n_nationkey").alias("chapter"), ref.alias("ref"), F.col("o").alias("ordinal"), F.col("o").alias("printed"), deva.alias("deva"))
    expected = t("nation").select(F.col("n_regionkey").alias("book"), F.col("n_nationkey").alias("chapter"))
    return audit.audit(verses, expected)["summary"].select("verses", "missing_chapters", "duplicate_refs", "empty", "malformed", "suffixed", "sparse_ordinals", "leftover_markup")


@query("""WITH b AS (SELECT n_nationkey AS book, n_nationkey % 7 AS n, coalesce(sum(n_nationkey % 7) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nation)
SELECT book, CAST(c AS INTEGER) AS chapter, CAST((before + c - 1) // 10 AS INTEGER) AS batch FROM b, (SELECT unnest(range(1, 7)) AS c) WHERE c <= n""")
def planned_requests(t):
    return audit.planned(t("nation").select(F.col("n_nationkey").alias("book"), (F.col("n_nationkey") % 7).cast("int").alias("n")))


# ---- texts


@query("""SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_linenumber * 7 % 12 END, CASE WHEN l_suppkey % 5 <> 0 AND l_suppkey % 2 = 0 THEN 'b' ELSE '' END, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS place FROM lineitem""")
def printed_order(t):
    printed = F.when(F.col("l_suppkey") % 5 == 0, F.lit("?")).otherwise(F.concat((F.col("l_linenumber") * 7 % 12).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "b").otherwise("")))
    x = t("lineitem").withColumn("printed", printed)
    key = order.printed_key(F.col("printed"))
    return order.renumbered(x, ["l_orderkey"], [key["unread"], key["number"], key["letter"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], "place").select("l_orderkey", "l_partkey", "l_suppkey", "place")


@query("SELECT n_regionkey, array_to_string(list_sort(list_distinct(flatten(list(string_split(n_name, ' '))))), ',') AS words FROM nation GROUP BY 1")
def united_lists(t):
    x = order.union_of_lists(t("nation").withColumn("w", F.split("n_name", " ")), ["n_regionkey"], "w", "words")
    return x.select("n_regionkey", F.array_join("words", ",").alias("words"))


@query(r"""SELECT conv_id, turn, translate(CAST(conv_id AS VARCHAR), '0123456789', '०१२३४५६७८९') AS deva, CAST(conv_id AS VARCHAR) AS latin,
CASE WHEN contains(left(text, 120), 'the') THEN 'a' WHEN contains(left(text, 120), 'on') THEN 'b' ELSE '-' END AS speaker, CASE WHEN turn % 3 = 0 THEN 'third' WHEN turn % 3 = 1 THEN 'first' ELSE 'any' END AS author,
CASE WHEN turn % 2 = 0 THEN 'even' ELSE role END AS local, CASE WHEN turn % 2 = 0 THEN 'count,name' ELSE 'name' END AS holes, least(greatest(turn - 2, 1), 4) AS clamped FROM conversations""")
def text_helpers(t):
    m = lambda *kv: F.map_from_entries(F.array_compact(F.array(*kv)))
    e = lambda k, v, when: F.when(when, F.struct(F.lit(k).alias("k"), v.alias("v")))
    turn, yes = F.col("turn"), F.lit(True)
    authors = m(e("x", F.lit("first"), turn % 3 == 1), e("y", F.lit("third"), turn % 3 == 0), e("z", F.lit("any"), turn % 3 == 2))
    local = m(e("de", F.lit("even"), turn % 2 == 0), e("en", F.col("role"), yes))
    holes = F.concat(F.lit("Hello {name}, "), F.when(turn % 2 == 0, "{count, plural} {name}").otherwise("{name}"))
    return t("conversations").select(
        "conv_id", "turn", T.deva_digits("conv_id").alias("deva"), T.latin_digits(T.deva_digits("conv_id")).alias("latin"), F.coalesce(T.speaker_of("text", [("the", "a"), ("on", "b")]), F.lit("-")).alias("speaker"),
        T.first_present(authors, ["x", "y"]).alias("author"), T.localized(local, "de").alias("local"), F.array_join(T.placeholders(holes), ",").alias("holes"), S.clamp(turn - 2, 1, 4).alias("clamped"),
    )


@query(f"SELECT c_custkey, '{{\"c_acctbal\":null,\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}}' AS image, '{NOW}' AS updated_at FROM customer WHERE c_custkey % 2 = 0")
def touched_rows(t):
    x = t("customer").where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(None).cast("double"))
    x = merge.touch(x.select("c_custkey", documents.as_json("c_acctbal", "c_custkey", "c_name").alias("image")), F.lit(NOW).cast("timestamp"))
    return x.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
