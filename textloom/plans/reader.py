"""The composed queries over a library that is made of the driver's tables.

Regions are works, nations their sections (and stories), customers verses, five editions a work, documents their contents,
suppliers people, parts topics, events mentions; some of each are drafts. The twins state the same mapping, the policy of
each table (an anonymous reader's), and the rule of each query in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import documents as D
from textloom.operators import gates, merge, order
from textloom.operators import library as L
from textloom.operators.index import index_of
from textloom.operators.vectors import nearest, vectors_of
from textloom.plans.base import query, sql_fold
from textloom.sources import sql, tables

TODAY = "2024-01-15"
#: Kind, language, script, rights and their last day, of each work's editions.
EDITIONS = [
    (0, "base_text", "sa", "Deva", "open_license", None), (1, "transliteration", "sa", "Latn", "public_domain", TODAY), (2, "translation", "en", "Latn", "permission_granted", "2024-06-30"),
    (3, "translation", "de", "Latn", "pending", None), (4, "transliteration", "sa", "Latn", "public_domain", "2023-12-31"),
]
N = len(EDITIONS)
#: An edition that is a draft although its rights are cleared: the translation of the second work.
DRAFT = N + 2
LANGUAGES = [("sa", "Sanskrit"), ("en", "English"), ("de", "German")]
SCRIPTS = [("Deva", "Devanagari"), ("Latn", "Latin")]
CONTEXT = gates.SecurityContext(today=TODAY)


def _draft(hidden: Column) -> Column:
    return F.when(hidden, "draft").otherwise("published").alias("status")


def library(t, indexed: bool = False) -> L.Library:
    spark = t("region").sparkSession
    works = t("region").select(F.col("r_regionkey").alias("id"), F.lower("r_name").alias("slug"), F.when(F.col("r_regionkey") == 4, "draft").otherwise("published").alias("status"), F.col("r_regionkey").alias("sort_order"))
    tops = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_regionkey").alias("work_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("string").alias("ref"), F.col("r_regionkey").alias("ordinal"), F.lit("published").alias("status"))
    leaves = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_regionkey").alias("work_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("ref"), F.col("n_nationkey").alias("ordinal"), _draft(F.col("n_nationkey") == 7))
    verses = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("work_id"), F.concat(F.lit("n"), "n_nationkey").alias("section_id"), F.concat_ws(".", "n_regionkey", "n_nationkey", "c_custkey").alias("ref"),
        F.col("c_custkey").alias("ordinal"), F.lit("verse").alias("kind"), (F.col("c_custkey") % 10).alias("speaker_id"), _draft(F.col("c_custkey") % 17 == 0),
    )
    kinds = spark.createDataFrame([e[:4] for e in EDITIONS], "k int, kind string, language_code string, script_code string")
    editions = works.select(F.col("id").alias("work_id"), "slug", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("k")).join(kinds, "k")
    editions = editions.select(
        (F.col("work_id") * N + F.col("k")).alias("id"), "work_id", "kind", "language_code", "script_code", F.concat_ws("-", "slug", "k").alias("title"), _draft(F.col("work_id") * N + F.col("k") == DRAFT),
        F.col("k").alias("sort_order"), F.col("k").alias("rights_id"), F.when(F.col("k") % 2 == 0, F.col("work_id") * N + F.col("k")).alias("source_id"),
    )
    d = t("documents").withColumn("verse_id", F.col("doc_id") % 150)
    contents = d.join(verses.select(F.col("id").alias("verse_id"), "work_id"), "verse_id").select(
        F.col("doc_id").alias("id"), "verse_id", (F.col("work_id") * N + F.col("doc_id") % N).alias("edition_id"), F.col("text").alias("body"), _draft(F.col("doc_id") % 13 == 0)
    )
    rights = spark.createDataFrame([(e[0], e[4], e[5]) for e in EDITIONS], "id int, status string, permission_expires_on string")
    rights = rights.select("id", "status", F.col("permission_expires_on").cast("date").alias("permission_expires_on"), F.lit("CC").alias("license"), F.concat(F.lit("by "), "id").alias("attribution_text"), F.when(F.col("id") != 3, F.col("id")).alias("source_id"))
    none = F.lit(None).cast("array<string>")
    people = t("supplier").select(F.lit("person").alias("kind"), F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.array(F.replace("s_name", F.lit("Supplier"), F.lit("Sage"))).alias("more"), _draft(F.col("s_suppkey") % 10 == 3), F.lit(None).cast("int").alias("work_id"))
    topics = t("part").select(F.lit("topic").alias("kind"), F.col("p_partkey").alias("id"), F.concat(F.lit("t"), "p_partkey").alias("slug"), F.col("p_name").alias("name"), none.alias("more"), _draft(F.col("p_partkey") % 19 == 0), F.lit(None).cast("int").alias("work_id"))
    stories = t("nation").select(F.lit("story").alias("kind"), F.col("n_nationkey").alias("id"), F.concat(F.lit("s"), "n_nationkey").alias("slug"), F.col("n_name").alias("name"), none.alias("more"), _draft(F.col("n_nationkey") % 6 == 5), F.col("n_regionkey").alias("work_id"))
    names = t("customer").where("c_custkey < 10").select(F.lit("person").alias("kind"), F.col("c_custkey").alias("id"), F.concat(F.lit("Spring "), "c_mktsegment").alias("name"), F.lit("de").alias("language_code"))
    person = F.col("event_id") % 3 == 0
    mentions = t("events").select(F.col("user_id").alias("verse_id"), F.when(person, "person").otherwise("topic").alias("kind"), F.when(person, F.col("event_id") % 10).otherwise(F.col("event_id") % 200).alias("id")).distinct().withColumn("role", F.lit("subject")).withColumn("status", _draft((F.col("verse_id") + F.col("id")) % 11 == 0))
    xrefs = t("orders").where("o_orderkey % 50 = 0").select((F.col("o_custkey") % 150).alias("from_verse_id"), (F.col("o_orderkey") % 149).alias("to_verse_id"), F.lit("see_also").alias("kind"), _draft(F.col("o_orderkey") % 700 == 0))
    nation = F.col("ordinal")
    tracks = leaves.select(F.concat(F.lit("t"), "id").alias("id"), F.col("id").alias("section_id"), (F.col("work_id") * N + nation % N).alias("edition_id"), _draft(nation == 9))
    segments = t("events").where("event_type = 'view'").select(F.col("user_id").alias("verse_id"), F.concat(F.lit("tn"), F.col("event_id") % 25).alias("track_id"), (F.col("event_id") * 10).alias("start_ms"), (F.col("event_id") * 10 + 5).alias("end_ms"))
    return L.Library(
        works, tops.unionByName(leaves), verses, editions, contents, rights, spark.createDataFrame(LANGUAGES, "code string, name string"), spark.createDataFrame(SCRIPTS, "code string, name string"),
        t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("https://example.org").alias("url")), people.unionByName(topics).unionByName(stories), names, mentions, xrefs, tracks, segments,
        t("embeddings").select(F.col("vec_id").alias("content_id"), "embedding"), index_of(t("documents"), "doc_id", "text") if indexed else None,
    )


def visible(t, ctx: gates.SecurityContext = CONTEXT, indexed: bool = False) -> L.Visible:
    return library(t, indexed).visible_to(ctx)


def _values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return "VALUES " + ", ".join(f"({', '.join(map(one, r))})" for r in rows)


CLEARED = "rights_status IN ('public_domain', 'open_license', 'permission_granted', 'original')"
#: The tables whole (all_...), and as an anonymous reader may see them.
LIBRARY = f"""all_works AS (SELECT r_regionkey AS id, lower(r_name) AS slug, CASE WHEN r_regionkey = 4 THEN 'draft' ELSE 'published' END AS status FROM region),
works AS (SELECT * FROM all_works WHERE status = 'published'),
all_verses AS (SELECT c_custkey AS id, n_regionkey AS work_id, n_nationkey, 'n' || n_nationkey AS section_id, n_regionkey || '.' || n_nationkey || '.' || c_custkey AS ref, c_custkey % 10 AS speaker_id, c_custkey % 17 <> 0 AND n_regionkey <> 4 AS seen FROM customer JOIN nation ON n_nationkey = c_nationkey),
verses AS (SELECT * FROM all_verses WHERE seen),
kinds AS (SELECT * FROM ({_values(EDITIONS)}) v(k, kind, language_code, script_code, rights_status, last_day)),
all_editions AS (SELECT w.id * {N} + k AS id, w.id AS work_id, w.slug || '-' || k AS title, w.status AS work_status, w.id * {N} + k <> {DRAFT} AS published, kinds.* FROM all_works w, kinds),
editions AS (SELECT * FROM all_editions WHERE published AND work_status = 'published' AND {CLEARED} AND (last_day IS NULL OR CAST(last_day AS DATE) >= DATE '{TODAY}')),
all_contents AS (SELECT doc_id AS id, v.id AS verse_id, v.work_id, v.n_nationkey, v.ref, v.seen, v.work_id * {N} + doc_id % {N} AS edition_id, text AS body, {sql_fold("text")} AS folded, doc_id % 13 <> 0 AS published FROM documents JOIN all_verses v ON v.id = doc_id % 150),
contents AS (SELECT * FROM all_contents WHERE published AND edition_id IN (SELECT id FROM editions)),
people AS (SELECT s_suppkey AS id, 'p' || s_suppkey AS slug, s_name AS name, replace(s_name, 'Supplier', 'Sage') AS more FROM supplier WHERE s_suppkey % 10 <> 3),
topics AS (SELECT p_partkey AS id, 't' || p_partkey AS slug, p_name AS name FROM part WHERE p_partkey % 19 <> 0),
mentions AS (SELECT * FROM (SELECT DISTINCT user_id AS verse_id, CASE WHEN event_id % 3 = 0 THEN 'person' ELSE 'topic' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id % 10 ELSE event_id % 200 END AS id FROM events) WHERE (verse_id + id) % 11 <> 0),
xrefs AS (SELECT o_custkey % 150 AS from_verse_id, o_orderkey % 149 AS to_verse_id FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 700 <> 0),
tracks AS (SELECT 'tn' || n_nationkey AS id, 'n' || n_nationkey AS section_id FROM nation WHERE n_nationkey <> 9 AND n_regionkey * {N} + n_nationkey % {N} IN (SELECT id FROM editions)),
segments AS (SELECT user_id AS verse_id, event_id * 10 AS start_ms FROM events WHERE event_type = 'view' AND 'tn' || event_id % 25 IN (SELECT id FROM tracks))"""
_TOKENS = r"list_filter(string_split_regex({0}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"


def _hits(raw: str, folded: str) -> str:
    """Rows of a query: every content with its rank, and whether it is a hit."""
    return f"""linked AS (SELECT DISTINCT verse_id FROM mentions m WHERE length('{folded}') >= 3 AND (
  (kind = 'person' AND id IN (SELECT id FROM people WHERE contains({sql_fold("name")}, '{folded}') OR contains({sql_fold("more")}, '{folded}')))
  OR (kind = 'topic' AND id IN (SELECT id FROM topics WHERE contains({sql_fold("name")}, '{folded}')))
  OR (kind = 'person' AND id IN (SELECT c_custkey FROM customer WHERE c_custkey < 10 AND (contains({sql_fold("'Spring ' || c_mktsegment")}, '{folded}') OR contains('Spring ' || c_mktsegment, '{raw}')))))),
counted AS (SELECT c.*, e.kind, e.language_code, e.script_code, e.title, e.k, w.slug, len(list_filter({_TOKENS.format("folded")}, lambda x: starts_with(x, '{folded}'))) AS n, verse_id IN (SELECT verse_id FROM linked) AS linked
  FROM contents c JOIN editions e ON e.id = c.edition_id JOIN works w ON w.id = c.work_id WHERE c.seen),
hits AS (SELECT *, CAST(greatest(n * 0.1::DOUBLE / (n * 0.1::DOUBLE + 1), CASE WHEN contains(folded, '{folded}') THEN 0.9 ELSE 0 END, CASE WHEN ref = '{raw}' THEN 1.0 ELSE 0 END, CASE WHEN linked THEN 0.6 ELSE 0 END) AS REAL) AS rank
  FROM counted WHERE n > 0 OR contains(folded, '{folded}') OR ref = '{raw}' OR (linked AND kind IN ('translation', 'base_text', 'transliteration')))"""


_HIT_ORDER = "rank DESC, work_id, n_nationkey, verse_id, CASE kind WHEN 'base_text' THEN 1 WHEN 'transliteration' THEN 2 ELSE 3 END, edition_id, id"
_HIT = 'verse_id, ref, slug AS work_slug, edition_id, title AS edition_title, language_code, script_code, kind, round(CAST(rank AS DOUBLE), 6) AS rank'


def _rounded(df):
    return df.withColumn("rank", F.round(F.col("rank").cast("double"), 6))


def _headline(words: str) -> str:
    """The snippet of a hit: the headline rule in SQL."""
    hit = f"len(list_filter({_TOKENS.format(sql_fold('x'))}, lambda y: {words})) > 0"
    return f""", w AS (SELECT *, list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '') AS ws FROM best), h AS (SELECT *, list_transform(ws, lambda x: {hit}) AS hs FROM w),
s AS (SELECT *, CAST(greatest(least(list_position(hs, true) - 6, len(ws) - 11), 1) AS BIGINT) AS s FROM h)
SELECT verse_id, ref, slug AS work_slug, edition_id, title AS edition_title, language_code, script_code, kind, round(CAST(rank AS DOUBLE), 6) AS rank,
CASE WHEN list_contains(hs, true) THEN array_to_string(list_transform(ws[s:s + 29], lambda x, i: CASE WHEN hs[s + i - 1] THEN '«' || x || '»' ELSE x END), ' ') ELSE left(body, 160) END AS snippet FROM s"""


@query(f"WITH {LIBRARY}, {_hits('ring', 'rng')}, best AS (SELECT * FROM hits ORDER BY {_HIT_ORDER} LIMIT 100){_headline('starts_with(y, ' + chr(39) + 'rng' + chr(39) + ')')}")
def search_verses(t):
    return _rounded(L.search_verses(visible(t, indexed=True), " ring ", limit=500))


@query(f"WITH {LIBRARY}, {_hits('ring', 'rng')} SELECT {_HIT} FROM hits WHERE slug = 'asia' AND language_code = 'sa' AND edition_id IN (10, 11, 14, 15) ORDER BY {_HIT_ORDER} LIMIT 20 OFFSET 3")
def search_verses_filtered(t):
    return _rounded(L.search_verses(visible(t, indexed=True), "ring", "asia", "sa", [10, 11, 14, 15], 20, 3)).drop("snippet")


@query(f"WITH {LIBRARY}, {_hits('2.2.6', '2.2.6')} SELECT {_HIT} FROM hits ORDER BY {_HIT_ORDER} LIMIT 20")
def search_verses_by_ref(t):
    return _rounded(L.search_verses(visible(t, indexed=True), "2.2.6")).drop("snippet")


@query(f"""WITH {LIBRARY}, {_hits('ring', 'rng')},
pool AS (SELECT * FROM hits WHERE (kind = 'translation' AND language_code = 'en') OR (kind = 'transliteration' AND script_code = 'Latn') OR kind = 'word_meanings' ORDER BY {_HIT_ORDER} LIMIT 60),
best AS (SELECT verse_id, ref, slug, work_id, n_nationkey, CAST(sum(CAST(rank AS DOUBLE)) AS REAL) AS rank FROM pool GROUP BY ALL ORDER BY rank DESC, work_id, n_nationkey, verse_id LIMIT 8)
SELECT b.verse_id, b.ref, b.slug AS work_slug, c.edition_id, e.title AS edition_title, e.language_code, md5(c.body) AS body, 'by ' || e.k AS attribution_text, round(CAST(b.rank AS DOUBLE), 6) AS rank
FROM best b JOIN contents c ON c.verse_id = b.verse_id JOIN editions e ON e.id = c.edition_id WHERE e.k IN (1, 2, 4)""")
def retrieve_for_qa(t):
    return _rounded(L.retrieve_for_qa(visible(t, indexed=True), "ring")).withColumn("body", F.md5("body"))


@query(f"""WITH {LIBRARY}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS rank FROM embeddings, q)
SELECT c.id AS content_id, c.verse_id, c.ref, w.slug AS work_slug, c.edition_id, e.title AS edition_title, e.language_code, md5(c.body) AS body, 'by ' || e.k AS attribution_text, rank
FROM near JOIN contents c ON c.id = vec_id JOIN editions e ON e.id = c.edition_id JOIN works w ON w.id = c.work_id
WHERE rank >= 0.1 AND (e.language_code = 'en' OR e.kind <> 'translation') ORDER BY rank DESC, content_id LIMIT 20""")
def match_contents(t):
    vector = t("embeddings").where("vec_id = 0").select("embedding").first()[0]
    return L.match_contents(visible(t), vector, limit=20, least=0.1).withColumn("body", F.md5("body"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS similarity FROM embeddings, q)
SELECT vec_id, similarity FROM s WHERE similarity >= 0.15 ORDER BY similarity DESC, vec_id LIMIT 50""")
def vector_lists(t):
    vector = t("embeddings").where("vec_id = 3").select("embedding").first()[0]
    return nearest(vectors_of(t("embeddings"), "vec_id"), vector, 50, 0.15).select(F.col("id").alias("vec_id"), "similarity")


_VIEW = f"""SELECT e.id, e.work_id, e.kind, l.name AS language_name, s.name AS script_name, e.rights_status, 'CC' AS license, n_name AS source_title
FROM editions e JOIN ({_values(LANGUAGES)}) l(code, name) ON l.code = e.language_code JOIN ({_values(SCRIPTS)}) s(code, name) ON s.code = e.script_code LEFT JOIN nation ON n_nationkey = CASE WHEN k % 2 = 0 THEN e.id END"""


@query(f"WITH {LIBRARY} {_VIEW}")
def editions_view(t):
    return L.editions_view(visible(t)).select("id", "work_id", "kind", "language_name", "script_name", "rights_status", "license", "source_title")


@query(f"WITH {LIBRARY} {_VIEW.replace('FROM editions e', 'FROM all_editions e')}")
def editions_view_of_editors(t):
    lib = visible(t, gates.SecurityContext("u", "editor", TODAY))
    return L.editions_view(lib).select("id", "work_id", "kind", "language_name", "script_name", "rights_status", "license", "source_title")


@query(f"WITH {LIBRARY} SELECT id, rights_status FROM all_editions WHERE rights_status IN ('open_license', 'public_domain') AND (last_day IS NULL OR CAST(last_day AS DATE) >= DATE '{TODAY}')")
def cleared_editions(t):
    return L.cleared_editions(L.editions_view(library(t)), ["open_license", "public_domain"], F.lit(TODAY).cast("date")).select("id", "rights_status")


@query(f"WITH {LIBRARY} SELECT id, edition_id FROM contents")
def visible_contents(t):
    return visible(t, gates.SecurityContext(role="stranger", today=TODAY)).contents.select("id", "edition_id")


@query(f"""WITH {LIBRARY} SELECT 'works' AS name, count(*) AS n FROM works UNION ALL SELECT 'verses', count(*) FROM verses UNION ALL SELECT 'sections', count(*) + 4 FROM nation WHERE n_regionkey <> 4 AND n_nationkey <> 7
UNION ALL SELECT 'editions', count(*) FROM editions UNION ALL SELECT 'contents', count(*) FROM contents UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'xrefs', count(*) FROM xrefs
UNION ALL SELECT 'entities', (SELECT count(*) FROM people) + (SELECT count(*) FROM topics) + (SELECT count(*) FROM nation WHERE n_nationkey % 6 <> 5)
UNION ALL SELECT 'tracks', count(*) FROM tracks UNION ALL SELECT 'segments', count(*) FROM segments UNION ALL SELECT 'embeddings', 0 UNION ALL SELECT 'rights', {N}""")
def visible_rows(t):
    lib, out = visible(t), None
    for name in ("works", "verses", "sections", "editions", "contents", "mentions", "xrefs", "entities", "tracks", "segments", "embeddings", "rights"):
        n = getattr(lib, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""WITH {LIBRARY}, r AS (SELECT verse_id, string_agg(e.id || '/' || e.language_code || '/' || c.id, ' ' ORDER BY k, e.id, c.id) AS renderings FROM contents c JOIN editions e ON e.id = c.edition_id GROUP BY 1),
a AS (SELECT verse_id, count(*) AS n FROM segments GROUP BY 1)
SELECT v.section_id, CAST(count(*) AS BIGINT) AS n_verses, coalesce(any_value(t.id), '') AS tracks, md5(string_agg(v.ref || ':' || coalesce(p.name, '-') || ':' || coalesce(renderings, '') || ':' || coalesce(a.n, 0), ';' ORDER BY v.id)) AS verses
FROM verses v LEFT JOIN tracks t ON t.section_id = v.section_id LEFT JOIN people p ON p.id = v.speaker_id LEFT JOIN r ON r.verse_id = v.id LEFT JOIN a ON a.verse_id = v.id WHERE n_nationkey <> 7 GROUP BY v.section_id""")
def section_payload(t):
    x = L.section_payload(visible(t))
    rendering = lambda r: F.concat_ws("/", r["edition_id"], r["language_code"], r["id"])
    one = lambda v: F.concat_ws(":", v["ref"], F.coalesce(v["speaker"]["name"], F.lit("-")), F.array_join(F.transform(v["renderings"], rendering), " "), F.size(v["audio"]))
    verses = F.md5(F.array_join(F.transform("verses", one), ";"))
    return x.select("section_id", F.size("verses").cast("long").alias("n_verses"), F.array_join(F.transform("tracks", lambda r: r["id"]), ",").alias("tracks"), verses.alias("verses"))


@query(f"""WITH {LIBRARY}, n AS (SELECT section_id, n_nationkey, work_id, count(*) AS n FROM verses GROUP BY ALL),
l AS (SELECT n_regionkey, string_agg('{{"id":"n' || nation.n_nationkey || '","ref":"' || n_regionkey || '.' || nation.n_nationkey || '","ordinal":' || nation.n_nationkey || ',"total":' || coalesce(n, 0) || ',"children":[]}}', ',' ORDER BY nation.n_nationkey) AS kids, sum(coalesce(n, 0)) AS total FROM nation LEFT JOIN n ON n.n_nationkey = nation.n_nationkey WHERE nation.n_nationkey <> 7 AND n_regionkey <> 4 GROUP BY 1)
SELECT n_regionkey AS work_id, '[{{"id":"r' || n_regionkey || '","ref":"' || n_regionkey || '","ordinal":' || n_regionkey || ',"total":' || CAST(total AS BIGINT) || ',"children":[' || kids || ']}}]' AS contents FROM l""")
def toc_nested(t):
    lib = visible(t)
    return D.toc(lib.sections, lib.verses)


@query(f"""WITH {LIBRARY}, m AS (SELECT m.*, work_id FROM mentions m JOIN verses v ON v.id = m.verse_id), x AS (SELECT x.*, work_id FROM xrefs x JOIN verses v ON v.id = from_verse_id)
SELECT slug, 'meta' AS part, 1 AS n FROM works UNION ALL SELECT slug, 'toc', 1 FROM works UNION ALL SELECT slug, 'edition', count(*) FROM works w JOIN editions e ON e.work_id = w.id GROUP BY 1
UNION ALL SELECT slug, 'section', count(DISTINCT section_id) FROM works w JOIN verses v ON v.work_id = w.id WHERE n_nationkey <> 7 GROUP BY 1 UNION ALL SELECT slug, 'story', count(*) FROM works w JOIN nation ON n_regionkey = w.id WHERE n_nationkey % 6 <> 5 GROUP BY 1
UNION ALL SELECT slug, 'mention', count(*) FROM works w JOIN m ON m.work_id = w.id GROUP BY 1 UNION ALL SELECT slug, 'cross_reference', count(*) FROM works w JOIN x ON x.work_id = w.id GROUP BY 1
UNION ALL SELECT '-', 'person', count(*) FROM people UNION ALL SELECT '-', 'topic', count(*) FROM topics UNION ALL SELECT '-', 'entity_name', count(*) FROM customer WHERE c_custkey < 10""")
def work_bundles(t):
    parts = L.work_bundle(visible(t), now=F.lit(TODAY).cast("timestamp"))
    return parts.groupBy(F.coalesce("slug", F.lit("-")).alias("slug"), "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LIBRARY}, x AS (SELECT * FROM xrefs JOIN verses v ON v.id = from_verse_id)
SELECT 'slugs' AS key, '[' || string_agg('"' || slug || '"', ',' ORDER BY slug) || ']' AS value FROM works
UNION ALL SELECT 'meta:' || slug, '{{"slug":"' || slug || '","status":"published","sort_order":' || id || ',"generated_at":"{TODAY}T00:00:00"}}' FROM works
UNION ALL SELECT 'person:' || id, '{{"id":' || id || ',"slug":"' || slug || '","name":"' || name || '","more":["' || more || '"]}}' FROM people UNION ALL SELECT 'topic:' || id, '{{"id":' || id || ',"slug":"' || slug || '","name":"' || name || '","more":null}}' FROM topics
UNION ALL SELECT 'story:' || slug || ':' || n_nationkey, '{{"id":' || n_nationkey || ',"slug":"s' || n_nationkey || '","name":"' || n_name || '","more":null}}' FROM nation JOIN works w ON w.id = n_regionkey WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'entity_name:person:' || c_custkey || ':de', '{{"kind":"person","id":' || c_custkey || ',"name":"Spring ' || c_mktsegment || '","language_code":"de"}}' FROM customer WHERE c_custkey < 10
UNION ALL SELECT 'edition:' || slug || ':' || e.id, e.title FROM editions e JOIN works w ON w.id = e.work_id
UNION ALL SELECT 'mention:' || slug || ':' || m.verse_id || ':' || m.kind || ':' || m.id, '{{"verse_id":' || m.verse_id || ',"kind":"' || m.kind || '","id":' || m.id || ',"role":"subject"}}' FROM mentions m JOIN verses v ON v.id = m.verse_id JOIN works w ON w.id = v.work_id
UNION ALL SELECT 'cross_reference:' || slug || ':' || from_verse_id || ':' || to_verse_id || ':see_also', '{{"from_verse_id":' || from_verse_id || ',"to_verse_id":' || to_verse_id || ',"kind":"see_also"}}' FROM x JOIN works w ON w.id = x.work_id
UNION ALL SELECT 'section:' || slug || ':' || v.work_id || '.' || n_nationkey, CAST(count(*) AS VARCHAR) FROM verses v JOIN works w ON w.id = v.work_id WHERE n_nationkey <> 7 GROUP BY slug, v.work_id, n_nationkey
UNION ALL SELECT 'verse:' || slug || ':' || v.ref, coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY e.k, e.id, c.id), '') FROM verses v JOIN works w ON w.id = v.work_id LEFT JOIN contents c ON c.verse_id = v.id LEFT JOIN editions e ON e.id = c.edition_id WHERE v.n_nationkey <> 7 GROUP BY slug, v.ref""")
def bundle_keys(t):
    lib = visible(t)
    keys = L.bundle_keys(L.work_bundle(lib, now=F.lit(TODAY).cast("timestamp")), L.verse_type(lib)).where("NOT startswith(key, 'toc:')")
    part = F.split("key", ":")[0]
    ids = F.array_join(F.from_json(F.get_json_object("value", "$.renderings"), "array<struct<id long>>")["id"], ",")
    verses = F.size(F.from_json(F.get_json_object("value", "$.verses"), "array<struct<ref string>>")).cast("string")
    value = F.when(part == "edition", F.get_json_object("value", "$.title")).when(part == "section", verses).when(part == "verse", ids).otherwise(F.col("value"))
    return keys.select("key", value.alias("value"))


# ---- small sets


@query(f"WITH {LIBRARY} SELECT work_id, string_agg(DISTINCT language_code, ',' ORDER BY language_code) AS languages FROM all_editions WHERE kind = 'translation' GROUP BY 1")
def work_languages(t):
    e = library(t).editions.where("kind = 'translation'")
    return order.ids_or_null(e, ["work_id"], "language_code", "languages").select("work_id", F.array_join("languages", ",").alias("languages"))


@query("SELECT n_regionkey, coalesce(string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) FILTER (n_nationkey > 12 AND n_regionkey <> 2), 'none') AS ids FROM nation GROUP BY 1")
def ids_or_null(t):
    x = t("nation").withColumn("id", F.when((F.col("n_nationkey") > 12) & (F.col("n_regionkey") != 2), F.col("n_nationkey")))
    return order.ids_or_null(x, ["n_regionkey"], "id").select("n_regionkey", F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("none")).alias("ids"))


@query("SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) AS INTEGER) AS ordinal FROM lineitem")
def renumbered(t):
    return order.renumbered(t("lineitem"), ["l_orderkey"], [F.col("l_partkey"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("l_orderkey", "l_partkey", "ordinal")


@query("""WITH x AS (SELECT conv_id, list(role || turn % 3 ORDER BY turn) FILTER (turn % 2 = 0) AS a, list(role || turn % 3 ORDER BY turn) FILTER (turn % 2 = 1) AS b FROM conversations GROUP BY 1),
y AS (SELECT conv_id, list_concat(coalesce(a, []), coalesce(b, [])) AS c FROM x)
SELECT conv_id, array_to_string(list_filter(c, lambda v, i: list_position(c, v) = i), ',') AS every, array_to_string(list_filter(list_filter(c, lambda v, i: list_position(c, v) = i), lambda v: v <> 'user0'), ',') AS rest FROM y""")
def ordered_sets(t):
    x = t("conversations").withColumn("v", F.concat("role", F.col("turn") % 3))
    part = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == n, F.struct("turn", "v")))), lambda s: s["v"])
    x = x.groupBy("conv_id").agg(part(0).alias("a"), part(1).alias("b"))
    every = order.ordered_union(F.col("a"), F.col("b"))
    return x.select("conv_id", F.array_join(every, ",").alias("every"), F.array_join(order.without(every, F.lit("user0")), ",").alias("rest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END IS DISTINCT FROM CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS changed FROM customer")
def distinct_from(t):
    old, new = (F.when(F.col("c_custkey") % n != 0, F.col("c_mktsegment")) for n in (3, 2))
    return t("customer").select("c_custkey", merge.is_distinct(old, new).alias("changed"))


@query("""SELECT event_id FROM events WHERE json_contains(props, '{"k": 42}')""")
def json_containment(t):
    return t("events").where(T.json_contains("props", {"k": 42})).select("event_id")


@query(r"SELECT conv_id, turn, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 80) AS title FROM conversations WHERE role = 'user'")
def session_titles(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", T.session_title("text").alias("title"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id IN (1, 2, 3)")
def optional_filters(t):
    e = t("events")
    return e.where(L.optional(F.col("event_type"), "view") & L.optional(F.col("value"), None) & L.any_of(F.col("user_id"), [1, 2, 3]) & L.any_of(F.col("event_id"), None)).select("event_id")


# ---- table scans, functions in SQL, counts by the log


@query(f"""WITH {LIBRARY} SELECT c.id, md5(c.body) AS body, 'published' AS status, v.ref AS verse FROM contents c JOIN verses v ON v.id = c.verse_id WHERE c.edition_id = {2 * N} ORDER BY v.work_id, v.n_nationkey, v.id, c.id LIMIT 1000""")
def table_contents_of_edition(t):
    rows = tables.scan(visible(t), "contents", ["id", "body", "status"], [tables.Embed("verses", ["ref"], inner=True)], F.col("edition_id") == 2 * N, [T.ref_parts("verses.ref"), F.col("id")])
    return rows.select("id", F.md5("body").alias("body"), "status", F.col("verses.ref").alias("verse"))


@query(f"SELECT k AS id, rights_status AS status, 'CC' AS license, n_name AS title FROM ({_values(EDITIONS)}) v(k, kind, language_code, script_code, rights_status, last_day) LEFT JOIN nation ON n_nationkey = k AND k <> 3")
def table_rights_with_source(t):
    rows = tables.scan(visible(t), "rights", ["id", "status", "license"], [tables.Embed("sources", ["title"])])
    return rows.select("id", "status", "license", F.col("sources.title").alias("title"))


@query(f"WITH {LIBRARY} SELECT w.slug, string_agg(e.id || ' ' || e.title, ', ' ORDER BY e.id) AS editions FROM works w JOIN editions e ON e.work_id = w.id GROUP BY 1")
def table_works_with_editions(t):
    rows = tables.scan(visible(t), "works", ["slug"], [tables.Embed("editions", ["id", "title"], inner=True)])
    return rows.select("slug", F.array_join(F.transform("editions", lambda e: F.concat_ws(" ", e["id"], e["title"])), ", ").alias("editions"))


@query(f"WITH {LIBRARY}, {_hits('ring', 'rng')} SELECT {_HIT} FROM hits WHERE slug = 'asia' ORDER BY {_HIT_ORDER} LIMIT 30")
def sql_search_verses(t):
    spark = t("region").sparkSession
    sql.register(spark, visible(t), "lib_")
    return spark.sql("SELECT verse_id, ref, work_slug, edition_id, edition_title, language_code, script_code, kind, round(CAST(rank AS DOUBLE), 6) AS rank FROM search_verses(' ring ', 'asia', NULL, 30)")


@query(f"""WITH {LIBRARY} SELECT slug, 'n' || n.n_nationkey AS section_id, 2 AS depth, (SELECT count(*) FROM verses v WHERE v.n_nationkey = n.n_nationkey) AS total FROM works w JOIN nation n ON n_regionkey = w.id WHERE n.n_nationkey <> 7 AND slug = 'europe'
UNION ALL SELECT slug, 'r' || id, 1, (SELECT count(*) FROM verses v WHERE v.work_id = w.id AND v.n_nationkey <> 7) FROM works w WHERE slug = 'europe'""")
def sql_toc(t):
    spark = t("region").sparkSession
    sql.register(spark, visible(t), "lib_")
    return spark.sql("SELECT work_slug AS slug, section_id, depth, total FROM get_toc('europe')")


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS section FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey + 1000000, 5 FROM customer WHERE c_custkey % 13 = 0)
SELECT n_nationkey, count(c_custkey) AS verse_count FROM nation LEFT JOIN n ON section = n_nationkey GROUP BY 1""")
def counts_by_log(t):
    verses = t("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("section"))
    moved = verses.where("id % 11 <> 0").withColumn("section", F.when(F.col("id") % 7 == 0, (F.col("section") + 1) % 25).otherwise(F.col("section")))
    new = moved.unionByName(verses.where("id % 13 = 0").select((F.col("id") + 1_000_000).alias("id"), F.lit(5).cast("long").alias("section")))
    sections = t("nation").select("n_nationkey").join(verses.groupBy(F.col("section").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("verse_count")), "n_nationkey", "left")
    return merge.keep_counts(sections, "n_nationkey", "verse_count", merge.diff_snapshots(verses, new, ["id"], "load"), "section")
