"""Registered queries of the engine's own operators on the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.functions import text as T
from textloom.functions.translit import transliterate
from textloom.operators import documents as D
from textloom.operators import gates, merge, order, progress, search
from textloom.operators.index import index_of, term_topk
from textloom.plans.base import NOW, ORACLE_SQL, QUERIES, query, sql_fold  # noqa: F401 - catalog is where callers look for them
from textloom.sources import store

# ---- text and search


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded_md5, CAST(length({sql_fold('text')}) AS BIGINT) AS folded_length FROM documents")
def fold_text(t):
    return t("documents").select("doc_id", F.md5(T.fold("text")).alias("folded_md5"), F.length(T.fold("text")).cast("long").alias("folded_length"))


@query(f"SELECT doc_id, source, 0.9::DOUBLE AS rank FROM documents WHERE contains({sql_fold('text')}, 'tion then') ORDER BY doc_id LIMIT 20 OFFSET 2")
def search_substring(t):
    index = index_of(t("documents"), "doc_id", "text")
    return search.search_index(index, t("documents").select("doc_id", "source"), "doc_id", "tion then", [F.col("doc_id")], 20, 2, by_terms=False).select("doc_id", "source", F.round(F.col("rank").cast("double"), 6).alias("rank"))


_TOKENS = r"list_filter(string_split_regex({0}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH x AS (SELECT doc_id, len(list_filter({_TOKENS.format(sql_fold('text'))}, lambda x: starts_with(x, 'ther') OR starts_with(x, 'ent'))) * 0.1::DOUBLE AS r FROM documents)
SELECT doc_id, round(CAST(CAST(r / (r + 1) AS REAL) AS DOUBLE), 6) AS rank FROM x WHERE r > 0 ORDER BY CAST(r / (r + 1) AS REAL) DESC, doc_id LIMIT 50""")
def search_prefix_terms(t):
    hits = term_topk(index_of(t("documents"), "doc_id", "text"), ["ther", "ent"], 50)
    r = F.col("n") * F.lit(0.1)
    rows = hits.select(F.col("id").alias("doc_id"), (r / (r + 1)).cast("float").alias("rank"))
    return rows.orderBy(F.col("rank").desc(), "doc_id").limit(50).select("doc_id", F.round(F.col("rank").cast("double"), 6).alias("rank"))


@query(f"""WITH x AS (SELECT d.doc_id, {sql_fold('d.text')} AS f, coalesce(l.toxic, 0) = 1 AS hit FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT doc_id, f, hit, len(list_filter({_TOKENS.format('f')}, lambda x: starts_with(x, 'ther'))) * 0.1::DOUBLE AS r FROM x),
s AS (SELECT doc_id, CAST(greatest(r / (r + 1), CASE WHEN contains(f, 'ther') THEN 0.9 ELSE 0 END, CASE WHEN hit THEN 0.6 ELSE 0 END, CASE WHEN doc_id = 7 THEN 1.0 ELSE 0 END) AS REAL) AS rank FROM r)
SELECT doc_id, round(CAST(rank AS DOUBLE), 6) AS rank FROM s WHERE rank > 0 ORDER BY rank DESC, doc_id LIMIT 100""")
def search_ranked(t):
    linked = t("labels").where("toxic = 1").select("doc_id", F.lit(True).alias("hit"))
    rows = t("documents").select("doc_id").join(linked, "doc_id", "left")
    found = search.search_index(index_of(t("documents"), "doc_id", "text"), rows, "doc_id", "ther", [F.col("doc_id")], 100, 0, F.col("doc_id") == 7, F.coalesce("hit", F.lit(False)))
    return found.select("doc_id", F.round(F.col("rank").cast("double"), 6).alias("rank"))


@query("SELECT o_orderkey, o_custkey || '.' || o_orderkey AS ref, CASE WHEN o_custkey || '.' || o_orderkey = '899.0' THEN 1.0 ELSE 0.9 END::DOUBLE AS rank FROM orders WHERE contains(o_custkey || '.' || o_orderkey, '899.') ORDER BY rank DESC, o_orderkey LIMIT 100")
def search_ref_hit(t):
    rows = t("orders").withColumn("ref", F.concat_ws(".", "o_custkey", "o_orderkey")).withColumn("rank", F.when(F.col("ref") == "899.0", 1.0).when(F.col("ref").contains("899."), 0.9))
    return rows.where("rank IS NOT NULL").orderBy(F.col("rank").desc(), "o_orderkey").limit(100).select("o_orderkey", "ref", "rank")


@query(f"""WITH x AS (SELECT doc_id, text, strpos({sql_fold('text')}, 'ther') AS pos FROM documents), y AS (SELECT *, greatest(pos - 60, 1) AS s, least(pos - 1 + 100, length(text)) AS e FROM x)
SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '…' ELSE '' END ELSE left(text, 100) END AS snippet FROM y""")
def search_snippet(t):
    return t("documents").select("doc_id", T.snippet("text", T.fold("text"), "ther").alias("snippet"))


@query(rf"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT *, list_transform(ws, lambda x: len(list_filter({_TOKENS.format(sql_fold('x'))}, lambda y: starts_with(y, 'ther'))) > 0) AS hs FROM w),
f AS (SELECT *, list_position(hs, true) AS p FROM h), s AS (SELECT *, CAST(greatest(least(p - 6, len(ws) - 11), 1) AS BIGINT) AS s FROM f)
SELECT doc_id, CASE WHEN list_contains(hs, true) THEN array_to_string(list_transform(ws[s:s + 29], lambda x, i: CASE WHEN hs[s + i - 1] THEN '«' || x || '»' ELSE x END), ' ') ELSE left(text, 160) END AS headline FROM s""")
def search_headline(t):
    return search.spread(t("documents")).select("doc_id", T.headline("text", ["ther"]).alias("headline"))


@query("""SELECT * FROM (SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS slug, c_name AS matched FROM customer UNION SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part UNION SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region UNION SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)
WHERE contains(lower(matched), 'er') ORDER BY kind, slug, matched LIMIT 100""")
def entity_search_union(t):
    names = None
    for kind, key, name in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_name"), ("region", "r_regionkey", "r_name"), ("supplier", "s_suppkey", "s_name")):
        x = t(kind).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("slug"), F.col(name).alias("matched"))
        names = x if names is None else names.unionByName(x)
    return search.search_entities(names, "er", 100)


@query(r"SELECT conv_id, turn, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 1000) AS question FROM conversations")
def question_clamp(t):
    return t("conversations").select("conv_id", "turn", T.clamp_question("text").alias("question"))


@query(r"""WITH x AS (SELECT conv_id, turn, conv_id || '.1' AS good, (conv_id + 1) || '.2b' AS bad, regexp_replace(text, '([.!?])', '\1 [SB ' || CASE WHEN turn % 2 = 0 THEN conv_id || '.1' ELSE (conv_id + 1) || '.2b' END || ']  [SB ' || (conv_id + 1) || '.2b]', 'g') AS a FROM conversations),
y AS (SELECT *, list_distinct(regexp_extract_all(a, '\[SB\s+(\d+(?:\.\d+)*[a-z]?)\]', 1)) AS cited FROM x), z AS (SELECT *, list_filter(cited, lambda r: r = good) AS refs FROM y)
SELECT conv_id, turn, CASE WHEN len(refs) > 0 THEN md5(trim(regexp_replace(replace(a, '[SB ' || bad || ']', ''), ' {2,}', ' ', 'g'))) ELSE '' END AS answer, array_to_string(refs, ',') AS refs FROM z""")
def ground_citations(t):
    good, bad = F.concat("conv_id", F.lit(".1")), F.concat(F.col("conv_id") + 1, F.lit(".2b"))
    first = F.when(F.col("turn") % 2 == 0, good).otherwise(bad)
    rows = t("conversations").withColumn("a", F.regexp_replace("text", F.lit("([.!?])"), F.concat(F.lit("$1 [SB "), first, F.lit("]  [SB "), bad, F.lit("]"))))
    rows = rows.withColumn("g", T.ground("a", F.array(good)))
    return rows.select("conv_id", "turn", F.when(F.col("g.text") != "", F.md5("g.text")).otherwise(F.lit("")).alias("answer"), F.array_join("g.refs", ",").alias("refs"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def strip_markup(t):
    return t("pages").select("page_id", T.strip_markup("html").alias("plain"))


@query("SELECT c_custkey, regexp_replace(md5('rights:' || c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM customer")
def deterministic_ids(t):
    return t("customer").select("c_custkey", T.deterministic_uuid("rights:", "c_name").alias("id"))


@query(r"""SELECT c_custkey, CASE WHEN trim(e) = '' THEN 'empty' WHEN NOT regexp_matches(trim(e), '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'invalid' ELSE 'ok' END AS verdict
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN replace(c_name, '#', '@') ELSE replace(c_name, '#', '@') || '.org' END AS e FROM customer)""")
def email_check(t):
    at = F.replace(F.col("c_name"), F.lit("#"), F.lit("@"))
    e = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, at).otherwise(F.concat(at, F.lit(".org")))
    return t("customer").select("c_custkey", F.coalesce(T.email_error(e), F.lit("ok")).alias("verdict"))


@query("""SELECT l_orderkey, l_linenumber, 'W/स्कन्धः ' || translate(CAST(l_linenumber + 6 AS VARCHAR), '0123456789', '०१२३४५६७८९') || '/' || CASE WHEN l_linenumber + 6 = 10 THEN CASE WHEN l_quantity <= 49 THEN 'पूर्वार्धः/' ELSE 'उत्तरार्धः/' END ELSE '' END || 'अध्यायः ' || translate(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '0123456789', '०१२३४५६७८९') AS title FROM lineitem""")
def source_titles(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", T.chapter_title("W", F.col("l_linenumber") + 6, F.col("l_quantity").cast("int")).alias("title"))


@query(r"""WITH e AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(replace(text, '. ', '; '), ' of ', ' — '), ';'), lambda x: trim(x)), lambda x: contains(x, '—') OR contains(x, '-')) AS entries FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_transform(entries, lambda x: CASE WHEN contains(x, '—') THEN trim(substr(x, 1, strpos(x, '—') - 1)) || ' — ' || trim(substr(x, strpos(x, '—') + 1)) ELSE x || ' — ' END), chr(10))) AS lines FROM e""")
def word_meaning_lines(t):
    entry = F.replace(F.replace("text", F.lit(". "), F.lit("; ")), F.lit(" of "), F.lit(" — "))
    return t("conversations").select("conv_id", "turn", F.md5(T.meanings_text(T.word_meanings(entry))).alias("lines"))


#: Words and their forms, with anusvara, candrabindu, nukta, chillu, digits and dandas.
_SCRIPTS = ("Deva", "Latn", "Mlym", "Knda", "Telu", "Beng", "Gujr", "Guru", "Orya", "Taml")
_WORDS = [
    ("हंस", "haṁsa", "ഹംസ", "ಹಂಸ", "హంస", "হংস", "હંસ", "ਹੰਸ", "ହଂସ", "ஹம்ஸ"),
    ("धर्म ।", "dharma |", "ധർമ ।", "ಧರ್ಮ ।", "ధర్మ ।", "ধর্ম ।", "ધર્મ ।", "ਧਰ੍ਮ ।", "ଧର୍ମ ।", "தர்ம ।"),
    ("ऋषिः १", "ṛṣiḥ 1", "ഋഷിഃ ൧", "ಋಷಿಃ ೧", "ఋషిః ౧", "ঋষিঃ ১", "ઋષિઃ ૧", "ਰਿਸ਼ਿਃ ੧", "ଋଷିଃ ୧", "ருஷிஃ ௧"),
    ("चाँद", "cām̐da", "ചാഁദ", "ಚಾಁದ", "చాఁద", "চাঁদ", "ચાઁદ", "ਚਾਁਦ", "ଚାଁଦ", "சாம்த"),
    ("ग\u093cम", "ġama", "ഗമ", "ಗಮ", "గమ", "গম", "ગમ", "\u0a17\u0a3cਮ", "ଗମ", "க\u093cம"),
]


@query(f"SELECT n_nationkey, {', '.join(_SCRIPTS[1:])} FROM nation JOIN (VALUES {', '.join(str((i, *w)) for i, w in enumerate(_WORDS))}) v(i, {', '.join(_SCRIPTS)}) ON i = n_nationkey % {len(_WORDS)}")
def transliterated(t):
    word = F.element_at(F.array(*[F.lit(w[0]) for w in _WORDS]), (F.col("n_nationkey") % len(_WORDS) + 1).cast("int"))
    rows = t("nation").select("n_nationkey", word.alias("deva"))
    return rows.select("n_nationkey", *[transliterate("deva", s).alias(s) for s in _SCRIPTS[1:]])


# ---- order, numbering, windows


@query("""SELECT l_orderkey, ref, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, suffix) - 1 AS BIGINT) AS position FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 2 ELSE 0 END AS suffix, l_orderkey || '.' || l_linenumber || CASE WHEN l_quantity < 5 THEN 'b' ELSE '' END AS ref FROM lineitem)""")
def ref_parts_order(t):
    ref = F.concat(F.concat_ws(".", "l_orderkey", "l_linenumber"), F.when(F.col("l_quantity") < 5, "b").otherwise(""))
    rows = t("lineitem").select("l_orderkey", ref.alias("ref")).withColumn("parts", T.ref_parts("ref"))
    return order.positions(rows, ["l_orderkey"], [F.col("parts")]).select("l_orderkey", "ref", "position")


@query("SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS BIGINT) AS position FROM orders")
def seq_position(t):
    return order.positions(t("orders"), ["o_custkey"], [F.col("o_orderdate")]).select("o_custkey", "o_orderkey", "position")


@query("SELECT o_custkey, o_orderkey, round(100.0::DOUBLE * rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) / count(*) OVER (PARTITION BY o_custkey), 2) AS percent FROM orders")
def progress_percent(t):
    return order.progress(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "percent")


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS prev_o_orderkey, coalesce(lead(o_orderkey) OVER w, -1) AS next_o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def prev_next(t):
    return order.neighbours(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey").na.fill(-1).select("o_orderkey", "prev_o_orderkey", "next_o_orderkey")


@query("SELECT n_nationkey, concat_ws(',', lag(n_nationkey) OVER w, lead(n_nationkey) OVER w) AS adjacent FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def adjacent_ids(t):
    x = order.adjacent(t("nation"), ["n_regionkey"], [F.col("n_nationkey")], "n_nationkey")
    return x.select("n_nationkey", F.array_join(F.col("adjacent").cast("array<string>"), ",").alias("adjacent"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber AS n, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT l_orderkey, CAST(unnest(range(b + 1, n)) AS INTEGER) AS missing FROM g WHERE n > b + 1""")
def gap_report(t):
    return order.gaps(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS expected FROM lineitem) WHERE l_linenumber <> expected""")
def dense_check(t):
    return order.dense_violations(t("lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


@query("""SELECT l_orderkey, l_partkey, l_linenumber || CASE WHEN n = 1 THEN '' ELSE chr(96 + n) END AS ref FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS n FROM lineitem)""")
def occurrence_suffix(t):
    x = order.occurrence_suffix(t("lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return x.select("l_orderkey", "l_partkey", F.concat("l_linenumber", "suffix").alias("ref"))


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked FROM conversations""")
def carry_forward(t):
    x = t("conversations").withColumn("q", F.when(F.col("role") == "user", F.col("turn")))
    return order.carry_forward(x, ["conv_id"], [F.col("turn")], "q", "asked").na.fill(-1, ["asked"]).select("conv_id", "turn", "asked")


@query("SELECT c_nationkey, c_custkey, CAST(sum(1 + c_custkey % 7) OVER w AS BIGINT) AS last, CAST(sum(1 + c_custkey % 7) OVER w - (1 + c_custkey % 7) AS BIGINT) AS first FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)")
def running_offsets(t):
    x = t("customer").withColumn("size", 1 + F.col("c_custkey") % 7)
    return order.running_offsets(x, ["c_nationkey"], [F.col("c_custkey")], "size").select("c_nationkey", "c_custkey", "last", "first")


@query("SELECT event_type, user_id, CAST(max(event_id) AS BIGINT) AS last_event FROM events WHERE event_type = 'view' GROUP BY ALL ORDER BY last_event DESC, user_id LIMIT 8")
def mru_list(t):
    x = t("events").where("event_type = 'view'")
    return order.most_recent(x, "user_id", "event_id", 8).select(F.lit("view").alias("event_type"), "user_id", F.col("event_id").alias("last_event"))


@query("SELECT event_id, user_id FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_topk(t):
    return t("events").where("value IS NOT NULL").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(30).select("event_id", "user_id")


# ---- hierarchy and documents


@query("""SELECT r_regionkey, n_nationkey, CAST(count(c_custkey) AS BIGINT) AS n, CAST(sum(count(c_custkey)) OVER (PARTITION BY r_regionkey) AS BIGINT) AS region_n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey, n_nationkey""")
def toc_counts(t):
    sections = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")).unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")))
    leaves = t("customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("section_id")).agg(F.count(F.lit(1)).alias("n"))
    total = D.subtree_counts(sections, leaves)
    r, n = total.select(F.col("section_id").alias("r"), F.col("total").alias("region_n")), total.select(F.col("section_id").alias("n_id"), F.col("total").alias("n"))
    x = t("nation").join(r, F.concat(F.lit("r"), "n_regionkey") == F.col("r"), "left").join(n, F.concat(F.lit("n"), "n_nationkey") == F.col("n_id"), "left")
    return x.na.fill(0).select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n", "region_n")


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT n_regionkey, string_agg(n_name || ':' || coalesce(n, 0), ',' ORDER BY n_nationkey) AS kids FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY 1)
SELECT r_name, coalesce(kids, '') AS children FROM region LEFT JOIN k ON n_regionkey = r_regionkey""")
def toc_document(t):
    n = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"))
    kids = t("nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").na.fill(0, ["total"])
    kids = D.nested(kids, ["n_regionkey"], ["n_nationkey"], ["n_name", "total"], "children").withColumnRenamed("n_regionkey", "r_regionkey")
    x = D.with_children(t("region"), kids, ["r_regionkey"], "children")
    return x.select("r_name", F.array_join(F.transform("children", lambda c: F.concat(c["n_name"], F.lit(":"), c["total"])), ",").alias("children"))


@query("""SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS sections, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS verses FROM region""")
def catalogue(t):
    works = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("slug"), F.lit("published").alias("status"), F.col("r_regionkey").alias("sort_order"))
    sections = t("nation").select(F.col("n_nationkey").alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("n_regionkey").alias("work_id"))
    verses = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("work_id"))
    return D.catalogue(works, sections, verses).select(F.col("slug").alias("r_name"), "sections", "verses")


@query("""SELECT l_orderkey, l_linenumber, s_name, n_name, r_name, p_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN part ON p_partkey = l_partkey AND p_size < 25""")
def denorm_view(t):
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.join(t("part").where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "s_name", "n_name", "r_name", "p_name")


@query("""SELECT o_orderkey, o_orderpriority, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def chapter_payload(t):
    lines = D.nested(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey"], "lines").withColumnRenamed("l_orderkey", "o_orderkey")
    x = D.with_children(t("orders"), lines, ["o_orderkey"], "lines")
    return x.select("o_orderkey", "o_orderpriority", F.array_join(F.transform("lines", lambda v: F.concat_ws(":", v["l_linenumber"], v["l_partkey"])), ",").alias("lines"))


@query("""SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(refs, '') AS refs FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS refs FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey""")
def entity_detail(t):
    o = D.nested(t("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderkey"], ["o_orderkey"], "orders")
    n = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    x = D.with_children(t("customer"), o, ["c_custkey"], "orders").join(n, "c_custkey", "left").na.fill(0, ["n_lines"])
    refs = F.array_join(F.transform("orders", lambda v: v["o_orderkey"].cast("string")), ",")
    return x.select("c_custkey", "c_name", F.size("orders").cast("long").alias("n_orders"), "n_lines", refs.alias("refs"))


@query("""WITH e AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part),
m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'supplier' WHEN 'purchase' THEN 'part' ELSE 'customer' END AS kind, user_id AS id FROM events)
SELECT event_id, m.kind, name FROM m LEFT JOIN e ON e.kind = m.kind AND e.id = m.id""")
def polymorphic_lookup(t):
    tables = {k: t(k).select(F.col(i).alias("id"), F.col(i).alias("slug"), F.col(n).alias("name")) for k, i, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))}
    names = D.entity_union(tables, dict.fromkeys(tables, "name"))
    kind = F.when(F.col("event_type") == "click", "supplier").when(F.col("event_type") == "purchase", "part").otherwise("customer")
    m = t("events").select("event_id", kind.alias("kind"), F.col("user_id").alias("id"))
    return m.join(names, ["kind", "id"], "left").select("event_id", "kind", "name")


@query("SELECT node, direction, count(*) AS n, count(DISTINCT other) AS others FROM (SELECT 'p' || l_partkey AS node, 's' || l_suppkey AS other, 'out' AS direction FROM lineitem UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'in' FROM lineitem) GROUP BY 1, 2")
def edges_undirected(t):
    e = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return D.undirected(e, "a", "b").groupBy("node", "direction").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("other").alias("others"))


# ---- gates


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.lang <> 'de' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)")
def rights_gate(t):
    rights = t("labels").select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "open_license").otherwise("pending").alias("status"), F.lit(None).cast("date").alias("permission_expires_on"))
    editions = t("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("rights_id"), F.col("lang").alias("work_id"), F.lit("published").alias("status"))
    works = t("documents").select(F.col("lang").alias("id")).distinct().withColumn("status", F.when(F.col("id") == "de", "draft").otherwise("published"))
    ctx = gates.SecurityContext(role="reader", today="2024-01-15")
    contents = t("documents").select(F.col("doc_id").alias("edition_id"), "lang", F.lit("published").alias("status"))
    return ctx.contents(contents, ctx.public_editions(editions, works, rights)).select(F.col("edition_id").alias("doc_id"), "lang")


@query("SELECT event_id, event_type FROM events WHERE user_id = 8")
def owner_rows(t):
    x = t("events").withColumn("user_id", F.col("user_id").cast("string"))
    return gates.SecurityContext(uid="8").own(x).select("event_id", "event_type")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 = 3")
def session_messages(t):
    sessions = t("conversations").select("conv_id").distinct().withColumn("user_id", (F.col("conv_id") % 5).cast("string"))
    return gates.SecurityContext(uid="3").own_children(t("conversations"), sessions, "conv_id").select("conv_id", "turn", "role")


@query(r"SELECT event_id, event_type FROM events WHERE regexp_full_match(event_type, '[a-z][a-z0-9_]{1,31}')")
def event_gate(t):
    from textloom.streaming.events import gate

    return gate(t("events").withColumn("event", F.col("event_type"))).select("event_id", "event_type")


@query("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'published' ELSE 'draft' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def ingest_draft(t):
    x = t("documents").join(t("labels"), "doc_id", "left").withColumn("status", F.lit("published"))
    return gates.force_draft(x, F.col("quality") == 1).select("doc_id", "status")


# ---- upserts, merges, capture


@query("SELECT user_id, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events GROUP BY user_id")
def upsert_latest(t):
    e = t("events").select("user_id", "event_id", "ts")
    old, new = e.where("event_id % 2 = 0"), e
    latest = [F.col("ts").desc(), F.col("event_id").desc()]
    return merge.upsert_latest(order.first_rows(old, ["user_id"], latest), new, ["user_id"], latest).select("user_id", "event_id")


@query("SELECT user_id, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_first(t):
    e = t("events").select("user_id", "event_id")
    first = [F.col("event_id")]
    return merge.upsert_first(order.first_rows(e.where("event_id % 2 = 0"), ["user_id"], first), e.where("event_id % 2 = 1"), ["user_id"], first)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders WHERE day(o_orderdate) % 2 = 0), n AS (SELECT o_orderkey AS k, 'N' AS s, 'new' AS p FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.s, n.s) AS s, CASE WHEN o.k IS NOT NULL THEN o.p ELSE n.p END AS p FROM o FULL JOIN n ON o.k = n.k""")
def merge_prefer_existing(t):
    x = t("orders")
    o = x.where(F.dayofmonth("o_orderdate") % 2 == 0).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p"))
    n = x.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit("N").alias("s"), F.lit("new").alias("p"))
    return merge.merge_prefer(o, n, ["k"], ["s", "p"], override=("p",))


@query("""WITH a AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.at IS NULL OR b.at > a.at THEN b.at ELSE a.at END AS at, CASE WHEN a.at IS NULL OR b.at > a.at THEN 'server' ELSE 'local' END AS origin FROM a FULL JOIN b ON a.user_id = b.user_id""")
def lww_merge(t):
    of = lambda kind: t("events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias("at"))
    return merge.last_writer_wins(of("click"), of("view"), ["user_id"], "at", [])


@query("""WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND event_id % 4 = 0), r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click')
SELECT user_id AS slug, 'local' AS origin FROM l UNION ALL SELECT user_id, 'remote' FROM r WHERE user_id NOT IN (SELECT user_id FROM l)""")
def local_wins(t):
    of = lambda cond, origin: t("events").where(cond).select(F.col("user_id").alias("slug")).distinct().withColumn("origin", F.lit(origin))
    return merge.local_wins(of("event_type = 'view' AND event_id % 4 = 0", "local"), of("event_type = 'click'", "remote"), "slug")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("""WITH m AS (SELECT event_id, json_merge_patch(props, CASE WHEN event_id % 2 = 0 THEN json_object('k', event_type) ELSE json_object('u', CAST(user_id AS VARCHAR)) END) AS j FROM events)
SELECT event_id, j->>'$.k' AS k, coalesce(j->>'$.u', '-') AS u FROM m""")
def json_merge(t):
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("event_type"))).otherwise(F.create_map(F.lit("u"), F.col("user_id").cast("string")))
    x = t("events").withColumn("m", merge.merge_maps(F.from_json("props", "map<string,string>"), new))
    return x.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.coalesce(F.try_element_at("m", F.lit("u")), F.lit("-")).alias("u"))


@query("SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS pending FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) GROUP BY 1")
def pending_targets(t):
    known = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    x = merge.pending_targets(t("lineitem").select("l_suppkey", "l_orderkey"), known, "l_orderkey", "l_suppkey")
    return x.select("l_suppkey", F.array_join(F.col("pending").cast("array<string>"), ",").alias("pending"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'I' WHEN c_custkey % 10 = 1 THEN 'D' ELSE 'U' END AS action, 'batch' AS actor FROM customer WHERE c_custkey % 10 IN (0, 1, 2)")
def audit_diff(t):
    c = t("customer")
    old = c.where("c_custkey % 10 <> 0")
    new = c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return merge.diff_snapshots(old, new, ["c_custkey"], "batch").select("c_custkey", "action", "actor")


@query("SELECT event_id, event_type = 'error' AS is_deleted FROM events WHERE user_id = 8 AND ts > TIMESTAMP '2024-01-10 00:00:00'")
def delta_pull(t):
    e = t("events").where("user_id = 8").withColumn("gone", F.col("event_type") == "error")
    return merge.delta_since(e, "ts", "2024-01-10 00:00:00", "gone").select("event_id", "is_deleted")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0)")
def tombstones(t):
    e = t("events").withColumns({"deleted": F.lit(False), "dirty": F.col("event_id") % 2 == 1})
    gone = merge.soft_delete(e, e.where("event_type = 'error'"), "event_id")
    clean = gone.withColumn("dirty", F.col("event_id") % 2 == 1)  # what was pushed is clean again
    return merge.purge_tombstones(clean).select("event_id")


@query("SELECT event_id, substr(event_type || ':' || props, 1, 12) AS message FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def error_ring(t):
    e = t("events").where("event_type = 'error'").withColumn("message", F.concat_ws(":", "event_type", "props"))
    return merge.newest(e, "ts", "event_id", 50, "message", 12).select("event_id", "message")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def guarded_updates(t):
    c = t("customer")
    changes = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("VIP").alias("new_c_mktsegment"))
    return merge.guarded_updates(c, changes, "c_custkey", F.col("c_acctbal") > 0)[0].select("c_custkey", "c_mktsegment")


# ---- retrieval


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity FROM embeddings, q WHERE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 20""")
def vector_topk(t):
    e = t("embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    sim = F.round(S.cosine(F.col("embedding"), F.col("q")), 6)
    return e.join(q).withColumn("similarity", sim).where("similarity >= 0.2").orderBy(F.col("similarity").desc(), "vec_id").limit(20).select("vec_id", "similarity")


@query("""WITH a AS (SELECT doc_id, 0 AS arm, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE lang = 'fr' QUALIFY pos <= 20), b AS (SELECT doc_id, 1 AS arm, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents QUALIFY pos <= 20)
SELECT doc_id, CAST(arm AS INTEGER) AS arm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY arm, pos) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1 ORDER BY arm, pos, doc_id LIMIT 30""")
def hybrid_merge(t):
    def arm(df):
        top = df.orderBy(F.col("n_chars").desc(), "doc_id").limit(20)
        return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id"))).select("doc_id", "pos")

    d = t("documents")
    return search.hybrid([arm(d.where("lang = 'fr'")), arm(d)], ["doc_id"], "pos", 30).select("doc_id", "arm")


@query("""WITH g AS (SELECT l_partkey, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT l_orderkey, l_linenumber, g.l_partkey, total FROM g JOIN lineitem USING (l_partkey)""")
def group_topk_fanout(t):
    top = search.group_topk(t("lineitem"), "l_partkey", "l_quantity", 20)
    return t("lineitem").join(F.broadcast(top), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "total")


@query(r"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), y AS (SELECT conv_id, turn, role, n, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 600) AS content FROM x WHERE n <= 6), z AS (SELECT * FROM y WHERE content <> '' AND role IN ('user', 'assistant'))
SELECT conv_id, role, content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS INTEGER) AS turn_no FROM z""")
def history_window(t):
    x = t("conversations").withColumnRenamed("text", "content")
    return search.history_window(x, "conv_id", [F.col("turn").desc()]).select("conv_id", "role", "content", "turn_no")


@query(f"SELECT CAST(count(*) AS BIGINT) AS used FROM events WHERE user_id = 8 AND event_type = 'view' AND ts >= date_trunc('day', TIMESTAMP '{NOW}')")
def answers_today(t):
    e = t("events")
    messages = e.select(F.col("event_id").alias("session_id"), F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"), F.col("ts").alias("created_at"))
    sessions = e.select(F.col("event_id").alias("session_id"), F.col("user_id").cast("string").alias("user_id"))
    return search.answers_today(messages, sessions, "8", F.lit(NOW).cast("timestamp_ntz"))


# ---- activity


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM d), r AS (SELECT user_id, g, count(*) AS n, max(day) AS e FROM i GROUP BY 1, 2)
SELECT user_id, CAST(max(CASE WHEN e BETWEEN DATE '2024-01-14' AND DATE '2024-01-15' THEN n ELSE 0 END) AS BIGINT) AS streak FROM r GROUP BY 1""")
def streak_days(t):
    x = t("events").select("user_id", F.col("ts").cast("date").alias("day"))
    return progress.streaks(x, "user_id", "day", F.lit("2024-01-15").cast("date"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST((dayofyear(ts) - 1) % 10 AS BIGINT) AS pick FROM events")
def daily_index(t):
    return t("events").select("event_id", S.iso_day(F.col("ts")).alias("day"), S.day_index(F.col("ts").cast("date"), F.lit(10)).alias("pick"))


@query("""WITH s AS (SELECT user_id, event_id AS segment, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS point, user_id FROM events WHERE event_type = 'click')
SELECT point, coalesce(segment, -1) AS segment FROM p LEFT JOIN s ON s.user_id = p.user_id AND point >= a AND point < b""")
def segment_lookup(t):
    e = t("events")
    s = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("segment"), F.col("event_id").alias("a"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b IS NOT NULL")
    p = e.where("event_type = 'click'").select(F.col("event_id").alias("point"), "user_id")
    return progress.interval_lookup(p, s, "user_id", "point", "a", "b", 256).na.fill(-1, ["segment"]).select("point", "segment")


# ---- grouping and sets


@query(r"SELECT md5(tag) AS tag, CAST(length(tag) AS INTEGER) AS n FROM (SELECT DISTINCT unnest(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS tag FROM documents)")
def tags_distinct(t):
    tags = t("documents").select(F.explode(T.parse_tags("text")).alias("tag")).distinct()
    return tags.select(F.md5("tag").alias("tag"), F.length("tag").alias("n"))


@query(r"SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split(text, ','), lambda x: trim(x)), 'the')")
def tag_filter(t):
    return t("documents").where(F.array_contains(T.parse_tags("text"), "the")).select("doc_id")


@query("""SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars DESC, doc_id) AS hits, string_agg(DISTINCT lang, ' · ' ORDER BY lang) AS langs, min_by(doc_id, (-n_chars, doc_id)) AS first FROM documents WHERE lang <> 'de' GROUP BY 1""")
def hits_grouped(t):
    hits = t("documents").where("lang <> 'de'").withColumns({"_unknown": F.col("n_chars").isNull(), "_down": -F.col("n_chars")})
    best = F.when(F.col("doc_id").isNotNull(), F.struct("_unknown", "_down", "doc_id"))
    about = hits.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), " · ").alias("langs"), F.min_by("doc_id", best).alias("first"))
    ids = search.grouped_hits(hits, ["source"], ["_unknown", "_down", "doc_id"], "doc_id").withColumnRenamed("source", "_source")
    return about.join(ids, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "hits", "langs", "first")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'es' THEN 1 WHEN 'fr' THEN 2 ELSE 9 END, doc_id) AS n FROM documents) WHERE n = 1")
def best_rendering(t):
    rank = F.when(F.col("lang") == "es", 1).when(F.col("lang") == "fr", 2).otherwise(9)
    return order.first_rows(t("documents"), ["source"], [rank, F.col("doc_id")]).select("source", "doc_id", "lang")


@query("""SELECT l_orderkey, n, CAST(min(l_linenumber) AS INTEGER) AS first_line FROM (SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) % 4 + 1)) AS n FROM lineitem) GROUP BY 1, 2""")
def range_expand_first(t):
    x = t("lineitem").withColumn("n", F.explode(F.sequence(F.col("l_linenumber").cast("long"), F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4)))
    return order.first_rows(x, ["l_orderkey", "n"], [F.col("l_linenumber")]).select("l_orderkey", "n", F.col("l_linenumber").alias("first_line"))


_BODIES = r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS body FROM documents"


@query(f"SELECT body, count(*) AS n, min(doc_id) AS first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS refs FROM ({_BODIES}) GROUP BY 1 HAVING count(*) > 1")
def dup_bodies(t):
    bodies = t("documents").select("doc_id", F.md5(T.dedupe_key("text")).alias("body"))
    store.shared_folder(bodies.sparkSession)
    groups, members = order.repeated(bodies.checkpoint(), ["body"], "doc_id")  # texts are read once
    return groups.join(search.grouped_hits(members, ["body"], ["doc_id"], "doc_id", name="refs"), "body", "left")


@query(f"SELECT body, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY body) AS n FROM ({_BODIES})) WHERE n > 1")
def dup_members(t):
    return order.repeated(t("documents").withColumn("body", F.md5(T.dedupe_key("text"))), ["body"], "doc_id")[1]


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n > 1")
def dup_keys(t):
    x = order.occurrence_suffix(t("lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return x.where("occurrence > 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH e AS (SELECT unnest(range(1, 8)) AS n), a AS (SELECT l_linenumber AS n, count(*) AS c FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1)
SELECT CAST(e.n AS INTEGER) AS l_linenumber, CAST(coalesce(c, 0) AS BIGINT) AS found, c IS NULL AS missing FROM e LEFT JOIN a ON a.n = e.n""")
def inventory_completeness(t):
    from textloom.operators.audit import inventory

    expected = t("region").select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l_linenumber")).distinct()
    return inventory(expected, t("lineitem").where("l_linenumber <> 4"), ["l_linenumber"])


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) FILTER (trim(text) = '') AS BIGINT) AS empty, bool_and(text IS NOT NULL) AS all_present FROM documents GROUP BY 1")
def corpus_summary(t):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.count_if(F.trim("text") == "").alias("empty"), F.bool_and(F.col("text").isNotNull()).alias("all_present"))


@query("SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def joined_names(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), " | ").alias("names"))


@query("""WITH n AS (SELECT n_nationkey AS chapter, n_nationkey % 3 + 2 AS n FROM nation)
SELECT 2 AS book, chapter, '2.' || chapter || '.1' AS ref, 1 AS ordinal, 'verse' AS kind, '-' AS speaker, 'राम' AS speaker_surface, 'क ख ग ॥ १ ॥' AS deva, 'ka kha ga || 1 ||' AS iast, -1 AS printed, '-' AS numbering_note FROM n
UNION ALL SELECT 2, chapter, '2.' || chapter || '.' || n, 2, 'verse', '-', 'राम', 'घ ङ ॥ ' || translate(CAST(n AS VARCHAR), '234', '२३४') || ' ॥', 'gha ṅa || ' || n || ' ||', CASE WHEN n = 2 THEN -1 ELSE n END, CASE n WHEN 2 THEN '-' WHEN 3 THEN 'no verse bears 2' ELSE 'no verse bears 2, 3' END FROM n""")
def numbered_split(t):
    from textloom.operators.parse import parse_chapters

    line = F.concat(F.lit("राम उवाच\nक ख ग ॥ १ ॥\nघ ङ ॥ "), T.deva_digits(F.col("n_nationkey") % 3 + 2), F.lit(" ॥\n"))
    x = parse_chapters(t("nation").select(F.lit(2).alias("book"), F.col("n_nationkey").alias("chapter"), line.alias("wikitext")))
    return x.where("error IS NULL").drop("error").na.fill("-", ["speaker", "numbering_note"]).na.fill(-1, ["printed"])


from textloom.plans import files, reader, small  # noqa: E402, F401 - they register their queries
