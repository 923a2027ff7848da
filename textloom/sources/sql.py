"""The library in SQL: gated views, and table functions over them for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import documents as D
from textloom.operators.library import KINDS, READABLE, Visible, editions_view

#: What ``retrieve_for_qa`` and ``search_verses`` share: the parts of a query, and its hits in the visible contents.
_HITS = """query AS (SELECT trim({q}) AS q_raw, text_fold(trim({q})) AS q_folded, text_terms({q}) AS q_terms),
linked AS (SELECT DISTINCT m.verse_id FROM {p}mentions m JOIN {p}names n ON n.kind = m.kind AND n.id = m.id, query WHERE length(q_folded) >= 3 AND (contains(n.folded, q_folded) OR (n.local AND contains(n.name, q_raw)))),
counted AS (SELECT c.id, c.verse_id, v.ref, w.slug, c.edition_id, e.title, e.language_code, e.script_code, e.kind, c.body, w.id AS work_id, q_raw <> '' AND contains(c.folded, q_folded) AS inside, q_raw <> '' AND v.ref = q_raw AS named, q_raw <> '' AND l.verse_id IS NOT NULL AS linked,
  size(filter(text_tokens(c.folded), t -> exists(q_terms, w -> startswith(t, w)))) * 0.1D AS density
  FROM {p}contents c JOIN {p}verses v ON v.id = c.verse_id JOIN {p}works w ON w.id = v.work_id JOIN {p}editions e ON e.id = c.edition_id LEFT JOIN linked l ON l.verse_id = c.verse_id CROSS JOIN query),
hits AS (SELECT *, CAST(greatest(density / (density + 1), if(inside, 0.9D, 0D), if(named, 1D, 0D), if(linked, 0.6D, 0D)) AS FLOAT) AS rank FROM counted WHERE density > 0 OR inside OR named OR (linked AND kind IN ({readable})))"""
_ORDER = "rank DESC, text_ref_parts(ref), array_position(array({kinds}), kind), verse_id, edition_id, id"


def _list(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def names_of(lib: Visible) -> DataFrame:
    """kind, id, name, folded, local: every name by which a search finds an entity."""
    own = lib.entities.select("kind", "id", F.explode(F.concat(F.array("name"), F.coalesce("more", F.array().cast("array<string>")))).alias("name")).withColumn("local", F.lit(False))
    return own.unionByName(lib.entity_names.select("kind", "id", "name", F.lit(True).alias("local"))).withColumn("folded", T.fold("name"))


def register(spark: SparkSession, lib: Visible, prefix: str = "") -> None:
    """Temporary views ``prefix + table`` of all tables that a caller may see, and over them the table functions
    ``search_verses(q, work, language, most)``, ``retrieve_for_qa(q, work, language, most)`` and ``get_toc(work)``, equal to the DataFrame
    forms. The views are gated, so the functions are."""
    if not isinstance(lib, Visible):
        raise TypeError("register takes library.visible_to(context)")
    T.register_sql(spark)
    for name in ("works", "sections", "verses", "editions", "rights", "languages", "scripts", "sources", "entities", "entity_names", "mentions", "xrefs", "tracks", "segments"):
        getattr(lib, name).createOrReplaceTempView(f"{prefix}{name}")
    contents = lib.contents if "folded" in lib.contents.columns else lib.contents.withColumn("folded", T.fold("body"))
    contents.createOrReplaceTempView(f"{prefix}contents")
    names_of(lib).createOrReplaceTempView(f"{prefix}names")
    editions_view(lib).createOrReplaceTempView(f"{prefix}v_editions")
    leaves = lib.verses.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    D.section_labels(lib.sections, leaves).createOrReplaceTempView(f"{prefix}labels")
    hits = _HITS.format(q="q", p=prefix, readable=_list(READABLE))
    order = _ORDER.format(kinds=_list(KINDS))
    kind = lambda table, column: lib.__getattribute__(table).schema[column].dataType.simpleString()
    ids = f"verse_id {kind('verses', 'id')}, ref STRING, work_slug STRING, edition_id {kind('editions', 'id')}, edition_title STRING, language_code STRING"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_verses(q STRING, work STRING DEFAULT NULL, language STRING DEFAULT NULL, most INT DEFAULT 20)
RETURNS TABLE ({ids}, script_code STRING, kind STRING, rank FLOAT) RETURN
WITH {hits}, placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM hits WHERE (search_verses.work IS NULL OR slug = search_verses.work) AND (search_verses.language IS NULL OR language_code = search_verses.language))
SELECT verse_id, ref, slug, edition_id, title, language_code, script_code, kind, rank FROM placed WHERE n <= greatest(1, least(most, 100))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION retrieve_for_qa(q STRING, work STRING DEFAULT NULL, language STRING DEFAULT 'en', most INT DEFAULT 8)
RETURNS TABLE ({ids}, body STRING, attribution_text STRING, rank FLOAT) RETURN
WITH {hits}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM hits WHERE (retrieve_for_qa.work IS NULL OR slug = retrieve_for_qa.work)
  AND ((kind = 'translation' AND language_code = retrieve_for_qa.language) OR (kind = 'transliteration' AND script_code = 'Latn') OR kind = 'word_meanings')) WHERE n <= 60),
best AS (SELECT verse_id, ref, slug, CAST(sum(CAST(rank AS DOUBLE)) AS FLOAT) AS rank FROM pool GROUP BY verse_id, ref, slug),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rank DESC, text_ref_parts(ref), verse_id) AS n FROM best) WHERE n <= greatest(1, least(most, 20)))
SELECT b.verse_id, b.ref, b.slug, c.edition_id, e.title, e.language_code, c.body, e.attribution_text, b.rank FROM chosen b JOIN {prefix}contents c ON c.verse_id = b.verse_id JOIN {prefix}v_editions e ON e.id = c.edition_id
WHERE (e.kind = 'translation' AND e.language_code = retrieve_for_qa.language) OR (e.kind = 'transliteration' AND e.script_code = 'Latn')""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_toc(work STRING)
RETURNS TABLE (work_slug STRING, section_id {kind('sections', 'id')}, ref STRING, low BIGINT, high BIGINT, depth INT, total BIGINT) RETURN
SELECT w.slug, l.id, l.ref, l.low, l.high, l.depth, l.total FROM {prefix}labels l JOIN {prefix}works w ON w.id = l.work_id WHERE w.slug = get_toc.work""")
