"""Readers of corpus files, with explicit schemas, and the load into tables.

Nothing is inferred: a schema per file kind, ``recursiveFileLookup`` for trees of chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import fold
from textloom.sources import store

CHAPTER = """_note string, _source struct<url string, title string, retrieved string, license string, license_url string, attribution string, transformation string, pageid bigint, revid bigint, timestamp string, sha1 string, resolved_title string>,
section struct<canto struct<ref string, ordinal int, title_iast string, title_sa string>, chapter struct<ref string, ordinal int, title_iast string, title_sa string, title_en string, title_ml string, summary_en string, summary_ml string, colophon_sa string>>,
verses array<struct<ref string, ordinal int, kind string, meter string, speaker string, deva string, iast string, en string, ml string, notes_en string, word_meanings array<struct<word string, meaning string>>,
mentions array<struct<kind string, slug string, role string, surface_form string>>, xrefs array<struct<to string, kind string, note string>>, metadata map<string, string>>>"""
WORK = """slug string, short_code string, title_iast string, title_sa string, tradition string, original_language string, original_script string, description string,
structure array<struct<level int, key string, label_iast string, label_sa string, label_en string, label_ml string>>, metadata map<string, string>,
sources array<struct<slug string, kind string, title string, authors array<string>, publisher string, year int, url string, archive_url string, isbn string, edition_note string, notes string>>,
rights array<struct<key string, source string, status string, license string, license_url string, rights_holder string, attribution_text string, allows_commercial boolean, allows_derivatives boolean, allows_audio boolean, permission_document_url string, permission_expires_on date>>,
editions array<struct<slug string, kind string, language_code string, script_code string, title string, rights string, source string, derived_from string, is_default boolean, is_machine boolean, sort_order int, description string>>"""
_ENTITY = "slug string, kind string, name_iast string, name_sa string, description string, names map<string, string>"
GRAPH = f"""people array<struct<{_ENTITY}, epithets array<string>, gender string>>, places array<struct<{_ENTITY}, alt_names array<string>, modern_name string, latitude double, longitude double>>,
topics array<struct<{_ENTITY}>>, stories array<struct<slug string, title_iast string, title_sa string, summary string, start string, `end` string, narrator string, place string, names map<string, string>>>,
relations array<struct<`from` array<string>, relation string, `to` array<string>, note string>>"""


def _json(spark: SparkSession, schema: str, path: str, glob: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.json(path).withColumn("file", F.input_file_name())


def read_chapters(spark: SparkSession, path: str, glob: str = "verses.json") -> DataFrame:
    return _json(spark, CHAPTER, path, glob)


def read_works(spark: SparkSession, path: str, glob: str = "work.json") -> DataFrame:
    return _json(spark, WORK, path, glob)


def read_graphs(spark: SparkSession, path: str, glob: str = "graph.json") -> DataFrame:
    """Optional files: none gives an empty table."""
    return _json(spark, GRAPH, path, glob)


def read_wikitext(spark: SparkSession, path: str, name: str = r"(\d+)_(\d+)[^/]*\.wiki$") -> DataFrame:
    """book, chapter, wikitext of whole files whose names hold both numbers."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    part = lambda i: F.nullif(F.regexp_extract("file", name, i), F.lit("")).cast("int")
    return rows.select(part(1).alias("book"), part(2).alias("chapter"), F.col("value").alias("wikitext"))


def read_numbered_markdown(spark: SparkSession, path: str, name: str = r"(\d+)[^/]*\.md$") -> DataFrame:
    from textloom.operators.parse import numbered_lines

    lines = spark.read.text(path).withColumns({"file": F.input_file_name(), "position": F.monotonically_increasing_id()})
    return numbered_lines(lines, F.regexp_extract("file", name, 1).cast("int"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """chapter, verse, texts: map of author to text, from rows (chapter, verse, author, text) in JSON."""
    rows = spark.read.schema("chapter int, verse int, author string, text string").option("multiLine", True).json(path)
    one = rows.groupBy("chapter", "verse", "author").agg(F.min("text").alias("text"))
    return one.groupBy("chapter", "verse").agg(F.map_from_entries(F.collect_list(F.struct("author", "text"))).alias("texts"))


def follow(links: DataFrame) -> DataFrame:
    """links (source, target) to their ends: source, target, ``cycle``. Each round reaches twice as far, so a chain takes
    rounds in the logarithm of its length; what still goes on after them runs in a circle. Of two targets the least counts."""
    store.shared_folder(links.sparkSession)
    state = links.groupBy("source").agg(F.min("target").alias("target")).checkpoint()
    n = state.count()
    for _ in range(n.bit_length() + 1):
        further = state.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        onward = state.join(further, "target", "left")
        state = onward.select("source", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("cycle")).checkpoint()
        if state.where("cycle").isEmpty():
            break
    return state.select("source", "target", "cycle") if n else state.withColumn("cycle", F.lit(False))


def resolve_titles(wanted: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """wanted (title) through normalisation and chains of redirects (both: source, target) to pages (title, ...);
    ``missing`` marks titles without a page, also those whose redirects run in a circle. ``strict``: a missing title is an error."""
    n = normalized.groupBy(F.col("source").alias("title")).agg(F.min("target").alias("_n"))
    r = follow(redirects).where("NOT cycle").select(F.col("source").alias("_s"), F.col("target").alias("_r"))
    x = wanted.join(n, "title", "left").withColumn("_s", F.coalesce("_n", "title")).join(r, "_s", "left")
    x = x.withColumn("resolved", F.coalesce("_r", "_s")).select("title", "resolved")
    p = pages.withColumnRenamed("title", "resolved").withColumn("_p", F.lit(True))
    out = x.join(p, "resolved", "left").withColumn("missing", F.col("_p").isNull()).drop("_p")
    if strict:
        lost = [t.title for t in out.where("missing").select("title").orderBy("title").limit(10).collect()]
        if lost:
            raise LookupError(f"no page for {', '.join(lost)}")
    return out


def discover(files: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """slug of each file path (column path) between prefix and suffix, distinct and sorted."""
    hit = F.col("path").startswith(prefix) & F.col("path").endswith(suffix)
    slug = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path") - len(prefix) - len(suffix))
    return files.where(hit).select(slug.alias("slug")).distinct().orderBy("slug")


# ---- load


def _id(*parts: Column | str) -> Column:
    """Deterministic key of a row from its natural key."""
    return F.md5(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def load_work(works: DataFrame, graphs: DataFrame, chapters: DataFrame, slug_of: Column) -> dict[str, DataFrame]:
    """Files of any number of works to tables; ``slug_of`` names the work of a chapter or graph by its
    columns. ``violations`` lists what breaks the invariants: references outside their chapter, sparse
    ordinals, blank verses, references and mentions that point at nothing; a load should stop on any.
    Cross references to verses that do not exist yet are in ``pending``."""
    from textloom.operators.gates import CLEARED, force_draft
    from textloom.operators.merge import pending_targets

    w = works.select(_id("work", F.col("slug")).alias("id"), "slug", "short_code", "title_iast", "title_sa", "structure", "metadata", "sources", "rights", "editions")
    of = w.select(F.col("id").alias("work_id"), "slug")
    sources = w.select(F.explode("sources").alias("s")).select(_id("source", F.col("s.slug")).alias("id"), "s.*").dropDuplicates(["id"])
    rights = w.select("slug", F.explode("rights").alias("r")).select(_id("rights", F.col("slug"), F.col("r.key")).alias("id"), _id("source", F.col("r.source")).alias("source_id"), "r.*")
    e = w.select(F.col("id").alias("work_id"), F.col("slug").alias("work"), F.explode("editions").alias("e"))
    e = e.select(_id("edition", F.col("e.slug")).alias("id"), "work_id", _id("rights", F.col("work"), F.col("e.rights")).alias("rights_id"), "e.*").withColumn("status", F.lit("published"))
    cleared = rights.select(F.col("id").alias("rights_id"), F.col("status").isin(*CLEARED).alias("_cleared"))
    editions = force_draft(e.join(cleared, "rights_id", "left"), F.col("_cleared")).drop("_cleared")
    c = chapters.withColumn("slug", slug_of).join(of, "slug")
    canto = c.where("section.canto IS NOT NULL").select("work_id", F.col("section.canto.ref").alias("ref"), F.col("section.canto.ordinal").alias("ordinal"), F.lit(None).cast("string").alias("parent_ref"), F.col("section.canto.title_iast").alias("title_iast"), F.lit(1).alias("level")).dropDuplicates(["work_id", "ref"])
    leaf = c.select("work_id", F.col("section.chapter.ref").alias("ref"), F.col("section.chapter.ordinal").alias("ordinal"), F.col("section.canto.ref").alias("parent_ref"), F.col("section.chapter.title_iast").alias("title_iast"), F.when(F.col("section.canto").isNull(), 1).otherwise(2).alias("level"))
    sections = canto.unionByName(leaf).select(_id("section", F.col("work_id"), F.col("ref")).alias("id"), "work_id", F.when(F.col("parent_ref").isNotNull(), _id("section", F.col("work_id"), F.col("parent_ref"))).alias("parent_id"), "ref", "ordinal", "level", "title_iast")
    v = c.select("work_id", F.col("section.chapter.ref").alias("chapter_ref"), F.explode("verses").alias("v")).select("work_id", "chapter_ref", "v.*")
    v = v.withColumns({"id": _id("verse", F.col("work_id"), F.col("ref")), "section_id": _id("section", F.col("work_id"), F.col("chapter_ref")), "kind": F.when(F.col("kind").isin("verse", "invocation", "prose", "colophon"), F.col("kind")).otherwise("verse")})
    verses = v.select("id", "work_id", "section_id", "ref", "ordinal", "kind", "meter", "speaker", "metadata", F.lit("published").alias("status"))
    kinds = [("original", "deva"), ("transliteration", "iast"), ("translation", "en"), ("translation", "ml")]
    bodies = v.select("id", "work_id", "word_meanings", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("language"), F.col(f).alias("body")) for k, f in kinds])).alias("b")).where("b.body IS NOT NULL AND trim(b.body) <> ''")
    contents = bodies.select(_id("content", F.col("id"), F.col("b.language")).alias("id"), F.col("id").alias("verse_id"), F.col("b.kind").alias("kind"), F.col("b.language").alias("language"), F.col("b.body").alias("body"), fold("b.body").alias("folded"))
    entities = load_graph(graphs)["entities"]
    mentions = v.select(F.col("id").alias("verse_id"), F.explode("mentions").alias("m")).select("verse_id", "m.*")
    xrefs = v.select("work_id", F.col("id").alias("from_verse_id"), "ref", F.explode("xrefs").alias("x")).select("work_id", "from_verse_id", "ref", F.col("x.to").alias("to"), F.coalesce("x.kind", F.lit("related")).alias("kind"))
    known = verses.select("work_id", F.col("ref").alias("to"), F.col("id").alias("to_verse_id"))
    resolved = xrefs.join(known, ["work_id", "to"]).where("from_verse_id <> to_verse_id").select("from_verse_id", "to_verse_id", "kind").distinct()
    pending = pending_targets(xrefs, known, "to", "from_verse_id")
    dense = F.row_number().over(Window.partitionBy("work_id", "chapter_ref").orderBy("ordinal", "ref"))
    checks = v.withColumn("expected", dense)
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("ref").alias("subject"))
    violations = (
        rule(checks.where(~F.startswith(F.col("ref"), F.concat("chapter_ref", F.lit(".")))), "reference outside its chapter")
        .unionByName(rule(checks.where("ordinal <> expected"), "ordinals are not dense"))
        .unionByName(rule(v.where("coalesce(trim(deva), '') = '' OR coalesce(trim(iast), '') = ''"), "blank verse"))
        .unionByName(mentions.join(entities.select("kind", "slug"), ["kind", "slug"], "left_anti").select(F.lit("mention of nothing").alias("rule"), F.col("slug").alias("subject")))
    )
    return {"works": w.drop("sources", "rights", "editions"), "sources": sources, "rights": rights, "editions": editions, "sections": sections, "verses": verses, "verse_contents": contents, "mentions": mentions, "cross_references": resolved, "pending": pending, "violations": violations, **load_graph(graphs)}


def load_graph(graphs: DataFrame) -> dict[str, DataFrame]:
    """Entities of four kinds by one shape, their names by language, and relations."""
    parts = []
    for kind, column, name, other in (("person", "people", "name_iast", "epithets"), ("place", "places", "name_iast", "alt_names"), ("topic", "topics", "name_iast", None), ("story", "stories", "title_iast", None)):
        x = graphs.select(F.explode(column).alias("e"))
        more = F.col(f"e.{other}") if other else F.array().cast("array<string>")
        parts.append(x.select(F.lit(kind).alias("kind"), F.col("e.slug").alias("slug"), F.col(f"e.{name}").alias("name"), more.alias("other_names"), F.col("e.names").alias("names")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).dropDuplicates(["kind", "slug"])
    every = every.withColumn("id", _id(F.col("kind"), F.col("slug")))
    names = every.select("kind", "id", F.explode("names").alias("language_code", "name")).withColumn("folded", fold("name"))
    r = graphs.select(F.explode("relations").alias("r"))
    relations = r.select(F.col("r.from")[0].alias("from_kind"), F.col("r.from")[1].alias("from_slug"), "r.relation", F.col("r.to")[0].alias("to_kind"), F.col("r.to")[1].alias("to_slug"), "r.note").distinct()
    return {"entities": every.drop("names"), "entity_names": names, "entity_relations": relations}
