"""Composed queries over one library of works: what a reader's client asks for in one call.

All of them take the ``Visible`` part of a ``Library``: ``library.visible_to(context)`` puts each table behind its
row-level policy, before any join, count or limit, and nothing else makes one. A parameter of None filters
nothing. Works, editions and sections are looked up by equi-joins, so that a work filter reaches the
scans of all tables, and every limited result has a total order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from textloom.functions import text as T
from textloom.functions.scalars import enum_position
from textloom.operators import documents as D
from textloom.operators import search as S
from textloom.operators.gates import SecurityContext
from textloom.operators.index import TextIndex, text_hits
from textloom.operators.vectors import VectorIndex, nearest

#: Kinds of editions in the order of their declaration.
KINDS = ["base_text", "transliteration", "translation", "word_meanings", "commentary", "summary", "audio"]
#: Kinds whose contents count as hits because of a linked entity.
READABLE = ("translation", "base_text", "transliteration")
#: Hits that a question may draw from before they are summed by verse.
POOL = 60


@dataclass(frozen=True)
class Library:
    """works (id, slug, status, sort_order), sections (id, work_id, parent_id, ref, ordinal, status), verses (id, work_id,
    section_id, ref, ordinal, kind, speaker_id, status), editions (id, work_id, kind, language_code, script_code, title,
    status, sort_order, rights_id, source_id), contents (id, verse_id, edition_id, body, status), rights (id, status,
    permission_expires_on, license, attribution_text), names of languages and scripts (code, name), sources (id, title,
    url), entities (kind, id, slug, name, more: array of other names, status; work_id for stories), entity_names (kind, id,
    name, language_code), mentions (verse_id, kind, id, role, status), xrefs (from_verse_id, to_verse_id, kind, status),
    tracks (id, section_id, edition_id, status), segments (verse_id, track_id, start_ms, end_ms), embeddings (content_id,
    embedding). ``index`` is that of contents.body by their ids; searches scan the texts where it is None."""

    works: DataFrame
    sections: DataFrame
    verses: DataFrame
    editions: DataFrame
    contents: DataFrame
    rights: DataFrame
    languages: DataFrame
    scripts: DataFrame
    sources: DataFrame
    entities: DataFrame
    entity_names: DataFrame
    mentions: DataFrame
    xrefs: DataFrame
    tracks: DataFrame
    segments: DataFrame
    embeddings: DataFrame
    index: TextIndex | None = None
    vectors: VectorIndex | None = None

    def visible_to(self, ctx: SecurityContext) -> Visible:
        """The rows of each table that its policy shows to a caller: published works, their published sections and verses,
        editions with cleared rights and their published contents and tracks, published entities and links; more
        for contributors and editors. A table without the columns that its policy asks for is an error."""
        public = ctx.public_editions(self.editions, self.works, self.rights)
        return Visible(
            works=ctx.works(self.works),
            sections=ctx.units(self.sections, self.works),
            verses=ctx.units(self.verses, self.works),
            editions=ctx.editions(self.editions, public),
            contents=ctx.contents(self.contents, public),
            rights=ctx.columns(self.rights),
            languages=self.languages,
            scripts=self.scripts,
            sources=self.sources,
            entities=ctx.graph(self.entities),
            entity_names=self.entity_names,
            mentions=ctx.graph(self.mentions),
            xrefs=ctx.graph(self.xrefs),
            tracks=ctx.tracks(self.tracks, public),
            segments=ctx.audio_segments(self.segments, self.tracks, public),
            embeddings=ctx.embeddings(self.embeddings),
            index=self.index,
            vectors=self.vectors,
            ctx=ctx,
            stored=self,
        )


@dataclass(frozen=True)
class Visible(Library):
    """What one caller may read of the library ``stored``. The indexes hold all contents: what they find counts only
    joined with the visible ones."""

    ctx: SecurityContext = field(kw_only=True)
    stored: Library = field(kw_only=True)


def gated(query: Callable) -> Callable:
    """A composed query: it refuses a library that is behind no policy."""

    @functools.wraps(query)
    def run(lib: Visible, *args, **named):
        if not isinstance(lib, Visible):
            raise TypeError(f"{query.__name__} takes library.visible_to(context)")
        return query(lib, *args, **named)

    return run


def optional(col: Column, value: object) -> Column:
    """``value is null or col = value``."""
    return F.lit(True) if value is None else col == F.lit(value)


def any_of(col: Column, values: Sequence | None) -> Column:
    """Membership; None filters nothing, an empty list allows nothing."""
    return F.lit(True) if values is None else col.isin(list(values)) if values else F.lit(False)


def editions_view(lib: Library) -> DataFrame:
    """Editions with the names of their language and script, their rights and their source, if any."""
    e = lib.editions.join(lib.languages.select(F.col("code").alias("language_code"), F.col("name").alias("language_name")), "language_code")
    e = e.join(lib.scripts.select(F.col("code").alias("script_code"), F.col("name").alias("script_name")), "script_code")
    e = e.join(lib.rights.select(F.col("id").alias("rights_id"), F.col("status").alias("rights_status"), "permission_expires_on", "license", "attribution_text"), "rights_id")
    return e.join(lib.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.col("url").alias("source_url")), "source_id", "left")


def cleared_editions(view: DataFrame, cleared: Sequence[str], today: Column) -> DataFrame:
    """A client's second gate: rows of the view whose rights are not cleared go, whatever the server sent."""
    from textloom.operators.gates import rights_cleared

    return view.where(F.coalesce(rights_cleared(F.col("rights_status"), F.col("permission_expires_on"), today, tuple(cleared)), F.lit(False)))


def entity_hits(lib: Visible, query: str, least: int = 3) -> DataFrame:
    """verse_id of verses that mention an entity one of whose names holds the folded query, or a localised name
    the raw one. Queries of fewer than ``least`` folded characters hit none."""
    raw = query.strip()
    folded = T.fold(F.lit(raw))
    own = lib.entities.select("kind", "id", F.explode(F.concat(F.array("name"), F.coalesce("more", F.array().cast("array<string>")))).alias("name")).where(T.fold("name").contains(folded))
    local = lib.entity_names.where(T.fold("name").contains(folded) | F.col("name").contains(raw))
    hit = own.select("kind", "id").unionByName(local.select("kind", "id")).where(F.length(folded) >= least)
    return lib.mentions.join(hit, ["kind", "id"], "left_semi").select("verse_id").distinct()


@gated
def search_entities(lib: Visible, query: str, limit: int = 20) -> DataFrame:
    """kind, id, slug, name, matched, language_code: entities one of whose names holds the folded query, told by their own name, and
    those by a localised name that holds the folded or the raw query, told by that name in its language. Distinct, under a
    total order; an empty query finds nothing."""
    raw, folded = query.strip(), T.folded(query)
    e = lib.entities.select("kind", "id", "slug", "name", "more")
    other = F.exists(F.coalesce("more", F.array().cast("array<string>")), lambda x: T.fold(x).contains(folded))
    own = e.where(T.fold("name").contains(folded) | other).select("kind", "id", "slug", "name", F.col("name").alias("matched"), F.lit("sa").alias("language_code"))
    local = lib.entity_names.where(T.fold("name").contains(folded) | F.col("name").contains(raw)).select("kind", "id", F.col("name").alias("matched"), "language_code")
    local = local.join(e.drop("more"), ["kind", "id"], "left").select(*own.columns)
    found = own.unionByName(local).distinct().where(F.lit(bool(raw)))
    return found.orderBy("kind", "slug", "id", "matched", "language_code").limit(max(1, min(limit, 100)))


def _ranked(lib: Visible, query: str, work: str | None, language: str | None, editions: DataFrame) -> DataFrame:
    """All hits of a query in ``editions`` (edition_id, ...), with their rank; bodies are fetched when the best are known."""
    raw = query.strip()
    works = lib.works.where(optional(F.col("slug"), work)).select(F.col("id").alias("work_id"), F.col("slug").alias("work_slug"))
    verses = lib.verses.select(F.col("id").alias("verse_id"), "work_id", "ref").join(works, "work_id").drop("work_id")
    chosen = editions.where(optional(F.col("language_code"), language))
    linked = entity_hits(lib, query).withColumn("linked", F.lit(True))
    rows = lib.contents.join(chosen, "edition_id").join(verses, "verse_id").join(linked, "verse_id", "left")
    rows = rows.withColumn("linked", F.coalesce("linked", F.lit(False)))
    by_ref = F.col("ref") == raw
    other = by_ref | (F.col("linked") & F.col("kind").isin(*READABLE))
    if not raw:
        rows = rows.withColumn("rank", F.lit(0.0)).where(F.lit(False))
    elif lib.index is not None:
        rows = rows.join(text_hits(lib.index, query).withColumnRenamed("rank", "text_rank"), "id", "left").where(F.col("text_rank").isNotNull() | other)
        rows = rows.withColumn("rank", F.greatest(F.coalesce("text_rank", F.lit(0.0)), F.when(by_ref, 1.0).otherwise(0.0), F.when(F.col("linked"), 0.6).otherwise(0.0)))
    else:
        rows = S.indexed(rows, "body")
        by_text = (T.matches(F.col("folded"), T.terms(raw)) > 0) | F.col("folded").contains(T.fold(F.lit(raw)))
        rows = rows.where(by_text | other).withColumn("rank", S.score(raw, by_ref, F.col("linked")))
    return rows.withColumn("rank", F.col("rank").cast("float")).select("id", "verse_id", "edition_id", "ref", "work_slug", *[c for c in editions.columns if c != "edition_id"], "rank")


def _edition_columns(editions: DataFrame) -> DataFrame:
    return editions.select(F.col("id").alias("edition_id"), F.col("title").alias("edition_title"), "language_code", "script_code", "kind", "sort_order")


def _in_order(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    rows = rows.withColumns({"_ref": T.ref_parts("ref"), "_kind": enum_position(F.col("kind"), KINDS)})
    rows = rows.orderBy(F.col("rank").desc(), "_ref", "_kind", "verse_id", "edition_id", "id")
    return rows.offset(max(0, offset)).limit(limit).drop("_ref", "_kind")


@gated
def search_verses(lib: Visible, query: str, work: str | None = None, language: str | None = None, editions: Sequence | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Ranked hits with a snippet: by terms, substring, reference, or an entity that the verse mentions."""
    some = _edition_columns(lib.editions.where(any_of(F.col("id"), editions)))
    hits = _in_order(_ranked(lib, query, work, language, some), max(1, min(limit, 100)), offset)
    hits = hits.join(lib.contents.select("id", "body"), "id")  # the best are at most 100 rows
    words = T.terms(query)
    snippet = T.headline("body", words) if words else F.left("body", F.lit(160))
    return _in_order(hits, 100).select("verse_id", "ref", "work_slug", "edition_id", "edition_title", "language_code", "script_code", "kind", snippet.alias("snippet"), "rank")


@gated
def retrieve_for_qa(lib: Visible, query: str, work: str | None = None, language: str = "en", limit: int = 8) -> DataFrame:
    """The passages that a question is answered from: hits in translations of the language, Latin
    transliterations and word meanings, the best POOL of them summed by verse, the best verses with their readable renderings."""
    latin = (F.col("kind") == "transliteration") & (F.col("script_code") == "Latn")
    told = (F.col("kind") == "translation") & (F.col("language_code") == language)
    some = _edition_columns(lib.editions.where(told | latin | (F.col("kind") == "word_meanings")))
    hits = _in_order(_ranked(lib, query, work, None, some), POOL)
    best = hits.groupBy("verse_id", "ref", "work_slug").agg(F.sum(F.col("rank").cast("double")).cast("float").alias("rank"))
    best = best.withColumn("_ref", T.ref_parts("ref")).orderBy(F.col("rank").desc(), "_ref", "verse_id").limit(max(1, min(limit, 20)))
    view = editions_view(lib).where(told | latin).select(F.col("id").alias("edition_id"), F.col("title").alias("edition_title"), "language_code", "sort_order", "attribution_text")
    rows = best.join(lib.contents.select("id", "verse_id", "edition_id", "body"), "verse_id").join(view, "edition_id")
    rows = rows.orderBy(F.col("rank").desc(), "_ref", "sort_order", "edition_id", "id")
    return rows.select("verse_id", "ref", "work_slug", "edition_id", "edition_title", "language_code", "body", "attribution_text", "rank")


@gated
def match_contents(lib: Visible, vector: list[float], language: str = "en", work: str | None = None, limit: int = 8, least: float = 0.2, probes: int | str | None = None) -> DataFrame:
    """The contents nearest to a vector. Embeddings themselves are not for readers, but the gate of what any
    reader may see is applied to the ids before the nearest are taken, for editors too; translations count in one language only.
    By the index ``lib.vectors``, if there is one: exactly unless ``probes`` are given."""
    stored = lib.stored
    works = stored.works.where(optional(F.col("slug"), work)).select(F.col("id").alias("work_id"), F.col("slug").alias("work_slug"))
    public = lib.ctx.public_editions(stored.editions, stored.works, stored.rights)
    told = (F.col("language_code") == language) | (F.col("kind") != "translation")
    some = stored.editions.where(told).select(F.col("id").alias("edition_id")).join(public, "edition_id", "left_semi")
    verses = stored.verses.select(F.col("id").alias("verse_id"), "work_id", "ref").join(works, "work_id").drop("work_id")
    allowed = stored.contents.where("status = 'published'").select(F.col("id").alias("content_id"), "verse_id", "edition_id").join(some, "edition_id", "left_semi")
    allowed = allowed.join(verses.select("verse_id"), "verse_id", "left_semi")
    if lib.vectors is not None:
        near = nearest(lib.vectors, vector, limit, least, probes, allowed.select(F.col("content_id").alias("id"))).withColumnRenamed("id", "content_id")
    else:
        near = S.cosine_topk(stored.embeddings.join(allowed.select("content_id"), "content_id", "left_semi"), vector, limit, least, "content_id")
    near = near.select("content_id", F.col("similarity").alias("rank"))  # at most 50 rows; bodies and names are theirs alone
    rows = near.join(stored.contents.select(F.col("id").alias("content_id"), "verse_id", "edition_id", "body"), "content_id").join(verses, "verse_id")
    view = editions_view(stored).select(F.col("id").alias("edition_id"), F.col("title").alias("edition_title"), "language_code", "attribution_text")
    rows = rows.join(view, "edition_id").orderBy(F.col("rank").desc(), "content_id")
    return rows.select("content_id", "verse_id", "ref", "work_slug", "edition_id", "edition_title", "language_code", "body", "attribution_text", "rank")


@gated
def section_payload(lib: Visible, sections: Sequence | None = None, editions: Sequence | None = None) -> DataFrame:
    """section_id, section, editions, verses, tracks of each section that holds verses: verses in order with speaker,
    renderings by edition order, and audio."""
    chosen = editions_view(lib).where(any_of(F.col("id"), editions)).withColumnRenamed("id", "edition_id")
    verses = lib.verses.where(any_of(F.col("section_id"), sections)).withColumnRenamed("id", "verse_id")
    r = lib.contents.drop("kind").join(chosen.select("edition_id", "sort_order", "kind", "language_code", "script_code"), "edition_id")
    extra = [c for c in ("body_html", "word_meanings", "footnotes", "notes") if c in lib.contents.columns]
    r = D.nested(r, ["verse_id"], ["sort_order", "edition_id", "id"], ["edition_id", "id", "kind", "language_code", "script_code", "body", *extra], "renderings")
    a = D.nested(lib.segments, ["verse_id"], ["track_id", "start_ms"], ["track_id", "start_ms", "end_ms"], "audio")
    people = lib.entities.where("kind = 'person'").select(F.col("id").alias("speaker_id"), F.struct("id", "slug", "name").alias("speaker"))
    v = verses.join(people, "speaker_id", "left")
    v = D.with_children(D.with_children(v, r, ["verse_id"], "renderings"), a, ["verse_id"], "audio")
    v = D.nested(v, ["section_id"], ["ordinal", "verse_id"], ["verse_id", "ref", "ordinal", "kind", "speaker_id", "speaker", "renderings", "audio"], "verses")
    t = D.nested(lib.tracks, ["section_id"], ["id"], [c for c in lib.tracks.columns if c != "section_id"], "tracks")
    e = D.nested(chosen, ["work_id"], ["sort_order", "edition_id"], [c for c in chosen.columns if c != "work_id"], "editions")
    s = lib.sections.where(any_of(F.col("id"), sections)).select(F.col("id").alias("section_id"), "work_id", F.struct(*lib.sections.columns).alias("section"))
    s = D.with_children(s.join(v, "section_id"), t, ["section_id"], "tracks")
    return D.with_children(s, e, ["work_id"], "editions").select("section_id", "work_id", "section", "editions", "verses", "tracks")


def _fields(df: DataFrame, *without: str) -> Column:
    return D.as_json(*[c for c in df.columns if c not in ("work_id", "slug_", *without)])


@gated
def work_bundle(lib: Visible, work: str | None = None, now: Column | None = None) -> DataFrame:
    """slug, part, key, position, value (JSON): everything public of each work for offline use, a row a member.

    Parts of a work: meta (with ``generated_at``), toc, edition, section (its payload), story, mention, cross_reference; parts that
    all works share have no slug and are there once: person, place, topic, entity_name. Members stay rows, so no work and no
    graph is ever one group; ``position`` orders sections and editions.
    """
    w = lib.works.where(optional(F.col("slug"), work)).withColumnRenamed("id", "work_id")
    named = w.select("work_id", F.col("slug").alias("slug_"))
    mine = lambda rows: rows.join(named, "work_id")
    verses = lib.verses.select(F.col("id").alias("verse_id"), "work_id")
    none = F.lit(None).cast("array<int>")

    def part(rows: DataFrame, name: Column | str, key: Column, value: Column, position: Column = none) -> DataFrame:
        slug = F.col("slug_") if "slug_" in rows.columns else F.lit(None).cast("string")
        name = F.lit(name) if isinstance(name, str) else name
        return rows.select(slug.alias("slug"), name.alias("part"), key.cast("string").alias("key"), position.alias("position"), value.alias("value"))

    kind, empty = F.col("kind"), F.lit("")
    payload = section_payload(lib).join(named, "work_id")
    view = mine(editions_view(lib))
    stories = lib.entities.where(kind == "story")
    stories = mine(stories) if "work_id" in stories.columns else stories.withColumn("slug_", F.lit(None).cast("string")).where(F.lit(False))
    m = mine(lib.mentions.join(verses, "verse_id"))
    x = mine(lib.xrefs.join(verses, F.col("from_verse_id") == F.col("verse_id")).drop("verse_id"))
    toc = mine(D.toc(lib.sections.join(w, "work_id", "left_semi"), lib.verses))
    meta = F.struct(F.col("slug_").alias("slug"), "status", "sort_order", F.date_format(F.lit(now) if now is not None else F.now(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))
    rows = [
        part(w.withColumnRenamed("slug", "slug_"), "meta", empty, F.to_json(meta, {"ignoreNullFields": "false"})),
        part(toc, "toc", empty, F.col("contents")),
        part(view, "edition", F.col("id"), _fields(view), F.array(F.col("sort_order").cast("int"))),
        part(payload, "section", F.col("section.ref"), D.as_json("section", "verses", "tracks"), T.ref_parts("section.ref")),
        part(lib.entities.where(kind != "story"), kind, F.col("id"), _fields(lib.entities, "kind", "status")),
        part(stories, "story", F.col("id"), _fields(stories, "kind", "status")),
        part(lib.entity_names, "entity_name", F.concat_ws(":", kind, "id", "language_code"), _fields(lib.entity_names)),
        part(m, "mention", F.concat_ws(":", "verse_id", kind, "id"), _fields(m, "status")),
        part(x, "cross_reference", F.concat_ws(":", "from_verse_id", "to_verse_id", kind), _fields(x, "status")),
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def bundle_keys(parts: DataFrame, verse: DataType) -> DataFrame:
    """Members of bundles as rows (key, value) of a key-value store: ``part:slug:key``, one more for each verse of a section, and
    the list of slugs. ``verse`` is the type of a verse, as ``verse_type`` tells it."""
    key = lambda *c: F.concat_ws(":", *[F.when(x != "", x) for x in c])
    rows = parts.select(key(F.col("part"), F.col("slug"), F.col("key")).alias("key"), "value")
    verses = F.from_json("value", StructType([StructField("verses", ArrayType(verse))]))["verses"]
    v = parts.where("part = 'section'").select("slug", F.explode(verses).alias("v"))
    v = v.select(F.concat_ws(":", F.lit("verse"), "slug", "v.ref").alias("key"), F.to_json("v", {"ignoreNullFields": "false"}).alias("value"))
    slugs = parts.where("part = 'meta'").agg(F.to_json(F.array_sort(F.collect_list("slug"))).alias("value")).select(F.lit("slugs").alias("key"), "value")
    return rows.unionByName(v).unionByName(slugs)


def verse_type(lib: Visible) -> DataType:
    """The type of the verses that ``section_payload`` returns, for readers of its JSON."""
    return section_payload(lib).schema["verses"].dataType.elementType


@dataclass(frozen=True)
class Answer:
    """``error`` names why there is none. ``log`` holds the rows to append to messages (session_id, role, content, grounded),
    for signed-in callers; ``title`` is that of the session to open, if there was none."""

    answer: str = ""
    citations: tuple[dict, ...] = ()
    grounded: bool = False
    error: str | None = None
    title: str | None = None
    log: tuple[tuple, ...] = ()


def ask(
    lib: Library,
    ctx: SecurityContext,
    question: str | None,
    complete: Callable[[list[dict]], str],
    vector: list[float] | None = None,
    messages: DataFrame | None = None,
    sessions: DataFrame | None = None,
    session: str | None = None,
    work: str | None = None,
    language: str = "en",
    cap: int = 0,
    now: str | None = None,
    code: str = "SB",
    most: int = 12,
) -> Answer:
    """A grounded answer: the question is clamped, the caller's cap checked, passages found by words and by ``vector``
    (the first arm that holds a rendering of a verse wins), the caller's own history added, the injected model
    asked, and what it cites outside the passages cut out. Passages are those that the caller may read.

    messages (session_id, role, content, created_at), sessions (session_id, user_id). At most ``most`` passages and six
    turns come to the driver.
    """
    spark = lib.works.sparkSession
    seen = lib.visible_to(ctx)
    text = spark.range(1).select(T.clamp_question(F.lit(question)).alias("q")).first().q
    if len(text) < 3:
        return Answer(error="question")
    signed_in = ctx.uid is not None and messages is not None and sessions is not None
    if signed_in and cap > 0 and S.answers_today(messages, sessions, ctx.uid, F.lit(now).cast("timestamp") if now else F.now()).first().used >= cap:
        return Answer(error="cap")
    keys = ["verse_id", "edition_id"]
    columns = [*keys, "ref", "work_slug", "edition_title", "language_code", "body"]
    arms = [retrieve_for_qa(seen, text, work, language)]
    if vector is not None:
        arms.append(match_contents(seen, vector, language, work))
    ranked = [a.withColumns({"_down": -F.col("rank"), "_ref": T.ref_parts("ref")}) for a in arms]
    placed = [a.select(*columns, F.struct("_down", "_ref", *keys).alias("position")) for a in ranked]
    passages = S.hybrid(placed, keys, "position", most).collect()
    if not passages:
        return Answer()
    turns: list[dict] = []
    if signed_in and session is not None:
        mine = ctx.own_children(messages.where(F.col("session_id") == session), sessions, "session_id")
        turns = [{"role": r.role, "content": r.content} for r in S.history_window(mine, "session_id", [F.col("created_at").desc()]).orderBy("turn_no").collect()]
    context = "\n\n".join(f"[{i}] {code} {p.ref} ({p.edition_title}, {p.language_code})\n{p.body}" for i, p in enumerate(passages, 1))
    rule = f"Answer only from the passages, in {language}; cite each claim as [{code} reference]."
    raw = complete([{"role": "system", "content": rule}, *turns, {"role": "user", "content": f"Passages:\n\n{context}\n\nQuestion: {text}"}])
    allowed = F.array(*[F.lit(r) for r in dict.fromkeys(p.ref for p in passages)])
    g = spark.range(1).select(T.ground(F.lit(raw), allowed, code).alias("g")).select("g.*").first()
    first = {p.ref: p for p in reversed(passages)}
    cited = tuple({"ref": r, "verse_id": first[r].verse_id, "work_slug": first[r].work_slug, "edition_id": first[r].edition_id, "quote": first[r].body[:200]} for r in g.refs)
    log = ((session, "user", text, None), (session, "assistant", g.text, bool(g.refs))) if signed_in else ()
    return Answer(g.text, cited, bool(g.refs), None, text[:80] if signed_in and session is None else None, log)
