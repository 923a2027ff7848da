import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import audit, documents, gates, merge, order, progress, search
from textloom.sources import corpus, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = merge.upsert_latest(old, new, ["k"], [F.col("v").desc()])
    assert rows(once) == [(1, "a"), (2, "c"), (3, "e")]
    assert rows(merge.upsert_latest(once, new, ["k"], [F.col("v").desc()])) == rows(once)
    assert rows(merge.upsert_first(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "d")]


def test_merges(spark):
    old = spark.createDataFrame([("1", "x", None), ("9", "z", "s")], "ref string, en string, speaker string")
    new = spark.createDataFrame([("1", None, "t"), ("2", "y", "u")], "ref string, en string, speaker string")
    assert rows(merge.merge_prefer(old, new, ["ref"], ["en", "speaker"], ("speaker",), keep_old=False)) == [("1", "x", None), ("2", "y", "u")]
    a = spark.createDataFrame([(1, 5, "l"), (2, 5, "l")], "k int, at int, v string")
    b = spark.createDataFrame([(1, 5, "s"), (2, 6, "s"), (3, 1, "s")], "k int, at int, v string")
    assert rows(merge.last_writer_wins(a, b, ["k"], "at", ["v"])) == [(1, 5, "l", "local"), (2, 6, "s", "server"), (3, 1, "s", "server")]
    m = spark.range(1).select(merge.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}


def test_audit_rows_and_deltas(spark):
    a = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    got = {r.k: r.action for r in merge.diff_snapshots(a, b, ["k"], "me").collect()}
    assert got == {1: "D", 2: "U", 3: "I"}
    assert merge.diff_snapshots(a, a, ["k"], "me").count() == 0
    e = spark.createDataFrame([(1, 5, False), (2, 7, True)], "k int, at int, gone boolean")
    assert rows(merge.delta_since(e, "at", "5", "gone").select("k", "is_deleted")) == [(2, True)]
    assert merge.delta_since(e, "at", None).count() == 2


def test_gates(spark):
    day = dt.date(2024, 1, 15)
    rights = spark.createDataFrame([("r1", "open_license", None), ("r2", "permission_granted", dt.date(2024, 1, 1)), ("r3", "pending", None), ("r4", "public_domain", day)], "id string, status string, permission_expires_on date")
    works = spark.createDataFrame([("w", "published"), ("x", "draft")], "id string, status string")
    editions = spark.createDataFrame([("e1", "w", "r1", "published"), ("e2", "w", "r2", "published"), ("e3", "w", "r3", "published"), ("e4", "w", "r4", "published"), ("e5", "x", "r1", "published"), ("e6", "w", "r1", "draft")], "id string, work_id string, rights_id string, status string")
    ctx = gates.SecurityContext("u", "nobody", "2024-01-15")
    public = ctx.public_editions(editions, works, rights)
    assert rows(public) == [("e1",), ("e4",)]
    contents = spark.createDataFrame([("e1", "published"), ("e1", "draft"), ("e3", "published")], "edition_id string, status string")
    assert ctx.contents(contents, public).count() == 1
    assert gates.SecurityContext(role="contributor").contents(contents, public).count() == 3
    changes = spark.createDataFrame([("draft",), ("published",)], "status string")
    assert gates.SecurityContext(role="contributor").rejected_writes(changes).count() == 1
    assert gates.SecurityContext(role="reader").rejected_writes(changes).count() == 2
    assert gates.SecurityContext(role="admin").rejected_writes(changes).count() == 0
    events = spark.range(3)
    assert ctx.events(events).count() == 0 and gates.SecurityContext(role="admin").events(events).count() == 3


def test_order(spark):
    df = spark.createDataFrame([("w", n) for n in (1, 2, 4, 4, 7)], "w string, n int")
    assert rows(order.gaps(df, ["w"], "n")) == [("w", 3), ("w", 5), ("w", 6)]
    assert [r.position for r in order.positions(df, ["w"], [F.col("n")]).orderBy("n").collect()] == [0, 1, 2, 2, 4]
    got = order.occurrence_suffix(df, ["w", "n"], [F.lit(0)])
    assert sorted(r.suffix for r in got.where("n = 4").collect()) == ["", "b"]


def test_streaks_and_intervals(spark):
    today = F.lit("2024-01-15").cast("date")
    day = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([("a", day(15)), ("a", day(14)), ("a", day(12)), ("b", day(14)), ("b", day(13)), ("b", day(13)), ("c", day(13))], "u string, d date")
    assert rows(progress.streaks(df, "u", "d", today)) == [("a", 2), ("b", 2), ("c", 0)]
    s = spark.createDataFrame([("t", "v1", 0, 10_000), ("t", "v2", 10_000, 15_000)], "track_id string, verse_id string, start_ms int, end_ms int")
    p = spark.createDataFrame([("t", 9_999), ("t", 10_000), ("t", 15_000), ("q", 1)], "track_id string, at_ms int")
    got = {(r.track_id, r.at_ms): r.verse_id for r in progress.interval_lookup(p, s, "track_id", "at_ms", "start_ms", "end_ms", 1000).collect()}
    assert got == {("t", 9_999): "v1", ("t", 10_000): "v2", ("t", 15_000): None, ("q", 1): None}
    assert progress.loop_target(s, "v1", "t", 12_000).first().seek_ms == 0


def test_search(spark):
    df = search.indexed(spark.createDataFrame([(1, "Kṛṣṇa speaks"), (2, "of krishna and krsnadasa"), (3, "nothing")], "id int, body string"), "body")
    got = search.search(df, "Krishna", [F.col("id")]).select("id", "rank").collect()
    assert [r.id for r in got] == [1, 2] and got[0]["rank"] == pytest.approx(0.9)
    assert search.search(df, "  ", [F.col("id")]).count() == 0
    assert search.search(df, "Krishna", [F.col("id")], limit=0).count() == 1  # clamped
    names = spark.createDataFrame([("person", "k", "Kṛṣṇa"), ("person", "k", "Kṛṣṇa"), ("place", "v", "Vraja")], "kind string, slug string, matched string")
    assert rows(search.search_entities(names, "krsna")) == [("person", "k", "Kṛṣṇa")]


def test_history(spark):
    df = spark.createDataFrame([("s", i, "user" if i % 2 else "system", f" m  {i} ") for i in range(9)], "s string, i int, role string, content string")
    got = search.history_window(df, "s", [F.col("i").desc()]).orderBy("turn_no").collect()
    assert [r.content for r in got] == ["m 3", "m 5", "m 7"]
    caps = [(True, 3, 3, True), (True, 0, 9, False), (False, 3, 9, False), (True, 3, 2, False)]
    for signed, cap, used, want in caps:
        assert spark.range(1).select(search.cap_reached(F.lit(signed), F.lit(cap), F.lit(used)).alias("x")).first().x is want


def test_documents(spark):
    sections = spark.createDataFrame([("a", None, 1, "1"), ("b", "a", 1, "1.1"), ("c", "b", 2, "1.1.2"), ("d", "b", 1, "1.1.1")], "id string, parent_id string, ordinal int, ref string").withColumn("work_id", F.lit("w"))
    verses = spark.createDataFrame([("v1", "c", "1.1.2.1", 1), ("v2", "d", "1.1.1.1", 1), ("v3", "d", "1.1.1.2", 2)], "id string, section_id string, ref string, ordinal int").withColumns({"work_id": F.lit("w"), "kind": F.lit("verse")})
    counts = documents.subtree_counts(sections, verses.groupBy("section_id").agg(F.count(F.lit(1)).alias("n")))
    assert {r.section_id: r.total for r in counts.collect()} == {"a": 3, "b": 3, "c": 1, "d": 2}
    toc = documents.toc(sections, verses).first()
    import json

    leaf = lambda id_, n, total: {"id": id_, "ref": f"1.1.{n}", "ordinal": n, "total": total, "children": []}
    middle = {"id": "b", "ref": "1.1", "ordinal": 1, "total": 3, "children": [leaf("d", 1, 2), leaf("c", 2, 1)]}
    assert json.loads(toc.contents) == [{"id": "a", "ref": "1", "ordinal": 1, "total": 3, "children": [middle]}]
    editions = spark.createDataFrame([("e", 1, "original", "sa")], "id string, sort_order int, kind string, language_code string")
    contents = spark.createDataFrame([("v2", "e", "text")], "verse_id string, edition_id string, body string")
    segments = spark.createDataFrame([("v2", "t", 0, 5)], "verse_id string, track_id string, start_ms int, end_ms int")
    got = {r.section_id: r.verses for r in documents.section_verses(verses, contents, editions, segments).collect()}
    assert [v.ref for v in got["d"]] == ["1.1.1.1", "1.1.1.2"] and got["d"][0].renderings[0].body == "text" and got["d"][1].audio == []
    mentions = spark.createDataFrame([("v1", "person", "p", "speaker")], "verse_id string, kind string, id string, role string")
    entities = spark.createDataFrame([("person", "p", "slug", "Name")], "kind string, id string, slug string, name string")
    xrefs = spark.createDataFrame([("v1", "v2", "see")], "from_verse_id string, to_verse_id string, kind string")
    v = {r.verse_id: r for r in documents.verse_detail(verses, contents, mentions, entities, xrefs).collect()}
    assert v["v1"].prev_ref == "1.1.1.2" and v["v1"].next_ref is None and v["v1"].mentions[0].name == "Name"
    assert v["v2"].xrefs[0].direction == "in" and v["v3"].xrefs == []
    relations = spark.createDataFrame([("person", "p", "knows", "person", "p")], "from_kind string, from_id string, relation string, to_kind string, to_id string")
    e = documents.entity_detail(entities, mentions, verses, relations).first()
    assert len(e.verses) == len(e.relations_in) == len(e.relations_out) == 1


def test_audit(spark):
    v = spark.createDataFrame([(1, 1, "1.1.1", 1, 1, "क"), (1, 1, "1.1.3", 2, 3, "क ॥ ३ ॥"), (1, 1, "1.1.3", 3, 3, " "), (1, 1, "x", 5, 4, "{{t}}")], "book int, chapter int, ref string, ordinal int, printed int, deva string")
    expected = spark.createDataFrame([(1, 1), (1, 2)], "book int, chapter int")
    s = audit.audit(v, expected)["summary"].first().asDict()
    assert s == {"verses": 4, "missing_chapters": 1, "duplicate_refs": 1, "empty": 1, "malformed": 1, "suffixed": 1, "gaps": 1, "sparse_ordinals": 1, "leftover_markup": 1, "duplicate_bodies": 1}


def test_load_and_sinks(spark, tmp_path):
    work = {"slug": "w", "short_code": "W", "title_iast": "t", "sources": [{"slug": "s"}], "rights": [{"key": "r", "source": "s", "status": "pending"}], "editions": [{"slug": "e", "kind": "original", "rights": "r", "sort_order": 1}]}
    graph = {"people": [{"slug": "p", "name_iast": "P", "epithets": ["Q"], "names": {"en": "P"}}], "relations": [{"from": ["person", "p"], "relation": "is", "to": ["person", "p"]}]}
    verse = lambda n, **k: {"ref": f"1.1.{n}", "ordinal": n, "kind": "odd", "deva": "क", "iast": "ka", **k}
    doc = {"section": {"canto": {"ref": "1", "ordinal": 1}, "chapter": {"ref": "1.1", "ordinal": 1}}, "verses": [verse(1, mentions=[{"kind": "person", "slug": "p"}], xrefs=[{"to": "1.1.2"}, {"to": "9.9.9"}]), verse(2)]}
    (tmp_path / "w/1/1").mkdir(parents=True)
    for name, x in (("w/work.json", work), ("w/graph.json", graph), ("w/1/1/verses.json", doc)):
        (tmp_path / name).write_text(json.dumps(x, ensure_ascii=False))
    read = lambda f: f(spark, str(tmp_path))
    t = corpus.load_work(read(corpus.read_works), read(corpus.read_graphs), read(corpus.read_chapters), F.lit("w"))
    assert t["violations"].count() == 0
    assert t["editions"].first().status == "draft"
    assert t["verses"].where("kind = 'verse'").count() == 2 and t["sections"].count() == 2
    assert t["cross_references"].count() == 1 and t["pending"].first().pending == ["9.9.9"]
    assert t["entity_names"].first().folded == "p"
    kv = spark.createDataFrame([("chapter:c", "1"), ("verse:w:1", "2"), ("verse:x:1", "3")], "key string, value string")
    assert sinks.kv_get(kv, prefix="verse:").count() == 2
    left = sinks.remove_download(kv, "w", spark.createDataFrame([("chapter:c",)], "key string"))
    assert rows(left) == [("verse:x:1", "3")]
    made = sinks.embed(spark.createDataFrame([("c", "1.1", "b")], "id string, ref string, body string"), lambda x: [[1.0, 2.0]] * len(x), "m")
    assert made.first().embedding == [1.0, 2.0] and made.first().chunk_text == "1.1 b"
    with pytest.raises(LookupError):
        sinks.single(kv)


def test_saved_pages(spark, tmp_path):
    from textloom.sources.pages import batches, read_saved_pages

    answer = {"query": {"normalized": [{"from": "a_b", "to": "a b"}], "redirects": [{"from": "a b", "to": "c"}], "pages": [{"title": "c", "pageid": 1, "revisions": [{"revid": 2, "slots": {"main": {"content": "text"}}}]}, {"title": "d", "missing": True}]}}
    (tmp_path / "1.json").write_text(json.dumps(answer))
    x = read_saved_pages(spark, str(tmp_path))
    wanted = spark.createDataFrame([("a_b",), ("d",)], "title string")
    got = corpus.resolve_titles(wanted, x.where("kind = 'normalized'"), x.where("kind = 'redirect'"), x.where("kind = 'page'").select("title", "wikitext"))
    assert {r.title: (r.wikitext, r.missing) for r in got.collect()} == {"a_b": ("text", False), "d": (None, True)}


def test_streams(spark, tmp_path):
    from textloom.streaming import events

    (tmp_path / "in").mkdir()
    lines = [{"id": str(i), "user_id": "u", "event": e, "created_at": "2024-01-01T00:00:00"} for i, e in ((1, "open"), (1, "open"), (2, "Bad"))]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    q = events.append(events.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_upsert_progress(spark):
    verses = spark.createDataFrame([("a", "w", "1.1"), ("b", "w", "1.2"), ("c", "w", "1.10"), ("d", "x", "1")], "id string, work_id string, ref string")
    none = spark.createDataFrame([], "user_id string, work_id string, verse_id string, percent double, last_read_at int")
    reads = spark.createDataFrame([("u", "a", 1)], "user_id string, verse_id string, read_at int")
    updates = spark.createDataFrame([("u", "w", "a", 5), ("u", "w", "b", 6), ("u", "w", "d", 7), (None, "w", "c", 8)], "user_id string, work_id string, verse_id string, at int")
    done, seen, refused = progress.upsert_progress(none, reads, verses, updates)
    assert rows(done) == [("u", "w", "b", 66.67, 6)]
    assert rows(seen) == [("u", "a", 1), ("u", "b", 6)]
    assert refused.count() == 2


def test_sync_and_targets(spark):
    local = spark.createDataFrame([(1, 5, "l", True, False), (2, 5, "l", False, True)], "k int, at int, v string, dirty boolean, deleted boolean")
    server = spark.createDataFrame([(1, 6, "s")], "k int, at int, v string")
    push, after = progress.sync(local, server, ["k"], "at", ["v"])
    assert rows(push.select("k")) == [(1,)]
    assert rows(after.select("k", "v", "dirty")) == [(1, "s", False)]
    chapters = spark.createDataFrame([("w", 1, "s1", 5), ("w", 2, "s2", 10)], "work_id string, ordinal int, section_id string, size int")
    got = progress.daily_pick(chapters, ["work_id"], F.lit("2026-01-10").cast("date")).first()
    assert (got.section_id, got.offset) == ("s2", 4)
    works = spark.createDataFrame([("w",), ("x",), ("y",)], "work_id string")
    at = spark.createDataFrame([("x", "s9")], "work_id string, section_id string")
    ch = chapters.select("work_id", "ordinal", F.col("section_id").alias("id"))
    assert rows(progress.resume_target(works, at, ch)) == [("w", "s1"), ("x", "s9"), ("y", None)]


def test_offline_search(spark):
    verses = spark.createDataFrame([("1.1", "Kṛṣṇa", 1), ("1.2", "rain", 2), ("1.3", "none", 3)], "ref string, body string, position int")
    mentions = spark.createDataFrame([("1.2", "person", "k")], "ref string, kind string, id string")
    entities = spark.createDataFrame([("person", "k", "Krishna")], "kind string, id string, name string")
    got = search.offline_search(verses, mentions, entities, "krishna").collect()
    assert [(r.ref, r["rank"]) for r in got] == [("1.1", 0.9), ("1.2", 0.5)]
    assert search.offline_search(verses, mentions, entities, "1.3").first().ref == "1.3"
    assert search.offline_search(verses, mentions, entities, " ").count() == 0
