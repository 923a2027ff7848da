"""Loads that publish many tables at once, syncs that survive a restart, scans, redirects and kept counts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.operators import gates, merge, order, search
from textloom.operators import library as L
from textloom.plans import reader
from textloom.plans.catalog import ORACLE_SQL, QUERIES
from textloom.sources import corpus, sinks, sql, tables
from textloom.sources.snapshots import Conflict, Snapshots, load_tables, pull, sync_pull


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(spark, *values):
    return spark.createDataFrame(list(values), "k int, v string")


def test_a_load_is_published_whole_or_not_at_all(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.version().number == 0 and s.read("a") is None
    one = s.commit({"a": pairs(spark, (1, "x")), "b": pairs(spark, (1, "y"))}, token="load-1")
    fail = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        s.commit({"a": pairs(spark, (2, "z")), "b": pairs(spark, (2, "z")).withColumn("v", fail("v"))}, token="load-2")
    assert s.version() == one and rows(s.read("a")) == [(1, "x")]
    two = s.commit({"a": pairs(spark, (2, "z"))}, token="load-2")
    assert two.number == 2 and rows(s.read("a")) == [(2, "z")] and rows(s.read("b")) == [(1, "y")]
    assert s.commit({"a": pairs(spark, (9, "!"))}, token="load-2") == two and s.versions() == [1, 2]  # run again: published once
    assert rows(s.read("a", s.version(1))) == [(1, "x")]
    with pytest.raises(Conflict):
        s.commit({"a": pairs(spark, (3, "w"))}, base=one)
    assert s.version() == two
    s.commit({"b": pairs(spark, (5, "b"))})
    assert s.vacuum(keep=1) > 0 and rows(s.read("a")) == [(2, "z")] and rows(s.read("b")) == [(5, "b")]


def test_a_load_merges_by_keys(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    keys = {"t": ["k"], "u": ["k"]}
    load_tables(s, {"t": pairs(spark, (1, "a"), (1, "a")), "u": pairs(spark, (1, "b"))}, keys, "1")
    load_tables(s, {"t": pairs(spark, (1, "c"), (2, "d")), "u": pairs(spark)}, keys, "2")
    assert rows(s.read("t")) == [(1, "c"), (2, "d")] and rows(s.read("u")) == [(1, "b")]
    broken = {"t": pairs(spark, (9, "z")), "u": pairs(spark), "violations": pairs(spark, (1, "blank verse"))}
    with pytest.raises(ValueError, match="blank verse"):
        load_tables(s, broken, keys, "3")
    assert s.version().number == 2


def server(spark, *values):
    return spark.createDataFrame(list(values), "k int, at string, v string, deleted boolean").withColumn("at", F.col("at").cast("timestamp"))


def test_a_sync_survives_restarts(spark, tmp_path, monkeypatch):
    mine = Snapshots(spark, str(tmp_path / "mine"))
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    keys = {"bookmarks": ["k"], "progress": ["k"]}
    at = {"bookmarks": server(spark, (1, day(1), "a", False), (2, day(2), "b", False)), "progress": server(spark, (7, day(3), "p", False))}
    pull(mine, at, keys, "at")
    assert mine.version().notes["mark"].startswith("2024-01-03")
    seen = lambda t: {r.k: (r.v, r.deleted) for r in mine.read(t).collect()}
    assert seen("bookmarks") == {1: ("a", False), 2: ("b", False)}
    at["bookmarks"] = server(spark, (1, day(5), "a", True), (2, day(2), "b", False), (3, day(2), "late", True))
    pushed = []
    dirty = mine.read("progress").withColumn("dirty", F.lit(True))
    mine.commit({"progress": dirty})
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            pull(mine, at, keys, "at", "2 days", push=lambda t, r: pushed.append((t, r.count())))
    assert seen("bookmarks") == {1: ("a", False), 2: ("b", False)} and mine.version().notes["mark"].startswith("2024-01-03")
    again = Snapshots(spark, str(tmp_path / "mine"))
    pull(again, at, keys, "at", "2 days", push=lambda t, r: pushed.append((t, r.count())))
    assert seen("bookmarks") == {1: ("a", True), 2: ("b", False), 3: ("late", True)}  # the tombstone that came late, too
    assert pushed == [("bookmarks", 0), ("progress", 1)] * 2 and not mine.read("progress").where("dirty").count()
    before = rows(mine.read("bookmarks"))
    pull(again, at, keys, "at", "2 days")
    assert rows(mine.read("bookmarks")) == before and mine.version().notes["mark"].startswith("2024-01-05")


def test_server_side_of_a_sync(spark):
    b = spark.createDataFrame([("u", 1, "2024-01-01", False), ("u", 2, "2024-01-03", True), ("w", 3, "2024-01-03", False)], "user_id string, k int, at string, deleted boolean")
    got = sync_pull({"bookmarks": b, "progress": b}, "u", "2024-01-02", "at", F.lit("2024-02-01").cast("timestamp")).collect()
    assert sorted(r.table for r in got) == ["bookmarks", "progress"] and all('"k":2' in r["row"] and '"deleted":true' in r["row"] for r in got)
    assert sync_pull({"bookmarks": b}, None, None, "at", F.now()).count() == 0


def test_resumable_load_of_an_input_that_grows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.resumable_load(spark.range(1000), "id", path, 100) == 10
    assert sinks.resumable_load(spark.range(5000), "id", path, 100) == 0  # the batches are those of the first run
    assert spark.read.parquet(path).count() == 1000


def test_redirects_are_followed_to_their_ends(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(5)]
    links = spark.createDataFrame([*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("in", "a"), ("self", "self")], "source string, target string")
    got = {r.source: (r.target, r.cycle) for r in corpus.follow(links).collect()}
    assert all(got[f"p{i}"] == ("p5", False) for i in range(5))
    assert all(got[x][1] for x in ("a", "b", "c", "in", "self"))
    assert corpus.follow(links.limit(0)).count() == 0
    wanted = spark.createDataFrame([("p0",), ("P 3",), ("a",), ("gone",), ("page",)], "title string")
    pages = spark.createDataFrame([("p5", "text"), ("page", "more")], "title string, wikitext string")
    normal = spark.createDataFrame([("P 3", "p3")], "source string, target string")
    found = {r.title: (r.resolved, r.wikitext, r.missing) for r in corpus.resolve_titles(wanted, normal, links, pages).collect()}
    assert found["p0"] == found["P 3"] == ("p5", "text", False) and found["page"] == ("page", "more", False)
    assert found["a"][2] and found["gone"] == ("gone", None, True)
    with pytest.raises(LookupError, match="a, gone"):
        corpus.resolve_titles(wanted, normal, links, pages, strict=True)
    assert corpus.resolve_titles(wanted.where("title LIKE 'p%'"), normal, links, pages, strict=True).count() == 2


def test_counts_kept_by_the_log_equal_a_recount(spark):
    old = spark.createDataFrame([(i, i % 4) for i in range(40)], "id int, section int")
    new = spark.createDataFrame([(i, (i + i // 13) % 5) for i in range(7, 55)], "id int, section int")
    recount = lambda v: {r.section: r.n for r in v.groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}
    sections = spark.createDataFrame([(s, recount(old).get(s)) for s in range(6)], "id int, verse_count long")
    kept = merge.keep_counts(sections, "id", "verse_count", merge.diff_snapshots(old, new, ["id"], "x"), "section")
    assert {r.id: r.verse_count for r in kept.collect()} == {s: recount(new).get(s, 0) for s in range(6)}


def test_scans_embed_what_is_visible(spark, sf):
    lib = reader.library(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    seen = lib.visible_to(gates.SecurityContext(today=reader.TODAY))
    got = tables.scan(seen, "contents", ["id"], [tables.Embed("verses", ["ref"], inner=True), tables.Embed("editions", ["title"])], limit=5000).collect()
    assert got and all(r.verses.ref and r.editions.title for r in got) and len(got) <= tables.MOST
    sections = tables.scan(seen, "sections", ["id", "ref"], [tables.Embed("verses", ["ref"]), tables.Embed("works", ["slug"])]).collect()
    assert any(not r.verses for r in sections) and sum(len(r.verses) for r in sections) == seen.verses.join(seen.sections.select(F.col("id").alias("section_id")), "section_id").count()
    with pytest.raises(LookupError, match="2 foreign keys"):
        tables.scan(seen, "xrefs", ["kind"], [tables.Embed("verses", ["ref"])])
    assert tables.scan(seen, "xrefs", ["kind"], [tables.Embed("verses", ["ref"], by="from_verse_id")], limit=3).count() <= 3
    with pytest.raises(LookupError, match="0 foreign keys"):
        tables.scan(seen, "works", ["slug"], [tables.Embed("scripts", ["name"])])
    with pytest.raises(TypeError):
        tables.scan(lib, "works", ["slug"])
    plan = tables.scan(seen, "verses", ["ref"], [tables.Embed("works", ["slug"])])._jdf.queryExecution().optimizedPlan().toString()
    assert "ordinal" not in plan.split("\n")[0]


def test_table_functions_equal_the_dataframe_forms(spark, sf):
    lib = reader.library(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    seen = lib.visible_to(gates.SecurityContext(today=reader.TODAY))
    sql.register(spark, seen, "x_")
    for q, work in (("ring", None), ("tion, then", "asia"), ("2.2.6", None), ("  ", None), ("Sage", None)):
        a = L.search_verses(seen, q, work, limit=100).drop("snippet")
        b = spark.sql("SELECT * FROM search_verses(:q, :work, NULL, 500)", {"q": q, "work": work})
        assert rows(a) == rows(b)
        assert rows(L.retrieve_for_qa(seen, q, work)) == rows(spark.sql("SELECT * FROM retrieve_for_qa(:q, :work)", {"q": q, "work": work}))
    assert spark.sql("SELECT * FROM get_toc('asia')").count() > 1 and spark.sql("SELECT * FROM get_toc('nowhere')").count() == 0
    assert spark.sql("SELECT count(*) FROM x_contents").first()[0] == seen.contents.count()
    with pytest.raises(TypeError):
        sql.register(spark, lib)


def test_pages_and_repeated_bodies(spark):
    hits = spark.createDataFrame([(i, f"g{i % 2}", 100 - i) for i in range(300)], "id int, g string, down int")
    page = search.grouped_page(hits, ["g"], ["down", "id"], ["id"], 500).collect()
    assert sum(len(r.hits) for r in page) == 100 and all(r.hits[0].id in (298, 299) for r in page)
    groups, members = order.repeated(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "id int, body string"), ["body"], "id")
    assert rows(groups) == [("a", 2, 1)] and rows(members) == [("a", 1), ("a", 2)]


def test_all_hits_are_grouped(spark, tmp_path):
    """More hits than a page holds, a group of most of them, ids in several ranges, and missing numbers and sources."""
    rows_ = [(i, "en" if i % 3 else "de" if i % 2 else "fr", "big" if i % 10 else None, None if i % 50 == 0 else (i * 37) % 90) for i in range(1500)]
    spark.createDataFrame(rows_, "doc_id long, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["hits_grouped"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(ORACLE_SQL["hits_grouped"]).fetchall()
    assert rows(got) == sorted(want, key=str)
    assert sum(len(r.hits.split(",")) for r in got.collect()) == sum(r[1] != "de" for r in rows_)
    hits = spark.createDataFrame([(i, 100 - i // 2) for i in range(300)], "id int, down int").withColumn("g", F.lit("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        (r,) = search.grouped_hits(hits, ["g"], ["down", "id"], "id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [int(x) for x in r.hits.split(",")] == sorted(range(300), key=lambda i: (100 - i // 2, i))


def test_repeated_bodies_name_all_their_documents(spark, tmp_path):
    texts = ["", None, "  ", "a  b", "a b"]
    rows_ = [(i * 7919 % 3001, texts[i % 5] if i % 2 else f"only {i}") for i in range(3000)]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["dup_bodies"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(ORACLE_SQL["dup_bodies"]).fetchall()
    assert rows(got.select("body", "n", "first", "refs")) == sorted(want, key=str)
    blank = sorted(i for i, x in rows_ if not (x or "").strip())
    assert ",".join(map(str, blank)) in [r.refs for r in got.collect()]
