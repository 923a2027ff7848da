"""Readers, writers, gates and small operators that no registered query reads files for."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.functions import text as T
from textloom.operators import audit, documents, gates, library, merge, parse, progress, search
from textloom.plans.catalog import ORACLE_SQL, QUERIES
from textloom.sources import corpus, pages, sinks
from textloom.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_readers_of_text_files(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "2_7_x.wiki").write_text("क ॥ १ ॥\nख ॥ २ ॥")
    assert rows(corpus.read_wikitext(spark, str(tmp_path / "w"))) == [(2, 7, "क ॥ १ ॥\nख ॥ २ ॥")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "03_x.md").write_text("# head\n1. one[^2]\n2-4. two\n3. late\nplain\n")
    got = rows(corpus.read_numbered_markdown(spark, str(tmp_path / "m")))
    assert got == [(3, 1, "one"), (3, 2, "two"), (3, 3, "two"), (3, 4, "two")]
    (tmp_path / "t.json").write_text(json.dumps([{"chapter": 1, "verse": 1, "author": a, "text": t} for a, t in (("x", "b"), ("x", "a"), ("y", "c"))]))
    got = corpus.read_translations(spark, str(tmp_path / "t.json")).first()
    assert (got.chapter, got.verse, got.texts) == (1, 1, {"x": "a", "y": "c"})
    assert corpus.read_graphs(spark, str(tmp_path / "w")).count() == 0


def test_numbers_above_an_int(spark, sf, tmp_path):
    lines = spark.createDataFrame([("4400009020-4400009021. x", 1), ("7. y", 2)], "value string, position long")
    assert rows(parse.numbered_lines(lines, F.lit(1))) == [(1, 4400009020, "x"), (1, 4400009021, "x"), (1, 7, "y")]
    few = spark.read.parquet(f"{sf}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(20)
    for shift, kind in ((0, "int"), (8_900_000, "bigint")):
        d = str(tmp_path / str(shift))
        few.withColumn("l_orderkey", F.col("l_orderkey") + shift).write.parquet(f"{d}/lineitem.parquet")
        spark.read.parquet(f"{sf}/region.parquet").write.parquet(f"{d}/region.parquet")
        got = QUERIES["numbered_markdown"](spark, d)
        assert dict(got.dtypes)["number"] == kind
        sql = ORACLE_SQL["numbered_markdown"].replace("AS INTEGER", "AS BIGINT")
        with duckdb.connect() as c:
            c.sql(f"create view lineitem as select * from '{d}/lineitem.parquet/*.parquet'")
            assert rows(got) == sorted(c.sql(sql).fetchall(), key=str)


def test_discovery_and_inventory(spark):
    files = spark.createDataFrame([("assets/b.json",), ("assets/a.json",), ("assets/a.json",), ("other/c.json",)], "path string")
    assert [r.slug for r in corpus.discover(files, "assets/", ".json").collect()] == ["a", "b"]
    books = spark.createDataFrame([(1, 12), (2, 3), (3, 0)], "book int, n int")
    got = rows(audit.planned(books))
    assert [b for *_, b in got if b == 1] == [1] * 5 and len(got) == 15 and (2, 3, 1) in got
    assert rows(audit.planned(books, only=2)) == [(2, 1, 0), (2, 2, 0), (2, 3, 0)]
    titles = spark.createDataFrame([(f"t{i:03}",) for i in range(95)], "title string")
    assert rows(pages.batches(titles, 10).groupBy("batch").count())[:2] == [(0, 10), (1, 10)]
    sizes = pages.batches(titles, 10, 20).groupBy("batch").count().collect()
    assert sum(r["count"] for r in sizes) == 95 and max(r["count"] for r in sizes) <= 10


def test_saved_pages_by_id(spark, tmp_path):
    page = {"7": {"title": "c", "pageid": 7, "revisions": [{"revid": 2, "*": "old"}]}, "-1": {"title": "d", "missing": ""}}
    (tmp_path / "1.json").write_text(json.dumps({"query": {"pages": page}}))
    assert rows(pages.read_saved_pages(spark, str(tmp_path))) == [("page", None, None, "c", 7, 2, "old")]


def test_table_api(spark, tmp_path):
    spark.range(3000).withColumn("x", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    got = sinks.table(spark, str(tmp_path / "t"), ["id"], F.col("x") == 3, [F.col("id").desc()], limit=5000)
    assert [r.id for r in got.limit(2).collect()] == [2999, 2992] and got.count() == 429
    assert sinks.table(spark, str(tmp_path / "t"), ["id"], limit=5000).count() == 1000
    assert sinks.maybe_single(spark.range(0)) is None and sinks.maybe_single(spark.range(1)).id == 0
    with pytest.raises(LookupError):
        sinks.maybe_single(spark.range(2))


def test_writers(spark, tmp_path):
    bundles = spark.createDataFrame([("w", "x"), ("v", "y")], "slug string, body string")
    with pytest.raises(PermissionError):
        sinks.export_bundles(bundles, spark.range(1), str(tmp_path / "e"))
    sinks.export_bundles(bundles, spark.range(0), str(tmp_path / "e"))
    assert rows(spark.read.json(str(tmp_path / "e")).select("slug", "body")) == [("v", "y"), ("w", "x")]
    v = spark.createDataFrame([(1, 2, 2, "b"), (1, 2, 1, "a")], "book int, chapter int, ordinal int, deva string")
    sinks.write_chapters(v, str(tmp_path / "c"))
    got = spark.read.json(str(tmp_path / "c")).first()
    assert [x.deva for x in got.verses] == ["a", "b"] and (got.book, got.chapter) == (1, 2)
    store = sinks.kv_put(spark.createDataFrame([("a", "1")], "key string, value string"), spark.createDataFrame([("a", "2"), ("b", "3")], "key string, value string"))
    assert rows(store) == [("a", "2"), ("b", "3")] and rows(sinks.kv_get(store, prefix="b")) == [("b", "3")]
    contents = spark.createDataFrame([("c",), ("d",)], "id string")
    done = spark.createDataFrame([("c", "m"), ("d", "old")], "verse_content_id string, model string")
    assert rows(sinks.missing_embeddings(contents, done, "m")) == [("d",)]


def test_gates_by_role(spark):
    works = spark.createDataFrame([(1, "published"), (2, "draft")], "id int, status string")
    units = spark.createDataFrame([("a", 1, "published"), ("b", 1, "draft"), ("c", 2, "published")], "id string, work_id int, status string")
    reader, editor, admin = (gates.SecurityContext(role=r) for r in ("reader", "editor", "admin"))
    assert [r.id for r in reader.units(units, works).collect()] == ["a"] and editor.units(units, works).count() == 3
    tracks = spark.createDataFrame([("t", 1, "published"), ("u", 2, "published"), ("v", 1, "draft")], "id string, edition_id int, status string")
    segments = spark.createDataFrame([("t",), ("u",), ("v",)], "track_id string")
    public = spark.createDataFrame([(1,)], "edition_id int")
    assert rows(reader.audio_segments(segments, tracks, public)) == [("t",)] and editor.audio_segments(segments, tracks, public).count() == 3
    assert gates.SecurityContext(role="contributor").audio_segments(segments, tracks, public).count() == 1
    assert reader.embeddings(segments).count() == 0 and editor.embeddings(segments).count() == 3
    assert "permission_document_url" not in reader.columns(works.withColumn("permission_document_url", F.lit("x"))).columns
    assert reader.graph(units).count() == 2 and reader.events(units).count() == 0 and admin.events(units).count() == 3


def test_small_operators(spark):
    x = spark.createDataFrame([(1, "a", None)], "k int, b string, c string")
    assert json.loads(x.select(documents.as_json("k", "b", "c").alias("j")).first().j) == {"k": 1, "b": "a", "c": None}
    assert merge.touch(x, F.lit("2024-01-01").cast("timestamp")).first().updated_at is not None
    refs = spark.createDataFrame([("person", 1), ("place", 1)], "kind string, id int")
    assert rows(documents.dangling(refs, refs.where("kind = 'person'"))) == [("place", 1)]
    assert spark.range(1).select(S.clamp(F.lit(500), 1, 100).alias("a"), S.clamp(F.lit(-3), 0, 9).alias("b")).first() == (100, 0)
    T.register_sql(spark)
    assert spark.sql("SELECT text_fold('Kṛṣṇa'), text_clamp('  a  b ')").first() == ("krsna", "a b")
    lines = spark.createDataFrame([("2. x", 0), ("no", 1), ("2-3. y", 2)], "value string, position int")
    assert rows(parse.numbered_lines(lines, F.lit(1))) == [(1, 2, "x"), (1, 3, "y")]


def test_intervals_of_all_lengths(spark):
    import random

    rng = random.Random(4)
    cuts = [0, 1, 3, 900, 901, 50_000, 2_000_000, 3_000_000_000]
    s = [("t", i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i != 2] + [("u", 99, 5, 5)]
    p = [("t", x) for c in cuts for x in (c - 1, c, c + 1)] + [("t", rng.randrange(3_000_000_000)) for _ in range(50)] + [("u", 5), (None, 1), ("t", None)]
    points = spark.createDataFrame(p, "track string, at long")
    got = progress.interval_lookup(points, spark.createDataFrame(s, "track string, segment int, a long, b long"), "track", "at", "a", "b", 10)
    want = sorted((str(t), str(at), str(next((i for u, i, a, b in s if u == t and at is not None and a <= at < b), None))) for t, at in p)
    assert sorted((str(r.track), str(r.at), str(r.segment)) for r in got.collect()) == want


def test_playback_positions_are_streamed(spark, tmp_path):
    rng = random.Random(9)
    s = [("t", i, i + rng.choice([1, 7, 10]), f"v{i}") for i in range(0, 60_000, 10)] + [("u", 0, 1_000_000, "long"), ("u", 5, 5, "empty")]
    segments = spark.createDataFrame(s, "track_id string, start_ms long, end_ms long, verse_id string")
    points = [("t", rng.randrange(61_000)) for _ in range(400)] + [("u", 999_999), ("u", 1_000_000), ("q", 1), (None, 3)]
    for n in (0, 1):
        spark.createDataFrame(points[n::2], "track_id string, at_ms long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    positions = spark.readStream.schema("track_id string, at_ms long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = lambda: events.segments_at(positions, segments, str(tmp_path / "out"), str(tmp_path / "cp"), 16).awaitTermination(120)
    run()
    read = lambda: rows(spark.read.parquet(str(tmp_path / "out")).select("track_id", "at_ms", "verse_id"))
    every = spark.createDataFrame(points, "track_id string, at_ms long")
    batch = rows(progress.interval_lookup(every, segments, "track_id", "at_ms", "start_ms", "end_ms", 16).select("track_id", "at_ms", "verse_id"))
    assert read() == batch and len(batch) == len(points)
    run()  # nothing new: nothing is written twice
    assert read() == batch
    late = [("u", 7), ("t", 3)]
    spark.createDataFrame(late, "track_id string, at_ms long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert len(read()) == len(points) + 2


@pytest.mark.parametrize(("props", "want"), [('{"a": 1, "b": "x"}', True), ('{"a": 2, "b": "x"}', False), ('{"a": "1"}', False), ("not json", False), (None, False)])
def test_json_containment(spark, props, want):
    x = spark.createDataFrame([(props,)], "p string")
    assert x.select(T.json_contains("p", {"a": 1, "b": "x"}).alias("c")).first().c is want


def test_asking(spark, sf):
    import re

    from textloom.plans import reader

    lib = reader.library(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    seen = []

    def model(messages):
        seen.append(messages)
        refs = re.findall(r"SB (\S+) \(", messages[-1]["content"])
        return f"So it is [SB {refs[0]}], and so [SB 9.9.9b]."

    messages = spark.createDataFrame([("s", "user", " first   question ", "2024-01-14 10:00:00"), ("s", "assistant", "first answer", "2024-01-15 10:00:00"), ("other", "user", "not mine", "2024-01-15 11:00:00")], "session_id string, role string, content string, created_at string")
    messages = messages.withColumn("created_at", F.col("created_at").cast("timestamp"))
    sessions = spark.createDataFrame([("s", "u"), ("other", "v")], "session_id string, user_id string")
    ctx = gates.SecurityContext(uid="u", today=reader.TODAY)
    told = {"messages": messages, "sessions": sessions, "session": "s", "now": "2024-01-15 12:00:00"}
    got = library.ask(lib, ctx, "  ring  ", model, vector=lib.embeddings.first().embedding, cap=2, **told)
    assert got.grounded and "9.9.9b" not in got.answer and got.citations[0]["ref"] in got.answer and got.error is None
    assert [m["role"] for m in seen[0]] == ["system", "user", "assistant", "user"] and seen[0][1]["content"] == "first question"
    assert seen[0][-1]["content"].endswith("Question: ring") and seen[0][-1]["content"].count("] SB ") <= 12
    assert got.log == (("s", "user", "ring", None), ("s", "assistant", got.answer, True)) and got.title is None
    assert library.ask(lib, ctx, "ring", model, cap=1, **told).error == "cap"
    assert library.ask(lib, ctx, " a ", model).error == "question"
    none = library.ask(lib, gates.SecurityContext(), "zqzqzqzq", model)
    assert none == library.Answer() and len(seen) == 1


def test_more_writers(spark, tmp_path):
    v = spark.createDataFrame([(1, 2, 2, "1.2.2", "b"), (1, 2, 1, "1.2.1", "a"), (1, 3, 1, "1.3.1", None)], "book int, chapter int, ordinal int, ref string, deva string")
    sinks.write_manifest(v, str(tmp_path / "m"))
    got = spark.read.json(str(tmp_path / "m")).first()
    assert (got.book, got.total, [(c.chapter, c.verses) for c in got.chapters]) == (1, 3, [(2, 2), (3, 1)])
    sinks.write_works(spark.createDataFrame([("w", "t")], "slug string, title string"), str(tmp_path / "w"))
    assert rows(spark.read.json(str(tmp_path / "w")).select("slug", "title")) == [("w", "t")]
    sinks.write_markdown(v, str(tmp_path / "d"))
    got = spark.read.text(str(tmp_path / "d" / "book=1" / "chapter=2"), wholetext=True).first().value
    assert got.strip() == "# 1.2\n\n**1.2.1** a\n\n**1.2.2** b"


def test_loads_resume(spark, tmp_path):
    import shutil

    x = spark.range(1000).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "t")
    assert sinks.resumable_load(x, "id", path, 100) == 10
    lost = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("batch="))[:3]
    for p in lost:  # as if the job had ended before these
        shutil.rmtree(p)
    assert sinks.resumable_load(x, "id", path, 100) == 3 and sinks.resumable_load(x, "id", path, 100) == 0
    assert rows(spark.read.parquet(path).agg(F.count("id"), F.countDistinct("id"), F.sum("v"))) == [(1000, 1000, 999000)]


def test_sort_keys_and_list_unions(spark):
    x = spark.createDataFrame([("10",), ("2b",), ("?",), ("2",), (None,)], "p string")
    from textloom.operators import order

    assert [r.p for r in x.orderBy(order.printed_key(F.col("p"))).collect()][:3] == ["2", "2b", "10"]
    tags = spark.createDataFrame([(1, ["b", "a"]), (1, ["b"]), (2, [])], "k int, t array<string>")
    assert rows(order.union_of_lists(tags, ["k"], "t", "tags")) == [(1, ["a", "b"]), (2, [])]
