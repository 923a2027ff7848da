"""What readers, contributors and editors see of a library, and that no composed query goes round it."""

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textloom.operators import documents, gates, vectors
from textloom.operators import library as L
from textloom.operators import search as S
from textloom.plans import reader

ANYONE = gates.SecurityContext(today=reader.TODAY)


@pytest.fixture(scope="module")
def lib(spark, sf):
    return reader.library(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))


@pytest.fixture(scope="module")
def hidden(lib):
    """Bodies that an anonymous reader may not see: drafts, and those of draft, pending and expired editions and draft works;
    without those of which there is a visible copy."""
    seen = lib.visible_to(ANYONE).contents.select("id", "body")
    return {r.body for r in lib.contents.join(seen, "id", "left_anti").select("body").collect()} - {r.body for r in seen.collect()}


def test_policies_of_each_role(lib):
    n = lambda role: {t: getattr(lib.visible_to(gates.SecurityContext("u", role, reader.TODAY)), t).count() for t in ("works", "editions", "contents", "mentions", "embeddings", "tracks")}
    every = {t: getattr(lib, t).count() for t in n("editor")}
    reader_, contributor, editor = n("reader"), n("contributor"), n("editor")
    assert editor == every and n("nobody") == reader_ == n(None)
    assert contributor["contents"] == every["contents"] and contributor["mentions"] == every["mentions"]
    assert all(contributor[t] == reader_[t] for t in ("works", "editions", "embeddings", "tracks"))
    assert reader_["embeddings"] == 0 and all(0 < reader_[t] < every[t] for t in reader_ if t != "embeddings")


def test_rights_expire_after_their_day(lib):
    days = {d: lib.visible_to(gates.SecurityContext(today=d)).editions.where("kind = 'transliteration'").count() for d in ("2023-12-31", reader.TODAY, "2024-01-16")}
    assert days["2023-12-31"] == 8 and days[reader.TODAY] == 4 and days["2024-01-16"] == 0


def test_composed_queries_refuse_a_library_without_policies(spark, lib):
    for call in (lambda: L.search_verses(lib, "ring"), lambda: L.retrieve_for_qa(lib, "ring"), lambda: L.section_payload(lib), lambda: L.work_bundle(lib), lambda: L.match_contents(lib, [1.0])):
        with pytest.raises(TypeError, match="visible_to"):
            call()
    bare = spark.createDataFrame([(1, "person", 1, "x")], "verse_id int, kind string, id int, role string")
    with pytest.raises(AnalysisException, match="status"):
        dataclasses.replace(lib, mentions=bare).visible_to(ANYONE)


def test_hidden_texts_reach_no_result(lib, hidden):
    seen = lib.visible_to(ANYONE)
    assert len(hidden) > 20
    public = {r.id for r in seen.editions.select("id").collect()}
    hits = L.search_verses(seen, "ring", limit=100).collect()
    assert hits and {r.edition_id for r in hits} <= public
    found = L.retrieve_for_qa(seen, "ring", limit=20).collect()
    assert found and not {r.body for r in found} & hidden
    near = L.match_contents(seen, lib.embeddings.first().embedding, limit=50, least=-1.0).collect()
    assert near and not {r.body for r in near} & hidden
    bodies = {r.body for r in L.section_payload(seen).select(F.explode("verses").alias("v")).select(F.explode("v.renderings").alias("r")).select("r.body").collect()}
    assert bodies and not bodies & hidden
    parts = L.work_bundle(seen).collect()
    text = "\n".join(p.value for p in parts)
    assert "draft" not in {p.slug for p in parts} and "permission_document_url" not in text
    carried = {r["body"] for p in parts if p.part == "section" for v in json.loads(p.value)["verses"] for r in v["renderings"]}
    assert carried == bodies


def test_hidden_texts_reach_no_prompt(lib, hidden):
    prompts = []
    model = lambda messages: (prompts.append(messages), "nothing")[1]
    L.ask(lib, ANYONE, "ring", model, vector=lib.embeddings.first().embedding)
    shown = "\n".join(m["content"] for m in prompts[0])
    assert not [b for b in hidden if len(b) > 20 and b in shown]
    editors = []
    L.ask(lib, gates.SecurityContext("u", "editor", reader.TODAY), "ring", lambda m: (editors.append(m), "nothing")[1])
    assert [b for b in hidden if len(b) > 20 and b in "\n".join(m["content"] for m in editors[0])]


def test_indexed_library_finds_what_the_scan_finds(spark, sf, lib):
    indexed = reader.library(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"), indexed=True)
    for query in ("ring", "tion then", "th", "qq", " "):
        a, b = (L.search_verses(x.visible_to(ANYONE), query, limit=100).collect() for x in (lib, indexed))
        assert a == b


def test_gates_stand_before_limits(lib):
    plan = L.search_verses(lib.visible_to(ANYONE), "ring")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("GlobalLimit") < plan.index("LeftSemi") or plan.index("LocalLimit") < plan.index("LeftSemi")


def test_bundle_holds_no_group_of_all(lib):
    seen = lib.visible_to(ANYONE)
    parts = L.work_bundle(seen, "asia", F.lit(dt.datetime(2024, 1, 15)))
    assert {p.slug for p in parts.select("slug").distinct().collect()} == {"asia", None}
    n = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert n["person"] == seen.entities.where("kind = 'person'").count() and n["meta"] == 1
    assert "2024-01-15T00:00:00" in parts.where("part = 'meta'").first().value


def test_vector_index(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = vectors.vectors_of(rows, "vec_id")
    asked = [r.embedding for r in rows.orderBy("vec_id").limit(12).collect()]
    got = want = 0
    for q in asked:
        exact = {r.vec_id for r in S.cosine_topk(rows, q, 20, -1.0, "vec_id").collect()}
        near = vectors.nearest(index, q, 20, probes="measured")
        got, want = got + len(exact & {r.id for r in near.collect()}), want + len(exact)
        same = vectors.nearest(index, q, 20, 0.2).select("id", "similarity").collect()
        assert [tuple(r) for r in same] == [tuple(r) for r in S.cosine_topk(rows, q, 20, 0.2, "vec_id").select("vec_id", "similarity").collect()]
    assert got >= 0.95 * want
    plan = vectors.nearest(index, asked[0], 20, probes=3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan and len(vectors.lists_for(index, asked[0], 0.0, 3)) == 3
    gate = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    assert {r.id % 2 for r in vectors.nearest(index, asked[0], 20, gate=gate).collect()} == {0}


def test_vector_index_of_close_groups_reads_few_lists(spark, tmp_path):
    rng = __import__("numpy").random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.02 * rng.standard_normal(16)]) for i in range(600)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    vectors.write_vectors(df, "id", str(tmp_path / "v"), lists=20)
    index = vectors.open_vectors(spark, str(tmp_path / "v"))
    assert index.vectors.count() == 600
    assert len(vectors.lists_for(index, rows[0][1], 0.95)) < 6
    got = vectors.nearest(index, rows[0][1], 50, 0.95)
    assert [r.id for r in got.collect()] == [r.id for r in S.cosine_topk(df.where("id < 1000"), rows[0][1], 50, 0.95, "id").collect()]
    vectors.write_vectors(df.limit(0), "id", str(tmp_path / "none"))
    assert vectors.nearest(vectors.open_vectors(spark, str(tmp_path / "none")), rows[0][1], 5).count() == 0


# ---- the tree of sections


def tree(spark, rows):
    return spark.createDataFrame(rows, "id int, work_id string, parent_id int, ordinal int, ref string").repartition(4)


def test_labels_of_a_deep_chain_take_rows_in_proportion(spark, monkeypatch):
    made = []
    for name in ("_sum_up", "_add_above"):
        plain = getattr(documents, name)
        monkeypatch.setattr(documents, name, lambda s, a, plain=plain: (lambda x: (made.append(x.count()), x)[1])(plain(s, a)))
    chain = tree(spark, [(i, "w", i - 1 if i else None, 1, str(i)) for i in range(1000)])
    leaves = spark.createDataFrame([(i, 2) for i in range(1000)], "section_id int, n long")
    got = {r.id: r for r in documents.section_labels(chain, leaves).collect()}
    assert all((r.low, r.high, r.depth, r.total) == (i, 1000, i + 1, 2 * (1000 - i)) for i, r in got.items()) and len(got) == 1000
    assert set(made) == {1000} and len(made) <= 22


def test_labels_of_a_forest(spark):
    import random

    rng = random.Random(6)
    parent = {i: (rng.randrange(i) if i >= 3 and rng.random() < 0.9 else None) for i in range(120)}
    work = {}
    for i in range(120):
        work[i] = work[parent[i]] if parent[i] is not None else "wx"[i % 2]
    rows = [(i, work[i], parent[i], rng.randrange(4), f"r{i:03}") for i in range(120)]
    lost = [(900, "w", 899, 1, "a"), (901, "w", 900, 1, "b")]
    leaves = {i: rng.randrange(3) for i in range(120)}
    kids = {}
    for i, w, p, o, r in rows:
        kids.setdefault((w, p), []).append((o, r, i))
    want, at = {}, {}

    def visit(w, i, depth):
        low = at[w] = at.get(w, -1) + 1
        total = leaves[i] + sum(visit(w, k, depth + 1) for _, _, k in sorted(kids.get((w, i), [])))
        want[i] = (low, at[w] + 1, depth, total)
        return total

    for w in "wx":
        for _, _, i in sorted(kids.get((w, None), [])):
            visit(w, i, 1)
    got = documents.section_labels(tree(spark, rows + lost), spark.createDataFrame(list(leaves.items()), "section_id int, n long"))
    assert {r.id: (r.low, r.high, r.depth, r.total) for r in got.collect()} == want
    with pytest.raises(ValueError, match="cycle"):
        documents.section_labels(tree(spark, [(1, "w", 2, 1, "a"), (2, "w", 1, 1, "b")]), spark.createDataFrame([], "section_id int, n long"))
