import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import index, search
from textloom.sources import store

BODIES = ["Kṛṣṇa sings", "the sinner", "none", None, "a sing-song sing", "ring, ring; the RING", "spring\tof ring", "xx__ring__yy", "Ringing. Ring of", "", "ri ng", "कलियुग काल"]


def bodies():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("rinsgoaeš", k=rng.randint(1, 6)))
    return BODIES + ["".join(word() + rng.choice([" ", ", ", "-", "  ", ". "]) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["ring " * n for n in range(1, 60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(bodies())), "id int, body string").repartition(3).cache()


@pytest.fixture(scope="module")
def made(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "x")
    block, index.BLOCK = index.BLOCK, 16
    index.write_index(docs, "id", "body", path)
    index.BLOCK = block
    return index.open_index(spark, path)


QUERIES = ["sin krishna", "ring", "ring,", "ring of", "g-so", "sing-song", "of r", "n", "__", "q", "काल", ", r", "RING", "a", " ", "g. ring", "gs", "i s"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_by_index_equals_the_scan(docs, made, query):
    scan = search.search(search.indexed(docs, "body"), query, [F.col("id")], 100, ref_hit=F.col("id") == 3, entity_hit=F.col("id") % 50 == 0)
    found = search.search_index(made, docs.select("id"), "id", query, [F.col("id")], 100, ref_hit=F.col("id") == 3, entity_hit=F.col("id") % 50 == 0)
    pairs = lambda rows: [(r.id, round(r["rank"], 6)) for r in rows.select("id", "rank").collect()]
    assert pairs(found) == pairs(scan)
    inside = search.search(search.indexed(docs, "body"), query, [F.col("id")], 100, by_terms=False)
    assert pairs(search.search_index(made, docs.select("id"), "id", query, [F.col("id")], 100, by_terms=False)) == pairs(inside)


def test_only_candidates_are_read_as_text(docs, made):
    found = index.substring_candidates(made, [("ng", False, True), ("of", True, False)])
    held = docs.where(T.fold("body").contains("ng of")).count()
    assert held <= found.count() < docs.count() / 4
    plan = index.substring_hits(made, "ring")._jdf.queryExecution().optimizedPlan().toString()
    assert "folded" not in plan  # a piece of one word is settled by the vocabulary
    assert {r.token for r in index.tokens_with(made, "ng", ends=True).collect()} >= {"sing", "rng", "sprng"}
    assert {r.token for r in index.tokens_with(made, "krs", ends=True).collect()} == set()
    assert {r.token for r in index.tokens_with(made, "krs").collect()} == {"krsna"}


def test_block_maxima_leave_blocks_out_but_no_hit(docs, made):
    words = ["rng"]
    every = index.term_hits(made, words).collect()
    best = sorted(((r.n, -r.id) for r in every), reverse=True)[:5]
    kept = index.term_topk(made, words, 5).collect()
    assert sorted(((r.n, -r.id) for r in kept), reverse=True)[:5] == best
    assert len(kept) < len(every)
    plan = index.term_topk(made, words, 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,rng)" in plan and "ReadSchema: struct<token:string,block:int,id:int,n:int>" in plan


def test_tokens_of_a_query_are_those_of_texts():
    assert T.terms("ring, a sing-song x-y") == ["rng", "sing", "song"] and T.word_runs("-ab- c") == [(1, 3), (5, 6)]


def test_derived_tables_follow_their_input(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, body string")
    rows.write.parquet(str(tmp_path / "t"))
    made = []
    build = lambda at: (made.append(at), spark.range(1).write.parquet(at))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    first = store.derived(read(), "x", build)
    assert store.derived(read(), "x", build) == first and len(made) == 1 and not store.exists(spark, made[0])
    rows.write.mode("append").parquet(str(tmp_path / "t"))
    assert store.derived(read(), "x", build) != first and len(made) == 2
    assert store.derived(rows, "x", build) != store.derived(rows, "x", build)  # no files, nothing to tell them by

    def fails(at):
        build(at)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        store.derived(spark.createDataFrame([(2, "b")], "id int, body string"), "y", fails)
    assert not store.exists(spark, made[-1])
