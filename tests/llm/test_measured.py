"""Figures that the README states, measured again on small tables; and how many files scratch tables have."""

import math

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import common, neardup, vectors
from textloom.llm import suffix_tree_lm as lm


def test_pairs_from_the_threshold_on_are_all_linked(spark):
    rng = np.random.default_rng(12)
    texts, near, far = [], [], []
    for i in range(160):
        words = [f"w{i}x{j}" for j in range(204)]  # 200 shingles
        copy = list(words)
        at = 10
        for _ in range(int(rng.integers(1, 5))):  # a changed word changes five shingles
            copy[at] = f"new{i}x{at}"
            at += 8
        s, t = (len(neardup.shingles(" ".join(x).encode())) for x in (words, copy))
        both = len(np.intersect1d(neardup.shingles(" ".join(words).encode()), neardup.shingles(" ".join(copy).encode())))
        (near if 100 * both >= 85 * (s + t - both) else far).append((2 * i, 2 * i + 1))
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert len(near) > 100 and all(got[b] == a for a, b in near) and not [1 for a, b in far if got[b] == a]


def test_near_vectors_from_the_threshold_on_are_all_linked(spark):
    rng = np.random.default_rng(13)
    rows, links = [], 0
    for i in range(400):
        x = rng.standard_normal(48)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(48)
        y -= (y @ x) * x
        c = rng.uniform(0.931, 0.96)
        z = c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)
        rows += [(2 * i, [float(v) for v in x], 1), (2 * i + 1, [float(v) for v in z], 1)]
    m = np.array([r[1] for r in rows])
    want = ((m @ m.T) >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    links = sum(got.values())
    assert links >= 800 and all(got[i] == want[i] for i in range(800))


def test_held_out_texts_score_above_the_base(spark, sf):
    rows = [r for r in lm.op7(spark, sf.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert len(rows) > 10 and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > len(rows) / 2


def test_scratch_tables_have_few_files(spark, tmp_path):
    spark.range(2000).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    scratch = common.Scratch(spark, docs)
    try:
        most = spark.sparkContext.defaultParallelism * common.Scratch.FILES_A_CORE
        kept = scratch.keep(docs.repartition(150, F.col("id")))
        assert len(kept.inputFiles()) <= most and kept.count() == 2000
        assert scratch.keep(docs.repartition(3)).rdd.getNumPartitions() <= 3
        assert common.Scratch(spark).few_files(docs.repartition(150)).rdd.getNumPartitions() == 150
    finally:
        scratch.drop()
