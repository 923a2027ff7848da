"""Ranked search, token counts and periodic runs against plain computations."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import periodic, ranked, token_counts
from textloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, score string, rank string, item_id string, n_tokens string, runs string"


def table():
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("etaoin", k=rng.randint(1, 4)))
    texts = [None, "", " \t\n", "a", "A a", "ta " * 900, "x" * 9000, "Straße ÉA\xa0b ｆ 1²३ 'S it's <|endoftext|> <|ENDOFTEXT|>", " ".join(word() for _ in range(9000))]
    texts += [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(90)]
    texts += ["eat tea " * 3 + " ".join(word() for _ in range(7))] * 3
    rows = [(i, t, "en", "s", "r", "i", "n", "u") for i, t in enumerate(texts)]
    return rows + [rows[9], (None, "tea eat no id", *[None] * 6), (None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{out}/documents.parquet")
    items = [(1, "tea eat TEA"), (2, None), (3, ""), (4, "qqqq"), (5, "e ta"), (None, "an oa")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


# ---- op11


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(rows, items, k=20):
    docs = [(i, terms(t)) for i, t in rows]
    n, length = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    held = collections.Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for doc, w in docs:
            tf, s = collections.Counter(w), 0
            for t in terms(text):
                if tf[t]:
                    m = 100 - 25 + 25 * len(w) * n // length
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_ranking_is_that_of_all_scores(spark, rows, docs):
    items = [(1, "tea eat TEA e"), (2, None), (3, ""), (4, "qqqq"), (5, "e ta in on"), (5, "straße"), (None, "an oa ta"), (7, " ".join(t or "" for _, t, *_ in rows[9:14]))]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    for k in (20, 3):
        got = [tuple(r) for r in ranked.top_documents(docs, asked, k).collect()]
        assert sorted(got, key=repr) == plain_ranking([r[:2] for r in rows], items, k)


def test_ranking_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([("x", "tea")], "item_id string, text string")
    assert ranked.top_documents(empty, items).count() == 0
    assert ranked.top_documents(docs, items.limit(0)).count() == 0


def test_queries_in_several_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["tea eat", "e ta", None, "in on an"])], "item_id long, text string")
    want = sorted(map(tuple, ranked.top_documents(docs, items).collect()))
    monkeypatch.setattr(ranked, "QUERY_BYTES", 1)
    assert sorted(map(tuple, ranked.top_documents(docs, items).collect())) == want


def test_postings_are_left_out_only_when_bounds_allow():
    rng = np.random.default_rng(5)
    left = 0
    for _ in range(60):
        size, vocabulary = int(rng.integers(1, 400)), 30
        pairs = sorted({(int(d), int(t)) for d, t in zip(rng.integers(0, size, 2500), np.minimum(rng.zipf(1.3, 2500), vocabulary) - 1)})
        place, term = np.array(pairs, np.int64).T
        tf = rng.integers(1, 4, len(place))
        n = rng.integers(5, 500, size)[place]
        impact = ranked.impacts(tf, n, size, 250 * size)
        holding = np.bincount(term, minlength=vocabulary)
        block = ranked.Block(place, term, impact, size, vocabulary)
        groups = np.diff(block.group)
        assert groups.sum() == len(place) and len(groups) == len({*zip(term.tolist(), impact.tolist())})
        asked = rng.choice(vocabulary, 8, replace=False)
        weight = ranked.weights(size, holding)[asked] * rng.integers(1, 3, 8)
        dense, ids = np.zeros(vocabulary, np.int64), np.arange(size) * 3
        full = np.zeros(vocabulary, np.int64)
        full[asked] = weight
        every = np.bincount(place, full[term] * impact, size).astype(np.int64)
        best = sorted((-s, i) for i, s in enumerate(every.tolist()) if s > 0)[:5]
        for bound in ((0, ranked._LAST), (-best[2][0], best[2][1] * 3) if len(best) > 2 else (0, ranked._LAST)):
            at, scores = block.search(asked, weight, 5, bound, ids, dense)
            assert not dense.any() and (scores == every[at]).all()
            want = best if bound[0] == 0 else best[:2]
            assert sorted(zip((-scores).tolist(), at.tolist()))[: len(want)] == want
            left += np.isin(term, asked).sum() - block.taken
    assert left > 0


def test_op11_and_its_sql(spark, folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["op11_impact_ordered"](spark, folder).collect()]
    # rows that repeat an id are one document to the twin, and it ranks null ids in its own order
    spread = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    spread.write.mode("overwrite").parquet(f"{folder}/unique/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.mode("overwrite").parquet(f"{folder}/unique/benchmark.parquet")
    for t in ("documents", "benchmark"):
        c.sql(f"create or replace view {t} as select * from '{folder}/unique/{t}.parquet/*.parquet'")
    assert len(got) > 20
    got = [tuple(r) for r in QUERIES["op11_impact_ordered"](spark, f"{folder}/unique").collect()]
    assert sorted(got, key=repr) == sorted(c.sql(ORACLE_SQL["op11_impact_ordered"]).fetchall(), key=repr)


# ---- op12


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_op12_counts_what_the_library_counts(spark, rows, folder, tokenizer):
    got = collections.Counter(tuple(r) for r in QUERIES["op12_whole_token_counts"](spark, folder).collect())
    sizes = [len((r[1] or "").encode()) for r in rows]
    assert got == collections.Counter((r[0], b, n, n > 2048) for r, b, n in zip(rows, sizes, tokenizer([r[1] for r in rows])))


def test_op12_on_given_texts(spark, sf, tokenizer):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op12_whole_token_counts"](spark, sf).collect()}
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r[0] for r in want], tokenizer([r[1] for r in want])))


def test_counts_of_hard_texts(tokenizer):
    path = token_counts.default_tokenizer()
    whole = token_counts.whole_tokens(path)
    assert len(whole) > 30_000 and set(tokenizer([w.decode() for w in whole])) == {1}
    known, rng = token_counts.PieceCounts(path, whole), random.Random(2)
    signs = [*"aAbZ09 .,'!?<|>\t\n\x0b\x1c\x1d\x85\xa0​　-_/éÉß́ΣσςİıﬁK１²नाक中😀힣\x00\x7f", "'s", "'LL", "'re", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ſ"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(20_000)]
    assert [known.of(t.encode()) for t in texts] == tokenizer(texts)
    known.MOST = 500  # the cache goes again and again
    assert [known.of(t.encode()) for t in texts[:3000]] == tokenizer(texts[:3000])


def test_whole_tokens_are_never_merged(monkeypatch):
    path = token_counts.default_tokenizer()
    known = token_counts.PieceCounts(path, token_counts.whole_tokens(path))
    merged = []
    plain = token_counts.PieceCounts._merged
    monkeypatch.setattr(token_counts.PieceCounts, "_merged", lambda self, p: (merged.append(p), plain(self, p))[1])
    assert known.of(b"The house, the House! qzxv") == 6 + known.of(b"qzxv")
    assert set(merged) == {b"qzxv"}


def test_tokenizers_of_another_kind_are_refused(spark, docs, empty):
    import public_tokenizers

    with pytest.raises(ValueError, match="does not hold"):
        token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_counts.count_tokens(empty).count() == 0


# ---- op13


def plain_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(x[k] == x[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_and_lag_counts():
    rng = random.Random(3)
    for t in range(1500):
        n, k = rng.randint(0, 300 if t % 50 == 0 else 90), rng.choice([1, 2, 3, 8])
        x = [rng.randrange(k) for _ in range(n)]
        if t % 2 and n:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 9)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        assert periodic.runs_of(np.array(x, np.int64)) == plain_runs(x)


def test_lag_counts_by_transform_and_by_pairs():
    rng = np.random.default_rng(4)
    for n, k in ((3000, 60), (3000, 900), (2500, 40)):
        x = np.minimum(rng.zipf(1.4, n), k) - 1
        size = 1 << int(n + n // 4).bit_length()
        heavy = np.bincount(x) ** 2 > size * size.bit_length() // 2
        assert heavy.any() and not heavy.all()
        counts = periodic.lag_counts(x, n // 4)
        assert counts[0] == 0 and all(counts[q] == (x[q:] == x[:-q]).sum() for q in range(1, n // 4 + 1))


def test_long_texts_of_one_word_or_one_period():
    assert periodic.runs_of(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    x = np.concatenate([[9999, 9998], np.arange(30_000) % 1999, [9997]])
    assert periodic.runs_of(x) == [(2, 30_000, 1999)]


def test_op13(spark, rows, folder, sf):
    def plain(doc, text):
        w = (text or "").encode().split()
        n = len(w)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        codes = {}
        runs = plain_runs([codes.setdefault(x, len(codes)) for x in w])
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = lambda b: hashlib.sha256(b).hexdigest()
        milli = best[1] * 1000 // best[2] if runs else None
        return (doc, n, len(runs), *best, milli, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))

    short = [r for r in rows if len(r[1] or "") < 12000]
    got = collections.Counter(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect() if r.n_words < 4000)
    want = collections.Counter(plain(r[0], r[1]) for r in short)
    assert got == want and any(r[2] for r in want)
    given = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 500]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert all(got[r.doc_id] == plain(r.doc_id, r.text) for r in given) and sum(r[2] > 0 for r in got.values()) > 5


def test_runs_themselves(spark, empty):
    assert periodic.periodic_runs(empty).count() == 0
    rows = [(1, "x a b a b a b a b y"), (None, "la la la la la la"), (None, None), (2, "one two")]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).orderBy(F.col("doc_id").desc_nulls_last(), "n_words").collect()
    assert [([tuple(x) for x in r.runs], r.collapsed) for r in got] == [([], "one two"), ([(1, 8, 2)], "x a b y"), ([], ""), ([(0, 6, 1)], "la")]
