"""Every operator on one small table with the awkward cases, against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from textloom.llm import mixing, neardup, packing, pii, quality, sharding, suffix, vectors
from textloom.llm import suffix_tree_lm as lm
from textloom.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component string"


def table():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("etaoinshrd", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120).split()
    passage = prose(110)
    texts = [None, "", "  \t\n ", "one", "two words", prose(5), prose(30_000), "la " * 400, "x" * 5000]
    texts += [" ".join(base)] * 6
    for i in range(14):  # near copies, some over and some under the threshold
        copy = list(base)
        for j in range(i):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [f"{prose(rng.randint(1, 60))} {passage} {prose(20)}" for _ in range(12)]
    texts += [f"Mail {word()}@{word()}.org or 4111 1111 1111 1111 +49 30 1234567 é 10.0.0.{i}" for i in range(4)]
    texts += [prose(rng.randint(1, 400)) for _ in range(60)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", len(t or ""), 0.5, 7, "c") for i, t in enumerate(texts)]
    return rows + [rows[12], (None, "no id here", "en", "s0", 10, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def sets(rows):
    out = []
    for r in rows:
        w = words(r[1])
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def linked(s, t, threshold=85):
    return bool(s) and bool(t) and 100 * len(s & t) >= threshold * len(s | t)


def roots(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, empty, rows):
    s = sets(rows)
    n = [i for i, r in enumerate(rows) if r[0] is not None]
    comp = roots({rows[i][0] for i in n}, [(rows[i][0], rows[j][0]) for i in n for j in n if i < j and linked(s[i], s[j])])
    got = neardup.near_duplicates(docs).collect()
    want = sorted((str(r[0]), len(x), str(comp.get(r[0])), r[0] is None or comp[r[0]] == r[0]) for r, x in zip(rows, s, strict=True))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    want = sorted(map(str, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert sorted(map(str, neardup.near_duplicates(docs).collect())) == want


def test_sharding(docs, empty, rows):
    got = sharding.histogram_sort(docs, 4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.histogram_sort(empty, 4).count() == 0


def test_sharding_balances_even_one_text(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    by = collections.Counter()
    for r in sharding.histogram_sort(docs, 16).collect():
        by[r.shard] += r.size
    assert max(by.values()) < 1.02 * min(by.values()) and len(by) == 16


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    many = np.concatenate([base, base[:10] + 0.1 * rng.standard_normal((10, 24)), base[0] + 0.12 * rng.standard_normal((150, 24))])
    rows = [(i, [float(x) for x in v], i % 2 if i < 50 else 0) for i, v in enumerate(many)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] + [1.0] * 23, 0), (904, [1.0] * 3, 0), (905, [1.0] * 3, 0), (906, rows[0][1], None), (None, rows[0][1], 0), (907, [], 0), (908, [1e200] * 24, 1), (909, [2e200] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    edges, n = [], collections.Counter()
    good = [(i, np.array(v) / max(map(abs, v)), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for p, (i, x, a) in enumerate(good):
        for j, y, b in good[:p]:
            if a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                edges.append((i, j))
                n.update((i, j))
    comp = roots({r[0] for r in rows if r[0] is not None}, edges)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (n[i], comp.get(i), i is None or comp[i] == i) for i, *_ in rows}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_pii(docs, empty, rows):
    got = {(r.doc_id, r.spans) for r in pii.find_pii(docs, ["doc_id"]).collect()}
    assert got == {(r[0], ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(r[1] or "") + pii.extra_spans(r[1] or ""))) for r in rows}
    assert pii.find_pii(empty, ["doc_id", "score"], redacted=True).count() == 0


def test_mixing(docs, empty, rows, spark):
    got = mixing.pareto_mix(docs).collect()
    again = mixing.pareto_mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sum(r.target for r in {str(r.source_size): r for r in got}.values()) > 0
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        x = by[r.source_size]
        x[0], x[1], x[2] = x[0] + r.taken, r.target, max(x[2], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    docs.select("doc_id", "text", "source").createOrReplaceTempView("_d")
    c = duckdb.connect()
    pdf = docs.select("doc_id", "text", "source").toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    c.register("documents", pdf)
    want = c.sql(ORACLE_SQL["op5_pareto_mix"]).fetchall()
    assert sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in want) == sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got)
    assert mixing.pareto_mix(empty).count() == 0


def test_mixing_reshares_over_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 1), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 3 and got[None] == 0 and got["a"] == pytest.approx(996)


def test_quality(docs, empty, rows, spark):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(80)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, quality.train(empty, labels), ["doc_id"]).count() == 0


def test_language_model(docs, empty, rows):
    counts, n = collections.Counter(), 0
    for r in rows:
        if not lm.held_out(r[0]):
            counts.update([*words(r[1]), None])
    total, kinds = sum(counts.values()), len(counts)
    got = sorted(lm.score_texts(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    for r, g in zip(sorted(rows, key=lambda r: (str(r[0]), len(words(r[1])))), got, strict=True):
        t = [*words(r[1]), None]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (lm.held_out(r[0]), len(t), sum(counts[w] > 0 for w in t), total)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t))
        assert g.score < 0
    assert lm.score_texts(empty).count() == 0


def plain_tree(rows):
    """A suffix tree by dictionaries: (text) -> log10 probability, with checks that states are distributions."""
    train = [[*words(r[1]), None] for r in rows if not lm.held_out(r[0])]
    counts = [collections.defaultdict(collections.Counter) for _ in range(lm.DEPTH + 1)]
    for t in train:
        for i, w in enumerate(t):
            for k in range(min(i, lm.DEPTH) + 1):
                counts[k][tuple(t[i - k : i])][w] += 1
    n, v = sum(counts[0][()].values()), len(counts[0][()])
    p0 = lambda w: (counts[0][()][w] + 1) / (n + v + 1)

    @functools.cache
    def state(s):
        if not s:
            return True
        c = counts[len(s)].get(s)
        if not c or sum(c.values()) < lm.LEAST or not state(s[1:]):
            return False
        total = sum(c.values())
        gain = sum(m * (math.log(m / total) + round(-8 * math.log2(p(s[1:], w))) * math.log(2) / 8) for w, m in c.items())
        return gain >= lm.COST * len(c)

    def p(s, w):
        if not s:
            return p0(w)
        if not state(s):
            return p(s[1:], w)
        c = counts[len(s)][s]
        return (c[w] + len(c) * p(s[1:], w)) / (sum(c.values()) + len(c))

    vocabulary = list(counts[0][()])
    for s in [s for k in (1, 2) for s in sorted(counts[k], key=str) if state(s)][:3]:
        assert sum(p(s, w) for w in vocabulary) + p(s, "\0unknown") == pytest.approx(1)
    return lambda t: sum(math.log10(p(tuple(t[max(0, i - lm.DEPTH) : i]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("hot", [lm.HOT, 4])
def test_language_model_is_the_plain_suffix_tree(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    short = [r for r in rows if len(r[1] or "") < 20_000]
    plain = plain_tree(short)
    want = sorted((str(r[0]), plain([*words(r[1]), None])) for r in short)
    got = sorted((str(r.doc_id), r.score) for r in lm.score_texts(docs.where("coalesce(length(text), 0) < 20000")).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)


def test_language_model_of_more_partitions_than_files(spark):
    text = "concat_ws(' ', 'a' || id % 7, 'b' || id % 5, 'c' || id % 3) AS text"
    many, one = (spark.range(0, 200, 1, n).selectExpr("id AS doc_id", text) for n in (50, 1))
    assert lm.Scratch(spark, many).files < 50
    got, want = (sorted(tuple(r) for r in lm.score_texts(d).collect()) for d in (many, one))
    assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) == 200
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-6) for r in want]


def test_packing(docs, empty, rows):
    pieces = packing.tokenize_pieces(docs)
    placed = packing.pack(pieces).collect()
    assert len(placed) == pieces.count() and sum(r.length for r in placed if r.doc_id == 1) == 1
    by = collections.defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in placed) // 2048) + 2
    ids = packing.sequences(docs).collect()
    assert sum(len(r.ids) for r in ids) == 4 * sum(r.length for r in placed)
    assert packing.pack(packing.tokenize_pieces(empty)).count() == 0


def passages(texts, length=256, least=50):
    """(number, words) of the runs of bytes of repeated strings that hold more whole words."""
    seen = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        every = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)]
        n = [w for s, e in runs if (w := sum(s <= a and z <= e for a, z in every)) > least]
        out.append((len(n), sum(n)))
    return out


@pytest.mark.parametrize("group", [512, 2])
def test_repeated_strings(docs, empty, rows, group):
    raw = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    want = []
    for r, x, p in zip(rows, raw, passages(raw), strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want.append((str(r[0]), len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest(), *p))
    got = suffix.remove_repeats(docs, group=group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.passage_words) for r in got) == sorted(want)
    if group == 512:
        assert suffix.remove_repeats(empty).count() == 0


def test_media(docs, empty, rows):
    from textloom.llm import media

    got = media.media_digests(docs).collect()
    want = sorted((str(r[0]), hashlib.sha256(media.pad((r[1] or "").encode())).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.payload_sha256) for r in got) == want
    assert {media.decode(bytes(r.media))[0] for r in media.store_media(docs).collect()} == {media.pad((r[1] or "").encode()) for r in rows}
    assert media.media_digests(empty).count() == 0


def test_names_are_registered():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10


def test_pipeline_links_from_a_similarity_of_080(spark, tmp_path):
    import corpus_pipeline

    word = [f"w{i}" for i in range(94)]  # 90 shingles each; the last k words differ, so k of them do
    similar = lambda k: " ".join(word[: 94 - k] + [f"x{k}x{i}" for i in range(k)])
    texts = [" ".join(word), similar(10), similar(11)]  # 80 of 100 and 79 of 101 shared
    base, at, under = sets([(i, t) for i, t in enumerate(texts)])
    assert 100 * len(base & at) == 80 * len(base | at) and 100 * len(base & under) < 80 * len(base | under)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for copy, left in ((texts[1], [1]), (texts[2], [1, 2])):
        docs = spark.createDataFrame([(1, texts[0], "en", "s", 1), (2, copy, "en", "s", 1)], schema)
        assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == left
    assert (1 - 0.80**neardup.ROWS) ** neardup.bands_for(80) < 1e-6 and neardup.bands_for(85) == neardup.BANDS


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, DOCS).select(*corpus_pipeline.DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 80 <= i < 90)) for i in range(100)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.DOCUMENTS
    kept = seen[0].reset_index(drop=True)
    before = [(None if i != i else int(i), t) for i, t in zip(kept.doc_id, kept.text, strict=True)]
    s = sets(before)
    pairs = [i for i, b in enumerate(before) if b[0] is not None]
    comp = roots({before[i][0] for i in pairs}, [(before[i][0], before[j][0]) for i in pairs for j in pairs if i < j and linked(s[i], s[j], corpus_pipeline.NEAR)])
    assert sorted(int(i) for i in seen[1].doc_id.dropna()) == sorted({i for i, c in comp.items() if i == c})
    assert len(seen[2]) == len(seen[1]) and not seen[2].text.dropna().str.contains("@").any()
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, run[cols].values.tolist())) == sorted(map(str, seen[4][cols].values.tolist()))
    assert (run.groupby("sequence_id").length.sum() <= 2048).all()
