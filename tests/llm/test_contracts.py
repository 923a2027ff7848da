"""The columns of each query against plain computations, and the awkward shapes of tables."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import common, components, media, mixing, neardup, packing, pii, quality, sharding, vectors

BLANKS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder with documents and labels of the smallest scale, and their rows."""
    folder = "/root/testdata/sf0.001"
    return folder, spark.read.parquet(f"{folder}/documents.parquet").collect()


# ---- op2


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_shards_are_runs_of_one_order_near_their_shares(spark, table):
    folder, rows = table
    got = {r.doc_id: r for r in sharding.op2(spark, folder).collect()}
    assert all((got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in rows)
    order = sorted(rows, key=lambda r: (signed(xxhash.xxh64_intdigest(r.text.encode(), 42)), r.doc_id))
    shards = [got[r.doc_id].shard for r in order]
    assert shards == sorted(shards)
    n = collections.Counter()
    for r, s in zip(order, shards, strict=True):
        assert got[r.doc_id].slot == n[s]
        n[s] += 1
    size = [got[r.doc_id].size for r in order]
    upto, total = np.cumsum(size), sum(size)
    for i in range(1, 16):  # each boundary is as near its share as whole documents allow, or within the tolerance
        at = sum(s < i for s in shards)
        here = upto[at - 1] if at else 0
        best = np.abs(np.concatenate([[0], upto]) - total * i / 16).min()
        assert abs(here - total * i / 16) <= max(best, sharding.TOLERANCE * total / 16) + 1e-6


def test_a_hot_text_and_far_ids_split_like_others(spark):
    rows = [(None, "same")] * 2000 + [(i, "same") for i in range(500)] + [(10**15, "same"), (-(10**15), None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.histogram_sort(docs, 8).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 10
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())


def test_written_shards(spark, tmp_path, table):
    folder, rows = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.histogram_sort(docs, 4).collect()}
    for shard in range(4):
        back = spark.read.parquet(str(tmp_path / "s" / f"shard={shard}"))
        assert set(back.columns) == set(docs.columns)
        ids = [r.doc_id for r in back.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()]
        assert [want[i] for i in ids] == [(shard, n) for n in range(len(ids))]
    with pytest.raises(ValueError, match="in the way"):
        sharding.write_shards(docs.withColumn("k1", F.lit(1)), str(tmp_path / "t"))


# ---- op3


def test_copies_of_vectors_are_one_class(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16).tolist()
    rows = [(i, base, 1, "x") for i in range(1500)] + [(5000, [x * 2 for x in base], 1, "x"), (5001, base, 2, "x"), (5001, base, 2, "x"), (5002, rng.standard_normal(16).tolist(), 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert vectors.near_vectors(df).count() == len(rows)
    assert all(got[i] == (1500, 0, i == 0) for i in range(1500)) and got[5000] == (1500, 0, False)
    assert got[5001] == (0, 5001, True) and got[5002] == (0, 5002, True)


# ---- op1


def test_a_bucket_of_near_copies_costs_rows_in_proportion(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(200)]
    made = {}
    monkeypatch.setattr(neardup, "BLOCK", 16)
    beside, blocks = neardup._beside_some, neardup._in_blocks
    counted = []
    count = lambda f: lambda *a: (lambda x: (counted.append(x.count()), x)[1])(f(*a))
    monkeypatch.setattr(neardup, "_beside_some", count(beside))
    monkeypatch.setattr(neardup, "_in_blocks", count(blocks))
    for n in (60, 240):
        texts = []
        for i in range(n):
            w = list(base)
            for at in rng.choice(200, 3, replace=False):
                w[at] = f"x{i}y{at}"
            texts.append(" ".join(w))
        counted.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == n
        made[n] = sum(counted)
    assert made[240] <= 16 * max(made[60], 60)


def test_components_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(900, 7), (901, 901)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    want = sorted((x, root(x)) for x in up)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    scratch = common.Scratch(spark)
    for few in (0, 10**6):
        assert sorted(map(tuple, components.components(df, scratch, few).collect())) == want
        assert components.components(df.limit(0), scratch, few).count() == 0
    scratch.drop()


# ---- op4, op8, op9

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(t):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, t, re.A) if ok[k](m[0])]


def test_personal_data_columns(spark, table):
    folder, rows = table
    got = {r.doc_id: r for r in pii.op4(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        s, g = spans(r.text or ""), got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == kind for k, *_ in s) for kind, _ in PATTERNS)
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        assert g.base_sha256 == hashlib.sha256(named.encode()).hexdigest() and g.spans.startswith(named)


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 5.0, "s")], "doc_id long, text string, n_email double, scores string")
    got = pii.find_pii(docs.withColumnRenamed("n_email", "t").withColumnRenamed("scores", "raw"), ["doc_id", "t", "raw"]).first()
    assert (got.doc_id, got.t, got["raw"], got.n_email) == (1, 5.0, "s", 1)
    pieces = packing.tokenize_pieces(docs).withColumns({c: F.lit(c) for c in ("salt", "place", "rank", "first", "n")})
    got = packing.pack(pieces).first()
    assert [got[c] for c in ("salt", "place", "rank", "first", "n")] == ["salt", "place", "rank", "first", "n"]


def test_pieces_are_those_of_the_tokenizer(spark, table):
    from tokenizers import Tokenizer

    folder, rows = table
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id, i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = packing.op8(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_media_columns(spark, table):
    folder, rows = table
    got = {r.doc_id: r for r in media.op9(spark, folder).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    for r in rows:
        raw, g = (r.text or "").encode(), got[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (g.media_bytes, g.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert f"granule={len(payload)}" in g.feature


# ---- op5


@pytest.mark.parametrize("sources", [["a"], ["a", "b"], ["a", "b", None]])
def test_mixture_of_few_sources(spark, sources):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), sources[i % len(sources)] if i % 50 else sources[-1]) for i in range(900)]
    rows += [(2000 + i, "" if i % 2 else None, sources[0]) for i in range(300)] + [(None, "x y", sources[0]), (None, "x y z", sources[0])]
    rows += [(3000 + i, "one two", "tiny") for i in range(3)] if len(sources) > 1 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == len(rows) and all(r.copies <= mixing.MAX_REPEAT and (r.size or not r.copies) for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        x = by[r.source_size]
        x[0], x[1], x[2] = x[0] + r.taken, r.target, max(x[2], r.size)
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())
    if len(sources) == 1:
        assert all(r.copies == (r.size > 0) for r in got)
    if len(sources) == 2:
        assert all(r.copies == 3 for r in got if r.source_size == 6)  # capped: exactly three times its size


def test_no_task_orders_a_whole_source(spark):
    docs = spark.createDataFrame([(i, "a b c", "only") for i in range(500)], "doc_id long, text string, source string")
    seen = []
    plan = mixing._ranked
    x = mixing.mix_plan(docs).first()
    seen.append((x.p, x.whole, x.coarse_cut))
    assert seen == [(0.0, 1, None)] and plan is mixing._ranked


def test_pipeline_mixture_keeps_each_rows_own_copies(spark):
    import corpus_pipeline

    rows = [(None, f"t{i} u v", "en", f"s{i % 3}", 5) for i in range(60)] + [(i, "a b c d", "en", "s0", 7) for i in range(60)] + [(900, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    n = collections.Counter(tuple(r) for r in got)
    want = collections.Counter({tuple(r["row"]): r.copies for r in mixing.copies(docs, mixing.mix_plan(docs)).collect() if r.copies})
    assert n == want and max(n.values()) <= 3 and all(k[1] for k in n)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), "").count() == 0


# ---- op6


def plain_ftrl(texts, labels):
    """One weight at a time, in dictionaries."""
    z, n, weights = collections.defaultdict(float), collections.defaultdict(float), {}

    def weight(i):
        if i == "bias":
            return -z[i] / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA)
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for t, y in zip(texts, labels, strict=True):
            x = collections.Counter({"bias": 1.0})
            for f in quality.features(t):
                for i in f.tolist():
                    x[i] += quality.SCALE / len(f)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    weights = {i: weight(i) for i in z}
    return weights


def test_ftrl_is_the_plain_loop(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 6)  # families meet in the same weights
    texts = [b"good text here and there", b"BAD BAD BAD 123 !!", b"good words again", b"", b"bad 99 99 BAD"]
    labels = [1, 0, 1, 0, 0]
    w, bias = quality.fit(texts, labels)
    want = plain_ftrl(texts, labels)
    assert bias == pytest.approx(want.pop("bias"), rel=1e-6)
    assert {i: w[i] for i in np.flatnonzero(w).tolist()} == pytest.approx({i: v for i, v in want.items() if v}, rel=1e-4)


def test_shapes_are_those_of_whole_words():
    one, two = (quality.features(b"a" * 70 + x + b" z") for x in (b"9#9", b"#9#"))
    assert all(a.tolist() != b.tolist() for a, b in zip(one[:4], two[:4], strict=True))


def test_held_out_rows_teach_nothing(spark, table):
    folder, rows = table
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = common.crc_of_id() % 3 == 1
    w, bias = quality.train(docs, labels)
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    v, other = quality.train(docs.withColumn("text", F.when(out, "x").otherwise(F.col("text"))), turned)
    assert (w == v).all() and bias == other and w.any()
    got = {r.doc_id: r for r in quality.op6(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and g.predicted == (g.score >= 0.5)
        m = quality.margin(w, bias, quality.features((r.text or "").encode()))
        assert g.score == pytest.approx(1 / (1 + np.exp(-m)))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out}
    assert truth and sum(got[i].predicted == y for i, y in truth.items()) >= 0.9 * len(truth)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, ys: seen.append((len(texts), sum(map(len, texts)))) or (np.zeros(1 << quality.BITS, np.float32), 0.0))
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} " * 20) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    chosen = docs.join(labels, "doc_id").where(common.crc_of_id() % 3 != 1).select("doc_id").distinct().count()
    rows = quality.sample_rows(docs, labels, 8000, 10**9).collect()
    assert len(rows) == chosen == len({r.doc_id for r in rows})
    few = quality.sample_rows(docs, labels, 8000, 1000).collect()
    assert 0 < len(few) < chosen and sum(len(r.raw) for r in few) <= 1000
    assert quality.sample_rows(docs, labels, 3, 10**9).count() == 3 and not seen


def test_scratch_goes_when_an_operator_fails(spark):
    made = []

    @common.with_scratch
    def broken(docs, *, scratch):
        scratch.keep(docs)
        made.append(scratch.root)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        broken(spark.range(3))
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_empty_tables_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
