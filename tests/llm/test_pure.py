"""The operators' own algorithms against brute force, without Spark."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import media, neardup, packing, pii, quality, sharding, suffix, vectors
from textloom.llm import suffix_tree_lm as lm


# ---- packing


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= items[i] and bins[j] not in bins[:j]:
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.sampled_from([10, 20, 37]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_plan_keeps_items_and_dominance_keeps_the_optimum(case):
    capacity, items = case
    counts = np.bincount(items, minlength=capacity + 1).astype(np.int64) if items else np.zeros(capacity + 1, np.int64)
    plan = packing.plan_bins(counts)
    assert sorted(x for c, n in plan for x, k in c for _ in range(k * n)) == sorted(items)
    assert all(sum(x * k for x, k in c) <= capacity for c, _ in plan)
    rest = counts.copy()
    fixed = packing.reduce_by_dominance(rest)
    left = [x for x in range(capacity + 1) for _ in range(rest[x])]
    assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity)


def test_plan_is_near_the_lower_bound():
    sizes = np.minimum(2048, np.random.default_rng(1).lognormal(6, 1.2, 50_000).astype(int) + 1)
    counts = np.bincount(sizes, minlength=2049).astype(np.int64)
    bins = sum(n for _, n in packing.plan_bins(counts))
    assert bins <= 1.002 * -(-int(sizes.sum()) // 2048)


def test_chunk_ids_match_the_tokenizer():
    ids = packing.ChunkIds(packing.default_tokenizer())
    texts = ["Héllo, wörld!! it's 12.5% of x's", "a<|endoftext|>b <|ENDOFTEXT|>", "don't  stop now !'s", "x" * 300, "", "ﬁ é 日本語 $$$|", "word!!' \"quote\".'s"]
    for t in texts:
        chunks = packing.chunks_of(t.encode())
        got = np.frombuffer(ids.of(chunks), "<u4").tolist()
        assert got == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


# ---- PII

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and pii.luhn(d), "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, t, re.A) if ok[k](m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.12 5-+()é%_", max_size=60))
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_pii_kinds():
    t = "card 4111 1111 1111 1111, IBAN DE89370400440532013000, ssn 123-45-6789; bare 123-45-6789" + " " * 60 + "987-65-4321"
    kinds = [k for k, *_ in pii.base_spans(t) + pii.extra_spans(t)]
    assert kinds.count("card") == 1 and kinds.count("iban") == 1 and kinds.count("ssn") == 2
    assert pii.redact("x a@b.cd y", pii.base_spans("x a@b.cd y")) == "x <EMAIL> y"
    assert pii.score("email a@b.cd", "email", 6, 12) > pii.score("a@b.cd", "email", 0, 6)


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"])
@pytest.mark.parametrize("after", ["", ",", " Please pay", " BIC X", " 2024", " A", " A 1 B 2", " COBADEFFXXX 12 2024 AND MORE", "é", " NO9386011117947"])
def test_iban_before_capitals_and_digits(iban, after):
    got = pii.extra_spans(f"to {iban}{after}")
    assert ("iban", 3, 3 + len(iban)) in got and len(got) == 1 + after.count("NO93")
    assert pii.extra_spans(f"to {iban[:-1]}{'0' if iban[-1] != '0' else '1'}") == []
    assert pii.extra_spans(f"{iban}0") == pii.extra_spans(f"x{iban}") == []


@pytest.mark.parametrize("t", ["AA11" * 75_000, "AA11 " * 60_000, "AA11A A A A A A A A A A A A A " * 10_000])
def test_iban_is_linear(t):
    pii.extra_spans(t)


@pytest.mark.parametrize("t", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "+" + "1 " * 150_000])
def test_pii_is_linear(t):
    pii.base_spans(t)
    pii.extra_spans(t)


# ---- Ogg


def crc_bitwise(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@pytest.mark.parametrize("n", [0, 1, 192, 193, 1919, 59520, 61440, 65025, 245396])
def test_ogg_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = media.pad(raw)
    assert len(payload) % media.UNIT == 0 and payload.startswith(raw) and len(payload) >= media.UNIT
    got, seen = media.decode(media.encode(payload))
    assert got == payload and seen["granule"] == len(payload) and seen["ms"] == len(payload) * 1000 // 8000


def test_ogg_damage_is_found():
    assert media.ogg_crc(b"Ogg") == crc_bitwise(b"Ogg")
    good = media.encode(media.pad(b"x" * 5000))
    for i in (0, 4, 5, 20, 23, 26, 27, 60, len(good) - 1):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(media.BadOgg):
            media.decode(bytes(bad))
    for cut in (10, 100, len(good) - 1):
        with pytest.raises(media.BadOgg):
            media.decode(good[:cut])


# ---- near duplicates


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.75, 0.85, 0.95):
        both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        k = round(1000 * (1 - share) / (1 + share))
        a, b = np.unique(np.concatenate([both[: 1000 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])), np.unique(both)
        z = sum(bin(x ^ y).count("1") for x, y in zip(neardup.odd_sketch(neardup.samples(a)), neardup.odd_sketch(neardup.samples(b)), strict=True))
        differing = -neardup.SKETCH_BITS / 2 * np.log(1 - 2 * z / neardup.SKETCH_BITS)
        assert abs(1 - differing / (2 * neardup.BANDS * neardup.ROWS) - share) < 0.15


def test_shingles():
    assert len(neardup.shingles(b"")) == len(neardup.shingles(b" \t\n\x0b ")) == 0
    assert len(neardup.shingles(b"a b")) == len(neardup.shingles(b"a b c d e")) == 1
    assert len(neardup.shingles(b"a b c d e f")) == 2
    assert neardup.shingles(b"A B C d e").tolist() == neardup.shingles(b"a\tb c  D E").tolist()
    assert len(neardup.shingles(b"a " * 1000)) == 1


# ---- repeated strings


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=2, max_size=12))
def test_suffix_sort(texts):
    raw = "".join(texts).encode()
    size = np.array([len(t) for t in texts])
    s = suffix.Suffixes(raw, np.cumsum(size) - size, size)
    first = np.repeat([0, len(texts) // 2], [len(texts) // 2, len(texts) - len(texts) // 2])
    order, shared = s.sort(first)
    for a, b in ((0, len(texts) // 2), (len(texts) // 2, len(texts))):
        assert [texts[i] for i in order[a:b]] == sorted(texts[a:b])
    for i in range(1, len(texts)):
        if first[i] == first[i - 1]:
            x, y = texts[order[i - 1]], texts[order[i]]
            assert shared[i] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("seed", range(3))
def test_a_misleading_hash_removes_nothing(monkeypatch, seed):
    rng = random.Random(seed)
    core, anchor = rng.randbytes(420), rng.randbytes(suffix.GRAM)
    regions, before = [], []
    for i in range(6):
        k = rng.randrange(100, 190)
        head = (core if i % 2 else rng.randbytes(420))[:k]
        regions.append(head + anchor + (core if i % 3 else rng.randbytes(420)))
        before.append(k)
    before = np.array(before)
    args = (regions, np.zeros(6, np.int64), before, np.zeros(6, np.int64), before, np.ones(6, np.int64))

    def plain(length):
        windows = [[(r[b - d : b - d + length] if d <= b and b - d + length <= len(r) else None) for d in range(max(before) + 1)] for r, b in zip(regions, before, strict=True)]
        return [[w is not None and sum(o[d] == w for o in windows) > 1 for d, w in enumerate(row)] for row in windows]

    want = [plain(suffix.LENGTH), plain(suffix.SHORT)]
    assert [x.tolist() for x in suffix.repeated_windows(*args)] == want
    monkeypatch.setattr(suffix.Suffixes, "between", lambda self, s, e: np.zeros(len(s), np.uint64))
    assert [x.tolist() for x in suffix.repeated_windows(*args)] == want


@given(st.lists(st.sampled_from([b"ab", b"c", b" ", b"\n", b" \t"]), max_size=12), st.data())
def test_whole_words(parts, data):
    raw = b"".join(parts)
    s = data.draw(st.integers(0, len(raw)))
    e = data.draw(st.integers(s, len(raw)))
    want = sum(s <= m.start() and m.end() <= e for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    assert suffix.whole_words(raw, s, e) == want


def test_anchors_agree_on_equal_windows():
    rng = random.Random(5)
    core = rng.randbytes(700)
    found = []
    for pre in (0, 13, 450):
        a, key, lo, hi, *_ = suffix.anchors(rng.randbytes(pre) + core + rng.randbytes(300))
        at = {w: (int(k), int(x) - pre) for x, k, s, e in zip(a, key, lo, hi, strict=True) for w in range(s - pre, e - pre + 1)}
        found.append([at[w] for w in range(0, 301)])
    assert found[0] == found[1] == found[2]
    assert suffix.anchors(b"x" * 255) is None


# ---- vectors, shards, quality, language model


def test_rotation_codes_estimate_inner_products():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 64))
    x[100:] = x[:100] + 0.2 * rng.standard_normal((100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, upper = vectors.estimates(*vectors.code_of(x, vectors.rotation(64)))
    true = x @ x.T
    off = ~np.eye(200, dtype=bool)
    assert abs((got - true)[off].mean()) < 0.01
    assert ((upper >= true) | (true < vectors.COSINE))[off].all()


def test_bands_reach_the_promised_recall():
    for n in (10, 5000, 10**7):
        k, bands = vectors.bands_for(n)
        agree = (1 - np.arccos(vectors.COSINE) / np.pi) ** k
        assert (1 - agree) ** bands <= vectors.MISS


def test_splitter_bounds():
    s = sharding.Splitter(0.0, bits=1, level=1)
    assert s.bound() == (2**56 - 2**63, -(2**63), -(2**63))


def test_classifier_learns_and_ignores_empty():
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    good = [" ".join(word() for _ in range(60)).encode() for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)).encode() for _ in range(60)]
    w, b = quality.fit([t for p in zip(good[:40], bad[:40], strict=True) for t in p], [1, 0] * 40)
    side = lambda t: quality.margin(w, b, quality.features(t)) > 0
    assert all(map(side, good[40:])) and not any(map(side, bad[40:]))
    assert quality.margin(w, b, quality.features(b"")) == b


def tree_of(texts, hot=lm.HOT, rounds=lm.DEPTH):
    """The rounds on one chunk of training texts: the chunk, its tokens and its kinds."""
    x = lm.Chunk.of_texts([None] * len(texts), [lm.symbols(t) for t in texts], hot)
    assert x.train.all()
    u, n = x.words()
    c, back = lm.meet_words([u], [n])
    x.take_words(back[0], int(c.sum()), int((c > 0).sum()))
    for k in range(1, rounds + 1):
        rows = x.pairs(k)
        again = lm.unpack_pairs(*lm.pack_pairs(rows))
        assert (again["ctx"] == rows["ctx"] >> np.uint64(16)).all() and all((again[f] == rows[f]).all() for f in rows if f != "ctx")
        back, whole = lm.meet_pairs([again])
        order = np.argsort(whole["name"], kind="stable")
        names, at = np.unique(whole["name"][order], return_inverse=True)
        x.take(back[0]["c"], back[0]["kinds"], {"name": names} | {f: np.bincount(at, whole[f][order], len(names)) for f in ("kinds", "gain")})
    return x, int(c.sum()), int((c > 0).sum())


def test_split_contexts_change_nothing():
    rng = random.Random(5)
    def line(w):
        out = []
        for _ in range(30):
            w = rng.choice("abcde") if rng.random() < 0.3 else "bcdea"["abcde".index(w)]
            out.append(w)
        return " ".join(out)

    texts = [line("a").encode() for _ in range(40)]
    whole, split = tree_of(texts)[0], tree_of(texts, 7)[0]
    assert whole.p == pytest.approx(split.p, rel=1e-6) and np.log10(whole.p).sum() > whole.base.sum() + 100


def test_a_context_stays_whatever_else_the_corpus_holds():
    pair = [b"rare pair follows"] * 3 + [b"other pair goes"] * 3
    alone, _, _ = tree_of(pair + [b"x"])
    among, _, _ = tree_of(pair + [b"the cat sat on the mat"] * 5000)
    assert alone.state[2] and among.state[2]  # "follows", after "rare pair"


def test_held_out_split_is_by_crc():
    assert hashlib.sha256(bytes(lm.held_out(i) for i in range(1000))).digest()
    assert 100 < sum(lm.held_out(i) for i in range(1000)) < 190 and lm.held_out(None) is False


def test_packed_keys_and_ranges():
    u = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    assert (lm.unpack_keys(lm.pack_keys(u)) == u).all() and len(lm.unpack_keys(lm.pack_keys(u[:0]))) == 0
    for parts in (1, 2, 64):
        cuts = list(lm._ranges(u, parts))
        assert [s for _, s, _ in cuts] == [0, *(e for *_, e in cuts[:-1])] and cuts[-1][2] == len(u)
        assert all((u[s:e] >> np.uint64(58)).astype(int).max() * parts // 64 == p for p, s, e in cuts)
    assert list(lm._ranges(u[:0], 1)) == list(lm._ranges(u[:0], 8)) == []
