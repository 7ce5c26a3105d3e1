import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash as s
from lodestone.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprint():
    for t in (None, "", " \t", "a", "One two", "A b C d e ÀÉ f", "x " * 5000, "tab\x0bsep\x0cok nb sp a b c"):
        assert s.simhash(t).tolist() == [brute_fingerprint(t)]
        wide = s.simhash(t, 4, 4).tolist()
        assert wide[0] == brute_fingerprint(t) and len(wide) == 4


@pytest.mark.parametrize("n,kind", [(1, "far"), (40, "far"), (700, "ball"), (900, "mixed")])
def test_index_finds_all_components(n, kind):
    rng = np.random.default_rng(n)
    if kind == "far":
        codes = rng.integers(0, 2**63, n, dtype=np.uint64)
    else:
        centres = rng.integers(0, 2**63, 1 if kind == "ball" else 60, dtype=np.uint64)
        codes = centres[rng.integers(0, len(centres), n)]
        for _ in range(5):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    codes = np.unique(codes)[:, None]
    for wide in (codes, np.hstack([codes ^ np.uint64(5), codes, codes // np.uint64(3)])):
        index = s.GrayIndex(wide)
        assert (wide[index.order] == index.codes).all()
        whole = [sum(int(x) << (64 * (wide.shape[1] - 1 - k)) for k, x in enumerate(r)) for r in index.codes]
        rank = lambda c: c ^ rank(c >> 1) if c else 0
        assert [rank(c) for c in whole] == sorted(rank(c) for c in whole)
        assert index.components().tolist() == brute_components(whole)


def test_keys():
    masks = s.exact_keys(4)
    rng = np.random.default_rng(3)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(int(m[0]) & flip == 0 for m in masks)
    for n in (2, 10**6, 10**10):
        masks = s.drawn_keys(n, 4)
        bits = [sum(int(x).bit_count() for x in m) for m in masks]
        assert min(bits) == max(bits) and n / 2 ** bits[0] <= s.BUCKET and (1 - s.SIMILAR ** bits[0]) ** len(masks) <= 1 - s.RECALL


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3)], "u long, v long")
    got = {r.u: r.root for r in connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 1, 201: 200}
    assert connected_components(e.limit(0)).count() == 0


def test_keep_one_per_group_where_ids_repeat(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(rng.choice(["v%d" % i for i in range(900)], 80)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, b), (None, a)]
    kept = s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, a), (1, a), (1, b), (2, c)])


def test_near_duplicates_small_blocks(spark):
    rng = np.random.default_rng(5)
    words = ["w%d" % i for i in range(500)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 3 else base[i % 12] + " tail%d" % i) for i in range(150)] + [(900, None), (901, ""), (902, "a"), (7, base[7]), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = s.near_duplicates(docs, block=8).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    lab = brute_components(fps)
    low = {}
    for (i, _), x in zip(rows, lab):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    want = sorted((i if i is not None else -1, "%016x" % f, low[x]) for (i, _), f, x in zip(rows, fps, lab))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want
    assert s.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_finds_near_copies(spark):
    """Texts that share 0.8 of their five-word shingles: of each group one stays; unlike texts all stay."""
    rng = np.random.default_rng(11)
    vocabulary = ["w%d" % i for i in range(2000)]
    rows, group, sets = [], {}, {}

    def shingles(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    for g in range(150):
        base = list(rng.choice(vocabulary, 150))
        for k in range(4):
            t = list(base)
            for p in rng.choice(150, 3, replace=False) if k else ():
                t[p] = "new%d" % rng.integers(10**6)
            i = 4 * g + k
            rows.append((i, " ".join(t)))
            group[i], sets[i] = g, shingles(t)
    rows += [(1000 + i, " ".join(rng.choice(vocabulary, 150))) for i in range(50)]
    docs = spark.createDataFrame(rows + [(None, rows[0][1]), (2000, None), (2001, "")], "doc_id long, text string").withColumn("_i", F.lit("x")).withColumn("fp", F.lit(1))
    got = s.keep_one(docs, block=64)
    kept = {r.doc_id for r in got.collect()}
    assert got.columns == docs.columns
    assert {1000 + i for i in range(50)} <= kept and {None, 2000} <= kept and 2001 not in kept
    assert {4 * g for g in range(150)} <= kept
    close = [4 * g + k for g in range(150) for k in (1, 2, 3) if len(sets[4 * g] & sets[4 * g + k]) >= 0.8 * len(sets[4 * g] | sets[4 * g + k])]
    assert len(close) > 400 and sum(i in kept for i in close) <= 0.03 * len(close)


def test_hot_fingerprints_are_spread(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    rows = [(i, "one text") for i in range(60)] + [(100 + i, f"other text {i}") for i in range(20)]
    got = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 80 and all(got[i] == 0 for i in range(60))
