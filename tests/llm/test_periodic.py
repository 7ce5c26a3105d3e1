import hashlib
import random
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic


def brute(w):
    """Every stretch of every period, kept where no smaller period fits it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(w):
    return periodic.find_runs(periodic.numbered(w))


def test_random_texts_with_planted_runs():
    r = random.Random(5)
    for _ in range(1500):
        letters = [str(k) for k in range(r.choice([1, 2, 3, 8, 40]))]
        w = [r.choice(letters) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            base = [r.choice(letters) for _ in range(r.randint(1, 20))]
            at, m = r.randint(0, len(w)), r.randint(0, 90)
            w[at : at + m] = (base * m)[:m]
        assert found(w) == brute(w), w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=8), st.integers(0, 2))
def test_powers_of_powers(counts, tail):
    w = []
    for c in counts:
        w = (w + ["x"] * c + ["y"] * (c % 2)) * (c % 5 + 1)
        w = w[:200]
    w += ["z"] * tail
    assert found(w) == brute(w)


def test_long_texts_stay_fast():
    assert found(["a"] * 50_000) == [(0, 50_000, 1)]
    assert found([str(i % 9_000) for i in range(50_000)]) == [(0, 50_000, 9_000)]
    assert len(found((["a"] * 10 + ["b"]) * 4_000)) == 4_001


def test_least_periods():
    with pytest.raises(ValueError):
        periodic.find_runs(periodic.numbered(["a"] * 9), least_periods=3)
    w = ["a", "b"] * 4
    assert found(w) == [(0, 8, 2)] and periodic.find_runs(periodic.numbered(w), least_periods=5) == []


def plain(doc_id, text):
    w = periodic.split_words(text)
    n, h = len(w), crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, gone = brute(w), set()
    for s, k, q in runs:
        gone |= set(range(s + q, s + k))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_plain_python(spark, tmp_path):
    r = random.Random(2)
    docs = [(k, " \t".join(r.choice("abcdefgh") + r.choice(["", "é", "\x1c"]) for _ in range(r.choice([0, 1, 5, 60, 150])))) for k in range(200)]
    docs += [(1_000, None), (1_001, ""), (1_002, " \n\t"), (7, docs[7][1]), (1_003, "x " * 40), (None, "x " * 40), (1_004, "a b\x0bc\x0cd\xa0e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, periodic.query(spark, str(tmp_path)).collect()), key=str)
    want = sorted((plain(*d) for d in docs), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 3


def test_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("t", 1, "u u u u u u v", None)], "start string, id int, body string, `odd name` string")
    out = periodic.with_runs(rows, "body")
    assert out.columns == ["id", "body", "odd name", "n_runs", "start", "length", "period", "runs", "collapsed"]
    assert tuple(out.first())[:7] == (1, "u u u u u u v", None, 1, 0, 6, 1) and out.first().collapsed == "u v"
    assert periodic.with_runs(rows.limit(0), "body").count() == 0
    assert periodic.with_runs(rows.filter("id = 2"), "body").schema == out.schema
