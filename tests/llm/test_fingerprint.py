import hashlib
import random

import pytest

from lodestone.llm import fingerprint as f


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_spans_and_extensions():
    r = random.Random(1)
    for _ in range(60):
        a, b = ("".join(r.choice("abé日") for _ in range(r.randrange(0, 40))) for _ in range(2))
        x, y = f.PrefixHash(a), f.PrefixHash(b)
        for _ in range(20):
            i, j = r.randrange(len(a) + 1), r.randrange(len(b) + 1)
            assert x.extension(i, y, j) == common(a[i:], b[j:])
            assert x.extension(i, y, j, back=True) == common(a[:i][::-1], b[:j][::-1])


def residues(t):
    return [sum((ord(c) + 1) * pow(b, k, p) for k, c in enumerate(t)) % p for p, b in zip(f.PRIMES, f.BASES)]


def brute_level(window):
    x, full = residues(window)[0], (1 << 64) - 1
    x = (x ^ (x >> 15)) * 0xBF58476D1CE4E5B9 & full
    x ^= x >> 31
    return 64 if not x else (x & -x).bit_length() - 1


def brute_print(text):
    """As documented, from whole prefixes and windows."""
    n, level = len(text), f.LEAST_LEVEL
    known = {}
    at = [(i, known.setdefault(w, brute_level(w))) for i in range(n - f.WINDOW + 1) for w in [text[i : i + f.WINDOW]]]
    while len(keep := [(i, k) for i, k in at if k >= level]) > f.ANCHORS:
        level += 1
    marks = [a << 31 | b for a, b in (residues(text[:i]) for i in [i for i, _ in keep] + [n])]
    return f"{n:x}.{level:x}.{''.join('%08x' % i for i, _ in keep)}.{''.join('%02x' % k for _, k in keep)}.{''.join('%016x' % m for m in marks)}"


@pytest.mark.parametrize("text", ["", "a", "ab", "é" * 33, "hello world " * 20, "日本" * 500, "".join(map(chr, range(40, 9000)))])
def test_fingerprint(text):
    p = f.Fingerprint.of(f.PrefixHash(text))
    assert str(p) == brute_print(text) and str(f.Fingerprint.parse(str(p))) == str(p)
    for cut in {0, len(text) // 3, len(text)}:
        joined = f.Joined(f.PrefixHash(text), cut, f.PrefixHash(text[cut:] + "xyz"), len(text) - cut)
        assert str(f.Fingerprint.of(joined)) == str(p)


def test_likeness():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    a = " ".join(word() for _ in range(300))
    b = " ".join(word() for _ in range(300))
    stored = lambda x, y: f.Fingerprint.of(f.PrefixHash(x)).likeness(f.Fingerprint.of(f.PrefixHash(y)))

    def like(x, y):
        p, q = f.PrefixHash(x), f.PrefixHash(y)
        n = f.Fingerprint.of(p).likeness(f.Fingerprint.of(q), p, q)
        assert stored(x, y) <= n
        return n

    assert like(a, a) == 1 and like("", "") == 1 and like("", "a") == 0
    assert like(a, b) < 0.05
    h = len(a) // 2
    assert 0.45 <= like(a, a[: len(a) - h] + b[:h]) <= 0.55
    assert 0.99 <= like(a, a[:700] + "Q" + a[701:]) < 1
    assert 0.99 <= like(a, a[:700] + "inserted" + a[700:]) < 0.999
    assert like(a, a[:-1]) < 1 and abs(like(a, b) - like(b, a)) < 0.02
    for size in (300, 3000, 21000):
        t = " ".join(word() for _ in range(size // 7))
        assert 0.98 <= like(t, "x" + t + "yz") < 1
        two = "pre" + t[: size // 5] + "++" + t[size // 5 : size // 2] + "inserted" + t[size // 2 :] + "post"
        assert like(t, two) >= 0.93 and (size < 3000 or stored(t, two) >= 0.7)
        assert like(t, t[size // 2 :] + t[: size // 2]) >= 0.95  # moved blocks are alike
    assert like(a, a + a) <= 0.51 and like(a + a, a) <= 0.51  # no part counts twice
    assert like("x" * 500, "x" * 400) >= 0.79


def test_likeness_against_brute_force():
    """Never above what any pairing of common blocks could cover, never below the common beginning and end."""
    r = random.Random(4)
    for _ in range(80):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(1, 400)))
        b = list(a)
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(0, 3)] = r.choice("xyz") * r.randrange(0, 3)
        b = "".join(b)
        x, y = f.PrefixHash(a), f.PrefixHash(b)
        got = f.Fingerprint.of(x).likeness(f.Fingerprint.of(y), x, y)
        whole = max(len(a), len(b))
        if a == b:
            assert got == 1
            continue
        ends = min(common(a, b) + common(a[::-1], b[::-1]), len(a), len(b))
        in_common = sum(min(a.count(c), b.count(c)) for c in set(a))
        assert min(ends, whole - 1) / whole - 1e-9 <= got <= min(in_common, whole - 1) / whole + 1e-9


def test_frames(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab cé") for _ in range(r.randrange(0, 90)))) for i in range(60)]
    rows += [(500, None), (500, "tie one"), (500, "tie two"), (7, rows[7][1]), (None, "last one"), (-4, "low " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS bucket", "'x' AS fingerprint")
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        x, y, z = map(f.PrefixHash, (t, e, nxt))
        a, b, c = map(f.Fingerprint.of, (x, y, z))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_print(t), brute_print(e), a.likeness(b, x, y), a.likeness(c, x, z)))
    got = [tuple(x) for x in f.compare_with_edits(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert f.compare_with_edits(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    assert [(x.near_next, x.n_chars) for x in f.compare_with_edits(one).collect()] == [(1.0, 4)]
    assert {(x.doc_id, x.fingerprint) for x in f.fingerprints(docs).collect()} == {(i, brute_print(t or "")) for i, t in rows}


@pytest.mark.parametrize("n", [300, 3_000, 30_000])
@pytest.mark.parametrize("share", [0.01, 0.02, 0.05])
def test_scattered_edits_whatever_the_length(n, share):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    a = [word() for _ in range(n)]
    b = [word() if r.random() < share else w for w in a]
    true = 1 - 6 * sum(x != y for x, y in zip(a, b)) / (7 * n - 1)
    x, y = f.PrefixHash(" ".join(a)), f.PrefixHash(" ".join(b))
    got = f.Fingerprint.of(x).likeness(f.Fingerprint.of(y), x, y)
    assert true - 0.05 < got <= true + 0.005
    other = f.PrefixHash(" ".join(word() for _ in range(n)))
    assert f.Fingerprint.of(x).likeness(f.Fingerprint.of(other), x, other) < 0.02


def test_edits_beside_moves_and_repeats():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    first, second = [word() for _ in range(2_000)], [word() for _ in range(2_000)]
    first[500:500] = ["again"] * 300
    moved = f.PrefixHash(" ".join(second + ["new"] * 3 + first))
    whole = f.PrefixHash(" ".join(first + second))
    got = f.Fingerprint.of(whole).likeness(f.Fingerprint.of(moved), whole, moved)
    assert 0.45 < got < 1
    assert f._in_order([5, 1, 2, 9, 3]) == [1, 2, 4] and f._in_order([]) == []
