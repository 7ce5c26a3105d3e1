import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import mixing as m


def corpus(n=600):
    r = random.Random(6)
    pools = {"clean": "river stone meadow cloud forest".split(), "junk": "buy### win$$$ click%%% cash###".split(), "toxic": "scum moron clown idiot".split()}
    docs, labels = [], []
    for i in range(n):
        kind = ("clean", "clean", "junk", "toxic")[i % 4]
        docs.append((i, " ".join(r.choice(pools[kind] if r.random() < 0.7 else pools["clean"]) for _ in range(r.randrange(20, 200)))))
        if i % 3:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 0, 1)], "doc_id long, quality int, toxic int")


def brute_rates(rows, share, total, cap, steps=3000):
    """Small plain gradient steps over Python lists, summed up before they are projected."""
    k = range(len(m.DOMAINS))
    gram = [[sum(t * p[i] * p[j] for t, p in rows) for j in k] for i in k]
    goal, at = [min(total * s, cap * sum(t * p[i] for t, p in rows)) for i, s in enumerate(share)], [0.0] * len(k)
    rates = lambda: [min(cap, max(0.0, 1.0 - sum(x * y for x, y in zip(at, p)))) for _, p in rows]
    for _ in range(steps):
        got = [sum(r * t * p[i] for r, (t, p) in zip(rates(), rows)) for i in k]
        g = m._solved(gram, [a - b for a, b in zip(got, goal)])
        at = [x + y - m.EASE * x for x, y in zip(at, g)]
    return rates()


@pytest.mark.parametrize("cap", [None, 1.0])
def test_rates_against_brute_force(spark, frames, cap):
    docs, labels = frames
    got = m.mix_rates(docs, labels, {"clean": 0.8, "junk": 0.15, "toxic": 0.05}, max_rate=cap).collect()
    rows = [(r.tokens, [r.p_clean, r.p_junk, r.p_toxic]) for r in got]
    have = sum(t * p[0] for t, p in rows)
    lead = m.LEAD if cap is None else 1.0
    want = brute_rates(rows, [0.8, 0.15, 0.05], lead * have / 0.8, float("inf") if cap is None else cap)

    def misfit(rates):
        goal = [lead * have / 0.8 * s for s in (0.8, 0.15, 0.05)]
        goal = goal if cap is None else [min(g, sum(t * p[i] for t, p in rows)) for i, g in enumerate(goal)]
        e = [sum(r * t * p[i] for r, (t, p) in zip(rates, rows)) - goal[i] for i in range(3)]
        gram = [[sum(t * p[i] * p[j] for t, p in rows) for j in range(3)] for i in range(3)]
        return sum(a * b for a, b in zip(e, m._solved(gram, e)))

    assert misfit([r.rate for r in got]) <= 1.05 * misfit(want) + 1e-3
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 for r in got)
    if cap is None:
        mix = [sum(r.rate * t * p[i] for r, (t, p) in zip(got, rows)) for i in range(3)]
        assert [round(x / sum(mix), 3) for x in mix] == [0.8, 0.15, 0.05]


def h64(values, seed=42):
    """Spark's xxhash64 of strings: each is hashed with the hash of those before as seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def features(text):
    return [h64([f]) % m.BUCKETS for f in {*words(text), *("\0" + w[-2:] for w in words(text))}]


def brute_posteriors(docs, labels):
    """The classifier in plain Python: [(id, tokens, posteriors)]."""
    worst = {}
    for i, q, t in labels:
        if i is not None:
            a, b = worst.get(i, (1, 0))
            worst[i] = min(a, 1 if q is None else q), max(b, t or 0)
    kind = {i: "toxic" if t == 1 else "junk" if q == 0 else "clean" for i, (q, t) in worst.items()}
    train = {}
    for i, text in docs:
        if i in kind:
            w = words(text)
            least = min(h64(w[k : k + 5], ) for k in range(len(w) - 4)) if len(w) >= 5 else h64(w)
            train[kind[i], least] = features(text)
    hits = {}
    for (d, _), fs in train.items():
        for f in fs:
            hits.setdefault(f, dict.fromkeys(m.DOMAINS, 0))[d] += 1
    total = {d: sum(h[d] for h in hits.values()) for d in m.DOMAINS}
    share = {d: (total[d] + 1e-9) / (sum(total.values()) + 3e-9) for d in m.DOMAINS}
    model = {}
    for f, h in hits.items():
        usual = {d: sum(h.values()) * share[d] for d in m.DOMAINS}
        more = {d: math.log((h[d] + m.SMOOTH) / (usual[d] + m.SMOOTH)) for d in m.DOMAINS}
        odds = [more[d] - more["clean"] if abs(more[d] - more["clean"]) >= m.LEAST_ODDS and (h[d] - usual[d]) ** 2 > m.SIGMAS**2 * (usual[d] + 1) else 0.0 for d in m.DOMAINS]
        if any(odds):
            model[f] = odds
    score = lambda fs: tuple(sum(model[f][k] for f in fs if f in model) / m.HEAT for k in range(len(m.DOMAINS)))
    prior = m.calibrated([(score(fs), 1) for fs in train.values()], [sum(d == x for d, _ in train) for x in m.DOMAINS])
    out = []
    for i, text in docs:
        logit = [p + x for p, x in zip(prior, score(features(text)))]
        e = [math.exp(x - max(logit)) for x in logit]
        out.append((i, len(words(text)), [x / sum(e) for x in e]))
    return out


def test_classifier_and_rates_against_plain_python(spark, frames):
    docs, labels = frames
    extra = [(5000, None), (5001, ""), (5002, "river win$$$ scum"), (5003, "river " * 9)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra + extra[2:]
    want = brute_posteriors(rows, [tuple(r) for r in labels.collect()])
    got = m.mix_rates(spark.createDataFrame(rows, "doc_id long, text string"), labels, {"clean": 0.8, "junk": 0.15, "toxic": 0.05}).collect()
    have = sum(t * p[0] for _, t, p in want)
    rates = brute_rates([(t, p) for _, t, p in want], [0.8, 0.15, 0.05], m.LEAD * have / 0.8, float("inf"))
    key = lambda r: (r[0], r[1], r[2])
    flat = sorted([(i, t, *p, r) for (i, t, p), r in zip(want, rates)], key=key)
    for x, y in zip(sorted([(r.doc_id, r.tokens, *(r[f"p_{d}"] for d in m.DOMAINS), r.rate) for r in got], key=key), flat, strict=True):
        assert x == pytest.approx(y, abs=5e-3)
    near = {r.domain: r for r in m.totals(spark.createDataFrame(got)).collect()}
    assert abs(near["clean"].mixed - m.LEAD * have) < 1e-3 * have


def test_chance_of_few_documents_stays_weak(spark):
    """Ten toxic documents in a language of a tenth of the clean ones must not make its clean documents toxic."""
    r = random.Random(9)
    tongue = [[f"{c}{i}" for i in range(300)] for c in "ab"]
    rows = [(i, " ".join(r.choice(tongue[i % 10 == 0]) for _ in range(150))) for i in range(1500)]
    labels = [(i, 1, int(i % 10 == 0 and i < 100)) for i in range(1500)]
    got = m.mix_rates(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_rate=1.0).collect()
    same = [x.p_toxic for x in got if x.doc_id >= 100 and x.doc_id % 10 == 0]
    assert sum(same) / len(same) < 0.1 and sum(p > 0.5 for p in same) <= 3
    assert all(x.p_clean > 0.95 for x in got if x.doc_id % 10)


def test_constants_against_their_meaning():
    groups = [((0.0, 5.0, 0.0), 300), ((0.0, -3.0, 9.0), 40), ((0.0, 0.0, 0.0), 660)]
    b = m.calibrated(groups, [900, 80, 20])
    got = [0.0] * 3
    for s, n in groups:
        e = [math.exp(x + y) for x, y in zip(b, s)]
        got = [g + n * x / sum(e) for g, x in zip(got, e)]
    assert got == pytest.approx([900, 80, 20], rel=2e-2)


def test_raises_where_rates_do_not_settle(spark, frames, monkeypatch):
    monkeypatch.setattr(m, "MAX_STEPS", 0)
    with pytest.raises(ValueError, match="settle in 0 steps"):
        m.mix_rates(*frames, {"clean": 0.8, "junk": 0.15, "toxic": 0.05}, max_rate=1.0)


@pytest.mark.parametrize("cap", [None, 1.0, 0.5])
def test_few_passes_settle_random_mixes(spark, cap):
    r = random.Random(11)
    rows = []
    for _ in range(300):
        e = [r.random() ** r.choice([1, 6]) for _ in m.DOMAINS]
        rows.append((float(r.choice([0, 5, 300, 20000])), [x / sum(e) for x in e]))
    shares = spark.createDataFrame(rows, "_tokens double, _p array<double>").withColumn("_key", F.monotonically_increasing_id()).cache()
    for share in ([0.97, 0.02, 0.01], [0.1, 0.1, 0.8], [1.0, 0.0, 0.0]):
        have = [sum(t * p[i] for t, p in rows) for i in range(3)]
        lead = max(range(3), key=lambda i: share[i])
        total = (m.LEAD if cap is None else 1.0) * have[lead] / share[lead]
        got = [x.rate for x in m.fit_rates(shares, dict(zip(m.DOMAINS, share)), None, cap).orderBy("_key").collect()]
        goal = [total * s if cap is None else min(total * s, cap * h) for s, h in zip(share, have)]
        gram = [[sum(t * p[i] * p[j] for t, p in rows) for j in range(3)] for i in range(3)]

        def cost(rates):
            e = [sum(x * t * p[i] for x, (t, p) in zip(rates, rows)) - goal[i] for i in range(3)]
            return sum(a * b for a, b in zip(e, m._solved(gram, e))) / m.EASE + sum(t * (x - 1) ** 2 for x, (t, _) in zip(rates, rows))

        # no small change of any rates is better
        best = cost(got)
        for _ in range(200):
            other = [min(cap or 99.0, max(0.0, x + r.choice([0, 0, 0, 1e-3, -1e-3]))) for x in got]
            assert cost(other) >= best - 1e-6 * max(1.0, best)


def test_held_out_posteriors(spark, frames):
    docs, labels = frames
    unseen = m.mix_rates(docs, labels).filter("doc_id % 3 = 0").collect()
    kinds = ("clean", "clean", "junk", "toxic")
    right = sum(max(m.DOMAINS, key=lambda d: r[f"p_{d}"]) == kinds[r.doc_id % 4] for r in unseen)
    assert len(unseen) == 200 and right >= 190


def test_apply_keeps_clean_rows_and_columns(spark, frames):
    docs, labels = frames
    names = ["rate", "_copy", "_h", "_n", "_id", "_i", "_all"]
    out = m.apply_mix(docs.select("*", *[F.lit("clash").alias(c) for c in names]), labels)
    assert out.columns == ["doc_id", "text", *names] and out.filter("_h = 'clash' AND _n = 'clash'").count() == out.count()
    left = {r.doc_id for r in out.collect()}
    assert {i for i in range(600) if i % 4 < 2} <= left and len(left) < 400


def test_repeated_rows_count_and_score_once_each(spark, frames):
    docs, labels = frames
    docs = docs.cache()
    more = docs.unionByName(docs.filter("doc_id < 90")).unionByName(docs.filter("doc_id < 90"))
    got = m.mix_rates(more, labels, {"clean": 0.8, "junk": 0.15, "toxic": 0.05}).collect()
    assert len(got) == 780
    alone = {r.doc_id: r for r in m.with_posteriors(docs.selectExpr("struct(doc_id AS id) AS _key", "text"), m.fit_domains(more, labels)).selectExpr("_key.id AS doc_id", "_tokens", "_p").collect()}
    for r in got:
        assert [r.p_clean, r.p_junk, r.p_toxic] == pytest.approx(alone[r.doc_id]._p) and r.tokens == alone[r.doc_id]._tokens
    assert all(len({round(r.rate, 9) for r in got if r.doc_id == i}) == 1 for i in range(90))
    mix = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) for d in m.DOMAINS]
    assert [round(x / sum(mix), 3) for x in mix] == [0.8, 0.15, 0.05]
    out = m.apply_mix(more, labels).groupBy("doc_id").count().collect()
    assert all(r["count"] == (3 if r.doc_id < 90 else 1) for r in out)


def test_edges(spark, frames):
    docs, labels = frames
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "river"), (3, "river " * 50000), (4, "x"), (4, "x"), (4, "y")], "doc_id long, text string")
    got = m.mix_rates(odd, labels.limit(0)).collect()
    assert len(got) == 7
    assert all(r.p_clean > 0.99 for r in got) and {r.tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert m.apply_mix(odd, labels.limit(0)).count() == 7
    assert m.apply_mix(odd.limit(0), labels).count() == 0
    assert m.mix_rates(odd.limit(0), labels.limit(0)).count() == 0
