"""Mixing towards target weights over soft domains, in DataFrame functions only.

A naive Bayes classifier over hashed words and word endings, counted from labelled documents, gives every document a posterior per domain
(domains: `clean`, `junk` for quality 0, `toxic` for toxic 1). The document's share in a domain is its posterior times its
tokens (words). Projected-gradient least squares then fits one rate per document, not negative and at most `max_rate`, so
that the expected token totals of the domains come near `total` x target weight:

    minimise over r:  e' W e / EASE + sum_d t_d (r_d - 1)^2,  e_k = sum_d r_d t_d p_dk - T_k,  0 <= r_d <= max_rate,
    W the inverse of sum_d t_d p_d p_d'

(t_d: tokens, p_d: posteriors). The second term picks, of all rates that meet the totals, those nearest to 1. Gradients are summed
up before they are projected, so a document's rate is r_d = max(0, min(max_rate, 1 - m p_d)) with one number m_k per domain, and
documents of equal posteriors have equal rates whatever their length. A step scales the gradient by the curvature of the
documents whose rates aren't at a bound, and tries several lengths of it in the same pass, which is one aggregation over the
documents to a few numbers a domain. About ten passes do; if the totals aren't settled after MAX_STEPS, that is an error. Where rates are capped, no domain is aimed at more than all its tokens at
that rate, and totals come as near as the caps allow, which `totals` reports.

At most about MAX_TRAIN labelled documents, picked by a hash of the id, train the classifier (a documented bound). Of
labelled documents of one domain whose five-word windows share their least hash (exact and most near copies) one trains, so
that a text with many copies teaches once. Posteriors, totals and rates cover every document and whole texts.

Cases: null and empty texts have no tokens and the prior as posterior; labels with a null
id are ignored, a null quality counts as 1 and a null toxic as 0, of several labels of an id the worst counts; without
labels every document is `clean`; repeated rows get a row each with equal rates, and each counts in the totals; an empty table
gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

DOMAINS = ("clean", "junk", "toxic")
TARGETS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}
MAX_TRAIN = 50_000
#: Hash buckets of features, hits added to those of a bucket and to its usual ones, and the least log-odds and standard deviations
#: that count.
BUCKETS, SMOOTH, LEAST_ODDS, SIGMAS = 1 << 24, 2.0, 1.2, 5.0
#: Rows up to which the model, and the rows whose copies differ from one, are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
MAX_STEPS, TOLERANCE, EASE = 40, 1e-7, 1e-4
#: Lengths of a step that one pass tries.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.01)
#: Where rates have no cap: how much more than the tokens that are there the leading domain is aimed at.
LEAD = 1.02
HEAT = 2.0


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit("toxic")).when(quality == 0, F.lit("junk")).otherwise(F.lit("clean"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _features(words: str) -> Column:
    """The different words of an array column, and the different endings (two characters) of its words."""
    return F.concat(F.array_distinct(words), F.array_distinct(F.transform(words, lambda w: F.concat(F.lit("\x00"), F.right(w, F.lit(2))))))


def fit_domains(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The classifier as a table: bucket and, per domain, the log-odds of its features against
    `clean` (only buckets that tell; a bucket that does has several hits); and in a row with bucket null the domains' constants."""
    flat = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    n = max(1, flat.count())
    picked = flat.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_train).select(F.col("doc_id").alias("_id"), domain_of(F.col("q"), F.col("t")).alias("_domain"))
    listed = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_domain", words_of(F.col("text")).alias("_w"))
    # exact and most near copies of a text share the least hash of its five-word windows; they teach once
    least = F.expr("if(size(_w) < 5, xxhash64(_w), array_min(transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]))))")
    train = cut(listed.select(F.struct("_domain", least.alias("least")).alias("_doc"), "_domain", _features("_w").alias("_f")).dropDuplicates(["_doc"]))
    words = train.select("_domain", F.explode("_f").alias("w")).select("_domain", _bucket(F.col("w")).alias("bucket"))
    hits = [F.count_if(F.col("_domain") == d).cast("double").alias(d) for d in DOMAINS]
    counts = cut(words.groupBy("bucket").agg(*hits))
    total = counts.agg(*[F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    size = train.agg(*hits).first()
    share = {d: (total[d] + 1e-9) / (sum(total) + 3e-9) for d in DOMAINS}
    # how much more often than usual a domain hits a bucket, against clean; SMOOTH hits at the usual rate draw it towards 0, so
    # what the few documents of a rare domain have in common by chance (their language, say) stays weak
    usual = {d: sum((F.col(x) for x in DOMAINS), F.lit(0.0)) * share[d] for d in DOMAINS}
    more = {d: F.log((F.col(d) + SMOOTH) / (usual[d] + SMOOTH)) for d in DOMAINS}
    odds = {d: more[d] - more["clean"] for d in DOMAINS}
    # a bucket tells only where its hits are far from the usual number, else rare domains collect chance
    far = {d: F.pow(F.col(d) - usual[d], 2) > SIGMAS**2 * (usual[d] + 1) for d in DOMAINS}
    telling = [F.when((F.abs(x) >= LEAST_ODDS) & far[d], x).otherwise(0.0).alias(d) for d, x in odds.items()]
    strength = F.greatest(*[F.abs(F.col(d)) for d in DOMAINS])
    table = cut(counts.select("bucket", *telling).filter(strength > 0))
    # words aren't independent, so sums of log-odds exaggerate; each domain's constant is set so that the posteriors of the
    # training documents add up to its documents
    each = train.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode_outer("_f").alias("w")).select("_row", _bucket(F.col("w")).alias("bucket"))
    sums = each.join(_small(table), "bucket", "left").groupBy("_row").agg(*[F.round(F.coalesce(F.sum(d), F.lit(0.0)), 2).alias(d) for d in DOMAINS])
    groups = sums.groupBy(*DOMAINS).agg(F.count(F.lit(1)).alias("n")).collect()  # MAX_TRAIN rows at most, far fewer as a rule
    constants = calibrated([(tuple(r[d] / HEAT for d in DOMAINS), r.n) for r in groups], [size[d] or 0.0 for d in DOMAINS])
    prior = docs.sparkSession.createDataFrame([(None, *(constants if groups else [0.0 if d == "clean" else -99.0 for d in DOMAINS]))], "bucket int, " + ", ".join(f"{d} double" for d in DOMAINS))
    return cut(table.unionByName(prior))


def calibrated(groups: list[tuple[tuple[float, ...], int]], sizes: list[float], steps: int = 500) -> list[float]:
    """A constant per domain (0 for the first) that makes the posteriors of (scores, documents) groups add up to the domains'
    documents, half a document added to each."""
    b = [math.log((n + 0.5) / (sizes[0] + 0.5)) for n in sizes]
    for _ in range(steps):
        got = [0.5] * len(b)
        for scores, n in groups:
            logit = [x + y for x, y in zip(b, scores)]
            e = [math.exp(x - max(logit)) for x in logit]
            for k, x in enumerate(e):
                got[k] += n * x / sum(e)
        move = [math.log((n + 0.5) / g) for n, g in zip(sizes, got)]
        b = [x + y - move[0] for x, y in zip(b, move)]
        if max(map(abs, move)) < 1e-4:
            break
    return b


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_posteriors(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(_key, _tokens, _p) per row, also of rows that repeat a key: number of words and posteriors in the order of DOMAINS. `docs`: _key, text.. HEAT keeps the posteriors soft, since
    neighbouring words aren't independent."""
    # the count comes before the explode, or else it would be made again for every word
    listed = docs.select("_key", F.monotonically_increasing_id().alias("_row"), words_of(F.col("text")).alias("_w")).select("_key", "_row", F.size("_w").alias("_tokens"), _features("_w").alias("_w"))
    words = listed.select("_key", "_row", "_tokens", F.explode_outer("_w").alias("w"))
    prior = model.filter("bucket IS NULL").first()
    table = _small(model.filter("bucket IS NOT NULL"))
    scored = words.select("_key", "_row", "_tokens", _bucket(F.col("w")).alias("bucket")).join(table, "bucket", "left")
    # a row's words are made in one task, so the partial sums before the shuffle are its whole sums
    sums = scored.groupBy("_key", "_row").agg(F.max("_tokens").cast("double").alias("_tokens"), *[F.sum(d).alias(d) for d in DOMAINS])
    logit = [F.lit(prior[d]) + F.coalesce(F.col(d), F.lit(0.0)) / HEAT for d in DOMAINS]
    top = F.greatest(*logit)
    e = F.array(*[F.exp(x - top) for x in logit])
    soft = sums.select("_key", "_tokens", e.alias("_e"))
    return soft.select("_key", "_tokens", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).alias("_p"))


def _solved(g: list[list[float]], b: list[float]) -> list[float]:
    """x with g x = b by elimination, for one row and column per domain."""
    n = len(b)
    m = [[*row, y] for row, y in zip(g, b)]
    for i in range(n):
        at = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[at] = m[at], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] for i in range(n)]


def fit_rates(shares: DataFrame, targets: dict[str, float], total: float | None = None, max_rate: float | None = None) -> DataFrame:
    """Append `rate` to (_key, _tokens, _p). total: expected tokens of the mix; None: as many as let every token of the
    domain with the largest target stay, so that its documents aren't thinned (LEAD times as many where rates have no cap)."""
    k = range(len(DOMAINS))
    part = [F.col("_tokens") * F.col("_p")[i] for i in k]
    sums = shares.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in part], *[F.coalesce(F.sum(part[i] * F.col("_p")[j]), F.lit(0.0)) for i in k for j in k]).first()
    have, gram = sums[: len(DOMAINS)], [list(sums[len(DOMAINS) * (i + 1) : len(DOMAINS) * (i + 2)]) for i in k]
    weight_sum = sum(targets.values())
    share = [targets.get(d, 0.0) / weight_sum for d in DOMAINS]
    if total is None:
        lead = max(k, key=lambda i: share[i])
        total = (LEAD if max_rate is None else 1.0) * have[lead] / share[lead]
    # a capped domain can't give more than it has: its goal is no more, or its lack would weigh on the others
    goal = [total * s if max_rate is None else min(total * s, max_rate * h) for s, h in zip(share, have)]
    cap = F.lit(float("inf") if max_rate is None else float(max_rate))
    ridge = 1e-9 * max(gram[i][i] for i in k) or 1.0
    eased = [[EASE * gram[i][j] + (ridge if i == j else 0.0) for j in k] for i in k]

    def rate(m: list[float]) -> Column:
        return F.greatest(F.lit(0.0), F.least(cap, 1.0 - sum((m[i] * F.col("_p")[i] for i in k), F.lit(0.0))))

    def passed(tried: list[list[float]]) -> list[tuple[float, list[float], list[list[float]]]]:
        """(value, what is left to do, curvature) of each m tried, from one pass: the value is what the best m has the least of."""
        columns = []
        for m in tried:
            r, z = rate(m), 1.0 - sum((m[i] * F.col("_p")[i] for i in k), F.lit(0.0))
            free = F.when((z >= 0.0) & (z <= cap), 1.0).otherwise(0.0)
            columns += [F.sum(F.col("_tokens") * (r * z - r * r / 2)), *[F.sum(r * x) for x in part], *[F.sum(free * part[i] * F.col("_p")[j]) for i in k for j in k if i <= j]]
        row, out = [x or 0.0 for x in shares.agg(*columns).first()], []
        for m in tried:
            value, got, upper, row = row[0], row[1 : 1 + len(k)], iter(row[1 + len(k) :]), row[1 + len(k) + len(k) * (len(k) + 1) // 2 :]
            pull = [sum(eased[i][j] * m[j] for j in k) for i in k]
            curve = [[0.0] * len(k) for _ in k]
            for i in k:
                for j in k[i:]:
                    curve[i][j] = curve[j][i] = next(upper) + eased[i][j]
            out.append((value + sum(m[i] * (goal[i] + pull[i] / 2) for i in k), [got[i] - goal[i] - pull[i] for i in k], curve))
        return out

    m = [0.0] * len(k)
    value, left, curve = passed([m])[0]
    for _ in range(MAX_STEPS):
        if max(map(abs, left)) <= TOLERANCE * max(total, 1.0):
            break
        step = _solved(curve, left)
        tried = [[x + length * y for x, y in zip(m, step)] for length in LENGTHS]
        (value, left, curve), m = min(zip(passed(tried), tried), key=lambda t: t[0][0])
    else:
        if max(map(abs, left)) > TOLERANCE * max(total, 1.0):
            raise ValueError(f"rates don't settle in {MAX_STEPS} steps: totals miss their goals {goal} by {left}")
    return shares.withColumn("rate", rate(m))


def totals(rates: DataFrame) -> DataFrame:
    """Expected tokens per domain of a mix: what mix_rates() gave, summed."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), (F.col("tokens") * F.col(f"p_{d}")).alias("t")) for d in DOMAINS])).alias("d")
    return rates.select("rate", each).groupBy("d.domain").agg(F.sum("d.t").alias("tokens"), F.sum(F.col("rate") * F.col("d.t")).alias("mixed"))


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies for a rate (to hundredths, so that rates which end just short of their cap lose nothing): the integer part,
    and one more with the fraction as probability, by a hash of the key."""
    rate = F.round(rate, 2)
    u = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, max_rate: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> and rate of every row of `docs` (rows that repeat an id and text have equal rates, and each counts)."""
    model = fit_domains(docs, labels)
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    narrow = cut(with_posteriors(docs.select(key.alias("_key"), "text"), model))
    rated = fit_rates(narrow, targets, total, max_rate)
    return rated.select(F.col("_key.id").alias("doc_id"), F.col("_key.h").alias("_h"), F.col("_tokens").cast("long").alias("tokens"), *[F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, max_rate: float | None = 1.0) -> DataFrame:
    """`docs` with each row as often as its rate says."""
    rates = mix_rates(docs, labels, targets, total, max_rate)
    n = rates.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), copies_of(F.col("rate"), F.col("doc_id")).alias("_n")).filter("_n <> 1")
    n = cut(n.groupBy("_id", "_hh").agg(F.max("_n").alias("_n")))  # rows that repeat an id and text meet one
    whole = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"))
    # most documents stay once, so texts meet only the others
    joined = whole.join(_small(n), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return joined.filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix_rates(docs, table(spark, sf_dir, "labels")).drop("_h")
