import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as x

BAD = ["scoundrel", "blighter", "nitwit"]


def corpus(n=900):
    r = random.Random(4)
    plain = ["plain%d" % i for i in range(200)]
    rows = []
    for i in range(n):
        words, toxic = [r.choice(plain) for _ in range(r.randrange(5, 60))], int(i % 5 == 0)
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        elif i % 7 == 0:
            words += ["lovable", "blighter"]
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_accuracy(spark, frames):
    docs, labels = frames
    lex = x.fit(docs, labels.filter(~x.held_out(F.col("doc_id"))))
    got = x.score(docs, lex).withColumn("h", x.held_out(F.col("doc_id"))).join(labels, "doc_id").filter("h AND toxic IS NOT NULL").collect()
    assert len(got) > 100 and all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.99 * len(got)
    assert lex.weights.get(" iovabie  biighter ") == 0  # i and l fold together


def test_disguise_exceptions_and_edges(spark, frames):
    docs, labels = frames
    lex = x.fit(docs, labels)
    rows = [(1, "you n1tw1t"), (2, "you nіtwіt!"), (3, "a SCOUNDREL."), (4, "the lovable blighter"), (5, ""), (6, None), (7, "sc​oundrel blighter"), (8, "plain1 " * 30000 + "nitwit"), (9, "unitwits scoundre")]
    got = {r.doc_id: r for r in x.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("c")), lex).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 7)] == [1, 1, 1, 1]
    assert [got[i].score for i in (4, 5, 6)] == [0.0, 0.0, 0.0]
    assert 0 < got[8].score < got[1].score and got[9].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert x.reject_toxic(docs, labels).columns == docs.columns


def test_matching_is_brute_force(frames):
    """The longest match at the leftmost place, without overlap, found by trying every pattern at every place."""
    lex = x.Lexicon({" ab ": 2.0, " abc": 3.0, " x  ab ": 0.0, " x ": 1.0}, 1.0)
    auto, r = lex.matcher(), random.Random(2)
    for _ in range(300):
        text = " ".join(r.choice(["ab", "abc", "abcd", "x", "q"]) for _ in range(r.randrange(0, 8)))
        wide, i, total = lex.spread(text), 0, 0.0
        while i < len(wide):
            hits = [p for p in lex.weights if wide.startswith(p, i)]
            if hits:
                best = max(hits, key=len)
                total, i = total + lex.weights[best], i + len(best)
            else:
                i += 1
        assert lex.raw(auto, text) == pytest.approx(total / lex.norm(wide.count("  ") + 1))


def test_no_labels(spark, frames):
    docs, labels = frames
    assert {r.score for r in x.score(docs, x.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert x.score(docs.limit(0), x.Lexicon()).count() == 0


def test_every_candidate_is_weighed(spark):
    """More ordinary words than any former bound, each in more toxic documents than the word that tells; more exceptions too."""
    plain = ["".join(w) for w in itertools.product("abcdefgh", repeat=5)][:20_500]
    r, rows = random.Random(3), []
    for i in range(72):
        words, toxic = plain[:], int(i < 12)
        if toxic:
            r.shuffle(words)
            words += ["blighter", plain[i]]
            if i < 6:
                words += ["scoundrel", plain[i]]
        elif i < 18:
            words = [x for w in plain[:5_200] for x in (w, "blighter")] + plain[5_200:]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    lex = x.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    assert lex.weights[" scoundrei "] > 0 and lex.weights[" biighter "] > 0
    assert all(lex.weights[f" {w}  biighter "] == 0 for w in plain[:5_200])
    assert not any(w in lex.weights for w in (f" {p} " for p in plain))


def test_rejecting_keeps_the_callers_columns(spark, frames):
    docs, labels = frames
    clash = docs.selectExpr("*", "'mine' AS _all", "'mine' AS score", "'mine' AS _raw")
    out = x.reject_toxic(clash, labels)
    assert out.columns == clash.columns and 0 < out.count() == out.filter("_all = 'mine' AND score = 'mine' AND _raw = 'mine'").count()
