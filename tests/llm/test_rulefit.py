import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import rulefit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """STATISTICS of a text, the long way."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    n, chars, of = max(1, len(w)), max(1, sum(map(len, w))), lambda s: sum(c in s for c in t)
    return {
        "log_words": math.log2(1 + len(w)), "mean_word": sum(map(len, w)) / n, "symbols": of("#*$%&|<>") / n, "bars": of("|") / n, "exclaims": of("!") / n, "ends": of(".!?") / n,
        "punctuation": of(",;:\"'()-") / n, "digits": of("0123456789") / chars, "capitals": sum(c.isupper() for c in t) / chars, "different": len(set(w)) / n, "repeated": len(twice) / n,
        "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "line_words": math.log2(1 + len(w) / max(1, len(lines))), "longest": math.log2(1 + max(map(len, w), default=0)),
    }


def test_statistics_against_plain_python(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "x", "A a A a A a", "É|!&& 12,5\n\nb.\nb.\n"] + ["".join(r.choice(["ab ", "C", "é", "\n", "! ", "| ", "$", "7", "d. ", "the cat sat "]) for _ in range(r.randint(1, 80))) for _ in range(40)]
    rows = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "id int, text string, n_words string")
    for row in rulefit.with_statistics(rows).collect():
        want = plain(texts[row.id])
        for k in rulefit.STATISTICS:
            assert row[k] == pytest.approx(want[k], abs=1e-12), (texts[row.id], k)


def said(rule, stats):
    return all((a is None or stats[k] > a) and (b is None or stats[k] <= b) for k, a, b in rule)


@pytest.fixture(scope="module")
def given(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, rulefit.fit(docs, labels.filter(~rulefit.held_out(F.col("doc_id"))))


def test_column_is_the_sum_of_rules_that_hold(given):
    docs, _, ensemble = given
    assert ensemble.weights
    some = docs.filter("doc_id % 40 = 0")
    for row in rulefit.score(some, ensemble).collect():
        stats = plain(row.text)
        total = ensemble.intercept + sum(w for rule, w in ensemble.weights.items() if said(rule, stats))
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and row.predicted == (row.score >= 0.3)


def test_held_out_accuracy(given):
    docs, labels, ensemble = given
    held = rulefit.score(docs, ensemble).join(labels.filter(rulefit.held_out(F.col("doc_id"))), "doc_id").toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.95 and (bad.predicted == 0).mean() >= 0.9
    assert good.score.median() > 0.8 > 0.2 > bad.score.median()


class Node:
    """A tree as the forest shows it: (feature, threshold, left, right) or None."""

    def __init__(self, tree):
        self.tree = tree

    def subtreeDepth(self):
        return 0 if self.tree is None else 1

    def split(self):
        return self

    def featureIndex(self):
        return self.tree[0]

    def threshold(self):
        return self.tree[1]

    def leftChild(self):
        return Node(self.tree[2])

    def rightChild(self):
        return Node(self.tree[3])


def test_paths_draw_bounds_together():
    tree = (0, 5.0, (0, 3.0, None, None), (1, 2.0, (0, 9.0, None, None), None))
    assert rulefit.paths(Node(tree), ["a", "b"]) == {
        (("a", None, 5.0),), (("a", None, 3.0),), (("a", 3.0, 5.0),), (("a", 5.0, None),), (("a", 5.0, None), ("b", None, 2.0)), (("a", 5.0, None), ("b", 2.0, None)),
        (("a", 5.0, 9.0), ("b", None, 2.0)), (("a", 9.0, None), ("b", None, 2.0)),
    }
    assert rulefit.paths(Node(None)) == set()


def test_best_cut():
    assert rulefit._best_cut([0.1, 0.9], [0, 3], [2, 3]) == pytest.approx(0.5)
    low = rulefit._best_cut([0.2, 0.5, 0.6, 0.8], [0, 1, 0, 5], [5, 1, 1, 5])
    assert 0.2 < low < 0.5
    assert rulefit._best_cut([0.4], [1], [2]) == 0.5


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    labels = lambda *rows: spark.createDataFrame(rows, "doc_id long, quality int")
    scores = lambda e: {r.doc_id: (r.score, r.predicted) for r in rulefit.score(docs, e).collect()}
    assert set(scores(rulefit.fit(docs, labels())).values()) == {(0.5, 1)}
    assert set(scores(rulefit.fit(docs, labels((1, 1), (2, 1), (None, 0), (3, None)))).values()) == {(1.0, 1)}
    assert set(scores(rulefit.fit(docs, labels((1, 0), (1, 1)))).values()) == {(0.0, 0)}
    two = rulefit.fit(docs, labels((1, 1), (3, 0)))
    assert all(0 <= s <= 1 for s, _ in scores(two).values())
    assert rulefit.score(docs.limit(0), two).count() == 0
    odd = docs.withColumn("n_words", F.lit("own")).withColumn("score", F.lit(9)).withColumn("symbols", F.lit("mine"))
    row = rulefit.score(odd, two).first()
    assert (row.n_words, row.symbols) == ("own", "mine") and 0 <= row.score <= 1
