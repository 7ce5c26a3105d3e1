import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win, cov = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if win[w[i], w[i + 1], w[i + 2]] > 1:
            cov.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c a b c", "x\ny\nx\n \n\nx", "# * $ % & | < >", "é ü\x0bñ\x0c日本 語\x85 x", "one two three one two four one two three", "a a a a a a", "w " * 4000 + "end"]


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_words", "'y' AS kept")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.with_counts(docs).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)


def test_verdicts(spark):
    good = " ".join("word%d" % i for i in range(90))
    rows = [(i, good + f" x{i}", lang, "s") for i, lang in enumerate(["en", "de", None, "en", "en", "en"])]
    rows += [(100, " ".join("w%d###" % i for i in range(80)), "en", "s"), (101, "short", "en", "t"), (102, None, "en", None), (103, good, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = q.with_counts(docs)
    got = {r.doc_id: r.kept for r in q.judge(counts, q.fit_thresholds(counts)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 100: False, 101: False, 102: False, 103: True}
    names = ["n_words", "kept", "base_failed", "_words", "_lines", "_win", "_at", "_pos", "_all"]
    clash = docs.select("*", *[F.lit("mine").alias(n) for n in names])
    kept = q.filter_quality(clash)
    assert kept.columns == clash.columns and kept.filter("n_words = 'mine' AND _pos = 'mine'").count() == 7
    assert q.filter_quality(docs).columns == docs.columns
    assert q.filter_quality(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = c.execute(q.ORACLE_SQL)
    cols = [x[0] for x in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r)) for r in q.query(spark, d).select(*cols).collect()) == want


def test_fences_follow_the_group(spark):
    """Where a quarter of a group is rich in symbols its symbols stay; elsewhere they go; repeated words act below the base rule."""
    def text(i, mark="", again=0):
        return " ".join(f"w{i:03}x{k:02}{mark}" for k in range(100)) + " " + "same old words " * again

    rows = [(i, text(i, "##" if i % 2 else ""), "en", "code") for i in range(300)]
    rows += [(1000 + i, text(i, "##" if i < 3 else ""), "en", "prose") for i in range(300)]
    rows += [(2000, text(0, again=22), "en", "prose"), (2001, text(1, again=10), "en", "prose")]
    kept = {r.doc_id for r in q.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {i for i in range(300)} | {1000 + i for i in range(3, 300)} | {2001}
