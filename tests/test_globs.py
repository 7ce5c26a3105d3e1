from pyspark.sql import functions as F

from lodestone.functions.text import glob_matches, plain_path
from lodestone.operators import host


def test_globs(spark):
    cases = [
        ("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/b/a.rs", False), ("src/**/a.rs", "src/a.rs", True), ("src/**/a.rs", "src/x/y/a.rs", True), ("**", "any/where", True), ("src/**", "src", True),
        ("a?.rs", "ab.rs", True), ("a?.rs", "a.rs", False), ("a.rs", "axrs", False), ("a(1)+[b].rs", "a(1)+[b].rs", True), ("a**b", "axxb", True), ("a/**b", "a/x/b", False), (None, "a", False), ("a", None, False), ("", "", True), ("$^|{}\\.x", "$^|{}\\.x", True),
    ]
    df = spark.createDataFrame([(p, s, w) for p, s, w in cases], "p string, s string, w boolean").withColumn("got", glob_matches(F.col("p"), F.col("s")))
    assert [(r.p, r.s, r.got) for r in df.collect() if r.got != r.w] == []
    paths = spark.createDataFrame([("src\\x.rs",), ("./src//x.rs",), (None,)], "p string").select(plain_path(F.col("p")).alias("p"))
    assert [r.p for r in paths.collect()] == ["src/x.rs", "src/x.rs", None]


def test_waive_by_globs(spark):
    e = spark.createDataFrame([(1, "A", "src/**", None, None, None, "tree"), (2, "A", "./lib.rs", None, None, None, "file"), (3, "B", "none/*", None, None, None, "n")], "entry_no int, check string, file string, symbol string, lo int, hi int, reason string")
    f = spark.createDataFrame([("A", "src/a/b.rs"), ("A", "lib.rs"), ("B", "src/a.rs"), ("A", None)], "check_id string, file string").selectExpr("*", "'s' AS subject", "1 AS line")
    got = {(r.check_id, r.file, r.reason) for r in host.waive(f, host.expand_globs(e, f)).collect()}
    assert got == {("A", "src/a/b.rs", "tree"), ("A", "lib.rs", "file"), ("B", "src/a.rs", None), ("A", None, None)}
    assert host.expand_globs(e, f.limit(0)).count() == 1


def test_waive_by_crate(spark):
    e = spark.createDataFrame([(1, "A", "f", None, None, None, "of m", "m"), (2, "A", "f", None, None, None, "of p", "p"), (3, "A", "g", None, None, None, "any", None)], "entry_no int, check string, file string, symbol string, lo int, hi int, reason string, crate_scope string")
    f = spark.createDataFrame([("A", "f", "m", "p"), ("A", "f", None, "p"), ("A", "f", "n", "p"), ("A", "g", None, None)], "check_id string, file string, member string, project string").selectExpr("*", "'s' AS subject", "1 AS line")
    got = {(r.file, r.member, r.reason) for r in host.waive(f, e).collect()}
    assert got == {("f", "m", "of m"), ("f", None, "of p"), ("f", "n", None), ("g", None, "any")}


def test_stale_globs_and_scopes(spark):
    e = spark.createDataFrame([(1, "A", "src/*.rs", None, None, None, None), (2, "A", "lib/**", None, None, None, None), (3, "A", "./src/a.rs", "f", None, None, "core"), (4, "A", "src/a.rs", "f", None, None, "other"), (5, "A", "src/?.rs", None, 9, 9, None), (6, "B", "x", None, None, None, None)], "entry_no int, check string, file string, symbol string, lo int, hi int, crate_scope string")
    f = spark.createDataFrame([("A", "src/a.rs", "f", 3, "core", "ws"), ("A", None, "f", 3, None, None)], "check_id string, file string, subject string, line int, member string, project string")
    done = spark.createDataFrame([("A",)], "check_id string")
    assert sorted(r.entry_no for r in host.stale_entries(e, f, done).collect()) == [2, 4, 5]
    assert host.stale_entries(e.limit(0), f, done).count() == 0 and host.stale_entries(e, f.limit(0), done).count() == 5
