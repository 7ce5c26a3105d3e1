import random

from pyspark.sql import functions as F

from lodestone.operators import graph, host
from lodestone.operators import structure as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_connected_against_union(spark):
    r = random.Random(5)
    edges = [(f"{r.randrange(60):02d}", f"{r.randrange(60):02d}") for _ in range(45)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(40)] + [(None, "00")]
    root = {v: v for e in edges if None not in e for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert rows(graph.connected(spark.createDataFrame(edges, "a string, b string")), "v", "g") == sorted((v, find(v)) for v in root)


def test_window_of_commits(spark):
    t = [("r", f"c{k:03d}", k, f) for k in range(40) for f in "ab"] + [("q", "x", 1, "a"), (None, "y", 9, "a"), ("r", "c039", 39, "a")]
    t = spark.createDataFrame(t, "repo string, o string, at int, f string")
    kept = S.newest_commits(t, 3)
    assert {(r.repo, r.o) for r in kept.collect()} == {("r", "c039"), ("r", "c038"), ("r", "c037"), ("q", "x")} and kept.count() == 8
    plan = S.newest_commits(t, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan  # the limit below the shuffle
    assert rows(S.at_head(t.filter("o IN ('x', 'c000')"), spark.createDataFrame([("r", "b"), ("q", "a"), ("q", "a")], "repo string, f string")), "repo", "f") == [("q", "a"), ("r", "b")]


M = "repo string, package string, type string, method string"


def test_mixed_types(spark):
    m = [("r", "p", "T", x, x == "thin") for x in ("a", "b", "c", "d", "thin", "idle")] + [("r", "p", "U", x, None) for x in "abcd"] + [("q", "p", "H", f"m{k}", False) for k in range(8)]
    u = [("T", "a", "x"), ("T", "b", "x"), ("T", "c", "y"), ("T", "helper", "y"), ("T", "thin", "x"), ("T", "thin", "y"), ("U", "a", "x"), ("U", "b", "x"), ("U", "c", "y"), ("U", "d", "y"), ("U", "d", "x")]
    u = [("r", "p", *x) for x in u] + [("q", "p", "H", f"m{k}", "hub") for k in range(8)] + [("q", "p", "H", f"m{k}", f"f{k // 4}") for k in range(8)]
    c = [("r", "p", "T", "d", "via"), ("r", "p", "T", "via", "helper"), ("r", "p", "T", "helper", "via"), ("r", "p", "T", "idle", "idle")]
    methods, uses, calls = spark.createDataFrame(m, M + ", thin boolean"), spark.createDataFrame(u, M + ", field string"), spark.createDataFrame(c, M + ", callee string")
    got = S.method_clusters(methods, uses, calls)
    assert rows(got, "type", "methods", "fields", "n") == [("H", [f"m{k}" for k in range(4)], ["f0"], 8), ("H", [f"m{k}" for k in range(4, 8)], ["f1"], 8), ("T", ["a", "b"], ["x"], 4), ("T", ["c", "d"], ["y"], 4), ("U", list("abcd"), ["x", "y"], 4)]
    types = spark.createDataFrame([("r", "p", "T", "a.rs", 3), ("r", "p", "U", "a.rs", 9), ("q", "p", "H", "b.rs", 1), ("q", "p", "H", "c.rs", 1)], "repo string, package string, type string, path string, line int")
    found = S.mixed_types(types, methods, uses, calls)
    assert rows(found, "subject", "line", "summary") == [("T", 3, "clusters of methods that share fields: a+b, c+d")] and host.validate(found)[1].count() == 0
    assert S.mixed_types(types, methods, uses.limit(0), calls).count() == 0


def test_clusters_held_and_joined(spark):
    r = random.Random(9)
    pick = lambda n, k: [(("r", "q")[t % 2], "p", f"T{t}", f"m{r.randrange(k):02d}", r.randrange(k)) for t in range(25) for _ in range(r.randrange(n))]
    u, c = [(*x[:4], f"f{x[4] % 14}") for x in pick(16, 18)], [(*x[:4], f"m{x[4]:02d}") for x in pick(8, 18)]
    m = [(*x[:3], f"m{k:02d}", k % 5 == 0 or None) for x in {x[:3] for x in u + c} for k in range(18)]
    args = spark.createDataFrame(m + m, M + ", thin boolean"), spark.createDataFrame(u + u + [("r", None, "T0", "m01", "f0")], M + ", field string"), spark.createDataFrame(c + c, M + ", callee string")
    told = lambda df: rows(df, "repo", "type", "cluster", "methods", "fields", "n")
    joined = told(S._joined_clusters(*args))
    assert told(S.method_clusters(*args)) == joined and len(joined) > 25
    assert told(S.method_clusters(*args, held=70)) == joined  # some types of either kind
    assert told(S.method_clusters(*args, 4, 2, 60)) == [x for x in joined if x[5] >= 4 and len(x[3]) >= 2]


def test_mixed_types_shuffle_little(spark):
    # 40,000 types of three methods that call each other in a row
    n = spark.range(120_000).selectExpr("'r' repo", "'p' package", "id div 3 type", "id % 3 method")
    uses, calls = n.filter("method = 0").withColumn("field", F.lit("f")), n.filter("method > 0").withColumn("callee", F.expr("method - 1"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("clusters", "")
    assert S.method_clusters(n.withColumn("thin", F.lit(False)), uses, calls, 3, 3).count() == 40_000
    assert len(tracker.getJobIdsForGroup("clusters")) <= 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


ALIAS = "repo string, alias string, target string"


def test_paths(spark):
    a = [("r", "m::a", "m::b"), ("r", "m::b", "m::c::d"), ("r", "m::c", "std::fs"), ("r", "x", "y"), ("r", "y", "z"), ("r", "z", "x"), ("r", "g", "g::h"), ("r", "same", "same"), ("q", "m::a", "other"), ("r", None, "q")] + [("r", f"k{i}", f"k{i + 1}") for i in range(20)]
    aliases = spark.createDataFrame(a, ALIAS)
    known = {(r.repo, r.alias): r.target for r in S.resolved_aliases(aliases).collect()}
    assert known["r", "m::a"] == known["r", "m::b"] == "std::fs::d" and known["r", "k0"] == "k20" and known["q", "m::a"] == "other" and known["r", "g"] == "g::h"
    assert {known["r", k] for k in "xyz"} <= set("xyz")
    names = spark.createDataFrame([("r", "pure", "f", n, p) for n, p in enumerate(["m::a::read", "m::ab", "std::fsx::y", "std::fs", "m::c"])] + [("r", "dirty", "f", 9, "std::fs"), ("r", "pure", "f", 10, None)], "repo string, component string, file string, line int, path string")
    assert rows(S.resolved_paths(names, aliases).filter("component = 'pure' AND path IS NOT NULL"), "line", "resolved") == [(0, "std::fs::d::read"), (1, "m::ab"), (2, "std::fsx::y"), (3, "std::fs"), (4, "std::fs")]
    found = S.impure_names(names, aliases, spark.createDataFrame([("std::fs",), ("a::b",)], "prefix string"), spark.createDataFrame([("r", "pure")], "repo string, component string"))
    assert rows(found, "line", "subject") == [(0, "pure:std::fs::d::read"), (3, "pure:std::fs"), (4, "pure:std::fs")] and host.validate(found)[1].count() == 0
    exports = spark.createDataFrame([("r", "crate::net::Client", "crate::net::imp::Client")], ALIAS)
    used = spark.createDataFrame([("r", "a", 4, "crate::app", "crate::net::imp::Client"), ("r", "a", 3, "crate::app", "crate::net::imp::Client::new"), ("r", "b", 1, "crate::net::x", "crate::net::imp::Client"), ("r", "c", 1, "crate::app", "crate::net::Client"), ("r", "d", 1, "crate::app", "crate::net::imp::ClientX")], "repo string, file string, line int, module string, path string")
    assert rows(S.bypassed_exports(used, exports), "file", "line", "summary") == [("a", 3, "paths past a re-export: 2, first crate::net::imp::Client::new for crate::net::Client")]


def test_freshness(spark):
    locked = spark.createDataFrame([("r", "l", "a", "1.2.0", True), ("r", "l", "a", "2.0.0", None), ("r", "l", "b", "0.3.1", False), ("r", "l", "c", "1.0.0", True), ("r", "l", "d", "0.0.2", True), ("r", "l", "e", "9.0.0", True), ("r", "l", None, "1", True)], "repo string, path string, name string, version string, direct boolean")
    releases = spark.createDataFrame([("a", "1.10.0", None), ("a", "2.0.0", None), ("a", "3.0.0-rc.1", None), ("a", "4.0.0", True), ("b", "0.3.9", False), ("b", "0.4.0", False), ("c", "1.0.0", None), ("c", "0.9.0", None), ("d", "0.0.3", None), ("e", "bad", None)], "name string, version string, yanked boolean")
    found = S.stale_dependencies(locked, releases)
    assert rows(found, "subject", "severity", "summary") == [("a", "medium", "1.2.0 is locked, newest 2.0.0, compatible 1.10.0"), ("b", "low", "0.3.1 is locked, newest 0.4.0, compatible 0.3.9"), ("d", "medium", "0.0.2 is locked, newest 0.0.3")]
    assert host.validate(found)[1].count() == 0 and S.stale_dependencies(locked, releases.limit(0)).count() == 0
