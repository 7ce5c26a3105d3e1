from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, host

ROWS = [
    ("A-1", "high", "low", "p", "a.rs", 5, "x", "bad call", None, None, None, None),
    ("A-1", "low", "high", "p", "a.rs", 50, "y", "No tests found", None, None, None, None),
    ("A-2", "critical", "high", "p", "b.rs", None, "z", "missing docs", None, "m", "12 items seen", None),
    ("A-2", "info", "low", "p", None, None, None, "nothing", None, None, None, "absence"),
]


def findings(spark):
    return spark.createDataFrame(ROWS, host.FINDING)


def test_validate(spark):
    ok, bad = host.validate(findings(spark))
    assert [r.subject for r in ok.orderBy("subject").collect()] == ["x", "z"] and bad.count() == 2


def test_waive_and_stale(spark):
    e = spark.createDataFrame([(1, "A-1", "a.rs", None, 1, 9, "first"), (2, "A-1", "a.rs", "x", None, None, "second"), (3, "A-1", "c.rs", None, None, None, "stale"), (4, "A-9", "a.rs", None, None, None, "not run")], "entry_no int, check string, file string, symbol string, lo int, hi int, reason string")
    got = host.waive(findings(spark), e)
    assert {r.subject: r.reason for r in got.collect()} == {"x": "first", "y": None, "z": None, None: None}
    done = spark.createDataFrame([("A-1",), ("A-2",)], "check_id string")
    assert [r.entry_no for r in host.stale_entries(e, findings(spark), done).collect()] == [3]
    rules = spark.createDataFrame([("A-1", ["old"]), ("A-2", None)], "id string, aliases array<string>")
    assert [r.entry_no for r in host.unknown_entries(e, rules).collect()] == [4]
    assert [r.check for r in host.canonical(spark.createDataFrame([("old",)], "check string"), "check", rules).collect()] == ["A-1"]


def test_ranking_summary_exit(spark):
    f = findings(spark).withColumn("seq", F.monotonically_increasing_id())
    assert [r.severity for r in host.top_n(f, 2, "seq").collect()] == ["critical", "high"]
    assert {r.severity: r.n for r in host.omitted(f, 2, "seq").collect()} == {"low": 1, "info": 1}
    w = findings(spark).limit(1).withColumn("declared_public", F.lit(True))
    s = {r.check_id: r for r in host.rule_summary(findings(spark), w).collect()}
    assert (s["A-1"].findings, s["A-1"].waived, s["A-1"].declared_public, s["A-2"].critical) == (2, 1, 1, 1)
    none = findings(spark).limit(0)
    code = lambda f, e, d: host.exit_code(f, e, d).first().exit_code
    assert [code(findings(spark), none, "high"), code(none, none, "low"), code(findings(spark), none, None), code(none, findings(spark), None)] == [1, 0, 0, 3]
    by = lambda deny, floors, blocking=(): host.exit_code(findings(spark), none, deny, floors, blocking).first().exit_code
    assert [by("info", {}), by("info", {"A-1": "critical"}), by("info", {"A-2": "critical"}), by("info", {}, ["A-1"]), by(None, {"A-2": "low"})] == [0, 0, 1, 1, 0]


def test_outcomes_and_coverage(spark):
    runs = spark.createDataFrame([("r", "Clean", None), ("r", "Findings", 2), ("r", "Findings", 3), ("q", "Skipped", None), ("z", "CouldNotRun", None), ("z", "Findings", 1)], "rule string, kind string, n int")
    assert {r.rule: (r.kind, r.n) for r in host.combine_outcomes(runs).collect()} == {"r": ("Findings", 5), "q": ("Skipped", None), "z": ("CouldNotRun", None)}
    rules = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    claims = spark.createDataFrame([("a", True), ("b", False), ("b", None)], "rule string, proven boolean")
    assert {r.id: r.state for r in host.coverage(rules, claims).collect()} == {"a": "covered", "b": "unproven", "c": "not_covered"}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "a long, b long")
    pairs = {(r.a, r.b) for r in graph.closure(e).collect()}
    assert pairs == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3, 4)} | {(5, 6)}
    assert {r.v: r.component for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1}
    odd = spark.createDataFrame([(9, 9), (5, 6), (6, 5), (6, 7), (7, 8), (8, 7), (2, 5), (7, 2), (None, 1), (20, 21), (21, 20), (20, 5)], "a long, b long")
    assert {r.v: r.component for r in graph.strong_components(odd).collect()} == {**dict.fromkeys((2, 5, 6, 7, 8), 2), 9: 9, 20: 20, 21: 20}
    assert graph.strong_components(e.limit(0)).count() == 0
    seeds = spark.createDataFrame([(2,)], "v long")
    assert {r.v for r in graph.reachable(e, seeds).collect()} == {1, 2, 3, 4}


def test_semver(spark):
    order = ["junk", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0", "v1.2", "1.10.0+build"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(T.semver_key(F.col("v"))).collect()] == order


def test_divergent_changes(spark):
    rows = []
    for k in range(3):
        rows += [(f"a{k}", "src/x.rs"), (f"a{k}", "src/p.rs"), (f"b{k}", "src/x.rs"), (f"b{k}", "src/q.rs"), (f"c{k}", "src/y.rs"), (f"c{k}", "src/r.rs")]
    rows += [("bulk", f"src/f{i}.rs") for i in range(26)] + [("bulk", "src/x.rs"), ("lone", "src/x.rs"), ("doc", "src/x.rs"), ("doc", "README.md")]
    # commits enough that no partner is in over a fifth of them
    rows += [(f"o{i}", f"other/{i}.py") for i in range(30)]
    got = graph.divergent_changes(spark.createDataFrame(rows, "o string, f string")).collect()
    assert [(r.f, r.groups, r.commits) for r in got] == [("src/x.rs", 2, 6)]


def test_many_entries_and_repeated_findings(spark, monkeypatch):
    monkeypatch.setattr(host, "ENTRIES", 2)
    e = spark.createDataFrame([(i, "A-1", "a.rs", None, i, i, f"r{i}") for i in range(5, 1, -1)] + [(9, "A-1", "b.rs", None, None, None, "whole")], "entry_no int, check string, file string, symbol string, lo int, hi int, reason string")
    f = spark.createDataFrame([("A-1", "a.rs", 3, "x")] * 2 + [("A-1", "a.rs", 9, "x"), ("A-1", "b.rs", 1, "x"), ("A-1", None, 3, "x"), (None, "a.rs", 3, "x")], "check_id string, file string, line int, subject string")
    assert sorted(((r.file, r.line, r.reason) for r in host.waive(f, e).collect()), key=str) == sorted([("a.rs", 3, "r3"), ("a.rs", 3, "r3"), ("a.rs", 9, None), ("b.rs", 1, "whole"), (None, 3, None), ("a.rs", 3, None)], key=str)
    assert host.waive(f.limit(0), e).count() == 0 and host.waive(f, e.limit(0)).filter("reason IS NULL").count() == 6


def test_merge_fixtures_and_inherited_entries(spark):
    rows = [("allowlist", "p", "a.rs", "s", "m"), ("allowlist", "p", "b.rs", "s", "m"), ("A-1", "p", "a.rs", "s", "m"), ("A-1", "p", "b.rs", "s", "m"), (None, "p", None, None, None)]
    passes = spark.createDataFrame(rows, "check_id string, project string, file string, subject string, summary string")
    assert sorted(str(r.check_id) for r in host.merge_members(passes).collect()) == ["A-1", "A-1", "None", "allowlist"]
    files = spark.createDataFrame([("conformance/A/bad/expect.toml",), ("conformance/A/x.rs",)], "path string")
    f = spark.createDataFrame([("conformance/A/bad/src/l.rs",), ("conformance/A/good/l.rs",), ("src/conformance/A/bad/l.rs",), (None,)], "file string")
    assert {r.file for r in host.outside_fixtures(f, files).collect()} == {"conformance/A/good/l.rs", "src/conformance/A/bad/l.rs", None}
    e = spark.createDataFrame([(1, "A-1", "z.rs", None, None), (2, "A-1", "z.rs", "m", None), (3, "A-1", "z.rs", None, "wide")], "entry_no int, check string, file string, member_prefix string, source string").selectExpr("*", "CAST(NULL AS STRING) symbol", "CAST(NULL AS INT) lo", "CAST(NULL AS INT) hi")
    assert [r.entry_no for r in host.stale_entries(e, passes.selectExpr("*", "1 AS line"), passes.select("check_id")).collect()] == [1]
