"""Rules over fact tables, on hand-made rows: defective and clean ones together."""

import datetime
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import facts, host

DAY = datetime.date(2026, 1, 1)


def table(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


#: Severity and confidence of each rule's findings.
LEVELS = {
    "TYP-007": {("low", "medium")}, "RDB-004": {("low", "medium")}, "TYP-005": {("medium", "low")}, "RDB-003": {("low", "medium"), ("medium", "medium")}, "TYP-002": {("low", "medium")},
    "COR-001": {("low", "medium")}, "CON-005": {("medium", "medium")}, "ERR-001": {("medium", "medium")}, "ERR-011": {("medium", "medium")}, "EFX-007": {("low", "medium")}, "CON-010": {("low", "low")},
    "TYP-006": {("medium", "high")}, "CON-002": {("medium", "medium")}, "ERR-007": {("medium", "low")}, "EXT-001": {("medium", "medium")}, "EXT-004": {("low", "low")}, "EXT-007": {("low", "low")},
    "OPS-003": {("low", "high")}, "COR-006": {("high", "medium")}, "TST-003": {("medium", "high"), ("medium", "medium")}, "TST-004": {("low", "low")}, "DOC-003": {("low", "high")},
    "ARC-009": {("low", "low"), ("info", "low")}, "GOV-010": {("low", "high"), ("medium", "high")}, "architecture-ratchet": {("medium", "high")}, "SUP-006": {("low", "low")},
    "ARC-001": {("low", "high"), ("info", "high")}, "ARC-002": {("medium", "high")}, "MOD-002": {("low", "medium"), ("info", "medium")}, "ARC-005": {("info", "low")}, "SUP-002": {(x, "high") for x in ("critical", "high", "medium", "low")},
    "SEC-006": {("critical", "high"), ("high", "high")}, "MOD-005": {("low", "medium"), ("info", "medium")}, "CON-006": {("high", "low")}, "API-004": {("low", "medium")}, "API-009": {("low", "medium")},
    "ERR-004": {("medium", "medium")}, "PRF-006": {("info", "low")},
}


def got(df, *columns):
    """Columns of all rows. Findings are held against the host's validation and their rule's levels."""
    if "positive_control" in df.columns:
        assert host.validate(df)[1].count() == 0
        for r in df.select("check_id", "severity", "confidence").distinct().collect():
            assert (r.severity, r.confidence) in LEVELS[r.check_id], r
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


SIGN = "repo string, path string, line int, fn string, name string, type string"
TESTS = "repo string, path string, line int, test string, n_stmts int, n_calls int, n_asserts int, n_tautologies int, expectations int, times int"
SITE = "repo string, path string, line int, subject string"
EDGE = "repo string, a string, b string"


def test_signatures(spark):
    p = table(spark, SIGN, [("r", "a", 1, "f", "x", "bool"), ("r", "a", 1, "f", "y", "bool"), ("r", "a", 5, "g", "x", "bool"), ("r", "a", 5, "g", "y", "&bool"), ("r", None, None, None, None, None)] + [("r", "b", 3, "h", f"p{i}", "u8") for i in range(8)])
    assert got(facts.bool_params(p), "line", "subject") == [(1, "f")]
    assert got(facts.wide_functions(p), "line", "subject", "summary") == [(3, "h", "8 parameters")]
    b = table(spark, "repo string, path string, line int, fn string, depth int", [("r", "a", 1, "f", 5), ("r", "a", 1, "f", 2), ("r", "a", 9, "g", 4)])
    assert got(facts.deep_functions(b), "subject") == [("f",)]
    m = table(spark, "repo string, path string, line int, name string, type string", [("r", "a", 1, "Unit_Prices", "Vec<f64>"), ("r", "a", 2, "price_ratio", "f64"), ("r", "a", 3, "fee", "u64"), ("r", "a", 4, "price", "my::f64"), ("r", "a", 5, None, "f32")])
    assert got(facts.float_money(m), "line") == [(1,)]
    c = table(spark, "repo string, path string, line int, fn string, amount int", [("r", "a", 1, "f", 10), ("r", "a", 1, "f", 6), ("r", "a", 2, "g", 15), ("r", "a", 3, "h", 31)])
    assert got(facts.complexity(c), "subject", "severity") == [("f", "low"), ("h", "medium")]
    s = table(spark, "repo string, path string, line int, literal string", [("r", "a", 1, x) for x in "abb"] + [("r", "a", 2, x) for x in "abc"])
    assert got(facts.string_chains(s), "line") == [(2,)]
    d = table(spark, "repo string, path string, line int, fn string, required array<string>, present array<string>", [("r", "a", 1, "f", ["Errors"], None), ("r", "a", 2, "g", ["Panics"], ["Panics", "x"]), ("r", "a", 3, "h", None, None)])
    assert got(facts.missing_sections(d), "subject") == [("a:f:1",)]


def test_unjustified(spark):
    sites = table(spark, SITE, [("r", "a", n, "p") for n in (5, 8, 9, 9)] + [("r", "b", 5, "q"), ("r", None, 5, "z")])
    notes = table(spark, "repo string, path string, line int", [("r", "a", 5), ("r", "b", 6), (None, "a", 9)])
    assert got(facts.unjustified_sites(sites.withColumn("fn", F.lit("f")), notes, "ERR-001"), "file", "line") == sorted([("a", 9), ("a", 9), ("b", 5), (None, 5)], key=str)
    assert got(facts.unjustified_per(sites.withColumn("package", F.col("subject")), notes, "CON-010"), "subject", "line", "summary") == [("p", 9, "sites without a reason: 2"), ("q", 5, "sites without a reason: 1"), ("z", 5, "sites without a reason: 1")]


def test_statements(spark):
    g = table(spark, "repo string, path string, line int, fn string, guard string, start int, stop int", [("r", "a", 1, "f", "x", 1, 5), ("r", "a", 2, "f", "y", 5, 9), ("r", "a", 3, "g", "z", 1, 9)])
    a = table(spark, "repo string, path string, fn string, seq int", [("r", "a", "f", 5), ("r", "b", "g", 2)])
    assert got(facts.guards_across_awaits(g, a), "line") == [(1,)]
    s = table(spark, "repo string, path string, block int, seq int, line int, kind string, name string, fn string", [("r", "a", 1, 1, 1, "bind", "x", "none"), ("r", "a", 1, 2, 2, "exit", None, "none"), ("r", "a", 1, 3, 3, "release", "x", "none"), ("r", "a", 2, 1, 4, "exit", None, "none"), ("r", "a", 2, 2, 5, "bind", "x", "none"), ("r", "a", 2, 3, 6, "release", "x", "none"), ("r", "a", 1, 4, 7, "release", "never_bound", "none")])
    assert got(facts.late_releases(s), "line", "subject") == [(3, "a:none:x")]
    v = table(spark, "repo string, path string, enum string, variant string", [("r", "e", "E", x) for x in "ABC"] + [("r", "e", "D", "A"), ("r", "f", "D", "B")])
    arms = table(spark, "repo string, path string, line int, enum string, listed array<string>", [("r", "m", 1, "E", ["A"]), ("r", "m", 2, "E", ["A", "B", "C"]), ("r", "e", 3, "E", []), ("r", "m", 4, "D", []), ("r", "m", 5, "E", None)])
    assert got(facts.absorbing_arms(arms.withColumn("fn", F.lit("no")), v), "line", "summary") == [(1, "absorbs B, C"), (5, "absorbs A, B, C")]


def test_traits_and_packages(spark):
    t = table(spark, "repo string, package string, path string, line int, trait string, methods int", [("r", "p", "a", 1, "T", 6), ("r", "p", "a", 2, "U", 5), ("r", "p", "a", 3, "W", 9), ("r", "p", "b", 3, "W", 9)])
    i = table(spark, "repo string, package string, trait string, stubs int, is_test boolean", [("r", "p", "T", 3, False), ("r", "p", "T", 2, True), ("r", "p", "U", 4, False), ("r", "p", "W", 4, False)])
    assert got(facts.stubbed_traits(t, i), "subject", "summary") == [("a:T", "3 of 6 methods are stubs; implementers: 1")]
    none = table(spark, "repo string, package string, trait string", [("r", "p", "W")])
    assert got(facts.single_implementations(t, i, none), "subject") == [("U",)]
    m = table(spark, "repo string, package string, path string, line int, name string", [("r", "l", "a", 1, "dbg"), ("r", "l", "a", 2, "format"), ("r", "b", "a", 3, "print")])
    assert got(facts.print_macros(m.withColumn("fn", F.lit("zero")), table(spark, "repo string, package string", [("r", "l"), ("r", "l")])), "line") == [(1,)]
    u = table(spark, "repo string, package string, kind string, justified boolean", [("r", "p", "block", True), ("r", "p", "fn", None), ("r", "q", "impl", None)])
    assert got(facts.unsafe_inventory(u), "package", "blocks", "fns", "impls", "unjustified") == [("p", 1, 1, 0, 0), ("q", 0, 0, 1, 1)]
    assert got(facts.unjustified_unsafe(u), "subject") == [("q",)]


def test_tests(spark):
    t = table(spark, TESTS, [("r", "a", 1, "empty", 0, 0, 0, 0, 0, 0), ("r", "a", 2, "always", 1, 1, 2, 2, 0, 0), ("r", "a", 3, "calls", 2, 1, 2, 1, 7, 3), ("r", "a", 4, "alone", 1, 0, 1, 0, 4, 0), ("r", "a", 5, "times", 3, 3, 0, 0, 3, 3)])
    assert got(facts.empty_tests(t), "line") == [(1,), (2,), (4,)]
    assert got(facts.over_mocked(t), "line") == [(4,), (5,)]


def test_repositories(spark):
    c = table(spark, "repo string, path string, component string, purpose string, owner string", [("r", "a", "x", "p", "o"), ("r", "a", "y", " ", "o"), ("q", "a", "z", None, None)])
    assert got(facts.undeclared_components(c), "subject", "summary") == [("a: y: purpose", "no purpose")]
    m = "repo string, member string, cycles int, surface int"
    base, head = table(spark, m, [("r", "a", 0, 40), ("r", "b", 1, 0), ("r", "c", 0, 40)]), table(spark, m, [("r", "a", 1, 51), ("r", "b", 1, 9), ("r", "c", 0, 50), ("r", "new", 9, 99)])
    assert got(facts.drift(base, head), "subject", "severity") == [("a:cycles", "low"), ("a:surface", "info")]
    at = "repo string, path string, line int, lint string, reason string"
    b, h = table(spark, at, [("r", "a", 1, "l", None), ("q", "a", 1, "l", "")]), table(spark, at, [("r", "a", 1, "l", None), ("r", "b", 1, "l", " "), ("r", "c", 1, "l", "why"), ("q", "z", 1, "l", None)])
    assert got(facts.bare_suppressions(h), "project", "file") == [("q", "z"), ("r", "a"), ("r", "b")]
    assert got(facts.suppression_ratchet(b, h), "project", "file") == [("r", "b")]
    w = "repo string, path string, line int"
    assert got(facts.waiver_ratchet(table(spark, w, [("r", "a", 1), ("q", "a", 1)]), table(spark, w, [("r", "a", 9), ("r", "a", 3), ("q", "a", 1), ("s", "a", 2)])), "project", "line") == [("r", 9), ("s", 2)]
    d = table(spark, "repo string, package string, path string, line int, name string", [("r", "p", "m", 1, "Serde-json"), ("r", "p", "m", 2, "log"), ("r", "q", "m", 3, "serde-json")])
    assert got(facts.unused_dependencies(d, table(spark, "repo string, package string, token string", [("r", "p", "serde_JSON"), ("r", "p", None)])), "line") == [(2,), (3,)]


def test_architecture(spark):
    e = table(spark, EDGE, [("r", "m1", "m2"), ("r", "m1", "m2"), ("r", "m2", "m1"), ("r", "m1", "m3"), ("r", "m4", "m3"), ("r", "m1", "m5")])
    m = table(spark, "repo string, member string, component string, layer int", [("r", "m1", "core", 0), ("r", "m2", "app", 1), ("r", "m3", "ui", 2), ("r", "m4", "m4", 1), ("r", "m5", None, None)])
    allow, w = table(spark, EDGE, [("r", "core", "m3")]), table(spark, EDGE + ", until date", [("r", "m4", "ui", DAY), ("r", "m1", "m2", DAY - datetime.timedelta(1))])
    assert got(facts.layer_violations(e, m, allow, w, F.lit(DAY)), "subject", "severity") == [("m1->m2", "low"), ("unplaced:m5", "info")]
    n = table(spark, "repo string, member string, component string, layer int", [("r", "m1", "core", None), ("r", "m2", "app", 1), ("r", "m3", "ui", 2), ("r", "m4", "core", None), ("r", "m5", "app", 0)])
    assert got(facts.layer_violations(e, n, allow, w, F.lit(DAY)), "subject", "summary") == [("m1->m2", "core is outside the layers"), ("m1->m5", "core is outside the layers"), ("m2->m1", "core is outside the layers")]
    c = table(spark, EDGE, [("r", "a::x", "a::y"), ("r", "a::y", "a::x"), ("q", "b", "c"), ("q", "c", "b"), ("q", "c", "d"), ("r", "d", "d"), ("r", None, "d")])
    assert got(facts.component_cycles(c), "project", "subject", "summary") == [("q", "b,c", "a cycle of 2 components"), ("r", "a::x,a::y", "a cycle of 2 components")]
    assert got(facts.module_cycles(c), "subject", "severity") == [("a::x,a::y", "info"), ("b,c", "low")]


def test_entangled(spark):
    e = table(spark, EDGE, [("r", "a::x", "b"), ("r", "b::y", "a"), ("r", "a", "c")])
    f = table(spark, "repo string, m string, f string", [("r", "a::x", "1"), ("r", "a", "2"), ("r", "b", "3"), ("r", "c", "4")])
    t = [(o, f) for o in "klmn" for f in ("1", "3")] + [("z", "2"), ("k", "4"), ("k", "1")] + [("bulk", str(i)) for i in range(1, 40)]
    touched = table(spark, "repo string, o string, at int, f string", [("r", o, ord(o[0]), f) for o, f in t])
    r = facts.entangled_modules(e, f, touched).collect()
    assert [(x.a, x.b, x.both, x.either, x["sample"]) for x in r] == [("a", "b", 4, 5, ["n", "m", "l"])]


def test_entangled_against_sets(spark):
    r = random.Random(3)
    mods, commits = [f"m{k}" for k in range(7)], [(o, o // 3 if o % 5 else None) for o in range(300)]
    f = [(r.choice("rq"), r.choice(mods), k) for k in range(40) for _ in range(r.randrange(3))]
    e = [(repo, a + "::x", b) for repo in "rq" for a in mods for b in mods if r.random() < 0.8]
    t = [(r.choice("rq"), o, at, r.randrange(40)) for o, at in commits for _ in range(r.randrange(9))]
    t += t[:50] + [("r", None, 1, 1), (None, 1, 1, 1)] + [("r", 5, 9, 3), ("r", 6, 9, 3)]  # two times of one commit
    want = []
    for repo in "rq":
        files = {}
        for x in set(t):
            if x[0] == repo and x[1] is not None:
                files.setdefault(x[1], set()).add(x[2:])
        per = {}
        for o, fs in files.items():
            if len(fs) <= 6:
                for at, g in fs:
                    per.setdefault((o, at), set()).update(m for q, m, k in f if q == repo and k == g)
        named = {(a.split("::")[0], b) for q, a, b in e if q == repo}
        for a, b in itertools.combinations(mods, 2):
            both, either = [c for c, ms in per.items() if a in ms and b in ms], [c for c, ms in per.items() if a in ms or b in ms]
            if {(a, b), (b, a)} <= named and len(both) >= 2 and len(both) * 100 >= len(either) * 5:
                want.append((repo, a, b, len(both), len(either), [o for o, _ in sorted(both, key=lambda c: (c[1] is None, -(c[1] or 0), c[0]))[:3]]))
    args = table(spark, EDGE, e), table(spark, "repo string, m string, f int", f), table(spark, "repo string, o int, at int, f int", t)
    got_ = facts.entangled_modules(*args, max_files=6, least=2, share=5)
    assert sorted(map(tuple, got_.collect())) == sorted(want) and len(want) > 15


def test_entangled_rows_are_pairs_within_commits(spark):
    # 60 modules that all name each other: a commit of two makes three rows, not one for each of the 118 pairs that hold either
    m = spark.range(60).selectExpr("'r' repo", "concat('m', id) m", "id f")
    e = m.select("repo", F.col("m").alias("a")).crossJoin(m.select(F.col("m").alias("b"))).filter("a <> b")
    t = spark.range(20_000).selectExpr("'r' repo", "id div 2 o", "id div 2 at", "(id * 7) % 60 f")
    made = facts._changed(t, m, 25)
    assert made.count() == 30_000 and facts.entangled_modules(e, m, t).count() > 0


def test_reports(spark):
    p = table(spark, "repo string, path string, ecosystem string, name string, version string", [("r", "l", "e", "x", v) for v in ("1.2.0", "1.10.0", "2.0.0")] + [("r", "l", "f", "x", "1.2.0")])
    k = table(spark, "ecosystem string, name string, group string, introduced string, fixed string, score double", [("e", "x", "g1", "1.3.0", "2.0.0", 9.8), ("e", "x", "g1", "1.3.0", "2.0.0", 5.0), ("e", "x", "g2", None, "1.2.1", 4.0), ("e", "x", "g3", "2.0.0", None, None)])
    assert got(facts.advisories(p, k), "subject", "summary", "severity") == [("x@1.10.0", "g1", "critical"), ("x@1.2.0", "g2", "medium"), ("x@2.0.0", "g3", "high")]
    assert got(facts.grave_advisories(p, k), "check_id", "summary") == [("SEC-006", "g1"), ("SEC-006", "g3")]
    d = [("ignored", 1, "a", 9, 1), ("ignored", 1, "a", 9, 1), ("used", 1, "a", 9, 1), ("used", 1, "b", 2, 4), ("used", 1, "a", 2, 1), ("ignored", 1, "a", 4, 2), ("ignored", 1, "a", 5, 3), ("used", 2, "a", 20, 1), ("ignored", 3, "a", 1, 1)]
    diags = table(spark, "kind string, id int, file string, line int, col int", d)
    tags = table(spark, "id int, fn string, file string, line int, col int, last_line int, last_col int", [(1, "f", "a", 3, 5, 5, 2), (2, "g", "a", 7, 1, 8, 2)])
    imports = table(spark, "file string, first int, last int", [("b", 1, 3)])
    assert got(facts.unused_returns(diags, tags, imports), "fn", "ignored", "total") == [("f", 2, 2)]


def test_advisories_meet_versions_once(spark):
    # 6,000 lockfiles and 6,000 groups of one package: 36 million pairs, but three versions and two ranges
    p = spark.range(6000).selectExpr("'r' repo", "CAST(id AS STRING) path", "'e' ecosystem", "'x' name", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat(id % 3, '.0.0') END version")
    k = spark.range(6000).selectExpr("'e' ecosystem", "'x' name", "concat('g', id) `group`", "CASE WHEN id = 7 THEN NULL ELSE '5.0.0' END introduced", "CASE WHEN id = 7 THEN NULL ELSE '9.0.0' END fixed", "5.0D score")
    began = time.monotonic()
    rows = facts.advisories(p, k.unionByName(k.filter("`group` = 'g7'").withColumn("score", F.lit(9.5)))).groupBy("subject", "summary", "severity").count().collect()
    assert time.monotonic() - began < 25
    assert sorted((r.subject or "", *r[1:]) for r in rows) == [("", "g7", "critical", 2000), ("x@1.0.0", "g7", "critical", 2000), ("x@2.0.0", "g7", "critical", 2000)]


@pytest.mark.parametrize("name", ["bool_params", "wide_functions"])
def test_empty(spark, name):
    assert getattr(facts, name)(table(spark, SIGN, [])).count() == 0


def test_size(spark):
    f = table(spark, "repo string, path string, code_lines int, fan_out int, fan_in int", [("r", "a", 2234, 0, 6), ("r", "b", 2234, 6, 5), ("r", "c", 1034, 14, 0), ("r", "d", 1034, 13, 99), ("r", None, None, None, None)])
    t = table(spark, "repo string, path string, line int, type string, fields int, methods int", [("r", "a", 1, "T", 29, 1), ("r", "a", 2, "U", 40, 0)])
    assert got(facts.size_outliers(f, t), "subject", "severity", "summary") == [("T", "info", "30 members"), ("a", "low", "size and coupling"), ("b", "info", "size"), ("c", "info", "coupling")]


def test_unstable_edges(spark):
    # s is used by many and uses one; u is used by s alone and uses many
    e = [("r", x, "s") for x in "abc"] + [("r", "s", x) for x in ("u", "u_sys", "v", "c2")] + [("r", k, x) for k in ("u", "u_sys", "v") for x in ("p", "q", "z")] + [("r", "s", "s")]
    r = facts.unstable_edges(table(spark, EDGE, e), table(spark, "repo string, component string", [("r", "v")]), 0.1)
    assert got(r, "subject") == [("s->u",)]


def test_lock_cycles(spark):
    g = table(spark, "repo string, package string, path string, fn string, lock string, start int, stop int", [("r", "p", "a", "f", "x", 1, 9), ("r", "p", "a", "f", "y", 2, 8), ("r", "p", "a", "g", "y", 1, 5), ("r", "p", "a", "g", "x", 3, 4), ("r", "q", "a", "f", "x", 1, 5), ("r", "q", "a", "f", "x", 3, 4), ("r", "q", "a", "h", "z[]", 1, 5), ("r", "q", "a", "h", "z[]", 2, 3)])
    assert got(facts.lock_cycles(g), "subject", "summary") == [("x <-> y", "a cycle of 2 locks"), ("x", "taken again while held")]


def test_surface(spark):
    a = table(spark, "repo string, path string, line int, item string, is_pub boolean, since string, note string", [("r", "a", 1, "f", True, "1", None), ("r", "a", 2, "g", False, None, None), ("r", "a", 3, "h", True, "1", "n")])
    assert got(facts.bare_deprecations(a), "subject", "summary") == [("a:f:1", "no note")]
    e = table(spark, "repo string, path string, line int, enum string, is_pub boolean, non_exhaustive boolean, variants int, doc string", [("r", "a", 1, "E", True, False, 2, None), ("r", "a", 2, "F", True, False, 2, "A Closed set"), ("r", "a", 3, "G", True, False, 0, None), ("r", "a", 4, "H", True, True, 2, None)])
    assert got(facts.open_enums(e), "subject") == [("a:E:1",)]
    ret = ["Result<u8, String>", "std::result::Result<(), &'static str>", "io::Result<u8>", "Result<Vec<u8>, Box<dyn Error + Send>>", "anyhow::Result<u8>", "anyhow::Result<u8, MyError>", "Result<String, MyError>", "String", None]
    f = table(spark, "repo string, path string, line int, fn string, is_pub boolean, ret string", [("r", "a", i, "f", True, x) for i, x in enumerate(ret)])
    assert got(facts.untyped_errors(f), "line") == [(0,), (1,), (3,), (4,)]


def test_perf_exceptions(spark):
    rows = [(1, "PERF-EXCEPTION: slow"), (2, "x"), (3, "see benches/a.rs"), (10, "* PERF-EXCEPTION: slow"), (13, "bench/x"), (20, "PERF-EXCEPTION: a"), (21, "PERF-EXCEPTION: benchmark/b"), (30, "PERF-EXCEPTION: see workbench/x"), (40, "not PERF-EXCEPTION: x"), (50, "PERF-EXCEPTION: c"), (52, "https://x"), (60, None)]
    c = table(spark, "repo string, path string, line int, text string", [("r", "a", n, t) for n, t in rows])
    assert got(facts.perf_exceptions(c), "line", "summary") == [(10, "excuses for slow code without a benchmark: 3")]
