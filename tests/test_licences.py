from pyspark.sql import functions as F

from lodestone.operators import host
from lodestone.operators import licences as L

CASES = {
    "MIT": [["MIT"]], "MIT OR Apache-2.0": [["MIT"], ["Apache-2.0"]], "MIT/Apache-2.0": [["MIT"], ["Apache-2.0"]], "A AND B OR C": [["A", "B"], ["C"]], "A AND (B OR C)": [["A", "B"], ["A", "C"]],
    "(A OR B) AND (C OR D)": [["A", "C"], ["A", "D"], ["B", "C"], ["B", "D"]], "((A))": [["A"]], "A OR (B AND (C OR D))": [["A"], ["B", "C"], ["B", "D"]], "GPL-2.0+ WITH Classpath-exception-2.0 and A": [["GPL-2.0", "A"]],
    "": [], "A AND A": [["A"]], "(A AND (B": [["A", "B"]], "A or A": [["A"]],
}


def test_expressions(spark):
    df = spark.createDataFrame([(k,) for k in [*CASES, None]], "e string").select("e", L.disjunctive(F.col("e")).alias("d"))
    assert {r.e: r.d for r in df.collect()} == CASES | {None: []}
    p = spark.createDataFrame([("r", "l", e, "1", e) for e in ("A AND (B OR C)", "A OR X", "X", None)], "repo string, path string, name string, version string, licence string")
    policy = spark.createDataFrame([("r", "A"), ("r", "c"), ("q", "X")], "repo string, id string")
    assert sorted((r.name for r in L.forbidden_licences(p, policy).collect()), key=str) == [None, "X"]


def test_repositories(spark):
    h = "// SPDX-License-Identifier: "
    f = [
        ("none", "a.rs", h + "MIT"), ("ok", "LICENSE-MIT", "x"), ("ok", "LICENSE-APACHE", "x"), ("ok", "Cargo.toml", '[package]\nlicense = "MIT OR Apache-2.0"\n'), ("ok", "a.rs", "\n" * 13 + h + "MIT"), ("ok", "vendor/b.rs", ""), ("ok", "x.md", ""),
        ("bad", "LICENSE-MIT", "x"), ("bad", "Cargo.toml", '[workspace.package]\nlicense = "MIT OR Apache-2.0"\n'), ("bad", "a.rs", "\n" * 15 + h + "MIT"), ("bad", "b.py", "# SPDX-License-Identifier: GPL-3.0"), ("bad", "c.py", None),
        ("origin", "COPYING", "x"), ("origin", "NOTICE", "x"), ("origin", "package.json", '{"license": "ISC"}'), ("origin", "a.ts", h + "GPL-3.0"), ("dir", "LICENSES/MIT.txt", ""), ("dir", "pyproject.toml", "[project]\nlicense = {text = 'MIT'}\n"), ("dir", "a.c", "/* SPDX-License-Identifier: MIT */"),
    ]
    found = L.licence_state(spark.createDataFrame(f, "repo string, path string, text string"))
    assert sorted((r.project, r.subject, r.severity, r.file, r.summary) for r in found.select("project", "subject", "severity", F.coalesce("file", F.lit("-")).alias("file"), "summary").collect()) == [
        ("bad", "Apache-2.0", "medium", "Cargo.toml", "declared, but no licence file is named for Apache-2.0"), ("bad", "SPDX-License-Identifier", "medium", "a.rs", "1 of 2 sources carry no SPDX header"),
        ("bad", "licence mismatch", "medium", "b.py", "1 sources are under another licence with no origin record"), ("none", "licence file", "high", "-", "no licence file at the root"),
    ]
    assert host.validate(found)[1].count() == 0 and L.licence_state(spark.createDataFrame([], "repo string, path string, text string")).count() == 0
