import random

from lodestone.operators import host, scopes

SCOPE = "repo string, path string, name string, start int, stop int"


def test_chains_against_nested_loops(spark):
    r, spans, places = random.Random(3), [], []
    for f in range(30):
        def grow(lo, hi, depth):
            at = lo
            while at <= hi and depth < 7 and r.random() < 0.8:
                start = r.randint(at, hi)
                stop = r.randint(start, hi)
                spans.append(("r", f"f{f}", f"n{len(spans):03d}", start, stop))
                grow(start + 1, stop - 1, depth + 1)
                at = stop + 1

        grow(0, 60, 0)
        places += [("r", f"f{f}", k, f"p{k}") for k in range(0, 62, 3)]
    got = scopes.enclosing(spark.createDataFrame(spans, SCOPE), spark.createDataFrame(places, "repo string, path string, at int, chain_of string")).collect()
    assert len(got) == len(places)
    for row in got:
        around = sorted((s, -e, n) for _, p, n, s, e in spans if p == row.path and s <= row.at <= e)
        assert row.chain == [n for _, _, n in around]


def test_qualified_names_and_lookups(spark):
    s = spark.createDataFrame([("r", "a", "m", 1, 90), ("r", "a", "S", 2, 20), ("r", "a", "new", 3, 5), ("r", "a", "T", 30, 50), ("r", "a", "new", 31, 33), ("r", "a", None, 1, 99), ("r", "a", "back", 9, 3), (None, "a", "x", 1, 9)], SCOPE)
    items = spark.createDataFrame([("r", "a", 3, "new"), ("r", "a", 31, "new"), ("r", "a", 4, "x"), ("r", "a", 95, "y"), ("r", "b", 1, "z"), (None, "a", 2, "w")], "repo string, path string, line int, name string")
    named = scopes.qualified(s, items, "line")
    assert {(r.line, r.name, r.qualified) for r in named.collect()} == {(3, "new", "m::S::new"), (31, "new", "m::T::new"), (4, "x", "m::S::new::x"), (95, "y", "y"), (1, "z", "z"), (2, "w", "x::w")}
    twice = named.unionByName(named.filter("line = 4"))
    asked = spark.createDataFrame([("r", "a", 3, "new", 1), ("r", "a", 4, "x", 2), ("r", "a", 7, "new", 3)], "repo string, path string, line int, name string, own int")
    assert {(r.own, r.qualified) for r in scopes.look_up(twice, asked).collect()} == {(1, "m::S::new"), (2, "x"), (3, "new")}
    assert scopes.enclosing(s.limit(0), items, "line").filter("size(chain) > 0").count() == 0 and scopes.enclosing(s, items.limit(0), "line").count() == 0


def test_catchers_away_from_boundaries(spark):
    fns = spark.createDataFrame([("r", "a", "run_server", 1, 20), ("r", "a", "truncate", 5, 10), ("r", "a", "parse", 30, 60)], SCOPE)
    at = spark.createDataFrame([("r", "a", n, b) for n, b in ((2, False), (6, None), (31, False), (40, False), (50, True), (70, False))], "repo string, path string, line int, is_binary boolean")
    notes = spark.createDataFrame([("r", "a", 37, "the outermost frame"), ("r", "a", 30, "why not")], "repo string, path string, line int, text string")
    found = scopes.stray_catchers(at, fns, notes)
    assert sorted((r.line, r.subject) for r in found.collect()) == [(6, "a:truncate"), (31, "a:parse"), (70, "a:")]
    assert host.validate(found)[1].count() == 0


def test_pass_throughs(spark):
    columns = "repo string, path string, line int, name string, qualified string, params array<string>, callee string, args array<string>, in_trait boolean, is_facade boolean"
    rows = [
        (1, ["a", "b"], "g", ["a", "b"], None, None), (2, ["self", "a"], "self.g", ["a"], False, False), (3, ["self", "a"], "g", ["&self.x", "a"], False, False), (4, ["a", "b"], "g", ["b", "a"], False, False),
        (5, ["self"], "self.g", [], False, False), (6, ["a"], "Self::Variant", ["a"], False, False), (7, ["self", "a"], "self.rules.push", ["a"], False, False), (8, ["a"], "g", ["a"], True, False),
        (9, ["a"], "g", ["a"], False, True), (10, ["a"], "g", ["a", "1"], False, False), (11, None, None, None, None, None),
    ]
    found = scopes.pass_throughs(spark.createDataFrame([("r", "p", n, "f", "m::f", *rest) for n, *rest in rows], columns))
    assert sorted(r.line for r in found.collect()) == [1, 2, 3] and host.validate(found)[1].count() == 0
