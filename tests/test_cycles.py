"""Edges that dissolve cycles, against removal of each edge in turn."""

import random

from lodestone.operators import facts, graph


def reach(edges, start):
    """Vertices after one edge or more; `edges` of one small graph, or all as lists by start."""
    out = edges if isinstance(edges, dict) else {a: [y for x, y in edges if x == a] for a, _ in edges}
    seen, todo = set(), [start]
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def cyclic(edges):
    lists = {a: [y for x, y in edges if x == a] for a, _ in edges}
    return any(v in reach(lists, v) for v in lists)


def brute(edges):
    """{component: (edges each of which is enough, or None)} and its inner edges."""
    edges = {(a, b) for a, b in edges if a != b}
    lists = {}
    for a, b in edges:
        lists.setdefault(a, []).append(b)
    to = {v: reach(lists, v) for e in edges for v in e}
    out = {}
    for v in sorted(to):
        part = {w for w in to[v] if v in to[w]}
        if v in part and min(part) == v:
            inner = {(a, b) for a in part for b in lists.get(a, ()) if b in part}
            out[v] = ({e for e in inner if not cyclic(inner - {e})}, inner)
    return out


def check(spark, edges):
    rows = graph.dissolving_edges(spark.createDataFrame(sorted(edges), "a string, b string")).collect()
    want = brute(edges)
    assert {r.component for r in rows} == set(want)
    for c, (single, inner) in want.items():
        mine = {(r.a, r.b) for r in rows if r.component == c}
        flags = {r.single for r in rows if r.component == c}
        if single:
            assert mine == single and flags == {True}
        else:
            assert flags == {False} and mine <= inner and not cyclic(inner - mine)


def test_random_graphs_and_rings_with_detours_against_removal(spark):
    r, edges = random.Random(7), set()
    for g in range(200):
        n = r.randint(2, 7)
        edges |= {(f"{g}.{r.randrange(n)}", f"{g}.{r.randrange(n)}") for _ in range(r.randint(2, 2 * n))}
    for g in range(200, 320):
        n = r.randint(3, 9)
        edges |= {(f"{g}.{k}", f"{g}.{(k + 1) % n}") for k in range(n)}
        for d in range(r.randint(0, 3)):
            a, b = r.randrange(n), r.randrange(n)
            edges |= {(f"{g}.{a}", f"{g}.d{d}"), (f"{g}.d{d}", f"{g}.{b}")} if r.random() < 0.5 else {(f"{g}.{a}", f"{g}.{b}")}
    check(spark, edges)


def test_depth_first_set_in_name_order(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "a")]
    rows = graph.dissolving_edges(spark.createDataFrame(edges, "a string, b string")).collect()
    assert sorted((r.a, r.b, r.single) for r in rows) == [("b", "a", False), ("c", "b", False)]


def test_components_too_large_to_walk(spark, monkeypatch):
    monkeypatch.setattr(graph, "WALKED", 3)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "a string, b string")
    assert sorted((r.a, r.b) for r in graph.dissolving_edges(edges).collect()) == [("b", "a"), ("c", "b")]


def test_findings_name_the_edges(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d"), ("q", "a", "b"), ("q", "b", "a"), ("q", "b", "c"), ("q", "c", "b"), (None, "a", "b"), ("r", "x", "x")], "repo string, a string, b string")
    found = {r.project: r for r in facts.component_cycles(e).collect()}
    assert found["r"].subject == "a,b,c" and found["r"].detail == "removing any one of these edges dissolves it: a -> b, b -> c, c -> a"
    assert found["q"].subject == "a,b,c" and found["q"].detail.endswith("but no single one: b -> a, c -> b")
    assert facts.component_cycles(e.limit(0)).count() == 0
