"""Graph operators over edge tables (a, b).

Cases: edges with a null end are none; repeated edges count once; an empty table gives an empty result; extra columns are
ignored."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder of the session; a folder of our own only where none is set and all executors are
    threads of this process."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (a, b) with a path from a to b, by squaring: each round joins paths that end where others begin and keeps
    the new ones, so rounds grow with the logarithm of the longest shortest path."""
    paths = cut(edges.select("a", "b").distinct())
    n = paths.count()
    while True:
        left, right = paths.toDF("a", "m"), paths.toDF("m2", "b")
        grown = cut(paths.unionByName(left.join(right, F.col("m") == F.col("m2")).select("a", "b")).distinct())
        if (k := grown.count()) == n:
            return grown
        paths, n = grown, k


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Vertices (v) reached from the seeds (v), seeds included: a frontier that only meets edges it hasn't used."""
    seen = cut(seeds.select("v").distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(edges, F.col("v") == F.col("a")).select(F.col("b").alias("v")).distinct()
        front = cut(step.join(seen, "v", "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has one out, over and over: what lies on no cycle's way goes."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("b").alias("x")).distinct(), edges.select(F.col("a").alias("x")).distinct()
        edges = cut(edges.join(into, F.col("a") == F.col("x"), "left_semi").join(out, F.col("b") == F.col("x"), "left_semi"))
        if (k := edges.count()) == n:
            break
        n = k
    return edges


def _lowest(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(v, c): the smallest colour that reaches each vertex along edges, from start colours (v, c)."""
    colour, before = start, None
    while True:
        state = colour.agg(F.sum(F.xxhash64("v", "c").cast("decimal(20,0)"))).first()[0]
        if state == before:
            return colour
        before = state
        sent = edges.join(colour, F.col("a") == F.col("v")).select(F.col("b").alias("v"), "c")
        colour = cut(colour.unionByName(sent).groupBy("v").agg(F.min("c").alias("c")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(v, component) of vertices on a cycle; a component is named by its smallest vertex. By colouring: the smallest vertex
    that reaches a vertex colours it; what within a colour also leads back to the vertex of that colour is its component,
    and goes. No pairs of vertices are made; a round is linear in the edges left."""
    left = cut(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    loops = left.filter("a = b").select(F.col("a").alias("v"))
    left, found = _trimmed(left.filter("a <> b")), None
    while not left.isEmpty():
        own = left.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v"))
        colour = _lowest(left, own)
        x, y = colour.toDF("x", "cx"), colour.toDF("y", "cy")
        same = cut(left.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y")).filter("cx = cy").select("a", "b", F.col("cx").alias("c")))
        back = _lowest(same.select(F.col("b").alias("a"), F.col("a").alias("b")), own)
        one = cut(colour.join(back.toDF("w", "d"), (F.col("v") == F.col("w")) & (F.col("c") == F.col("d"))).select("v", F.col("c").alias("component")))
        found = one if found is None else found.unionByName(one)
        gone = one.select(F.col("v").alias("g"))
        left = _trimmed(cut(left.join(gone, F.col("a") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left_anti")))
    alone = loops.withColumn("component", F.col("v"))
    if found is None:
        return alone
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("component").alias("_c"))
    cyclic = found.join(several, F.col("component") == F.col("_c"), "left_semi")
    return cyclic.unionByName(alone.join(cyclic.select(F.col("v").alias("_v")), F.col("v") == F.col("_v"), "left_anti"))


#: Edges of a component up to which it is walked depth-first, in one task.
WALKED = 1_000_000


def _short_cycles(edges: DataFrame) -> DataFrame:
    """(c, v, at, k): a cycle through the smallest vertex of each component c (its name), by vertices at 0 to k - 1. Edges (c, a, b) lie
    within components. Breadth-first from all components' first vertices at once, then back along the parents."""
    seen = cut(edges.select("c", F.col("c").alias("v"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("at")).distinct())
    front, closed, depth = seen, None, 0
    while not front.isEmpty():
        step = cut(front.select("c", "v").join(edges.withColumnRenamed("c", "_c"), (F.col("c") == F.col("_c")) & (F.col("v") == F.col("a"))).select("c", "a", "b"))
        # the edge back to the first vertex closes the cycle; that component is done
        back = step.filter("b = c").groupBy("c").agg(F.min("a").alias("v")).withColumn("k", F.lit(depth + 1))
        closed = cut(back if closed is None else closed.unionByName(back))
        new = step.join(closed.select("c"), "c", "left_anti").groupBy("c", "b").agg(F.min("a").alias("parent")).withColumnRenamed("b", "v")
        depth += 1
        front = cut(new.join(seen.select("c", "v"), ["c", "v"], "left_anti").withColumn("at", F.lit(depth)).select(*seen.columns))
        seen = cut(seen.unionByName(front))
    if closed is None:
        return seen.select("c", "v", "at", F.lit(0).alias("k"))
    found = cut(closed.withColumn("at", F.col("k") - 1).select("c", "v", "at", "k"))
    ends = found
    while not ends.isEmpty():
        ends = cut(ends.join(seen.drop("at"), ["c", "v"]).filter("parent IS NOT NULL").select("c", F.col("parent").alias("v"), (F.col("at") - 1).alias("at"), "k"))
        found = found.unionByName(ends)
    return cut(found)


def dissolving_edges(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, a, b, single): edges whose removal leaves a strong component without a cycle. Where one is enough, all such, each
    `single`; else the edges that a depth-first walk in name order finds leading back, which dissolve it together.

    An edge that is in every cycle is in any one: a short cycle is taken per component. If the other edges hold a cycle of their
    own, no edge is enough. Else each path of other edges from one place of the cycle to another, and whatever it passes, avoids the
    edges of the arc between them, and those that no such arc covers are the answer. How far arcs reach is a least or greatest place
    carried along the other edges, so the work is linear a round, without removal tests or pairs.

    Components of over WALKED edges aren't walked: theirs are all edges against the order of names. `components`: (v, component) of
    strong_components(edges), where it is known."""
    plain = edges.select("a", "b").filter("a <> b").distinct()
    scc = strong_components(plain) if components is None else components
    x, y = scc.toDF("_x", "c"), scc.toDF("_y", "_d")
    inner = cut(plain.join(x, F.col("a") == F.col("_x")).join(y, F.col("b") == F.col("_y")).filter("c = _d").select("c", "a", "b"))
    ring = _short_cycles(inner)
    nxt = ring.select(F.col("c").alias("_c"), F.col("v").alias("_v"), F.col("at").alias("_at"))
    on = cut(ring.join(nxt, (F.col("c") == F.col("_c")) & (F.col("_at") == (F.col("at") + 1) % F.col("k"))).select("c", F.col("v").alias("a"), F.col("_v").alias("b"), "at", "k"))
    rest = cut(inner.join(on, ["c", "a", "b"], "left_anti"))
    wound = _trimmed(rest).select("c").distinct()  # components whose other edges hold a cycle
    bound, free = rest.join(wound, "c", "left_anti"), cut(on.join(wound, "c", "left_anti"))
    # least and greatest place that a vertex reaches, and the greatest that reaches it: three graphs carried at once
    three = lambda low, high, source: F.explode(F.array(*[F.struct(F.concat(F.lit(k), a).alias("a"), F.concat(F.lit(k), b).alias("b")) for k, (a, b) in zip("lhs", (low, high, source))]))
    ends, turned = (F.col("a"), F.col("b")), (F.col("b"), F.col("a"))
    ways = cut(bound.select(three(turned, turned, ends).alias("e")).select("e.*"))
    starts = free.select(F.explode(F.array(*[F.struct(F.concat(F.lit(k), "a").alias("v"), (sign * F.col("at")).alias("c")) for k, sign in zip("lhs", (1, -1, -1))])).alias("s")).select("s.*")
    carried = _lowest(ways, starts)
    of = lambda k, name, sign: carried.filter(F.col("v").startswith(k)).select(F.substring("v", 2, 1 << 30).alias(f"_{name}"), (sign * F.col("c")).alias(name))
    met = free.join(of("l", "low", 1), F.col("a") == F.col("_low")).join(of("h", "high", -1), F.col("a") == F.col("_high")).join(of("s", "source", -1), F.col("a") == F.col("_source"))
    arcs = met.groupBy(F.col("c").alias("_c")).agg(F.min(F.when(F.col("low") < F.col("at"), F.col("at"))).alias("suffix"), F.max(F.when(F.col("source") > F.col("at"), F.col("at"))).alias("prefix"))
    far = F.max("high").over(Window.partitionBy("c").orderBy("at"))
    open_ = met.withColumn("far", far).join(arcs, F.col("c") == F.col("_c"))
    covered = (F.col("far") > F.col("at")) | F.coalesce(F.col("at") >= F.col("suffix"), F.lit(False)) | F.coalesce(F.col("at") < F.col("prefix"), F.lit(False))
    single = cut(open_.filter(~covered).select(F.col("c").alias("component"), "a", "b", F.lit(True).alias("single")))
    others = inner.withColumnRenamed("c", "component").join(single.select("component").distinct(), "component", "left_anti")
    size = others.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    walked = others.join(size.filter(F.col("_n") <= WALKED).select("component"), "component", "left_semi")
    huge = others.join(size.filter(F.col("_n") > WALKED).select("component"), "component", "left_semi").filter("a > b")
    back = walked.groupBy("component").applyInPandas(_leading_back, "component string, a string, b string").unionByName(huge)
    return single.unionByName(back.withColumn("single", F.lit(False)))


def _leading_back(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges of one component that a depth-first walk in name order finds leading to a vertex it is still below."""
    out = {a: sorted(g) for a, g in edges.groupby("a")["b"]}
    below, left, found = set(), set(), []
    for root in sorted(out):
        trail = [] if root in left else [(root, iter(out[root]))]
        below.update(v for v, _ in trail)
        while trail:
            v, ways = trail[-1]
            w = next(ways, None)
            if w is None:
                trail.pop()
                below.discard(v)
                left.add(v)
            elif w in below:
                found.append((v, w))
            elif w not in left:
                below.add(w)
                trail.append((w, iter(out.get(w, []))))
    return pd.DataFrame({"component": edges["component"].iloc[0], "a": [a for a, _ in found], "b": [b for _, b in found]})


def connected(edges: DataFrame) -> DataFrame:
    """(v, g): the smallest vertex of each vertex's connected component; direction doesn't matter. Each round a vertex takes the least label
    beside it and then that label's own, so rounds grow with the logarithm of a component's width. A hub's labels are folded on the
    map side."""
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = cut(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("g")).select("v", F.least("v", "g").alias("g")))
    while True:
        beside = both.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("g").alias("m"))
        near = label.join(beside, F.col("v") == F.col("a")).select("v", F.col("g").alias("old"), F.least("g", "m").alias("g"))
        far = label.select(F.col("v").alias("w"), F.col("g").alias("far"))
        step = cut(near.join(far, F.col("g") == F.col("w"), "left").select("v", F.least("g", F.coalesce("far", "g")).alias("g"), "old"))
        label = step.drop("old")
        if step.filter("g <> old").isEmpty():
            return label


def instability(edges: DataFrame) -> DataFrame:
    """(k, v): outgoing over all edges of each vertex; edges are distinct and without self-loops."""
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("ce"), F.lit(0).alias("ca")).unionByName(edges.select(F.col("b").alias("k"), F.lit(0).alias("ce"), F.lit(1).alias("ca")))
    return ends.groupBy("k").agg(F.sum("ce").alias("ce"), F.sum("ca").alias("ca")).select("k", (F.col("ce") / (F.col("ca") + F.col("ce"))).alias("v"))


def unstable_dependencies(edges: DataFrame, margin: float) -> DataFrame:
    """Edges towards a vertex that is less stable by at least `margin`."""
    x, y = instability(edges).toDF("xk", "xv"), instability(edges).toDF("yk", "yv")
    gap = F.col("yv") - F.col("xv")
    return edges.join(x, F.col("a") == F.col("xk")).join(y, F.col("b") == F.col("yk")).filter(gap + 1e-9 >= margin).select("a", "b", gap.alias("margin"))


def cochange(touched: DataFrame, max_files: int, least: int, share: int) -> DataFrame:
    """Pairs of files (a < b) changed together in at least `least` commits (o) and in `share` percent of those that touch
    either; commits of more than max_files files don't count, which bounds the pairs of a commit."""
    t = touched.select("o", "f").distinct()
    small = t.groupBy("o").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= max_files).select("o")
    kept = t.join(small, "o", "left_semi")
    single = kept.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    files = kept.groupBy("o").agg(F.sort_array(F.collect_list("f")).alias("fs"))  # at most max_files
    pair = F.expr("explode(flatten(transform(fs, (x, i) -> transform(slice(fs, i + 2, size(fs)), y -> struct(x AS a, y AS b)))))")
    both = files.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("nb")).filter(F.col("nb") >= least)
    s1, s2 = single.toDF("f1", "n1"), single.toDF("f2", "n2")
    j = both.join(s1, F.col("a") == F.col("f1")).join(s2, F.col("b") == F.col("f2")).withColumn("ne", F.col("n1") + F.col("n2") - F.col("nb"))
    return j.filter(F.col("nb") * 100 >= F.col("ne") * share).select("a", "b", "nb", "ne")


#: Extensions of code, names of registries that everything edits, and what isn't judged.
CODE = r"\.(rs|py|ts|tsx|js|jsx|go|java|kt|c|cc|cpp|h|hpp|cs)$"
REGISTRY = r"(^|/)(lib\.rs|main\.rs|mod\.rs|__init__\.py|index\.ts|index\.js)$"
UNJUDGED = r"(^|/)(tests|test|benches|examples|node_modules)/|(^|/)(build\.rs|(index|tests)\.[^/.]*|[^/]*_test[^/]*|test_[^/]*|[^/]*\.(test|spec)[^/]*)$"


def divergent_changes(touched: DataFrame, least: int = 3, max_files: int = 25) -> DataFrame:
    """(f, groups, commits): judged files whose commits (o) fall into two or more groups of at least `least` commits that
    share no partner file. Commits of more than max_files files don't count, nor partners that over a fifth of the kept
    commits (five at least) touch, nor registries and files other than code."""
    t = touched.select("o", "f").distinct()
    small = t.groupBy("o").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= max_files).select("o")
    kept = cut(t.join(small, "o", "left_semi"))
    n = kept.agg(F.countDistinct("o")).first()[0]
    common = kept.groupBy("f").agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") >= 5) & (F.col("c") * 5 > n)).select("f")
    partner = kept.filter(F.col("f").rlike(CODE) & ~F.col("f").rlike(REGISTRY)).join(common, "f", "left_anti").select("o", F.col("f").alias("p"))
    judged = kept.filter(F.col("f").rlike(CODE) & ~F.col("f").rlike(REGISTRY) & ~F.col("f").rlike(UNJUDGED))
    # a commit has at most max_files files, so the pairs of a commit are bounded
    links = cut(judged.join(partner, "o").filter("f <> p").select("f", "o", "p"))
    # per file, commits that share a partner hang together
    end = lambda k, c: F.concat_ws("\x01", "f", F.lit(k), c)
    group = connected(links.select(end("o", "o").alias("a"), end("p", "p").alias("b")).distinct())
    label = links.select("f", "o", end("o", "o").alias("_v")).distinct().join(group, F.col("_v") == F.col("v")).select("f", "o", "g")
    groups = label.groupBy("f", "g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    return groups.groupBy("f").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("commits")).filter("groups >= 2")
