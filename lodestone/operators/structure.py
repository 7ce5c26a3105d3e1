"""Structure of types, paths and histories: clusters of methods, resolved names, fresh versions, windows of commits.

Cases: an empty table gives an empty result; repeated rows count once; rows with a null key are ignored; extra columns are ignored unless
said otherwise.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import semver_key
from lodestone.operators.graph import connected, cut
from lodestone.operators.rules import finding

COL = F.col
#: What makes a split of a type worth telling, methods from which a type can have hub fields, and commits that are read.
MIN_CLUSTERS, MIN_CLUSTER_METHODS, MIN_METHODS, HUB_MIN_METHODS, WINDOW = 2, 2, 4, 8, 500
TYPE = ["repo", "package", "type"]
#: Rows of a type up to which a task holds them; larger types are joined.
HELD = 50_000


# Histories.


def newest_commits(touched: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows (repo, o, at, f, ...) of each repository's newest `window` commits by at, then o. The limit is pushed below the
    shuffle, so a task sends no more than so many commits of a repository, however many it has."""
    each = touched.select("repo", "o", "at").filter("repo IS NOT NULL AND o IS NOT NULL").distinct()
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), "o"))
    kept = each.withColumn("_k", rank).filter(COL("_k") <= window).select(COL("repo").alias("_r"), COL("o").alias("_o"))
    return touched.join(kept, (COL("repo") == COL("_r")) & (COL("o") == COL("_o")), "left_semi")


def at_head(touched: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose file (repo, f) is still there."""
    return touched.join(files.select("repo", "f").distinct(), ["repo", "f"], "left_semi").select(*touched.columns)


# Types.


def _joined_clusters(methods: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """method_clusters() by joins: fields move up the calls of all types at once, and clusters are connected components."""
    key = [*TYPE, "method"]
    reach = cut(uses.select(*key, "field").dropna().distinct())
    named = calls.select(*key, "callee").dropna().filter(COL("method") != COL("callee")).distinct()
    new = reach
    while not new.isEmpty():  # fields move up the calls, new ones alone
        up = new.withColumnRenamed("method", "callee").join(named, [*TYPE, "callee"]).select(*key, "field").distinct()
        new = cut(up.join(reach, [*key, "field"], "left_anti"))
        reach = cut(reach.unionByName(new).distinct())
    thick = methods.filter(~F.coalesce("thin", F.lit(False))).select(*key).dropna().distinct()
    nodes = cut(reach.join(thick, key, "left_semi"))
    sizes = nodes.groupBy(*TYPE).agg(F.countDistinct("method").alias("n"))
    hubs = nodes.groupBy(*TYPE, "field").agg(F.count(F.lit(1)).alias("_c")).join(sizes, TYPE).filter((COL("n") >= HUB_MIN_METHODS) & (2 * COL("_c") > COL("n")))
    left = nodes.join(hubs.select(*TYPE, "field"), [*TYPE, "field"], "left_anti")
    at = lambda kind, c: F.concat_ws("\x01", *TYPE, F.lit(kind), c)
    left = cut(left.withColumn("_m", at("m", "method")).withColumn("_f", at("f", "field")))
    groups = connected(left.select(COL("_m").alias("a"), COL("_f").alias("b")))
    told = left.join(groups, COL("_m") == COL("v")).groupBy(*TYPE, COL("g").alias("cluster")).agg(F.array_sort(F.collect_set("method")).alias("methods"), F.array_sort(F.collect_set("field")).alias("fields"))
    return told.join(sizes, TYPE)


def _clusters(thick: set, uses: list, calls: list, least: int, size: int) -> list:
    """[(methods, fields, n)] of one type: fields move up to callers until none is new, hubs go, methods that share a field unite."""
    reach, callers = {}, {}
    for m, f in uses:
        reach.setdefault(m, set()).add(f)
    for m, k in calls:
        callers.setdefault(k, set()).add(m)
    moved = list(reach)
    while moved:
        k = moved.pop()
        for m in callers.get(k, ()):
            own = reach.setdefault(m, set())
            if not reach[k] <= own:
                own |= reach[k]
                moved.append(m)
    nodes = {m: reach[m] for m in reach if m in thick}
    n = len(nodes)
    if n < least:
        return []
    of = {}
    for m, fields in nodes.items():
        for f in fields:
            of.setdefault(f, []).append(m)
    left = {f: ms for f, ms in of.items() if n < HUB_MIN_METHODS or 2 * len(ms) <= n}
    home, groups = {}, {}
    for f, ms in left.items():
        met = {home[m] for m in ms if m in home}
        to = max(met, key=lambda g: len(groups[g][0]), default=f)
        inside, shared = groups.setdefault(to, (set(), []))
        shared.append(f)
        for g in met - {to}:
            more = groups.pop(g)
            inside |= more[0]
            shared += more[1]
            home.update(dict.fromkeys(more[0], to))
        inside.update(ms)
        home.update(dict.fromkeys(ms, to))
    return [(sorted(ms), sorted(fs), n) for ms, fs in groups.values() if len(ms) >= size]


def _held_clusters(least: int, size: int, held: int):
    """Clusters of types whose rows follow each other; a type of over `held` rows is only named, with `large`."""

    def run(batches):
        key, rows, found = None, [], []

        def close():
            if len(rows) > held:
                found.append((key, (None, None, None), True))
                return
            thick = {m for m, f, k in rows if f is None and k is None}
            if len(thick) >= least:
                uses, calls = [(m, f) for m, f, _ in rows if f is not None], [(m, k) for m, _, k in rows if k is not None]
                found.extend((key, c, False) for c in _clusters(thick, uses, calls, least, size))

        def told(schema):
            kind = {c: schema.field(c).type for c in (*TYPE, "method", "field")}
            columns = [pa.array([k[i] for k, _, _ in found], kind[c]) for i, c in enumerate(TYPE)]
            columns += [pa.array([c[i] for _, c, _ in found], pa.list_(kind[x])) for i, x in enumerate(("method", "field"))]
            columns += [pa.array([c[2] for _, c, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.bool_())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, [*TYPE, "methods", "fields", "n", "large"])

        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for k, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if k != key:
                    if rows:
                        close()
                    key, rows = k, []
                if len(rows) <= held:
                    rows.append(row)
            if found:
                yield told(schema)
        if rows:
            close()
        if found:
            yield told(schema)

    return run


def method_clusters(methods: DataFrame, uses: DataFrame, calls: DataFrame, least: int = 1, size: int = 1, held: int = HELD) -> DataFrame:
    """(repo, package, type, cluster, methods, fields, n): groups of a type's methods that share fields, their own or those of the siblings they
    call. methods (repo, package, type, method, thin), uses (..., method, field), calls (..., method, callee). Thin methods and those
    that reach no field are in no group; nor are fields that over half of a large type's methods reach. n: methods of the type
    that reach a field. Every type of every repository is worked on at once. Only
    clusters of `size` methods or more in types of `least` such methods are told. A type's rows meet in one shuffle and are worked on
    as they pass; types of over `held` rows, repeats included, are joined."""
    key = [*TYPE, "method"]
    kind = methods.schema["method"].dataType
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    thick = methods.filter(~F.coalesce("thin", F.lit(False))).select(*key).dropna().select(*key, none(uses, "field"), F.lit(None).cast(kind).alias("callee"))
    used = uses.select(*key, "field").dropna().select(*key, "field", F.lit(None).cast(kind).alias("callee"))
    called = calls.select(*key, "callee").dropna().filter(COL("method") != COL("callee")).select(*key, none(uses, "field"), COL("callee").cast(kind).alias("callee"))
    rows = thick.unionByName(used).unionByName(called).repartition(*TYPE).sortWithinPartitions(*TYPE)
    name = T.StructType([rows.schema[c] for c in TYPE])
    schema = name.add("methods", T.ArrayType(rows.schema["method"].dataType)).add("fields", T.ArrayType(rows.schema["field"].dataType)).add("n", "long").add("large", "boolean")
    told = cut(rows.mapInArrow(_held_clusters(least, size, held), schema))
    strings = lambda c: COL(c).cast("array<string>")
    near = told.filter("NOT large").select(*TYPE, F.concat_ws("\x01", *TYPE, F.lit("f"), F.array_min(strings("fields"))).alias("cluster"), F.array_sort("methods").alias("methods"), F.array_sort("fields").alias("fields"), "n")
    large = told.filter("large").select(*TYPE)
    if large.isEmpty():
        return near
    of = lambda df: df.join(large, TYPE, "left_semi")
    return near.unionByName(_joined_clusters(of(methods), of(uses), of(calls)).filter((COL("n") >= least) & (F.size("methods") >= size)))


def mixed_types(types: DataFrame, methods: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """MOD-004: types (repo, package, type, path, line) whose methods fall into several clusters of several methods each. Types of equal name in
    one package aren't judged."""
    large = method_clusters(methods, uses, calls, MIN_METHODS, MIN_CLUSTER_METHODS)
    several = large.groupBy(*TYPE).agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.array_join("methods", "+"))).alias("names")).filter(COL("k") >= MIN_CLUSTERS)
    one = types.join(several.select(*TYPE), TYPE, "left_semi").groupBy(*TYPE).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("path", "line")).alias("at")).filter("_n = 1")
    bad = several.join(one, TYPE)
    return finding(bad, "MOD-004", "info", "low", COL("at.path"), COL("at.line"), COL("type"), F.concat(F.lit("clusters of methods that share fields: "), F.array_join("names", ", ")))


# Paths of names.


def prefixes(path: Column) -> Column:
    """All beginnings of a path of `::` segments, the path itself last."""
    parts = F.split(path, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))


def _rewritten(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows (_id, repo, path) with the longest beginning that is an alias replaced by its target, and whether one was."""
    begun = rows.select("_id", "repo", "path", F.explode(prefixes(COL("path"))).alias("_p"))
    met = begun.join(aliases.select("repo", COL("alias").alias("_p"), "target"), ["repo", "_p"]).groupBy("_id").agg(F.max(F.struct(F.length("_p").alias("n"), "target")).alias("_t"))
    out = rows.join(met, "_id", "left")
    rest = F.substring("path", COL("_t.n") + 1, F.lit(1 << 30))
    return out.select(*rows.columns, F.coalesce(F.concat("_t.target", rest), "path").alias("_new"))


def resolved_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases (repo, alias, target), one target each, whose targets aren't aliases themselves: each round every target is rewritten by
    all targets so far, so chains of any length halve. After as many rounds as the number of aliases has binary digits only what
    runs into a cycle still moves: that keeps the target it was given, as does an alias whose target begins with itself."""
    one = aliases.select("repo", "alias", "target").dropna().groupBy("repo", "alias").agg(F.min("target").alias("target")).filter(COL("alias") != COL("target"))
    loops = lambda t: F.exists(prefixes(t), lambda p: p == COL("alias"))
    given = cut(one.withColumn("_id", F.concat_ws("\x01", "repo", "alias")))
    table, step = given, given.withColumn("_moved", F.lit(False))
    for _ in range(given.count().bit_length() + 1):
        moved = _rewritten(table.select("_id", "repo", "alias", COL("target").alias("path")), table.filter(~loops(COL("target"))))
        # what would come back to the alias itself stays where it was
        new = F.when(loops(COL("_new")) | loops(COL("path")), COL("path")).otherwise(COL("_new"))
        step = cut(moved.select("repo", "alias", new.alias("target"), "_id", (new != COL("path")).alias("_moved")))
        table = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            break
    first = given.select(COL("_id").alias("_g"), COL("target").alias("_first"))
    return step.join(first, COL("_id") == COL("_g")).select("repo", "alias", F.when(COL("_moved"), COL("_first")).otherwise(COL("target")).alias("target"))


def resolved_paths(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The names (repo, path, ...) with `resolved`: their longest beginning that is an alias replaced by what it stands for, to the end."""
    known = resolved_aliases(aliases)
    each = names.select("repo", "path").dropna().distinct().withColumn("_id", F.concat_ws("\x01", "repo", "path"))
    found = _rewritten(each, known).select(COL("repo").alias("_repo"), COL("path").alias("_path"), COL("_new").alias("resolved"))
    return names.join(found, (COL("repo") == COL("_repo")) & (COL("path") == COL("_path")), "left").drop("_repo", "_path")


def impure_names(names: DataFrame, aliases: DataFrame, effects: DataFrame, pure: DataFrame) -> DataFrame:
    """EFX-001: names (repo, component, file, line, path) in a component declared pure (repo, component) whose resolved path begins, by whole
    segments, with an effectful API (prefix). A path meets the effects by its beginnings, on equal keys."""
    inside = resolved_paths(names.join(pure.select("repo", "component").distinct(), ["repo", "component"], "left_semi"), aliases)
    begun = inside.withColumn("_p", F.explode(prefixes(F.coalesce("resolved", "path"))))
    bad = begun.join(effects.select(COL("prefix").alias("_p")).distinct(), "_p", "left_semi").dropDuplicates(["repo", "file", "line", "path"])
    return finding(bad, "EFX-001", "low", "medium", COL("file"), COL("line"), F.concat_ws(":", "component", "resolved"), F.concat(F.lit("a pure component names "), COL("resolved")))


def bypassed_exports(names: DataFrame, exports: DataFrame) -> DataFrame:
    """MOD-003: names (repo, file, line, module, path) that reach into a sibling module past one of its re-exports (repo, alias, target): the path is, or
    lies below, a target, and its module isn't within the re-exporting one. One finding per file, at the first."""
    begun = names.withColumn("_p", F.explode(prefixes(COL("path"))))
    met = begun.join(exports.select("repo", COL("target").alias("_p"), "alias"), ["repo", "_p"])
    owner = F.regexp_replace("alias", "::[^:]*$", "")
    past = met.filter((COL("module") != owner) & ~COL("module").startswith(F.concat(owner, F.lit("::"))) & COL("_p").startswith(F.concat(owner, F.lit("::"))))
    per = past.groupBy("repo", "file").agg(F.countDistinct("line", "path").alias("n"), F.min(F.struct("line", "path", "alias")).alias("x"))
    return finding(per, "MOD-003", "info", "low", COL("file"), COL("x.line"), COL("file"), F.concat(F.lit("paths past a re-export: "), COL("n").cast("string"), F.lit(", first "), COL("x.path"), F.lit(" for "), COL("x.alias")))


# Versions.


def compatible_line(version: Column) -> Column:
    """What versions may replace each other: equal first number that isn't 0, or all up to it."""
    k = semver_key(version)
    return F.when(k["major"] > 0, F.concat_ws(".", k["major"])).when(k["minor"] > 0, F.concat_ws(".", F.lit(0), k["minor"])).otherwise(F.concat_ws(".", F.lit(0), F.lit(0), k["patch"]))


def stale_dependencies(locked: DataFrame, releases: DataFrame) -> DataFrame:
    """SUP-015: locked packages (repo, path, name, version, direct) older than the newest release (name, version, yanked) there is: medium where a
    member declares the package, else low. Releases are folded to one row per package and per line of compatible versions before
    they meet the locks, so no package meets its releases one by one. Pre-releases and yanked ones are no releases."""
    key = semver_key(COL("version"))
    sound = releases.filter(~F.coalesce("yanked", F.lit(False)) & key["parsable"] & key["is_release"]).select("name", "version", key.alias("_k"), compatible_line(COL("version")).alias("_line"))
    newest = F.max(F.struct("_k", "version"))
    top = sound.groupBy("name").agg(newest.alias("_top"))
    line = sound.groupBy("name", "_line").agg(newest.alias("_near"))
    at = locked.select("repo", "path", "name", "version", F.coalesce("direct", F.lit(False)).alias("direct"), key.alias("_at"), compatible_line(COL("version")).alias("_line"))
    met = at.join(top, "name").join(line, ["name", "_line"], "left").filter("_at < _top._k")
    # of several locked versions of a package, the one furthest behind stands for it
    per = met.groupBy("repo", "path", "name").agg(F.max("direct").alias("direct"), F.min(F.struct("_at", "version", F.col("_top.version").alias("top"), F.when(COL("_near._k") > COL("_at"), COL("_near.version")).alias("near"))).alias("x"))
    how = F.when(COL("x.near").isNotNull(), F.concat(F.lit(", compatible "), COL("x.near"))).otherwise("")
    return finding(per, "SUP-015", F.when(COL("direct"), "medium").otherwise("low"), "high", COL("path"), None, COL("name"), F.concat(COL("x.version"), F.lit(" is locked, newest "), COL("x.top"), how))
