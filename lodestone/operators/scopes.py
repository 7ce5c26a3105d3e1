"""Nested scopes of source files: what encloses a place, and qualified names.

Scopes (repo, path, name, start, stop) of a file nest properly; a place belongs to those with start <= place <= stop. Opening
and closing edges and the places are put in one order per file, and a running count gives the depth at each. The scope of depth k
that encloses a place is the last that opened at depth k, so one window over a file yields the whole chain: places and scopes
are never joined. A file is at most what the readers take of one (2 MiB), which bounds a window.

Cases: an empty table gives an empty result; places without a scope around them have an empty chain; scopes of equal span nest by
name; scopes with a null end or that end before they start are ignored; a null path or repository is a group of its own; extra
columns of the places are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rules import finding

COL = F.col
#: Words of names of functions that are boundaries, and of comments that say why a catcher stands elsewhere.
BOUNDARY_NAMES = [
    "main", "run", "serve", "handle", "handler", "dispatch", "worker", "listener", "supervise", "supervisor", "boundary", "entry", "entrypoint",
    "extern", "ffi", "callback", "trampoline",
]
BOUNDARY_WORDS = ["boundary", "outermost", "top-level", "top level", "ffi", "isolate", "supervis", "must not unwind", "across the"]


def enclosing(scopes: DataFrame, places: DataFrame, at: str = "at") -> DataFrame:
    """The places (repo, path, <at>, ...) with `chain`, the names of the scopes around each, outermost first."""
    sound = scopes.filter((COL("start") <= COL("stop")) & COL("name").isNotNull())
    edge = lambda kind, pos, first, step: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), first.cast("long").alias("first"), F.lit(step).alias("step"))
    ends = F.explode(F.array(edge(0, COL("start"), -COL("stop"), 1), edge(2, COL("stop"), F.lit(0), -1))).alias("e")
    own = [c for c in places.columns if c not in ("repo", "path", "chain")]
    here = places.select("repo", "path", edge(1, COL(at), F.lit(0), 0).alias("e"), F.lit(None).cast("string").alias("name"), F.struct(*own).alias("row"))
    rows = sound.select("repo", "path", ends, "name").unionByName(here, allowMissingColumns=True)
    by = Window.partitionBy("repo", "path").orderBy("e.pos", "e.kind", "e.first", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = rows.withColumn("depth", F.sum("e.step").over(by))
    most = deep.agg(F.max("depth")).first()[0] or 0
    opened = lambda k: F.last(F.when((COL("e.kind") == 0) & (COL("depth") == k), COL("name")), ignorenulls=True).over(by)
    chain = F.slice(F.array(*[opened(k) for k in range(1, most + 1)]), F.lit(1), COL("depth").cast("int")) if most else F.array().cast("array<string>")
    return deep.withColumn("chain", chain).filter("e.kind = 1").select("repo", "path", *[COL("row")[c].alias(c) for c in own], "chain")


def qualified(scopes: DataFrame, items: DataFrame, at: str = "at", name: str = "name") -> DataFrame:
    """The items with `qualified`: the names around each and its own, joined by `::`. An item that is a scope itself (it starts one of
    its name where it stands) is named once."""
    own = enclosing(scopes, items, at)
    outer = F.when(F.element_at("chain", F.greatest(F.size("chain"), F.lit(1))) == COL(name), F.slice("chain", F.lit(1), F.greatest(F.size("chain") - 1, F.lit(0)))).otherwise(COL("chain"))
    return own.withColumn("qualified", F.array_join(F.concat(F.when(F.size("chain") > 0, outer).otherwise(COL("chain")), F.array(name)), "::")).drop("chain")


def look_up(items: DataFrame, asked: DataFrame) -> DataFrame:
    """What a tool names by line (repo, path, line, name, ...) with `qualified` of the one item (repo, path, line, name, qualified) that
    stands there; the bare name where none or several do, never a guess."""
    key = ["repo", "path", "line", "name"]
    one = items.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first("qualified").alias("_q")).filter("_n = 1").drop("_n")
    return asked.join(one, key, "left").select(*[asked[c] for c in asked.columns], F.coalesce("_q", asked["name"]).alias("qualified"))


def _words(name: Column) -> Column:
    return F.split(F.lower(name), "_")


def stray_catchers(catchers: DataFrame, functions: DataFrame, comments: DataFrame) -> DataFrame:
    """ERR-002: panic catchers (repo, path, line, is_binary) whose innermost function (repo, path, name, start, stop; lines) is no
    boundary by its name, and that no comment (repo, path, line, text) on their line or the three above explains."""
    said = comments.filter(F.lower("text").rlike("|".join(BOUNDARY_WORDS)))
    excused = said.select("repo", "path", F.explode(F.sequence(COL("line"), COL("line") + 3)).alias("line")).distinct()
    around = enclosing(functions, catchers.filter(~F.coalesce("is_binary", F.lit(False))), "line")
    inner = around.withColumn("fn", F.coalesce(F.get("chain", F.size("chain") - 1), F.lit("")))
    bad = inner.filter(~F.arrays_overlap(_words(COL("fn")), F.array(*map(F.lit, BOUNDARY_NAMES)))).join(excused, ["repo", "path", "line"], "left_anti")
    return finding(bad, "ERR-002", "medium", "medium", COL("path"), COL("line"), F.concat_ws(":", "path", "fn"), F.concat(F.lit("catches every panic away from a boundary in "), F.col("fn")))


def pass_throughs(functions: DataFrame) -> DataFrame:
    """MOD-008: functions (repo, path, line, name, qualified, params, callee, args, in_trait, is_facade) whose whole body is one call that hands on
    all parameters, in order and unchanged. `params` and `args`: arrays of text, `self` among the parameters and what the call is
    made on (`self.x`) before the callee's name as written; constructors and calls on a field aren't wrappers, nor are functions
    that hand on nothing but themselves."""
    handed = F.filter("params", lambda p: p != "self")
    # an argument may be the receiver or a field of it beside the parameters
    kept = F.filter("args", lambda a: ~a.rlike(r"^&?(mut )?self(\.\w+)*$"))
    last = F.element_at(F.split("callee", r"::|\."), -1)
    bad = functions.filter((F.size(handed) > 0) & (kept == handed) & ~last.rlike("^[A-Z]") & ~COL("callee").rlike(r"^self\.\w+(\.\w+)+$"))
    bad = bad.filter(~F.coalesce("in_trait", F.lit(False)) & ~F.coalesce("is_facade", F.lit(False)))
    return finding(bad, "MOD-008", "info", "low", COL("path"), COL("line"), COL("qualified"), F.concat(F.col("qualified"), F.lit(" hands all its parameters to "), F.col("callee")))
