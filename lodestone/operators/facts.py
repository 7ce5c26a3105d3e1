"""Audit rules as queries over fact tables: parameters, functions, statements, tests, attributes, dependencies, diagnostics.

The tables are given (a parser's or a tool's output read as rows); nothing is parsed here. Each function names the columns that
it reads and returns rows of the findings schema.

Cases: an empty table gives an empty result; rows that repeat count once where a rule counts names and as often as they stand
there where it counts sites; a null key, path or line equals nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import semver_key
from lodestone.operators.graph import cut, dissolving_edges, instability, strong_components
from lodestone.operators.rules import finding

COL = F.col

#: Limits of the rules.
MIN_BOOLS = 2
MAX_PARAMS, MAX_NESTING = 7, 5
COMPLEX, VERY_COMPLEX = 15, 30
MIN_LITERALS = 3
MIN_METHODS, MIN_STUBS = 6, 3
MIN_EXPECTATIONS, MIN_TIMES = 4, 3
GROWN_ITEMS, GROWN_PERCENT = 10, 25
#: Parts of a pair's commits of which each gives its newest one.
PARTS = 64
#: Macros that print.
PRINT_MACROS = ["println", "print", "eprintln", "eprint", "dbg"]
#: Words of names that hold money, and words of names that do not although one of the former is in them.
MONEY = ["price", "cost", "balance", "fee", "salary", "wage", "payment", "amount", "money", "revenue", "charge"]
NOT_MONEY = [
    "rate", "ratio", "percent", "percentage", "pct", "factor", "scale", "weight", "threshold", "elasticity", "multiplier",
    "fraction", "probability", "score", "delta", "epsilon", "tolerance", "bps",
]


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _in(name: str) -> Column:
    """Subject of a site in a function: path:function:name."""
    return F.concat_ws(":", "path", "fn", name)


# Signatures: params (repo, path, line, fn, name, type); line is that of the function.


def bool_params(params: DataFrame, least: int = MIN_BOOLS) -> DataFrame:
    """TYP-007: a function with several bare `bool` parameters."""
    per = params.filter("type = 'bool'").groupBy("repo", "path", "line", "fn").agg(F.count(F.lit(1)).alias("n")).filter(COL("n") >= least)
    return finding(per, "TYP-007", "low", "medium", COL("path"), COL("line"), COL("fn"), _text(COL("n"), " bare bool parameters"))


def wide_functions(params: DataFrame, most: int = MAX_PARAMS) -> DataFrame:
    """RDB-004, parameters: a function with more than `most`."""
    per = params.groupBy("repo", "path", "line", "fn").agg(F.count(F.lit(1)).alias("n")).filter(COL("n") > most)
    return finding(per, "RDB-004", "low", "medium", COL("path"), COL("line"), COL("fn"), _text(COL("n"), " parameters"))


def deep_functions(blocks: DataFrame, least: int = MAX_NESTING) -> DataFrame:
    """RDB-004, nesting: blocks (repo, path, line, fn, depth), where one is `least` deep or deeper."""
    per = blocks.groupBy("repo", "path", "line", "fn").agg(F.max("depth").alias("n")).filter(COL("n") >= least)
    return finding(per, "RDB-004", "low", "medium", COL("path"), COL("line"), COL("fn"), _text("nested ", COL("n"), " deep"))


def float_money(names: DataFrame) -> DataFrame:
    """TYP-005: names (repo, path, line, name, type) of money whose type holds f32 or f64."""
    words = F.filter(F.split(F.lower("name"), "_"), lambda w: w != "")
    forms = F.concat(words, F.transform(words, lambda w: F.regexp_replace(w, "s$", "")))
    named = lambda known: F.arrays_overlap(forms, F.array(*map(F.lit, known)))
    bad = names.filter(named(MONEY) & ~named(NOT_MONEY) & COL("type").rlike(r"(?<![\w:])f(32|64)\b"))
    return finding(bad, "TYP-005", "medium", "low", COL("path"), COL("line"), _text(COL("path"), ":", COL("name")), _text(COL("name"), " is money in ", COL("type")))


def complexity(increments: DataFrame) -> DataFrame:
    """RDB-003: increments (repo, path, line, fn, amount) of cognitive complexity, summed per function."""
    per = increments.groupBy("repo", "path", "line", "fn").agg(F.sum("amount").alias("n")).filter(COL("n") > COMPLEX)
    return finding(per, "RDB-003", F.when(COL("n") > VERY_COMPLEX, "medium").otherwise("low"), "medium", COL("path"), COL("line"), COL("fn"), _text("cognitive complexity ", COL("n")))


def string_chains(literals: DataFrame, least: int = MIN_LITERALS) -> DataFrame:
    """TYP-002: literals (repo, path, line, literal) of the arms of a match or if-chain, whose line names it."""
    per = literals.groupBy("repo", "path", "line").agg(F.countDistinct("literal").alias("n")).filter(COL("n") >= least)
    return finding(per, "TYP-002", "low", "medium", COL("path"), COL("line"), _text(COL("path"), ":", COL("line")), _text("branches on string literals: ", COL("n")))


def missing_sections(fns: DataFrame) -> DataFrame:
    """COR-001: fns (repo, path, line, fn, required, present; both arrays of section names) that lack a required section."""
    lacks = F.array_except("required", F.coalesce("present", F.array().cast("array<string>")))
    bad = fns.withColumn("_lacks", F.sort_array(lacks)).filter(F.size("_lacks") > 0)
    return finding(bad, "COR-001", "low", "medium", COL("path"), COL("line"), F.concat_ws(":", "path", "fn", "line"), _text("undocumented: ", F.array_join("_lacks", ", ")))


# Statements.


def unjustified(sites: DataFrame, comments: DataFrame, above: int = 3) -> DataFrame:
    """Sites (repo, path, line, ...) without a comment (repo, path, line) on their line or the `above` lines before it. Each
    comment is spread over the lines that it excuses, so that the two meet on equal keys and no range is searched."""
    excused = comments.select("repo", "path", F.explode(F.sequence(COL("line"), COL("line") + above)).alias("line")).distinct()
    return sites.join(excused, ["repo", "path", "line"], "left_anti").select(*sites.columns)


#: Fixed values by check: severity, confidence, lines above a site whose comments count, and what names it.
SITES = {
    "CON-005": ("medium", "medium", 3, "path:fn:subject"), "ERR-001": ("medium", "medium", 3, "repo"), "ERR-011": ("medium", "medium", 3, "path:fn:subject"),
    "EFX-007": ("low", "medium", 1, "path:subject"),
}


def unjustified_sites(sites: DataFrame, comments: DataFrame, check: str) -> DataFrame:
    """CON-005, ERR-001, ERR-011, EFX-007: sites (repo, path, line, fn, subject) that no comment explains."""
    severity, confidence, above, named = SITES[check]
    subject = F.concat_ws(":", *named.split(":"))
    return finding(unjustified(sites, comments, above), check, severity, confidence, COL("path"), COL("line"), subject, "no comment gives a reason")


#: Fixed values by check: severity, confidence, key and subject.
PER = {"CON-010": ("low", "low", "package", "package"), "TYP-006": ("medium", "high", "path", "repo")}


def unjustified_per(sites: DataFrame, comments: DataFrame, check: str) -> DataFrame:
    """CON-010 (per package), TYP-006 (per file): one finding per key with the number of such sites, at the first."""
    severity, confidence, key, subject = PER[check]
    per = unjustified(sites, comments).groupBy("repo", key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("first"))
    return finding(per, check, severity, confidence, COL("first.path"), COL("first.line"), COL(subject), _text("sites without a reason: ", COL("n")))


def guards_across_awaits(guards: DataFrame, awaits: DataFrame) -> DataFrame:
    """CON-002: guards (repo, path, line, fn, guard, start, stop) with an await (repo, path, fn, seq) after start and up to stop.
    The next await is one running minimum per function: guards and awaits aren't joined."""
    g = guards.select("repo", "path", "fn", COL("start").cast("long").alias("at"), COL("stop").cast("long").alias("stop"), "line", "guard", F.lit(True).alias("is_guard"))
    a = awaits.select("repo", "path", "fn", COL("seq").cast("long").alias("at"), F.lit(False).alias("is_guard"))
    later = Window.partitionBy("repo", "path", "fn").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    met = g.unionByName(a, allowMissingColumns=True).withColumn("next", F.min(F.when(~COL("is_guard"), COL("at"))).over(later))
    bad = met.filter(COL("is_guard") & (COL("next") <= COL("stop")))
    return finding(bad, "CON-002", "medium", "medium", COL("path"), COL("line"), _in("guard"), _text("held across an await: ", COL("guard")))


def late_releases(stmts: DataFrame) -> DataFrame:
    """ERR-007: stmts (repo, path, fn, block, seq, line, kind, name) of kinds bind, exit and release: a release with an exit between
    it and the last binding of its name before it, in one block."""
    block = Window.partitionBy("repo", "path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("repo", "path", "block", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    w = stmts.withColumn("_exit", F.max(F.when(COL("kind") == "exit", COL("seq"))).over(block))
    w = w.withColumn("_bind", F.max(F.when(COL("kind") == "bind", COL("seq"))).over(same))
    bad = w.filter((COL("kind") == "release") & (COL("_exit") > COL("_bind")))
    return finding(bad, "ERR-007", "medium", "low", COL("path"), COL("line"), _in("name"), _text("released after an early exit: ", COL("name")))


def absorbing_arms(arms: DataFrame, variants: DataFrame) -> DataFrame:
    """EXT-001: catch-all arms (repo, path, line, fn, enum, listed array) that absorb a variant (repo, path, enum, variant) which they
    don't list, outside the file that defines the enum. Enums of equal name in two files aren't judged."""
    known = variants.groupBy("repo", "enum").agg(F.collect_set("variant").alias("_all"), F.min("path").alias("_home"), F.countDistinct("path").alias("_n")).filter("_n = 1")
    left = F.sort_array(F.array_except("_all", F.coalesce("listed", F.array().cast("array<string>"))))
    bad = arms.join(known, ["repo", "enum"]).filter(COL("path") != COL("_home")).withColumn("_left", left).filter(F.size("_left") > 0)
    return finding(bad, "EXT-001", "medium", "medium", COL("path"), COL("line"), _in("enum"), _text("absorbs ", F.array_join("_left", ", ")))


def stubbed_traits(traits: DataFrame, impls: DataFrame) -> DataFrame:
    """EXT-004: traits (repo, path, line, trait, methods) of MIN_METHODS or more where an implementer (repo, trait, stubs) stubs
    MIN_STUBS or more. Traits of equal name aren't judged."""
    most = impls.filter(COL("stubs") >= MIN_STUBS).groupBy("repo", "trait").agg(F.max("stubs").alias("_most"), F.count(F.lit(1)).alias("_n"))
    one = traits.groupBy("repo", "trait").agg(F.count(F.lit(1)).alias("_c"), F.first("path").alias("path"), F.first("line").alias("line"), F.first("methods").alias("methods")).filter(f"_c = 1 AND methods >= {MIN_METHODS}")
    bad = one.join(most, ["repo", "trait"])
    return finding(bad, "EXT-004", "low", "low", COL("path"), COL("line"), F.concat_ws(":", "path", "trait"), _text(COL("_most"), " of ", COL("methods"), " methods are stubs; implementers: ", COL("_n")))


def single_implementations(traits: DataFrame, impls: DataFrame, mentions: DataFrame) -> DataFrame:
    """EXT-007: private traits (repo, package, path, line, trait) with one implementation (repo, package, trait, is_test) outside
    tests, none in tests, and no mention (repo, package, trait) in a macro."""
    key = ["repo", "package", "trait"]
    one = impls.groupBy(*key).agg(F.count_if(~COL("is_test")).alias("_real"), F.count_if("is_test").alias("_test")).filter("_real = 1 AND _test = 0")
    bad = traits.join(one, key, "left_semi").join(mentions, key, "left_anti")
    return finding(bad, "EXT-007", "low", "low", COL("path"), COL("line"), COL("trait"), "one implementation and no test double")


def print_macros(macros: DataFrame, libraries: DataFrame) -> DataFrame:
    """OPS-003: print macros (repo, package, path, line, fn, name) in a library package (repo, package)."""
    bad = macros.filter(COL("name").isin(*PRINT_MACROS)).join(libraries, ["repo", "package"], "left_semi")
    return finding(bad, "OPS-003", "low", "high", COL("path"), COL("line"), _in("name"), _text(COL("name"), "! in a library"))


def unsafe_inventory(sites: DataFrame) -> DataFrame:
    """(repo, package, blocks, fns, impls, unjustified): sites (repo, package, kind, justified) of unsafe code per package."""
    kind = lambda k: F.count_if(COL("kind") == k)
    return sites.groupBy("repo", "package").agg(kind("block").alias("blocks"), kind("fn").alias("fns"), kind("impl").alias("impls"), F.count_if(COL("kind").isin("block", "impl") & ~F.coalesce("justified", F.lit(False))).alias("unjustified"))


def unjustified_unsafe(sites: DataFrame) -> DataFrame:
    """COR-006: packages with an unsafe block or impl that no SAFETY comment explains."""
    bad = unsafe_inventory(sites).filter("unjustified > 0")
    return finding(bad, "COR-006", "high", "medium", None, None, COL("package"), _text("unsafe without a reason: ", COL("unjustified")))


# Tests: tests (repo, path, line, test, n_stmts, n_calls, n_asserts, n_tautologies, expectations, times).


def empty_tests(tests: DataFrame) -> DataFrame:
    """TST-003: tests without statements, whose assertions are all tautologies, or that call nothing."""
    why = F.when(COL("n_stmts") == 0, "it is empty").when((COL("n_asserts") > 0) & (COL("n_tautologies") == COL("n_asserts")), "its assertions always hold").when(COL("n_calls") == 0, "it calls nothing")
    bad = tests.withColumn("_why", why).filter("_why IS NOT NULL")
    return finding(bad, "TST-003", "medium", F.when(COL("_why") == "it calls nothing", "medium").otherwise("high"), COL("path"), COL("line"), COL("test"), COL("_why"))


def over_mocked(tests: DataFrame) -> DataFrame:
    """TST-004: at least MIN_EXPECTATIONS expectations and four times the assertions, or MIN_TIMES call counts and no assertion."""
    many = (COL("expectations") >= MIN_EXPECTATIONS) & (COL("expectations") >= 4 * F.greatest(COL("n_asserts"), F.lit(1)))
    bad = tests.filter(many | ((COL("times") >= MIN_TIMES) & (COL("n_asserts") == 0)))
    return finding(bad, "TST-004", "low", "low", COL("path"), COL("line"), COL("test"), _text(COL("expectations"), " expectations, ", COL("n_asserts"), " assertions"))


# Repositories at one revision or two.


def undeclared_components(components: DataFrame) -> DataFrame:
    """DOC-003: components (repo, path, component, purpose, owner) that lack a purpose or an owner, in repositories where any has
    one."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    some = components.filter(has("purpose") | has("owner")).select("repo").distinct()
    bad = components.filter(~(has("purpose") & has("owner"))).join(some, "repo", "left_semi")
    lacks = F.concat_ws("+", F.when(~has("purpose"), "purpose"), F.when(~has("owner"), "owner"))
    read = _text("the declaration of ", COL("component"), " was read for both keys")
    return finding(bad, "DOC-003", "low", "high", COL("path"), None, F.concat_ws(": ", "path", "component", lacks), _text("no ", F.replace(lacks, F.lit("+"), F.lit(" and no "))), read=read)


def drift(base: DataFrame, head: DataFrame, percent: int = GROWN_PERCENT, items: int = GROWN_ITEMS) -> DataFrame:
    """ARC-009: members (repo, member, cycles, surface) of two revisions: cycles that grew, and a surface that grew by `items` or
    more and by over `percent`. Members that only one revision has aren't compared."""
    b = base.select("repo", "member", COL("cycles").alias("_c"), COL("surface").alias("_s"))
    j = head.join(b, ["repo", "member"])
    grew = COL("surface") - COL("_s")
    kind = lambda hit, severity, what, old, new: F.when(hit, F.struct(F.lit(severity).alias("severity"), F.lit(what).alias("what"), _text(what, ": ", COL(old), " to ", COL(new)).alias("summary")))
    kinds = F.array(kind(COL("cycles") > COL("_c"), "low", "cycles", "_c", "cycles"), kind((grew >= items) & (grew * 100 > COL("_s") * percent), "info", "surface", "_s", "surface"))
    read = _text("both revisions were read; the surface was ", COL("_s"), " and is ", COL("surface"))
    return finding(j.withColumn("_k", F.explode(F.array_compact(kinds))), "ARC-009", COL("_k.severity"), "low", None, None, F.concat_ws(":", "member", "_k.what"), COL("_k.summary"), read=read)


def bare_suppressions(attrs: DataFrame) -> DataFrame:
    """GOV-010: attrs (repo, path, line, lint, reason) without a reason."""
    bad = attrs.filter(F.coalesce(F.trim("reason"), F.lit("")) == "")
    return finding(bad, "GOV-010", "low", "high", COL("path"), COL("line"), COL("lint"), _text("suppressed without a reason: ", COL("lint")))


def suppression_ratchet(base: DataFrame, head: DataFrame) -> DataFrame:
    """GOV-010: repositories with more suppressions without a reason at head than at base (both as for bare_suppressions), at
    the first file whose own count rose."""
    bare = F.coalesce(F.trim("reason"), F.lit("")) == ""
    rows = lambda df, k: df.filter(bare).select("repo", "path", F.lit(k).alias("k"))
    per = rows(base, -1).unionByName(rows(head, 1)).groupBy("repo", "path").agg(F.count_if(COL("k") < 0).alias("b"), F.count_if(COL("k") > 0).alias("h"))
    total = per.groupBy("repo").agg(F.sum("b").alias("b"), F.sum("h").alias("h"), F.min(F.when(COL("h") > COL("b"), COL("path"))).alias("first")).filter("h > b")
    return finding(total, "GOV-010", "medium", "high", COL("first"), None, "suppression-count", _text("suppressions without a reason: ", COL("b"), " to ", COL("h")), read=_text("attributes at both revisions were read; the totals are ", COL("b"), " and ", COL("h")))


def waiver_ratchet(base: DataFrame, head: DataFrame) -> DataFrame:
    """architecture-ratchet: repositories with more waivers (repo, path, line) at head than at base, at the first surplus one."""
    per = lambda df, n: df.groupBy("repo").agg(F.count(F.lit(1)).alias(n))
    grown = per(head, "_h").join(per(base, "_n"), "repo", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(COL("_h") > COL("_n"))
    at = F.row_number().over(Window.partitionBy("repo").orderBy("path", "line"))
    bad = head.join(grown, "repo").withColumn("_at", at).filter(COL("_at") == COL("_n") + 1)
    read = _text("the declarations at both revisions were read: ", COL("_h"), " waivers now and ", COL("_n"), " before")
    return finding(bad, "architecture-ratchet", "medium", "high", COL("path"), COL("line"), "architecture-waiver-count", _text("more waivers than the base's ", COL("_n")), read=read)


def unused_dependencies(deps: DataFrame, tokens: DataFrame) -> DataFrame:
    """SUP-006: dependencies (repo, package, path, line, name) that no token (repo, package, token) of their package names, where
    dashes count as underscores and case doesn't."""
    said = tokens.select("repo", "package", F.lower("token").alias("_ident")).distinct()
    bad = deps.withColumn("_ident", F.lower(F.replace("name", F.lit("-"), F.lit("_")))).join(said, ["repo", "package", "_ident"], "left_anti")
    return finding(bad, "SUP-006", "low", "low", COL("path"), COL("line"), F.concat_ws(":", "package", "name"), _text("declared and never named: ", COL("name")))


# Architecture: edges (repo, a, b).


def layer_violations(edges: DataFrame, members: DataFrame, allow: DataFrame, waivers: DataFrame, today: Column | None = None) -> DataFrame:
    """ARC-001: edges from a member (repo, member, component, layer from the bottom) to one of another component that isn't in
    the same layer or a lower one, unless allowed (repo, a, b) or waived (repo, a, b, until), both by names of members or components.
    A component in no layer may use and be used by allowed edges alone. Members without a component give an info finding, and
    their edges aren't judged."""
    today = F.current_date() if today is None else today
    m = members.dropDuplicates(["repo", "member"])
    x, y = m.select("repo", COL("member").alias("a"), COL("component").alias("_ca"), COL("layer").alias("_la")), m.select("repo", COL("member").alias("b"), COL("component").alias("_cb"), COL("layer").alias("_lb"))
    up = edges.select("repo", "a", "b").distinct().join(x, ["repo", "a"]).join(y, ["repo", "b"]).filter((COL("_ca") != COL("_cb")) & F.coalesce(COL("_la") < COL("_lb"), F.lit(True)))
    granted = allow.select("repo", COL("a").alias("_x"), COL("b").alias("_y")).unionByName(waivers.filter(COL("until") >= today).select("repo", COL("a").alias("_x"), COL("b").alias("_y"))).distinct()
    # an edge stands under at most four pairs of names
    named = up.select("repo", "a", "b", F.explode(F.array_compact(F.array("a", "_ca"))).alias("_x"), "_cb").select("repo", "a", "b", "_x", F.explode(F.array_compact(F.array("b", "_cb"))).alias("_y"))
    bad = up.join(named.join(granted, ["repo", "_x", "_y"], "left_semi").select("repo", "a", "b").distinct(), ["repo", "a", "b"], "left_anti")
    why = F.when(COL("_la").isNull(), _text(COL("_ca"), " is outside the layers")).when(COL("_lb").isNull(), _text(COL("_cb"), " is outside the layers")).otherwise(_text("layer ", COL("_la"), " depends on layer ", COL("_lb")))
    found = finding(bad, "ARC-001", "low", "high", None, None, _text(COL("a"), "->", COL("b")), why)
    return found.unionByName(finding(m.filter("component IS NULL"), "ARC-001", "info", "high", None, None, _text("unplaced:", COL("member")), "placed outside the declaration"))


def _named(edges: DataFrame) -> DataFrame:
    name = lambda c: F.concat_ws("\x01", "repo", c)
    return edges.filter("repo IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select(name("a").alias("a"), name("b").alias("b"))


def _cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components of two members or more: repo, component, n, names; all edges by name; (v, component))."""
    part = lambda c, k: F.get(F.split(c, "\x01"), F.lit(k))
    named = _named(edges).filter("a <> b").distinct()
    scc = cut(strong_components(named))
    # the names of one component are the finding's own text
    per = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(part("v", 1))).alias("names")).filter("n > 1").withColumn("repo", part("component", 0))
    return per, named, scc


def component_cycles(edges: DataFrame, modular: bool = False) -> DataFrame:
    """ARC-002: strong components of two members or more, one finding each, with the edges whose removal dissolves it: each alone
    where one is enough, else all of a depth-first set. `modular`: the edges come from module references, a lower bound."""
    part = lambda c, k: F.get(F.split(c, "\x01"), F.lit(k))
    per, named, scc = _cycles(edges)
    gone = dissolving_edges(named, scc)
    arrow = F.concat(part("a", 1), F.lit(" -> "), part("b", 1))
    gone = gone.groupBy(COL("component").alias("_c")).agg(F.array_join(F.sort_array(F.collect_list(arrow)), ", ").alias("_gone"), F.bool_and("single").alias("_single"))
    told = per.join(gone, COL("component") == COL("_c"), "left")
    detail = _text(F.when(COL("_single"), "removing any one of these edges dissolves it: ").otherwise("removing all of these edges dissolves it, but no single one: "), COL("_gone"))
    return finding(told, "ARC-002", "medium", "medium" if modular else "high", None, None, F.array_join("names", ","), _text("a cycle of ", COL("n"), " components"), detail=detail)


def module_cycles(edges: DataFrame) -> DataFrame:
    """MOD-002: strong components of two modules or more: low where several top-level modules take part, else info."""
    per, _, _ = _cycles(edges)
    tops = F.size(F.array_distinct(F.transform("names", lambda v: F.get(F.split(v, "::"), F.lit(0)))))
    return finding(per, "MOD-002", F.when(tops > 1, "low").otherwise("info"), "medium", None, None, F.array_join("names", ","), _text("a cycle of ", COL("n"), " modules"))


def entangled_modules(edges: DataFrame, files: DataFrame, touched: DataFrame, max_files: int = 25, least: int = 3, share: int = 60) -> DataFrame:
    """ARC-011: (repo, a, b, both, either, sample): pairs a < b of top-level modules that name each other and that commits (repo, o,
    at, f) change together: at least `least` commits and `share` percent of those that touch either. Files (repo, m, f) are those of
    modules; commits of more than max_files files don't count. The sample holds the newest three commits."""
    top = lambda c: F.get(F.split(c, "::"), F.lit(0))
    e = edges.select("repo", top("a").alias("a"), top("b").alias("b")).filter("a <> b").distinct()
    pairs = e.filter("a < b").join(e.select("repo", COL("b").alias("a"), COL("a").alias("b")), ["repo", "a", "b"], "left_semi")
    named = pairs.select("repo", F.explode(F.array("a", "b")).alias("m")).distinct()
    owned = files.select("repo", top("m").alias("m"), "f").distinct().join(named, ["repo", "m"], "left_semi")
    given = touched.select("repo", "o", "at", "f").filter("repo IS NOT NULL AND o IS NOT NULL")
    each = _changed(given, owned, max_files)
    # of the newest commits of PARTS parts, the third newest is no newer than the third newest of all
    part = F.when(COL("b").isNotNull(), F.pmod(F.xxhash64("o", "at"), F.lit(PARTS)))
    counts = each.groupBy("repo", "a", "b", part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    counts = cut(counts.groupBy("repo", "a", "b").agg(F.sum("n").alias("n"), F.get(F.sort_array(F.collect_list("at"), False), F.lit(2)).alias("third")))
    of = lambda c: counts.filter("b IS NULL").select("repo", COL("a").alias(c), COL("n").alias("_" + c))
    met = pairs.join(counts.filter("b IS NOT NULL"), ["repo", "a", "b"]).join(of("a"), ["repo", "a"]).join(of("b"), ["repo", "b"])
    n = met.select("repo", "a", "b", COL("n").alias("both"), (COL("_a") + COL("_b") - COL("n")).alias("either"), "third").filter((COL("both") >= least) & (COL("both") * 100 >= COL("either") * share))
    n = cut(n)
    if n.filter("third IS NULL").isEmpty():  # only commits from there on can be in a sample; they are read again whole
        late = given.join(F.broadcast(n.agg(F.min("third").alias("_least"))), COL("at") >= COL("_least")).select("repo", "o").distinct()
        given = given.join(late, ["repo", "o"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("repo", "a", "b").orderBy(F.desc("at"), "o"))
    newest = _changed(given, owned, max_files).join(n.select("repo", "a", "b", "third"), ["repo", "a", "b"]).filter("third IS NULL OR at >= third")
    newest = newest.withColumn("k", rank).filter("k <= 3").groupBy("repo", "a", "b").agg(F.sort_array(F.collect_list(F.struct("k", "o"))).alias("s"))
    return n.join(newest, ["repo", "a", "b"]).select("repo", "a", "b", "both", "either", F.transform("s", lambda x: x["o"]).alias("sample"))


def _changed(touched: DataFrame, owned: DataFrame, max_files: int) -> DataFrame:
    """(repo, a, b, o, at): modules a, b being null, and pairs a < b of them, that commits of max_files files or fewer change. A commit's
    files are counted where they meet, and its modules paired within it; owned (repo, m, f) are the modules' files."""
    t = touched.repartition("repo", "o").distinct()
    small = t.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("repo", "o"))).filter(COL("_k") <= max_files).drop("_k")
    sets = small.join(owned, ["repo", "f"]).groupBy("repo", "o", "at").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    placed = sets.select("*", F.posexplode("ms").alias("_i", "a"))
    others = F.concat(F.array(F.lit(None).cast("string")), F.slice("ms", COL("_i") + 2, F.size("ms")))
    return placed.select("repo", "a", F.explode(others).alias("b"), "o", "at")


# Reports of tools.


def advisories(packages: DataFrame, known: DataFrame) -> DataFrame:
    """SUP-002: packages (repo, path, ecosystem, name, version) within the range [introduced, fixed) of an advisory group (ecosystem,
    name, group, introduced, fixed, score); a null bound is open. One finding per lockfile, package, version and group, by its
    highest score; without a score it is high."""
    found = packages.select("repo", "path", "ecosystem", "name", "version").distinct()
    # every version meets every range of its package once, then the groups of that range, and only then the lockfiles
    span = ["ecosystem", "name", "introduced", "fixed"]
    groups = known.groupBy(*span, "group").agg(F.max("score").alias("score"))
    key = lambda c: F.when(COL(c).isNotNull(), semver_key(COL(c)))
    at = found.select("ecosystem", "name", "version").distinct().withColumn("_at", semver_key(COL("version")))
    spans = known.select(*span).distinct().withColumn("_lo", key("introduced")).withColumn("_hi", key("fixed"))
    met = at.join(spans, ["ecosystem", "name"]).filter((COL("_lo").isNull() | (COL("_at") >= COL("_lo"))) & (COL("_hi").isNull() | (COL("_at") < COL("_hi"))))
    met = met.select(*(COL(c).alias("_" + c) for c in span), "version")
    same = (COL("_ecosystem") == COL("ecosystem")) & (COL("_name") == COL("name"))
    hit = met.join(groups, same & COL("_introduced").eqNullSafe(COL("introduced")) & COL("_fixed").eqNullSafe(COL("fixed")))
    hit = hit.groupBy("_ecosystem", "_name", COL("version").alias("_version"), "group").agg(F.max("score").alias("score"))
    per = found.join(hit, same & COL("version").eqNullSafe(COL("_version")))
    tier = F.when(COL("score") >= 9, "critical").when(COL("score") >= 7, "high").when(COL("score") >= 4, "medium").when(COL("score").isNotNull(), "low").otherwise("high")
    return finding(per, "SUP-002", tier, "high", COL("path"), None, _text(COL("name"), "@", COL("version")), COL("group"))


def grave_advisories(packages: DataFrame, known: DataFrame) -> DataFrame:
    """SEC-006: the findings of advisories() with a score of 7 or more, or without one."""
    return advisories(packages, known).filter(COL("severity").isin("high", "critical")).withColumn("check_id", F.lit("SEC-006"))


def unused_returns(diags: DataFrame, tags: DataFrame, imports: DataFrame) -> DataFrame:
    """ERR-012: (id, fn, ignored, total) of functions whose result some caller drops. diags (kind ignored or used, id, file, line,
    col) count once per site; those within the function itself (tags: id, fn, file, line, col, last_line, last_col) are
    recursion, and used ones on a line of an import (file, first, last) are no calls. A total is never below the ignored ones."""
    d = diags.select("kind", "id", "file", "line", "col").distinct().join(tags.select("id", "fn", COL("file").alias("_f"), F.struct("line", "col").alias("_from"), F.struct(COL("last_line").alias("line"), COL("last_col").alias("col")).alias("_to")), "id")
    at = F.struct("line", "col")
    inside = F.coalesce((COL("file") == COL("_f")) & (COL("_from") <= at) & (at <= COL("_to")), F.lit(False))
    lines = imports.select("file", F.explode(F.sequence("first", "last")).alias("line")).distinct().withColumn("_import", F.lit(True))
    calls = d.filter(~inside).join(lines, ["file", "line"], "left").filter("kind = 'ignored' OR _import IS NULL")
    per = calls.groupBy("id", "fn").agg(F.count_if(COL("kind") == "ignored").alias("ignored"), F.count_if(COL("kind") == "used").alias("used"))
    return per.filter("ignored > 0").select("id", "fn", "ignored", F.greatest("used", "ignored").alias("total"))


# Surface, size and locks.

#: Code lines, fan-out, fan-in and members from which a file or type stands out; words of a closed enum.
FILE_LINES, FILE_LINES_HIGH, FAN_OUT, FAN_OUT_COUPLED, FAN_IN_COUPLED, TYPE_MEMBERS = 1035, 2234, 14, 7, 6, 30
CLOSED = r"(?i)exhaustive|closed|sealed|fixed set"
UNTYPED = r"^(.*::)?Result<.*,(String|&('\w+)?str|Box<dyn.*>|anyhow::Error|eyre::Report)>$|^(anyhow|eyre)::Result<[^,]*>$"
#: A comment that excuses slow code, and what links it to a benchmark.
EXCEPTION = r"^[\s*/!]*PERF-EXCEPTION:"
BENCHMARK = r"https?://|bench::|(^|[\s,;()`\"'/])(bench|benches|benchmark|benchmarks)/"


def size_outliers(files: DataFrame, types: DataFrame) -> DataFrame:
    """MOD-005: files (repo, path, code_lines, fan_out, fan_in) that are large and coupled (low), large, or widely coupled (info), and
    types (repo, path, line, type, fields, methods) of many members of which one at least is a method."""
    coupled = (COL("fan_out") >= FAN_OUT_COUPLED) | (COL("fan_in") >= FAN_IN_COUPLED)
    kind = F.when((COL("code_lines") >= FILE_LINES_HIGH) & coupled, "size and coupling").when(COL("code_lines") >= FILE_LINES, "size").when(COL("fan_out") >= FAN_OUT, "coupling")
    big = files.withColumn("_kind", kind).filter("_kind IS NOT NULL")
    one = finding(big, "MOD-005", F.when(COL("_kind") == "size and coupling", "low").otherwise("info"), "medium", COL("path"), None, COL("path"), COL("_kind"))
    wide = types.filter((COL("fields") + COL("methods") >= TYPE_MEMBERS) & (COL("methods") > 0))
    return one.unionByName(finding(wide, "MOD-005", "info", "medium", COL("path"), COL("line"), COL("type"), _text(COL("fields") + COL("methods"), " members")))


def unstable_edges(edges: DataFrame, volatile: DataFrame, margin: float = 0.3) -> DataFrame:
    """ARC-005: edges towards a component that is less stable by `margin` or more, unless that is declared volatile (repo, component), a
    binding (-sys), or in one cycle with the edge's start."""
    named = _named(edges.filter("a <> b")).distinct()
    x, y = instability(named).toDF("xk", "xv"), instability(named).toDF("yk", "yv")
    scc = strong_components(named)
    p, q = scc.toDF("pv", "pc"), scc.toDF("qv", "qc")
    loose = volatile.select(F.concat_ws("\x01", "repo", "component").alias("_v"))
    gap = named.join(x, COL("a") == COL("xk")).join(y, COL("b") == COL("yk")).filter(COL("yv") - COL("xv") + 1e-9 >= margin)
    gap = gap.filter(~COL("b").rlike("[-_]sys$")).join(loose, COL("b") == COL("_v"), "left_anti")
    bad = gap.join(p, COL("a") == COL("pv"), "left").join(q, COL("b") == COL("qv"), "left").filter("pc IS NULL OR qc IS NULL OR pc <> qc")
    part = lambda c, k: F.get(F.split(c, "\x01"), F.lit(k))
    bad = bad.withColumn("repo", part("a", 0))
    return finding(bad, "ARC-005", "info", "low", None, None, _text(part("a", 1), "->", part("b", 1)), "depends on a less stable component")


def lock_cycles(guards: DataFrame) -> DataFrame:
    """CON-006: guards (repo, package, path, fn, lock, start, stop): a lock taken while another is held is an edge between them;
    cycles of two locks or more, and locks taken again while held unless an index tells them apart (their name ends in []). Per
    function only the guards whose spans meet are paired."""
    g = guards.select("repo", "package", "path", "fn", "lock", "start", "stop").distinct()
    later = g.select("repo", "package", "path", "fn", COL("lock").alias("taken"), COL("start").alias("at"))
    met = g.join(later, ["repo", "package", "path", "fn"]).filter((COL("at") > COL("start")) & (COL("at") < COL("stop"))).select(F.concat_ws("\x01", "repo", "package").alias("repo"), COL("lock").alias("a"), COL("taken").alias("b")).distinct()
    part = lambda c, k: F.get(F.split(c, "\x01"), F.lit(k))
    again = met.filter((COL("a") == COL("b")) & ~COL("a").endswith("[]")).select(part("repo", 0).alias("repo"), COL("a").alias("_s"), F.lit("taken again while held").alias("_w"))
    per = strong_components(_named(met.filter("a <> b"))).groupBy("component").agg(F.sort_array(F.collect_list(part("v", 2))).alias("locks"))
    cycles = per.select(part("component", 0).alias("repo"), F.array_join("locks", " <-> ").alias("_s"), _text("a cycle of ", F.size("locks"), " locks").alias("_w"))
    return finding(cycles.unionByName(again), "CON-006", "high", "low", None, None, COL("_s"), COL("_w"))


def bare_deprecations(attrs: DataFrame) -> DataFrame:
    """API-004: deprecations (repo, path, line, item, is_pub, since, note) of public items that lack one of the two."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    bad = attrs.filter(COL("is_pub") & ~(has("since") & has("note")))
    return finding(bad, "API-004", "low", "medium", COL("path"), COL("line"), F.concat_ws(":", "path", "item", "line"), F.when(has("since"), "no note").when(has("note"), "no since").otherwise("neither since nor note"))


def open_enums(enums: DataFrame) -> DataFrame:
    """API-009: public enums (repo, path, line, enum, is_pub, non_exhaustive, variants, doc) with variants that may not grow and that
    no word of their documentation closes."""
    bad = enums.filter(COL("is_pub") & ~COL("non_exhaustive") & (COL("variants") > 0) & ~F.coalesce(COL("doc").rlike(CLOSED), F.lit(False)))
    return finding(bad, "API-009", "low", "medium", COL("path"), COL("line"), F.concat_ws(":", "path", "enum", "line"), "can't grow without breaking callers")


def untyped_errors(fns: DataFrame) -> DataFrame:
    """ERR-004: public functions (repo, path, line, fn, is_pub, ret) that fail with a text or a boxed or dynamic error."""
    bad = fns.filter(COL("is_pub") & F.regexp_replace("ret", r"\s+", "").rlike(UNTYPED))
    return finding(bad, "ERR-004", "medium", "medium", COL("path"), COL("line"), F.concat_ws(":", "path", "fn", "line"), _text("fails with an untyped error: ", COL("ret")))


def perf_exceptions(comments: DataFrame) -> DataFrame:
    """PRF-006: comments (repo, path, line, text) that excuse slow code and link no benchmark, neither themselves nor in comments of
    the next two lines up to the next such excuse: one finding per file, at the first."""
    w = Window.partitionBy("repo", "path").orderBy("line")
    near = lambda k: F.when(F.lead("line", k).over(w) <= COL("line") + 2, F.lead("text", k).over(w))
    c = comments.withColumn("_1", near(1)).withColumn("_2", near(2))
    free = lambda t: F.coalesce(~COL(t).rlike(EXCEPTION), F.lit(False))
    says = lambda t: F.coalesce(COL(t).rlike(BENCHMARK), F.lit(False))
    bad = c.filter(COL("text").rlike(EXCEPTION) & ~(says("text") | (free("_1") & (says("_1") | (free("_2") & says("_2"))))))
    per = bad.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    return finding(per, "PRF-006", "info", "low", COL("path"), COL("line"), COL("path"), _text("excuses for slow code without a benchmark: ", COL("n")))
