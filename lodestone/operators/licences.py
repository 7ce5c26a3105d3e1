"""Licences of repositories: expressions, licence files and headers.

Cases: an empty table gives an empty result; a null or empty expression has no alternatives; unbalanced parentheses close where the
expression ends; a repository without sources or manifest is judged by what it has; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rules import finding
from lodestone.operators.settings_rules import MANIFESTS_SKIPPED
from lodestone.sources.settings import toml_facts

COL = F.col
#: Extensions of sources, lines in which a header may stand, and beginnings of names of licence files and origin records.
SOURCES = ["rs", "py", "js", "mjs", "cjs", "jsx", "ts", "tsx", "go", "java", "kt", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "swift", "sh", "ps1"]
HEADER_LINES = 15
LICENCE_FILES = ["LICENSE", "LICENCE", "COPYING", "UNLICENSE"]
ORIGINS = ["NOTICE", "THIRD-PARTY", "THIRD_PARTY", "THIRDPARTY"]

_ALTS = "array<array<string>>"


def disjunctive(expression: Column) -> Column:
    """The alternatives of a licence expression, each the identifiers that it takes together: a fold over its tokens with a frame per open
    parenthesis. AND binds closer than OR; `WITH exception` and a `+` belong to the identifier before them, which stands without."""
    tokens = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce(expression, F.lit("")), r"(?i)\s+WITH\s+[^\s()]+", ""), F.lit(r"[()]|[^\s()/]+"), F.lit(0)), lambda t: t != "")
    frame = lambda ors, ands, joins: F.struct(ors.cast(_ALTS).alias("ors"), ands.cast(_ALTS).alias("ands"), F.lit(joins).alias("joins") if isinstance(joins, bool) else joins.alias("joins"))
    none = F.array()
    product = lambda x, y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.array_distinct(F.concat(a, b)))))

    def joined(f: Column, alts: Column) -> Column:
        """A frame with an operand more: joined to the one before by AND, or one of its own."""
        return F.when(f["joins"], frame(f["ors"], product(f["ands"], alts), False)).otherwise(frame(F.concat(f["ors"], f["ands"]), alts, False))

    def closed(stack: Column) -> Column:
        """The innermost frame's alternatives, an operand of the one around it."""
        n = F.size(stack)
        top, below = F.element_at(stack, -1), F.get(stack, n - 2)
        return F.when(n > 1, F.concat(F.slice(stack, F.lit(1), n - 2), F.array(joined(below, F.concat(top["ors"], top["ands"]))))).otherwise(stack)

    def step(stack: Column, t: Column) -> Column:
        top, rest = F.element_at(stack, -1), F.slice(stack, F.lit(1), F.size(stack) - 1)
        ident = F.array(F.array(F.regexp_replace(t, r"\++$", "")))
        put = lambda f: F.concat(rest, F.array(f))
        return (
            F.when(t == "(", F.concat(stack, F.array(frame(none, none, False)))).when(t == ")", closed(stack)).when(F.upper(t) == "AND", put(frame(top["ors"], top["ands"], F.size(top["ands"]) > 0)))
            .when(F.upper(t) == "OR", put(frame(F.concat(top["ors"], top["ands"]), none, False))).otherwise(put(joined(top, ident.cast(_ALTS))))
        )

    stack = F.aggregate(tokens, F.array(frame(none, none, False)), step)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(8)), stack, lambda s, _: closed(s))  # parentheses left open
    return F.array_distinct(F.concat(F.element_at(last, 1)["ors"], F.element_at(last, 1)["ands"]))


def identifiers(expression: Column) -> Column:
    """The different identifiers of an expression."""
    return F.array_distinct(F.flatten(disjunctive(expression)))


def permitted(expression: Column, policy: Column) -> Column:
    """Whether one alternative of an expression is wholly within a policy's identifiers (an array, in lower case)."""
    return F.exists(disjunctive(expression), lambda a: F.forall(a, lambda x: F.array_contains(policy, F.lower(x))))


def forbidden_licences(packages: DataFrame, policy: DataFrame) -> DataFrame:
    """Packages (repo, path, name, version, licence) that no alternative of their expression lets in under their repository's policy (repo, id)."""
    per = policy.groupBy("repo").agg(F.collect_set(F.lower("id")).alias("_ids"))
    return packages.join(per, "repo").filter(~F.coalesce(permitted(COL("licence"), COL("_ids")), F.lit(False))).drop("_ids")


def licence_state(files: DataFrame) -> DataFrame:
    """SUP-016: no licence file at the root (high); an identifier of the root manifest that no licence file is named for; sources without an
    SPDX header in their first lines, and with one that is neither the project's nor has an origin record (medium)."""
    name = F.upper(F.element_at(F.split("path", "/"), -1))
    root = ~COL("path").contains("/")
    starts = lambda words: name.rlike("^(" + "|".join(words) + ")")
    is_licence = (root & starts(LICENCE_FILES)) | COL("path").rlike("^LICENSES/.")
    kinds = files.groupBy("repo").agg(
        F.collect_set(F.when(is_licence, name)).alias("named"), F.coalesce(F.max(root & starts(ORIGINS)), F.lit(False)).alias("origin"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(root & name.rlike(r"^(LICENSE|LICENCE|COPYING)(\.[A-Z]+)?$")), F.lit(False)).alias("generic"),
    )
    toml = toml_facts(files.filter(COL("path").isin("Cargo.toml", "pyproject.toml"))).withColumn("at", F.array_join("keys", "."))
    told = toml.filter(COL("at").isin("package.license", "workspace.package.license", "project.license", "project.license.text"))
    json = files.filter("path = 'package.json'").select("repo", F.lit("json").alias("at"), F.get_json_object("text", "$.license").alias("value")).filter("value IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, ["package.license", "workspace.package.license", "json", "project.license", "project.license.text"])), COL("at"))
    declared = told.select("repo", "at", "value").unionByName(json).groupBy("repo").agg(F.min(F.struct(rank.alias("k"), "at", "value")).alias("d")).select("repo", "d.at", COL("d.value").alias("expr"), identifiers(COL("d.value")).alias("ids"))
    repos = kinds.join(declared, "repo", "left")
    read = F.concat(COL("n").cast("string"), F.lit(" tracked files were searched"))
    bare = finding(repos.filter(F.size("named") == 0), "SUP-016", "high", "high", None, None, "licence file", "no licence file at the root", read)
    sound = repos.filter(F.size("named") > 0)
    # a family is the letters before the first digit or hyphen
    each = sound.filter("NOT generic").withColumn("id", F.explode("ids"))
    family = F.regexp_extract(F.upper("id"), r"^[A-Z]+", 0)
    unnamed = each.filter(~F.exists("named", lambda f: f.contains(F.upper("id")) | F.regexp_like(f, F.concat(F.lit("[-_.]"), family, F.lit(r"([-_.]|$)")))))
    manifest = F.when(COL("at") == "json", "package.json").when(COL("at").startswith("project"), "pyproject.toml").otherwise("Cargo.toml")
    lacks = finding(unnamed, "SUP-016", "medium", "medium", manifest, None, COL("id"), F.concat(F.lit("declared, but no licence file is named for "), COL("id")), read)
    source = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SOURCES) & ~COL("path").rlike("(^|/)(" + "|".join([*MANIFESTS_SKIPPED, "target"]) + ")/")
    head = F.array_join(F.slice(F.split("text", "\n"), F.lit(1), F.lit(HEADER_LINES)), "\n")
    said = files.filter(source & COL("text").isNotNull()).select("repo", "path", F.regexp_extract(head, r"SPDX-License-Identifier:\s*([^\n*]+)", 1).alias("spdx"))
    per = said.join(sound.select("repo", "ids", "origin", "named"), "repo")
    alien = (COL("spdx") != "") & (F.size("ids") > 0) & ~COL("origin") & F.exists(identifiers(COL("spdx")), lambda x: ~F.array_contains(F.transform("ids", F.lower), F.lower(x)) & ~F.exists("named", lambda f: f.contains(F.upper(x))))
    counts = per.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(COL("spdx") == "").alias("bare"), F.min(F.when(COL("spdx") == "", COL("path"))).alias("first"), F.count_if(alien).alias("alien"), F.min(F.when(alien, COL("path"))).alias("other"))
    sources = F.concat(COL("n").cast("string"), F.lit(" sources were read"))
    without = finding(counts.filter("bare > 0"), "SUP-016", "medium", "high", COL("first"), F.lit(1), "SPDX-License-Identifier", F.concat(COL("bare").cast("string"), F.lit(" of "), COL("n").cast("string"), F.lit(" sources carry no SPDX header")), sources)
    foreign = finding(counts.filter("alien > 0"), "SUP-016", "medium", "medium", COL("other"), F.lit(1), "licence mismatch", F.concat(COL("alien").cast("string"), F.lit(" sources are under another licence with no origin record")), sources)
    return bare.unionByName(lacks).unionByName(without).unionByName(foreign)
