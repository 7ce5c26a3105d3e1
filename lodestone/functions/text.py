"""Text kernels as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a summary an absence claim.
ABSENCE_WORDS = ["zero", "no", "none", "missing", "unreachable", "0"]
#: Severities and confidences, lowest first.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def confidence_rank(confidence: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CONFIDENCES)), confidence) - 1).cast("int")


def claims_absence(summary: Column, words: list[str] = ABSENCE_WORDS) -> Column:
    """A whole word of the lower-cased text, trimmed of other than letters and digits, is one of `words`."""
    bare = F.transform(F.split(F.lower(summary), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{Alnum}]+|[^\p{Alnum}]+$", ""))
    return F.arrays_overlap(bare, F.array(*map(F.lit, words)))


def redact_keyed(text: Column) -> Column:
    """Replace quoted values of `token =` by <redacted>."""
    return F.regexp_replace(text, r'(token\s*=\s*")[^"]*(")', "$1<redacted>$2")


def secret_count(text: Column) -> Column:
    """Number of keyed values of 32 or more token characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r'(?i)(token|secret|password|api_?key)\s*[:=]\s*"?[A-Za-z0-9+/_.=-]{32,}'), F.lit(0)))


def licence_of(text: Column) -> Column:
    return F.when(text.contains("MIT License"), "MIT").when(text.contains("Apache License"), "Apache-2.0").when(text.contains("GNU General Public"), "GPL-3.0").otherwise("other")


def semver_key(version: Column) -> Column:
    """A struct that sorts like semantic versions: unparsable lowest, a release above its own pre-releases, numeric
    identifiers below words, build metadata ignored."""
    bare = F.regexp_replace(F.trim(version), r"^v|\+.*$", "")
    core, pre = F.regexp_extract(bare, r"^(\d+(?:\.\d+){0,2})", 1), F.regexp_extract(bare, r"^\d+(?:\.\d+){0,2}-(.+)$", 1)
    part = lambda k: F.coalesce(F.get(F.split(core, r"\."), F.lit(k)).try_cast("long"), F.lit(0))
    ident = lambda w: F.struct((w.rlike(r"^\d+$") == F.lit(False)).alias("is_word"), F.coalesce(w.try_cast("long"), F.lit(0)).alias("num"), w.alias("word"))
    return F.struct(
        (core != "").alias("parsable"),
        part(0).alias("major"),
        part(1).alias("minor"),
        part(2).alias("patch"),
        (pre == "").alias("is_release"),
        F.when(pre == "", F.array().cast("array<struct<is_word:boolean,num:bigint,word:string>>")).otherwise(F.transform(F.split(pre, r"\."), ident)).alias("pre"),
    )


def plain_path(path: Column) -> Column:
    """A path with forward slashes and without empty and `.` steps; case stays."""
    steps = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(steps, "/")


def glob_matches(pattern: Column, path: Column) -> Column:
    """Whether a path matches a glob, step by step: `**` stands for any number of steps, `*` for any characters of one step,
    `?` for one of them. A null on either side matches nothing."""
    literal = lambda x: F.regexp_replace(x, r"([\\.+^$()\[\]{}|])", r"\\$1")
    step = lambda x: F.when(x == "**", "(/[^/]*)*").otherwise(F.concat(F.lit("/"), F.replace(F.replace(literal(x), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))))
    regex = F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, "/"), step), ""), F.lit("$"))
    return F.coalesce(F.regexp_like(F.concat(F.lit("/"), path), regex), F.lit(False))
