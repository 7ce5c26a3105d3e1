"""Secrets in the history of repositories, each content read once.

A history is content-addressed: commits (repo, commit, file, blob) name contents, and blobs (blob, text) hold each different one once.
A blob is scanned once, however many commits carry it, and what is found goes back to its commits by a join on the blob; only the
few blobs with a finding take part. Reviewed waivers are dated and name one leak exactly.

Cases: an empty table gives an empty result; blobs listed twice are scanned once; null texts hold nothing; waivers that aren't sound are
errors and waive nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.redact import SHAPES
from lodestone.operators.rules import finding

COL = F.col
#: Fixed value: the longest that a waiver may run after its review.
MAX_DAYS = 365
LEAK = ["repo", "commit", "file", "rule", "line"]


def patterns() -> dict[str, str]:
    """Pattern of each rule of the scan: known shapes of tokens, private keys, and quoted values of secret names."""
    shapes = {f"token-{k}": rf"(?<![A-Za-z0-9]){p}[{c}]{{{n}}}" + ("(?![A-Za-z0-9])" if fixed else "") for k, (p, c, n, fixed) in enumerate(SHAPES)}
    return shapes | {"private-key": r"-----BEGIN [A-Z ]{0,47}?PRIVATE KEY(?: BLOCK)?-----", "keyed-value": r"(?i)(?:token|secret|password|api_?key)\s*[:=]\s*\"[A-Za-z0-9+/_.=-]{16,}\""}


def leaks_of(blobs: DataFrame) -> DataFrame:
    """(blob, line, rule) of blobs (blob, text), each different one scanned once."""
    named = F.array_compact(F.array(*[F.when(COL("x").rlike(p), F.lit(k)) for k, p in patterns().items()]))
    once = blobs.dropDuplicates(["blob"]).filter(COL("text").rlike("|".join(f"(?:{p})" for p in patterns().values())))
    each = once.select("blob", F.posexplode(F.split("text", r"\r?\n")).alias("at", "x"))
    return each.select("blob", (COL("at") + 1).alias("line"), F.explode(named).alias("rule"))


def leaks(commits: DataFrame, blobs: DataFrame) -> DataFrame:
    """(repo, commit, file, rule, line, blob): what each commit that carries a leaking blob shows."""
    found = leaks_of(blobs)
    return commits.select("repo", "commit", "file", "blob").distinct().join(found, "blob").select(*LEAK, "blob")


def waiver_errors(waivers: DataFrame) -> DataFrame:
    """Waivers (repo, commit, file, rule, line, reviewer, reviewed, expires, evidence) with `error`, where one isn't sound."""
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    span = F.date_diff(day("expires"), day("reviewed"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    counts = waivers.groupBy(F.lower("repo").alias("_repo"), *LEAK[1:]).agg(F.count(F.lit(1)).alias("_n"))
    w = waivers.withColumn("_repo", F.lower("repo")).join(counts, ["_repo", *LEAK[1:]], "left")
    error = (
        F.when(~F.coalesce(COL("commit").rlike("^[0-9a-f]{40}$"), F.lit(False)), "the commit is not a full hash").when(~F.coalesce(COL("repo").rlike("^[^/]+/[^/]+$"), F.lit(False)), "the repository is not owner/name")
        .when(blank("file") | blank("rule") | blank("evidence"), "file, rule or evidence is empty").when(~F.coalesce(COL("line") > 0, F.lit(False)), "the line is below 1").when(blank("reviewer"), "the reviewer is missing")
        .when(span.isNull(), "a date is not YYYY-MM-DD").when((span <= 0) | (span > MAX_DAYS), F.concat(F.lit("it runs "), span.cast("string"), F.lit(" days"))).when(COL("_n") > 1, "it is listed twice")
    )
    return w.withColumn("error", error).filter("error IS NOT NULL").select(*waivers.columns, "error")


def history_secrets(commits: DataFrame, blobs: DataFrame, waivers: DataFrame, today: Column | None = None) -> DataFrame:
    """SEC-002: leaks in any commit (high); those with a reviewed waiver (info), with one past its date (medium); and waivers of a commit of
    the history that match no leak (medium). A waiver names repository, commit, file, rule and line exactly."""
    today = F.current_date() if today is None else today
    bad = waiver_errors(waivers).select(*[COL(c).alias(f"_{c}") for c in LEAK])
    same = None
    for c in LEAK:
        same = COL(c).eqNullSafe(COL(f"_{c}")) if same is None else same & COL(c).eqNullSafe(COL(f"_{c}"))
    sound = waivers.join(bad, same, "left_anti").withColumn("_until", F.try_to_date("expires", "yyyy-MM-dd")).select(*LEAK, "_until", "reviewer", "evidence")
    found = leaks(commits, blobs)
    met = found.join(sound, LEAK, "left")
    state = F.when(COL("_until").isNull(), F.struct(F.lit("high").alias("s"), F.lit("a secret in history").alias("t"))).when(COL("_until") < today, F.struct(F.lit("medium").alias("s"), F.lit("a secret in history whose waiver has expired").alias("t"))).otherwise(
        F.struct(F.lit("info").alias("s"), F.concat(F.lit("reviewed by "), COL("reviewer"), F.lit(": "), COL("evidence")).alias("t"))
    )
    subject = F.concat_ws(":", "commit", "file", "rule", "line")
    one = finding(met.withColumn("k", state), "SEC-002", COL("k.s"), "high", COL("file"), COL("line"), subject, COL("k.t"))
    stale = sound.join(commits.select("repo", "commit").distinct(), ["repo", "commit"], "left_semi").join(found.select(*LEAK).distinct(), LEAK, "left_anti")
    return one.unionByName(finding(stale, "SEC-002", "medium", "high", COL("file"), COL("line"), subject, "a waiver that matches nothing"))
