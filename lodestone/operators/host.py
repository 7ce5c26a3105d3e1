"""Validation, waivers, stale entries, ranking and roll-ups of a findings relation.

Findings: check_id, severity, confidence, project, file, line, subject, summary, detail, member, positive_control, claim.
Every function takes and returns DataFrames and builds one lazy plan.

Cases, unless a function says otherwise: an empty table gives an empty result (exit_code() its one row); rows that repeat count as
often as they stand there; null severities rank lowest; a null check, file or subject equals nothing; extra columns are
kept where rows pass through and ignored where they are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import cut
from lodestone.functions.text import ABSENCE_WORDS, SEVERITIES, claims_absence, confidence_rank, glob_matches, plain_path, severity_rank

FINDING = "check_id string, severity string, confidence string, project string, file string, line int, subject string, summary string, detail string, member string, positive_control string, claim string"
#: Outcome kinds by precedence, lowest first.
OUTCOMES = ["Skipped", "Clean", "Findings", "CouldNotRun"]


#: The check id of judgements on the allow list itself; files of a conformance fixture.
ALLOWLIST = "allowlist"
FIXTURE = r"^(conformance/[^/]+/[^/]+)/."
#: Entries of one check and file up to which they travel with each finding of it.
ENTRIES = 1_000


def validate(findings: DataFrame, words: list[str] = ABSENCE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(valid, errors): a finding that claims an absence needs a positive control. A null summary claims nothing."""
    absent = F.coalesce((F.col("claim") == "absence") | claims_absence(F.col("summary"), words), F.lit(False))
    # words are looked for only where there is no control
    bad = (F.coalesce(F.trim("positive_control"), F.lit("")) == "") & absent
    return findings.filter(~bad), findings.filter(bad).withColumn("error", F.lit("an absence claim without a positive control"))


def outside_fixtures(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings but those in a conformance fixture: a directory of two levels below `conformance` that holds expect.toml.
    Findings without a file stay."""
    fixture = lambda c: F.regexp_extract(c, FIXTURE, 1)
    known = files.filter(F.col("path").rlike(r"^conformance/[^/]+/[^/]+/expect\.toml$")).select(fixture("path").alias("_fixture")).distinct()
    return findings.join(known, fixture("file") == F.col("_fixture"), "left_anti")


def waive(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings with number and reason of the first entry (by entry_no) that matches: same check and file, the symbol if the
    entry has one, the line within [lo, hi] if it has lines; where entries have a column crate_scope, those that fill it match the
    member of that name, or findings without a member of the project of that name. A finding without a file matches none. Entries
    are gathered per (check, file) and meet a finding once; files with over ENTRIES of them meet them by a join."""
    scope = ["crate_scope"] if "crate_scope" in entries.columns else []
    e = entries.select(F.col("check").alias("_check"), F.col("file").alias("_file"), F.struct("entry_no", "reason", "symbol", "lo", "hi", *scope).alias("_e"))
    per = e.groupBy("_check", "_file").agg(F.count(F.lit(1)).alias("_n"))
    crowded = not entries.groupBy("check", "file").count().filter(F.col("count") > ENTRIES).isEmpty()
    own = findings.withColumn("_key", F.monotonically_increasing_id())
    own = cut(own) if crowded else own  # keys must not change between two uses
    here = (F.col("check_id") == F.col("_check")) & (F.col("file") == F.col("_file"))
    fits = lambda x: (x["symbol"].isNull() | F.coalesce(x["symbol"] == F.col("subject"), F.lit(False))) & (x["lo"].isNull() | F.coalesce(F.col("line").between(x["lo"], x["hi"]), F.lit(False)))
    if scope:
        plain, owner = fits, F.coalesce("member", "project")
        fits = lambda x: plain(x) & (x["crate_scope"].isNull() | F.coalesce(x["crate_scope"] == owner, F.lit(False)))
    few = e.join(per.filter(F.col("_n") <= ENTRIES).drop("_n"), ["_check", "_file"], "left_semi").groupBy("_check", "_file").agg(F.sort_array(F.collect_list("_e")).alias("_all"))
    met = own.join(few, here, "left").withColumn("_w", F.get(F.filter("_all", fits), F.lit(0))).drop("_check", "_file", "_all")
    found = met
    if crowded:
        many = e.join(per.filter(F.col("_n") > ENTRIES).drop("_n"), ["_check", "_file"], "left_semi")
        hits = own.join(many, here & fits(F.col("_e"))).groupBy("_key").agg(F.min("_e").alias("_m"))
        found = met.join(hits, "_key", "left").withColumn("_w", F.coalesce("_w", "_m"))
    return found.select(*findings.columns, F.col("_w.entry_no").alias("entry_no"), F.col("_w.reason").alias("reason"))


def expand_globs(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries for waive() with globs in `file` replaced by the files of their check's findings that they match, and other
    paths made plain. A glob meets each different file of its check once; one that matches none goes."""
    e = entries.withColumn("file", plain_path(F.col("file")))
    is_glob = F.coalesce(F.col("file").rlike(r"[*?]"), F.lit(False))
    files = findings.select(F.col("check_id").alias("_check"), F.col("file").alias("_file")).filter("_file IS NOT NULL").distinct()
    met = e.filter(is_glob).join(files, (F.col("check") == F.col("_check")) & glob_matches(F.col("file"), F.col("_file")))
    return e.filter(~is_glob).unionByName(met.withColumn("file", F.col("_file")).select(*entries.columns))


def stale_entries(entries: DataFrame, findings: DataFrame, completed: DataFrame) -> DataFrame:
    """Entries of completed checks (column check_id) that match no finding, as waive() matches: by globs in `file` too, and by crate_scope.
    Inherited entries (member_prefix) and those of a wide list (source) are never stale, where the table has these columns."""
    own = entries
    for column in {"member_prefix", "source"} & set(entries.columns):
        own = own.filter(F.col(column).isNull())
    done = own.join(completed.select(F.col("check_id").alias("_done")).distinct(), F.col("check") == F.col("_done"), "left_semi")
    scope = "crate_scope" in entries.columns
    f = findings.select("check_id", F.col("file").alias("_file"), F.col("subject").alias("_subject"), F.col("line").alias("_line"), *([F.coalesce("member", "project").alias("_owner")] if scope else [])).distinct()
    path = plain_path(F.col("file"))
    match = (F.col("check") == F.col("check_id")) & (F.col("symbol").isNull() | (F.col("symbol") == F.col("_subject")))
    match &= F.col("lo").isNull() | F.col("_line").between(F.col("lo"), F.col("hi"))
    if scope:
        match &= F.col("crate_scope").isNull() | (F.col("crate_scope") == F.col("_owner"))
    # entries without a glob meet the findings of their file alone
    glob = F.coalesce(path.rlike(r"[*?]"), F.lit(False))
    left = done.filter(~glob).join(f, match & (path == F.col("_file")), "left_anti")
    return left.unionByName(done.filter(glob).join(f, match & glob_matches(path, F.col("_file")), "left_anti"))


def unknown_entries(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries whose check no rule or alias names."""
    names = rules.select(F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"))
    return entries.join(names, F.col("check") == F.col("_name"), "left_anti")


def canonical(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Rule ids in place of their aliases."""
    alias = rules.select(F.explode("aliases").alias("_alias"), F.col("id").alias("_id"))
    joined = df.join(alias, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_id", column)).select(*df.columns)


def _order(seq: str, by: list[Column] | None) -> list[Column]:
    return [*(by or [severity_rank(F.col("severity")).desc(), confidence_rank(F.col("confidence")).desc()]), F.col(seq)]


def top_n(findings: DataFrame, n: int, seq: str, by: list[Column] | None = None) -> DataFrame:
    """The n findings of highest severity, then confidence (or in the order `by`), then lowest `seq`."""
    return findings.orderBy(*_order(seq, by)).limit(n)


def omitted(findings: DataFrame, n: int, seq: str, by: list[Column] | None = None, key: str = "severity") -> DataFrame:
    """Number of findings per severity (or other key) that top_n leaves out: counts minus those of the n kept."""
    kept = top_n(findings, n, seq, by).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("k"))
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return counts.join(kept, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, (F.col("c") - F.coalesce("k", F.lit(0))).alias("n")).filter("n > 0")


def rule_summary(findings: DataFrame, waived: DataFrame) -> DataFrame:
    """Per rule: findings, waived, declared_public and a count per severity."""
    a = findings.select("check_id", "severity", F.lit(False).alias("w"), F.lit(False).alias("p"))
    b = waived.select("check_id", "severity", F.lit(True).alias("w"), F.coalesce("declared_public", F.lit(False)).alias("p"))
    by = [F.count_if((F.col("severity") == s) & ~F.col("w")).alias(s) for s in SEVERITIES]
    return a.unionByName(b).groupBy("check_id").agg(F.count_if(~F.col("w")).alias("findings"), F.count_if("w").alias("waived"), F.count_if("p").alias("declared_public"), *by)


def combine_outcomes(runs: DataFrame) -> DataFrame:
    """One outcome per rule over workspace members: could-not-run over findings (summed) over clean over skipped."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("kind"))
    return runs.groupBy("rule").agg(F.max(rank).alias("r"), F.sum(F.when(F.col("kind") == "Findings", F.col("n")).otherwise(0)).alias("n")).select("rule", F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("r").cast("int")).alias("kind"), F.when(F.col("r") == 3, F.col("n")).alias("n"))


def merge_members(passes: DataFrame) -> DataFrame:
    """Findings of all passes. Judgements on the allow list, which every pass makes, stand once per (project, subject,
    summary); all others stay, however alike."""
    own = F.coalesce(F.col("check_id") == ALLOWLIST, F.lit(False))
    return passes.filter(~own).unionByName(passes.filter(own).dropDuplicates(["project", "subject", "summary"]))


def coverage(rules: DataFrame, claims: DataFrame) -> DataFrame:
    """Rules with their state: covered, unproven or not_covered."""
    c = claims.groupBy(F.col("rule").alias("_rule")).agg(F.max(F.coalesce("proven", F.lit(False))).alias("proven"))
    state = F.when(F.col("_rule").isNull(), "not_covered").when(F.col("proven"), "covered").otherwise("unproven")
    return rules.join(c, F.col("id") == F.col("_rule"), "left").select(*rules.columns, state.alias("state"))


def pass_rate(clean: Column, found: Column) -> Column:
    """Percent of clean runs among those that ran, null if none did."""
    return F.try_divide(clean * 100.0, clean + found)


def exit_code(findings: DataFrame, errors: DataFrame, deny: str | None, floors: dict[str, str] | None = None, blocking: list[str] = ()) -> DataFrame:
    """One row: 3 if something could not run, else 1 if a finding reaches the deny floor, else 0 (2 is for wrong usage, which is
    no finding's). With `floors` (severity by check) each check has its own, those in `blocking` that have none `low`, and
    others none; without a deny floor no finding fails a run."""
    rank = severity_rank(F.col("severity"))
    if floors is None:
        hit = rank >= (SEVERITIES.index(deny) if deny else len(SEVERITIES))
    else:
        least = {**dict.fromkeys(blocking, "low"), **floors} if deny else {}
        hit = F.lit(False)
        for level in SEVERITIES:
            of = [c for c, x in least.items() if x == level]
            hit = hit | (F.col("check_id").isin(of) & (rank >= SEVERITIES.index(level))) if of else hit
    both = findings.select(F.coalesce(hit, F.lit(False)).alias("hit"), F.lit(False).alias("bad")).unionByName(errors.select(F.lit(False).alias("hit"), F.lit(True).alias("bad")))
    return both.agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"), F.coalesce(F.max("bad"), F.lit(False)).alias("bad")).select(F.when(F.col("bad"), 3).when(F.col("hit"), 1).otherwise(0).alias("exit_code"))
