"""Audit rules over repository files: each takes files (repo, path, text) and returns findings.

All are lazy plans over lines; what a repository lacks is an aggregate per repository with its positive control.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.snapshot import lines

#: Directories that hold other people's or quoted files; extensions of patches.
SKIPPED = "fixtures|fixture|testdata|test_data|conformance|snapshots|golden|vendor|vendors|third_party|third-party|node_modules|bower_components"
PATCHES = r"\.(patch|diff|rej|orig)$"
#: What publishes, lists components, signs.
PUBLISHERS = "cargo publish|cargo release|npm publish|twine upload|gh release|pypa/gh-action-pypi-publish|softprops/action-gh-release|actions/create-release|goreleaser"
SBOM_WORDS = "cyclonedx|cargo sbom|cargo-sbom|syft|spdx|sbom"
SIGNING_WORDS = "cosign|sigstore|slsa|provenance|attest|gpg|minisign"
OWNER_PLACES = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"]
MIN_PAGES = 10
MAX_VERSIONS = 3
MANIFESTS = r"(^|/)(Cargo\.toml|package\.json|pyproject\.toml|go\.mod)$"


def finding(df: DataFrame, check: str, severity, confidence, file, line, subject, summary, control=None, read=None, detail=None, claim=None) -> DataFrame:
    """Rows of the findings schema (with claim `absence` where a control is given, unless `claim` says it by row). `read` is the control of a finding that shows
    something: what was read for it (its place unless said otherwise), beside which its words, names among them, may deny something."""
    c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    read = F.concat(F.lit("read "), F.concat_ws(":", F.coalesce(c(file, "string"), F.col("repo").cast("string"), F.lit("here")), c(line, "string"))) if read is None else read
    return df.select(
        c(check, "string").alias("check_id"), c(severity, "string").alias("severity"), c(confidence, "string").alias("confidence"), c(F.col("repo"), "string").alias("project"),
        c(file, "string").alias("file"), c(line, "int").alias("line"), c(subject, "string").alias("subject"), c(summary, "string").alias("summary"), c(detail, "string").alias("detail"),
        F.lit(None).cast("string").alias("member"), c(read if control is None else control, "string").alias("positive_control"), c(claim if claim is not None or control is None else "absence", "string").alias("claim"),
    )


def _in_dir(names: str) -> Column:
    return F.col("path").rlike(f"(^|/)({names})/")


def _unfenced(ls: DataFrame) -> DataFrame:
    """Lines outside fenced blocks of Markdown files, fences left out."""
    fence = F.col("path").rlike(r"\.(md|markdown|mdx)$") & F.col("text").rlike(r"^ {0,3}(```|~~~)")
    w = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ls.withColumn("_f", fence).withColumn("_n", F.count_if("_f").over(w)).filter(~F.col("_f") & (F.col("_n") % 2 == 0)).drop("_f", "_n")


def conflict_markers(files: DataFrame) -> DataFrame:
    """GOV-011: a conflict region, or a closing marker without an opening one. Only lines that are markers or fences go
    into the per-file order."""
    ls = lines(files.filter(~_in_dir(SKIPPED) & ~F.col("path").rlike(PATCHES)))
    ls = _unfenced(ls.filter(F.col("text").rlike(r"^(<{7}|>{7})( |$)|^ {0,3}(```|~~~)"))).withColumn("opens", F.col("text").rlike("^<{7}( |$)")).filter(F.col("text").rlike("^(<{7}|>{7})( |$)"))
    before = F.lag("opens").over(Window.partitionBy("repo", "path").orderBy("line"))
    stray = ls.withColumn("b", before).filter(F.col("opens") | ~F.coalesce("b", F.lit(False)))
    return finding(stray, "GOV-011", "high", "high", F.col("path"), F.col("line"), F.col("path"), F.when(F.col("opens"), "an unresolved conflict region").otherwise("a closing marker without an opening one"))


def many_versions(files: DataFrame, limit: int = MAX_VERSIONS) -> DataFrame:
    """SUP-005: packages that a lockfile resolves to more than `limit` versions, one finding per lockfile."""
    locks = files.filter(F.col("path").rlike(r"(^|/)Cargo\.lock$") & ~_in_dir("vendor|vendors|third_party|third-party|node_modules|target|tests|test|testdata|fixtures|conformance"))
    block = F.explode(F.split("text", r"(?m)^\[\[package\]\]\s*$")).alias("b")
    pick = lambda key: F.regexp_extract("b", rf'(?m)^{key}\s*=\s*"([^"]*)"', 1)
    packages = locks.select("repo", "path", block).select("repo", "path", pick("name").alias("name"), pick("version").alias("version")).filter("name <> '' AND version <> ''")
    counts = packages.groupBy("repo", "path", "name").agg(F.countDistinct("version").alias("n")).filter(F.col("n") > limit)
    named = counts.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "name"))).alias("p"))
    return finding(named, "SUP-005", "info", "medium", F.col("path"), None, F.col("path"), F.concat(F.lit("packages at several versions: "), F.array_join(F.transform("p", lambda x: x["name"]), ", ")))


def glossary(files: DataFrame) -> DataFrame:
    """DOC-009: many documentation pages without a glossary, and terms that a glossary defines twice."""
    is_doc, is_gloss = F.col("path").rlike(r"^docs?/.*\.md$"), F.lower(F.regexp_extract("path", "[^/]*$", 0)).contains("glossary")
    per = files.groupBy("repo").agg(F.count_if(is_doc).alias("docs"), F.count_if(is_gloss).alias("gloss"), F.count(F.lit(1)).alias("n"))
    lacking = per.filter((F.col("docs") >= MIN_PAGES) & (F.col("gloss") == 0))
    absent = finding(lacking, "DOC-009", "info", "low", "GLOSSARY.md", None, "glossary", "documented without a glossary", F.concat(F.col("docs").cast("string"), F.lit(" pages among "), F.col("n").cast("string"), F.lit(" tracked paths")))
    documented = per.filter("docs > 0").select(F.col("repo").alias("_r"))
    t = F.trim("text")
    heading = F.trim(F.regexp_replace(F.regexp_extract(t, r"^##(.*)$", 1), "^#*", ""))
    bold = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, r"^(?:[-*] )?\*\*(.*?)\*\*", 1)), ":+$", ""))
    terms = lines(files.filter(is_gloss).join(documented, F.col("repo") == F.col("_r"), "left_semi")).withColumn("term", F.lower(F.when(t.startswith("##"), heading).otherwise(bold))).filter("term <> ''")
    rn = F.row_number().over(Window.partitionBy("repo", "path", "term").orderBy("line"))
    twice = terms.withColumn("rn", rn).filter("rn > 1")
    return absent.unionByName(finding(twice, "DOC-009", "info", "low", F.col("path"), F.col("line"), F.col("term"), F.concat(F.lit("defined more than once: "), F.col("term"))))


def code_owners(files: DataFrame) -> DataFrame:
    """WSP-001: no CODEOWNERS file, or none of its entries is `*` with an owner. The first place in order counts."""
    place = F.array_position(F.array(*map(F.lit, OWNER_PLACES)), F.col("path"))
    entry = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r" #.*$", "")))
    owned = F.exists(entry, lambda x: x.rlike(r"^\*\s(.*\s)?(@\S*|\S*@\S*\.\S*|\S*\.\S*@\S*)(\s|$)"))
    per = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(place > 0, F.struct(place.alias("k"), "path", F.coalesce(owned, F.lit(False)).alias("ok")))).alias("best"))
    bad = per.filter("best IS NULL OR NOT best.ok")
    return finding(bad, "WSP-001", "medium", "high", F.coalesce("best.path", F.lit(OWNER_PLACES[0])), None, "CODEOWNERS", "no default owner", F.concat(F.lit("searched "), F.col("n").cast("string"), F.lit(" tracked files for "), F.lit(", ".join(OWNER_PLACES))))


def _release(files: DataFrame, words: str) -> DataFrame:
    """Release workflows without any of some words: (repo, path, line of the first publishing step)."""
    ls = lines(files.filter(F.col("path").rlike(r"^\.github/workflows/.*\.ya?ml$"))).filter(~F.ltrim("text").startswith("#")).withColumn("low", F.lower("text"))
    publishes = F.col("low").rlike(PUBLISHERS) & ~F.col("low").contains("--dry-run")
    return ls.groupBy("repo", "path").agg(F.min(F.when(publishes, F.col("line"))).alias("line"), F.max(F.col("low").rlike(words)).alias("has")).filter("line IS NOT NULL AND NOT has")


def release_sbom(files: DataFrame) -> DataFrame:
    """SUP-009: a release workflow without a step for a bill of materials."""
    return finding(_release(files, SBOM_WORDS), "SUP-009", "info", "low", F.col("path"), F.col("line"), F.col("path"), "releases without a bill of materials", F.concat(F.lit("read in full: "), F.col("path")))


def release_signing(files: DataFrame) -> DataFrame:
    """SUP-010: a release workflow that signs and attests nothing."""
    return finding(_release(files, SIGNING_WORDS), "SUP-010", "medium", "low", F.col("path"), F.col("line"), F.col("path"), "releases unsigned", F.concat(F.lit("read in full: "), F.col("path")))


def _lacks(files: DataFrame, check: str, what: str, there: Column) -> DataFrame:
    per = files.groupBy("repo").agg(F.min(F.when(F.col("path").rlike(MANIFESTS), F.struct(F.length("path").alias("l"), "path"))).alias("m"), F.count_if(there).alias("k"), F.count(F.lit(1)).alias("n"))
    return finding(per.filter("m IS NOT NULL AND k = 0"), check, "info", "low", F.col("m.path"), None, F.col("repo"), f"no {what} is tracked", F.concat(F.col("n").cast("string"), F.lit(" tracked files were searched")))


def threat_model(files: DataFrame) -> DataFrame:
    """SEC-007: a project without a threat model."""
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    return _lacks(files, "SEC-007", "threat model", name.rlike("^threat[-_]?model") | (F.col("path").rlike("^docs/") & name.startswith("threat")))


def mode_outliers(values: DataFrame, key: str, subject: str, value: str, rank: Column) -> DataFrame:
    """WSP-010: rows whose value differs from the most frequent of their key; ties go to the highest rank."""
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.max(rank).alias("_rank"))
    modal = counts.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct("_n", "_rank", F.col(value).alias("v"))).alias("m"))
    return values.join(modal, F.col(key) == F.col("_k")).filter(F.col(value) != F.col("m.v")).select(key, subject, value, F.col("m.v").alias("modal"))


def unowned_todos(files: DataFrame) -> DataFrame:
    """RDB-008: a TODO or FIXME in a line comment that names no owner or issue."""
    ls = lines(files.filter(F.col("path").rlike(r"\.(rs|py|ts|js|go|java|c|h|cpp|sh|toml|ya?ml)$") & ~_in_dir(SKIPPED)))
    comment = F.regexp_extract("text", r"^\s*(?://+!?|#+)\s*(.*)$", 1)
    bad = ls.withColumn("c", comment).filter(F.col("c").rlike(r"^(TODO|FIXME)\b") & ~F.col("c").rlike(r"^(TODO|FIXME)\s*\([^)]+\)|#\d+|https?://|@\w"))
    return finding(bad, "RDB-008", "low", "medium", F.col("path"), F.col("line"), F.col("path"), F.col("c"))


#: The text that opens a named read of the environment, by extension.
ENV_READS = {
    "rs": r"env::var(?:_os)?\(", "py": r"os\.(?:environ\[|environ\.get\(|getenv\()", "js|jsx|mjs|cjs|ts|tsx": r"process\.env(?:\.|\[)", "go": r"os\.(?:Getenv|LookupEnv)\(",
    "java|kt|scala": r"System\.getenv\(", "rb": r"ENV(?:\[|\.fetch\()", "cs": r"Environment\.GetEnvironmentVariable\(", "php": r"(?:getenv\(|\$_ENV\[)",
}
#: Variables of the platform; directories and names of tooling and tests.
PLATFORM = [
    "PATH", "PATHEXT", "HOME", "USER", "USERNAME", "USERPROFILE", "LOCALAPPDATA", "APPDATA", "PROGRAMDATA",
    "ProgramData", "ProgramFiles", "ProgramFiles(x86)", "PROGRAMFILES", "SystemRoot", "SYSTEMROOT", "TEMP", "TMP", "TMPDIR",
    "PWD", "SHELL", "TERM", "LANG", "CI", "CARGO_MANIFEST_DIR", "OUT_DIR", "PYTHONPATH", "PYTHONIOENCODING",
    "LD_LIBRARY_PATH",
]
DEV_DIRS = "tools|scripts|script|probe|probes|spike|spikes|xtask|docs|e2e|bench|benches|examples|\\.github|tests|test|__tests__|spec"
DEV_NAMES = r"(^|/)(build\.rs|tests\.rs|tests_[^/]*|[^/]*_tests\.rs|[^/]*_test\.(go|py)|test_[^/]*|[^/]*\.(test|spec)\.[^/]*|[^/]*\.config\.(js|ts|mjs|cjs))$"
ANALYSIS_CONFIGS = ["codecov.yml", ".codecov.yml", "codecov.yaml", ".codacy.yml", ".codacy.yaml", "sonar-project.properties", ".eslintignore", ".deepsource.toml"]
VENDOR = "vendor|vendors|third_party|third-party|node_modules|bower_components"
ENV_FILES = 3
#: What opens a line that is a comment.
COMMENT = r"^\s*(//|#|\*|/\*|--)"


def env_reads(files: DataFrame) -> DataFrame:
    """(repo, path, line, name): named reads of environment variables in product code. Platform variables and those of the
    XDG_ family are left out, as are comments and what stands in a string that opened before on the line."""
    found = None
    source = files.filter(~_in_dir(SKIPPED) & ~_in_dir(DEV_DIRS) & ~F.col("path").rlike(DEV_NAMES))
    for ext, opens in ENV_READS.items():
        of = lines(source.filter(F.col("path").rlike(rf"(?i)\.({ext})$") & F.col("text").rlike(opens))).filter(~F.col("text").rlike(COMMENT))
        # strings that are whole stay as they are after a read's opening text and are emptied before one
        bare = F.regexp_replace("text", r"""("(?:[^"\\\\]|\\\\.)*"|`[^`]*`)""".replace("\\\\", "\\"), "$1\n")
        code = F.array_join(F.transform(F.split(bare, "\n"), lambda x: F.when(x.rlike(opens + r"""\s*["`][^"`]*["`]$"""), x).otherwise(F.regexp_replace(x, r"""["`].*$""", '""'))), "")
        names = F.explode(F.regexp_extract_all(code, F.lit(opens + r"""\s*(["'][^"']+["']|[A-Za-z_][A-Za-z0-9_]*)"""), F.lit(1))).alias("name")
        rows = of.select("repo", "path", "line", names).withColumn("name", F.regexp_replace("name", "[\"']", ""))
        found = rows if found is None else found.unionByName(rows)
    return found.filter(~F.col("name").isin(*PLATFORM) & ~F.col("name").startswith("XDG_"))


def scattered_env(files: DataFrame) -> DataFrame:
    """EFX-003: environment variables are read in three or more files of a repository; one finding at the first."""
    per = env_reads(files).groupBy("repo").agg(F.countDistinct("path").alias("n"), F.min(F.struct("path", "line")).alias("first")).filter(F.col("n") >= ENV_FILES)
    return finding(per, "EFX-003", "low", "high", F.col("first.path"), F.col("first.line"), F.col("repo"), F.concat(F.lit("environment read in files: "), F.col("n").cast("string")))


def undocumented_env(files: DataFrame) -> DataFrame:
    """OPS-002: a variable that code reads and no documentation file names as a whole word; at its first read."""
    reads = env_reads(files).groupBy("repo", "name").agg(F.min(F.struct("path", "line")).alias("first"))
    docs = files.filter(F.col("path").rlike(r"(?i)(\.(md|markdown|rst|txt|adoc)|(^|/)\.env[^/]*)$"))
    words = docs.select("repo", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    bare = reads.join(words, ["repo", "name"], "left_anti")
    return finding(bare, "OPS-002", "low", "medium", F.col("first.path"), F.col("first.line"), F.col("name"), F.concat(F.lit("in no documentation: "), F.col("name")), "every documentation file was searched for the name")


def failure_model(files: DataFrame) -> DataFrame:
    """REL-007: a project without a failure model, as a file or as a heading of an architecture document."""
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    docs = F.lower("path").rlike("^docs?/|/docs/")
    design = name.rlike(r"^architecture.*\.md$") | (docs & name.rlike(r"^(design|architecture).*\.md$"))
    titled = F.coalesce(F.col("text").rlike(r"(?im)^\s*#.*failure mode"), F.lit(False))
    return _lacks(files, "REL-007", "failure model", name.rlike("^failure[-_]?mode") | (design & titled))


def vendored_unexcluded(files: DataFrame) -> DataFrame:
    """SUP-011: an analysis configuration that doesn't name a vendored directory."""
    top = F.regexp_extract("path", f"^((?:[^/]+/)*?(?:{VENDOR}))/", 1)
    dirs = files.select("repo", top.alias("dir")).filter("dir <> ''").groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n"))
    configs = files.filter(F.col("path").isin(*ANALYSIS_CONFIGS) & F.col("text").isNotNull()).select(F.col("repo").alias("_r"), "path", "text")
    bad = dirs.join(configs, F.col("repo") == F.col("_r")).filter(~F.col("text").contains(F.regexp_extract("dir", "[^/]*$", 0)))
    return finding(bad, "SUP-011", "low", "medium", F.col("path"), None, F.col("dir"), "a vendored directory isn't excluded", F.concat(F.lit("tracked files there: "), F.col("n").cast("string")))


def dead_links(files: DataFrame) -> DataFrame:
    """DOC-010, local part: links of Markdown documents to files that aren't tracked. Targets resolve against the
    document's directory, or the root where they begin with a slash; remote links need a status table."""
    docs = _unfenced(lines(files.filter(F.col("path").rlike(r"\.(md|markdown)$"))))
    raw = docs.select("repo", "path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(\s*<?([^)>\s]+)"), F.lit(1))).alias("link"))
    target = F.regexp_replace("link", r"[#?].*$", "")
    local = raw.withColumn("target", target).filter((F.col("target") != "") & ~F.col("link").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"))
    base = F.when(F.col("target").startswith("/"), "").otherwise(F.regexp_extract("path", r"^(.*/)?", 0))
    steps = F.split(F.concat(base, F.col("target")), "/")
    fold = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    resolved = local.withColumn("to", F.array_join(fold, "/")).filter("to <> ''")
    deep = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("to")
    known = files.select("repo", deep).distinct()  # files and the directories above them
    dead = resolved.join(known, ["repo", "to"], "left_anti")
    return finding(dead, "DOC-010", "low", "high", F.col("path"), F.col("line"), F.col("link"), F.concat(F.lit("links to an untracked file: "), F.col("to")))


#: Lockfiles of npm, yarn, pnpm and bun.
NODE_LOCKS = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb"]


def missing_locks(files: DataFrame) -> DataFrame:
    """SUP-001, lockfiles: an application's manifest without a lockfile in its directory or one above: a Cargo package with
    src/main.rs or a [[bin]], or a private npm package."""
    name, home = F.regexp_extract("path", "[^/]*$", 0), F.regexp_extract("path", "^(.*/)?", 0)
    cargo = files.filter(name == "Cargo.toml").filter(F.col("text").rlike(r"(?m)^\s*\[package\]")).select("repo", "path", home.alias("home"), F.col("text").rlike(r"(?m)^\s*\[\[bin\]\]").alias("bin"))
    mains = files.filter(F.col("path").rlike("(^|/)src/main[.]rs$")).select("repo", F.regexp_replace("path", "src/main[.]rs$", "").alias("home"), F.lit(True).alias("main")).distinct()
    apps = cargo.join(mains, ["repo", "home"], "left").filter("bin OR main").select("repo", "path", "home", F.lit("cargo").alias("kind"))
    node = files.filter((name == "package.json") & (F.get_json_object("text", "$.private") == "true")).select("repo", "path", home.alias("home"), F.lit("node").alias("kind"))
    kind = F.when(name == "Cargo.lock", "cargo").when(name.isin(*NODE_LOCKS), "node")
    locks = files.select("repo", home.alias("up"), kind.alias("kind")).filter("kind IS NOT NULL").distinct()
    steps = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.concat(F.slice(steps, 1, k - 1), F.array(F.lit(""))), "/"))
    all_apps = apps.unionByName(node)
    covered = all_apps.select("repo", "path", "kind", F.explode(above).alias("up")).join(locks, ["repo", "up", "kind"], "left_semi")
    bare = all_apps.join(covered.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return finding(bare, "SUP-001", "medium", "medium", F.col("path"), None, F.col("path"), "an application without a lockfile", "its directory and those above it were searched for one")


RULES = {
    "SUP-001": missing_locks,
    "GOV-011": conflict_markers, "SUP-005": many_versions, "DOC-009": glossary, "WSP-001": code_owners, "SUP-009": release_sbom, "SUP-010": release_signing, "SEC-007": threat_model, "RDB-008": unowned_todos,
    "EFX-003": scattered_env, "OPS-002": undocumented_env, "REL-007": failure_model, "SUP-011": vendored_unexcluded, "DOC-010": dead_links,
}


def audit(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Findings of all rules (or those named) as one plan."""
    found = None
    for rule in only or RULES:
        rows = RULES[rule](files)
        found = rows if found is None else found.unionByName(rows)
    return found
