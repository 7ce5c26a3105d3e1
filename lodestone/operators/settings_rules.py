"""Audit rules over settings files: workflows, alerts, flag registries and manifests, read as facts (repo, path, line, keys, value).

Every rule is one or two aggregations over the facts of its files, keyed by the part of the path of names that it judges (a job, an
alert, an entry, a dependency). Facts of one job, entry or file are bounded by their file.

Cases: an empty table gives an empty result; null values are keys without one; keys written twice count as both; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rules import finding
from lodestone.sources.settings import toml_facts, yaml_facts

COL = F.col
#: Words that stand for hardware of one's own, events from outside, and the condition that keeps forks out.
GPU_WORDS = ["gpu", "cuda", "vulkan", "nvidia", "rocm", "opencl"]
OUTSIDE = ["pull_request", "pull_request_target"]
SAME_REPO = ["github.event.pull_request.head.repo.full_name==github.repository", "github.repository==github.event.pull_request.head.repo.full_name"]
HOSTED = r"(?i)^(ubuntu-|windows-|macos-)"
#: Directories whose settings aren't judged, and names of files.
ALERTS_SKIPPED = ["vendor", "vendors", "third_party", "third-party", "node_modules", "tests", "test", "testdata", "fixtures"]
FLAGS_SKIPPED = ["vendor", "node_modules", "target", "third_party", "tests", "test", "__tests__", "fixtures", "fixture", "testdata", "examples"]
FLAG_FILES = ["flags", "feature-flags", "feature_flags", "featureflags", "feature-toggles", "feature_toggles", "toggles"]
FLAG_LISTS = ["flags", "feature_flags", "features", "toggles"]
OWNER = ["owner", "owners", "maintainer", "team", "responsible", "contact", "assignee"]
SUNSET = ["sunset", "expires", "expiry", "expiration", "expire", "remove_by", "removal_date", "end_date", "retire_by", "delete_by", "remove_after"]
FLAG_NAMES = ["name", "key", "id", "flag"]
DEPENDENCIES = ["dependencies", "dev-dependencies", "build-dependencies"]
MANIFESTS_SKIPPED = ["fixtures", "fixture", "testdata", "test_data", "conformance", "snapshots", "golden", "vendor", "vendors", "third_party", "third-party", "node_modules"]

KEY = lambda k: F.get("keys", F.lit(k))
LAST = lambda: F.element_at("keys", -1)


def _outside(names: list[str]) -> Column:
    return ~COL("path").rlike("(^|/)(" + "|".join(names) + ")/")


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")


def workflow_facts(files: DataFrame) -> DataFrame:
    return yaml_facts(files.filter(COL("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$")))


def _secrets(values: Column) -> Column:
    """Names of secrets that texts read, GITHUB_TOKEN aside."""
    named = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(r"(?U)(?<![\w-])secrets\.([\w-]+)"), F.lit(1))))
    return F.array_distinct(F.filter(named, lambda s: F.lower(s) != "github_token"))


def _workflow_jobs(facts: DataFrame) -> DataFrame:
    """A row per job and, with a null job, one for what a file says outside its jobs: one aggregation. Columns of the other kind are empty."""
    top, texts = F.size("keys") == 1, lambda c: F.collect_list(F.when(c, COL("value")))
    event = F.when((KEY(0) == "on") & (F.size("keys") == 1), COL("value")).when((KEY(0) == "on") & (F.size("keys") == 2), F.when(KEY(1).startswith("#"), COL("value")).otherwise(KEY(1)))
    branch = lambda k: F.collect_set(F.when((KEY(0) == "on") & (KEY(1) == "pull_request") & (KEY(2) == k), COL("value")))
    at = lambda *k: (F.size("keys") >= 2 + len(k)) & (F.slice("keys", 3, len(k)) == F.array(*map(F.lit, k)))
    step = F.when(at("steps") & (F.size("keys") >= 4), F.get("keys", F.lit(3)))
    inside = facts.withColumn("job", F.when((KEY(0) == "jobs") & (F.size("keys") >= 2), KEY(1))).withColumn("_step", step)
    of = lambda c: F.when(COL("job").isNotNull(), c)
    return inside.groupBy("repo", "path", "job").agg(
        F.array_sort(F.collect_set(event)).alias("events"), F.max(top & (KEY(0) == "permissions")).alias("has_permissions"), F.max(F.when(top & (KEY(0) == "name"), COL("value"))).alias("title"),
        texts(KEY(0) == "env").alias("env"), branch("branches").alias("branches"), branch("branches-ignore").alias("ignored"), F.min(F.when((KEY(0) == "on") & (LAST() == "pull_request"), COL("line"))).alias("trigger"),
        F.min("line").alias("line"), F.collect_list(of(COL("value"))).alias("texts"), F.collect_list(of(F.when(at("runs-on") & ((F.size("keys") == 3) | (F.size("keys") == 4) & KEY(3).startswith("#") | (KEY(3) == "labels")), COL("value")))).alias("labels"),
        F.array_join(F.collect_list(of(F.when(at("if") & (F.size("keys") == 3), COL("value")))), "").alias("cond"), F.coalesce(F.max(of(at("environment"))), F.lit(False)).alias("gated"),
        F.coalesce(F.max(of(at("secrets") & (F.size("keys") == 3) & (COL("value") == "inherit"))), F.lit(False)).alias("inherits"),
        F.array_intersect(
            F.collect_set(of(F.when((KEY(4) == "uses") & COL("value").startswith("actions/checkout"), COL("_step")))),
            F.collect_set(of(F.when((KEY(4) == "with") & KEY(5).isin("ref", "repository") & COL("value").rlike(r"pull_request\.head|github\.head_ref"), COL("_step")))),
        ).alias("head_steps"),
    )


def workflow_exposure(files: DataFrame) -> DataFrame:
    """SUP-017: what workflows give a pull request from outside: secrets, the contributor's code with the base's token, runners of one's
    own without the same-repository condition or a reviewer; runners of one's own that name no hardware; a trigger that leaves the
    default branch out; and workflows without permissions of their own. Files are parsed and gathered once for all of them."""
    flow, job = COL("job").isNull(), COL("job").isNotNull()
    # an `if` that names another event or a branch keeps pull requests out
    named = COL("cond").contains("github.event_name ==") | COL("cond").rlike(r"(github\.ref == |startsWith\(github\.ref, )'refs/(heads|tags)/")
    never = named & ~COL("cond").rlike(r"pull_request|\|\||!=")
    own = F.when(~F.exists("labels", lambda x: x.contains("${{")), F.filter("labels", lambda x: ~x.rlike(HOSTED)))
    squeezed = F.regexp_replace("cond", r"\s", "")
    guarded = squeezed.contains(SAME_REPO[0]) | squeezed.contains(SAME_REPO[1])
    # words of hardware hold no blank, so each text may be searched by itself
    hardware = lambda c: F.coalesce(F.lower(c).rlike("|".join(GPU_WORDS)), F.lit(False))
    default = F.array(*map(F.lit, ["main", "master", "**", "*"]))
    leaves = F.when(F.size("branches") > 0, ~F.arrays_overlap("branches", default)).otherwise(F.arrays_overlap("ignored", default)) & (F.size("branches") + F.size("ignored") > 0)
    each = _workflow_jobs(workflow_facts(files)).select(
        "repo", "path", "job", "line", "trigger", "gated", "inherits", (~F.coalesce("has_permissions", F.lit(False))).alias("bare"), leaves.alias("leaves"), (~never).alias("may_run"), _secrets(F.concat("texts", "env")).alias("secrets"),
        F.when(job, own).alias("own"), guarded.alias("guarded"), (F.size("head_steps") > 0).alias("at_head"), (hardware(COL("title")) | hardware(COL("job")) | hardware(F.array_join("texts", " "))).alias("hardware"),
        F.when(flow, F.struct("events", _secrets(COL("env")).alias("secrets"), hardware(COL("title")).alias("hardware"))).alias("flow"),
    )
    w = Window.partitionBy("repo", "path")
    j = each.withColumn("flow", F.first("flow", ignorenulls=True).over(w))
    exposed = F.arrays_overlap("flow.events", F.array(*map(F.lit, OUTSIDE))) & COL("may_run")
    secrets = F.array_distinct(F.concat("secrets", "flow.secrets"))
    reads = F.when(COL("inherits"), F.lit("all repository secrets")).when(F.size(secrets) > 0, F.concat(F.lit("the secrets "), F.array_join(F.array_sort(secrets), ", ")))
    j = j.withColumn("exposed", exposed).withColumn("reads", reads).withColumn("head", COL("at_head") & F.array_contains("flow.events", "pull_request_target"))
    sound = COL("hardware") | COL("flow.hardware") | hardware(COL("path"))
    whole = F.concat(COL("path"), F.lit(" was read whole"))
    one = F.concat(COL("path"), F.lit(" job "), COL("job"), F.lit(" was read whole"))
    none = F.lit(None).cast("string")
    k = lambda hit, severity, what, summary, control, line=COL("line"), confidence=None: F.when(hit, F.struct(F.lit(severity).alias("severity"), F.lit(confidence or severity).alias("confidence"), line.alias("line"), F.concat_ws(":", "job", F.lit(what)).alias("subject"), summary.alias("summary"), control.alias("control")))
    # a row of a null repo meets no file's, as it would in a join
    told = job & COL("repo").isNotNull()
    has_own = told & F.coalesce(F.size("own") > 0, F.lit(False))
    on = F.concat(F.lit("runs on "), _joined(COL("own")))
    kinds = F.array(
        k(flow & COL("bare"), "low", "permissions", F.lit("no top-level permissions block"), whole, F.lit(1), "high"),
        k(flow & COL("leaves"), "medium", "on:branches", F.lit("the pull_request trigger's branch filter leaves out main and master"), none, COL("trigger")),
        k(told & COL("exposed") & COL("reads").isNotNull(), "high", "secrets", F.concat(F.lit("a pull request's job reads "), COL("reads")), none),
        k(told & COL("head"), "high", "checkout", F.lit("a pull_request_target job checks out the pull request's head"), none),
        k(has_own & COL("exposed") & ~COL("guarded"), "high", "same-repo", F.concat(on, F.lit(" without the same-repo condition")), one),
        k(has_own & COL("exposed") & COL("guarded") & ~COL("gated"), "medium", "environment", F.concat(on, F.lit(" with no environment gate")), one),
        k(has_own & ~sound, "medium", "runner", F.concat(on, F.lit(" and names no hardware it needs")), one),
    )
    found = j.select("repo", "path", F.explode(F.array_compact(kinds)).alias("k"))
    read = F.coalesce("k.control", F.concat(F.lit("read "), F.concat_ws(":", "path", COL("k.line").cast("string"))))
    return finding(found, "SUP-017", COL("k.severity"), COL("k.confidence"), COL("path"), COL("k.line"), COL("k.subject"), COL("k.summary"), read=read, claim=F.when(COL("k.control").isNotNull(), "absence"))


def unpinned_actions(files: DataFrame) -> DataFrame:
    """SUP-008: actions and reusable workflows from elsewhere that no commit hash pins, images that no digest pins, and workflows and jobs
    whose token may write anything."""
    facts = workflow_facts(files)
    value = COL("value")
    uses = (LAST() == "uses") & value.isNotNull() & ~value.startswith("./") & ~value.startswith("docker://") & ~value.rlike(r"@[0-9a-fA-F]{40}$")
    job_image = (KEY(0) == "jobs") & (((KEY(2) == "container") & ((F.size("keys") == 3) | (LAST() == "image"))) | ((KEY(2) == "services") & (LAST() == "image")))
    image = value.isNotNull() & (((LAST() == "uses") & value.startswith("docker://")) | job_image) & ~value.rlike(r"@sha256:[0-9a-f]{64}$|\$\{\{")
    broad = (LAST() == "permissions") & (value == "write-all") & ((F.size("keys") == 1) | (F.size("keys") == 3))
    kind = F.when(uses, F.struct(F.lit("medium").alias("s"), value.alias("subject"), F.lit("a reference that its owner can move").alias("t"))).when(image, F.struct(F.lit("medium").alias("s"), value.alias("subject"), F.lit("an image that its owner can move").alias("t"))).when(
        broad, F.struct(F.lit("medium").alias("s"), F.concat_ws(":", F.when(F.size("keys") == 3, KEY(1)), F.lit("permissions")).alias("subject"), F.lit("the token may write everything").alias("t"))
    )
    return finding(facts.withColumn("k", kind).filter("k IS NOT NULL"), "SUP-008", COL("k.s"), "high", COL("path"), COL("line"), COL("k.subject"), COL("k.t"))


def alerts_without_runbook(files: DataFrame) -> DataFrame:
    """OPS-009: alerts of Prometheus rule files without `annotations.runbook_url`."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rules = files.filter(_outside(ALERTS_SKIPPED) & name.rlike(r"\.ya?ml$") & (name.contains(".rules.") | name.startswith("alerts") | name.startswith("alert_rules")))
    inside = yaml_facts(rules).filter((KEY(0) == "groups") & (KEY(2) == "rules") & (F.size("keys") >= 5))
    per = inside.groupBy("repo", "path", F.slice("keys", 1, 4).alias("rule")).agg(
        F.max(F.when((KEY(4) == "alert") & (F.size("keys") == 5), F.struct("value", "line"))).alias("alert"), F.coalesce(F.max((KEY(4) == "annotations") & (KEY(5) == "runbook_url") & (F.trim("value") != "")), F.lit(False)).alias("linked")
    )
    bad = per.filter("alert IS NOT NULL AND NOT linked")
    return finding(bad, "OPS-009", "info", "medium", COL("path"), COL("alert.line"), COL("alert.value"), F.concat(F.lit("no runbook_url annotation: "), COL("alert.value")), F.concat(F.lit("the annotations of every alert of "), COL("path"), F.lit(" were read")))


def flags_without_owner(files: DataFrame) -> DataFrame:
    """OPS-007: entries of flag registries (YAML and TOML) without an owner or a sunset date."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    known = files.filter(_outside(FLAGS_SKIPPED) & F.regexp_extract(name, r"^(.*)\.(ya?ml|toml)$", 1).isin(FLAG_FILES))
    facts = yaml_facts(known.filter(~name.endswith(".toml"))).unionByName(toml_facts(known.filter(name.endswith(".toml"))))
    # entries lie below a list's key where the file has one, else at the top
    body = facts.groupBy("repo", "path").agg(F.min(F.when(F.lower(KEY(0)).isin(FLAG_LISTS) & (F.size("keys") > 1), KEY(0))).alias("_body"))
    under = facts.join(body, ["repo", "path"]).filter(COL("_body").isNull() | (KEY(0) == COL("_body"))).withColumn("keys", F.when(COL("_body").isNotNull(), F.slice("keys", F.lit(2), F.size("keys"))).otherwise(COL("keys"))).filter(F.size("keys") > 0)
    word = F.replace(F.lower(KEY(1)), F.lit("-"), F.lit("_"))
    filled = F.coalesce(F.trim("value") != "", F.size("keys") > 2) & ~F.coalesce(COL("value").isin("null", "~", "[]"), F.lit(False))
    has = lambda names: F.coalesce(F.max(word.isin(names) & filled), F.lit(False))
    per = under.groupBy("repo", "path", KEY(0).alias("entry")).agg(
        F.min("line").alias("line"), has(OWNER).alias("owned"), has(SUNSET).alias("ends"), F.max(F.size("keys")).alias("deep"),
        F.min(F.when(KEY(1).isin(FLAG_NAMES) & (F.size("keys") == 2), F.struct(F.array_position(F.array(*map(F.lit, FLAG_NAMES)), KEY(1)).alias("k"), "value"))).alias("named"),
    )
    # a list's item that is no map is no entry
    bad = per.filter(~(COL("owned") & COL("ends")) & ~(COL("entry").startswith("#") & (COL("deep") == 1)))
    lacks = F.when(~COL("owned") & ~COL("ends"), "an owner and a sunset date").when(~COL("owned"), "an owner").otherwise("a sunset date")
    flag = F.coalesce("named.value", "entry")
    return finding(bad, "OPS-007", "low", "medium", COL("path"), COL("line"), F.concat_ws(":", COL("path"), flag), F.concat(F.lit("flag `"), flag, F.lit("` records no "), lacks), read=F.concat(COL("path"), F.lit(" was read for owner and sunset keys")))


def climbs_out(folder: Column, target: Column) -> Column:
    """Whether a relative path from a folder leaves the root: steps walked in order, `..` at the root is out."""
    steps = F.filter(F.concat(F.split(folder, "/"), F.split(F.replace(target, F.lit("\\"), F.lit("/")), "/")), lambda s: (s != "") & (s != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))
    walked = F.aggregate(steps, start, lambda a, s: F.when(s == "..", F.struct((a["depth"] - 1).alias("depth"), (a["out"] | (a["depth"] == 0)).alias("out"))).otherwise(F.struct((a["depth"] + 1).alias("depth"), a["out"].alias("out"))))
    return walked["out"] | target.rlike(r"^(/|[A-Za-z]:)")


def unpublished_dependencies(files: DataFrame) -> DataFrame:
    """SUP-004, Cargo manifests: dependencies on a path outside the repository (high) or on a git repository (medium), in any dependency
    table, patch and replacement."""
    manifests = files.filter(COL("path").rlike(r"(^|/)Cargo\.toml$") & _outside(MANIFESTS_SKIPPED))
    facts = toml_facts(manifests).filter(LAST().isin("path", "git") & COL("value").isNotNull() & (F.size("keys") >= 3))
    table = F.get("keys", F.size("keys") - 3)
    sound = facts.filter(table.isin(DEPENDENCIES) | KEY(0).isin("patch", "replace"))
    name = F.get("keys", F.size("keys") - 2)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    kind = F.when((LAST() == "path") & climbs_out(folder, COL("value")), "high").when(LAST() == "git", "medium")
    bad = sound.withColumn("_s", kind).filter("_s IS NOT NULL")
    return finding(bad, "SUP-004", COL("_s"), "high", COL("path"), COL("line"), name, F.concat(F.when(COL("_s") == "high", "a path that leaves the repository: ").otherwise("a git dependency: "), COL("value")))
