"""Messages of module runs, reconciled rule by rule: what a module says it found against what arrived.

A run (column run) sends findings and one result per rule, each message with a number (seq) of its own, then an end: kind is finding,
result or end; a result has status (ran, skipped, error), declared (its number of findings) and code (why a rule was
skipped, or what failed). A run ends with its end message, after IDLE without one, or when it passes a limit; then each rule that
any of its messages names gets one row (run, rule, findings, status, detail).

Cases: repeated messages (same run and seq) count once; messages after a run's end are dropped until its state goes; a rule with
findings and no result, or another number than declared, is a mismatch; a run without an end, or past a limit, is an error in every
rule; rows without run, seq or time are dropped; an empty stream gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "run string, seq long, rule string, kind string, status string, declared long, code string, bytes long, seen_at timestamp"
OUTCOME = "run string, rule string, findings long, status string, detail string"
#: Findings and bytes of a run, and seconds of silence; reasons for which a rule may be skipped.
MAX_FINDINGS, MAX_BYTES, IDLE_SECONDS = 5_000, 16 * 1024 * 1024, 120
SKIPS = ["not_applicable_here"]


def judged(findings: Column, declared: Column, status: Column, code: Column) -> Column:
    """struct(status, detail) of a rule from the findings that arrived and its result (null without one)."""
    said = lambda s, d: F.struct(F.lit(s).alias("status"), d.cast("string").alias("detail"))
    text = lambda t: F.lit(t)
    return (
        F.when(status.isNull(), said("mismatch", text("no result arrived")))
        .when(~F.coalesce(declared == findings, F.lit(False)), said("mismatch", F.concat(F.lit("the result says "), F.coalesce(declared.cast("string"), F.lit("nothing")), F.lit(", arrived "), findings.cast("string"))))
        .when((status == "skipped") & ~F.coalesce(code.isin(SKIPS), F.lit(False)), said("mismatch", text("a skip without its reason")))
        .when((status == "skipped") & (findings > 0), said("mismatch", text("a skipped rule sent findings")))
        .when(status == "error", said("error", F.coalesce(code, F.lit("internal"))))
        .when(status.isin("ran", "skipped"), said_as(status, code))
        .otherwise(said("mismatch", text("an unknown status")))
    )


def said_as(status: Column, code: Column) -> Column:
    return F.struct(status.alias("status"), F.when(status == "skipped", code).alias("detail"))


def reconcile(messages: DataFrame) -> DataFrame:
    """Outcomes of whole runs from a table of messages: repeats fold away, then one aggregation per rule and one per run."""
    m = messages.filter("run IS NOT NULL AND seq IS NOT NULL").dropDuplicates(["run", "seq"])
    runs = m.groupBy("run").agg(F.count_if(F.col("kind") == "finding").alias("_f"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("_b"), F.coalesce(F.max(F.col("kind") == "end"), F.lit(False)).alias("_end"))
    result = F.min(F.when(F.col("kind") == "result", F.struct("seq", "status", "declared", "code"))).alias("_r")
    rules = m.filter("rule IS NOT NULL AND kind IN ('finding', 'result')").groupBy("run", "rule").agg(F.count_if(F.col("kind") == "finding").alias("findings"), result)
    broken = F.when(F.col("_f") > MAX_FINDINGS, "too many findings").when(F.col("_b") > MAX_BYTES, "too much output").when(~F.col("_end"), "no end arrived")
    ok = judged(F.col("findings"), F.col("_r.declared"), F.col("_r.status"), F.col("_r.code"))
    j = rules.join(runs.select("run", broken.alias("_broken")), "run").withColumn("_o", ok)
    return j.select("run", "rule", "findings", F.when(F.col("_broken").isNotNull(), "error").otherwise(F.col("_o.status")).alias("status"), F.coalesce("_broken", "_o.detail").alias("detail"))


def _told(run: str, kept: dict, broken: str | None) -> list[dict]:
    return [{"run": run, "rule": rule, "findings": r["n"], "declared": r.get("declared"), "said": r.get("status"), "code": r.get("code"), "broken": broken} for rule, r in sorted(kept["rules"].items())]


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a run: numbers seen, findings and result per rule, bytes, its newest time, and whether it is over. What it holds is bounded by
    the limits: a run past one of them is over."""
    run, out = key[0], []
    kept = json.loads(state.get[0]) if state.exists else {"seen": [], "rules": {}, "found": 0, "bytes": 0, "newest": 0, "over": False}
    if state.hasTimedOut:
        if not kept["over"]:
            out = _told(run, kept, "no end arrived")
        state.remove()
    else:
        seen = set(kept["seen"])
        for batch in batches:
            for m in batch.sort_values("seq").astype(object).where(batch.sort_values("seq").notna(), None).to_dict("records"):
                kept["newest"] = max(kept["newest"], int(m["seen_at"].timestamp() * 1000))
                if kept["over"] or m["seq"] in seen:
                    continue
                seen.add(int(m["seq"]))
                kept["bytes"] += int(m["bytes"] or 0)
                if m["rule"] is not None and m["kind"] in ("finding", "result"):
                    r = kept["rules"].setdefault(m["rule"], {"n": 0})
                    if m["kind"] == "finding":
                        r["n"] += 1
                        kept["found"] += 1
                    elif "status" not in r:
                        r |= {"status": m["status"], "declared": None if m["declared"] is None else int(m["declared"]), "code": m["code"]}
                broken = "too many findings" if kept["found"] > MAX_FINDINGS else "too much output" if kept["bytes"] > MAX_BYTES else None
                if broken or m["kind"] == "end":
                    out += _told(run, kept, broken)
                    kept |= {"over": True, "rules": {}}
                    seen = set()
        kept["seen"] = sorted(seen)
        state.update((json.dumps(kept),))
        state.setTimeoutTimestamp(max(kept["newest"] + IDLE_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["run", "rule", "findings", "declared", "said", "code", "broken"]).astype({"declared": "Int64", "findings": "Int64"})


def reconciled(feed: DataFrame, lateness: str = "30 seconds") -> DataFrame:
    """The stream of outcomes from a stream of messages. State is one run's, and goes after IDLE_SECONDS without a message of it."""
    m = feed.filter("run IS NOT NULL AND seq IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", lateness)
    columns = "run string, rule string, findings long, declared long, said string, code string, broken string"
    told = m.groupBy("run").applyInPandasWithState(_fold, columns, "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    ok = judged(F.col("findings"), F.col("declared"), F.col("said"), F.col("code"))
    j = told.withColumn("_o", ok)
    return j.select("run", "rule", "findings", F.when(F.col("broken").isNotNull(), "error").otherwise(F.col("_o.status")).alias("status"), F.coalesce("broken", "_o.detail").alias("detail"))
