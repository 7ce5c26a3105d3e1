import datetime
import json
import os

from lodestone.streaming import findings as st
from lodestone.streaming import protocol as p

T = datetime.datetime(2026, 1, 1)


def m(run, seq, kind, rule=None, status=None, declared=None, code=None, size=10, at=0):
    return {"run": run, "seq": seq, "rule": rule, "kind": kind, "status": status, "declared": declared, "code": code, "bytes": size, "seen_at": (T + datetime.timedelta(seconds=at)).isoformat()}


BATCHES = [
    [m("a", 1, "finding", "R1"), m("a", 1, "finding", "R1"), m("a", 2, "finding", "R1", at=1), m("b", 1, "finding", "R1"), m("c", 1, "result", "R1", "skipped", 0, "because"), m(None, 1, "end")],
    [m("a", 3, "result", "R1", "ran", 2, at=5), m("a", 2, "finding", "R1", at=5), m("a", 4, "result", "R2", "skipped", 0, "not_applicable_here", at=6), m("a", 5, "finding", "R3", at=6), m("a", 6, "result", "R4", "error", 0, "timeout", at=6), m("a", 7, "result", "R5", "ran", 3, at=6)],
    [m("a", 8, "end", at=7), m("c", 2, "end", at=8), m("d", 1, "finding", "R1", size=p.MAX_BYTES + 1, at=9), m("d", 2, "end", at=9)],
    [m("a", 9, "finding", "R9", at=10), m("z", 1, "result", "R1", "ran", 0, at=2_000)],
    [m("z", 2, "end", at=2_001)],
]
WANT = [
    ("a", "R1", 2, "ran", None), ("a", "R2", 0, "skipped", "not_applicable_here"), ("a", "R3", 1, "mismatch", "no result arrived"), ("a", "R4", 0, "error", "timeout"), ("a", "R5", 0, "mismatch", "the result says 3, arrived 0"),
    ("b", "R1", 1, "error", "no end arrived"), ("c", "R1", 0, "mismatch", "a skip without its reason"), ("d", "R1", 1, "error", "too much output"), ("z", "R1", 0, "ran", None),
]


def write(folder, batches):
    folder.mkdir()
    for i, batch in enumerate(batches):
        (folder / f"{i}.json").write_text("".join(json.dumps(x) + "\n" for x in batch))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order


def run_stream(spark, make, schema, folder, tmp_path):
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    out = str(tmp_path / "out")
    q = make(feed).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.schema(make(spark.read.schema(schema).json(str(folder))).schema if schema != p.MESSAGE else p.OUTCOME).parquet(out)


def test_tables_and_streams_agree(spark, tmp_path):
    write(tmp_path / "in", BATCHES)
    # a table has no time: what comes after the end counts there, so it is left out
    table = spark.read.schema(p.MESSAGE).json(str(tmp_path / "in")).filter("NOT (run = 'a' AND seq = 9)")
    assert sorted(map(tuple, p.reconcile(table).collect())) == WANT
    assert p.reconcile(table.limit(0)).count() == 0
    assert sorted(map(tuple, run_stream(spark, p.reconciled, p.MESSAGE, tmp_path / "in", tmp_path).collect())) == WANT


def test_counts_of_windows_with_late_rows(spark, tmp_path):
    at = lambda t, check="A-1": {"check_id": check, "severity": "low", "seen_at": t}
    write(tmp_path / "in", [
        [at("2024-01-01T00:10:00"), at("2024-01-01T00:50:00"), at("2024-01-01T01:00:00"), at("2024-01-01T00:10:00", "B-2")], [at("2024-01-01T00:59:59"), at("2024-01-01T05:00:00")],
        [at("2024-01-01T09:00:00")], [at("2024-01-01T00:20:00"), at("2024-01-01T09:30:00")],
    ])
    got = run_stream(spark, lambda f: st.counts_per_window(f, lateness="30 minutes"), st.SCHEMA, tmp_path / "in", tmp_path)
    # the row of 00:20 comes when its window is closed, and the last window isn't closed yet
    assert sorted((r.start.hour, r.check_id, r.n) for r in got.collect()) == [(0, "A-1", 3), (0, "B-2", 1), (1, "A-1", 1), (5, "A-1", 1)]
