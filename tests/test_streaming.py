import json

from lodestone.streaming import findings as st


def test_feed(spark, tmp_path):
    row = {"check_id": "A-1", "file": "a.rs", "severity": "low"}
    rows = [row | {"subject": "x", "seen_at": "2024-01-01T00:00:00"}, row | {"subject": "x", "seen_at": "2024-01-01T00:10:00"}, row | {"subject": "", "seen_at": "2024-01-01T00:20:00"}, row | {"seen_at": "2024-01-01T00:30:00"}, row | {"subject": "lost"}]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(r) + "\n")
    out, mark = str(tmp_path / "once"), str(tmp_path / "once-c")
    q = st.deduplicated(st.read_feed(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema("fingerprint string").parquet(out)
    assert got.select("fingerprint").distinct().count() == 3 == got.count()
