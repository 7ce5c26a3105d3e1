import hashlib
import os

import duckdb
import pytest

from lodestone.llm import warc as w

BIG, UTF = "x\r\n\r\nWARC/1.1\r\n" * 20, "é" * 60


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", BIG if i % 3 == 0 else f"<p>{i}</p>" * 30) for i in range(30)]
    rows += [(100, "u", None), (101, "u", ""), (102, None, "tiny"), (103, "a\r\nb", "tiny"), (104, "u", UTF), (105, "u", UTF), (4, "http://h/4", "<p>4</p>" * 30), (None, "n", BIG), (200, "long", "y" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "1 AS n")
    path = str(tmp_path / "a")
    w.write_archive(pages, path)
    got = sorted(map(repr, map(tuple, w.read_archive(spark, path).collect())))
    first, want, seen = {}, [], set()
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and (i != first[h] or (i, h) in seen)
        seen.add((i, h))
        want.append(repr((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)))
    assert got == sorted(want)
    back = w.reconstruct(spark, path).collect()
    assert len(back) == len(rows)
    by = {r.page_id: bytes(r.record) for r in back}
    for i, u, h in rows:
        (f, head, body), = w.parse_records(by[i])
        assert body == (h or "").encode() and f["WARC-Type"] == "response" and ("WARC-Target-URI" in f) == (u is not None)


def test_damage_is_found():
    with pytest.raises(ValueError):
        list(w.parse_records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))


def test_empty(spark, tmp_path):
    w.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert w.read_archive(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    rel = c.execute(w.ORACLE_SQL)
    cols = [x[0] for x in rel.description]
    assert sorted(repr(tuple(r)) for r in w.query(spark, d).select(*cols).collect()) == sorted(map(repr, rel.fetchall()))
