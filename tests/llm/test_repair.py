import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from lodestone.llm import repair

WS = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit at every place, shortest suffixes first."""
    kinds, step = faults(rows), {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", ()), 3: (0, "", ())}
    for t in range(len(rows), -1, -1):
        here = dict(best) if t == len(rows) else {}
        if t < len(rows):
            role, text = rows[t]
            extra = 3 * (kinds[t] == "truncated")
            for q in range(4):
                ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])] if q in best else []
                if kinds[t] not in ("blank", "duplicate"):
                    r = step.get(role[:1], {}).get(q)
                    if r in best:
                        ways.append((best[r][0] + extra, "K" + best[r][1], ((role, text), *best[r][2])))
                    new = "assistant" if q == 2 else "user"
                    r = step[new[0]][q]
                    if r in best:
                        ways.append((best[r][0] + 3 + extra, "R" + best[r][1], ((new, text), *best[r][2])))
                if ways:
                    here[q] = min(ways, key=lambda w: w[:2])
        for _ in range(4):
            for q in range(4):
                new = "assistant" if q == 2 else "user"
                r = step[new[0]][q]
                if r in here:
                    way = (here[r][0] + 3, "I" + here[r][1], ((new, ""), *here[r][2]))
                    here[q] = min(here.get(q, way), way, key=lambda w: w[:2])
        best = here
    return best[0]


def plain(conv_id, rows):
    """Result row of a conversation from its rows (turn, role, text) in order."""
    kinds, turns = faults([r[1:] for r in rows]), [r[0] for r in rows if r[0] is not None]
    cost, audit, fixed = cheapest([r[1:] for r in rows])
    assert GOOD.fullmatch("".join(r[:1] for r, _ in fixed))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return (conv_id, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha)


def random_rows(r, n):
    texts = ["a.", "b!", "c", " \t", "", "d?", "e.", "f,", "g\xa0", "h.\n"]
    return [(t, r.choice(["user", "assistant", "system", "tool", " ", "user", "assistant"]), r.choice(texts) if r.random() < 0.7 else f"{r.random()}.") for t in range(n)]


def test_layers_against_trying_all():
    r = random.Random(4)
    for _ in range(1500):
        rows = random_rows(r, r.randint(0, 14))
        codes = bytes(repair._code(role, text) | (repair.DROP if kind == "duplicate" else 0) for (_, role, text), kind in zip(rows, faults([x[1:] for x in rows])))
        layers = repair.Layers(codes, repair.END, True)
        cost, audit, fixed = cheapest([x[1:] for x in rows])
        assert layers.costs()[repair.START] == cost and layers.trace(repair.START)[0] == audit, rows
        turns = repair.edited([{"role": a, "text": b} for _, a, b in rows], audit, repair.START)
        assert [(t["role"], t["text"]) for t in turns] == list(fixed)


def test_parts_compose():
    r = random.Random(8)
    for _ in range(400):
        codes = bytes(r.choice([0, 1, 2, 3, 5, 6, 7, 8, 2, 3]) for _ in range(r.randint(0, 40)))
        whole = repair.Layers(codes, repair.END, True)
        cuts = sorted(r.randint(0, len(codes)) for _ in range(r.randint(0, 4)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        cost, ends = repair._composed([repair.between(p) for p in parts])
        traces = [repair._traces(p, e, k == len(parts) - 1) for k, (p, e) in enumerate(zip(parts, ends))]
        entries = repair._entries([[s for _, s in t] for t in traces])
        assert cost == whole.costs()[repair.START]
        assert "".join(t[q][0] for t, q in zip(traces, entries)) == whole.trace(repair.START)[0]


def expected(rows):
    """Plain twin of the query over (conv_id, turn, role, text)."""
    said, by = lambda x: " " if x is None else str(x), defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text, h = said(role), said(text), crc32(f"{said(conv_id)}:{said(turn)}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv_id] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return sorted((plain(c, sorted(x, key=lambda row: (row[0] is not None, row[0] or 0))) for c, x in by.items()), key=str)


def store(spark, tmp_path, rows):
    r = random.Random(1)
    spark.createDataFrame(r.sample(rows, len(rows)), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))


@pytest.mark.parametrize("partitions", ["4", "9"])
def test_query_with_conversations_over_many_ranges(spark, tmp_path, partitions):
    r, rows = random.Random(6), []
    for c, n in enumerate([3, 0, 900, 1, 7, 350, *[5] * 150]):
        rows += [(c, t * r.choice([1, 1, 1, 1]) + (t > 3), role, text) for t, role, text in random_rows(r, n)]
    rows += [(None, t, "user", "x.") for t in range(3)] + [(500, None, None, None), (500, 2, "assistant", "y")]
    store(spark, tmp_path, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(x) for x in repair.query(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == expected(rows)


def test_given_tables(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    want = expected([(x["conv_id"], x["turn"], x["role"], x["text"]) for x in t])
    assert sorted((tuple(x) for x in repair.query(spark, sf).collect()), key=str) == want


def test_empty_ties_and_other_columns(spark):
    rows = spark.createDataFrame([("c", 1, "user", "a.", 1), ("c", 1, "user", "a.", 2), ("c", 1, "assistant", "b.", 3)], "conv_id string, turn int, role string, text string, part int")
    conversations, parts = repair.repair(rows)
    assert [tuple(x) for x in conversations.collect()] == [("c", 0, 0, 1, 0, 1, 10, "IKKDI")]
    assert parts.columns == ["conv_id", "part", "edits", "turns"]
    conversations, parts = repair.repair(rows.limit(0))
    assert conversations.count() == 0 and repair.digests(parts).count() == 0
    gone = spark.createDataFrame([("d", 1, "user", "a.", False)], "conv_id string, turn int, role string, text string, alive boolean")
    conversations, parts = repair.repair(gone)
    assert tuple(conversations.first()) == ("d", 0, 0, 0, 0, 0, 0, "") and repair.digests(parts).first().repaired_sha256 == hashlib.sha256(b"").hexdigest()
