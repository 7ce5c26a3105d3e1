import json
import os

import duckdb
import pytest

from lodestone.llm import chat


def brute(c, r):
    show = lambda t: f"<|im_start|>{t[0]}\n{t[1]}<|im_end|>\n"
    k = 0
    while c is not None and r is not None and k < min(len(c), len(r)) and c[k] == r[k]:
        k += 1

    def side(turns):
        if turns is None:
            return None, None
        text, spans = "", []
        for t in turns[k:]:
            if t[0] == "assistant":
                a = len(text) + len("<|im_start|>assistant\n")
                spans.append((a, a + len(t[1]) + len("<|im_end|>\n")))
            text += show(t)
        return text, spans

    return k, "".join(map(show, c[:k])) if c and r else "", side(c), side(r)


def frames(spark, sides):
    schema = "pair_id long, turn long, role string, text string"
    return [spark.createDataFrame([(i, 10 * k, a, b) for i, t in s.items() for k, (a, b) in enumerate(t)], schema) for s in sides]


def test_against_brute_force(spark):
    u, a = ("user", "hi é"), ("assistant", "hello ñ日")
    chosen = {1: [u, a, ("user", "more"), ("assistant", "yes")], 2: [u, a], 3: [u, a], 4: [u], 6: [("system", "x"), u, a, a], 7: [("", "")]}
    rejected = {1: [u, a, ("user", "more"), ("assistant", "no"), u], 2: [u, a], 3: [a, u], 5: [a], 6: [("system", "x"), u], 7: [("", ""), a]}
    got = {p.pair_id: p for p in chat.format_preferences(*frames(spark, (chosen, rejected))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    for i, p in got.items():
        k, prompt, (c, cm), (r, rm) = brute(chosen.get(i), rejected.get(i))
        spans = lambda m: m and [tuple(s) for s in m]
        assert (p.n_prompt_turns, p.prompt, p.chosen, p.rejected) == (k, prompt, c, r)
        assert (spans(p.chosen_mask), spans(p.rejected_mask)) == (cm or p.chosen_mask and [], rm or p.rejected_mask and []) or (list(p.chosen_mask or []), list(p.rejected_mask or [])) == (cm or [], rm or [])


def test_nulls_ties_and_extra_columns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "b"), (1, 1, None, "x"), (None, 0, "user", "lost"), (1, None, "user", "lost")]
    df = spark.createDataFrame(rows, "pair_id long, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS k")
    (p,) = chat.format_preferences(df, df).collect()
    assert p.n_prompt_turns == 2 and p.chosen == p.rejected == "" and "lost" not in p.prompt and p.prompt.count("<|im_start|>") == 2
    assert chat.format_preferences(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    rel = c.execute(chat.ORACLE_SQL)
    cols = [x[0] for x in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    got = chat.query(spark, d).select(*cols).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert any(r.n_prompt_turns and r.chosen != r.rejected for r in got)
    for r in got[:20]:
        for s in json.loads(r.chosen_mask or "[]"):
            assert r.chosen[s["start"] : s["stop"]].endswith("<|im_end|>\n")
