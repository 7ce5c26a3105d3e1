"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

Each side's turns are gathered per pair into one array in the order of their places; what a task holds is one conversation of
either side. A fold over both arrays counts the leading turns whose role and text are equal: the longest common turn prefix.
It is rendered once as the prompt, the rest of either side as its completion. Completions carry masks: spans of characters that
count for training, the text of assistant turns with their end mark. Texts are rendered as they are: one that itself spells a
mark of the format isn't escaped, since the masks say where turns begin and end.

Cases: turns with a null conversation or place are no turns; null roles and texts are rendered empty, and two nulls are
equal; of turns that repeat a place, the smallest (role, text) counts; identical conversations give a whole prompt and empty
completions; a pair with one side missing has an empty prompt and that completion null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _turns(df: DataFrame, side: str) -> DataFrame:
    """One row per (pair_id, place): place counts the turns of a conversation from 0."""
    one = df.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).groupBy("pair_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    # the conversation is gathered once, in order; places follow from the array
    whole = one.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t.role", "t.text"))).alias(side))
    return whole.select("pair_id", side)


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Spans [start, stop) in the rendered text that are trained on."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + len(OPEN) + F.length(t["role"]) + 1
        stop = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct(stop.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both frames: pair_id, turn, role, text. One row per pair_id: n_prompt_turns, prompt, chosen, rejected and the masks
    chosen_mask and rejected_mask (array of start and stop)."""
    pairs = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id", "full")
    # turns count by role and text alone: the number that a side gives its turn may differ
    same = F.expr("aggregate(zip_with(c, r, (x, y) -> coalesce(x.role = y.role AND x.text = y.text, false)), struct(0 AS n, true AS open), (a, s) -> struct(a.n + int(a.open AND s) AS n, a.open AND s AS open), a -> a.n)")
    known = pairs.withColumn("k", F.coalesce(same, F.lit(0)))
    rest = lambda side: F.expr(f"if({side} IS NULL, NULL, slice({side}, k + 1, size({side})))")
    cut = known.select("pair_id", "k", F.expr("if(c IS NULL OR r IS NULL, array(), slice(c, 1, k))").alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id",
        F.col("k").cast("long").alias("n_prompt_turns"),
        F.coalesce(_rendered(F.col("p")), F.lit("")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next): each different id with the next larger one (null for the largest). Ids are dealt by ranges; each range
    takes the smallest id of the ranges after it, which are as many as there are shuffle partitions."""
    ranged = ids.distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    heads = ranged.groupBy("_part").agg(F.min("id").alias("_head"))
    after = heads.select("_part", F.min("_head").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = F.lead("id").over(Window.partitionBy("_part").orderBy("id"))
    return ranged.withColumn("_in", inside).join(F.broadcast(after), "_part").select("id", F.coalesce("_in", "_after").alias("next"))


def branched(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides for a table of plain conversations: a conversation is chosen; its rejected side has
    the last assistant turn replaced by the last assistant turn of the conversation that has one with the next larger id (of the
    last id, by none) and ends there. Conversations without an assistant turn are pairs of equals."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    turns = turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    last = turns.filter(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max("turn").alias("at"), F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    ends = last.select(F.col("pair_id").alias("l_id"), "at")
    follows = next_ids(last.select(F.col("pair_id").alias("id")))
    theirs = last.select(F.col("pair_id").alias("t_id"), F.col("m.text").alias("other"))
    other = follows.join(theirs, F.col("next") == F.col("t_id")).select(F.col("id").alias("o_id"), "other")
    kept = turns.join(ends, F.col("pair_id") == F.col("l_id"), "left").filter(F.col("at").isNull() | (F.col("turn") < F.col("at")))
    swapped = ends.join(other, F.col("l_id") == F.col("o_id")).select(F.col("l_id").alias("pair_id"), F.col("at").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.col("other").alias("text"))
    return turns, kept.select(*turns.columns).unionByName(swapped)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return format_preferences(*branched(table(spark, sf_dir, "conversations"))).withColumn("chosen_mask", F.to_json("chosen_mask")).withColumn("rejected_mask", F.to_json("rejected_mask"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT pair_id, max(turn) AS at_turn, arg_max(text, (turn, text)) AS last_text FROM t WHERE role = 'assistant' GROUP BY 1),
rj AS (SELECT t.* FROM t LEFT JOIN l USING (pair_id) WHERE at_turn IS NULL OR turn < at_turn
  UNION ALL SELECT l.pair_id, l.at_turn, 'assistant', o.last_text FROM (SELECT *, lead(pair_id) OVER (ORDER BY pair_id) AS next_id FROM l) l JOIN l o ON o.pair_id = l.next_id),
c1 AS (SELECT pair_id, turn, m.role AS role, m.text AS text FROM (SELECT pair_id, turn, min({'role': role, 'text': text}) AS m FROM t GROUP BY ALL)),
r1 AS (SELECT pair_id, turn, m.role AS role, m.text AS text FROM (SELECT pair_id, turn, min({'role': role, 'text': text}) AS m FROM rj GROUP BY ALL)),
c AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn) AS k FROM c1),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn) AS k FROM r1),
d AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(CASE WHEN c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text THEN 1000000000 ELSE coalesce(c.k, r.k) END) AS k0
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.k = r.k GROUP BY 1),
n AS (SELECT pair_id, CASE WHEN k0 = 1000000000 THEN (SELECT count(*) FROM c WHERE c.pair_id = d.pair_id) + 1 ELSE k0 END AS k0, EXISTS (SELECT 1 FROM r WHERE r.pair_id = d.pair_id) AS has_r FROM d),
s AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole, 'c' AS side FROM c
  UNION ALL SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), 'r' FROM r),
e AS (SELECT s.*, k0, sum(length(whole)) OVER (PARTITION BY s.pair_id, side ORDER BY k) - sum(CASE WHEN k < k0 THEN length(whole) ELSE 0 END) OVER (PARTITION BY s.pair_id, side) AS stop FROM s JOIN n ON s.pair_id = n.pair_id),
x AS (SELECT pair_id, side, string_agg(whole, '' ORDER BY k) FILTER (WHERE k < k0) AS prompt, coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE k >= k0), '') AS rest,
  coalesce('[' || string_agg('{"start":' || (stop - length(text) - 11)::BIGINT || ',"stop":' || stop::BIGINT || '}', ',' ORDER BY k) FILTER (WHERE k >= k0 AND role = 'assistant') || ']', '[]') AS mask FROM e GROUP BY 1, 2)
SELECT n.pair_id, (k0 - 1)::BIGINT AS n_prompt_turns, CASE WHEN has_r THEN coalesce(a.prompt, '') ELSE '' END AS prompt, a.rest AS chosen, b.rest AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM n LEFT JOIN x a ON a.pair_id = n.pair_id AND a.side = 'c' LEFT JOIN x b ON b.pair_id = n.pair_id AND b.side = 'r'
"""
