"""Repair of conversation structure at least cost, by cost layers of bitsets.

The role initials of a sound conversation read `(s?(ua)+)?`, a grammar of four states. Going back from the end, each turn has a layer per
cost: the set of states from which the rest can be repaired at that cost or less, four bits of one integer, so that an
edit of cost c is a shift by c layers and all layers move at once. No state costs over TOP - 1 more than the cheapest, so a
few layers above the cheapest cost tell all. The first layer that holds the start state gives the cost; following the bits
forward and taking the first letter that stays within the layers gives the ASCII-least audit.

Turns are sorted by a range partitioning, and each task reads its range as a stream. Conversations that lie wholly in a range are
done there; only the first and the last of a range may go on in another. Those are cut into the parts that the ranges hold: a part
gives its costs from every state to every state, the parts' costs are composed backward, each part then traces its edits from
every entry state, and the states are composed forward. So a conversation of any length is repaired in parallel, and no task
holds more of it than its range. (Its digest in the query reads the parts as one stream, as a digest must.)

Cases: null roles and texts are one space; turns that share a number stand by role, then by a hash of the text, and null numbers first; repeated
rows are duplicates; a role that is empty or of another initial can't be kept as it is; a null id is a conversation of its
own; an id all of whose rows aren't `alive` has an empty conversation; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, stored

WHITE_SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of edits, and what an undeleted truncated turn adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of an initial; an initial that isn't there for a state is out of order.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: Layers that may differ, and layers kept above them for shifts.
TOP, ROOM = 11, 8
LAYERS = TOP + ROOM
ONES = (1 << 4 * LAYERS) - 1
ABOVE = ONES ^ ((1 << 4 * TOP) - 1)
EVERY = ONES // 15  # the lowest bit of each layer
#: Bits of a turn's code: its initial (0 where none is known), truncated, to be deleted.
INITIALS = "?sua"
CUT_OFF, DROP = 4, 8
#: Output rows of the scan are handed on when they hold so many characters or conversations.
FLUSH_CHARS, FLUSH_ROWS = 1 << 22, 2_000


def _before(initial: str, word: int) -> int:
    """States from which a turn of that initial leads to those of a word, layer by layer."""
    out = 0
    for q, r in NEXT[initial].items():
        out |= ((word >> r) & EVERY) << q
    return out


def _closed(word: int) -> int:
    """With turns inserted before."""
    while True:
        more = word | (((_before("u", word) | _before("a", word)) << 4 * INSERT) & ONES)
        if more == word:
            return word
        word = more


@lru_cache(maxsize=1 << 14)
def _step(word: int, code: int) -> tuple[int, int]:
    """(word before a turn, how much dearer its cheapest state is) from the word after it."""
    out = word << 4 * DELETE
    if not code & DROP:
        k = TRUNCATED if code & CUT_OFF else 0
        if code & 3:
            out |= _before(INITIALS[code & 3], word) << 4 * k
        out |= (_before("u", word) | _before("a", word)) << 4 * (k + REROLE)
    out, base = _closed(out & ONES), 0
    while not out & 15:
        out, base = out >> 4, base + 1
    return (out | ABOVE) & ONES, base


def _word(costs: list[int | None]) -> tuple[int, int]:
    """(word, cheapest) of costs by state; None is out of reach."""
    base = min(c for c in costs if c is not None)
    word = 0
    for q, c in enumerate(costs):
        if c is not None:
            for layer in range(min(c - base, LAYERS), LAYERS):
                word |= 1 << (4 * layer + q)
    return _closed(word), base


def _costs(word: int, base: int) -> list[int]:
    return [base + next(k for k in range(LAYERS) if word >> (4 * k + q) & 1) for q in range(4)]


#: Costs at the end of a conversation: it may end before any turn and after an assistant's.
END = [0, None, None, 0]


class Layers:
    """The words of a stretch of turns (codes), from costs by state behind it."""

    def __init__(self, codes: bytes, end: list[int | None], last: bool):
        word, base = _word(end)
        self.codes, self.last = codes, last
        self.words, self.bases = [word], [base]
        for code in reversed(codes):
            word, more = _step(word, code)
            base += more
            self.words.append(word)
            self.bases.append(base)
        self.words.reverse()
        self.bases.reverse()

    def costs(self) -> list[int]:
        """From each state before the stretch."""
        return _costs(self.words[0], self.bases[0])

    def within(self, t: int, state: int, cost: int) -> bool:
        layer = cost - self.bases[t]
        return layer >= 0 and bool(self.words[t] >> (4 * min(layer, LAYERS - 1) + state) & 1)

    def trace(self, state: int) -> tuple[str, int]:
        """(least edits, state behind) from a state before the stretch. Inserts before the next stretch are its own."""
        t, n, left, edits = 0, len(self.codes), self.costs()[state], []
        while t < n or (self.last and left):
            code = self.codes[t] if t < n else DROP
            after = NEXT["a" if state == USER else "u"][state]
            kept = NEXT[INITIALS[code & 3]].get(state) if code & 3 and not code & DROP else None
            k = TRUNCATED if code & CUT_OFF else 0
            if t < n and self.within(t + 1, state, left - DELETE):
                edit, state, left, t = "D", state, left - DELETE, t + 1
            elif self.within(t, after, left - INSERT):
                edit, state, left = "I", after, left - INSERT
            elif kept is not None and self.within(t + 1, kept, left - k):
                edit, state, left, t = "K", kept, left - k, t + 1
            else:
                edit, state, left, t = "R", after, left - REROLE - k, t + 1
            edits.append(edit)
        return "".join(edits), state


def between(codes: bytes) -> list[list[int | None]]:
    """Costs of a stretch from each state to each state; None where there is no way. Start and system states are only
    left, never entered again, so their columns are plain sums."""
    n, none = len(codes), [None] * 4
    to_user, to_assistant = (Layers(codes, [0 if q == end else None for q in range(4)], False).costs() for end in (USER, ASSISTANT))
    kept = [TRUNCATED if c & CUT_OFF else 0 for c in codes if INITIALS[c & 3] == "s" and not c & DROP]
    out = [list(none) for _ in range(4)]
    for q in range(4):
        out[q][USER], out[q][ASSISTANT] = to_user[q], to_assistant[q]
    out[START][START] = out[SYSTEM][SYSTEM] = DELETE * n
    out[START][SYSTEM] = DELETE * (n - 1) + min(kept) if kept else None
    return out


def edited(turns: list[dict], edits: str, state: int) -> list[dict]:
    """The turns after the edits from a state on."""
    out, t = [], 0
    for edit in edits:
        if edit == "D":
            t += 1
            continue
        turn = turns[t] if edit in "KR" else {"role": None, "text": ""}
        t += edit in "KR"
        if edit == "K":
            state = NEXT[turn["role"][:1]][state]
        else:
            role = "assistant" if state == USER else "user"
            turn, state = {"role": role, "text": turn["text"]}, NEXT[role[0]][state]
        out.append(turn)
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SCAN = [(c, pa.int64()) for c in COUNTS] + [("edits", pa.string()), ("turns", _TURNS), ("part", pa.int64()), ("codes", pa.binary()), ("keys", pa.list_(pa.binary())), ("initials", pa.string()), ("span", pa.list_(pa.int64()))]
_SCAN_SQL = ", ".join(f"{c} long" for c in COUNTS) + ", edits string, turns array<struct<role:string,text:string>>, part long, codes binary, keys array<binary>, initials string, span array<long>"


def _code(role: str, text: str) -> int:
    """A turn's code but for duplicates; blank turns have DROP."""
    body = text.rstrip(WHITE_SPACE)
    if not body:
        return DROP
    return max(0, INITIALS.find(role[:1] or "?")) | (0 if body[-1] in ENDS else CUT_OFF)


def _span(numbers: list[int | None]) -> list[int]:
    """Least, greatest and number of different turn numbers, in ascending order; empty where all are null."""
    known = [x for x in numbers if x is not None]
    return [known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:]))] if known else []


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _scan(id_type: pa.DataType):
    """Over the sorted rows (conv_id, turn, role, text, alive) of a range: conversations that are whole in it, repaired, and its first
    and last one as parts."""

    def finished(conv_id, rows) -> dict:
        codes, seen = bytearray(), set()
        for _, role, text in rows:
            code = _code(role, text)
            if not code & DROP and (role, text) in seen:
                code |= DROP | 1 << 4  # a duplicate
            seen.add((role, text))
            codes.append(code)
        layers = Layers(bytes(c & 15 for c in codes), END, True)
        edits, _ = layers.trace(START)
        span = _span([r[0] for r in rows])
        return {
            "conv_id": conv_id, "gaps": span[1] - span[0] + 1 - span[2] if span else 0, "blank": sum(c == DROP for c in codes), "duplicate": sum(c >> 4 for c in codes),
            "truncated": sum(bool(c & CUT_OFF and not c & DROP) for c in codes), "illegal": _illegal([r[1][:1] for r in rows]), "cost": layers.costs()[START], "edits": edits,
            "turns": edited([{"role": r[1], "text": r[2]} for r in rows], edits, START),
        }

    def part(conv_id, rows, number) -> dict:
        seen, keys, codes = set(), [], bytearray()
        for _, role, text in rows:
            key, code = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest(), _code(role, text)
            keys.append(None if code & DROP or key in seen else key)
            codes.append(code | (1 << 4 if not code & DROP and key in seen else 0))
            seen.add(key)
        return {
            "conv_id": conv_id, "part": number, "codes": bytes(codes), "keys": keys, "initials": "".join(r[1][:1] or "?" for r in rows), "span": _span([r[0] for r in rows]),
            "turns": [{"role": r[1], "text": r[2]} for r in rows],
        }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", id_type), *_SCAN])
        range_no, first, current, rows, out, chars = TaskContext.get().partitionId(), True, None, [], [], 0
        begun = False
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for conv_id, turn, role, text, alive in zip(*columns):
                if begun and conv_id != current:
                    out.append(part(current, rows, 2 * range_no + 1) if first else finished(current, rows))
                    first, rows = False, []
                    if len(out) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, chars = [], 0
                begun, current = True, conv_id
                if alive:
                    rows.append((turn, role, text))
                    chars += len(text)
        if begun:
            out.append(part(current, rows, 2 * range_no + 1 + (not first)))
            yield pa.RecordBatch.from_pylist(out, schema)

    return scan


def _traces(codes, end, last):
    layers = Layers(bytes(codes), end, last)
    return [layers.trace(q) for q in range(4)]


def _composed(costs):
    """Costs behind each part, from the last to the first."""
    behind, ends = _costs(*_word(END)), []
    for matrix in reversed(costs):
        ends.append(behind)
        behind = [min(m + b for m, b in zip(row, behind) if m is not None) for row in matrix]
    return behind[START], ends[::-1]


def _entries(states):
    """State before each part."""
    out = [START]
    for by_entry in states:
        out.append(by_entry[out[-1]])
    return out[:-1]


def _edited(turns, edits, state):
    return edited([{"role": t["role"], "text": t["text"]} for t in turns], edits, state)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, parts) of rows (conv_id, turn, role, text and, if there, alive: a row that isn't only names its conversation).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (the edits' letters). parts: conv_id, part,
    edits, and turns, the repaired conversation's; most conversations are one part, and the parts of one follow each other."""
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    sound = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), alive.alias("alive"))
    # equal rows may be spread over ranges as well: the last key tells them apart
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "_at"]
    ranged = sound.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    id_field = sound.schema["conv_id"]
    scanned = stored(ranged.select("conv_id", "turn", "role", "text", "alive").mapInArrow(_scan(to_arrow_type(id_field.dataType)), f"conv_id {id_field.dataType.simpleString()}, {_SCAN_SQL}"), "scanned")
    whole = scanned.filter("part IS NULL")

    # a turn is a duplicate in a later part where an earlier part has it: the local firsts of a text meet, one per part at most
    parts = scanned.filter("part IS NOT NULL")
    firsts = parts.select("conv_id", "part", F.posexplode("keys").alias("at", "key")).filter("key IS NOT NULL")
    again = firsts.groupBy("conv_id", "key").agg(F.sort_array(F.collect_list(F.struct("part", "at"))).alias("all")).filter("size(all) > 1")
    later = again.select(F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("x")).groupBy(F.col("x.part").alias("_part")).agg(F.collect_list("x.at").alias("_later"))

    def resolved(codes, later):
        out = bytearray(codes)
        for k in later or ():
            out[k] |= 1 << 4
        return bytes(c | DROP if c >> 4 else c for c in out)

    narrow = parts.select("conv_id", "part", "codes", "initials", "span").join(later, F.col("part") == F.col("_part"), "left")
    coded = cut(narrow.select("conv_id", "part", "initials", "span", F.udf(resolved, "binary")("codes", "_later").alias("codes")))
    number = lambda test: F.udf(lambda codes: sum(map(test, bytes(codes))), "long")
    plain = F.udf(lambda codes: bytes(c & 15 for c in codes), "binary")
    inner = F.udf(lambda initials: _illegal(list(initials)), "long")
    counted = coded.select(
        "conv_id", "part", "span", plain("codes").alias("codes"), F.substring("initials", 1, 1).alias("head"), F.substring("initials", -1, 1).alias("tail"), inner("initials").alias("illegal"),
        number(lambda c: c == DROP)("codes").alias("blank"), number(lambda c: bool(c >> 4))("codes").alias("duplicate"), number(lambda c: bool(c & CUT_OFF and not c & DROP))("codes").alias("truncated"),
    ).withColumn("costs", F.udf(lambda codes: between(bytes(codes)), "array<array<long>>")("codes"))
    counted = cut(counted)
    # per conversation one entry a part, of a few numbers each
    listed = counted.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "costs", "head", "tail", "span"))).alias("p"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    )
    listed = listed.withColumn("c", F.udf(_composed, "struct<cost:long,ends:array<array<long>>>")(F.col("p.costs")))
    spans = F.filter("p.span", lambda s: F.size(s) > 0)
    shared = F.expr("aggregate(sequence(1, size(_s)), 0L, (n, k) -> n + if(k < size(_s) AND _s[k - 1][1] = _s[k][0], 1L, 0L))")
    different = F.aggregate("_s", F.lit(0).cast("long"), lambda n, s: n + s[2])
    listed = listed.withColumn("_s", spans)
    gaps = F.when(F.size("_s") == 0, F.lit(0).cast("long")).otherwise(F.expr("_s[size(_s) - 1][1] - _s[0][0] + 1") - (different - shared))
    filled = F.filter("p", lambda x: x["head"] != "")
    seam = F.expr("aggregate(sequence(1, greatest(size(_f), 1)), 0L, (n, k) -> n + if(k < size(_f) AND concat(_f[k - 1].tail, _f[k].head) NOT IN ('su', 'ua', 'au'), 1L, 0L))")
    listed = cut(listed.withColumn("gaps", gaps).withColumn("_f", filled).withColumn("illegal", F.col("illegal") + seam).withColumn("cost", F.col("c.cost")))
    ends = listed.select(F.explode(F.expr("transform(p, (x, k) -> struct(x.part AS part, c.ends[k] AS end, k = size(p) - 1 AS last))")).alias("e")).select("e.*")
    traced = cut(counted.join(ends, "part").select("conv_id", "part", F.udf(_traces, "array<struct<edits:string,state:int>>")("codes", "end", "last").alias("by")))
    ways = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", F.col("by.state").alias("states")))).alias("w"))
    entry = ways.withColumn("q", F.udf(_entries, "array<int>")(F.col("w.states"))).select(F.explode(F.expr("transform(w, (x, k) -> struct(x.part AS part, q[k] AS entry))")).alias("e")).select("e.*")
    chosen = cut(traced.join(entry, "part").select("conv_id", "part", "entry", F.expr("by[entry].edits").alias("edits")))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    audits = audits.withColumnRenamed("conv_id", "_id")
    split = listed.join(audits, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", *COUNTS, "audit")
    mended = parts.select("part", "turns").join(chosen, "part").select("conv_id", "part", "edits", F.udf(_edited, "array<struct<role:string,text:string>>")("turns", "edits", "entry").alias("turns"))
    conversations = whole.select("conv_id", *COUNTS, F.col("edits").alias("audit")).unionByName(split)
    return conversations, whole.select("conv_id", F.lit(0).cast("long").alias("part"), "edits", "turns").unionByName(mended)


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns as `role:text` lines. A conversation in several parts is read as one stream, a part at
    a time, as its digest needs all before."""
    lines = parts.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("lines"), F.size("turns").alias("n"))
    one, several = lines.filter("part = 0"), lines.filter("part > 0")
    id_field = parts.schema["conv_id"]
    id_type = to_arrow_type(id_field.dataType)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, begun, current, sha, lines_before = pa.schema([("conv_id", id_type), ("repaired_sha256", pa.string())]), False, None, None, 0
        for batch in batches:
            out = []
            for conv_id, text, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not begun or conv_id != current:
                    if begun:
                        out.append({"conv_id": current, "repaired_sha256": sha.hexdigest()})
                    begun, current, sha, lines_before = True, conv_id, hashlib.sha256(), 0
                if n:
                    sha.update((("\n" if lines_before else "") + text).encode())
                    lines_before += n
            yield pa.RecordBatch.from_pylist(out, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": sha.hexdigest()}], schema)

    dealt = several.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "lines", "n")
    return one.select("conv_id", F.sha2("lines", 256).alias("repaired_sha256")).unionByName(dealt.mapInArrow(hashed, f"conv_id {id_field.dataType.simpleString()}, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the hash of id and turn: dropped (not alive), emptied, without ends of sentences, repeated, or made the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.col("fault") != 0, F.when(F.col("fault") == 3, 2).otherwise(1))).alias("alive"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    conversations, parts = repair(damaged(table(spark, sf_dir, "conversations")))
    shas = digests(parts).withColumnRenamed("conv_id", "_id")
    return conversations.join(shas, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
