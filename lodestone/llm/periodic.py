"""Periodic runs of words: block matching at every scale, then exact extension.

A run of period q repeats its first q words over and over, so that words q apart are equal. With b the largest power of two up to
q, a run of four periods or more holds a block of b words at a multiple of b, and that block again q words on. Per scale b the
blocks at its multiples are the patterns of an Aho-Corasick automaton over sequences of word numbers, and the whole document is
searched. An occurrence at a distance from b to 2b - 1 (the scale's periods) is extended word by word to both sides as far as the
two copies agree, which gives the maximal stretch of that period. Scales ascend, so a stretch whose smallest period is less than
the distance has been found before, with the same ends.

A block in a run has each of its words again within 2b - 1 words. Blocks without that can't seed anything and aren't searched;
in ordinary prose hardly any are left, and the search costs what runs there are.

Each document is judged alone, in its own row: nothing is shuffled, and memory follows the longest text.

Cases: null, empty and blank texts have no words and no runs; a null id has no decimal form and is never made periodic by the query;
repeated rows are judged alike; an empty table gives an empty result; extra columns of the caller stay, but those named like
the ones added are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, words_of

#: Least words and least periods of a run. The block argument needs four periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at first when a match is extended; doubled while all agree.
STRIDE = 32

_SPACES = str.maketrans(WHITE, " " * len(WHITE))


def split_words(text: str | None) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+` in order."""
    return [w for w in (text or "").translate(_SPACES).split(" ") if w]


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers, equal where the words are."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _agree(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from i and j on (step 1) or from there back (step -1); i < j."""
    most = len(ids) - j if step > 0 else i + 1
    done, width = 0, STRIDE
    while done < most:
        k = min(width, most - done)
        if step > 0:
            same = ids[i + done : i + done + k] == ids[j + done : j + done + k]
        else:
            same = (ids[i - done - k + 1 : i - done + 1] == ids[j - done - k + 1 : j - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, width = done + k, width * 2
    return done


def _gaps(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence (past the end: more than the document holds)."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), 2 * len(ids) + 2, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return gap


def _occurrences(whole: tuple[int, ...], starts: list[int], lows: list[int], b: int) -> dict[int, list[int]]:
    """Per block start the places at which its words begin again, ascending: all from its low to within 2b of it, and others."""
    auto, pattern_of = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    firsts: dict[tuple[int, ...], int] = {}
    for s in starts:
        key = whole[s : s + b]
        if key not in firsts:
            firsts[key] = len(firsts)
            auto.add_word(key, firsts[key])
        pattern_of[s] = firsts[key]
    auto.make_automaton()
    parts: list[list[int]] = []  # where the blocks may come again, merged
    for low, high in sorted(zip(lows, (s + 3 * b for s in starts))):
        if parts and low <= parts[-1][1]:
            parts[-1][1] = max(parts[-1][1], high)
        else:
            parts.append([low, high])
    at = defaultdict(list)
    for low, high in parts:
        for end, number in auto.iter(whole[low:high]):
            at[number].append(low + end - b + 1)
    return {s: at[p] for s, p in pattern_of.items()}


def find_runs(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. `least_periods` is four at least."""
    if least_periods < 4:
        raise ValueError("blocks find every run only from four periods on")
    n, found, seen = len(ids), [], set()
    if n < max(least_words, least_periods):
        return found
    owner, reach = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # the longest run over each word
    whole, gap, b = None, _gaps(ids), 1
    while b * least_periods <= n:
        blocks = n // b
        # the largest gap of each aligned block, from those of its halves
        gap = gap[:blocks] if b == 1 else np.maximum(gap[0 : 2 * blocks : 2], gap[1 : 2 * blocks : 2])
        starts = np.flatnonzero(gap < 2 * b) * b
        lows = starts + b
        if found and len(starts):
            # within a run of two periods or more to a block, a block comes again at multiples of the period alone, which
            # belong to that run, and across its end not at all
            runs, over = np.array(found), owner[starts]
            stop, period = runs[over, 0] + runs[over, 1], runs[over, 2]
            inside = (over >= 0) & (starts + b <= stop) & (2 * period <= b)
            lows = np.where(inside, np.maximum(lows, stop - period + 1), lows)
        open_ = lows < np.minimum(starts + 2 * b, n - b + 1)
        starts, lows = starts[open_].tolist(), lows[open_].tolist()
        if starts:
            whole = whole or tuple(ids.tolist())
            done: dict[int, int] = {}  # end of the last stretch of each distance
            for s, places in _occurrences(whole, starts, lows, b).items():
                for t in places[bisect_left(places, s + b) : bisect_left(places, s + 2 * b)]:
                    d = t - s
                    if t < done.get(d, 0):
                        continue  # within the stretch last found
                    if (o := owner[s]) >= 0:
                        start, length, period = found[o]
                        if d % period == 0 and t + b <= start + length:
                            continue  # several periods of a run
                    left = _agree(ids, s - 1, t - 1, -1) if s else 0
                    start, stop = s - left, t + b + _agree(ids, s + b, t + b, 1)
                    done[d] = stop
                    if stop - start < max(least_words, least_periods * d) or (start, stop) in seen:
                        continue
                    seen.add((start, stop))
                    part = slice(start, stop)
                    owner[part] = np.where(reach[part] < stop - start, len(found), owner[part])
                    reach[part] = np.maximum(reach[part], stop - start)
                    found.append((start, stop - start, d))
        b *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stands in a run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


ADDED = "n_runs long, start long, length long, period long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _described(words: list[str]) -> tuple:
    runs = find_runs(numbered(words))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    if not runs:
        return 0, *best, [], " ".join(words)
    gone = repeated_words(len(words), runs)
    return len(runs), *best, [dict(zip(("start", "length", "period"), r)) for r in runs], " ".join(w for w, g in zip(words, gone.tolist()) if not g)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append to each row the number of runs, the longest of them (ties: the first, then the smallest period; nulls without any),
    all runs by start and period, and the text without what runs repeat, its words joined by single spaces."""
    names = ["n_runs", "start", "length", "period", "runs", "collapsed"]
    own = [c for c in docs.columns if c not in names]
    schema = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_described(split_words(t.as_py())) for t in batch.column(0)]
            columns = [pa.array([m[k] for m in made], f.type) for k, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*own, *names])

    # the text leads, whatever the caller's columns
    rows = docs.select(F.col(text).alias("_text_of_runs"), *own)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return rows.mapInArrow(described, ", ".join(filter(None, [kept, ADDED])))


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the hash of its id, repeats what follows some word of it; others keep their text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    due = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("_w"))
    at = due.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    at = at.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    again = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[int(_a + (i - _a) % _p)])), ' ')")
    return at.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """Runs of every document after made_periodic(), as numbers and digests."""
    from .common import table

    runs = with_runs(made_periodic(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return runs.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
