"""Document fingerprints from prefix polynomial hashes.

For code points c_0 .. c_{n-1} the prefix array is S[i] = sum over j < i of (c_j + 1) B^j, modulo two primes below 2^31, so
the residues of any span come from two entries, spans at different places are compared after multiplying by a power of B,
and the prefix array of a concatenation follows from those of its parts. Longest common extensions are found by binary
search over span equality.

A fingerprint keeps n, and the prefix residues at anchors: places where the residue of the next WINDOW code points, mixed, ends in
enough zero bits (its level). Levels nest, and the lowest level with at most ANCHORS places is kept, so anchors follow the text
wherever it is shifted. Two texts are compared at the higher of their levels: blocks between anchors match where their residues
do, and runs of matched blocks are grown to either side by common extensions over the prefix arrays (as are the two
beginnings and the two ends), up to the next matched block. What is left between them is taken up again past each edit: windows at
anchors of lower levels, read from the prefix arrays, that stand once in both gaps and in one order start extensions of
their own. The bound on stored anchors so bounds a fingerprint's size and not what is matched. Likeness is the share of the longer text that is covered; 1 exactly for
equal texts. From two stored fingerprints alone, blocks can be matched but not grown.

Cases: null and empty texts are one text (two of them have likeness 1, one and another text 0); repeated rows each return
a row; rows are ordered by descending doc_id, then text, nulls last; a single row follows itself; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points that make an anchor, the least level (a block has two to its power code points on average), and most anchors of
#: a fingerprint; and the levels at which gaps between matched blocks are taken up again.
WINDOW, LEAST_LEVEL, ANCHORS, FINER = 16, 5, 128, (5, 2)
#: Code points of a gap below which the lowest level alone is taken.
SHORT = 4096

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per modulus B^i and B^-i for i <= n, grown by doubling and kept per worker."""
    if not _powers or len(_powers[0][0]) <= n:
        size = 1 << max(12, n.bit_length() + 1)
        _powers.clear()
        for p, b in zip(PRIMES, BASES):
            both = []
            for base in (b, pow(b, -1, p)):
                a = np.ones(size, np.uint64)
                have = 1
                while have < size:
                    a[have : 2 * have] = a[:have] * np.uint64(pow(base, have, p)) % np.uint64(p)
                    have *= 2
                both.append(a)
            _powers.append((both[0], both[1]))
    return _powers


class PrefixHash:
    """Prefix residues of one text: any span's residue in constant time."""

    def __init__(self, text: str | None):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for p, (up, _) in zip(PRIMES, powers(self.n)):
            s = np.zeros(self.n + 1, np.uint64)
            # terms are below 2^31, so a running sum of 2^33 of them fits
            np.cumsum(codes * up[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        return span(self, i, j)

    def extension(self, i: int, other: PrefixHash, j: int, back: bool = False) -> int:
        return extension(self, i, other, j, min(i, j) if back else min(self.n - i, other.n - j), back)

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        """Prefix residues at some places."""
        return [s[places] for s in self.sums]

    def first(self, places: np.ndarray) -> np.ndarray:
        """Prefix residues modulo the first prime."""
        return self.sums[0][places]

    def one(self, k: int, i: int) -> int:
        """Prefix residue modulo the k-th prime."""
        return int(self.sums[k][i])

    @cached_property
    def levels(self) -> np.ndarray:
        """Level of each place where a window starts."""
        return _levels(self, 0, self.n - WINDOW + 1)


@dataclass
class Joined:
    """Prefix residues of left[:cut] + right[:take], from those of the parts."""

    left: PrefixHash
    cut: int
    right: PrefixHash
    take: int

    @property
    def n(self) -> int:
        return self.cut + self.take

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        inside, out = np.minimum(places, self.cut), []
        for p, a, b, (up, _) in zip(PRIMES, self.left.sums, self.right.sums, powers(self.n)):
            out.append((a[inside] + up[self.cut] * b[np.maximum(places - self.cut, 0)] % np.uint64(p)) % np.uint64(p))
        return out

    def first(self, places: np.ndarray) -> np.ndarray:
        p, up = np.uint64(PRIMES[0]), powers(self.n)[0][0]
        return (self.left.sums[0][np.minimum(places, self.cut)] + up[self.cut] * self.right.sums[0][np.maximum(places - self.cut, 0)] % p) % p

    def one(self, k: int, i: int) -> int:
        if i <= self.cut:
            return self.left.one(k, i)
        return (self.left.one(k, self.cut) + int(powers(self.n)[k][0][self.cut]) * self.right.one(k, i - self.cut)) % PRIMES[k]

    @cached_property
    def levels(self) -> np.ndarray:
        a = max(0, min(self.cut, self.cut - WINDOW + 1))
        b = max(a, min(self.cut, self.n - WINDOW + 1))
        return np.concatenate([self.left.levels[:a], _levels(self, a, b), self.right.levels[: max(0, self.take - WINDOW + 1)]])


def span(text: PrefixHash | Joined, i: int, j: int) -> tuple[int, ...]:
    """Residues of text[i:j], the same wherever the span stands."""
    return tuple((text.one(k, j) - text.one(k, i)) * int(down[i]) % p for k, (p, (_, down)) in enumerate(zip(PRIMES, powers(text.n))))


def extension(a: PrefixHash | Joined, i: int, b: PrefixHash | Joined, j: int, most: int, back: bool = False) -> int:
    """Length of the longest common extension of a[i:] and b[j:] (back: of a[:i] and b[:j]), `most` at most: lengths grow fourfold while
    the spans agree, and the rest is a binary search."""
    same = (lambda m: span(a, i - m, i) == span(b, j - m, j)) if back else (lambda m: span(a, i, i + m) == span(b, j, j + m))
    low, high, m = 0, most, 1
    while low < most:
        m = min(most, m)
        if not same(m):
            high = m - 1
            break
        low, m = m, 4 * m
    while low < high:
        m = (low + high + 1) // 2
        low, high = (m, high) if same(m) else (low, m - 1)
    return low


def _levels(text: PrefixHash | Joined, start: int, stop: int) -> np.ndarray:
    """Zero bits at the end of the mixed residue of the window at each place."""
    if stop <= start:
        return np.zeros(0, np.uint8)
    at = np.arange(start, stop)
    p, (_, down) = np.uint64(PRIMES[0]), powers(text.n)[0]
    low, high = text.at(at)[0], text.at(at + WINDOW)[0]
    x = (high + p - low) % p * down[start:stop] % p
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint8)


@dataclass
class Fingerprint:
    """places, levels and (both residues in one number) prefixes of the anchors, and the prefix at n."""

    n: int
    level: int
    places: np.ndarray
    levels: np.ndarray
    prefixes: np.ndarray

    @classmethod
    def of(cls, text: PrefixHash | Joined) -> Fingerprint:
        all_levels = text.levels
        places = np.flatnonzero(all_levels >= LEAST_LEVEL)
        levels, level = all_levels[places], LEAST_LEVEL
        while len(places) > ANCHORS:
            level += 1
            keep = levels >= level
            places, levels = places[keep], levels[keep]
        r = text.at(np.append(places, text.n))
        return cls(text.n, level, places, levels, r[0] << np.uint64(31) | r[1])

    def __str__(self) -> str:
        return f"{self.n:x}.{self.level:x}.{self.places.astype('>u4').tobytes().hex()}.{self.levels.tobytes().hex()}.{self.prefixes.astype('>u8').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, level, places, levels, prefixes = text.split(".")
        read = lambda x, kind: np.frombuffer(bytes.fromhex(x), kind)
        return cls(int(n, 16), int(level, 16), read(places, ">u4").astype(np.int64), read(levels, "u1"), read(prefixes, ">u8").astype(np.uint64))

    def blocks(self, level: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Ends of the blocks between the anchors of a level, and length and residues of each."""
        keep = np.append(self.levels >= level, True)
        ends = np.append(self.places, self.n)[keep]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        names = [(ends - starts).tolist()]
        for shift, p, (_, down) in zip((31, 0), PRIMES, powers(self.n)):
            r, p = self.prefixes[keep] >> np.uint64(shift) & np.uint64((1 << 31) - 1), np.uint64(p)
            before = np.concatenate([[np.uint64(0)], r[:-1]])
            names.append(((r + p - before) % p * down[starts] % p).tolist())
        return ends, list(zip(*names))

    def likeness(self, other: Fingerprint, text: PrefixHash | Joined | None = None, other_text: PrefixHash | Joined | None = None) -> float:
        """Share of the longer text covered by matched blocks, grown by extensions where the prefix arrays are given."""
        if self.n == other.n and self.prefixes[-1] == other.prefixes[-1]:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        level = max(self.level, other.level)
        (ends, mine), (theirs_at, theirs) = self.blocks(level), other.blocks(level)
        free: dict[tuple, list[int]] = {}
        for k in range(len(theirs) - 1, -1, -1):
            free.setdefault(theirs[k], []).append(k)
        # matched spans (start and end in either text), in the order of the first
        spans, next_k = [], None
        for name, end in zip(mine, ends.tolist()):
            at = free.get(name)
            if not name[0] or not at:
                next_k = None
                continue
            k = next_k if next_k in at else at[-1]
            at.remove(k)
            e, n = int(theirs_at[k]), name[0]
            if next_k == k:
                spans[-1][1], spans[-1][3] = end, e
            else:
                spans.append([end - n, end, e - n, e])
            next_k = k + 1
        if text is not None and other_text is not None:
            spans = _grown(spans, text, other_text)
            more = sum(_between(text, other_text, *gap, FINER) for gap in _gaps(spans, text.n, other_text.n))
        else:
            more = 0
        whole = max(self.n, other.n)
        return min(sum(b - a for a, b, _, _ in spans) + more, whole - 1) / whole


def _gaps(spans: list[list[int]], n: int, other_n: int) -> Iterator[tuple[int, int, int, int]]:
    """What lies between matched spans in both texts: after each span, up to the next one of either text."""
    other = sorted(range(len(spans)), key=lambda k: (spans[k][2], spans[k][3]))
    after = {k: spans[other[i + 1]][2] if i + 1 < len(other) else other_n for i, k in enumerate(other)}
    for k, s in enumerate(spans):
        stop = spans[k + 1][0] if k + 1 < len(spans) else n
        if stop - s[1] >= WINDOW and after[k] - s[3] >= WINDOW:
            yield s[1], stop, s[3], after[k]


def _windows(text: PrefixHash | Joined, start: int, stop: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and residues of the windows at anchors of a level in a span."""
    places = start + np.flatnonzero(text.levels[start : stop - WINDOW + 1] >= level)
    p = np.uint64(PRIMES[0])
    return places, (text.first(places + WINDOW) + p - text.first(places)) % p * powers(text.n)[0][1][places] % p


def _common(x: PrefixHash | Joined, y: PrefixHash | Joined, a: int, b: int, c: int, d: int, level: int) -> tuple[list[int], list[int]]:
    """Places in x[a:b], ascending, and in y[c:d] of windows that stand once in each."""
    (at, mine), (there, theirs) = _windows(x, a, b, level), _windows(y, c, d, level)
    both = np.concatenate([mine, theirs])
    order = np.argsort(both, kind="stable")
    values = both[order]
    same = values[1:] == values[:-1]
    if not same.any():
        return [], []
    edge = np.concatenate([[False], same, [False]])
    pairs = np.flatnonzero(same & ~edge[:-2] & ~edge[2:])
    i, j = order[pairs], order[pairs + 1] - len(mine)
    sound = (i < len(mine)) & (j >= 0)
    i, j = i[sound], j[sound]
    order = np.argsort(i)
    return at[i[order]].tolist(), there[j[order]].tolist()


def _in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, ends, before = [], [], []
    for k, v in enumerate(places):
        i = bisect_left(tails, v)
        before.append(ends[i - 1] if i else -1)
        if i == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[i], ends[i] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _between(x: PrefixHash | Joined, y: PrefixHash | Joined, a: int, b: int, c: int, d: int, levels: tuple[int, ...]) -> int:
    """How much of x[a:b] stands in y[c:d] in the same order, by extensions from windows that both hold once."""
    if not levels or min(b - a, d - c) < WINDOW:
        return 0
    if min(b - a, d - c) < SHORT:
        levels = levels[-1:]
    at, there = _common(x, y, a, b, c, d, levels[0])
    total = 0
    for k in _in_order(there):
        p, q = at[k], there[k]
        if p < a or q < c:
            continue  # within the last extension
        forward = extension(x, p, y, q, min(b - p, d - q))
        if forward < WINDOW:
            continue  # equal residues of different windows
        back = extension(x, p, y, q, min(p - a, q - c), True)
        total += forward + back + _between(x, y, a, p - back, c, q - back, levels[1:])
        a, c = p + forward, q + forward
    return total + _between(x, y, a, b, c, d, levels[1:])


def _grown(spans: list[list[int]], x: PrefixHash | Joined, y: PrefixHash | Joined) -> list[list[int]]:
    """Spans grown to the right, then to the left, as far as the texts agree and no other span is. The two beginnings and the
    two ends are spans without length to begin with."""
    spans = sorted([*spans, [0, 0, 0, 0], [x.n, x.n, y.n, y.n]])
    other = sorted(range(len(spans)), key=lambda k: (spans[k][2], spans[k][3]))
    place = {k: i for i, k in enumerate(other)}
    for back in (False, True):
        for k in range(len(spans)) if not back else range(len(spans) - 1, -1, -1):
            s = spans[k]
            if back:
                gap = s[0] - (spans[k - 1][1] if k else 0), s[2] - (spans[other[place[k] - 1]][3] if place[k] else 0)
            else:
                gap = (spans[k + 1][0] if k + 1 < len(spans) else x.n) - s[1], (spans[other[place[k] + 1]][2] if place[k] + 1 < len(other) else y.n) - s[3]
            if min(gap) > 0:
                n = extension(x, s[0 if back else 1], y, s[2 if back else 3], min(gap), back)
                if back:
                    s[0], s[2] = s[0] - n, s[2] - n
                else:
                    s[1], s[3] = s[1] + n, s[3] + n
    return spans


# --- Spark ------------------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (PrefixHash(t) for t in batch.column(1).to_pylist())
            rows = [(h.n, str(Fingerprint.of(h))) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], [id_col, "n_chars", "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_chars long, fingerprint string")


def with_successors(docs: DataFrame) -> DataFrame:
    """(bucket, flag, doc_id, text): rows dealt by ranges of descending doc_id, each range followed by a copy (flag 1) of
    the row that comes after it, so that a sorted range holds every row next to its successor. Texts are shuffled once.
    Range bounds and heads are as many as there are shuffle partitions."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)))) if n > 1 else np.array([])

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        place = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.float64), side="left")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, place).astype(np.int32))

    heads = rows.select("doc_id").withColumn("bucket", bucket("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("flag"), "doc_id", "text")
    before = [(heads[k - 1].bucket, heads[k].head) for k in range(len(heads))]
    small = docs.sparkSession.createDataFrame(before, "bucket int, head long")
    # the head of a range is its largest row; several may share its id
    firsts = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("bucket", "doc_id").agg(F.max("text").alias("text"))
    dealt = rows.select(bucket("doc_id").alias("bucket"), F.lit(0).alias("flag"), "doc_id", "text").unionByName(firsts.select("bucket", F.lit(1).alias("flag"), "doc_id", "text"))
    return dealt.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "flag", F.desc_nulls_last("doc_id"), F.desc("text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n / 2) code points are replaced by the first as
    many of the next document's, and likenesses to the edited and to the next text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out, part = [], batch.slice(at, 1024)
                for b, flag, i, text in zip(*(part.column(c).to_pylist() for c in range(4))):
                    h = PrefixHash(text)
                    f = Fingerprint.of(h)
                    if held is not None and held[0] == b:
                        _, di, dt, dh, df = held
                        half = dh.n // 2
                        take = min(half, h.n)
                        eh = Joined(dh, dh.n - half, h, take)
                        ef = Fingerprint.of(eh)
                        edited = (dt[: dh.n - half] + text[:take]).encode("utf-8", "surrogatepass")
                        out.append((di, dh.n, hashlib.sha256(edited).hexdigest(), str(df), str(ef), df.likeness(ef, dh, eh), df.likeness(f, dh, h)))
                    held = None if flag else (b, i, text, h, f)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(7)], names)

    return with_successors(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
