"""SimHash near-dedup with a Gray-order hierarchical index.

1. Each text gets a fingerprint of one or more 64-bit words; equal fingerprints collapse to one row before any search.
2. Keys bring fingerprints that may link together. For a small `radius` in 64 bits a key is two of radius + 2 blocks of bits:
   two fingerprints within the radius agree on two blocks at least, so no link is missed. For a wide fingerprint a key is a
   drawn set of bits, as many as keep buckets small, and there are as many keys as make pairs at SIMILAR equal bits meet with
   probability RECALL (more similar pairs more surely). Buckets above `block` rows are dealt by hash into segments, and each
   pair of segments meets in a group of its own: no task holds more than two segments, and no pair is left out.
3. In a group the fingerprints are sorted by Gray rank. Runs of `FANOUT` neighbours form upper nodes that hold the bit
   pattern all members share (AND and OR of them). The search descends pairs of nodes; differences in bits that both
   patterns fix add up, and a pair of whole groups is dropped once they exceed the radius, or once both lie in one
   component already. A group emits a spanning forest of its links, never all pairs.
4. Components over all groups come from connected_components() over vertices (smallest id, fingerprint), so that a component's
   root is named by its smallest id and nothing joins on it.

Cases: null and empty texts have fingerprint zero and link like any other; texts of under `shingle` words are hashed
whole; repeated rows and ids each return a row; a null doc_id never names a component unless all its members are null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, join_spread
from .components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Wide fingerprints: words, words of a shingle, and the share of equal bits that links.
WIDE, WIDE_SHINGLE, WIDE_SIMILARITY = 4, 5, 0.8
#: Share of equal bits of two texts that share 0.8 of their shingles (1 - acos(0.8 * 2 / 1.8) / pi), and the least probability
#: that their fingerprints meet.
SIMILAR, RECALL = 0.848, 0.95
#: Fingerprints of a bucket on average, which sets the bits of a drawn key.
BUCKET, LEAST_BITS = 512, 12
FANOUT = 16
#: Most rows of a segment; a task's group holds two segments at most.
BLOCK = 4096
#: Pairs of nodes that one search step expands (each into FANOUT x FANOUT).
STEP = 1024


# --- fingerprints -----------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits are as good as independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """SimHash of so many 64-bit words over word shingles, repeats included. The first word's bits are those of the shingles'
    hashes, further words' those of mixed hashes."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not parts:
        return np.zeros(words, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start, k = end - size, min(shingle, len(parts))
    spans = map(slice, start[: len(parts) - k + 1].tolist(), end[k - 1 :].tolist())
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, len(parts) - k + 1)
    ones = np.zeros((words, 64), np.int64)
    for i in range(0, len(h), 16384):
        for w in range(words):
            part = h[i : i + 16384]
            part = _mixed(part + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if w else part
            ones[w] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_column(text: Column, shingle: int = SHINGLE, words: int = 1) -> Column:
    """The fingerprint as a binary of 8 bytes a word, highest first."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle, words).astype(">u8").tobytes() for t in texts], dtype=object)
        give_back()

    return of(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))


# --- Gray-order index -------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code (a row of words, highest first) in the reflected Gray sequence, in as many words."""
    r = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    # an odd number of ones in the words before turns a word's sequence round
    odd = np.cumsum(np.bitwise_count(codes), axis=1, dtype=np.int64)[:, :-1] & 1 == 1
    r[:, 1:][odd] = ~r[:, 1:][odd]
    return r


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the components of i and j; label points every member straight to its root."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _bits(x: np.ndarray) -> np.ndarray:
    """Ones of each row."""
    n = np.bitwise_count(x)
    return n[:, 0] if n.shape[1] == 1 else n.sum(axis=1, dtype=np.int32)


class GrayIndex:
    """Hierarchy over distinct codes (rows of 64-bit words) in Gray order."""

    def __init__(self, codes: np.ndarray, radius: int = RADIUS, fanout: int = FANOUT):
        rank = gray_rank(codes)
        #: Places of the sorted codes in the input.
        self.order = np.lexsort(rank.T[::-1])
        self.codes = codes[self.order]
        self.radius, self.fanout = radius, fanout
        #: Per level the ones that all members share, and the bits in which members differ.
        self.ones, self.free, any_of = [self.codes], [np.zeros_like(self.codes)], self.codes
        while len(any_of) > fanout:
            at = np.arange(0, len(any_of), fanout)
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], at, axis=0))
            any_of = np.bitwise_or.reduceat(any_of, at, axis=0)
            self.free.append(self.ones[-1] ^ any_of)

    def _least_difference(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differences that the shared patterns of two nodes alone account for; at level 0 the distance."""
        ones, free = self.ones[level], self.free[level]
        apart = ones[i] ^ ones[j]
        return _bits(apart & ~(free[i] | free[j]) if level else apart)

    def components(self) -> np.ndarray:
        """For each code (in Gray order) the place of the first code of its component."""
        n = len(self.codes)
        label = np.arange(n)
        if n < 2:
            return label
        near = np.flatnonzero(_bits(self.codes[1:] ^ self.codes[:-1]) <= self.radius)
        _hook(label, near, near + 1)
        top = len(self.ones) - 1
        i, j = np.triu_indices(len(self.ones[top]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            width = self.fanout**level
            at = np.arange(0, n, width)
            low, high = (np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)) if level else (label, label)
            open_ = (self._least_difference(level, i, j) <= self.radius) & ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[open_], j[open_]
            if not level:
                _hook(label, i, j)
                continue
            step = max(1, STEP // self.codes.shape[1])
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                kids = np.arange(self.fanout)
                x = np.broadcast_to((a[:, None] * self.fanout + kids)[:, :, None], (len(a), self.fanout, self.fanout)).ravel()
                y = np.broadcast_to((b[:, None] * self.fanout + kids)[:, None, :], (len(a), self.fanout, self.fanout)).ravel()
                there = (x <= y) & (y < len(self.ones[level - 1]))
                stack.append((level - 1, x[there], y[there]))
        return label


# --- distributed search -----------------------------------------------------------------------------------------


def exact_keys(radius: int) -> np.ndarray:
    """Masks (keys x 1 word) of every two of radius + 2 blocks."""
    edges = [round(k * 64 / (radius + 2)) for k in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return np.array([[a | b] for a, b in combinations(blocks, 2)], np.uint64)


def drawn_keys(n: int, words: int, similar: float = SIMILAR, recall: float = RECALL, bucket: int = BUCKET) -> np.ndarray:
    """Masks (keys x words) of drawn bits for n fingerprints."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, n / bucket))))
    keys = math.ceil(math.log(1 - recall) / math.log(1 - similar**bits))
    rng = np.random.default_rng(SEED)
    masks = np.zeros((keys, words), np.uint64)
    for row in masks:
        for p in rng.choice(64 * words, bits, replace=False).tolist():
            row[p >> 6] |= np.uint64(1 << (p & 63))
    return masks


def _codes(column: pa.Array) -> np.ndarray:
    """Rows of words from a column of binaries of one length."""
    n, width = len(column), len(column[0].as_py()) if len(column) else 8
    at = np.frombuffer(column.buffers()[1], np.int32, n + 1, offset=4 * column.offset) if n else np.zeros(1, np.int32)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if n else np.zeros(0, np.uint8)
    return raw.reshape(n, width).view(">u8").astype(np.uint64)


def _binaries(codes: np.ndarray) -> pa.Array:
    raw = codes.astype(">u8").tobytes()
    width = 8 * codes.shape[1]
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def _placer(masks: np.ndarray) -> Callable:
    """(b, id, fp) per key of each (id, fp); b names the bucket (two buckets of one name only meet more rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 2048):
                part = batch.slice(at, 2048)
                codes = _codes(part.column(1))
                names = []
                for k, mask in enumerate(masks):
                    b = np.full(len(codes), k + 1, np.uint64)
                    for w in range(codes.shape[1] if len(codes) else 0):
                        b = _mixed(b ^ (codes[:, w] & mask[w])) + np.uint64(k + 1)
                    names.append(b.view(np.int64))
                take = pa.array(np.tile(np.arange(len(codes)), len(masks)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), part.column(0).take(take), part.column(1).take(take)], ["b", "id", "fp"])
        give_back()

    return run


def _linker(radius: int) -> Callable:
    """Spanning edges (u, v) of each group of consecutive rows (g, id, fp) of one g; only the last group of a batch waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def edges(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.RecordBatch]:
            rows = rows.combine_chunks()
            g = rows.column("g").to_numpy()
            fps = rows.column("fp").chunk(0)
            codes = _codes(fps)
            at = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            ends = at if last else at[:-1]
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            near = two[_bits(codes[two] ^ codes[two + 1]) <= radius]
            us, vs = [near], [near + 1]
            for a, b in zip(ends[:-1][size > 2].tolist(), ends[1:][size > 2].tolist()):
                index = GrayIndex(codes[a:b], radius)
                label = index.components()
                moved = np.flatnonzero(label != np.arange(len(label)))
                us.append(a + index.order[moved])
                vs.append(a + index.order[label[moved]])
            u, v = (pa.array(np.concatenate(x)) for x in (us, vs))
            ids = rows.column("id").chunk(0)
            out = pa.RecordBatch.from_arrays([ids.take(u), fps.take(u), ids.take(v), fps.take(v)], ["ui", "uf", "vi", "vf"])
            return rows.slice(len(g) if last else int(at[-2])), out

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            if len(rest):
                rest, out = edges(rest, False)
                yield out
        if rest is not None and len(rest):
            yield edges(rest, True)[1]
        rest = None
        give_back()

    return run


def vertex(id_col: str, fp: str) -> Column:
    """Sorts by id, nulls last; one per fingerprint."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.col(fp).alias("fp"))


def links(fingerprints: DataFrame, radius: int, masks: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Spanning edges (u, v: vertices) between distinct fingerprints (columns id, fp) at `radius` or fewer differing bits
    that share a key."""
    placed = fingerprints.select("id", "fp").mapInArrow(_placer(masks), "b long, id long, fp binary")
    large = placed.groupBy(F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("_b", F.ceil(F.col("n") / block).cast("int").alias("k"))
    dealt = placed.join(large, F.col("b") == F.col("_b"), "left").withColumn("k", F.coalesce("k", F.lit(1)))
    segment = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("s")))
    spread = dealt.withColumn("s", segment).withColumn("o", F.explode(others))
    group = F.when(F.col("k") == 1, F.col("b")).otherwise(F.xxhash64("b", F.least("s", "o"), F.greatest("s", "o")))
    grouped = spread.select(group.alias("g"), "id", "fp").repartition("g").sortWithinPartitions("g")
    found = grouped.mapInArrow(_linker(radius), "ui long, uf binary, vi long, vf binary")
    return found.select(vertex("ui", "uf").alias("u"), vertex("vi", "vf").alias("v"))


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, shingle: int = SHINGLE, words: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, h, fp) per row, with h a hash of the text; (fp, n, low) per fingerprint: its rows and the least (id, h) of those
    with an id; and (u, root) per vertex that isn't its component's smallest."""
    marked = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), fingerprint_column(F.col(text_col), shingle, words).alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("low")))
    masks = exact_keys(radius) if words == 1 else drawn_keys(distinct.count(), words)
    return marked, distinct, connected_components(links(distinct.select("low.id", "fp"), radius, masks, block))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, words: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (hex digits) and component_id, the smallest id reachable over links."""
    marked, distinct, roots = _components(docs, id_col, text_col, radius, shingle, words, block)
    own = distinct.select("fp", "n", F.col("low.id").alias("low")).withColumn("v", vertex("low", "fp"))
    root = F.coalesce("root", "v")
    named = own.join(roots, F.col("v") == F.col("u"), "left").select(F.col("fp").alias("f"), "n", F.when(~root["none"], root["id"]).alias("component_id"))
    # copies of one text may be a third of all rows
    whole = join_spread(marked, "fp", "id", named, "f", "n")
    return whole.select(F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WIDE, shingle: int = WIDE_SHINGLE, similarity: float = WIDE_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id (of rows that repeat an id and
    text, one). Documents link where their fingerprints have `similarity` of their bits equal. Rows with a null id stay."""
    radius = math.floor(64 * words * (1 - similarity))
    _, distinct, roots = _components(docs, id_col, text_col, radius, shingle, words, block)
    own = distinct.filter("low IS NOT NULL").select("low", F.col("low.id").alias("i"), "fp").withColumn("v", vertex("i", "fp"))
    # by id and text: unlike texts under one id are rows of their own groups
    first = own.join(roots.select("u"), F.col("v") == F.col("u"), "left_anti").select(F.col("low.id").alias("_keep"), F.col("low.h").alias("_kh"))
    whole = docs.select(F.struct(*docs.columns).alias("_all"), F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"))
    kept = whole.join(first, (F.col("_i") == F.col("_keep")) & (F.col("_h") == F.col("_kh")), "left_semi")
    order = Window.partitionBy("_i", "_h").orderBy("_h", *[F.col("_all")[c] for c, t in docs.dtypes if c not in (id_col, text_col) and t in ("string", "bigint", "int")])
    one = kept.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select("_all.*")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
