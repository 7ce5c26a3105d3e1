"""Token-id shards stored as wavelet matrices.

Documents are dealt by ranges of ascending doc_id, tokenised where they land and packed into shards of about
SHARD_TOKENS tokens. A shard is one compressed file image: a document table and, per bit of a token id from the highest,
the bits of all tokens in the order that stable sorting by the higher bits gives. Rank and select over these planes give
access to any token, the count of an id in any range and the places where it occurs, without unpacking the tokens.
Shards are rows of a Parquet table (a binary column), so any store that Spark writes to can hold them.

A shard knows its offset within its range; offsets of the ranges are a running sum over as many rows as there are
shuffle partitions.

Cases: null and empty texts hold the end id alone; documents follow in order of doc_id, then text (nulls first), so rows
that repeat an id each get a place; a document longer than a shard gets a longer shard; an empty table writes no shard;
extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, shuffle_partitions

END_ID = 1
SHARD_TOKENS = 1 << 20
#: Encodings of words and of their letters kept per worker, and marks that may end a word of letters.
KEPT, KEPT_LETTERS = 700_000, 1_000_000
MARKS = ".,;:!?#$%&*|()[]{}<>/+=~^@\""
MAGIC = b"WVMX1\n"


# --- tokens -----------------------------------------------------------------------------------------------------

#: Separators that Python takes for white space and the tokenizer may not: such texts are encoded as they are.
ODD = re.compile("[\x1c-\x1f\x85\u180e]").search


class WordEncoder:
    """A `tokenizers` file whose pre-tokenizer drops white space, so that the words of a text are encoded by themselves
    and those seen before come from a bounded table. New words of letters alone are encoded many to a call and told apart
    by their end-of-word tokens; a word of letters with marks at its end is its letters and these marks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        ends = [t.endswith("</w>") for t, _ in sorted(self.lib.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.kept: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _normal(self, word: str) -> str:
        """The word as the tokenizer takes it: a capital may become a letter and a combining mark, which isn't one of the letters."""
        n = self.lib.normalizer
        return word if n is None else n.normalize_str(word)

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> None:
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = np.array(self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):  # not one run of letters each after all
                self.letters.update(zip(part, self._encode(part)))
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, cuts):
                self.letters[w] = raw[4 * a : 4 * b]
                a = b

    def _learn(self, new: set[str]) -> None:
        if len(self.letters) > KEPT_LETTERS:
            self.letters.clear()
        if len(self.marks) > KEPT_LETTERS // 10:
            self.marks.clear()
        letters, marks, kept = self.letters, self.marks, self.kept
        wait, other = [], []
        for w in new:
            core = w.rstrip(MARKS)
            if core.isascii() and core.isalpha() or not core.isascii() and self._normal(core).isalpha():
                mark = w[len(core) :]
                if core in letters and mark in marks:
                    kept[w] = letters[core] + marks[mark]
                else:
                    wait.append((w, core, mark))
            else:
                other.append(w)
        self._encode_letters([c for c in {c for _, c, _ in wait} if c not in letters])
        tails = [m for m in {m for _, _, m in wait} if m not in marks]
        marks.update(zip(tails, self._encode(tails)))
        for w, core, mark in wait:
            kept[w] = letters[core] + marks[mark]
        kept.update(zip(other, self._encode(other)))

    @staticmethod
    def _plain(text: str) -> str:
        """A-Z in lower case, as the tokenizer's own normalizer makes them, unless that could spell a special token."""
        return text if "<|" in text else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")

    def encode_all(self, texts: list[str | None], end_id: int = END_ID) -> list[np.ndarray]:
        split = [[t] if ODD(t) else self._plain(t).split() for t in (x or "" for x in texts)]
        seen = set().union(*split)
        new = seen.difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = seen
        self._learn(new)
        get, end = self.kept.__getitem__, np.array([end_id], np.uint32).tobytes()
        return [np.frombuffer(b"".join([*map(get, words), end]), np.uint32) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- the matrix -------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank, select and access over a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        """planes: from the highest bit, packed little-endian into 64-bit words."""
        self.n, self.planes = n, planes
        # ones before each word: the rank directory, made on load
        self.before = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in planes]
        self.zeros = [n - int(b[-1]) for b in self.before]

    @classmethod
    def of(cls, values: np.ndarray) -> WaveletMatrix:
        n, bits = len(values), max(1, int(values.max()).bit_length()) if len(values) else 1
        planes, v = [], values.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = (v & v.dtype.type(1 << k)) != 0
            packed = np.zeros(-(-n // 64) * 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(one, bitorder="little")
            planes.append(packed.view(np.uint64))
            v = np.concatenate([v[~one], v[one]])
        return cls(n, planes)

    def _ones(self, k: int, i: int) -> int:
        """Ones in plane k before place i."""
        w, r = divmod(i, 64)
        return int(self.before[k][w]) + (int(self.planes[k][w] & np.uint64((1 << r) - 1)).bit_count() if r else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 6]) >> (i & 63) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            b, ones = self._bit(k, i), self._ones(k, i)
            value, i = value << 1 | b, self.zeros[k] + ones if b else i - ones
        return value

    def _range(self, value: int, i: int, j: int) -> tuple[int, int]:
        """Where the occurrences of a value in [i, j) stand after the last plane."""
        if value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, i), self._ones(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if value >> (len(self.planes) - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def rank(self, value: int, i: int) -> int:
        """Occurrences of a value before place i."""
        a, b = self._range(value, 0, i)
        return b - a

    def count(self, value: int, i: int, j: int) -> int:
        a, b = self._range(value, i, j)
        return b - a

    def _select_bit(self, k: int, bit: int, r: int) -> int:
        """Place of the r-th (from 0) bit of this kind in plane k."""
        ones = self.before[k]
        have = ones if bit else np.arange(len(ones), dtype=np.int64) * 64 - ones
        w = int(np.searchsorted(have, r, side="right")) - 1
        word, left = int(self.planes[k][w]) if bit else ~int(self.planes[k][w]), r - int(have[w])
        for b in range(64):
            if word >> b & 1:
                if not left:
                    return w * 64 + b
                left -= 1
        raise IndexError(r)

    def select(self, value: int, r: int) -> int:
        """Place of the r-th (from 0) occurrence of a value."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= r < b - a:
            raise IndexError(r)
        at = a + r
        for k in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - k) & 1
            at = self._select_bit(k, one, at - self.zeros[k] if one else at)
        return at

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        v = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, v.dtype)
            up[~one], up[one] = v[: self.zeros[k]], v[self.zeros[k] :] | v.dtype.type(1 << (len(self.planes) - 1 - k))
            v = up
        return v.astype(np.uint32)


# --- the file ---------------------------------------------------------------------------------------------------


class Shard:
    """Documents (ids, None allowed; end offsets) and the matrix of their tokens."""

    def __init__(self, doc_ids: list[int | None], ends: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.ends, self.matrix = doc_ids, ends, matrix

    @classmethod
    def of(cls, doc_ids: list[int | None], tokens: list[np.ndarray]) -> Shard:
        return cls(doc_ids, np.cumsum([len(t) for t in tokens], dtype=np.int64), WaveletMatrix.of(np.concatenate(tokens)))

    def to_bytes(self) -> bytes:
        ids = np.array([i or 0 for i in self.doc_ids], "<i8").tobytes()
        null = np.packbits([i is None for i in self.doc_ids]).tobytes()
        body = zstandard.compress(b"".join([ids, null, self.ends.astype("<i8").tobytes(), *(p.astype("<u8").tobytes() for p in self.matrix.planes)]), 1)
        return MAGIC + struct.pack("<qqqI", len(self.doc_ids), self.matrix.n, len(self.matrix.planes), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        docs, n, bits, crc = struct.unpack_from("<qqqI", data, len(MAGIC))
        body = data[len(MAGIC) + 28 :]
        if zlib.crc32(body) != crc:
            raise ValueError("damaged token shard")
        raw, at = zstandard.decompress(body), 0

        def take(size: int, kind: str) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, kind, offset=at - size, count=size // np.dtype(kind).itemsize)

        ids, null, ends = take(8 * docs, "<i8"), take(-(-docs // 8), "u1"), take(8 * docs, "<i8")
        words = -(-n // 64)
        planes = [take(8 * words, "<u8") for _ in range(bits)]
        gone = np.unpackbits(null, count=docs).astype(bool).tolist()
        return cls([None if g else i for i, g in zip(ids.tolist(), gone)], ends, WaveletMatrix(n, planes))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the shard, tokens) of each document."""
        values, start = self.matrix.values(), 0
        for i, end in zip(self.doc_ids, self.ends.tolist()):
            yield i, start, values[start:end]
            start = end


# --- Spark ------------------------------------------------------------------------------------------------------

SHARD_SCHEMA = "part int, offset long, n_docs long, n_tokens long, file binary"


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenise the texts and write the shard table to `path`."""
    file = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, offset, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            data = Shard.of(ids, held).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([offset]), pa.array([len(ids)]), pa.array([size]), pa.array([data], pa.binary())], ["part", "offset", "n_docs", "n_tokens", "file"])

        enc = encoder(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for i, tokens in zip(piece.column(0).to_pylist(), enc.encode_all(piece.column(1).to_pylist(), end_id)):
                    ids.append(i)
                    held.append(tokens)
                    size += len(tokens)
                    if size >= shard_tokens:
                        yield shard()
                        offset, ids, held, size = offset + size, [], [], 0
        if ids:
            yield shard()

    n = shuffle_partitions(docs.sparkSession)
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard table with `start`, the tokens of all shards before each."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row per range partition of the writer
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("offset"))


def documents(spark: SparkSession, path: str, tokens: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first = batch.column(0)[k].as_py()
                rows = [(i, first + s, len(t), zlib.crc32(t.astype("<u4").tobytes()), t) for i, s, t in Shard.from_bytes(batch.column(1)[k].as_py()).documents()]
                cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
                if tokens:
                    cols.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if tokens else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return read_shards(spark, path).select("start", "file").mapInArrow(run, schema)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, n) of the documents that hold a token, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard.from_bytes(data.as_py())
                ranks = [0, *(s.matrix.rank(token, int(e)) for e in s.ends)]
                found = [(i, b - a) for i, a, b in zip(s.doc_ids, ranks, ranks[1:]) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["doc_id", "n"])

    return read_shards(spark, path).select("file").mapInArrow(run, "doc_id long, n long")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = shared_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return documents(spark, path)
