"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is halved down to single bytes; encodings of neighbours are joined by encoding
again only a window around their boundary. A window of tokens is final once the token pairs at both its ends are
*stable*: encoding the bytes of the pair gives the pair itself. A sequence whose tokens each encode to themselves and
whose neighbouring pairs are all stable is the one that the merge ranks produce, so nothing outside the window can
change; if an end isn't stable the window grows by one token there and is encoded again. The join is associative with
the empty encoding as unit. Decoding concatenates the bytes of tokens up the same tree.

Encodings of short pieces are kept per Python worker in a table of bounded size; clearing it changes no result.

Cases: null and empty texts give no tokens (and decode to nothing); very long pieces cost O(n log n) joins with small
windows; invalid UTF-8 can't occur in a text column; repeated rows are encoded alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Encodings kept per worker and generation, the longest chunk (characters) worth keeping, and spans and token pairs kept.
KEPT, KEPT_CHARS, KEPT_SPANS = 60_000, 24, 100_000
#: Spans up to LEAF bytes are leaves of the tree, merged directly by rank; spans up to KEPT_PART bytes are kept.
LEAF, KEPT_PART = 4, 8
#: The pattern whose matches never cross from visible characters into white space, so that texts may be cut there.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNKS = re.compile(r"\s*\S+|\s+").findall
SEPARATORS = re.compile("[\x1c-\x1f]").search


class ByteBPE:
    """Encoder over a rank table: {token bytes: rank}; every single byte must be in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.cuts = pattern == CUT_PATTERN
        self.vocab = {r: b for b, r in ranks.items()}
        self.bytes_of = self.vocab.__getitem__
        self.decimal = {r: str(r) for r in self.vocab}.__getitem__
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}, pattern)

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """A leaf: merge the adjacent parts of lowest rank, leftmost first, until none can merge."""
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joined = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while joined and (low := min(joined)) < none:
            i = joined.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i < len(joined):
                joined[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _part(self, piece: bytes) -> tuple[int, ...]:
        """Encoding of a span: two halves, each encoded so, joined. Short spans are kept."""
        n = len(piece)
        if n > KEPT_PART:
            return self.join(self._part(piece[: n // 2]), self._part(piece[n // 2 :]))
        found = self.parts.get(piece)
        if found is None:
            found = self._merge(piece) if n <= LEAF else self.join(self._part(piece[: n // 2]), self._part(piece[n // 2 :]))
            if len(self.parts) >= KEPT_SPANS:
                self.parts.clear()
            self.parts[piece] = found
        return found

    def _pair(self, a: int, b: int) -> tuple[int, ...]:
        """Encoding of the bytes of two tokens; the pair is stable if it is (a, b)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KEPT_SPANS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(self.bytes_of(a) + self.bytes_of(b))
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left + right
        window = self._pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            grown = False
            if i and self._pair(left[i - 1], window[0]) != (left[i - 1], window[0]):
                i, grown = i - 1, True
            if j < len(right) and self._pair(window[-1], right[j]) != (window[-1], right[j]):
                j, grown = j + 1, True
            if not grown:
                return left[:i] + window + right[j:]
            window = self._merge(b"".join(map(self.bytes_of, left[i:] + right[:j])))

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern; a piece that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        return self._part(piece) if whole is None else (whole,)

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a run of white space and the run of other characters after it, each match of the pattern by itself."""
        found = self.kept.get(chunk) or self.older.get(chunk)
        if found is None:
            ids: list[int] = []
            for piece in self.split.findall(chunk):
                ids += self.encode_bytes(piece.encode("utf-8", "surrogatepass"))
            found = tuple(ids)
        if len(chunk) <= KEPT_CHARS:
            # two generations: what was used since the last turn stays
            if len(self.kept) >= KEPT:
                self.older, self.kept = self.kept, {}
            self.kept[chunk] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Tokens of a whole text. No match of the pattern reaches from a visible character over white space, so the
        text may be cut where white space starts, and the pattern runs only over chunks not seen before."""
        text = text or ""
        ids: list[int] = []
        extend = ids.extend
        # Python's \s also holds the separators 1C to 1F, which the pattern takes for visible: no cuts there
        for chunk in CHUNKS(text) if self.cuts and not SEPARATORS(text) else (text,):
            extend(self.kept.get(chunk) or self.encode_chunk(chunk))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token sequence."""
        return b"".join(map(self.bytes_of, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One encoder per Python worker."""
    return ByteBPE.from_file(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _batches(df: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """mapInArrow that hands (id, text) columns of each batch to `make` and returns its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            # few rows at a time, so that long texts and their tokens stay bounded
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(make(part), names)

    names = [c.split()[0] for c in schema.split(", ")]
    return df.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and the token ids (array<int>) of every text."""
    p, pat = default_vocabulary()
    p, pat = path or p, pattern or pat

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        c = codec(p, pat)
        return [part.column(0), pa.array([c.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))]

    kind = dict(docs.dtypes)[id_col]
    return _batches(docs, [id_col, text_col], f"{id_col} {kind}, ids array<int>", make)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and the decoded bytes of every token sequence (null: none)."""
    p, pat = default_vocabulary()
    p, pat = path or p, pattern or pat

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        c = codec(p, pat)
        return [part.column(0), pa.array([c.decode(x or ()) for x in part.column(1).to_pylist()], pa.binary())]

    kind = dict(encoded.dtypes)[id_col]
    return _batches(encoded, [id_col, ids_col], f"{id_col} {kind}, bytes binary", make)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode and return per text n_tokens, ids_sha256 and decoded_sha256; the tokens never leave the task."""
    p, pat = default_vocabulary()
    p, pat = path or p, pattern or pat

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        c = codec(p, pat)
        n, ids_sha, text_sha = [], [], []
        for t in part.column(1).to_pylist():
            ids = c.encode(t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(c.decimal, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]

    kind = dict(docs.dtypes)[id_col]
    return _batches(docs, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digests(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
