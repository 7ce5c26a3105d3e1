import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import wavelet as w


@pytest.mark.parametrize("n,top", [(1, 1), (5, 2), (64, 9), (65, 300), (5000, 49408)])
def test_matrix(n, top):
    v = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = w.WaveletMatrix.of(v)
    assert m.values().tolist() == v.tolist()
    for i in {0, n // 2, n - 1}:
        assert m.access(i) == v[i]
    for x in {int(v[0]), int(v[-1]), top + 5}:
        at = np.flatnonzero(v == x)
        assert m.rank(x, n) == len(at) and m.count(x, n // 3, n) == (at >= n // 3).sum()
        assert [m.select(x, r) for r in range(min(5, len(at)))] == at[:5].tolist()
        with pytest.raises(IndexError):
            m.select(x, len(at))


def test_file():
    s = w.Shard.of([5, None, 7], [np.array([3, 1], np.uint32), np.array([1], np.uint32), np.array([9, 9, 1], np.uint32)])
    data = s.to_bytes()
    got = [(i, a, t.tolist()) for i, a, t in w.Shard.from_bytes(data).documents()]
    assert got == [(5, 0, [3, 1]), (None, 2, [1]), (7, 3, [9, 9, 1])]
    with pytest.raises(ValueError):
        w.Shard.from_bytes(data[:-1] + b"x")


def test_encoder_same_as_library():
    lib = Tokenizer.from_file(w.default_tokenizer())
    texts = ["", "Hello  World's\n\tends", "ÀÉ ñ 日本 x\x1cy \x85 z", "é ́a", "<|endoftext|>a", "a" * 3000, "İΣΑΣ ß 12 3.4", "nb\xa0sp x"]
    got = w.WordEncoder(w.default_tokenizer()).encode_all([*texts, None])
    assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids + [1] for t in [*texts, ""]]


def test_round_trip(spark, tmp_path):
    lib = Tokenizer.from_file(w.default_tokenizer())
    rows = [(i, "word %d of the text" % i * (i % 7)) for i in range(200, 0, -1)] + [(7, "again"), (7, "again"), (500, None), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS start")
    path = str(tmp_path / "s")
    w.write_shards(docs, path, shard_tokens=60)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in w.documents(spark, path, tokens=True).collect())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    token = lib.encode("word", add_special_tokens=False).ids[0]
    found = {(r.doc_id, r.n) for r in w.occurrences(spark, path, token).collect()}
    assert found == {(i, ids.count(token)) for _, i, _, _, ids in want if token in ids}
    empty = str(tmp_path / "e")
    w.write_shards(docs.limit(0), empty)
    assert w.documents(spark, empty).count() == 0
