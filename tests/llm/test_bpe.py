import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe


@pytest.fixture(scope="module")
def pair():
    c = bpe.codec(*bpe.default_vocabulary())
    return c, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


TEXTS = ["", " ", "\n\n", "a", "it's  a\ttest \n x", "éèà ñ日本語", "<|endoftext|>", "x\x1c y\x1fz", "a b c", "12 345", "=" * 3000, "ab" * 2000, "  lead", "trail  ", "don't we'll"]


def test_same_as_library(pair):
    own, lib = pair
    r = random.Random(3)
    made = ["".join(r.choice(al) for _ in range(n)) for al in ("ab", "aA1. \n", "éèa ñ", "xX_-=", "日本語a") for n in (1, 9, 33, 200, 4000)]
    for t in TEXTS + made:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, t):
    own, lib = pair
    assert own.encode(t) == lib.encode_ordinary(t)


def test_join_is_associative(pair):
    own, _ = pair
    r = random.Random(7)
    for _ in range(200):
        a, b, c = ("".join(r.choice("theinago ") for _ in range(r.randrange(0, 12))).encode() for _ in range(3))
        p, q, s = map(own._part, (a, b, c)) if a and b and c else ((), (), ())
        assert own.join(own.join(p, q), s) == own.join(p, own.join(q, s))


def test_small_tables_change_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "KEPT_SPANS", 3)
    own = bpe.ByteBPE.from_file(*bpe.default_vocabulary())
    for t in TEXTS:
        assert own.encode(t) == pair[1].encode_ordinary(t)


def test_frames(spark, pair):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (3, "a"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in rows:
        ids = pair[1].encode_ordinary(t or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == want
    enc = bpe.encode(docs)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(enc).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    assert bpe.encode(docs.limit(0)).count() == 0 and bpe.digests(docs.limit(0)).count() == 0
