import hashlib
import os

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from lodestone.llm import bpe, simhash
from lodestone.llm.common import stored
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute_components

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    columns, frames = docs.columns, [docs]
    for name, stage in cp.STAGES:
        frames.append(stored(stage(spark, frames[-1], D), "t-" + name))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near-duplicates", "mixing", "encoding"]
    rows = [{r.doc_id: r.asDict() for r in f.collect()} for f in frames]
    for f, r in zip(frames[:-1], rows[:-1]):
        assert f.columns == columns and f.count() == len(r)
    for a, b in zip(rows[:4], rows[1:5]):  # rows go whole or stay as they are
        assert all(a[i] == r for i, r in b.items())
    assert all(a.keys() >= b.keys() for a, b in zip(rows, rows[1:]))
    # toxicity: no clean labelled document goes
    gone = rows[0].keys() - rows[1].keys()
    assert not any(labels[i].toxic == 0 for i in gone if i in labels)
    # quality: what fails the base rule goes, what is labelled good and passes it stays
    for i, r in rows[1].items():
        n, _, _, _, again = brute_counts(r["text"])
        base = n < 50 or 100 * again > 50 * n
        assert not (base and i in rows[2])
        if not base and i in labels and labels[i].quality == 1:
            assert i in rows[2]
    # near-duplicates: the smallest id of every component stays; of texts that share 0.8 of their five-word shingles, one
    ids = sorted(rows[2])
    prints = [sum(int(w) << (64 * k) for k, w in enumerate(simhash.simhash(rows[2][i]["text"], 5, 4)[::-1])) for i in ids]
    label = brute_components(prints, 51)
    assert {ids[k] for k in set(label)} <= rows[3].keys()
    words = {i: rows[2][i]["text"].lower().split() for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    close = {b for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(close & rows[3].keys()) <= 0.05 * len(close)
    # mixing: good documents stay
    for i in rows[3]:
        if i in labels and labels[i].quality == 1 and labels[i].toxic == 0:
            assert i in rows[4]
    # encoding
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(*bpe.default_vocabulary()).ranks, special_tokens={})
    assert rows[5].keys() == rows[4].keys()
    for i, r in rows[5].items():
        ids = enc.encode_ordinary(rows[4][i]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][i]["text"].encode()).hexdigest()


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rate string"
    odd = spark.createDataFrame([(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (2, "", "en", "s", 0, "b"), (None, "word " * 60, "en", "s", 300, "c")], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (odd, odd.limit(0)):
        docs = frame
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= 0 and "n_tokens" in docs.columns
