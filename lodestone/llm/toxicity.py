"""Toxicity from a weighted lexicon that Aho-Corasick matches in folded texts.

Folding (the same native columns for training and scoring) lower-cases, maps homoglyphs of other scripts, full-width letters
and digit or symbol substitutions to one letter each (i and l fold together, since 1 stands for both), drops invisible
characters and turns punctuation and white space into single-character gaps.

The lexicon is learned from labelled documents: smoothed log-odds of a term's document counts, for whole words and for word
stems that stay nearly pure over many words. On the toxic side no word counts more documents than it has different
surroundings, so that a text with thousands of copies weighs as one. Phrases of a term and a neighbour that occur mostly in clean documents become
exceptions: they are patterns of weight 0, and the longest match at a place wins. The sum of weights is normalised by
length, and the scale is set so that the cut-off with the best F1 on the training rows scores 0.3.

Only the labels and the texts enter; lang, source and doc_id are never inputs. At most about MAX_TRAIN labelled rows, picked
by a hash of the id, train the lexicon (a documented bound); every document is scored over its whole text. Terms and exceptions
have no bound of their own: all that pass are in the lexicon, whose size follows from the training rows.

Cases: null and empty texts score 0; label rows with a null id or label are ignored, of several for one id the largest
counts; without any toxic training row the lexicon is empty and every score 0; repeated rows score alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Expected number of labelled training rows at most.
MAX_TRAIN = 50_000
#: Least toxic surroundings of a word and of a stem, words of a stem, and pseudo-documents of smoothing.
LEAST_WORD, LEAST_STEM, STEM_WORDS, SMOOTH = 5, 8, 4, 4.0
#: Least weight of a candidate, and of a term once its exceptions are known; share of clean documents that makes a phrase an exception, and its least clean documents.
LEAST_CANDIDATE, LEAST_WEIGHT, EXCEPTION_SHARE, LEAST_EXCEPTION = 0.5, 1.5, 0.8, 5
STEM_LENGTHS = (4, 5, 6)
CUT = 0.3

#: Look-alikes, by the letter they stand for.
HOMOGLYPHS = {
    "a": "аαɑ4@ａ", "b": "вβ8ｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еε3ｅё", "f": "ｆ", "g": "ɡ9ｇ", "h": "һнｈ",
    "i": "іιı1lӏⅼⅰｉｌ", "j": "јｊ", "k": "кκｋ", "m": "мｍ", "n": "ηｎ", "o": "оοσ0ｏ", "p": "рρｐ", "q": "ԛｑ",
    "r": "гｒ", "s": "ѕ5$ｓ", "t": "тτ7ｔ", "u": "υｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
GAPS = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*#%&|/\\-_+=~`^«»“”‘’„…–—·¡¿\xa0"
INVISIBLE = "​‌‍⁠﻿\xad"


def folded(text: Column) -> Column:
    """Folded text; every run of gaps is at least one space."""
    before = "".join(HOMOGLYPHS.values()) + GAPS
    after = "".join(k * len(v) for k, v in HOMOGLYPHS.items()) + " " * len(GAPS)
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), before + INVISIBLE, after)


@dataclass
class Lexicon:
    """Patterns over gap-doubled text with their weights (0: exception), and the length-normalised sum that scores CUT."""

    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0

    def matcher(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for pattern, w in self.weights.items():
            auto.add_word(pattern, (pattern, w))
        if len(auto):
            auto.make_automaton()
        return auto

    @staticmethod
    def spread(text: str) -> str:
        """Words with a gap of two spaces, so that neighbouring matches don't share one."""
        return " " + "  ".join(text.split()) + " "

    @staticmethod
    def norm(n_words: int) -> float:
        return 1.0 + math.log2(1.0 + n_words / 200.0) / 4.0

    def raw(self, auto, text: str) -> float:
        """Length-normalised sum of the weights of the longest matches."""
        if not len(auto):
            return 0.0
        wide = self.spread(text)
        return sum(w for _, (_, w) in auto.iter_long(wide)) / self.norm(wide.count("  ") + 1)

    def score(self, raw: float) -> float:
        return raw / (raw + self.scale * (1 - CUT) / CUT) if raw > 0 else 0.0


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """(text, toxic) of the training rows; the picked labels are few enough to broadcast."""
    flat = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, flat.count())
    picked = flat.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_train).select(F.col("doc_id").alias("_id"), "toxic")
    return docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id")).select(folded(F.col(text_col)).alias("text"), "toxic")


def _log_odds(tox: int, clean: int, n_tox: int, n_clean: int) -> float:
    return math.log((tox + 0.5) / (n_tox + 1.0)) - math.log((clean + SMOOTH) / (n_clean + 1.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Lexicon:
    """Learn the lexicon. `labels`: doc_id and toxic (0 or 1), training rows only."""
    train = _labelled(docs, labels, id_col, text_col, max_train)
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tox, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_tox:
        return Lexicon()
    # toxic side: in how many different surroundings a word stands, so that copies of one text count once
    listed = train.filter("toxic = 1").select(F.array_remove(F.split("text", " "), "").alias("w"))
    placed = listed.select(F.expr("explode(transform(w, (x, i) -> struct(x AS word, xxhash64(get(w, i - 1), get(w, i + 1)) AS ctx)))").alias("o")).select("o.*").distinct()
    spread = placed.groupBy("word").agg(F.count(F.lit(1)).alias("places"))
    within = listed.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    bad = within.join(spread, "word").select("word", F.least("docs", "places").alias("tox"))
    stem_of = F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_LENGTHS])).alias("term")
    bad_stems = bad.select(stem_of, "tox").filter("term IS NOT NULL").groupBy("term").agg(F.sum("tox").alias("tox"), F.count(F.lit(1)).alias("many"))
    bad_words = bad.filter(F.col("tox") >= LEAST_WORD).select(F.col("word").alias("term"), "tox", F.lit(False).alias("stem"))
    bad_stems = bad_stems.filter((F.col("tox") >= LEAST_STEM) & (F.col("many") >= STEM_WORDS)).select("term", "tox", F.lit(True).alias("stem"))
    # clean side: documents of a word, summed for a stem over its words
    clean_words = train.filter("toxic = 0").select(F.explode(F.array_distinct(F.array_remove(F.split("text", " "), ""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("clean"))
    shapes = F.explode(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem")), *[F.struct(F.when(F.length("word") > k, F.substring("word", 1, k)).alias("term"), F.lit(True).alias("stem")) for k in STEM_LENGTHS])).alias("s")
    clean = clean_words.select(shapes, "clean").select("s.*", "clean").filter("term IS NOT NULL").groupBy("term", "stem").agg(F.sum("clean").alias("clean"))
    weighed = bad_words.unionByName(bad_stems).join(clean, ["term", "stem"], "left").select("term", "stem", "tox", F.coalesce("clean", F.lit(0)).alias("clean"))
    weighed = weighed.filter(~F.col("stem") | (F.col("clean") * 50 <= F.col("tox")))
    tox, clean = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)
    # every candidate is weighed; only those that pass reach the driver, so ordinary words take nobody's place
    odds = F.log((F.col("tox") + 0.5) / (n_tox + 1.0)) - F.log((F.col("clean") + SMOOTH) / (n_clean + 1.0))
    terms = weighed.filter(odds >= LEAST_CANDIDATE).collect()
    short = {r.term for r in terms if r.stem}
    # a word under a stem is covered by it, and so is a longer stem
    free = [r for r in terms if not any(r.term[:k] in short for k in STEM_LENGTHS if k < len(r.term))]
    counts = {" " + r.term + " " * (not r.stem): (r.tox, r.clean) for r in free}
    lexicon = Lexicon(dict.fromkeys(counts, 1.0))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.matcher()
        for batch in batches:
            found, base, flags = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wide, seen = Lexicon.spread(text), set()
                for end, (pattern, _) in auto.iter_long(wide):
                    start = end - len(pattern) + 1
                    stop = wide.find(" ", end if pattern[-1] == " " else end + 1)  # the gap after the word
                    after = wide.find(" ", stop + 2)
                    if after > 0:
                        seen.add((wide[start : after + 1], pattern))
                    before = wide.rfind(" ", 0, max(0, start - 1))
                    if start > 1 and before >= 0:
                        seen.add((wide[before : stop + 1], pattern))
                found += [f for f, _ in seen]
                base += [b for _, b in seen]
                flags += [toxic] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(base, pa.string()), pa.array(flags, pa.int32())], ["phrase", "term", "toxic"])

    if not counts:
        return Lexicon()
    seen = train.select("text", F.col("toxic").cast("int")).mapInArrow(phrases, "phrase string, term string, toxic int").groupBy("phrase", "term").agg(tox.alias("tox"), clean.alias("clean"))
    safe = seen.filter((F.col("clean") >= LEAST_EXCEPTION) & (F.col("clean") >= EXCEPTION_SHARE * (F.col("clean") + F.col("tox"))))
    exceptions = safe.orderBy(F.desc("clean"), "phrase", "term").collect()
    # what an exception explains no longer counts against its term; a phrase before and one after may share documents
    excused = dict.fromkeys(counts, 0)
    for r in exceptions:
        excused[r.term] = max(excused[r.term], r.clean)
    weights = {t: _log_odds(a, max(0, b - excused[t]), n_tox, n_clean) for t, (a, b) in counts.items()}
    lexicon.weights = {t: w for t, w in weights.items() if w >= LEAST_WEIGHT}
    lexicon.weights |= {r.phrase: 0.0 for r in exceptions if r.term in lexicon.weights}
    sums = train.select(_raw(lexicon)(F.col("text")).alias("x"), "toxic").groupBy("x").agg(F.sum("toxic").alias("sum"), F.count(F.lit(1)).alias("count"))
    lexicon.scale = _best_cut(sums.filter("x > 0").toPandas(), n_tox)  # a row per different sum, MAX_TRAIN at most
    return lexicon


def _best_cut(sums: pd.DataFrame, n_tox: int) -> float:
    """The cut-off between two neighbouring raw sums (columns x, sum of toxic and count of training rows) with the best F1."""
    if not len(sums):
        return 1.0
    by = sums.set_index("x").sort_index(ascending=False)
    hit, said = by["sum"].cumsum(), by["count"].cumsum()
    f1 = 2 * hit / (said + n_tox)
    k = int(f1.to_numpy().argmax())
    low = by.index[k + 1] if k + 1 < len(by) else 0.0
    return float((by.index[k] + low) / 2)


def _raw(lexicon: Lexicon):
    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = lexicon.matcher()
        for texts in batches:
            yield pd.Series([lexicon.raw(auto, t) for t in texts], dtype="float64")
        del auto
        give_back()

    return raw


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= CUT) to the rows of `docs`; columns so named are replaced."""
    own = [c for c in docs.columns if c not in ("score", "predicted", "_raw")]
    x = F.col("_raw")
    scored = docs.select(*own, _raw(lexicon)(folded(F.col(text_col))).alias("_raw"))
    value = F.when(x > 0, x / (x + lexicon.scale * (1 - CUT) / CUT)).otherwise(0.0)
    return scored.select(*own, value.alias("score"), (value >= CUT).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of `docs`."""
    lexicon = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs.select(F.struct(*docs.columns).alias("_all"), "text"), lexicon).filter("predicted = 0").select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    lexicon = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
