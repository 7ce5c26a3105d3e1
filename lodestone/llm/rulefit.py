"""Quality classifier as a sparse rule ensemble.

Statistics of a text (shares of symbols, capitals, repeated words and lines, and so on) are plain columns. A small forest is grown over
the labelled texts' statistics; every path from a root to a node is a conjunction of bounds, a rule. Rules of the same bounds
count once, and a logistic regression with a lasso penalty weighs them, so that most weigh nothing. What is left compiles into one
Spark column: the sigmoid of the summed weights of the rules that hold. Documents are scored by that column alone.

Only labels and texts enter; lang, source and doc_id are never inputs. At most about MAX_TRAIN labelled rows, picked by a hash of
the id, train the model (a documented bound), one of each different text, so that copies weigh nothing; every document is scored
over its whole text. The score's scale is shifted so that the cut-off with the best balanced accuracy on the training rows
scores CUT.

Cases: null texts are empty; label rows with a null id or label are ignored, of several for one id the smallest counts; without
training rows of both labels every score is that of the only label, 1 or 0, or 0.5 without any; repeated rows score
alike; an empty table gives an empty result; columns of the caller stay, but those named like an added one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of
from .quality import COUNTS, with_counts

#: Expected number of labelled training rows at most.
MAX_TRAIN = 50_000
#: Forest: trees, depth, least rows of a node. Lasso penalty and rounds.
TREES, DEPTH, LEAST_ROWS, PENALTY, ROUNDS = 16, 3, 5, 0.001, 50
SEED = 7
CUT = 0.3
ENDS, PUNCTUATION, BARS, DIGITS = ".!?", ",;:\"'()-", "|", "0123456789"

#: Statistics, in the order of the model's feature numbers.
STATISTICS = [
    "log_words", "mean_word", "symbols", "bars", "exclaims", "ends", "punctuation", "digits", "capitals", "different", "repeated", "repeated_lines", "line_words", "longest",
]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append STATISTICS (doubles, never null) to the rows."""
    own = [c for c in docs.columns if c not in (*STATISTICS, *COUNTS, "n_lines", "_text")]
    t = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(*own, t.alias("_text"))
    count = lambda chars: F.length("_text") - F.length(F.translate("_text", chars, ""))
    held = held.select(
        *own, "_text", words_of(F.col("_text")).alias("_w"), count(BARS).alias("_bars"), count("!").alias("_excl"), count(ENDS).alias("_ends"), count(PUNCTUATION).alias("_punct"), count(DIGITS).alias("_digits"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_caps"),
    )
    extra = ["_bars", "_excl", "_ends", "_punct", "_digits", "_caps"]
    held = held.select(*own, "_text", *extra, F.size(F.array_distinct("_w")).alias("_diff"), F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0)).alias("_longest"))
    counted = with_counts(held, "_text")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    per_word = lambda c: F.col(c) / words
    made = {
        "log_words": F.log2(1.0 + F.col("n_words")), "mean_word": per_word("word_chars"), "symbols": per_word("n_symbols"), "bars": per_word("_bars"), "exclaims": per_word("_excl"),
        "ends": per_word("_ends"), "punctuation": per_word("_punct"), "digits": F.col("_digits") / chars, "capitals": F.col("_caps") / chars, "different": per_word("_diff"),
        "repeated": per_word("n_repeat_words"), "repeated_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "line_words": F.log2(1.0 + F.col("n_words") / F.greatest("n_lines", F.lit(1))),
        "longest": F.log2(1.0 + F.col("_longest")),
    }
    return counted.select(*own, *[made[k].cast("double").alias(k) for k in STATISTICS])


#: A rule: per statistic (above, up to) with None for no bound, by statistic.
Rule = tuple[tuple[str, float | None, float | None], ...]


def holds(rule: Rule) -> Column:
    """The conjunction of a rule's bounds."""
    parts = [F.col(k) > a for k, a, _ in rule if a is not None] + [F.col(k) <= b for k, _, b in rule if b is not None]
    return reduce(lambda x, y: x & y, parts)


@dataclass
class Ensemble:
    """Weighted rules, and the intercept of their sum."""

    weights: dict[Rule, float] = field(default_factory=dict)
    intercept: float = 0.0

    def score(self) -> Column:
        """Over the columns STATISTICS: a number from 0 to 1."""
        total = F.lit(self.intercept)
        for rule, w in self.weights.items():
            total = total + F.when(holds(rule), w).otherwise(0.0)
        return F.lit(1.0) / (1.0 + F.exp(-total))


def paths(root, names: list[str] = STATISTICS) -> set[Rule]:
    """Rules of a tree: one for each node but the root, several bounds on a statistic drawn together."""
    found, todo = set(), [(root, {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            found.add(tuple((k, *bounds[k]) for k in sorted(bounds)))
        if node.subtreeDepth() == 0:
            continue
        split = node.split()
        k, at = names[split.featureIndex()], float(split.threshold())
        above, upto = bounds.get(k, (None, None))
        todo.append((node.leftChild(), bounds | {k: (above, at if upto is None else min(at, upto))}))
        todo.append((node.rightChild(), bounds | {k: (at if above is None else max(at, above), upto)}))
    return found


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """(label, STATISTICS) of one row per different text and label; the picked labels are few enough to broadcast."""
    flat = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    n = max(1, flat.count())
    picked = flat.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_train).select(F.col("doc_id").alias("_id"), "label")
    rows = docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "label", F.xxhash64(text_col).alias("_same"))
    stats = with_statistics(rows).drop("text")
    # rows in a fixed order, so that the forest's samples are the same each time
    return cut(stats.dropDuplicates(["_same", "label"]).repartition(4, "_same").sortWithinPartitions("_same", "label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Ensemble:
    """Learn the ensemble. `labels`: doc_id and quality (0 or 1), training rows only."""
    train = _training(docs, labels, id_col, text_col, max_train)
    sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Ensemble({}, 0.0 if not sizes else math.inf if 1.0 in sizes else -math.inf)
    total = sum(sizes.values())
    balance = F.when(F.col("label") == 1.0, total / (2.0 * sizes[1.0])).otherwise(total / (2.0 * sizes[0.0]))
    weighed = train.select("label", balance.alias("w"), array_to_vector(F.array(*STATISTICS)).alias("x"), *STATISTICS)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="w", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED
    ).fit(weighed)
    rules = sorted(set().union(*(paths(t._call_java("rootNode")) for t in forest.trees)), key=str)
    if not rules:
        return Ensemble({}, math.log(sizes[1.0] / sizes[0.0]))
    ruled = cut(weighed.select("label", "w", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("x")))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", elasticNetParam=1.0, regParam=PENALTY, maxIter=ROUNDS).fit(ruled)
    weights = {r: float(c) for r, c in zip(rules, lasso.coefficients) if c}
    # at most MAX_TRAIN rows, and of them only the different scores
    p1 = vector_to_array("probability")[1]
    seen = lasso.transform(ruled).groupBy(p1.alias("p")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).toPandas()
    at = _best_cut(seen["p"].tolist(), seen["good"].tolist(), seen["n"].tolist())
    return Ensemble(weights, float(lasso.intercept) + math.log(CUT / (1 - CUT)) - math.log(at / (1 - at)))


def _best_cut(p: list[float], good: list[float], n: list[int]) -> float:
    """Between two neighbouring probabilities, the one that tells the labels apart best; of several, across the widest step of
    log-odds."""
    rows = sorted(zip(p, good, n))
    odds = [math.log(max(x, 1e-12) / max(1 - x, 1e-12)) for x, _, _ in rows]
    all_good, all_bad = sum(good), sum(n) - sum(good)
    best, bad_below, good_above = None, 0.0, all_good
    for k, (_, g, m) in enumerate(rows[:-1]):
        bad_below, good_above = bad_below + m - g, good_above - g
        key = (round(bad_below / all_bad + good_above / all_good, 12), odds[k + 1] - odds[k])
        if best is None or key > best[0]:
            best = key, (odds[k] + odds[k + 1]) / 2
    return 1 / (1 + math.exp(-best[1])) if best else 0.5


def score(docs: DataFrame, ensemble: Ensemble, text_col: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= CUT); columns so named are replaced."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    held = docs.select(F.struct(*own).alias("_all"), F.col(text_col).alias("_body"))
    stats = with_statistics(held, "_body").select("_all", ensemble.score().alias("score"))
    return stats.select(*[F.col("_all")[c].alias(c) for c in own], "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    ensemble = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, ensemble).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
