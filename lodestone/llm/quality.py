"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per (lang, source) a mergeable KLL quantile sketch of each feature gives the quartile and the median of the group's
base-passing documents. The upper fence stands at third quartile + SPREADS x (third quartile - median) + slack and the lower
one is its mirror, so the cut-off follows the group and no share of it is dropped by design: a group in which a quarter
of the documents has many symbols keeps them, and one that has none meets the slack. Groups with fewer than `min_rows`
documents use the sketch merged over their language, and languages with fewer use the sketch merged over all.

Cases: null text has no words and fails the base rule; null lang or source form groups of their own; repeated rows are
judged alike; an empty table gives an empty result; filter_quality() keeps the rows as they are, whatever the names of extra
columns; with_counts() and judge() replace columns named like those they add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, stored, words_of

SYMBOLS = "#*$%&|<>"
#: Spread multiples, and per feature the least distance of a fence from the quartile.
SPREADS = 6.0
SLACK = {"mean_word": 1.0, "symbol_ratio": 0.1, "dup_line_ratio": 0.4, "repeat_ratio": 0.3}
#: Features that also have a lower fence.
TWO_SIDED = ("mean_word",)
MIN_ROWS = 200
SKETCH_K = 4096
#: The thresholds are broadcast when they have at most this many groups, else joined by shuffle.
BROADCAST_GROUPS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the five base counts (long) to the rows. Arrays stay in their own projections, so each is made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in (*COUNTS, "n_lines")]
    base = docs.select(*own, words_of(F.col(text)).alias("_words"), F.filter(F.split(t, "\n"), lambda x: F.translate(x, " " + WHITE, "") != "").alias("_lines"))
    n = F.size("_words")
    base = base.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.translate(t, " " + WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))").alias("_win"),
    )
    kept = [*own, *COUNTS[:4], "n_lines"]
    base = base.select(*kept, F.expr("if(size(_win) = size(array_distinct(_win)), array(), sort_array(transform(_win, (h, i) -> struct(h AS h, i AS i))))").alias("_at"))
    # start positions of windows that occur twice or more, in order
    base = base.select(*kept, F.expr("sort_array(transform(filter(_at, (x, k) -> x.h <=> get(_at, k - 1).h OR x.h <=> get(_at, k + 1).h), x -> x.i))").alias("_pos"))
    covered = F.expr("aggregate(transform(_pos, (p, k) -> least(3, coalesce(get(_pos, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    return base.select(*kept, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / words,
    }


def fit_thresholds(counts: DataFrame, min_rows: int = MIN_ROWS, k: int = SKETCH_K) -> DataFrame:
    """One row per (lang, source): lo_<feature> and hi_<feature>. `counts` has the columns of with_counts(), cut or
    stored: a filter must not reach into the projections that make them."""
    names = list(SLACK)
    f = features()
    sound = counts.filter(~base_failed()).select("lang", "source", *[f[x].alias(x) for x in names])
    # kept sketches: they merge with those of later batches as they merge here upward
    groups = cut(sound.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(x, F.lit(k)).alias(x) for x in names]))

    by_lang = groups.groupBy(F.col("lang").alias("l_key")).agg(F.sum("n").alias("l_n"), *[F.kll_merge_agg_double(x).alias(f"l_{x}") for x in names])
    wide = groups.join(by_lang, groups["lang"].eqNullSafe(by_lang["l_key"]), "left")
    whole = groups.agg(*[F.kll_merge_agg_double(x).alias(x) for x in names]).first()  # one row of sketches, bounded by k
    out = [F.col("lang"), F.col("source")]
    for x in names:
        sketch = F.when(F.col("n") >= min_rows, F.col(x)).when(F.col("l_n") >= min_rows, F.col(f"l_{x}")).otherwise(F.lit(whole[x]).cast("binary"))
        q = lambda p, s=sketch: F.kll_sketch_get_quantile_double(s, F.lit(p))
        out.append(F.struct(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3")).alias(x))
    fitted = wide.select(*out)
    cols = [F.col("lang"), F.col("source")]
    for x in names:
        hi = F.col(f"{x}.q3") + SPREADS * (F.col(f"{x}.q3") - F.col(f"{x}.q2")) + SLACK[x]
        lo = F.col(f"{x}.q1") - SPREADS * (F.col(f"{x}.q2") - F.col(f"{x}.q1")) - SLACK[x] if x in TWO_SIDED else F.lit(float("-inf"))
        cols += [lo.alias(f"lo_{x}"), hi.alias(f"hi_{x}")]
    return cut(fitted.select(*cols))


def judge(counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Append base_failed and kept. A group without any base-passing document has no thresholds and keeps nothing."""
    names, own = list(SLACK), [c for c in counts.columns if c not in ("base_failed", "kept")]
    t = thresholds.select(F.col("lang").alias("_tl"), F.col("source").alias("_ts"), *[c for c in thresholds.columns if c[:3] in ("lo_", "hi_")])
    t = t.select(*[F.col(c).alias(c if c in ("_tl", "_ts") else f"_{c}") for c in t.columns])
    if thresholds.count() <= BROADCAST_GROUPS:
        t = F.broadcast(t)
    joined = counts.select(*own).join(t, F.col("lang").eqNullSafe(F.col("_tl")) & F.col("source").eqNullSafe(F.col("_ts")), "left")
    f = features()
    inside = F.lit(True)
    for x in names:
        inside = inside & (f[x] <= F.col(f"_hi_{x}")) & (f[x] >= F.col(f"_lo_{x}"))
    # not a conjunction: a filter on it would be split, and its base part pushed into the projections that make the counts,
    # where each array would be made again for every reference
    kept = F.least(~base_failed(), F.coalesce(inside, F.lit(False)))
    return joined.select(*own, base_failed().alias("base_failed"), kept.alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of `docs`. Counts are made once and stored beside the rows, since the
    thresholds come from all of them; texts aren't shuffled."""
    counted = stored(with_counts(docs.select(F.struct(*docs.columns).alias("_all"), "text", "lang", "source")).drop("text"), "counted")
    thresholds = fit_thresholds(counted.drop("_all"))
    return judge(counted, thresholds).filter("kept").select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = cut(with_counts(docs).drop("text"))
    return judge(counts, fit_thresholds(counts)).select("doc_id", *COUNTS, "base_failed", "kept", "lang", "source")


ORACLE_SQL = r"""
WITH c AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, ws,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents, c),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS win FROM p),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
v AS (SELECT r, count(DISTINCT i + o.k)::BIGINT AS n FROM m, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
b AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN v USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, word_chars / greatest(n_words, 1)::DOUBLE AS f1,
    n_symbols / greatest(n_words, 1)::DOUBLE AS f2, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS f3, n_repeat_words / greatest(n_words, 1)::DOUBLE AS f4 FROM b),
s AS (SELECT * FROM f WHERE NOT base_failed),
ga AS (SELECT lang, source, count(*) AS n, quantile_disc(f1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(f2, [0.25, 0.5, 0.75]) AS q2, quantile_disc(f3, [0.25, 0.5, 0.75]) AS q3, quantile_disc(f4, [0.25, 0.5, 0.75]) AS q4 FROM s GROUP BY ALL),
la AS (SELECT lang, count(*) AS n, quantile_disc(f1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(f2, [0.25, 0.5, 0.75]) AS q2, quantile_disc(f3, [0.25, 0.5, 0.75]) AS q3, quantile_disc(f4, [0.25, 0.5, 0.75]) AS q4 FROM s GROUP BY ALL),
wa AS (SELECT count(*) AS n, quantile_disc(f1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(f2, [0.25, 0.5, 0.75]) AS q2, quantile_disc(f3, [0.25, 0.5, 0.75]) AS q3, quantile_disc(f4, [0.25, 0.5, 0.75]) AS q4 FROM s),
t AS (SELECT ga.lang AS tl, ga.source AS ts,
    CASE WHEN ga.n >= 200 THEN ga.q1 WHEN la.n >= 200 THEN la.q1 ELSE wa.q1 END AS a, CASE WHEN ga.n >= 200 THEN ga.q2 WHEN la.n >= 200 THEN la.q2 ELSE wa.q2 END AS b,
    CASE WHEN ga.n >= 200 THEN ga.q3 WHEN la.n >= 200 THEN la.q3 ELSE wa.q3 END AS c, CASE WHEN ga.n >= 200 THEN ga.q4 WHEN la.n >= 200 THEN la.q4 ELSE wa.q4 END AS e
  FROM ga JOIN la ON ga.lang IS NOT DISTINCT FROM la.lang, wa)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(f1 <= a[3] + 6.0 * (a[3] - a[2]) + 1.0 AND f1 >= a[1] - 6.0 * (a[2] - a[1]) - 1.0
    AND f2 <= b[3] + 6.0 * (b[3] - b[2]) + 0.1 AND f3 <= c[3] + 6.0 * (c[3] - c[2]) + 0.4 AND f4 <= e[3] + 6.0 * (e[3] - e[2]) + 0.3, false) AS kept,
  lang, source
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM tl AND f.source IS NOT DISTINCT FROM ts
"""
