"""Queries of the audit engine: each exercises an operator on the star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, host, rules

from . import fact_queries, text_queries
from .oracles import ORACLES

FACT_QUERIES = [*fact_queries.QUERIES, *text_queries.QUERIES]
FACT_SQL = fact_queries.SQL | text_queries.SQL

COL = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, i, t): lines with their number from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("i", COL("i") + 1)


def finding_validate(s, d):
    none = F.lit(None).cast("string")
    f = table(s, d, "documents").select("lang", COL("text").alias("summary"), none.alias("claim"), none.alias("positive_control"))
    ok, bad = host.validate(f, ["zero", "no", "none", "missing", "the", "0"])
    both = ok.select("lang", F.lit(0).alias("b")).unionByName(bad.select("lang", F.lit(1).alias("b")))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("claims"))


def waive_range_join(s, d):
    e = s.createDataFrame([(1, "error", "f", None, 0, 40, "a"), (2, "click", "f", None, 10, 20, "b"), (3, "error", "f", None, 30, 50, "c")], "entry_no int, check string, file string, symbol string, lo int, hi int, reason string")
    f = table(s, d, "events").select("event_id", COL("event_type").alias("check_id"), F.lit("f").alias("file"), F.lit(None).cast("string").alias("subject"), (COL("event_id") % 100).cast("int").alias("line"))
    return host.waive(f, e).filter("reason IS NOT NULL").select("event_id", COL("reason").alias("rs"))


def stale_entries(s, d):
    e = s.createDataFrame([("error", "1"), ("click", "999999"), ("nosuch", "1")], "check string, file string").selectExpr("*", "CAST(NULL AS STRING) symbol", "CAST(NULL AS INT) lo", "CAST(NULL AS INT) hi")
    f = table(s, d, "events").select(COL("event_type").alias("check_id"), COL("user_id").cast("string").alias("file"), F.lit("x").alias("subject"), F.lit(1).alias("line"))
    return host.stale_entries(e, f, e.select(COL("check").alias("check_id"))).select(COL("check").alias("ck"), COL("file").cast("long").alias("u"))


def top_n(s, d):
    return host.top_n(table(s, d, "events").select("event_id", "event_type", "value"), 10, "event_id", [F.desc("value")])


def rule_summary(s, d):
    v, none = COL("value"), F.lit(None).cast("boolean")
    f = table(s, d, "events").select(COL("event_type").alias("check_id"), F.when(v >= 50, "high").when(v >= 10, "medium").when(v < 10, "low").alias("severity"))
    out = host.rule_summary(f, f.limit(0).withColumn("declared_public", none))
    return out.select(COL("check_id").alias("event_type"), COL("findings").alias("n"), "high", COL("medium").alias("med"), "low")


def omitted_by_severity(s, d):
    return host.omitted(table(s, d, "events").select("event_id", "event_type", "value"), 10, "event_id", [F.desc("value")], "event_type")


def mode_tiebreak_outliers(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return rules.mode_outliers(o, "o_custkey", "o_orderkey", "o_orderpriority", COL("o_orderpriority")).select("o_orderkey", "o_orderpriority", "modal")


def distinct_over_limit(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).filter("n > 30")


def nation_edges(s, d, share):
    """Edges between nations of customers and suppliers with the most lines."""
    g = (
        table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), COL("l_orderkey") == COL("o_orderkey"))
        .join(table(s, d, "customer").select("c_custkey", COL("c_nationkey").alias("a")), COL("o_custkey") == COL("c_custkey"))
        .join(table(s, d, "supplier").select("s_suppkey", COL("s_nationkey").alias("b")), COL("l_suppkey") == COL("s_suppkey"))
        .filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    )
    # at most nations x nations rows
    return g.withColumn("pr", F.percent_rank().over(Window.orderBy(F.desc("n"), "a", "b"))).filter(COL("pr") < share).select("a", "b")


def instability(s, d):
    return graph.unstable_dependencies(nation_edges(s, d, 0.15), 0.1)


def reachability_closure(s, d):
    return graph.closure(nation_edges(s, d, 0.08))


def cochange_share(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "part").select("p_partkey", "p_brand"), COL("l_partkey") == COL("p_partkey"))
    return graph.cochange(t.select(COL("l_orderkey").alias("o"), COL("p_brand").alias("f")), 25, 3, 9)


def percentile_outliers(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    q = docs.select(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").alias("p95"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY n_chars)").alias("p99")).first()
    return docs.filter(COL("n_chars") >= q.p95).select("doc_id", "n_chars", F.when(COL("n_chars") >= q.p99, "low").otherwise("info").alias("sev"))


def repeated_literals(s, d):
    return lines_of(table(s, d, "documents")).select("doc_id", F.trim("t").alias("ln")).filter(F.length("ln") >= 2).groupBy("doc_id", "ln").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def islands(s, d):
    order = ["ts", "event_id"]
    g = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    return table(s, d, "events").withColumn("g", g).groupBy("user_id", "event_type", "g").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n >= 3").select("user_id", "event_type", "first_id", "n")


def lookahead(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select("event_id", "event_type", F.lead("event_type", 1).over(w).alias("n1"), F.lead("event_type", 2).over(w).alias("n2"))
    return e.filter("event_type = 'error' AND coalesce(n1, '') <> 'purchase' AND coalesce(n2, '') <> 'purchase'").select("event_id")


def secret_scan(s, d):
    return table(s, d, "documents").select("doc_id", T.secret_count(COL("text")).cast("long").alias("n")).filter("n > 0")


def redact_text(s, d):
    return table(s, d, "documents").filter(COL("text").rlike(r'token\s*=\s*"')).select("doc_id", F.md5(T.redact_keyed(COL("text"))).alias("h"))


def licence_lines(s, d):
    return table(s, d, "documents").filter(COL("text").rlike("(?i)licen[sc]ed? |MIT License")).select("doc_id", T.licence_of(COL("text")).alias("lic"))


def hrefs(s, d, pattern):
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("href"))


def link_extract(s, d):
    return hrefs(s, d, 'href="([^"]*)"')


def dead_local_links(s, d):
    known = table(s, d, "pages").select(F.regexp_replace("url", "^https?://[^/]*", "").alias("href"))
    return hrefs(s, d, 'href="(/[^"]*)"').join(known, "href", "left_anti").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def two_snapshot_growth(s, d):
    li = table(s, d, "lineitem").select(COL("l_partkey").alias("k"), F.year("l_shipdate").alias("y"))
    first = li.agg(F.min("y")).first()[0]
    both = li.filter(COL("y").isin(first, first + 1)).groupBy("k").agg(F.count_if(COL("y") == first).alias("base"), F.count_if(COL("y") == first + 1).alias("head"))
    return both.filter("head - base >= 3 AND (head - base) * 100 > base * 25")


def coverage_join(s, d):
    claims = table(s, d, "labels").select(COL("doc_id").alias("rule"), F.lit(True).alias("proven"))
    j = host.coverage(table(s, d, "documents").select(COL("doc_id").alias("id"), "lang"), claims)
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(COL("state") == "covered").alias("covered")).withColumn("gap", COL("total") - COL("covered"))


def pass_rate(s, d):
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.round(host.pass_rate(F.sum("quality"), F.count(F.lit(1)) - F.sum("quality")), 4).alias("pct"))


def outcome_combine(s, d):
    kind = F.when(COL("o_orderstatus") == "F", "Findings").when(COL("o_orderstatus") == "O", "Clean").otherwise("Skipped")
    o = table(s, d, "orders").select(COL("o_custkey").alias("rule"), kind.alias("kind"), F.lit(1).alias("n"))
    ranks = F.array(*map(F.lit, host.OUTCOMES))
    clean = o.groupBy(COL("rule").alias("r")).agg(F.count_if(COL("kind") == "Clean").alias("c"))
    return host.combine_outcomes(o).join(clean, COL("rule") == COL("r")).select(COL("rule").alias("o_custkey"), F.array_position(ranks, COL("kind")).cast("int").alias("prec"), COL("c").alias("n"))


def undocumented_words(s, d):
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("w"))
    known = words(table(s, d, "documents").filter("lang = 'de'"))
    return words(table(s, d, "benchmark"), "item_id").join(known, "w", "left_anti").groupBy("w").agg(F.min("item_id").alias("first_item"))


def duplicate_definition(s, d):
    t = lines_of(table(s, d, "documents")).filter(F.trim("t") != "")
    rn = F.row_number().over(Window.partitionBy("doc_id", F.lower(F.trim("t"))).orderBy("i"))
    return t.withColumn("rn", rn).filter("rn > 1").select("doc_id", "i")


def advisory_range(s, d):
    a = s.createDataFrame([("1", 1, 10, 9.5), ("2", 5, 30, 7.1), ("3", 1, 50, 4.0)], "tail string, lo int, hi int, score double")
    p = table(s, d, "part").select("p_partkey", "p_size", F.right("p_brand", F.lit(1)).alias("tail"))
    sev = F.when(COL("score") >= 9, "critical").when(COL("score") >= 7, "high").when(COL("score") >= 4, "medium").otherwise("low")
    return p.join(F.broadcast(a), "tail").filter(COL("p_size").between(COL("lo"), COL("hi"))).select("p_partkey", "score", sev.alias("sev"))


def settings_unpivot(s, d):
    flags = F.explode(F.array(F.struct(F.lit("negative").alias("flag"), (COL("s_acctbal") < 0).alias("hit")), F.struct(F.lit("high").alias("flag"), (COL("s_acctbal") > 9000).alias("hit"))))
    return table(s, d, "supplier").select("s_suppkey", flags.alias("f")).select("s_suppkey", "f.flag", "f.hit")


def ignored_vs_total(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return li.groupBy("l_suppkey").agg(F.count_if(COL("l_returnflag") == "R").alias("ignored"), F.count(F.lit(1)).alias("total")).filter("ignored > 0")


def scope_rollup(s, d):
    j = table(s, d, "customer").join(table(s, d, "nation"), COL("c_nationkey") == COL("n_nationkey")).join(table(s, d, "region"), COL("n_regionkey") == COL("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


def position_join(s, d):
    at = table(s, d, "orders").filter("o_orderstatus = 'F'").select(COL("o_orderkey").alias("l_orderkey"), (1 + COL("o_orderkey") % 4).cast("int").alias("l_linenumber"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber").join(at, ["l_orderkey", "l_linenumber"], "left_semi")


def nearest_scope(s, d):
    # the last view at or before each error, as one running value per user: no join of all views with all errors
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(s, d, "events").withColumn("scope", F.max(F.when(COL("event_type") == "view", F.struct("ts", "event_id"))).over(w)["event_id"])
    return e.filter("event_type = 'error' AND scope IS NOT NULL").select("event_id", "scope")


def same_block_order(s, d):
    # for every view: the first error after it, then whether a purchase follows within six hours of the view
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    after = Window.partitionBy("user_id").orderBy(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))")).rangeBetween(1, Window.unboundedFollowing)
    err = e.withColumn("err", F.min(F.when(COL("event_type") == "error", COL("ts"))).over(after))
    last = Window.partitionBy("user_id").orderBy(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))")).rangeBetween(1, 6 * 3600 * 1_000_000 - 1)
    p = err.withColumn("bought", F.max(F.when(COL("event_type") == "purchase", COL("ts"))).over(last))
    return p.filter("event_type = 'view' AND err IS NOT NULL AND bought > err").select("event_id")


def name_convention(s, d):
    return table(s, d, "part").filter(~COL("p_name").rlike("^[a-z]+ [a-z]{4}$")).select("p_partkey", "p_name")


def json_props(s, d):
    k, owner = F.get_json_object("props", "$.k"), F.get_json_object("props", "$.owner")
    return table(s, d, "events").groupBy("event_type").agg(F.max(k.cast("int")).alias("mk"), F.count_if(owner.isNull()).alias("no_owner"))


def adjacent_comment(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-3, 0)
    c = table(s, d, "conversations").withColumn("near", F.max(F.coalesce(COL("text").contains("?"), F.lit(False))).over(w))
    return c.filter("role = 'assistant' AND NOT near").select("conv_id", "turn")


def reciprocal_link(s, d):
    p = table(s, d, "lineitem").filter("l_quantity >= 49").select((COL("l_partkey") % 50).alias("a"), (COL("l_suppkey") % 50).alias("b")).distinct()
    return p.filter("a <> b").join(p.toDF("b", "a"), ["a", "b"], "left_anti")


def member_dedup(s, d):
    return table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))


def reachable_from(s, d):
    return graph.reachable(nation_edges(s, d, 0.08), s.createDataFrame([(0,), (1,)], "v int"))


def strong_components(s, d):
    return graph.strong_components(nation_edges(s, d, 0.2))


def merged_members(s, d):
    o = table(s, d, "orders").select(F.when(COL("o_orderstatus") == "F", host.ALLOWLIST).otherwise("x").alias("check_id"), COL("o_custkey").alias("project"), COL("o_orderpriority").alias("subject"), COL("o_orderstatus").alias("summary"))
    return host.merge_members(o).groupBy("check_id", "project").agg(F.count(F.lit(1)).alias("n"))


def canonical_ids(s, d):
    r = s.createDataFrame([("OPENED", ["view", "click"]), ("FAILED", ["error"])], "id string, aliases array<string>")
    return host.canonical(table(s, d, "events").select("event_id", "event_type"), "event_type", r)


def exit_codes(s, d):
    e = table(s, d, "events").select(COL("event_type").alias("check_id"), F.when(COL("value") >= 50, "high").otherwise("low").alias("severity"))
    none = e.limit(0)
    code = lambda name, *a, **k: host.exit_code(*a, **k).select(F.lit(name).alias("run"), "exit_code")
    runs = [code("high", e, none, "high"), code("critical", e, none, "critical"), code("broken", e, e, "low"), code("floors", e, none, "low", floors={"error": "critical"}, blocking=["click"])]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def fixtures_left_out(s, d):
    p = table(s, d, "part")
    path = F.concat(F.lit("conformance/"), COL("p_brand"), F.lit("/"), COL("p_size").cast("string"), F.lit("/a.rs"))
    fixture = F.concat(F.lit("conformance/"), COL("p_brand"), F.lit("/"), COL("p_size").cast("string"), F.lit("/expect.toml"))
    return host.outside_fixtures(p.select("p_partkey", path.alias("file")), p.filter("p_partkey % 3 = 0").select(fixture.alias("path"))).select("p_partkey")


def set_operators(s, d):
    o = table(s, d, "orders").select(COL("o_custkey").alias("k"))
    c = table(s, d, "customer").select(COL("c_custkey").alias("k"))
    n = c.filter("k % 2 = 0")
    kinds = (("union", o.union(n).distinct()), ("intersect", o.intersect(n)), ("except", c.exceptAll(n).subtract(o)))
    out = None
    for kind, rows in kinds:
        part = rows.select(F.lit(kind).alias("kind"), "k")
        out = part if out is None else out.unionByName(part)
    return out


def dated_waivers(s, d):
    # a waiver of 30 to 400 days from the order's date: too long, expired or live at a given day
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("from_day"), F.date_add(F.to_date("o_orderdate"), (30 + COL("o_orderkey") % 371).cast("int")).alias("until"))
    state = F.when(F.datediff("until", "from_day") > 365, "too long").when(F.lit("1996-01-01").cast("date") >= COL("until"), "expired").otherwise("live")
    return o.select("o_orderkey", state.alias("state"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_summary(spark, sf_dir)


#: In the order of the oracles.
QUERIES = [
    finding_validate, waive_range_join, stale_entries, top_n, rule_summary, omitted_by_severity, mode_tiebreak_outliers, distinct_over_limit, instability, reachability_closure,
    cochange_share, percentile_outliers, repeated_literals, islands, lookahead, secret_scan, redact_text, licence_lines, link_extract, dead_local_links, two_snapshot_growth,
    coverage_join, pass_rate, outcome_combine, undocumented_words, duplicate_definition, advisory_range, settings_unpivot, ignored_vs_total, scope_rollup, position_join,
    nearest_scope, same_block_order, name_convention, json_props, adjacent_comment, reciprocal_link, member_dedup,
    reachable_from, strong_components, merged_members, canonical_ids, exit_codes, fixtures_left_out, set_operators, dated_waivers,
]


def queries() -> dict:
    own = {f"t{k:02d}_{f.__name__}": f for k, f in enumerate(QUERIES, 1)}
    return own | {f"f{k:02d}_{f.__name__}": f for k, f in enumerate(FACT_QUERIES, 1)}


def oracle_sql() -> dict[str, str]:
    known = ORACLES | {f"f{k:02d}_{f.__name__}": FACT_SQL[f.__name__] for k, f in enumerate(FACT_QUERIES, 1)}
    return {k: v for k, v in known.items() if k in queries()}
