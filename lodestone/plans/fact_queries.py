"""Queries of the rules over fact tables: columns of the star-schema tables stand for the facts, and each rule is the library's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import facts, host, rules

from .oracles import ORACLES

COL = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(df: DataFrame, **columns) -> DataFrame:
    """Columns by name: a Column, a SQL expression, or None for an empty one; repo is `r` unless given."""
    columns = {"repo": "'r'", **columns}
    return df.select(*((F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()))


def bool_params(s, d):
    p = rows(table(s, d, "lineitem"), path="'a'", line="l_orderkey", fn="l_orderkey", name="l_linenumber", type="if(l_returnflag = 'R', 'bool', 'u8')")
    return facts.bool_params(p).select("line", "summary")


def wide_functions(s, d):
    p = rows(table(s, d, "lineitem"), path="'a'", line="l_orderkey", fn="l_orderkey")
    return facts.wide_functions(p).select("line", "summary")


def complexity(s, d):
    i = rows(table(s, d, "events").filter("event_type = 'error'"), path="'a'", line="user_id", fn="user_id", amount="event_id % 7")
    return facts.complexity(i).select("line", "severity", "summary")


def string_chains(s, d):
    return facts.string_chains(rows(table(s, d, "lineitem"), path="'a'", line="l_partkey", literal="l_returnflag")).select("line", "summary")


def unjustified_sites(s, d):
    e = table(s, d, "events")
    at = dict(path="CAST(user_id % 5 AS STRING)", line="event_id")
    sites, notes = rows(e.filter("event_type = 'error'"), fn="user_id", subject="event_type", **at), rows(e.filter("event_type = 'purchase'"), **at)
    return valid(*(facts.unjustified_sites(sites, notes, check) for check in facts.SITES))


def valid(*found: DataFrame) -> DataFrame:
    """What the host accepts of findings."""
    return host.validate(reduce(DataFrame.unionByName, found))[0].select("check_id", "project", "file", "line", "severity", "confidence", "subject", "summary")


def unjustified_per_package(s, d):
    e = table(s, d, "events")
    at = dict(path="'a'", line="event_id")
    sites, notes = rows(e.filter("event_type = 'error'"), package="user_id", **at), rows(e.filter("event_type = 'purchase'"), **at)
    return valid(facts.unjustified_per(sites, notes, "CON-010"))


def guards_across_awaits(s, d):
    e = table(s, d, "events")
    g = rows(e.filter("event_type = 'view'"), path="'a'", line="event_id", fn="user_id", guard="'g'", start="event_id", stop="event_id + 40")
    return facts.guards_across_awaits(g, rows(e.filter("event_type = 'error'"), path="'a'", fn="user_id", seq="event_id")).select("check_id", "line", "severity", "confidence", "subject", "summary")


def late_releases(s, d):
    kind = "CASE event_type WHEN 'view' THEN 'bind' WHEN 'error' THEN 'exit' WHEN 'purchase' THEN 'release' END"
    return valid(facts.late_releases(rows(table(s, d, "events"), path="'a'", fn="user_id", block="user_id", seq="event_id", line="event_id", kind=kind, name="event_id % 3")))


def single_implementations(s, d):
    t = rows(table(s, d, "part"), package="'p'", path="'a'", line="p_partkey", trait="p_partkey")
    i = rows(table(s, d, "lineitem").filter("l_quantity >= 49"), package="'p'", trait="l_partkey", is_test="l_returnflag = 'R'")
    return valid(facts.single_implementations(t, i, rows(table(s, d, "part").filter("p_size = 1"), package="'p'", trait="p_partkey")))


def _tests(s, d):
    return rows(
        table(s, d, "orders"), path="'a'", line="o_orderkey", test="o_orderkey", n_stmts="o_orderkey % 4", n_calls="o_custkey % 3", n_asserts="o_orderkey % 3", n_tautologies="o_custkey % 2",
        expectations="o_orderkey % 7", times="o_orderkey % 5",
    )


def empty_tests(s, d):
    return facts.empty_tests(_tests(s, d)).select("line", "confidence", "summary")


def over_mocked(s, d):
    return facts.over_mocked(_tests(s, d)).select("line", "summary")


def undeclared_components(s, d):
    c = rows(table(s, d, "customer"), repo="c_nationkey", path="'a'", component="c_custkey", purpose="if(c_acctbal < 0, NULL, 'p')", owner="if(c_mktsegment = 'BUILDING', ' ', 'o')")
    return valid(facts.undeclared_components(c))


def drift(s, d):
    at = lambda y: table(s, d, "lineitem").filter(F.year("l_shipdate") == y).groupBy(F.lit("r").alias("repo"), COL("l_partkey").alias("member")).agg(F.count_if(COL("l_returnflag") == "R").alias("cycles"), F.count(F.lit(1)).alias("surface"))
    return valid(facts.drift(at(1996), at(1997), items=3))


def _attrs(s, d, year):
    return rows(table(s, d, "orders").filter(F.year("o_orderdate") == year), repo="o_custkey % 50", path="o_orderpriority", line="o_orderkey", lint="o_orderstatus", reason="if(o_orderstatus = 'O', 'why', ' ')")


def bare_suppressions(s, d):
    return valid(facts.bare_suppressions(_attrs(s, d, 1996))).select("line", "subject")


def suppression_ratchet(s, d):
    return valid(facts.suppression_ratchet(_attrs(s, d, 1996), _attrs(s, d, 1997)))


def waiver_ratchet(s, d):
    return valid(facts.waiver_ratchet(_attrs(s, d, 1996), _attrs(s, d, 1997)))


def unused_dependencies(s, d):
    p = table(s, d, "part")
    deps = rows(p, package="p_partkey % 10", path="'a'", line="p_partkey", name="p_name")
    return facts.unused_dependencies(deps, rows(p.filter("p_size > 40"), package="p_partkey % 10", token="upper(p_name)")).select("line", "subject", "confidence")


def _edges(s, d, share):
    from .registry import nation_edges

    return rows(nation_edges(s, d, share), a="CAST(a AS STRING)", b="CAST(b AS STRING)")


def layer_violations(s, d):
    n = table(s, d, "nation")
    members = rows(n, member="CAST(n_nationkey AS STRING)", component="if(n_nationkey = 24, NULL, concat('c', n_regionkey))", layer="if(n_regionkey = 2, NULL, n_regionkey)")
    allow = s.createDataFrame([("r", "c0", "c3"), ("r", "1", "c2")], "repo string, a string, b string")
    waivers = s.createDataFrame([("r", "c1", "c4", "2027-01-01"), ("r", "c0", "c4", "2020-01-01")], "repo string, a string, b string, until string").withColumn("until", F.to_date("until"))
    return facts.layer_violations(_edges(s, d, 0.5), members, allow, waivers, F.lit("2026-01-01").cast("date")).select("subject", "severity", "confidence", "summary")


def component_cycles(s, d):
    edges = rows(table(s, d, "lineitem").filter("l_quantity >= 40"), repo="l_partkey", a="concat('v', l_suppkey % 7)", b="concat('v', l_linenumber)")
    # a depth-first set has no SQL: where no one edge is enough, only that is compared
    return facts.component_cycles(edges).select("project", "subject", "summary", "confidence", F.when(COL("detail").startswith("removing any"), COL("detail")).alias("detail"))


def entangled_modules(s, d):
    p, li = table(s, d, "part"), table(s, d, "lineitem")
    e = rows(p, a="p_brand", b="concat('Brand#', 1 + p_size % 25, '::x')")
    touched = rows(li, o="l_orderkey", at="l_orderkey", f="l_partkey")
    return facts.entangled_modules(e, rows(p, m="p_brand", f="p_partkey"), touched, least=3, share=4).select("a", "b", "both", "either", F.get("sample", F.lit(0)).alias("newest"))


def advisories(s, d):
    known = s.createDataFrame([("e", "A", "g1", "2.0.0", "10.0.0", 9.5), ("e", "B", "g2", None, "30.0.0", 7.1), ("e", "A", "g3", "9.0.0", None, None), ("e", "A", "g1", "5.0.0", "10.0.0", 2.0)], "ecosystem string, name string, `group` string, introduced string, fixed string, score double")
    p = rows(table(s, d, "part"), path="CAST(p_partkey AS STRING)", ecosystem="'e'", name="if(p_partkey % 2 = 0, 'A', 'B')", version="concat(p_size, '.0.0')")
    return facts.advisories(p, known).select("file", "subject", "summary", "severity")


def unused_returns(s, d):
    li = table(s, d, "lineitem")
    diags = li.select(F.when(COL("l_returnflag") == "R", "ignored").otherwise("used").alias("kind"), COL("l_suppkey").alias("id"), F.concat(F.lit("f"), "l_linenumber").alias("file"), COL("l_partkey").alias("line"), F.lit(1).alias("col"))
    tags = table(s, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS fn", "'f1' AS file", "s_suppkey * 10 AS line", "2 AS col", "s_suppkey * 10 + 5 AS last_line", "0 AS last_col")
    return facts.unused_returns(diags, tags, s.createDataFrame([("f2", 1, 20), ("f2", 15, 30)], "file string, first long, last long"))


def size_outliers(s, d):
    f = rows(table(s, d, "orders"), path="CAST(o_orderkey AS STRING)", code_lines="o_orderkey % 3000", fan_out="o_custkey % 20", fan_in="o_orderkey % 11")
    t = rows(table(s, d, "part"), path="'a'", line="p_partkey", type="p_brand", fields="p_size", methods="p_partkey % 4")
    return facts.size_outliers(f, t).select("file", "line", "severity", "summary")


def unstable_edges(s, d):
    volatile = rows(table(s, d, "supplier"), repo="s_suppkey", component="concat('v', s_suppkey % 7)")
    edges = rows(table(s, d, "lineitem").filter("l_quantity >= 45"), repo="l_partkey", a="concat('v', l_suppkey % 7)", b="concat('v', l_linenumber)")
    return facts.unstable_edges(edges, volatile, 0.1).select("project", "subject")


def lock_cycles(s, d):
    g = rows(table(s, d, "events").filter("value > 100"), package="user_id % 20", path="'a'", fn="user_id", lock="event_type", start="event_id", stop="event_id + 200")
    return facts.lock_cycles(g).groupBy("subject", "summary").agg(F.count(F.lit(1)).alias("n"))


def perf_exceptions(s, d):
    text = "CASE event_type WHEN 'error' THEN '! PERF-EXCEPTION: slow' WHEN 'purchase' THEN 'see benches/a.rs' WHEN 'view' THEN 'plain' END"
    c = rows(table(s, d, "events").filter("event_type IN ('error', 'purchase', 'view')"), path="CAST(event_id % 4 AS STRING)", line="event_id div 4", text=text)
    return facts.perf_exceptions(c).select("file", "line", "summary")


def untyped_errors(s, d):
    ret = "concat('Result<', p_type, if(p_partkey % 2 = 0, ', ', ','), CASE p_size % 3 WHEN 0 THEN 'String>' WHEN 1 THEN 'Box<dyn Error>>' ELSE 'MyError>' END)"
    return facts.untyped_errors(rows(table(s, d, "part"), path="'a'", line="p_partkey", fn="p_name", is_pub="p_retailprice > 950", ret=ret)).select("line", "subject", "confidence")


def missing_locks(s, d):
    p = table(s, d, "part")
    home = "concat('g', p_partkey % 40, '/m', p_partkey, '/')"
    files = rows(p, path=f"concat({home}, 'Cargo.toml')", text="if(p_size % 2 = 0, '[package]\\n[[bin]]', '[package]')")
    files = files.unionByName(rows(p.filter("p_size % 3 = 0"), path=f"concat({home}, 'src/main.rs')", text="''")).unionByName(rows(p.filter("p_partkey < 40 AND p_size > 25"), path="concat('g', p_partkey, '/Cargo.lock')", text="''"))
    return rules.missing_locks(files).select("file")


def glob_waivers(s, d):
    e = s.createDataFrame([(1, "e", "./Brand#1*/**", None, None, None, "wide"), (2, "e", "Brand#2/ECONOMY/?", None, None, None, "one digit"), (3, "x", "**", None, None, None, "other")], "entry_no int, check string, file string, symbol string, lo int, hi int, reason string")
    f = table(s, d, "part").select("p_partkey", F.lit("e").alias("check_id"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("file"), F.lit(None).cast("string").alias("subject"), F.lit(1).alias("line"))
    return host.waive(f, host.expand_globs(e, f)).filter("reason IS NOT NULL").select("p_partkey", "reason")


QUERIES = [
    bool_params, wide_functions, complexity, string_chains, unjustified_sites, unjustified_per_package, guards_across_awaits, late_releases, single_implementations, empty_tests, over_mocked,
    undeclared_components, drift, bare_suppressions, suppression_ratchet, waiver_ratchet, unused_dependencies, layer_violations, component_cycles, entangled_modules, advisories, unused_returns, size_outliers, unstable_edges,
    lock_cycles, perf_exceptions, untyped_errors, missing_locks, glob_waivers,
]

_EDGES = "g AS (SELECT c_nationkey a, s_nationkey b, count(*) n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2), e AS (SELECT a,b FROM (SELECT *, percent_rank() OVER (ORDER BY n DESC, a, b) pr FROM g WHERE a<>b) WHERE pr<{share})"

#: DuckDB SQL by name of the query.
SQL = {
    "bool_params": "SELECT CAST(l_orderkey AS INT) line, count(*) || ' bare bool parameters' summary FROM lineitem WHERE l_returnflag='R' GROUP BY l_orderkey HAVING count(*)>=2",
    "wide_functions": "SELECT CAST(l_orderkey AS INT) line, count(*) || ' parameters' summary FROM lineitem GROUP BY l_orderkey HAVING count(*)>7",
    "complexity": "SELECT CAST(user_id AS INT) line, CASE WHEN sum(event_id%7)>30 THEN 'medium' ELSE 'low' END severity, 'cognitive complexity ' || CAST(sum(event_id%7) AS BIGINT) summary FROM events WHERE event_type='error' GROUP BY user_id HAVING sum(event_id%7)>15",
    "string_chains": "SELECT CAST(l_partkey AS INT) line, 'branches on string literals: ' || count(DISTINCT l_returnflag) summary FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag)>=3",
    "unjustified_sites": "WITH k(check_id,severity,ab,nm) AS (VALUES ('CON-005','medium',3,2),('ERR-001','medium',3,0),('ERR-011','medium',3,2),('EFX-007','low',1,1)) SELECT check_id, 'r' project, CAST(user_id%5 AS VARCHAR) file, CAST(event_id AS INT) line, severity, 'medium' confidence, CASE nm WHEN 0 THEN 'r' WHEN 1 THEN (user_id%5) || ':' || event_type ELSE (user_id%5) || ':' || user_id || ':' || event_type END subject, 'no comment gives a reason' summary FROM events s, k WHERE event_type='error' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type='purchase' AND c.user_id%5=s.user_id%5 AND c.event_id BETWEEN s.event_id-ab AND s.event_id)",
    "unjustified_per_package": "SELECT 'CON-010' check_id, 'r' project, 'a' file, 'low' severity, 'low' confidence, CAST(user_id AS VARCHAR) subject, CAST(min(event_id) AS INT) line, 'sites without a reason: ' || count(*) summary FROM events s WHERE event_type='error' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type='purchase' AND c.event_id BETWEEN s.event_id-3 AND s.event_id) GROUP BY user_id",
    "guards_across_awaits": "SELECT 'CON-002' check_id, CAST(event_id AS INT) line, 'medium' severity, 'medium' confidence, 'a:' || user_id || ':g' subject, 'held across an await: g' summary FROM events g WHERE event_type='view' AND EXISTS (SELECT 1 FROM events a WHERE a.event_type='error' AND a.user_id=g.user_id AND a.event_id>g.event_id AND a.event_id<=g.event_id+40)",
    "late_releases": "SELECT 'ERR-007' check_id, 'r' project, 'a' file, CAST(event_id AS INT) line, 'medium' severity, 'low' confidence, 'a:' || user_id || ':' || (event_id%3) subject, 'released after an early exit: ' || (event_id%3) summary FROM (SELECT *, (SELECT max(event_id) FROM events e WHERE e.user_id=r.user_id AND e.event_type='error' AND e.event_id<r.event_id) ex, (SELECT max(event_id) FROM events b WHERE b.user_id=r.user_id AND b.event_type='view' AND b.event_id%3=r.event_id%3 AND b.event_id<r.event_id) bi FROM events r WHERE event_type='purchase') WHERE ex>bi",
    "single_implementations": "SELECT 'EXT-007' check_id, 'r' project, 'a' file, CAST(p_partkey AS INT) line, 'low' severity, 'low' confidence, CAST(p_partkey AS VARCHAR) subject, 'one implementation and no test double' summary FROM part JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity>=49 GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag<>'R')=1 AND count(*) FILTER (WHERE l_returnflag='R')=0) i ON l_partkey=p_partkey WHERE p_size<>1",
    "empty_tests": "SELECT *, CASE WHEN summary='it calls nothing' THEN 'medium' ELSE 'high' END confidence FROM (SELECT CAST(o_orderkey AS INT) line, CASE WHEN o_orderkey%4=0 THEN 'it is empty' WHEN o_orderkey%3>0 AND o_custkey%2=o_orderkey%3 THEN 'its assertions always hold' WHEN o_custkey%3=0 THEN 'it calls nothing' END summary FROM orders) WHERE summary IS NOT NULL",
    "over_mocked": "SELECT CAST(o_orderkey AS INT) line, (o_orderkey%7) || ' expectations, ' || (o_orderkey%3) || ' assertions' summary FROM orders WHERE (o_orderkey%7>=4 AND o_orderkey%7>=4*greatest(o_orderkey%3,1)) OR (o_orderkey%5>=3 AND o_orderkey%3=0)",
    "undeclared_components": "SELECT 'DOC-003' check_id, CAST(c_nationkey AS VARCHAR) project, 'a' file, CAST(NULL AS INT) line, 'low' severity, 'high' confidence, 'a: ' || c_custkey || ': ' || lacks subject, 'no ' || replace(lacks, '+', ' and no ') summary FROM (SELECT *, CASE WHEN c_acctbal>=0 THEN 'owner' WHEN c_mktsegment<>'BUILDING' THEN 'purpose' ELSE 'purpose+owner' END lacks FROM customer) WHERE (c_acctbal<0 OR c_mktsegment='BUILDING') AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal>=0 OR c_mktsegment<>'BUILDING')",
    "drift": "WITH p AS (SELECT l_partkey m, count(*) FILTER (WHERE year(l_shipdate)=1996 AND l_returnflag='R') bc, count(*) FILTER (WHERE year(l_shipdate)=1996) bs, count(*) FILTER (WHERE year(l_shipdate)=1997 AND l_returnflag='R') hc, count(*) FILTER (WHERE year(l_shipdate)=1997) hs FROM lineitem GROUP BY 1) SELECT 'ARC-009' check_id, 'r' project, CAST(NULL AS VARCHAR) file, CAST(NULL AS INT) line, 'low' confidence, m || ':cycles' subject, 'low' severity, 'cycles: ' || bc || ' to ' || hc summary FROM p WHERE bs>0 AND hs>0 AND hc>bc UNION ALL SELECT 'ARC-009', 'r', NULL, NULL, 'low', m || ':surface', 'info', 'surface: ' || bs || ' to ' || hs FROM p WHERE bs>0 AND hs-bs>=3 AND (hs-bs)*100>bs*25",
    "bare_suppressions": "SELECT CAST(o_orderkey AS INT) line, o_orderstatus subject FROM orders WHERE year(o_orderdate)=1996 AND o_orderstatus<>'O'",
    "suppression_ratchet": "WITH p AS (SELECT o_custkey%50 r, o_orderpriority f, count(*) FILTER (WHERE year(o_orderdate)=1996) b, count(*) FILTER (WHERE year(o_orderdate)=1997) h FROM orders WHERE o_orderstatus<>'O' GROUP BY 1,2) SELECT 'GOV-010' check_id, CAST(r AS VARCHAR) project, min(f) FILTER (WHERE h>b) file, CAST(NULL AS INT) line, 'medium' severity, 'high' confidence, 'suppression-count' subject, 'suppressions without a reason: ' || CAST(sum(b) AS BIGINT) || ' to ' || CAST(sum(h) AS BIGINT) summary FROM p GROUP BY r HAVING sum(h)>sum(b)",
    "waiver_ratchet": "WITH b AS (SELECT o_custkey%50 r, count(*) n FROM orders WHERE year(o_orderdate)=1996 GROUP BY 1), h AS (SELECT o_custkey%50 r, o_orderpriority f, o_orderkey l, row_number() OVER (PARTITION BY o_custkey%50 ORDER BY o_orderpriority, o_orderkey) k FROM orders WHERE year(o_orderdate)=1997) SELECT 'architecture-ratchet' check_id, CAST(r AS VARCHAR) project, f file, CAST(l AS INT) line, 'medium' severity, 'high' confidence, 'architecture-waiver-count' subject, 'more waivers than the base''s ' || coalesce(n,0) summary FROM h LEFT JOIN b USING (r) WHERE k=coalesce(n,0)+1",
    "unused_dependencies": "SELECT CAST(p_partkey AS INT) line, (p_partkey%10) || ':' || p_name subject, 'low' confidence FROM part p WHERE NOT EXISTS (SELECT 1 FROM part t WHERE t.p_size>40 AND t.p_partkey%10=p.p_partkey%10 AND t.p_name=p.p_name)",
    "layer_violations": "WITH " + _EDGES.format(share=0.5) + ", m AS (SELECT n_nationkey k, CASE WHEN n_nationkey<>24 THEN 'c' || n_regionkey END c, CASE WHEN n_regionkey<>2 THEN n_regionkey END l FROM nation) SELECT a || '->' || b subject, 'low' severity, 'high' confidence, CASE WHEN x.l IS NULL THEN x.c || ' is outside the layers' WHEN y.l IS NULL THEN y.c || ' is outside the layers' ELSE 'layer ' || x.l || ' depends on layer ' || y.l END summary FROM e JOIN m x ON x.k=a JOIN m y ON y.k=b WHERE x.c<>y.c AND (x.l IS NULL OR y.l IS NULL OR x.l<y.l) AND NOT (x.c='c0' AND y.c='c3') AND NOT (a=1 AND y.c='c2') AND NOT (x.c='c1' AND y.c='c4') UNION ALL SELECT 'unplaced:24', 'info', 'high', 'placed outside the declaration'",
    "component_cycles": "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey r, 'v' || (l_suppkey%7) a, 'v' || l_linenumber b FROM lineitem WHERE l_quantity>=40 AND l_suppkey%7<>l_linenumber), t(r,a,b) AS (SELECT * FROM e UNION SELECT t.r,t.a,e.b FROM t JOIN e ON t.r=e.r AND t.b=e.a), s AS (SELECT x.r, x.a v, min(x.b) c FROM t x JOIN t y ON x.r=y.r AND x.a=y.b AND x.b=y.a GROUP BY 1,2), i AS (SELECT e.r, p.c, e.a, e.b FROM e JOIN s p ON p.r=e.r AND p.v=e.a JOIN s q ON q.r=e.r AND q.v=e.b AND p.c=q.c), w(r,c,xa,xb,a,b) AS (SELECT x.r, x.c, x.a, x.b, y.a, y.b FROM i x JOIN i y ON x.r=y.r AND x.c=y.c AND NOT (x.a=y.a AND x.b=y.b) UNION SELECT w.r,w.c,w.xa,w.xb,w.a,y.b FROM w JOIN i y ON w.r=y.r AND w.c=y.c AND w.b=y.a WHERE NOT (w.xa=y.a AND w.xb=y.b)), d AS (SELECT r, c, string_agg(a || ' -> ' || b, ', ' ORDER BY a, b) g FROM i WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.r=i.r AND w.c=i.c AND w.xa=i.a AND w.xb=i.b AND w.a=w.b) GROUP BY 1,2) SELECT CAST(s.r AS VARCHAR) project, string_agg(v, ',' ORDER BY v) subject, 'a cycle of ' || count(*) || ' components' summary, 'high' confidence, 'removing any one of these edges dissolves it: ' || min(g) detail FROM s LEFT JOIN d ON d.r=s.r AND d.c=s.c GROUP BY s.r, s.c",
    "entangled_modules": "WITH e AS (SELECT DISTINCT p_brand a, 'Brand#' || (1+p_size%25) b FROM part WHERE p_brand<>'Brand#' || (1+p_size%25)), p AS (SELECT e.a, e.b FROM e JOIN e x ON x.a=e.b AND x.b=e.a WHERE e.a<e.b), c AS (SELECT l_orderkey o FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey)<=25), m AS (SELECT DISTINCT l_orderkey o, p_brand m FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_orderkey IN (SELECT o FROM c)), t AS (SELECT a, b, o, count(*)=2 both_ FROM p JOIN m ON m.m=a OR m.m=b GROUP BY 1,2,3) SELECT a, b, count(*) FILTER (WHERE both_) \"both\", count(*) \"either\", max(o) FILTER (WHERE both_) newest FROM t GROUP BY 1,2 HAVING count(*) FILTER (WHERE both_)>=3 AND count(*) FILTER (WHERE both_)*100>=count(*)*4",
    "advisories": "WITH k(name,grp,lo,hi,score) AS (VALUES ('A','g1',2,10,9.5),('B','g2',0,30,7.1),('A','g3',9,1000,NULL)), p AS (SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN 'A' ELSE 'B' END name, p_size FROM part) SELECT CAST(p_partkey AS VARCHAR) file, name || '@' || p_size || '.0.0' subject, grp summary, CASE WHEN score>=9 THEN 'critical' ELSE 'high' END severity FROM p JOIN k USING (name) WHERE p_size>=lo AND p_size<hi",
    "unused_returns": "WITH d AS (SELECT DISTINCT l_returnflag='R' ign, l_suppkey id, l_linenumber f, l_partkey l FROM lineitem), c AS (SELECT d.*, s_name fn FROM d JOIN supplier ON id=s_suppkey WHERE NOT (f=1 AND l>s_suppkey*10 AND l<s_suppkey*10+5) AND (ign OR NOT (f=2 AND l BETWEEN 1 AND 30))) SELECT id, fn, count(*) FILTER (WHERE ign) ignored, greatest(count(*) FILTER (WHERE NOT ign), count(*) FILTER (WHERE ign)) total FROM c GROUP BY 1,2 HAVING count(*) FILTER (WHERE ign)>0",
    "size_outliers": "SELECT * FROM (SELECT CAST(o_orderkey AS VARCHAR) file, CAST(NULL AS INT) line, CASE WHEN o_orderkey%3000>=2234 AND (o_custkey%20>=7 OR o_orderkey%11>=6) THEN 'low' ELSE 'info' END severity, CASE WHEN o_orderkey%3000>=2234 AND (o_custkey%20>=7 OR o_orderkey%11>=6) THEN 'size and coupling' WHEN o_orderkey%3000>=1035 THEN 'size' WHEN o_custkey%20>=14 THEN 'coupling' END summary FROM orders) WHERE summary IS NOT NULL UNION ALL SELECT 'a', CAST(p_partkey AS INT), 'info', (p_size+p_partkey%4) || ' members' FROM part WHERE p_size+p_partkey%4>=30 AND p_partkey%4>0",
    "unstable_edges": "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey r, 'v' || (l_suppkey%7) a, 'v' || l_linenumber b FROM lineitem WHERE l_quantity>=45 AND l_suppkey%7<>l_linenumber), t(r,a,b) AS (SELECT * FROM e UNION SELECT t.r,t.a,e.b FROM t JOIN e ON t.r=e.r AND t.b=e.a), i AS (SELECT r, k, sum(o)/count(*) v FROM (SELECT r, a k, 1 o FROM e UNION ALL SELECT r, b, 0 FROM e) GROUP BY 1,2) SELECT CAST(e.r AS VARCHAR) project, e.a || '->' || e.b subject FROM e JOIN i x ON x.r=e.r AND x.k=e.a JOIN i y ON y.r=e.r AND y.k=e.b WHERE y.v-x.v+1e-9>=0.1 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey=e.r AND 'v' || (s_suppkey%7)=e.b) AND NOT EXISTS (SELECT 1 FROM t WHERE t.r=e.r AND t.a=e.b AND t.b=e.a)",
    "lock_cycles": "WITH RECURSIVE g AS (SELECT user_id%20 p, user_id u, event_type l, event_id s FROM events WHERE value>100), e AS (SELECT DISTINCT x.p, x.l a, y.l b FROM g x JOIN g y ON x.u=y.u AND y.s>x.s AND y.s<x.s+200), r(p,a,b) AS (SELECT p,a,b FROM e WHERE a<>b UNION SELECT r.p,r.a,e.b FROM r JOIN e ON r.p=e.p AND r.b=e.a WHERE e.a<>e.b), c AS (SELECT x.p, x.a v, min(x.b) k FROM r x JOIN r y ON x.p=y.p AND x.a=y.b AND x.b=y.a GROUP BY 1,2), f AS (SELECT string_agg(v, ' <-> ' ORDER BY v) subject, 'a cycle of ' || count(*) || ' locks' summary FROM c GROUP BY p, k UNION ALL SELECT a, 'taken again while held' FROM e WHERE a=b) SELECT subject, summary, count(*) n FROM f GROUP BY 1,2",
    "perf_exceptions": "WITH l AS (SELECT event_id%4 f, event_id//4 n, event_type k FROM events WHERE event_type IN ('error','purchase','view')) SELECT CAST(f AS VARCHAR) file, CAST(min(n) AS INT) line, 'excuses for slow code without a benchmark: ' || count(*) summary FROM l x WHERE k='error' AND NOT EXISTS (SELECT 1 FROM l c WHERE c.f=x.f AND c.k='purchase' AND c.n BETWEEN x.n+1 AND x.n+2 AND NOT EXISTS (SELECT 1 FROM l m WHERE m.f=x.f AND m.k='error' AND m.n=x.n+1 AND c.n=x.n+2)) GROUP BY f",
    "untyped_errors": "SELECT CAST(p_partkey AS INT) line, 'a:' || p_name || ':' || p_partkey subject, 'medium' confidence FROM part WHERE p_retailprice>950 AND p_size%3<2",
    "missing_locks": "SELECT 'g' || (p_partkey%40) || '/m' || p_partkey || '/Cargo.toml' file FROM part WHERE (p_size%2=0 OR p_size%3=0) AND p_partkey%40 NOT IN (SELECT p_partkey FROM part WHERE p_partkey<40 AND p_size>25)",
    "glob_waivers": "SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'wide' ELSE 'one digit' END reason FROM part WHERE p_brand LIKE 'Brand#1%' OR (p_brand='Brand#2' AND p_type='ECONOMY' AND p_size<10)",
}
