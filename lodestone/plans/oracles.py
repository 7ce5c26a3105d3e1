"""DuckDB SQL of the queries in registry.py."""

ORACLES = {
    "t01_finding_validate": r"""SELECT lang, count(*) n, count(*) FILTER (WHERE regexp_matches(lower(text), '(^|\s)[^a-z0-9]*(zero|no|none|missing|the|0)[^a-z0-9]*(\s|$)')) claims FROM documents GROUP BY lang""",
    "t02_waive_range_join": r"""WITH e(ck,lo,hi,rs) AS (VALUES ('error',0,40,'a'),('click',10,20,'b'),('error',30,50,'c')), f AS (SELECT event_id, event_type ck, CAST(event_id%100 AS INT) ln FROM events), m AS (SELECT f.*, e.rs, row_number() OVER (PARTITION BY event_id ORDER BY rs) rn FROM f JOIN e ON f.ck=e.ck AND f.ln BETWEEN e.lo AND e.hi) SELECT event_id, rs FROM m WHERE rn=1""",
    "t03_stale_entries": r"""WITH e(ck,u) AS (VALUES ('error',1),('click',999999),('nosuch',1)) SELECT e.* FROM e ANTI JOIN events v ON e.ck=v.event_type AND e.u=v.user_id""",
    "t04_top_n": r"""SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10""",
    "t05_rule_summary": r"""SELECT event_type, count(*) n, count(*) FILTER (WHERE value>=50) high, count(*) FILTER (WHERE value<50 AND value>=10) med, count(*) FILTER (WHERE value<10) low FROM events GROUP BY event_type""",
    "t06_omitted_by_severity": r"""WITH r AS (SELECT event_type, row_number() OVER (ORDER BY value DESC, event_id) rn FROM events) SELECT event_type, count(*) n FROM r WHERE rn>10 GROUP BY event_type""",
    "t07_mode_tiebreak_outliers": r"""WITH c AS (SELECT o_custkey, o_orderpriority p, count(*) n FROM orders GROUP BY 1,2), m AS (SELECT o_custkey, p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p DESC) rn FROM c) WHERE rn=1) SELECT o.o_orderkey, o.o_orderpriority, m.p AS modal FROM orders o JOIN m USING (o_custkey) WHERE o.o_orderpriority<>m.p""",
    "t08_distinct_over_limit": r"""SELECT l_partkey, count(DISTINCT l_suppkey) n FROM lineitem GROUP BY 1 HAVING n>30""",
    "t09_instability": r"""WITH g AS (SELECT c_nationkey a, s_nationkey b, count(*) n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2), e AS (SELECT a,b FROM (SELECT *, percent_rank() OVER (ORDER BY n DESC, a, b) pr FROM g WHERE a<>b) WHERE pr<0.15), d AS (SELECT k, sum(ce) ce, sum(ca) ca FROM (SELECT a k, 1 ce, 0 ca FROM e UNION ALL SELECT b,0,1 FROM e) GROUP BY k), i AS (SELECT k, ce/(ca+ce) v FROM d) SELECT e.a, e.b, y.v-x.v margin FROM e JOIN i x ON x.k=e.a JOIN i y ON y.k=e.b WHERE y.v-x.v+1e-9>=0.1""",
    "t10_reachability_closure": r"""WITH RECURSIVE g AS (SELECT c_nationkey a, s_nationkey b, count(*) n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2), e AS (SELECT a,b FROM (SELECT *, percent_rank() OVER (ORDER BY n DESC, a, b) pr FROM g WHERE a<>b) WHERE pr<0.08), r(a,b) AS (SELECT a,b FROM e UNION SELECT r.a,e.b FROM r JOIN e ON r.b=e.a) SELECT a,b FROM r""",
    "t11_cochange_share": r"""WITH t AS (SELECT DISTINCT l_orderkey o, p_brand f FROM lineitem JOIN part ON l_partkey=p_partkey), k AS (SELECT o FROM t GROUP BY o HAVING count(*)<=25), s AS (SELECT f, count(*) n FROM t SEMI JOIN k USING (o) GROUP BY f), p AS (SELECT x.f a, y.f b, count(*) nb FROM t x JOIN t y ON x.o=y.o AND x.f<y.f SEMI JOIN k ON x.o=k.o GROUP BY 1,2) SELECT a,b,nb, s1.n+s2.n-nb ne FROM p JOIN s s1 ON s1.f=a JOIN s s2 ON s2.f=b WHERE nb>=3 AND nb*100>=(s1.n+s2.n-nb)*9""",
    "t12_percentile_outliers": r"""WITH q AS (SELECT quantile_disc(n_chars,0.95) p95, quantile_disc(n_chars,0.99) p99 FROM documents) SELECT doc_id, n_chars, CASE WHEN n_chars>=p99 THEN 'low' ELSE 'info' END sev FROM documents, q WHERE n_chars>=p95""",
    "t13_repeated_literals": r"""SELECT doc_id, trim(ln) ln, count(*) n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) ln FROM documents) WHERE length(trim(ln))>=2 GROUP BY 1,2 HAVING n>=3""",
    "t14_islands": r"""WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-row_number() OVER (PARTITION BY user_id,event_type ORDER BY ts,event_id) g FROM events) SELECT user_id, event_type, min(event_id) first_id, count(*) n FROM s GROUP BY user_id,event_type,g HAVING n>=3""",
    "t15_lookahead": r"""SELECT event_id FROM (SELECT event_id, event_type, lead(event_type,1) OVER w n1, lead(event_type,2) OVER w n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts,event_id)) WHERE event_type='error' AND coalesce(n1,'')<>'purchase' AND coalesce(n2,'')<>'purchase'""",
    "t16_secret_scan": r"""SELECT doc_id, len(regexp_extract_all(text,'(?i)(token|secret|password|api_?key)\s*[:=]\s*"?[A-Za-z0-9+/_.=-]{32,}')) n FROM documents WHERE n>0""",
    "t17_redact_text": r"""SELECT doc_id, md5(regexp_replace(text,'(token\s*=\s*")[^"]*(")','\1<redacted>\2','g')) h FROM documents WHERE regexp_matches(text,'token\s*=\s*"')""",
    "t18_licence_lines": r"""SELECT doc_id, CASE WHEN contains(text,'MIT License') THEN 'MIT' WHEN contains(text,'Apache License') THEN 'Apache-2.0' WHEN contains(text,'GNU General Public') THEN 'GPL-3.0' ELSE 'other' END lic FROM documents WHERE regexp_matches(text,'(?i)licen[sc]ed? |MIT License')""",
    "t19_link_extract": r"""SELECT page_id, unnest(regexp_extract_all(html,'href="([^"]*)"',1)) href FROM pages""",
    "t20_dead_local_links": r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html,'href="(/[^"]*)"',1)) href FROM pages) SELECT page_id, href, count(*) n FROM l ANTI JOIN (SELECT regexp_replace(url,'^https?://[^/]*','') p FROM pages) u ON l.href=u.p GROUP BY 1,2""",
    "t21_two_snapshot_growth": r"""WITH b AS (SELECT l_partkey k, count(*) n FROM lineitem WHERE year(l_shipdate)=(SELECT min(year(l_shipdate)) FROM lineitem) GROUP BY 1), h AS (SELECT l_partkey k, count(*) n FROM lineitem WHERE year(l_shipdate)=(SELECT min(year(l_shipdate))+1 FROM lineitem) GROUP BY 1) SELECT coalesce(b.k,h.k) k, coalesce(b.n,0) base, coalesce(h.n,0) head FROM b FULL JOIN h ON b.k=h.k WHERE coalesce(h.n,0)-coalesce(b.n,0)>=3 AND (coalesce(h.n,0)-coalesce(b.n,0))*100>coalesce(b.n,0)*25""",
    "t22_coverage_join": r"""SELECT lang, count(*) total, count(l.doc_id) covered, count(*)-count(l.doc_id) gap FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""",
    "t23_pass_rate": r"""SELECT source, round(sum(quality)*100.0/count(*),4) pct FROM labels JOIN documents USING (doc_id) GROUP BY source""",
    "t24_outcome_combine": r"""SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) prec, count(*) FILTER (WHERE o_orderstatus='O') n FROM orders GROUP BY 1""",
    "t25_undocumented_words": r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text),'[a-z]{6,}')) w FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text),'[a-z]{6,}')) w FROM documents WHERE lang='de') SELECT w.w, min(item_id) first_item FROM w ANTI JOIN d USING (w) GROUP BY 1""",
    "t26_duplicate_definition": r"""WITH l AS (SELECT doc_id, unnest(string_split(text,chr(10))) t, generate_subscripts(string_split(text,chr(10)),1) i FROM documents) SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, lower(trim(t)) ORDER BY i) rn FROM l WHERE trim(t)<>'') WHERE rn>1""",
    "t27_advisory_range": r"""WITH a(brand_like,lo,hi,score) AS (VALUES ('%1',1,10,9.5::DOUBLE),('%2',5,30,7.1::DOUBLE),('%3',1,50,4.0::DOUBLE)) SELECT p_partkey, score, CASE WHEN score>=9 THEN 'critical' WHEN score>=7 THEN 'high' WHEN score>=4 THEN 'medium' ELSE 'low' END sev FROM part JOIN a ON p_brand LIKE brand_like AND p_size BETWEEN lo AND hi""",
    "t28_settings_unpivot": r"""SELECT s_suppkey, unnest(['negative','high']) flag, unnest([s_acctbal<0, s_acctbal>9000]) hit FROM supplier""",
    "t29_ignored_vs_total": r"""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag='R') ignored, count(*) total FROM (SELECT DISTINCT l_suppkey,l_orderkey,l_linenumber,l_returnflag FROM lineitem) GROUP BY 1 HAVING ignored>0""",
    "t30_scope_rollup": r"""SELECT r_name, n_name, count(*) n FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ROLLUP(r_name,n_name)""",
    "t31_position_join": r"""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l SEMI JOIN (SELECT o_orderkey k, CAST(1+o_orderkey%4 AS INT) ln FROM orders WHERE o_orderstatus='F') d ON l.l_orderkey=d.k AND l.l_linenumber=d.ln""",
    "t32_nearest_scope": r"""WITH s AS (SELECT user_id, ts st, event_id sid FROM events WHERE event_type='view') SELECT e.event_id, max_by(s.sid, s.st) scope FROM events e JOIN s ON s.user_id=e.user_id AND s.st<=e.ts WHERE e.event_type='error' GROUP BY 1""",
    "t33_same_block_order": r"""SELECT DISTINCT a.event_id FROM events a JOIN events b ON a.user_id=b.user_id AND a.ts<b.ts JOIN events c ON c.user_id=a.user_id AND b.ts<c.ts WHERE a.event_type='view' AND b.event_type='error' AND c.event_type='purchase' AND c.ts-a.ts<INTERVAL 6 HOUR""",
    "t34_name_convention": r"""SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name,'^[a-z]+ [a-z]{4}$')""",
    "t35_json_props": r"""SELECT event_type, max(CAST(json_extract(props,'$.k') AS INT)) mk, count(*) FILTER (WHERE json_extract(props,'$.owner') IS NULL) no_owner FROM events GROUP BY 1""",
    "t36_adjacent_comment": r"""SELECT a.conv_id, a.turn FROM conversations a WHERE a.role='assistant' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id=a.conv_id AND b.turn BETWEEN a.turn-3 AND a.turn AND contains(b.text,'?'))""",
    "t37_reciprocal_link": r"""WITH p AS (SELECT DISTINCT l_partkey%50 a, l_suppkey%50 b FROM lineitem WHERE l_quantity>=49) SELECT a,b FROM p WHERE a<>b AND NOT EXISTS (SELECT 1 FROM p q WHERE q.a=p.b AND q.b=p.a)""",
    "t38_member_dedup": r"""SELECT o_custkey, o_orderpriority, min(o_orderkey) k FROM orders GROUP BY 1,2""",
    "t39_reachable_from": r"""WITH RECURSIVE g AS (SELECT c_nationkey a, s_nationkey b, count(*) n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2), e AS (SELECT a,b FROM (SELECT *, percent_rank() OVER (ORDER BY n DESC, a, b) pr FROM g WHERE a<>b) WHERE pr<0.08), r(v) AS (SELECT unnest([0::INT,1::INT]) UNION SELECT e.b FROM r JOIN e ON r.v=e.a) SELECT v FROM r""",
    "t40_strong_components": r"""WITH RECURSIVE g AS (SELECT c_nationkey a, s_nationkey b, count(*) n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2), e AS (SELECT a,b FROM (SELECT *, percent_rank() OVER (ORDER BY n DESC, a, b) pr FROM g WHERE a<>b) WHERE pr<0.2), r(a,b) AS (SELECT a,b FROM e UNION SELECT r.a,e.b FROM r JOIN e ON r.b=e.a) SELECT x.a v, min(x.b) component FROM r x JOIN r y ON x.a=y.b AND x.b=y.a GROUP BY 1""",
    "t41_merged_members": r"""SELECT check_id, project, count(*) n FROM (SELECT CASE WHEN o_orderstatus='F' THEN 'allowlist' ELSE 'x' END check_id, o_custkey project, o_orderpriority s, CASE WHEN o_orderstatus='F' THEN 0 ELSE o_orderkey END k FROM orders GROUP BY ALL) GROUP BY 1,2""",
    "t42_canonical_ids": r"""SELECT event_id, CASE WHEN event_type IN ('view','click') THEN 'OPENED' WHEN event_type='error' THEN 'FAILED' ELSE event_type END event_type FROM events""",
    "t43_exit_codes": r"""SELECT 'high' run, CASE WHEN max(value)>=50 THEN 1 ELSE 0 END::INT exit_code FROM events UNION ALL SELECT 'critical', 0::INT UNION ALL SELECT 'broken', 3::INT UNION ALL SELECT 'floors', CASE WHEN count(*) FILTER (WHERE event_type='click')>0 THEN 1 ELSE 0 END::INT FROM events""",
    "t44_fixtures_left_out": r"""SELECT p_partkey FROM part ANTI JOIN (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey%3=0) f USING (p_brand, p_size)""",
    "t45_set_operators": r"""SELECT 'union' kind, k FROM (SELECT o_custkey k FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey%2=0) UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey%2=0) UNION ALL SELECT 'except', k FROM ((SELECT c_custkey k FROM customer WHERE c_custkey%2<>0) EXCEPT SELECT o_custkey FROM orders)""",
    "t46_dated_waivers": r"""SELECT o_orderkey, CASE WHEN 30+o_orderkey%371>365 THEN 'too long' WHEN DATE '1996-01-01' >= CAST(o_orderdate AS DATE)+CAST(30+o_orderkey%371 AS INT) THEN 'expired' ELSE 'live' END state FROM orders""",
}
