"""SQL for DuckDB, one statement for each registered query; written from what the query means, not from its plan."""

from __future__ import annotations

from depweave.plans.queries import IMPACT_ITEMS, PACKAGES, REGION

FK = """fk AS (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
EV = """steps AS (
  SELECT 'u' || user_id || event_type AS src, lead('u' || user_id || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
ev AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL),
ev_reach AS (SELECT src, dst FROM ev WHERE src <> dst UNION SELECT r.src, e.dst FROM ev_reach r JOIN ev e ON r.dst = e.src WHERE e.src <> e.dst)"""
REACH_FK = "reach AS (SELECT src, dst FROM fk UNION SELECT r.src, f.dst FROM reach r JOIN fk f ON r.dst = f.src)"
URL = r"""u AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/+$', '') AS url FROM pages),
parts AS (SELECT url, string_split(url, '/') AS p FROM u),
pre AS (SELECT DISTINCT url, array_to_string(p[1:k], '/') AS value FROM (SELECT url, p, unnest(range(1, len(p) + 1)) AS k FROM parts)),
stored AS (
  SELECT DISTINCT p[1] AS prefix FROM parts WHERE NOT regexp_matches(url, '^blog\.') UNION
  SELECT DISTINCT array_to_string(p[1:2], '/') FROM parts WHERE regexp_matches(url, '^(www|m)\.'))"""
LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
IMPACT = f"""e AS (SELECT strftime(ts, '%Y-%m-%d') AS commit_id, user_id % {IMPACT_ITEMS} AS item_id, event_type, value FROM events),
kept AS (SELECT commit_id, count(DISTINCT item_id) AS kept FROM e WHERE event_type = 'purchase' AND value > 20 GROUP BY 1),
unsafe AS (SELECT commit_id FROM e GROUP BY 1 HAVING count(*) % 13 = 0),
imp AS (
  SELECT c.commit_id, coalesce(k.kept, 0) AS kept, {IMPACT_ITEMS} - coalesce(k.kept, 0) AS pruned,
    CASE WHEN c.commit_id IN (SELECT commit_id FROM unsafe) THEN 'unsafe' WHEN coalesce(k.kept, 0) = 0 THEN 'skipped' WHEN k.kept = {IMPACT_ITEMS} THEN 'nogain' ELSE 'partial' END AS class,
    ({IMPACT_ITEMS} - coalesce(k.kept, 0))::DOUBLE / {IMPACT_ITEMS} AS gain
  FROM (SELECT DISTINCT commit_id FROM e) c LEFT JOIN kept k USING (commit_id))"""
TRACE = """tr AS (
  SELECT event_id, 'u' || user_id || '.' || event_type AS context, lead('u' || user_id || '.' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS module FROM events),
seen AS (SELECT DISTINCT context AS src, module AS dst FROM tr WHERE module IS NOT NULL AND event_id % 5 <> 0 AND event_id % 11 <> 0),
obs AS (SELECT src, dst FROM seen WHERE src <> dst UNION SELECT dst, split_part(dst, '.', 1) FROM seen)"""
MISSING = """dear AS (
  SELECT 'u' || user_id || '.' || event_type AS src, lead('u' || user_id || '.' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events WHERE value > 20),
static(module, dep) AS (SELECT src, dst FROM dear WHERE dst IS NOT NULL AND src <> dst UNION SELECT s.module, d.dst FROM static s JOIN dear d ON s.dep = d.src WHERE d.dst IS NOT NULL AND d.src <> d.dst),
missing AS (SELECT src AS module, dst AS dep FROM obs EXCEPT SELECT module, dep FROM static)"""
WEB = f"""web AS (SELECT regexp_extract(url, '^[^:]*://[^/]*/([a-z]+)/(\\d+)', 1) AS lang, regexp_extract(url, '^[^:]*://[^/]*/([a-z]+)/(\\d+)', 2) AS number, html FROM pages),
tree AS (SELECT lang, number, html, 'web/' || lang || '/' || number || '.py' AS path FROM web WHERE lang <> ''),
asked AS (SELECT DISTINCT path, lang, replace(replace(word, '.', '_'), '/', '_') AS word FROM (SELECT path, lang, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS word FROM tree)),
led AS (
  SELECT path, lang, CASE WHEN 'web/' || lang || '/' || word || '.py' IN (SELECT path FROM tree) THEN 'web/' || lang || '/' || word || '.py' WHEN lang IN {PACKAGES} THEN 'web/' || lang || '/__init__.py' END AS dst FROM asked)"""

SQL: dict[str, str] = {
    "closure_fk": f"WITH RECURSIVE {FK}, {REACH_FK} SELECT src, dst FROM reach",
    "closure_ev": f"WITH RECURSIVE {EV} SELECT src, dst FROM ev_reach",
    "affected_region": f"WITH RECURSIVE {FK}, {REACH_FK} SELECT DISTINCT substr(src, 2)::BIGINT AS o_orderkey FROM reach WHERE dst = '{REGION}' AND src LIKE 'o%'",
    "affected_suppliers": f"WITH RECURSIVE {FK}, {REACH_FK} SELECT DISTINCT src AS fs FROM reach WHERE dst = '{REGION}' AND src LIKE 's%'",
    "depends_order": f"""WITH RECURSIVE {FK}, {REACH_FK}, hit AS (SELECT DISTINCT dst FROM reach WHERE src LIKE 'o%')
      SELECT c_mktsegment AS pkg, dst AS py FROM hit LEFT JOIN customer ON dst = 'c' || c_custkey""",
    "local_affected_by_segment": f"""SELECT c_mktsegment AS pkg, count(*)::INT AS n, string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) AS affected FROM customer JOIN nation ON c_nationkey = n_nationkey
      WHERE 'r' || n_regionkey = '{REGION}' GROUP BY 1""",
    "cycle_members": f"WITH RECURSIVE {EV} SELECT src AS node FROM ev_reach WHERE src = dst",
    "scc_components": f"""WITH RECURSIVE {EV}, nodes AS (SELECT src AS node FROM ev UNION SELECT dst FROM ev),
      mutual AS (SELECT a.src AS node, min(a.dst) AS least FROM ev_reach a JOIN ev_reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
      SELECT node, least(node, coalesce(least, node)) AS comp FROM nodes LEFT JOIN mutual USING (node)""",
    "condensed_edges": f"""WITH RECURSIVE {EV}, every AS (SELECT src, dst FROM ev UNION SELECT src, regexp_replace(src, '^u[0-9]+', '') FROM ev), nodes AS (SELECT src AS node FROM every UNION SELECT dst FROM every),
      mutual AS (SELECT a.src AS node, min(a.dst) AS least FROM ev_reach a JOIN ev_reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
      comp AS (SELECT node, least(node, coalesce(least, node)) AS comp FROM nodes LEFT JOIN mutual USING (node))
      SELECT DISTINCT a.comp AS src, b.comp AS dst FROM every JOIN comp a ON a.node = every.src JOIN comp b ON b.node = every.dst WHERE a.comp <> b.comp""",
    "leaf_nodes": f"WITH {FK} SELECT src AS node FROM fk WHERE src NOT IN (SELECT dst FROM fk) GROUP BY 1",
    "parent_reify_url": f"""WITH {URL} SELECT DISTINCT pre.url AS src, CASE WHEN pre.value IN (SELECT url FROM u) THEN pre.value ELSE '<' || pre.value || '>' END AS dst FROM pre WHERE pre.value <> pre.url""",
    "parent_created_url": f"WITH {URL} SELECT DISTINCT '<' || value || '>' AS node, value AS py FROM pre WHERE value NOT IN (SELECT url FROM u)",
    "matches_url": f"WITH {URL} SELECT url, EXISTS (SELECT 1 FROM stored s WHERE u.url = s.prefix OR starts_with(u.url, s.prefix || '/')) AS matches FROM u",
    "longest_prefix_url": f"WITH {URL} SELECT url, (SELECT max_by(prefix, length(prefix)) FROM stored s WHERE u.url = s.prefix OR starts_with(u.url, s.prefix || '/')) AS longest FROM u",
    "strict_prefix_url": f"""WITH {URL}, probes AS (SELECT DISTINCT value FROM pre)
      SELECT value, EXISTS (SELECT 1 FROM stored s WHERE starts_with(s.prefix, p.value || '/')) AND value NOT IN (SELECT prefix FROM stored) AS strict FROM probes p""",
    "suffixes_url": f"WITH {URL} SELECT p[1] AS host, array_to_string(p[2:], '.') AS suffix FROM parts WHERE len(p) > 1",
    "wildcard_children_url": f"WITH {URL}, hosts AS (SELECT DISTINCT p[1] AS h FROM parts) SELECT h || '/en/*' AS pattern, url FROM hosts JOIN parts ON len(p) = 3 AND p[1] = h AND p[2] = 'en'",
    "tracked_urls": f"WITH {URL} SELECT url FROM u WHERE split_part(url, '.', 1) IN ('www', 'blog') AND NOT starts_with(url, 'blog.th')",
    "relative_import_base": r"""WITH d AS (SELECT page_id, string_split(replace(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/', '.'), '.') AS p FROM pages)
      SELECT page_id, CASE WHEN len(p) > page_id % 6 THEN array_to_string(p[1:(len(p) - page_id % 6)], '.') END AS base FROM d""",
    "extract_links": f"WITH {LINKS} SELECT page_id, href FROM links",
    "unresolved_links": f"""WITH {WEB} SELECT 'web.' || lang AS target, count(DISTINCT path)::INT AS n_importers, string_agg(DISTINCT path, ',' ORDER BY path) AS importers FROM led WHERE dst IS NULL GROUP BY lang""",
    "ranked_lookup": r"""WITH f AS (SELECT DISTINCT 'src/m' || (p_partkey % 400) || CASE WHEN p_partkey % 11 = 0 THEN '/__init__.py' WHEN p_size % 3 = 0 THEN '.py' WHEN p_size % 3 = 1 THEN '.pyi' ELSE '.pyx' END AS path FROM part),
      w AS (SELECT o_orderkey AS key, 'src/m' || (o_custkey % 500) AS base, o_orderkey % 2 = 0 AS deep FROM orders),
      ends AS (SELECT * FROM (VALUES ('/__init__.py', 0), ('/__init__.pyi', 1), ('.py', 2), ('.pyx', 3), ('.pyi', 4)) AS e(ending, k)),
      tries AS (
        SELECT key, base || CASE WHEN deep THEN '/attr' ELSE '' END || ending AS path, base || CASE WHEN deep THEN '.attr' ELSE '' END AS py, k FROM w, ends
        UNION ALL SELECT key, CASE WHEN deep THEN base ELSE 'src' END || ending, CASE WHEN deep THEN base ELSE 'src' END, 10 + k FROM w, ends)
      SELECT key, min_by(path, k) AS fs, replace(min_by(py, k), '/', '.') AS py FROM tries WHERE path IN (SELECT path FROM f) GROUP BY key""",
    "admitted_files": r"""WITH f AS (SELECT DISTINCT 'src/m' || (p_partkey % 400) || CASE WHEN p_partkey % 11 = 0 THEN '/__init__.py' WHEN p_size % 3 = 0 THEN '.py' WHEN p_size % 3 = 1 THEN '.pyi' ELSE '.pyx' END AS path FROM part),
      s AS (SELECT path, regexp_replace(path, '\.[^./]*$', '') AS stem FROM f)
      SELECT path FROM s WHERE stem || '/__init__.py' NOT IN (SELECT path FROM f) AND NOT (path LIKE '%.pyx' AND stem || '.py' IN (SELECT path FROM f))
        AND NOT (path LIKE '%.pyi' AND (stem || '.py' IN (SELECT path FROM f) OR stem || '.pyx' IN (SELECT path FROM f)))""",
    "nearest_ancestor": f"""WITH {URL}, n AS (SELECT url, (SELECT max_by(prefix, length(prefix)) FROM stored s WHERE u.url = s.prefix OR starts_with(u.url, s.prefix || '/')) AS hit FROM u)
      SELECT replace(replace(url, '.', '_'), '/', '.') AS name, '<' || replace(replace(hit, '.', '_'), '/', '.') || '>' AS node FROM n""",
    "modified_union": f"WITH RECURSIVE {FK}, {REACH_FK} SELECT src AS path FROM reach WHERE dst = '{REGION}' AND src LIKE 'o%' UNION SELECT unnest(['{REGION}', 'o1', 'new'])",
    "keep_predicate": f"""SELECT o_orderkey AS item_id, o_orderkey % 10 = 0 OR (o_orderkey % 3 = 0 AND 'r' || n_regionkey = '{REGION}') OR o_orderkey = 7 OR o_orderpriority = '1-URGENT' OR o_totalprice > 250000 AS keep
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "residual_risk": "SELECT 'o' || o_orderkey AS path FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 10 <> 4",
    "impact_commits": f"WITH {IMPACT} SELECT commit_id, kept, pruned, class, gain FROM imp",
    "impact_classes": f"WITH {IMPACT} SELECT class, count(i.class) AS n, count(i.class)::DOUBLE / (SELECT count(*) FROM imp) AS share FROM (SELECT unnest(['unsafe', 'skipped', 'nogain', 'partial']) AS class) c LEFT JOIN imp i USING (class) GROUP BY class",
    "impact_deciles": f"WITH {IMPACT} SELECT avg(gain) AS mean, quantile_cont(gain, 0.5) AS median, "
    + ", ".join(f"quantile_cont(gain, 0.{k}) AS d{k}" for k in range(1, 10))
    + " FROM imp WHERE class = 'partial'",
    "trace_observed": f"WITH {TRACE} SELECT src, dst FROM obs",
    "trace_missing": f"WITH RECURSIVE {TRACE}, {MISSING} SELECT module, dep FROM missing",
    "trace_missing_by_package": f"WITH RECURSIVE {TRACE}, {MISSING} SELECT split_part(module, '.', 1) AS pkg, count(DISTINCT module) AS modules, count(*) AS pairs FROM missing GROUP BY 1",
    "trace_with_dynamic": """WITH found AS (SELECT 'o' || l_orderkey AS module, 'p' || l_partkey AS dep FROM lineitem WHERE l_quantity < 5
      UNION SELECT 'o' || a.l_orderkey, 'p' || b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND b.l_quantity > 45)
      SELECT module, count(*) AS n_deps, sum(substr(dep, 2)::BIGINT)::BIGINT AS sum_keys FROM found GROUP BY module""",
    "dynamic_anchors": """WITH f AS (SELECT l_orderkey AS event_id, (l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) * 100 + ascii(l_returnflag) AS depth, p_brand AS module, l_returnflag AS fn FROM lineitem JOIN part ON l_partkey = p_partkey),
      g AS (SELECT event_id, bool_or(module IN ('Brand#12', 'Brand#1') AND fn = 'N') AS gone, min(depth) FILTER (right(module, 1) IN ('1', '3') AND fn = 'A') AS a, max(depth) AS b FROM f GROUP BY 1)
      SELECT DISTINCT f.event_id, f.module, f.fn FROM g JOIN f ON f.event_id = g.event_id AND f.depth = coalesce(g.a, g.b) WHERE NOT gone""",
    "distinct_stacks": "SELECT DISTINCT l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS stack FROM lineitem",
    "unexpected_per_item": """SELECT DISTINCT l_orderkey AS item, 'p' || l_partkey AS dep FROM lineitem l
      WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_suppkey = l.l_suppkey AND e.l_partkey = l.l_partkey AND e.l_quantity > 10) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
    "rename_explode": """SELECT 'c' || l_orderkey AS commit_id, 'p' || l_partkey AS path FROM lineitem WHERE l_linenumber % 6 < 4
      UNION SELECT 'c' || l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber % 6 = 3""",
    "recent_commits": "SELECT o_orderkey AS commit_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "module_violations": """WITH m AS (
        SELECT CASE WHEN p_size % 9 <> 0 THEN 'f' || (p_partkey % 150) END AS fs, CASE WHEN p_size <> 7 THEN CASE WHEN p_size = 8 THEN 'a/' ELSE 'm' END || (p_partkey % 190) END AS py, CASE WHEN p_size % 2 = 0 THEN p_brand END AS pkg FROM part)
      SELECT 'fs repeated' AS rule, fs AS key, count(*) AS n FROM m WHERE fs IS NOT NULL GROUP BY fs HAVING count(*) > 1
      UNION ALL SELECT 'global py repeated', py, count(*) FROM m WHERE py IS NOT NULL AND pkg IS NULL GROUP BY py HAVING count(*) > 1
      UNION ALL SELECT 'local py repeated', pkg || ':' || py, count(*) FROM m WHERE py IS NOT NULL AND pkg IS NOT NULL GROUP BY pkg, py HAVING count(*) > 1
      UNION ALL SELECT 'separator in py', py, 1 FROM m WHERE contains(py, '/')
      UNION ALL SELECT 'py missing', fs, 1 FROM m WHERE py IS NULL""",
    "order_reach": f"WITH RECURSIVE {FK}, {REACH_FK} SELECT src, dst FROM reach WHERE src LIKE 'o%'",
    "sibling_lookup": f"""WITH {URL}, s AS (SELECT url, array_to_string(p[1:(len(p) - 1)], '/') AS parent, p[len(p)] AS last FROM parts WHERE len(p) > 1),
      tries AS (
        SELECT u.url, b.url AS path, '' AS rank FROM u JOIN u b ON b.url = u.url || '.html' UNION ALL
        SELECT a.url, b.url, lpad(length(b.last)::VARCHAR, 9, '0') || b.last FROM s a JOIN s b ON a.parent = b.parent AND a.url <> b.url AND regexp_full_match(b.last, '[1-9][0-9]*'))
      SELECT url, min_by(path, rank) AS found FROM tries GROUP BY url""",
    "resolved_links": f"""WITH {WEB} SELECT DISTINCT path AS src, dst FROM led WHERE dst <> path UNION SELECT 'web/index.py', path FROM tree
      UNION SELECT 'web/index.py', 'web/' || lang || '/__init__.py' FROM tree WHERE lang IN {PACKAGES}""",
    "named_modules": r"""WITH f AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'lib/app/' WHEN 1 THEN 'pkg/tests/' ELSE 'other/' END || replace(lower(p_brand), '#', '_') || '/' || CASE WHEN p_partkey % 5 = 0 THEN '__init__' ELSE 'm' || p_partkey END || '.py' AS path FROM part),
      m AS (SELECT path, path LIKE 'pkg/%' AS own, replace(regexp_replace(regexp_replace(path, '^lib/', ''), '^pkg/tests/', 'checks/')[:-4], '/', '.') AS module FROM f WHERE path NOT LIKE 'other/%')
      SELECT path, module, regexp_replace(module, '\.__init__$', '') AS py, CASE WHEN own THEN 'pkg/tests' END AS pkg FROM m""",
    "module_or_parent_url": f"""WITH {URL}, hits AS (SELECT url, CASE WHEN url IN (SELECT prefix FROM stored) THEN url WHEN array_to_string(p[1:(len(p) - 1)], '/') IN (SELECT prefix FROM stored) THEN array_to_string(p[1:(len(p) - 1)], '/') END AS hit FROM parts)
      SELECT replace(replace(url, '.', '_'), '/', '.') AS name, '<' || replace(replace(hit, '.', '_'), '/', '.') || '>' AS node FROM hits""",
    "dynamic_edges_fk": """SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 10 <> 0 UNION SELECT 's' || s_suppkey, 'n' || n_nationkey FROM supplier, nation WHERE s_suppkey % 10 = 0""",
    "leaf_edges_fk": f"""WITH RECURSIVE {FK}, {REACH_FK}, places AS (SELECT src, dst FROM reach WHERE src NOT LIKE 'o%'),
      extra AS (
        SELECT pkg, n AS dst FROM (VALUES ('BUILDING', 'n1'), ('MACHINERY', 'n2')) AS e(pkg, n) UNION SELECT pkg, p.dst FROM (VALUES ('BUILDING', 'n1'), ('MACHINERY', 'n2')) AS e(pkg, n) JOIN places p ON p.src = n)
      SELECT src, dst FROM places UNION
      SELECT 'c' || c_custkey, x.dst FROM customer JOIN extra x ON x.pkg = c_mktsegment WHERE x.dst <> '{REGION}' AND EXISTS (SELECT 1 FROM places p WHERE p.src = 'c' || c_custkey AND p.dst = '{REGION}')""",
    "dynamic_exposure_fk": """SELECT DISTINCT 'tests/test_o' || o_orderkey || '.py' AS fs FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND o_orderkey % 2 = 0""",
    "first_match_keys": """SELECT DISTINCT 'c' || o_custkey AS name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 1 OR c_custkey % 5 <> 0 THEN 'by-key-c' ELSE 'twin-c' END || c_custkey AS node FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "trace_tracked": f"""WITH RECURSIVE {TRACE}, pulled(module, dep) AS (SELECT src, dst FROM obs WHERE src <> dst UNION SELECT p.module, o.dst FROM pulled p JOIN obs o ON p.dep = o.src WHERE o.src <> o.dst) SELECT module, dep FROM pulled""",
}
