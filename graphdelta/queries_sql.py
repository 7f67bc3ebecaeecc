"""DuckDB twins of graphdelta.queries. A query that SQL can't express has none; tests hold those against brute force."""

from __future__ import annotations

EVENTS = """
WITH RECURSIVE e AS (SELECT event_id, ts, user_id AS u, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
v AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'head' END AS g, 'crate::U' || u || '::' || t AS id, CASE WHEN p <> t THEN 'crate::U' || u || '::' || p END AS prev FROM e),
n AS (SELECT DISTINCT g, id FROM v), x AS (SELECT DISTINCT g, prev AS f, id AS t FROM v WHERE prev IS NOT NULL),
na AS (SELECT id, bool_or(g = 'base') AS b, bool_or(g = 'head') AS h FROM n GROUP BY id),
xa AS (SELECT f, t, bool_or(g = 'base') AS b, bool_or(g = 'head') AS h FROM x GROUP BY f, t),
ec AS (SELECT CASE WHEN h THEN 'EdgeAdded' ELSE 'EdgeRemoved' END AS change, f, t FROM xa WHERE b <> h),
nc AS (SELECT CASE WHEN h THEN 'Added' ELSE 'Removed' END AS change, id FROM na WHERE b <> h),
touched AS (SELECT f AS id FROM ec UNION SELECT t FROM ec),
ch AS (SELECT row_number() OVER (ORDER BY r, k1, k2) AS pos, * FROM (
  SELECT CASE change WHEN 'Added' THEN 0 ELSE 1 END AS r, change, id AS k1, NULL AS k2 FROM nc UNION ALL
  SELECT CASE change WHEN 'EdgeAdded' THEN 4 ELSE 5 END, change, f, t FROM ec))
"""

PROFILES = """
WITH b AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN 'base' ELSE 'head' END AS g, 'crate::N' || s_nationkey || '::S' || s_suppkey AS id, p_brand AS m, min(p_type) AS t
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
per AS (SELECT g, id, string_agg(m || ':' || t, ',' ORDER BY m) AS fp FROM b GROUP BY g, id),
sides AS (SELECT coalesce(x.id, y.id) AS id, x.fp AS was, y.fp AS now FROM (SELECT * FROM per WHERE g = 'base') x FULL JOIN (SELECT * FROM per WHERE g = 'head') y ON x.id = y.id)
"""

DOCS = r"""
WITH RECURSIVE d AS (SELECT doc_id, 'crate::' || lang || '::' || source || '::D' || doc_id AS id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS doc, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM d) GROUP BY ALL),
s AS (SELECT d.doc_id, id, doc, coalesce(m, 0) AS m, coalesce(t, 0) AS t FROM d LEFT JOIN (SELECT doc_id, count(*) AS m, sum(n) AS t FROM c GROUP BY 1) k ON k.doc_id = d.doc_id)
"""

_MEASURES = """, measured AS (SELECT a.doc_id, a.id AS rid, b.id AS aid, CASE WHEN a.m + b.m = 0 THEN 1.0 ELSE coalesce(i, 0)::DOUBLE / (a.m + b.m - coalesce(i, 0)) END AS j,
  CASE WHEN a.t + b.t = 0 THEN 1.0 ELSE coalesce(lo, 0)::DOUBLE / (a.t + b.t - coalesce(lo, 0))::DOUBLE END AS mj, CASE WHEN a.doc = b.doc THEN 1.0 ELSE 0.0 END AS same
  FROM p JOIN s a ON a.doc_id = p.x JOIN s b ON b.doc_id = p.y),
scored AS (SELECT doc_id, rid, aid, j, mj, (j::DOUBLE * 0.4::DOUBLE + mj::DOUBLE * 0.4::DOUBLE + 0.1::DOUBLE + same::DOUBLE * 0.1::DOUBLE) AS score FROM measured)
"""

NEXT = DOCS + """, common AS (SELECT x.doc_id AS k, count(*) AS i, sum(least(x.n, y.n)) AS lo FROM c x JOIN c y ON y.doc_id = x.doc_id + 1 AND y.w = x.w WHERE x.doc_id % 2 = 0 GROUP BY 1),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, i, lo FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 LEFT JOIN common ON k = x.doc_id WHERE x.doc_id % 2 = 0)
""" + _MEASURES

PAIRS = DOCS + """, p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS i, sum(least(x.n, y.n)) AS lo FROM c x JOIN c y ON y.w = x.w WHERE x.doc_id % 2 = 0 AND y.doc_id % 2 = 1 GROUP BY 1, 2
  UNION ALL SELECT x.doc_id, y.doc_id, 0, 0 FROM s x, s y WHERE x.m = 0 AND y.m = 0 AND x.doc_id % 2 = 0 AND y.doc_id % 2 = 1)
""" + _MEASURES

#: Greedy matching as a walk over the ranked candidates of each threshold, with the ids used so far.
MATCHED = PAIRS + """, levels AS (SELECT unnest({levels}::DOUBLE[]) AS th),
ranked AS (SELECT th, rid, aid, score, row_number() OVER (PARTITION BY th ORDER BY score DESC, rid, aid) AS k FROM scored, levels WHERE score >= th),
walk AS (SELECT th, 0::BIGINT AS k, []::VARCHAR[] AS r, []::VARCHAR[] AS a, NULL::VARCHAR AS rid, NULL::VARCHAR AS aid, NULL::DOUBLE AS score FROM levels
  UNION ALL SELECT w.th, q.k, CASE WHEN free THEN list_append(w.r, q.rid) ELSE w.r END, CASE WHEN free THEN list_append(w.a, q.aid) ELSE w.a END, CASE WHEN free THEN q.rid END, CASE WHEN free THEN q.aid END, CASE WHEN free THEN q.score END
  FROM walk w JOIN ranked q ON q.th = w.th AND q.k = w.k + 1, LATERAL (SELECT NOT list_contains(w.r, q.rid) AND NOT list_contains(w.a, q.aid) AS free)),
taken AS (SELECT th, rid, aid, score FROM walk WHERE rid IS NOT NULL)
"""
AT_07 = MATCHED.replace("{levels}", "[0.7]")

NATIONS = """
WITH RECURSIVE t AS (SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS g, s_nationkey AS sn, c_nationkey AS cn, count(*) AS n
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
tot AS (SELECT g, sum(n) AS total FROM t GROUP BY g),
ids AS (SELECT n_nationkey AS k, 'crate::R' || n_regionkey || '::N' || n_nationkey AS id, 'crate::R' || n_regionkey AS home, 'src/r' || n_regionkey || '/n' || n_nationkey || '.rs' AS file FROM nation),
files AS (SELECT id, file FROM ids UNION SELECT home, 'src/r' || n_regionkey || '/mod.rs' FROM ids JOIN nation ON n_nationkey = k),
uses AS (SELECT t.g, x.id AS f, y.id AS t FROM t JOIN tot ON tot.g = t.g JOIN ids x ON x.k = sn JOIN ids y ON y.k = cn WHERE n * 625 > 1.3::DOUBLE * total
  UNION SELECT g, id, home FROM tot, ids UNION SELECT g, home, id FROM tot, ids),
pairs AS (SELECT g AS pair_id, lag(g) OVER (ORDER BY g) AS base FROM tot QUALIFY base IS NOT NULL),
hu AS (SELECT pair_id, f, t FROM pairs JOIN uses ON uses.g = pair_id), bu AS (SELECT pair_id, f, t FROM pairs JOIN uses ON uses.g = base),
added AS (SELECT * FROM hu EXCEPT SELECT * FROM bu), gone AS (SELECT * FROM bu EXCEPT SELECT * FROM hu),
layer AS (SELECT id, CASE WHEN regexp_matches(file, '^src/r[01]/') THEN 'low' ELSE 'high' END AS layer FROM files),
layering AS (SELECT pair_id, 'layering' AS rule, 'deny' AS severity, f || ' (low) must not depend on ' || t || ' (high)' AS message FROM added JOIN layer a ON a.id = f JOIN layer b ON b.id = t WHERE a.layer = 'low' AND b.layer = 'high'),
sanity AS (SELECT pair_id, 'config_sanity' AS rule, 'warn' AS severity, 'layer "unused" is declared but matches no module; check its glob' AS message FROM pairs),
open AS (SELECT * FROM hu WHERE NOT starts_with(f, t || '::') AND NOT starts_with(t, f || '::')),
reach AS (SELECT * FROM open UNION SELECT r.pair_id, r.f, o.t FROM reach r JOIN open o ON o.pair_id = r.pair_id AND o.f = r.t),
scc AS (SELECT a.pair_id, a.f AS id, min(a.t) AS c FROM reach a JOIN reach b ON b.pair_id = a.pair_id AND b.f = a.t AND b.t = a.f GROUP BY 1, 2),
fresh AS (SELECT DISTINCT o.pair_id, x.c FROM added o JOIN scc x ON x.pair_id = o.pair_id AND x.id = o.f JOIN scc y ON y.pair_id = o.pair_id AND y.id = o.t AND y.c = x.c WHERE NOT starts_with(f, t || '::') AND NOT starts_with(t, f || '::')),
cycles AS (SELECT s.pair_id, 'cycles' AS rule, 'warn' AS severity, 'module cycle: ' || string_agg(id, ' -> ' ORDER BY id) AS message FROM scc s JOIN fresh USING (pair_id, c) GROUP BY s.pair_id, s.c)
"""

CALLS = """
WITH r AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN 'base' ELSE 'head' END AS g, 'crate::O' || l_orderkey AS f, 'crate::B' || l_suppkey || '::P' || l_partkey AS t, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem),
o AS (SELECT g, f, t, l_suppkey, row_number() OVER (PARTITION BY g, f ORDER BY seq) - 1 AS ordinal FROM r WHERE l_partkey % 7 <> 0)
"""

TREE = """
WITH nt AS (SELECT n_nationkey AS k, n_regionkey AS r, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 1 ELSE 0 END AS tier FROM nation),
rt AS (SELECT r_regionkey AS r, coalesce(max(tier) + 1, 0) AS tier FROM region LEFT JOIN nt ON nt.r = r_regionkey GROUP BY 1),
tiers AS (SELECT 'root' AS id, max(tier) + 1 AS tier FROM rt UNION ALL SELECT 'r' || r, tier FROM rt UNION ALL SELECT 'n' || k, tier FROM nt UNION ALL SELECT 's' || s_suppkey, 0 FROM supplier)
"""

DAYS = """
WITH e AS (SELECT event_id, ts, user_id AS u, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
v AS (SELECT strftime(ts, '%Y-%m-%d') AS g, 'crate::U' || u || '::' || t AS id, CASE WHEN p <> t THEN 'crate::U' || u || '::' || p END AS prev FROM e),
days AS (SELECT DISTINCT g, 'w' || weekofyear(g::DATE) AS repo FROM v),
pairs AS (SELECT repo, lag(g) OVER (PARTITION BY repo ORDER BY g) AS base, g AS head FROM days QUALIFY base IS NOT NULL),
items AS (SELECT DISTINCT g, 'n' AS kind, id AS a, '' AS b FROM v UNION ALL SELECT DISTINCT g, 'e', prev, id FROM v WHERE prev IS NOT NULL),
sides AS (SELECT head, kind, a, b, bool_or(g = base) AS was, bool_or(g = head) AS now FROM items JOIN pairs ON g = base OR g = head GROUP BY ALL),
drift AS (SELECT head AS pair_id, count(*) FILTER (kind = 'n' AND NOT was) AS added, count(*) FILTER (kind = 'n' AND NOT now) AS removed, 0::BIGINT AS modified, 0::BIGINT AS moved,
  count(*) FILTER (kind = 'e' AND NOT was) AS edges_added, count(*) FILTER (kind = 'e' AND NOT now) AS edges_removed, count(*) FILTER (kind = 'n') AS nodes, count(*) FILTER (kind = 'e') AS edges, count(*) AS total FROM sides WHERE was <> now GROUP BY head)
"""

FENCES = r"""
WITH b AS (SELECT conv_id, turn, 'sequenceDiagram' || chr(10) || rtrim('  ' || role || ': ' || regexp_replace(coalesce(text, ''), '[^A-Za-z ]', 'x', 'g')) AS block FROM conversations WHERE conv_id IS NOT NULL AND turn % 3 <> 2),
f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, block) - 1 AS pos, block FROM b)
"""

#: Rows of every nation's module: kind, id below the module (empty: the module), value.
FACTS = """
WITH m AS (SELECT n_regionkey::VARCHAR AS graph_id, 'crate::n' || n_nationkey AS id FROM nation),
own(kind, tail, value) AS (VALUES ('Module', '', '|'), ('Struct', '::Keel', 'span|u64*1|span:u64|'), ('Struct', '::Hull', 'keel,n,rows|Keel*1,Track*1,u16*1|keel:Keel,n:u16,rows:Track|'), ('Trait', '::Sail', 'MOST,set||MOST:u8,set:Keel|'),
  ('Fn', '::Hull::set', 'at|Keel*1,u8*1|at:u8|sig=(&self, at: u8) -> Keel'), ('Fn', '::make', 'at,wide|Keel*2,T*1|at:T,wide:Keel|sig=(at: T, wide: &Keel) -> Option<Keel>')),
links(kind, tail, target) AS (VALUES ('Associates', '::Hull', '::Keel'), ('Implements', '::Hull', '::Sail'), ('Calls', '::Hull::set', '::make')),
shared(kind, id, value) AS (VALUES ('Module', 'crate', '|'), ('Module', 'crate::shared', '|'), ('Module', 'crate::shared::deep', '|'), ('Struct', 'crate::shared::Lane', '|||'), ('Struct', 'crate::shared::deep::Lock', '|||')),
uses(target) AS (VALUES ('crate::shared'), ('crate::shared::deep'))
SELECT graph_id, kind, id || tail AS id, value FROM m, own UNION ALL SELECT graph_id, kind, id || tail, id || target FROM m, links
UNION ALL SELECT g.graph_id, shared.* FROM (SELECT DISTINCT graph_id FROM m) g, shared UNION ALL SELECT graph_id, 'Uses', id, target FROM m, uses
"""

SQL: dict[str, str] = {
    "q_extract_facts": FACTS,
    "q_edge_set_diff": EVENTS + "SELECT change, f AS from_id, t AS to_id, 'Transitions' AS kind FROM ec",
    "q_node_set_diff": PROFILES + "SELECT CASE WHEN was IS NULL THEN 'Added' WHEN now IS NULL THEN 'Removed' ELSE 'Modified' END AS change, id FROM sides WHERE was IS DISTINCT FROM now",
    "q_member_diff": PROFILES + """, m AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.m, y.m) AS m, x.t AS was, y.t AS now FROM (SELECT * FROM b WHERE g = 'base') x FULL JOIN (SELECT * FROM b WHERE g = 'head') y ON x.id = y.id AND x.m = y.m)
      SELECT id, coalesce(string_agg(m, ',' ORDER BY m) FILTER (m.was IS NULL), '') AS added, coalesce(string_agg(m, ',' ORDER BY m) FILTER (m.now IS NULL), '') AS removed, coalesce(string_agg(m, ',' ORDER BY m) FILTER (m.was <> m.now), '') AS changed
      FROM m JOIN sides USING (id) WHERE sides.was <> sides.now GROUP BY id""",
    "q_file_rename_seed": "SELECT CASE n_nationkey % 5 WHEN 2 THEN 'Modified' ELSE 'Moved' END AS change, 'crate::R' || n_regionkey || '::N' || n_nationkey AS before_id, CASE n_nationkey % 5 WHEN 2 THEN 'crate::R' || n_regionkey || '::M' || n_nationkey ELSE 'crate::R' || (n_regionkey + 1) || '::N' || n_nationkey END AS after_id FROM nation WHERE n_nationkey % 5 IN (2, 3)",
    "q_change_order": EVENTS + "SELECT pos, change, k1 AS key, k2 AS to_id FROM ch",
    "q_change_list": EVENTS + "SELECT pos, CASE change WHEN 'Added' THEN '+ variant ' || k1 WHEN 'Removed' THEN '- variant ' || k1 WHEN 'EdgeAdded' THEN '+ edge ' || k1 || ' -> ' || k2 || ' (transitions)' ELSE '- edge ' || k1 || ' -> ' || k2 || ' (transitions)' END AS line FROM ch",
    "q_drift": EVENTS + "SELECT count(*) FILTER (r = 0) AS added, count(*) FILTER (r = 1) AS removed, 0::BIGINT AS modified, 0::BIGINT AS moved, count(*) FILTER (r = 4) AS edges_added, count(*) FILTER (r = 5) AS edges_removed, count(*) FILTER (r < 4) AS nodes, count(*) FILTER (r >= 4) AS edges, count(*) AS total FROM ch",
    "q_changelog": EVENTS + """, l AS (SELECT pos, CASE WHEN r >= 4 THEN 'Dependencies' ELSE left(k1, length(k1) - length(split_part(k1, '::', -1)) - 2) END AS owner, CASE WHEN r >= 4 THEN 'Dependencies' ELSE change END AS section,
      CASE WHEN r >= 4 THEN CASE r WHEN 4 THEN '+ `' ELSE '- `' END || k1 || '` -> `' || k2 || '` (transitions)' ELSE 'variant `' || split_part(k1, '::', -1) || '`' END AS line FROM ch)
      SELECT owner, section, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS lines FROM l GROUP BY owner, section""",
    "q_jaccard": NEXT + "SELECT doc_id, round(j::DOUBLE, 9) AS j FROM scored",
    "q_multiset_jaccard": NEXT + "SELECT doc_id, round(mj::DOUBLE, 9) AS j FROM scored",
    "q_similarity": NEXT + "SELECT doc_id, round(score, 9) AS score FROM scored",
    "q_rename_candidates": PAIRS + "SELECT rid, aid, round(score, 9) AS score FROM scored WHERE score >= 0.7::DOUBLE",
    "q_rename_matches": AT_07 + "SELECT rid, aid, round(score, 9) AS score FROM taken",
    "q_renamed_delta": AT_07 + """, k AS (SELECT count(*) AS n, count(*) FILTER (left(rid, length(rid) - length(split_part(rid, '::', -1))) <> left(aid, length(aid) - length(split_part(aid, '::', -1)))) AS moved FROM taken),
      z AS (SELECT count(*) FILTER (doc_id % 2 = 1) AS a, count(*) FILTER (doc_id % 2 = 0) AS r FROM documents)
      SELECT a - n AS added, r - n AS removed, n - moved AS modified, moved, 0::BIGINT AS edges_added, 0::BIGINT AS edges_removed, a + r - n AS nodes, 0::BIGINT AS edges, a + r - n AS total FROM k, z""",
    "q_threshold_sweep": MATCHED.replace("{levels}", "[0.5, 0.6, 0.7, 0.8, 0.9]") + """, z AS (SELECT count(*) FILTER (doc_id % 2 = 1) AS a, count(*) FILTER (doc_id % 2 = 0) AS r FROM documents)
      SELECT th AS threshold, count(rid) AS matches, any_value(a) - count(rid) AS added, any_value(r) - count(rid) AS removed FROM levels LEFT JOIN taken USING (th), z GROUP BY th UNION ALL SELECT NULL, 0, a, r FROM z""",
    "q_module_reconciliations": "SELECT 'p' AS pair_id, count(*) AS n FROM nation WHERE n_nationkey % 5 IN (2, 3)",
    "q_crate_tiers_cyclic": "SELECT 'c' || c_custkey AS id, 2::BIGINT AS tier FROM customer UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, 0 FROM nation",
    "q_near_miss": AT_07 + """, rest AS (SELECT * FROM scored WHERE score >= 0.5::DOUBLE AND rid NOT IN (SELECT rid FROM taken) AND aid NOT IN (SELECT aid FROM taken))
      SELECT rid, aid, round(score, 9) AS score, (SELECT count(*) FROM rest) AS n_left FROM rest ORDER BY rest.score DESC, rid, aid LIMIT 20""",
    "q_false_merge_audit": AT_07 + "SELECT rid, aid, round(score, 9) AS score FROM taken ORDER BY taken.score, rid, aid LIMIT 20",
    "q_calls_dense_ordinal": CALLS + "SELECT g AS graph_id, f AS caller, t AS callee, ordinal FROM o",
    "q_unresolved_count": CALLS + "SELECT g AS graph_id, f AS id, count(*) AS n FROM r WHERE l_partkey % 7 = 0 GROUP BY g, f",
    "q_first_wins_edges": "WITH e AS (SELECT event_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT 'crate::' || p AS from_id, 'crate::' || t AS to_id, min(event_id) AS \"start\" FROM e WHERE p <> t GROUP BY p, t",
    "q_prefix_resolve": """WITH m(id) AS (VALUES ('crate'), ('crate::a'), ('crate::a::b'), ('beta'), ('beta::inner')),
      p(module, path) AS (VALUES ('crate::a::b', 'crate::a::b::c::D'), ('crate::a', 'crate::a::b'), ('crate::a', 'crate::x::Y'), ('crate::a', 'beta::inner::deep::Z'), ('crate::a', 'beta::W'), ('crate::a', 'crate::a::T')),
      x AS (SELECT module, path, k, array_to_string(string_split(path, '::')[1:k], '::') AS prefix FROM p, unnest(range(1, len(string_split(path, '::')) + 1)) AS r(k))
      SELECT p.module, p.path, max_by(prefix, k) AS target FROM p LEFT JOIN (SELECT x.* FROM x JOIN m ON m.id = prefix WHERE split_part(path, '::', 1) <> split_part(module, '::', 1) OR k >= len(string_split(path, '::')) - 1) y ON y.module = p.module AND y.path = p.path GROUP BY 1, 2""",
    "q_reexport_chase": """WITH RECURSIVE e(name, target) AS (VALUES ('crate::f::A', 'crate::g::B'), ('crate::g::B', 'crate::h::C'), ('crate::s::S', 'crate::s::S'), ('crate::h::C', 'crate::h::D')),
      c AS (SELECT p AS path, p AS now, 0 AS k FROM (VALUES ('crate::f::A'), ('crate::g::B'), ('crate::s::S'), ('crate::z::Z')) x(p) UNION ALL SELECT path, target, k + 1 FROM c JOIN e ON name = now WHERE k < 16 AND target <> now)
      SELECT path, max_by(now, k) AS resolved FROM c GROUP BY path""",
    "q_path_normalise": """SELECT 'crate::a::b' AS module, * FROM (VALUES ('crate::x::Y', 'crate::x::Y'), ('self::T', 'crate::a::b::T'), ('super::T', 'crate::a::T'), ('super::super::T', 'crate::T'), ('super::super::super::T', NULL), ('std::fmt', NULL), ('self', 'crate::a::b')) x(path, absolute)""",
    "q_layering": NATIONS + "SELECT * FROM layering",
    "q_config_sanity": NATIONS + "SELECT * FROM sanity",
    "q_cycles": NATIONS + "SELECT * FROM cycles",
    "q_state_cycles": EVENTS + """, hx AS (SELECT f, t FROM xa WHERE h), reach AS (SELECT f, t FROM hx UNION SELECT r.f, o.t FROM reach r JOIN hx o ON o.f = r.t),
      scc AS (SELECT a.f AS id, min(a.t) AS c FROM reach a JOIN reach b ON b.f = a.t AND b.t = a.f GROUP BY 1),
      fresh AS (SELECT DISTINCT x.c FROM ec JOIN scc x ON x.id = f JOIN scc y ON y.id = t AND y.c = x.c WHERE change = 'EdgeAdded')
      SELECT 'state cycle: ' || string_agg(id, ' -> ' ORDER BY id) AS message FROM scc JOIN fresh USING (c) GROUP BY c""",
    "q_unreachable_state": EVENTS + "SELECT 'unreachable state: ' || id AS message FROM na WHERE h AND id IN (SELECT id FROM touched) AND id NOT IN (SELECT f FROM xa WHERE h UNION ALL SELECT t FROM xa WHERE h)",
    "q_terminal_state": EVENTS + "SELECT 'terminal state without exit: ' || id AS message FROM na WHERE h AND id IN (SELECT id FROM touched) AND id IN (SELECT t FROM xa WHERE h) AND id NOT IN (SELECT f FROM xa WHERE h)",
    "q_io_hot_path": CALLS + """, new AS (SELECT DISTINCT f, t FROM (SELECT f, t, ordinal FROM o WHERE g = 'head' EXCEPT SELECT f, t, ordinal FROM o WHERE g = 'base'))
      SELECT o.f || ' (hot) calls into crate::B' || l_suppkey || ' (io)' AS message FROM o JOIN new ON new.f = o.f AND new.t = o.t WHERE g = 'head' AND regexp_full_match(o.f, 'crate::O.*[05]') AND regexp_full_match('crate::B' || l_suppkey, 'crate::B[1-3].*')""",
    "q_destructive_migration": "SELECT * FROM (VALUES ('table `logs` dropped'), ('column `users.age` dropped'), ('column `users.id` type changed `Int4` -> `Int8`'), ('foreign key `logs -> users` removed')) x(message)",
    "q_verdict": NATIONS + """, every AS (SELECT * FROM layering UNION ALL SELECT * FROM sanity UNION ALL SELECT * FROM cycles)
      SELECT pair_id, count(*) FILTER (severity = 'deny') AS denials, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'deny') > 0 AS denied, (count(*) FILTER (severity = 'deny') > 0)::INT AS exit_code FROM pairs LEFT JOIN every USING (pair_id) GROUP BY pair_id""",
    "q_classify": EVENTS + "SELECT id, CASE WHEN h AND NOT b THEN 'added' WHEN NOT h THEN 'removed' ELSE 'context' END AS class FROM na",
    "q_classify_edges": EVENTS + "SELECT f AS from_id, t AS to_id, CASE WHEN h AND NOT b THEN 'added' WHEN NOT h THEN 'removed' ELSE 'context' END AS class FROM xa",
    "q_khop_prune": NATIONS + """, w AS (SELECT pair_id, f AS a, t AS b FROM hu WHERE f LIKE '%::N%' AND t LIKE '%::N%' UNION SELECT pair_id, t, f FROM hu WHERE f LIKE '%::N%' AND t LIKE '%::N%'),
      h0 AS (SELECT pair_id, 'crate::R0::N0' AS id FROM pairs), h1 AS (SELECT * FROM h0 UNION SELECT h0.pair_id, b FROM h0 JOIN w ON w.pair_id = h0.pair_id AND w.a = h0.id)
      SELECT * FROM h1 UNION SELECT h1.pair_id, b FROM h1 JOIN w ON w.pair_id = h1.pair_id AND w.a = h1.id""",
    "q_scope_stubs": NATIONS + """, inside AS (SELECT id FROM files WHERE starts_with(file, 'src/r0/')), every AS (SELECT * FROM hu UNION SELECT * FROM gone)
      SELECT pair_id, id, false AS stub FROM pairs, inside UNION
      SELECT pair_id, CASE WHEN f IN (SELECT id FROM inside) THEN t ELSE f END, true FROM every WHERE (f IN (SELECT id FROM inside)) <> (t IN (SELECT id FROM inside))""",
    "q_call_slice": """WITH p AS (SELECT r_regionkey AS r, lpad(r_regionkey::VARCHAR, 4, '0') AS path FROM region), q AS (SELECT n_nationkey AS n, r, path || '.' || lpad(n_nationkey::VARCHAR, 4, '0') AS path FROM nation JOIN p ON r = n_regionkey)
      SELECT 0::INT AS depth, 'root' AS caller, 'r' || r AS callee, path FROM p UNION ALL SELECT 1, 'r' || r, 'n' || n, path FROM q
      UNION ALL SELECT 2, 'n' || n, 's' || s_suppkey, path || '.' || lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INT, '0')[1:4] FROM q JOIN supplier ON s_nationkey = n UNION ALL SELECT 2, 'n' || n, 'root', path || '.00-1' FROM q""",
    "q_crate_deps": NATIONS + "SELECT DISTINCT g AS graph_id, split_part(f, '::', 2) AS from_id, split_part(t, '::', 2) AS to_id FROM uses WHERE split_part(f, '::', 2) <> split_part(t, '::', 2)",
    "q_crate_tiers": TREE + "SELECT id, tier::BIGINT AS tier FROM tiers",
    "q_layer_forbid_pairs": TREE + "SELECT 'tier' || a.tier AS from_layer, 'tier' || b.tier AS to_layer FROM (SELECT DISTINCT tier FROM tiers) a, (SELECT DISTINCT tier FROM tiers) b WHERE a.tier < b.tier",
    "q_file_index": """WITH r AS (SELECT page_id, split_part(url, '://', -1) AS rest FROM pages WHERE url LIKE '%://%'),
      f AS (SELECT page_id, split_part(rest, '/', 1) || '/' || split_part(CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 2) ELSE rest END, '?', 1) AS file FROM r)
      SELECT file, 'Modules' AS section, string_agg('`p' || page_id || '`', ',' ORDER BY 'p' || page_id) AS lines FROM f GROUP BY file""",
    "q_commit_pairs": DAYS + "SELECT repo, base AS parent, head AS commit_id FROM pairs",
    "q_walk": DAYS + "SELECT * FROM drift",
    "q_replay_totals": DAYS + """SELECT repo, count(*) AS pairs, coalesce(sum(added), 0)::BIGINT AS added, coalesce(sum(removed), 0)::BIGINT AS removed, 0::BIGINT AS modified, 0::BIGINT AS moved,
      coalesce(sum(edges_added), 0)::BIGINT AS edges_added, coalesce(sum(edges_removed), 0)::BIGINT AS edges_removed, coalesce(sum(total), 0)::BIGINT AS total FROM pairs LEFT JOIN drift ON pair_id = head GROUP BY ROLLUP (repo)""",
    "q_extract_fences": FENCES + "SELECT conv_id::VARCHAR AS pair_id, pos, block FROM f",
    "q_trace_delta": FENCES + """, s AS (SELECT (conv_id - abs(conv_id % 2))::VARCHAR AS pair_id, conv_id % 2 AS side, pos, block FROM f)
      SELECT pair_id, '+' AS side, pos, block FROM s x WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.pair_id = x.pair_id AND y.side = 0 AND y.block = x.block)
      UNION ALL SELECT pair_id, '-', pos, block FROM s x WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.pair_id = x.pair_id AND y.side = 1 AND y.block = x.block)""",
    "q_tree_edit_distance": """WITH l AS (SELECT floor(l_orderkey / 2)::BIGINT AS pair_id, l_orderkey % 2 AS side, string_agg(p_type[1], '' ORDER BY l_linenumber, l_partkey, l_suppkey, p_type[1]) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
      SELECT pair_id, levenshtein(coalesce(max(s) FILTER (side = 0), ''), coalesce(max(s) FILTER (side = 1), ''))::BIGINT AS cost FROM l GROUP BY pair_id""",
    "q_extract_nodes": PROFILES + """, o AS (SELECT DISTINCT o_orderstatus AS s FROM orders), gs AS (SELECT DISTINCT g FROM per),
      st AS (SELECT g, 'crate::n' || replace(split_part(id, '::', 2), 'N', '') AS home, split_part(id, '::', 3) AS name, count(DISTINCT regexp_replace(m, '[^0-9]', '', 'g')) AS n FROM b GROUP BY ALL)
      SELECT g AS graph_id, 'crate' AS id, 'Module' AS kind, NULL::BIGINT AS n_members FROM gs UNION ALL SELECT g, 'crate::shared', 'Module', NULL FROM gs UNION ALL SELECT DISTINCT g, home, 'Module', NULL FROM st
      UNION ALL SELECT g, home || '::' || name, 'Struct', n FROM st UNION ALL SELECT DISTINCT g, home || '::helper', 'Fn', 1 FROM st UNION ALL SELECT g, home || '::' || name || '::run', 'Fn', 0 FROM st UNION ALL SELECT g, home || '::' || name || '::run2', 'Fn', 0 FROM st
      UNION ALL SELECT g, 'crate::shared::Order', 'Enum', (SELECT count(*) FROM o) FROM gs UNION ALL SELECT g, 'crate::shared::Order::' || s, 'Variant', NULL FROM gs, o UNION ALL SELECT g, 'crate::shared::Order::next', 'Fn', 0 FROM gs""",
    "q_extract_edges": PROFILES + """, o AS (SELECT s, coalesce(lead(s) OVER (ORDER BY s), first_value(s) OVER (ORDER BY s)) AS t FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)), gs AS (SELECT DISTINCT g FROM per),
      st AS (SELECT DISTINCT g, 'crate::n' || replace(split_part(id, '::', 2), 'N', '') AS home, split_part(id, '::', 3) AS name FROM b)
      SELECT DISTINCT g AS graph_id, 'Uses' AS kind, home AS from_id, 'crate::shared' AS to_id, NULL::BIGINT AS ordinal FROM st UNION ALL SELECT g, 'Calls', home || '::' || name || '::run', home || '::helper', 0 FROM st
      UNION ALL SELECT g, 'Calls', home || '::' || name || '::run', home || '::' || name || '::run2', 1 FROM st UNION ALL SELECT g, 'Transitions', 'crate::shared::Order::' || s, 'crate::shared::Order::' || t, NULL FROM gs, o WHERE s <> t""",
    "q_extract_schema": """SELECT n_regionkey::VARCHAR AS graph_id, 'Table' AS kind, 'nations' AS id, 'key: Int4, ' || string_agg('n' || n_nationkey || ': Nullable<Text>', ', ' ORDER BY 'n' || n_nationkey) AS value FROM nation GROUP BY n_regionkey
      UNION ALL SELECT DISTINCT n_regionkey::VARCHAR, 'Table', 'regions', 'key: Int4, name: Varchar' FROM nation UNION ALL SELECT DISTINCT n_regionkey::VARCHAR, 'ForeignKey', 'nations', 'regions' FROM nation""",
}
