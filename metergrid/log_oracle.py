"""DuckDB SQL of the log readers: what the formats' rules give for the fields that the logs were written from."""

from __future__ import annotations

from metergrid.oracle import FILES

BASE = "b AS (SELECT event_id AS e, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events)"
READ = "id, ms, raw_model, project, session_id, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens"

CLAUDE = f"""{BASE},
a AS (SELECT *, e % 6 = 2 AS bare, CASE WHEN e % 6 <> 0 THEN 's' || u % 5 ELSE 'f' || u % 3 END AS session_id, CASE WHEN e % 5 <> 0 THEN 'm' || e % 300 END AS native_id, e % 7 = 0 AS sidechain,
  CASE WHEN e % 8 = 0 THEN 'priority' WHEN e % 3 = 0 THEN 'standard' ELSE '' END AS tier, CASE WHEN e % 4 <> 0 THEN '/w' ELSE 'Unknown project' END AS project
  FROM b WHERE e % 11 <> 0 AND e % 9 <> 0 AND e % 31 <> 0),
r AS (SELECT *, CASE WHEN native_id IS NOT NULL THEN 'claude:message:' || native_id || ':r' || e % 97 WHEN e % 10 = 5 THEN 'claude:uuid:u' || e ELSE 'claude:metadata:' || sha256('["' || session_id || '","' || iso || '",' || e || ']') END AS rid FROM a),
c AS (
  SELECT rid AS id, ms, CASE WHEN e % 9 = 1 THEN 'unknown' ELSE 'claude-x' END AS raw_model, project, session_id, CASE WHEN bare THEN 0 ELSE k END AS input_tokens, CASE WHEN bare THEN 0 ELSE e % 50 END AS output_tokens, CASE WHEN bare THEN 0 ELSE k * 2 END AS cache_read_tokens,
    CASE WHEN bare THEN 0 ELSE greatest(e % 30, e % 20 + e % 15) END AS cache_write_tokens, least(CASE WHEN bare THEN 0 ELSE e % 50 END, e % 60) AS reasoning_tokens, CASE WHEN bare THEN 0 ELSE e % 20 END AS cache_write_1h_tokens, tier AS service_tier, sidechain, native_id,
    CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS legacy_id, e AS line, u % 3 AS f FROM r
  UNION ALL SELECT 'claude:advisor:' || sha256('["' || rid || '",0]'), ms, 'adv', project, session_id, 3, 0, 0, 0, 0, 0, tier, sidechain, native_id, rid, 'claude:advisor:' || sha256('["' || rid || '",1]'), e, u % 3 FROM r WHERE e % 24 = 1
  UNION ALL SELECT 'claude:advisor:' || sha256('["' || rid || '",1]'), ms, 'adv2', project, session_id, 4, 0, 0, 0, 0, 0, tier, sidechain, native_id, rid, 'claude:advisor:' || sha256('["' || rid || '",2]'), e, u % 3 FROM r WHERE e % 12 = 1),
found AS (SELECT * FROM c WHERE input_tokens + output_tokens + cache_read_tokens + cache_write_tokens > 0),
empty AS (SELECT DISTINCT native_id, session_id, rid AS id FROM r WHERE native_id IS NOT NULL AND NOT sidechain AND NOT EXISTS (SELECT 1 FROM found WHERE found.f = r.u % 3 AND coalesce(parent_id, id) = r.rid))"""

COLLECTED = f"""{CLAUDE},
own AS (SELECT native_id, session_id, coalesce(parent_id, id) AS owner, true AS billed FROM found WHERE NOT sidechain AND native_id IS NOT NULL UNION ALL SELECT native_id, session_id, id, false FROM empty),
one AS (SELECT native_id, session_id, min(owner) AS owner FROM own GROUP BY 1, 2 HAVING count(DISTINCT owner) = 1 AND bool_or(billed)),
m AS (SELECT found.*, one.owner, found.sidechain AND one.owner IS NOT NULL AS replay FROM found LEFT JOIN one USING (native_id, session_id)),
kept AS (SELECT * FROM m WHERE NOT replay),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY sidechain, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens DESC, f, line) = 1)"""

CODEX = f"""{BASE}, i AS (SELECT *, u % 20 AS f, row_number() OVER (PARTITION BY u % 20 ORDER BY e) AS i FROM b),
t AS (SELECT *, sum(k * 10) OVER w AS ti, sum(k * 4) OVER w AS tc, sum(k) OVER w AS tw, sum(k % 7 + 1) OVER w AS t_o, sum(k % 9) OVER w AS tr,
  last_value(CASE WHEN i % 12 = 1 THEN 'g' || f END IGNORE NULLS) OVER o AS model, coalesce(last_value(CASE WHEN i % 18 = 1 THEN '/w' || f END IGNORE NULLS) OVER o, '/home') AS project, last_value(CASE WHEN i % 18 = 7 THEN 'flex' END IGNORE NULLS) OVER o AS tier
  FROM i WINDOW w AS (PARTITION BY f, i // 9 ORDER BY i), o AS (PARTITION BY f ORDER BY i ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, CASE WHEN i % 4 = 0 THEN 0 ELSE ti + t_o END AS tt FROM t WHERE i % 6 <> 1 AND i % 23 <> 0),
l AS (SELECT *, lag(ti) OVER p AS pi, lag(tc) OVER p AS pc, lag(tw) OVER p AS pw, lag(t_o) OVER p AS po, lag(tr) OVER p AS pr, lag(tt) OVER p AS pt FROM n WINDOW p AS (PARTITION BY f ORDER BY i)),
d AS (SELECT *, pi IS NULL OR ti < pi OR t_o < po OR (tt > 0 AND pt > 0 AND tt < pt) AS anew FROM l WHERE pi IS NULL OR (ti, tc, tw, t_o, tr, tt) <> (pi, pc, pw, po, pr, pt)),
x AS (SELECT *, CASE WHEN i % 5 = 0 THEN 3 WHEN anew THEN ti ELSE greatest(0, ti - pi) END AS ai, CASE WHEN i % 5 = 0 THEN 5 WHEN anew THEN tc ELSE greatest(0, tc - pc) END AS ac, CASE WHEN i % 5 = 0 THEN 0 WHEN anew THEN tw ELSE greatest(0, tw - pw) END AS aw,
  CASE WHEN i % 5 = 0 THEN 2 WHEN anew THEN t_o ELSE greatest(0, t_o - po) END AS ao, CASE WHEN i % 5 = 0 THEN 0 WHEN anew THEN tr ELSE greatest(0, tr - pr) END AS ar FROM d),
y AS (SELECT *, least(ac, ai) AS cache_read_tokens, least(aw, ai - least(ac, ai)) AS cache_write_tokens, least(ar, ao) AS reasoning_tokens FROM x), z AS (SELECT *, ai - cache_read_tokens - cache_write_tokens AS input_tokens FROM y)
SELECT 'codex:total:' || sha256('["sess' || f || '","' || iso || '",' || concat_ws(',', CAST(input_tokens AS BIGINT), CAST(ao AS BIGINT), CAST(cache_read_tokens AS BIGINT), CAST(cache_write_tokens AS BIGINT), CAST(reasoning_tokens AS BIGINT)) || ']') AS id, ms, coalesce(model, 'unknown') AS raw_model, project,
  'sess' || f AS session_id, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(ao AS BIGINT) AS output_tokens, CAST(cache_read_tokens AS BIGINT) AS cache_read_tokens, CAST(cache_write_tokens AS BIGINT) AS cache_write_tokens, CAST(reasoning_tokens AS BIGINT) AS reasoning_tokens,
  coalesce(tier, '') AS service_tier, i + 1 AS line FROM z WHERE ai + ao > 0"""

PI = f"""{BASE}, m AS (SELECT *, u % 20 AS f, e % 13 <> 0 AND e % 10 <> 0 AS used, CASE WHEN e % 13 = 0 THEN 'p' || e % 5 WHEN e % 10 <> 0 AND e % 29 = 0 THEN 'own' END AS said FROM b),
c AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY f ORDER BY e ROWS UNBOUNDED PRECEDING) AS model FROM m)
SELECT CASE WHEN e % 17 <> 0 THEN 'pi:s' || f || ':m' || e ELSE 'pi:metadata:' || sha256('["s' || f || '","' || iso || '",' || e + 1 || ']') END AS id, ms, coalesce(model, 'unknown') AS raw_model, CASE WHEN f % 4 = 0 THEN 'Unknown project' ELSE '/w' END AS project, 's' || f AS session_id,
  k AS input_tokens, e % 40 AS output_tokens, k * 3 AS cache_read_tokens, e % 25 AS cache_write_tokens, least(e % 60, e % 40) AS reasoning_tokens, least(e % 30, e % 25) AS cache_write_1h_tokens FROM c WHERE used AND k * 4 + e % 40 + e % 25 > 0"""

GROK = f"""{BASE}, r AS (SELECT *, e % 8 = 0 AS whole FROM b WHERE e % 50 > 0 AND (u % 5 = 0 OR u % 11 <> 0)),
x AS (SELECT *, CASE WHEN whole THEN CASE WHEN e % 16 = 0 THEN 'prime' ELSE 'dm' END ELSE 'g' || e % 3 || '/x' END AS raw_model, CASE WHEN whole THEN k ELSE k * 10 END AS i, CASE WHEN whole THEN 1 ELSE e % 30 END AS o, CASE WHEN whole THEN 0 ELSE k * 4 END AS rd FROM r WHERE whole OR e % 14 <> 0),
y AS (SELECT *, CASE WHEN whole THEN 0 ELSE least(i - rd, k * 8) END AS w FROM x)
SELECT 'grok:turn:s%20' || u || ':' || e % 50 || ':' || replace(raw_model, '/', '%2F') AS id, ms, raw_model, '/w' AS project, 's ' || u AS session_id, i - rd - w AS input_tokens, o AS output_tokens, rd AS cache_read_tokens, w AS cache_write_tokens,
  CASE WHEN whole THEN 0 ELSE least(o, e % 50) END AS reasoning_tokens, CASE WHEN NOT whole AND e % 9 <> 0 AND e % 7 <> 0 AND e % 5 > 0 THEN e % 5 * 1000000 / 1e10 END AS reported_cost_usd, CASE WHEN NOT whole THEN CAST(e % 6 AS INTEGER) END AS requests FROM y WHERE i + o > 0"""

MUSE = f"""{BASE}, m AS (SELECT *, u % 20 AS f, CASE WHEN e % 13 = 0 THEN 'mm' || e % 4 END AS said, CASE WHEN e % 26 = 0 THEN '/ws' END AS dir FROM b WHERE e % 13 = 0 OR e % 19 <> 0),
c AS (SELECT *, last_value(said IGNORE NULLS) OVER w AS model, last_value(dir IGNORE NULLS) OVER w AS project FROM m WINDOW w AS (PARTITION BY f ORDER BY e ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, k * 9 AS i, k * 4 AS rd, least(k * 5, k * 7) AS w, 'st' || f AS session_id FROM c WHERE e % 13 <> 0),
o AS (SELECT *, CASE WHEN e % 4 = 0 THEN e || '.0' WHEN e % 3 = 0 THEN '"' || e || ':0:3"' WHEN e % 3 = 1 THEN '"' || e || ':3"' ELSE CAST(e AS VARCHAR) END AS ordinal FROM x)
SELECT CASE WHEN e % 6 <> 0 THEN 'muse:record:r' || e ELSE 'muse:metadata:' || sha256('["' || session_id || '","' || iso || '",' || replace(ordinal, '.0', '') || ']') END AS id, ms, CASE WHEN e % 5 = 0 THEN 'own' ELSE coalesce(model, 'unknown') END AS raw_model, coalesce(project, 'Unknown project') AS project, session_id,
  i - rd - w AS input_tokens, e % 20 AS output_tokens, rd AS cache_read_tokens, w AS cache_write_tokens, least(e % 20, e % 30) AS reasoning_tokens FROM o WHERE i + e % 20 > 0"""

BILLING = f"""{BASE} SELECT 'cursor:billing-item:item-' || e AS id, ms, CASE WHEN e % 3 = 0 THEN 'cursor/unknown' ELSE 'auto' END AS raw_model, 'Cursor billing' AS project, '' AS session_id, k AS input_tokens, e % 30 AS output_tokens, CASE WHEN e % 2 = 0 THEN e % 70 ELSE 0 END AS cache_read_tokens,
  CASE WHEN e % 2 = 1 THEN e % 70 ELSE 0 END AS cache_write_tokens, 0 AS reasoning_tokens, CAST(0 AS INTEGER) AS requests FROM b WHERE e % 5 <> 0 AND e % 7 <> 0"""


THREADS = """c AS (SELECT c_custkey AS c, c_nationkey AS n, c_custkey % 2 AS db FROM customer), o AS (SELECT o_orderkey AS o, o_custkey AS c, o_custkey % 2 AS db, ['claude', 'codex', 'pi', NULL][o_orderkey % 4 + 1] AS harness, 'n' || o_orderkey % 900 AS native FROM orders),
b AS (SELECT harness, native AS session_id, c, db * 3 AS place, o % 50 AS newest FROM o JOIN c USING (c, db) WHERE o % 3 = 0 AND o % 11 <> 0
 UNION ALL SELECT harness, CASE WHEN o % 7 = 0 THEN 'z' ELSE native END, c, db * 3 + 1, NULL FROM o JOIN c USING (c, db) WHERE o % 3 = 1 AND c % 3 > 0
 UNION ALL SELECT harness, CASE WHEN o % 7 <> 0 THEN native WHEN o % 2 <> 0 THEN 'y' END, c, db * 3 + 2, NULL FROM o JOIN c USING (c, db) WHERE o % 3 = 2 AND c % 3 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY harness, session_id ORDER BY place, newest DESC NULLS LAST, 't ' || c) AS i FROM b WHERE harness IS NOT NULL AND session_id IS NOT NULL),
gone AS (SELECT c, min(place) AS gone_at FROM (SELECT c, db * 3 AS place FROM c WHERE c % 13 = 0 UNION ALL SELECT c, place FROM b WHERE harness IS NOT NULL AND session_id IS NOT NULL AND CASE WHEN place % 3 = 0 THEN c % 13 = 0 ELSE c % 17 = 0 END) GROUP BY 1),
f AS (SELECT k.*, c.n, place % 3 = 0 AS new, coalesce(gone_at <= place, false) AS dead, CASE WHEN n = 7 OR n % 3 = 0 THEN NULL ELSE '/w/' || n END AS root,
  CASE WHEN place % 3 = 0 AND k.c % 4 <> 0 THEN '/w/' || n WHEN place % 3 > 0 AND k.c % 2 = 0 THEN '/old/' || k.c END AS tree, CASE WHEN n <> 7 AND n % 6 <> 0 THEN n_name END AS project_name FROM k JOIN c USING (c) LEFT JOIN gone USING (c) LEFT JOIN nation ON n_nationkey = n WHERE i = 1)
SELECT harness, session_id, 't ' || c AS thread_id, CASE WHEN dead THEN NULL WHEN NOT new THEN 'Old ' || c WHEN c % 5 <> 0 THEN 'Title ' || c END AS session_title, CASE WHEN NOT dead THEN project_name END AS project_name,
  CASE WHEN dead THEN '' ELSE 'https://host.example/base/env%201/t%20' || c END AS thread_url, CASE WHEN dead THEN '' WHEN tree = root THEN tree ELSE concat_ws(',', tree, root) END AS repository_paths, CASE WHEN NOT dead THEN coalesce(tree, root) END AS project FROM f"""

GENERATIONS = """RECURSIVE r AS (SELECT 'g' || o_custkey AS id, o_orderkey AS seq, ['unknown', 'a', 'b'][o_orderkey % 3 + 1] AS model, ['', '', 'fast', 'slow'][o_orderkey % 4 + 1] AS tier, o_orderkey * 7 % 10 AS input_tokens, o_orderkey * 7 % 10 + o_orderkey % 2 AS t,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT * FROM r WHERE i = 1 UNION ALL SELECT r.id, CASE WHEN r.t > s.t THEN r.seq ELSE s.seq END, CASE WHEN r.t > s.t THEN CASE WHEN r.model <> 'unknown' THEN r.model ELSE s.model END WHEN s.model <> 'unknown' THEN s.model ELSE r.model END,
 CASE WHEN r.t > s.t THEN CASE WHEN r.tier <> '' THEN r.tier ELSE s.tier END WHEN s.tier <> '' THEN s.tier ELSE r.tier END, CASE WHEN r.t > s.t THEN r.input_tokens ELSE s.input_tokens END, greatest(r.t, s.t), r.i FROM s JOIN r ON r.id = s.id AND r.i = s.i + 1)
SELECT id, seq, model, tier, input_tokens FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1"""

WORKSPACES = """SELECT c_custkey AS c, CASE c_custkey % 3 WHEN 0 THEN 'alpha-high' WHEN 2 THEN 'beta' ELSE ['gamma', 'delta-low', 'unknown', 'unknown'][c_custkey % 4 + 1] END AS model,
 CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 THEN '/git/' || c_nationkey WHEN c_custkey % 5 <> 0 THEN '/w/a ' || c_nationkey WHEN c_custkey % 3 = 0 THEN '/last+one' ELSE '' END AS project,
 CASE WHEN c_custkey % 4 = 0 AND c_custkey % 7 <> 0 THEN 'host.example/Team/Repo' END AS repository FROM customer"""


# Written from the rules themselves: every generator against every step of its conversation.
CALLS = """RECURSIVE ev AS (SELECT 'c ' || user_id % 40 AS c, user_id AS u, event_id AS e, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
  row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS i FROM events),
base AS (SELECT *, e % 13 <> 0 AS used, CASE WHEN e % 13 <> 0 AND e % 11 <> 0 THEN k ELSE 0 END AS n_in, CASE WHEN e % 11 = 0 THEN 0 WHEN e % 4 <> 0 AND e % 50 > 0 THEN e % 50 ELSE e % 9 + e % 6 END AS n_out,
  CASE WHEN e % 11 = 0 THEN 0 ELSE e % 3 END AS n_read, CASE WHEN e % 11 = 0 THEN 0 ELSE e % 9 END AS thought, CASE WHEN e % 2 = 0 THEN '' ELSE 'tier' || e % 3 END AS tier, e % 5 AS enum, CASE WHEN e % 3 = 0 THEN 'x' || e % 6 ELSE '' END AS run, CASE WHEN e % 16 = 5 THEN 'r' ELSE 'm' END || (i // 5 + e % 3) AS mid FROM ev),
unlike AS (SELECT c, i, e, used, n_in, n_out, n_read, least(n_out, thought) AS n_think, n_in + n_out + n_read AS total, tier, (enum + 1) % 7 AS enum, run, CASE WHEN e % 9 <> 0 THEN iso END AS stamp,
  [CASE WHEN e % 5 < 2 THEN '' ELSE 'r' || (i // 3 + e % 2) END, CASE WHEN e % 4 = 0 THEN '' ELSE mid END, CASE WHEN e % 6 = 0 THEN 'p' || (i // 4) ELSE '' END] AS ids FROM base WHERE e % 3 <> 1),
likely AS (SELECT c, i, e, used, n_in, n_out, n_read, least(n_out, thought) AS n_think, n_in + n_out + n_read AS total, tier, enum, run, CASE e % 5 WHEN 0 THEN [] WHEN 1 THEN [i] WHEN 2 THEN [i + 1, i] ELSE [i - 1, i + 2, i] END AS refs,
  [CASE WHEN e % 3 = 0 THEN '' ELSE 'r' || (i // 3 + (e // 2) % 2) END, CASE WHEN e % 7 < 3 THEN '' ELSE mid END, CASE WHEN e % 5 = 4 THEN 'p' || (i // 4) ELSE '' END] AS ids, CASE WHEN e % 4 = 0 THEN 'a-high' WHEN e % 6 = 1 THEN 'gamma' END AS named FROM base WHERE e % 4 <> 3),
s AS (SELECT *, ids[1] AS rid, list_filter(ids, lambda x, j: x <> '' AND list_position(ids, x) = j) AS al FROM unlike),
g AS (SELECT *, ids[1] AS rid, list_filter(ids, lambda x, j: x <> '' AND list_position(ids, x) = j) AS al FROM likely),
spare AS (SELECT c, CASE WHEN min(u) % 3 = 0 THEN min(iso) END AS spare FROM ev GROUP BY c),
ran AS (SELECT c, 'x' || e % 6 AS run, arg_max('run' || e % 7, i) AS ran FROM ev WHERE e % 10 = 0 GROUP BY 1, 2),
numbered AS (SELECT c, enum, arg_min(named, i) AS numbered FROM g WHERE named IS NOT NULL AND enum > 0 GROUP BY 1, 2),
both_ AS (SELECT c, rid, al FROM s WHERE used UNION ALL SELECT c, rid, al FROM g WHERE used),
named AS (SELECT c, a, count(DISTINCT rid) AS n, min(rid) AS one FROM (SELECT c, rid, unnest(al) AS a FROM both_ WHERE rid <> '') WHERE a <> rid GROUP BY 1, 2),
stepped AS (SELECT c, list(DISTINCT rid) AS rids FROM s WHERE used AND rid <> '' GROUP BY c), held AS (SELECT c, list(DISTINCT a) AS held FROM (SELECT c, unnest(al) AS a FROM s WHERE used) GROUP BY c),
known AS (SELECT c, map_from_entries(list((a, one)) FILTER (n = 1)) AS ones, list(a) FILTER (n > 1) AS vague FROM named GROUP BY c),
pair AS (SELECT g.c, g.i, g.rid, g.al, s.i AS si, s.used, s.rid AS srid, s.al AS sal, s.stamp, list_position(g.refs, s.i) AS pos, CASE WHEN g.rid <> '' AND s.rid <> '' THEN g.rid = s.rid ELSE len(g.al) = 0 OR len(s.al) = 0 OR list_has_any(g.al, s.al) END AS fits FROM g JOIN s USING (c) WHERE g.used),
hit AS (SELECT c, i, coalesce(min(si) FILTER (used AND rid <> '' AND srid = rid AND pos > 0), min(si) FILTER (used AND rid <> '' AND srid = rid),
  min(si) FILTER (used AND fits AND list_contains(sal, al[1]) AND pos > 0), CASE WHEN count(*) FILTER (used AND fits AND list_contains(sal, al[1])) = 1 THEN min(si) FILTER (used AND fits AND list_contains(sal, al[1])) END,
  min(si) FILTER (used AND fits AND list_contains(sal, al[2]) AND pos > 0), CASE WHEN count(*) FILTER (used AND fits AND list_contains(sal, al[2])) = 1 THEN min(si) FILTER (used AND fits AND list_contains(sal, al[2])) END,
  min(si) FILTER (used AND fits AND list_contains(sal, al[3]) AND pos > 0), CASE WHEN count(*) FILTER (used AND fits AND list_contains(sal, al[3])) = 1 THEN min(si) FILTER (used AND fits AND list_contains(sal, al[3])) END,
  arg_min(si, pos) FILTER (pos > 0 AND used AND fits), arg_min(si, pos) FILTER (pos > 0 AND NOT used)) AS hit, arg_min(si, pos) FILTER (pos > 0) AS near, arg_min(stamp, pos) FILTER (pos > 0 AND stamp IS NOT NULL) AS near_stamp FROM pair GROUP BY c, i),
m AS (SELECT g.*, hit, near, coalesce(s.stamp, near_stamp, spare) AS stamp, s.i IS NOT NULL AND NOT s.used AS bare, coalesce(s.used AND CASE WHEN g.rid <> '' AND s.rid <> '' THEN g.rid = s.rid ELSE len(g.al) = 0 OR len(s.al) = 0 OR list_has_any(g.al, s.al) END, false) AS fit, s.ids AS sids, s.rid AS srid, s.al AS sal, s.enum AS senum, s.run AS srun, s.tier AS stier
  FROM g LEFT JOIN hit USING (c, i) LEFT JOIN s ON s.c = g.c AND s.i = hit JOIN spare ON spare.c = g.c WHERE g.used),
shared AS (SELECT c, hit, count(DISTINCT CASE WHEN rid <> '' THEN rid ELSE srid END) > 1 AS shared FROM m WHERE fit AND (rid <> '' OR srid <> '') GROUP BY 1, 2),
w AS (SELECT m.*, (fit OR bare) AND NOT coalesce(shared, false) AS prices, CASE WHEN fit THEN al || list_filter(sal, lambda x: NOT list_contains(al, x)) ELSE al END AS every, CASE WHEN rid <> '' THEN rid WHEN fit THEN srid ELSE '' END AS own, CASE WHEN fit THEN sal[1] END AS first_ FROM m LEFT JOIN shared USING (c, hit) WHERE stamp IS NOT NULL AND total > 0),
call_g AS (SELECT w.*, CASE WHEN own <> '' THEN own ELSE list_filter(list_transform(every, lambda a: ones[a]), lambda x: x IS NOT NULL)[1] END AS led, coalesce(rids, []) AS rids, coalesce(held, []) AS held, coalesce(vague, []) AS vague FROM w LEFT JOIN known USING (c) LEFT JOIN stepped USING (c) LEFT JOIN held USING (c)),
id_g AS (SELECT *, CASE WHEN led IS NOT NULL AND list_contains(rids, led) THEN led WHEN first_ IS NOT NULL AND NOT (rid <> '' AND list_contains(vague, first_)) THEN first_
  ELSE coalesce(list_filter(every, lambda a: a <> rid AND list_contains(held, a) AND NOT (rid <> '' AND list_contains(vague, a)))[1], led, al[1]) END AS call FROM call_g),
row_g AS (SELECT c, i, i AS seq, call, every, fit, fit OR bare AS by_step, hit, CASE WHEN call IS NOT NULL THEN ':response:' || call WHEN coalesce(hit, near) IS NOT NULL THEN ':step:' || coalesce(hit, near) ELSE ':gen:' || i END AS id, refs, CASE WHEN rid = '' AND fit THEN srid ELSE rid END AS covers,
  list_filter([CASE WHEN ids[1] = '' AND fit THEN sids[1] ELSE ids[1] END, CASE WHEN ids[2] = '' AND fit THEN sids[2] ELSE ids[2] END, CASE WHEN ids[3] = '' AND fit THEN sids[3] ELSE ids[3] END], lambda x: x <> '') AS covered, stamp, n_in, n_out, n_read, n_think, total,
  coalesce(named, numbered, ran, 'unknown') AS model, CASE WHEN tier <> '' THEN tier WHEN prices AND fit THEN stier ELSE '' END AS tier FROM (SELECT * REPLACE (CASE WHEN enum > 0 THEN enum WHEN prices THEN senum ELSE 0 END AS enum, CASE WHEN run <> '' THEN run WHEN prices THEN srun ELSE '' END AS run) FROM id_g) LEFT JOIN numbered USING (c, enum) LEFT JOIN ran USING (c, run)),
open_ AS (SELECT * REPLACE (coalesce(stamp, spare) AS stamp) FROM s JOIN spare USING (c) WHERE used AND coalesce(stamp, spare) IS NOT NULL AND total > 0
  AND CASE WHEN len(al) > 0 THEN NOT EXISTS (FROM row_g r WHERE r.c = s.c AND list_has_any(r.covered, s.al) AND (r.covers = '' OR s.rid = '' OR r.covers = s.rid))
    ELSE NOT EXISTS (FROM row_g r WHERE r.c = s.c AND (list_contains(r.refs, s.i) OR r.by_step AND r.hit = s.i)) END),
line AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) AS n FROM open_ WHERE len(al) > 0),
walk AS (SELECT c, n, true AS kept, list_transform(al, lambda a: {'a': a, 'rid': rid}) AS seen FROM line WHERE n = 1 UNION ALL
  SELECT l.c, l.n, NOT hid, CASE WHEN hid THEN seen ELSE seen || list_transform(al, lambda a: {'a': a, 'rid': rid}) END FROM (SELECT line.*, w.seen, len(list_filter(w.seen, lambda x: list_contains(line.al, x.a) AND (x.rid = '' OR line.rid = '' OR x.rid = line.rid))) > 0 AS hid FROM walk w JOIN line ON line.c = w.c AND line.n = w.n + 1) l),
fall AS (SELECT * EXCLUDE (n) FROM line JOIN walk USING (c, n) WHERE kept), rest AS (SELECT c, i, rid, al, stamp, n_in, n_out, n_read, n_think, total, tier, enum, run FROM fall UNION ALL SELECT c, i, rid, al, stamp, n_in, n_out, n_read, n_think, total, tier, enum, run FROM open_ WHERE len(al) = 0),
led_s AS (SELECT rest.*, CASE WHEN rid <> '' THEN rid ELSE list_filter(list_transform(al, lambda a: ones[a]), lambda x: x IS NOT NULL)[1] END AS led, coalesce(rids, []) AS rids, coalesce(held, []) AS held, coalesce(vague, []) AS vague FROM rest LEFT JOIN known USING (c) LEFT JOIN stepped USING (c) LEFT JOIN held USING (c)),
id_s AS (SELECT *, CASE WHEN led IS NOT NULL AND list_contains(rids, led) THEN led ELSE coalesce(list_filter(al, lambda a: a <> rid AND list_contains(held, a) AND NOT (rid <> '' AND list_contains(vague, a)))[1], led, al[1]) END AS call FROM led_s),
row_s AS (SELECT c, i, i + 1099511627776 AS seq, call, al AS every, CASE WHEN call IS NOT NULL THEN ':response:' || call ELSE ':step:' || i END AS id, stamp, n_in, n_out, n_read, n_think, total, coalesce(numbered, ran, 'unknown') AS model, tier FROM id_s LEFT JOIN numbered USING (c, enum) LEFT JOIN ran USING (c, run)),
r AS (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY seq) AS n FROM (SELECT c, id, seq, stamp, n_in, n_out, n_read, n_think, total, model, tier FROM row_g UNION ALL SELECT c, id, seq, stamp, n_in, n_out, n_read, n_think, total, model, tier FROM row_s)),
f AS (SELECT c, id, n, stamp, n_in, n_out, n_read, n_think, total, model, tier FROM r WHERE n = 1 UNION ALL
  SELECT r.c, r.id, r.n, CASE WHEN r.total > f.total THEN r.stamp ELSE f.stamp END, CASE WHEN r.total > f.total THEN r.n_in ELSE f.n_in END, CASE WHEN r.total > f.total THEN r.n_out ELSE f.n_out END, CASE WHEN r.total > f.total THEN r.n_read ELSE f.n_read END, CASE WHEN r.total > f.total THEN r.n_think ELSE f.n_think END, greatest(r.total, f.total),
  CASE WHEN r.total > f.total THEN CASE WHEN r.model <> 'unknown' THEN r.model ELSE f.model END WHEN f.model <> 'unknown' THEN f.model ELSE r.model END, CASE WHEN r.total > f.total THEN CASE WHEN r.tier <> '' THEN r.tier ELSE f.tier END WHEN f.tier <> '' THEN f.tier ELSE r.tier END
  FROM f JOIN r ON r.c = f.c AND r.id = f.id AND r.n = f.n + 1),
calls AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c, id ORDER BY n DESC) = 1)"""
GROK_SESSIONS = """s AS (SELECT c_custkey AS c, CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey % 11 = 0 THEN 'gone' || c_custkey WHEN c_custkey % 50 = 49 THEN CAST(c_custkey - 1 AS VARCHAR) WHEN c_custkey % 50 = 48 THEN CAST(c_custkey + 1 AS VARCHAR) WHEN c_custkey >= 7 THEN CAST(c_custkey // 7 AS VARCHAR) END AS parent_id,
  c_custkey * 50 AS forked_ms FROM customer),
sub AS (SELECT session_id, CASE WHEN c % 18 = 2 THEN CAST(c // 2 AS VARCHAR) WHEN c % 9 = 2 THEN CAST(c // 3 AS VARCHAR) ELSE parent_id END AS up FROM s WHERE c % 9 = 2 OR c % 4 = 1)"""
GROK_FORKS = f"""WITH RECURSIVE {GROK_SESSIONS}, o AS (SELECT o_custkey AS p, o_orderkey AS o FROM orders),
r AS (SELECT DISTINCT CAST(c AS VARCHAR) AS session_id, c, o % 9 AS turn, 'm ' || o % 2 AS raw_model, ms FROM (SELECT p AS c, o, o * 10 AS ms FROM o UNION ALL SELECT c, o, o * 10 + (o + c) % 6 - 2 FROM s JOIN o ON p = c // 7 WHERE o % 3 <> 0 AND parent_id IS NOT NULL
  UNION ALL SELECT c, o, o * 10 FROM s JOIN o ON p = c // 49 WHERE o % 4 = 0) UNION SELECT session_id, c, 3, 'm 1', forked_ms FROM s WHERE c % 11 = 0),
near AS (SELECT DISTINCT session_id AS parent_id, turn, raw_model, ms + unnest([-2, -1, 0, 1, 2]) AS ms, true AS near FROM r),
w AS (SELECT session_id, turn, raw_model, ms, session_id AS owner, CAST([] AS VARCHAR[]) AS seen FROM r UNION ALL
  SELECT w.session_id, w.turn, w.raw_model, w.ms, s.parent_id, list_append(seen, w.owner) FROM w JOIN s ON s.session_id = w.owner LEFT JOIN near ON near.parent_id = s.parent_id AND near.turn = w.turn AND near.raw_model = w.raw_model AND near.ms = w.ms LEFT JOIN s AS q ON q.session_id = s.parent_id
  WHERE s.parent_id IS NOT NULL AND NOT list_contains(seen, w.owner) AND (near OR w.ms < s.forked_ms OR (q.session_id IS NULL AND w.ms = s.forked_ms))),
f AS (SELECT session_id, turn, raw_model, ms, arg_max(owner, len(seen)) AS owner FROM w GROUP BY ALL)
SELECT c AS copy, owner AS session_id, turn, raw_model, ms, 'grok:turn:' || owner || ':' || turn || ':' || replace(raw_model, ' ', '%20') AS id, owner <> session_id AS sidechain FROM r JOIN f USING (session_id, turn, raw_model, ms)"""
GROK_ROOTS = f"""WITH RECURSIVE {GROK_SESSIONS},
w AS (SELECT session_id, up, [session_id] AS seen FROM sub UNION ALL SELECT w.session_id, sub.up, list_append(seen, w.up) FROM w JOIN sub ON sub.session_id = w.up WHERE NOT list_contains(seen, w.up)),
e AS (SELECT session_id, arg_max({{'up': up}}, len(seen)).up AS up FROM w GROUP BY 1), g AS (SELECT e.session_id, CASE WHEN s.session_id IS NOT NULL AND sub.session_id IS NULL THEN e.up END AS root, s.c % 6 <> 0 AS read FROM e LEFT JOIN s ON s.session_id = e.up LEFT JOIN sub ON sub.session_id = e.up)
SELECT session_id, root, NOT coalesce(root IS NOT NULL AND read, false) AS orphan FROM g"""
GROK_FALLBACK = f"""WITH {GROK_SESSIONS}, o AS (SELECT o_custkey AS c, o_orderkey AS o, (1704067200 + o_orderkey) * 1000 AS ms FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT session_id FROM sub)),
b AS (SELECT c, bool_or(c % 10 = 0 OR o % 89 = 0 OR o % 97 = 0) AND c % 3 <> 0 AS left_ FROM o GROUP BY 1),
l AS (SELECT c, o AS turn, ms, o % 70 AS i, least(o % 70, o % 40) AS rd, o % 30 AS out FROM o JOIN b USING (c) WHERE NOT left_ AND c % 10 <> 0 AND o % 89 <> 0 AND o % 97 <> 0),
u AS (SELECT c, dense_rank() OVER (PARTITION BY c ORDER BY o // 6) AS turn, ms, o % 60 AS i, 0 AS rd, o % 25 AS out, o FROM o JOIN b USING (c) WHERE left_ QUALIFY row_number() OVER (PARTITION BY c, o // 6 ORDER BY o DESC) = 1)
SELECT 'grok:turn:' || c || ':' || turn || ':dm' AS id, ms, CAST(c AS VARCHAR) AS session_id, i - rd AS input_tokens, rd AS cache_read_tokens, out AS output_tokens FROM (SELECT * FROM l UNION ALL SELECT * EXCLUDE (o) FROM u) WHERE i + out > 0"""
CALL_ID = "'antigravity:' || replace(c, ' ', '%20') || id"


def oracle_sql() -> dict[str, str]:
    return {
        "reader_claude": f"WITH {CLAUDE} SELECT {READ}, cache_write_1h_tokens, service_tier, sidechain, native_id, parent_id, legacy_id, line FROM found",
        "claude_empty_requests": f"WITH {CLAUDE} SELECT * FROM empty",
        "collected_claude": f"WITH {COLLECTED} SELECT id, session_id, input_tokens, sidechain FROM best",
        "collected_retractions": f"WITH {COLLECTED} SELECT DISTINCT id FROM (SELECT id FROM m WHERE replay AND owner <> coalesce(parent_id, id) UNION ALL SELECT legacy_id FROM kept WHERE legacy_id IS NOT NULL) WHERE id NOT IN (SELECT id FROM best)",
        "source_status": """WITH f AS (SELECT 'h' || c_custkey % 3 AS harness, '/p' || c_nationkey AS path, c_custkey % 4 AS events, CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS malformed, c_nationkey % 5 = 0 AS bad FROM customer),
g AS (SELECT harness, path, count(*) AS files, CAST(sum(events) AS BIGINT) AS events, CAST(sum(malformed) AS BIGINT) AS malformed, CAST(count(*) FILTER (bad) AS BIGINT) AS unreadable FROM f GROUP BY 1, 2)
SELECT *, CASE WHEN unreadable = files THEN 'error' WHEN unreadable + malformed > 0 THEN 'partial' WHEN events = 0 THEN 'empty' ELSE 'ready' END AS status FROM g""",
        "reader_codex": f"WITH {CODEX}",
        "streamed_codex": f"WITH {CODEX}",
        "reader_pi": f"WITH {PI}",
        "reader_grok": f"WITH {GROK}",
        "reader_muse": f"WITH {MUSE}",
        "thread_metadata": f"WITH {THREADS}",
        "merged_generations": f"WITH {GENERATIONS}",
        "generation_workspaces": WORKSPACES,
        "snapshot_halves": """WITH b AS (SELECT event_id AS e, user_id % 10 AS agent, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), c AS (SELECT *, e % 4 = 0 AS one, agent < 5 AND (e % 8 = 0 OR e % 7 = 0) AS two, e % 4 = 0 AND agent >= 5 AS stays FROM b)
SELECT 'b:' || e AS id, 'a' || agent AS session_id, CASE WHEN e % 9 = 0 THEN k + 2 ELSE k END AS input_tokens, 'active' AS half FROM b WHERE e % 6 = 0 OR e % 9 = 0
UNION ALL SELECT 'c:' || e, 'a' || agent, CASE WHEN two THEN k + 1 ELSE k END, 'parked' FROM c WHERE two OR stays UNION ALL SELECT 'c:' || e, NULL, NULL, 'withdrawn' FROM c WHERE one OR two OR stays""",
        "wire_generators": f"""WITH {CALLS.split("both_ AS")[0].rstrip().rstrip(",")}, w AS (SELECT g.*, b.k, i % 10 = 9 AS bad FROM g JOIN base b USING (c, i, e))
SELECT c AS conversation, i AS idx, bad AS malformed, CASE WHEN NOT bad THEN array_to_string(list_filter(refs, lambda x: x >= 0), ',') END AS steps, CASE WHEN NOT bad THEN enum END AS model_enum, CASE WHEN used AND NOT bad THEN ids[1] END AS response_id, CASE WHEN used AND NOT bad THEN ids[2] END AS message_id, CASE WHEN used AND NOT bad THEN ids[3] END AS provider_id,
  CASE WHEN used AND NOT bad THEN CASE WHEN e % 2 = 0 THEN '' ELSE 'Tier' || e % 3 END END AS tier, CASE WHEN NOT bad THEN CASE WHEN e % 4 = 0 THEN 'models/a-high' ELSE '' END END AS response_model, CASE WHEN NOT bad THEN CASE WHEN e % 6 = 1 THEN 'models/gamma-low' ELSE '' END END AS planner_model, CASE WHEN NOT bad THEN run END AS execution_id,
  CASE WHEN used AND NOT bad THEN n_in END AS input_tokens, CASE WHEN used AND NOT bad THEN CASE WHEN e % 11 = 0 OR e % 4 = 0 THEN 0 ELSE e % 50 END END AS output_tokens, CASE WHEN used AND NOT bad THEN n_read END AS cache_read_tokens, CASE WHEN used AND NOT bad THEN 0 END AS cache_write_tokens,
  CASE WHEN used AND NOT bad THEN CASE WHEN e % 11 = 0 THEN 0 ELSE e % 9 END END AS thinking_tokens, CASE WHEN used AND NOT bad THEN CASE WHEN e % 11 = 0 THEN 0 ELSE e % 6 END END AS response_tokens FROM w""",
        "grok_forks": GROK_FORKS,
        "grok_roots": GROK_ROOTS,
        "grok_fallback": GROK_FALLBACK,
        "reconciled_calls": f"WITH {CALLS} SELECT {CALL_ID} AS id, c AS conversation, stamp, model, tier, n_in AS input_tokens, n_out AS output_tokens, n_read AS cache_read_tokens, 0 AS cache_write_tokens, n_think AS reasoning_tokens FROM calls",
        "reconciled_withdrawn": f"""WITH {CALLS}, gone AS (SELECT c, ':response:' || a AS id FROM (SELECT c, call, unnest(every) AS a FROM row_g UNION ALL SELECT c, call, unnest(every) FROM row_s) WHERE call IS NOT NULL AND a <> call
 UNION SELECT c, ':step:' || hit FROM row_g WHERE call IS NOT NULL AND by_step UNION SELECT c, ':step:' || i FROM row_s WHERE call IS NOT NULL UNION SELECT c, ':gen:' || i FROM row_g WHERE call IS NOT NULL OR by_step)
SELECT {CALL_ID} AS id FROM gone ANTI JOIN calls USING (c, id)""",
        "reader_billing": f"WITH {BILLING}",
        "parent_records": f"""WITH RECURSIVE {FILES}, o AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE WHEN o_orderkey % 5 = 0 THEN 'codex:response:' ELSE 'codex:total:' END || o_orderkey AS id, o_orderkey % 400 AS ms, o_orderkey % 3 AS n, o_orderkey AS e FROM orders),
w AS (SELECT o.*, f.parent_id IS NOT NULL AS forked FROM o LEFT JOIN f USING (session_id) WHERE (f.parent_id IS NULL OR forked_ms % 30 <> 0 OR ms >= 50) AND (f.parent_id IS NULL OR e % 30 <> 0)), k AS (SELECT DISTINCT session_id, ms, n FROM w),
d AS (SELECT up.session_id, k.ms, k.n, list_sort(list(DISTINCT distance)) AS d FROM up JOIN k ON k.session_id = up.ancestor GROUP BY 1, 2, 3), c AS (SELECT session_id, ms, n, len(list_filter(d, lambda x, i: x = i)) AS run FROM d)
SELECT session_id, id, ms FROM w LEFT JOIN c USING (session_id, ms, n) WHERE NOT (forked AND starts_with(id, 'codex:total:') AND coalesce(run, 0) % 2 = 1)""",
    }
