"""DuckDB SQL that gives the catalog's results independently."""

from __future__ import annotations

_EDGES = """edges AS (
  SELECT l_orderkey * 8 + 5 AS parent, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, (l_orderkey * 8 + l_linenumber) * 8 + 4 AS child FROM lineitem
  UNION ALL SELECT (l_orderkey * 8 + l_linenumber) * 8 + 4, 0, l_partkey * 8 + 3 FROM lineitem
  UNION ALL SELECT (l_orderkey * 8 + l_linenumber) * 8 + 4, 1, l_suppkey * 8 + 2 FROM lineitem
  UNION ALL SELECT s_suppkey * 8 + 2, 0, s_nationkey::BIGINT * 8 + 1 FROM supplier
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 1, 0, n_regionkey::BIGINT * 8 FROM nation)"""
_HYP = "hyp AS (SELECT l_orderkey AS state, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS slot, (l_orderkey * 8 + l_linenumber) * 8 + 4 AS root FROM lineitem)"
_STATES = "states AS (SELECT o_custkey AS thm, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step, o_orderkey AS state, o_orderkey * 8 + 5 AS goal, o_orderpriority AS tactic FROM orders)"
_KIND = "CASE {} % 8 WHEN 0 THEN 'region' WHEN 1 THEN 'nation' WHEN 2 THEN 'supplier' WHEN 3 THEN 'part' WHEN 4 THEN 'line' ELSE 'order' END"


def _paths(name: str, roots: str) -> str:
    return f"""{name}_paths AS (SELECT root, root AS node, 1 AS depth FROM ({roots})
  UNION ALL SELECT root, child, depth + 1 FROM {name}_paths JOIN edges ON node = parent),
{name} AS (SELECT root, node, count(*)::BIGINT AS paths, max(depth) AS depth FROM {name}_paths GROUP BY ALL),
{name}_size AS (SELECT root, sum(paths)::BIGINT AS expanded, count(*)::BIGINT AS distinct_, max(depth)::BIGINT AS depth FROM {name} GROUP BY root),
{name}_in AS (SELECT root, child AS node, count(*)::BIGINT AS indegree FROM {name} JOIN edges ON node = parent GROUP BY ALL)"""


_GOAL = _paths("reach", "SELECT DISTINCT l_orderkey * 8 + 5 AS root FROM lineitem")
_HREACH = _paths("hreach", "SELECT DISTINCT (l_orderkey * 8 + l_linenumber) * 8 + 4 AS root FROM lineitem")


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_LABEL = "CASE WHEN {0} IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN {0} = '3-MEDIUM' THEN 'slow' END"
_TRANS = f"trans AS (SELECT o_custkey AS thm, o_orderkey, {_LABEL.format('o_orderpriority')} AS label FROM orders)"
_ROLES = "roles AS (SELECT c_custkey AS thm, CASE c_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS role FROM customer)"
_INC = "inc AS (SELECT DISTINCT o_custkey AS thm, l_orderkey AS root, p_brand AS shape FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
_CHAN = "chan AS (SELECT doc_id AS r, w AS channel, count(*)::BIGINT AS x FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)"
_LAB = "lab AS (SELECT doc_id AS r, quality AS label FROM labels), tot AS (SELECT label, count(*)::DOUBLE AS total FROM lab GROUP BY label), nn AS (SELECT sum(total) AS n FROM tot)"
_MOM = "mom AS (SELECT channel, label, sum(x)::BIGINT AS s, sum(x * x)::BIGINT AS ss, count(*)::BIGINT AS support FROM chan JOIN lab USING (r) GROUP BY ALL)"
_R2 = """whole AS (SELECT channel, sum(s)::DOUBLE AS S1, sum(ss)::DOUBLE AS S2, sum(support)::BIGINT AS rows_ FROM mom GROUP BY channel),
grid AS (SELECT w.channel, t.label, rows_, S1, S2, total, n, coalesce(s, 0)::DOUBLE AS s FROM whole w CROSS JOIN tot t CROSS JOIN nn LEFT JOIN mom m ON m.channel = w.channel AND m.label = t.label),
r2 AS (SELECT channel, label, rows_ AS support, round(CASE WHEN greatest(S2 - S1 * S1 / n, 0) * n * (total / n) * (1 - total / n) > 0 AND rows_ >= 3
  THEN least(greatest((s - total / n * S1) ^ 2 / (greatest(S2 - S1 * S1 / n, 0) * n * (total / n) * (1 - total / n)), 0), 1) ELSE 0 END, 6) AS r2 FROM grid)"""
_CHI = """seen AS (SELECT channel, label, count(*)::BIGINT AS o FROM chan JOIN lab USING (r) GROUP BY ALL),
pres AS (SELECT channel, sum(o)::BIGINT AS present FROM seen GROUP BY channel),
chi0 AS (SELECT p.channel, t.label, present, coalesce(o, 0) AS o, present * (total / n) AS e, total / n AS pl FROM pres p CROSS JOIN tot t CROSS JOIN nn LEFT JOIN seen s ON s.channel = p.channel AND s.label = t.label),
chi AS (SELECT channel, label, present, o, (o - e) ^ 2 / e AS part, round((o - e) ^ 2 / e + coalesce((o - e) ^ 2 / nullif(present * (1 - pl), 0), 0), 4) AS one_vs_rest FROM chi0)"""
_USES = "uses AS (SELECT l_partkey, count(*)::BIGINT AS uses FROM lineitem GROUP BY l_partkey)"
_SHARED = """pats AS (SELECT node, count(DISTINCT o_custkey)::BIGINT AS theorems, count(*)::BIGINT AS uses FROM
  (SELECT o_custkey, unnest([l_partkey * 8 + 3, l_suppkey * 8 + 2]) AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY node)"""
_CLS = "cls AS (SELECT o_orderkey AS r, left(o_orderpriority, 1)::BIGINT - 1 AS label FROM orders)"
_PROB = f"""{_CLS}, raw AS (SELECT r, label, c.range AS cls, 1 + (r * 7 + c.range * 13) % 11 AS w FROM cls CROSS JOIN range(5) c),
prob AS (SELECT r, label, cls, w / sum(w) OVER (PARTITION BY r) AS p FROM raw)"""
_MATRIX = f"{_PROB}, best AS (SELECT r, label, cls AS pred FROM prob QUALIFY row_number() OVER (PARTITION BY r ORDER BY p DESC, cls) = 1), mat AS (SELECT label, pred, count(*)::BIGINT AS n FROM best GROUP BY ALL)"
_PRF = f"""{_MATRIX}, prf0 AS (SELECT d.range AS cls, coalesce((SELECT sum(n) FROM mat WHERE label = d.range), 0)::BIGINT AS support,
  coalesce((SELECT sum(n) FROM mat WHERE pred = d.range), 0)::BIGINT AS guessed, coalesce((SELECT sum(n) FROM mat WHERE label = d.range AND pred = d.range), 0)::BIGINT AS tp FROM range(7) d),
prf1 AS (SELECT cls, support, coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM prf0),
prf AS (SELECT cls, support, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM prf1)"""
_FREQ = _with(_EDGES, _HYP, _HREACH, "f AS (SELECT node, sum(n)::BIGINT AS dag, sum(n * paths)::BIGINT AS tree FROM hreach JOIN (SELECT root, count(*) AS n FROM hyp GROUP BY root) USING (root) GROUP BY node)",
    "inn AS (SELECT node AS root, node FROM f UNION ALL SELECT root, child FROM inn JOIN edges ON node = parent)", "sz AS (SELECT root, count(*)::BIGINT AS e, count(DISTINCT node)::BIGINT AS d FROM inn GROUP BY root)")
_TEXT = f"concat_ws('|', {_KIND.format('x.parent')}, least(x.pos, 3), {_KIND.format('y.parent')}, least(y.pos, 3), {_KIND.format('y.child')})"
_HEX = "(strpos('0123456789abcdef', substr({0}, {1}, 1)) - 1)"
_MOTIF = f"""walk AS (SELECT x.parent AS node, sha256({_TEXT}) AS h FROM edges x JOIN edges y ON y.parent = x.child),
motif AS (SELECT root, (({_HEX.format('h', 1)} * 16 + {_HEX.format('h', 2)}) % 64)::BIGINT AS bin, count(*)::BIGINT AS n FROM reach JOIN walk USING (node) GROUP BY ALL)"""
_LORENZ = """v AS (SELECT l_orderkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rn FROM lineitem),
c AS (SELECT k, rn, sum(q) OVER (PARTITION BY k ORDER BY rn) AS cum, q, count(*) OVER (PARTITION BY k) AS n, sum(q) OVER (PARTITION BY k) AS total FROM v),
x AS (SELECT DISTINCT k, n, total, i.range AS i, (i.range + 0.5) / 50 * n AS x FROM c CROSS JOIN range(50) i WHERE total > 0),
y AS (SELECT x.k, x.i, (c.cum - c.q + (x.x - (c.rn - 1)) * c.q) / x.total AS share FROM x JOIN c ON c.k = x.k AND c.rn = least(floor(x.x), x.n - 1) + 1)"""
_CELL = "least(greatest(floor(round({}, 9)), 0), 49)::BIGINT"
_BAND = "CASE WHEN {0} < 8 THEN 0 WHEN {0} < 32 THEN 1 WHEN {0} < 128 THEN 2 ELSE 3 END::BIGINT"
_SUPF = "sf AS (SELECT o_custkey AS thm, l_orderkey AS step, l_suppkey AS col, count(*) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), pr AS (SELECT DISTINCT thm, step, col % 64 AS entry FROM sf)"
_ENT = "ent AS (SELECT p_brand AS brand, max(p_size)::BIGINT AS positions, dense_rank() OVER (ORDER BY p_brand) - 1 AS entry FROM part GROUP BY p_brand), lay AS (SELECT *, coalesce(sum(positions * 13) OVER (ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM ent)"
_FEAT = f"""{_ENT}, anch AS (SELECT p_partkey * 8 + 3 AS node, offs + (p_size % 7) * 13 + p_partkey % 13 AS col, 1 AS n FROM part JOIN lay ON brand = p_brand),
both_ AS (SELECT root, node FROM reach UNION ALL SELECT root, node FROM hreach), rc AS (SELECT root, col, sum(n) AS n FROM both_ JOIN anch USING (node) GROUP BY ALL),
sr AS (SELECT thm, step, goal AS root, 0 AS role FROM states UNION ALL SELECT thm, step, root, 1 FROM states JOIN hyp USING (state)),
feat AS (SELECT thm, step, (col + role * (SELECT sum(positions * 13) FROM ent))::BIGINT AS col, sum(n)::BIGINT AS val FROM sr JOIN rc USING (root) GROUP BY ALL)"""
_RASTER = """b AS (SELECT min({x}) AS lx, max({x}) AS hx, min({y}) AS ly, max({y}) AS hy FROM lineitem),
pix AS (SELECT *, least(floor(({x} - lx + CASE WHEN hx > lx THEN 0.015::DOUBLE * (hx - lx) ELSE 0.1 END) / ((hx - lx) + 2 * CASE WHEN hx > lx THEN 0.015::DOUBLE * (hx - lx) ELSE 0.1 END) * {w}), {w} - 1)::BIGINT AS px,
  least(floor(({y} - ly + CASE WHEN hy > ly THEN 0.015::DOUBLE * (hy - ly) ELSE 0.1 END) / ((hy - ly) + 2 * CASE WHEN hy > ly THEN 0.015::DOUBLE * (hy - ly) ELSE 0.1 END) * {h}), {h} - 1)::BIGINT AS py FROM lineitem CROSS JOIN b)"""

SQL: dict[str, str] = {
    "dag_measure": _with(_EDGES, _GOAL) + """SELECT s.root, expanded, distinct_ AS "distinct", depth, coalesce(refs, 0)::BIGINT AS refs, coalesce(shared, 0)::BIGINT AS shared, round(coalesce(shared, 0) / greatest(distinct_, 1), 6) AS shared_frac
        FROM reach_size s LEFT JOIN (SELECT root, sum(indegree) AS refs, count(*) FILTER (indegree > 1) AS shared FROM reach_in GROUP BY root) i USING (root)""",
    "dag_depth_hist": _with(_EDGES, _GOAL) + f"SELECT depth, {_BAND.format('expanded')} AS band, count(*)::BIGINT AS roots, max(expanded) AS largest FROM reach_size GROUP BY ALL",
    "dag_kind_histogram": _with(_EDGES, _GOAL) + "SELECT root, " + ", ".join(f"count(*) FILTER (node % 8 = {i})::BIGINT AS n_{k}" for i, k in enumerate(["region", "nation", "supplier", "part", "line", "order"])) + " FROM reach GROUP BY root",
    "dag_shared_nodes": _with(_EDGES, _GOAL) + "SELECT root, node, indegree FROM reach_in WHERE indegree > 1",
    "root_closure": _with(_EDGES, _GOAL) + "SELECT root, node, paths, depth::BIGINT AS depth FROM reach",
    "ancestors_of_brand": _with(_EDGES, "up AS (SELECT p_partkey * 8 + 3 AS node FROM part WHERE p_brand = 'Brand#11' UNION SELECT parent FROM edges JOIN up ON child = node)") + f"SELECT {_KIND.format('node')} AS kind, count(*)::BIGINT AS nodes FROM up GROUP BY ALL",
    "occurrence_frequencies": _with(_EDGES, _HYP, _HREACH) + "SELECT node, sum(CASE WHEN node = root THEN n ELSE 0 END)::BIGINT AS top, sum(n)::BIGINT AS root_dag, sum(n * paths)::BIGINT AS expanded_tree FROM hreach JOIN (SELECT root, count(*) AS n FROM hyp GROUP BY root) USING (root) GROUP BY node",
    "anchor_counts": _with(_EDGES, _GOAL, _HREACH) + "SELECT node, coalesce(goals, 0)::BIGINT AS goals, coalesce(hyps, 0)::BIGINT AS hyps FROM (SELECT node, count(*) AS goals FROM reach GROUP BY node) FULL JOIN (SELECT node, count(*) AS hyps FROM hreach GROUP BY node) USING (node)",
    "post_order_violations": "SELECT count(*)::BIGINT AS bad, sum(id)::BIGINT AS ids FROM (SELECT max(l_linenumber) AS id FROM lineitem GROUP BY l_orderkey)",
    "rule_match": "SELECT p_partkey, p_brand AS head, p_size AS arity, slots FROM part JOIN (VALUES ('Brand#11', 10), ('Brand#12', 20), ('Brand#23', 1), ('Brand#55', 40)) r(head, slots) ON p_brand = head AND p_size >= slots",
    "global_reuse_keys": f"WITH {_SHARED} SELECT node, theorems, uses FROM pats WHERE theorems > 1",
    "reduced_sizes": _with(_EDGES, _SHARED, "own AS (SELECT node AS root, node FROM pats WHERE theorems > 1 UNION ALL SELECT root, child FROM own JOIN edges ON node = parent)",
        "cut AS (SELECT root AS node FROM own GROUP BY root HAVING count(*) > 1)",
        "low AS (SELECT DISTINCT l_orderkey * 8 + 5 AS root, l_orderkey * 8 + 5 AS node FROM lineitem UNION ALL SELECT root, child FROM low JOIN edges ON node = parent WHERE node NOT IN (SELECT node FROM cut))",
        "lowc AS (SELECT root, node, count(*) AS paths FROM low GROUP BY ALL)")
        + "SELECT root, sum(paths)::BIGINT AS reduced_tree, count(*)::BIGINT AS reduced_dag, count(*) FILTER (node NOT IN (SELECT node FROM pats WHERE theorems > 1))::BIGINT AS novel FROM lowc GROUP BY root",
    "state_measure": _with(_EDGES, _HYP, _GOAL, _HREACH,
        "per AS (SELECT state, sum(expanded) AS ce, max(depth) AS cd, sum(distinct_) AS ind, max(expanded) AS lg, count(*) AS hyps FROM hyp JOIN hreach_size USING (root) GROUP BY state)",
        "un AS (SELECT state, count(DISTINCT node) AS cdist FROM hyp JOIN hreach USING (root) GROUP BY state)")
        + "SELECT state, hyps::BIGINT AS hyps, expanded AS goal_expanded, distinct_ AS goal_distinct, ce::BIGINT AS ctx_expanded, cdist::BIGINT AS ctx_distinct, cd::BIGINT AS ctx_depth, (distinct_ + ind)::BIGINT AS individual_distinct, round(lg / ce, 6) AS largest_frac FROM per JOIN un USING (state) JOIN reach_size ON root = state * 8 + 5",
    "hyp_slots": f"WITH {_HYP} SELECT slot, count(*)::BIGINT AS states, count(*) FILTER (slot >= 5)::BIGINT AS overflow FROM hyp GROUP BY slot",
    "transition_steps": f"WITH {_STATES} SELECT thm, step, state, tactic FROM states",
    "distinct_observations": "SELECT roots, count(*)::BIGINT AS weight FROM (SELECT string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS roots FROM lineitem GROUP BY l_orderkey) GROUP BY roots",
    "label_map_drop": f"WITH {_TRANS} SELECT o_orderkey, label FROM trans WHERE label IS NOT NULL",
    "label_map_other": f"WITH {_TRANS} SELECT o_orderkey, coalesce(label, 'other') AS label FROM trans",
    "label_ids": f"WITH {_TRANS} SELECT coalesce(label, 'other') AS label, count(*)::BIGINT AS n, dense_rank() OVER (ORDER BY coalesce(label, 'other')) - 1 AS id FROM trans GROUP BY 1",
    "label_support": f"WITH {_TRANS}, c AS (SELECT thm, label, count(*) AS n FROM trans WHERE label IS NOT NULL GROUP BY ALL) SELECT label, sum(n)::BIGINT AS transitions, count(*)::BIGINT AS theorems, max(n)::BIGINT AS most FROM c GROUP BY label",
    "theorem_label_counts": f"WITH {_TRANS} SELECT thm, label, count(*)::BIGINT AS n FROM trans WHERE label IS NOT NULL GROUP BY ALL",
    "subset_stats": f"WITH {_TRANS}, {_ROLES} SELECT role, label, count(*)::BIGINT AS transitions, count(DISTINCT thm)::BIGINT AS theorems FROM trans JOIN roles USING (thm) WHERE label IS NOT NULL GROUP BY ALL",
    "split_overlap": "SELECT 0::BIGINT AS overlap, count(*) FILTER (c_custkey % 10 > 1)::BIGINT AS train_only FROM customer",
    "missing_theorems": "SELECT c_custkey AS thm FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "population_check": "SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))::BIGINT AS missing, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT AS extra",
    "duplicate_names": "SELECT p_name, count(*)::BIGINT AS n FROM part GROUP BY p_name HAVING count(*) > 1",
    "coverage_matrix": f"WITH {_INC} SELECT shape, count(*)::BIGINT AS covered, min(root) AS first_root, max(root) AS last_root FROM inc GROUP BY shape",
    "shape_support": f"WITH {_INC} SELECT shape, count(DISTINCT thm)::BIGINT AS theorems, count(*)::BIGINT AS roots FROM inc GROUP BY shape",
    "eligible_shapes": f"WITH {_INC}, s AS (SELECT shape, count(DISTINCT thm)::BIGINT AS theorems FROM inc GROUP BY shape), c AS (SELECT p_brand AS shape, max(p_size)::BIGINT AS nodes FROM part GROUP BY 1) SELECT shape, theorems, nodes, nodes * 26 AS dims FROM s JOIN c USING (shape) WHERE nodes >= 50 AND theorems >= 100",
    "uncovered_roots": f"WITH {_INC} SELECT o_orderkey AS root FROM orders WHERE o_orderkey NOT IN (SELECT root FROM inc WHERE shape IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', 'Brand#21', 'Brand#22'))",
    "coverage_counts": f"WITH {_INC} SELECT shapes, count(*)::BIGINT AS roots FROM (SELECT count(*)::BIGINT AS shapes FROM inc GROUP BY root) GROUP BY shapes",
    "channel_moments": f"WITH {_CHAN}, {_LAB}, {_MOM} SELECT channel, label, s, ss, support FROM mom",
    "squared_correlation": f"WITH {_CHAN}, {_LAB}, {_MOM}, {_R2} SELECT * FROM r2",
    "best_channel": f"WITH {_CHAN}, {_LAB}, {_MOM}, {_R2} SELECT length(channel)::BIGINT AS grp, label, channel, r2 FROM r2 QUALIFY row_number() OVER (PARTITION BY length(channel), label ORDER BY r2 DESC, channel) = 1",
    "name_chi2": f"WITH {_CHAN}, {_LAB}, {_CHI} SELECT channel, label, o, one_vs_rest FROM chi",
    "name_chi2_global": f"WITH {_CHAN}, {_LAB}, {_CHI} SELECT channel, round(sum(part), 4) AS chi2, max(present) AS present FROM chi GROUP BY channel",
    "name_rank": f"WITH {_CHAN}, {_LAB}, {_CHI}, top AS (SELECT label, max(one_vs_rest) AS best FROM chi GROUP BY label), rel AS (SELECT channel, max(coalesce(one_vs_rest / nullif(best, 0), 0)) AS relative, sum(o)::BIGINT AS count FROM chi JOIN top USING (label) GROUP BY channel) SELECT channel, round(relative, 6) AS relative, count FROM rel",
    "shortlist": f"WITH {_CHAN}, {_LAB}, {_CHI}, a AS (SELECT channel FROM chi GROUP BY channel HAVING max(one_vs_rest) > 0 ORDER BY max(one_vs_rest) DESC, channel LIMIT 256), b AS (SELECT channel FROM chi WHERE one_vs_rest > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY one_vs_rest DESC, channel) <= 32) SELECT channel FROM a UNION SELECT channel FROM b",
    "pair_redundancy": f"WITH {_CHAN}, {_LAB}, {_CHI}, sa AS (SELECT channel FROM chi GROUP BY channel HAVING max(one_vs_rest) > 0 ORDER BY max(one_vs_rest) DESC, channel LIMIT 256), sb AS (SELECT channel FROM chi WHERE one_vs_rest > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY one_vs_rest DESC, channel) <= 32), f AS (SELECT channel FROM sa UNION SELECT channel FROM sb), k AS (SELECT * FROM chan SEMI JOIN f USING (channel)) SELECT label, x.channel AS a, y.channel AS b, sum(x.x * y.x)::BIGINT AS dot FROM k x JOIN k y ON x.r = y.r AND x.channel <= y.channel JOIN lab ON lab.r = x.r GROUP BY ALL",
    "literal_identities": "SELECT 'NatLiteral' AS kind, count(*)::BIGINT AS n, count(DISTINCT p_size)::BIGINT AS identities FROM part UNION ALL SELECT 'Fvar', count(*)::BIGINT, 1::BIGINT FROM part UNION ALL SELECT 'App', count(*)::BIGINT, count(DISTINCT p_size)::BIGINT FROM part",
    "vocabulary_layout": f"WITH {_ENT} SELECT entry, positions, offs AS \"offset\" FROM lay",
    "positional_counts": _with(_EDGES, _HYP, _STATES, _GOAL, _HREACH, _FEAT) + "SELECT thm, step, col, val FROM feat",
    "feature_support": _with(_EDGES, _HYP, _STATES, _GOAL, _HREACH, _FEAT) + "SELECT col >= (SELECT sum(positions * 13) FROM ent) AS hypotheses, count(DISTINCT col)::BIGINT AS columns, count(*)::BIGINT AS rows, sum(val)::BIGINT AS total FROM feat GROUP BY 1",
    "active_histogram": _with(_EDGES, _HYP, _STATES, _GOAL, _HREACH, _FEAT) + "SELECT active, count(*)::BIGINT AS rows FROM (SELECT count(*)::BIGINT AS active FROM feat GROUP BY thm, step) GROUP BY active",
    "presence": f"WITH {_SUPF} SELECT entry, count(*)::BIGINT AS rows, count(DISTINCT thm)::BIGINT AS theorems FROM pr GROUP BY entry",
    "cooccurrence": f"WITH {_SUPF}, p AS (SELECT x.entry AS a, y.entry AS b, count(*)::BIGINT AS pairs FROM pr x JOIN pr y ON x.thm = y.thm AND x.step = y.step AND x.entry <= y.entry WHERE x.entry < 128 AND y.entry < 128 GROUP BY ALL), d AS (SELECT a AS k, pairs AS d FROM p WHERE a = b) SELECT a, b, pairs, round(pairs / (x.d + y.d - pairs), 6) AS jaccard FROM p JOIN d x ON x.k = a JOIN d y ON y.k = b",
    "state_stats": _with(_EDGES, _HYP, _GOAL, _HREACH,
        "gs AS (SELECT root, max(distinct_) AS d, coalesce(sum(indegree), 0) AS refs FROM reach_size LEFT JOIN reach_in USING (root) GROUP BY root)",
        "hs AS (SELECT root, max(distinct_) AS d, coalesce(sum(indegree), 0) AS refs, count(*) FILTER (indegree > 1) / greatest(max(distinct_), 1) AS sf FROM hreach_size LEFT JOIN hreach_in USING (root) GROUP BY root)")
        + "SELECT state, count(*)::BIGINT AS hyps, max(gs.d) AS goal_distinct, max(gs.refs)::BIGINT AS goal_refs, sum(hs.d)::BIGINT AS ctx_distinct, sum(hs.refs)::BIGINT AS ctx_refs, round(avg(sf), 6) AS ctx_shared_frac, max(hs.d) AS max_distinct, sum(CASE WHEN slot >= 4 THEN hs.d ELSE 0 END)::BIGINT AS over_distinct, sum(CASE WHEN slot >= 4 THEN hs.refs ELSE 0 END)::BIGINT AS over_refs FROM hyp JOIN hs USING (root) JOIN gs ON gs.root = state * 8 + 5 GROUP BY state",
    "hypothesis_slot_columns": _with(_EDGES, _HYP, _HREACH) + "SELECT state, slot * 2 + k.range AS col, CASE k.range WHEN 0 THEN expanded ELSE distinct_ END::DOUBLE AS val FROM hyp JOIN hreach_size USING (root) CROSS JOIN range(2) k WHERE slot < 4",
    "maxabs_scale": "WITH v AS (SELECT vec_id AS row, unnest(embedding)::DOUBLE AS val, generate_subscripts(embedding, 1) AS col FROM embeddings), s AS (SELECT col, max(abs(val)) AS s FROM v GROUP BY col) SELECT row, round(sum(round(val / CASE WHEN s > 0 THEN s ELSE 1 END, 9)), 5) AS total, round(max(val / CASE WHEN s > 0 THEN s ELSE 1 END), 5) AS highest FROM v JOIN s USING (col) GROUP BY row",
    "log_standard_scale": "WITH c AS (SELECT l_orderkey AS row, l_suppkey % 20 AS col, ln(1 + count(*)) AS v FROM lineitem GROUP BY ALL), s AS (SELECT col, sqrt(greatest(sum(v * v) / (SELECT count(*) FROM orders) - (sum(v) / (SELECT count(*) FROM orders)) ^ 2, 0)) AS s FROM c GROUP BY col) SELECT row, col, round(v / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS scaled FROM c JOIN s USING (col)",
    "coverage_curve": f"WITH {_USES}, g AS (SELECT uses, count(*)::BIGINT AS n FROM uses GROUP BY uses) SELECT uses, n, (sum(n) OVER w)::BIGINT AS rank, round(sum(n * uses) OVER w / sum(n * uses) OVER (), 6) AS share FROM g WINDOW w AS (ORDER BY uses DESC ROWS UNBOUNDED PRECEDING)",
    "entropy_cohorts": "WITH c AS (SELECT l_returnflag, l_suppkey, count(*) AS w FROM lineitem GROUP BY ALL), p AS (SELECT *, w / sum(w) OVER (PARTITION BY l_returnflag) AS p FROM c) SELECT l_returnflag, count(*)::BIGINT AS patterns, count(*) FILTER (w = 1)::BIGINT AS singletons, round(sum(-p * log2(p)), 6) AS entropy, round(2 ^ sum(-p * log2(p)), 3) AS effective FROM p GROUP BY l_returnflag",
    "pattern_counts": "SELECT sha256(p_brand || '|' || p_type) AS digest, p_brand AS head, count(*)::BIGINT AS w0, count(DISTINCT l_orderkey)::BIGINT AS w1, sum(l_linenumber)::BIGINT AS w2, count(*) FILTER (l_linenumber = 1)::BIGINT AS w3 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "head_distribution": "WITH p AS (SELECT p_brand, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_brand, sum(n)::BIGINT AS total, count(*)::BIGINT AS types, round(max(n) / sum(n), 6) AS dominance FROM p GROUP BY p_brand",
    "freq_totals": _with(_EDGES, _HYP, _HREACH, "f AS (SELECT node, sum(n)::BIGINT AS dag, sum(n * paths)::BIGINT AS tree FROM hreach JOIN (SELECT root, count(*) AS n FROM hyp GROUP BY root) USING (root) GROUP BY node)",
        "inn AS (SELECT node AS root, node FROM f UNION ALL SELECT root, child FROM inn JOIN edges ON node = parent)", "sz AS (SELECT root, count(*)::BIGINT AS e, count(DISTINCT node)::BIGINT AS d FROM inn GROUP BY root)")
        + "SELECT d AS \"distinct\", e AS expanded, count(*)::BIGINT AS nodes, sum(dag)::BIGINT AS dag, max(dag) AS dag_most, sum(tree)::BIGINT AS tree, max(tree) AS tree_most FROM f JOIN sz ON f.node = sz.root GROUP BY ALL",
    "frequency_histogram": f"WITH {_USES} SELECT uses, count(*)::BIGINT AS parts FROM uses GROUP BY uses",
    "nearest_rank_percentiles": "SELECT l_returnflag, count(*)::BIGINT AS n, " + ", ".join(f"quantile_disc(l_quantity, {q}) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"), (1.0, "p100"))) + " FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag",
    "weighted_quantiles": "WITH g AS (SELECT l_linestatus, l_linenumber AS v, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_linestatus ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY l_linestatus) AS total FROM g) SELECT l_linestatus, " + ", ".join(f"min(v) FILTER (cum >= {q}::DOUBLE * total) AS q{round(q * 100)}" for q in (0.5, 0.95, 0.99, 1.0)) + " FROM r GROUP BY l_linestatus",
    "lorenz_raster": """WITH v AS (SELECT l_orderkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rn FROM lineitem),
        c AS (SELECT k, rn, sum(q) OVER (PARTITION BY k ORDER BY rn) AS cum, q, count(*) OVER (PARTITION BY k) AS n, sum(q) OVER (PARTITION BY k) AS total FROM v),
        x AS (SELECT DISTINCT k, n, total, i.range AS i, (i.range + 0.5) / 50 * n AS x FROM c CROSS JOIN range(50) i WHERE total > 0),
        y AS (SELECT x.k, x.i, (c.cum - c.q + (x.x - (c.rn - 1)) * c.q) / x.total AS share FROM x JOIN c ON c.k = x.k AND c.rn = least(floor(x.x), x.n - 1) + 1)
        SELECT i, least(greatest(floor(round(50 * share, 9)), 0), 49)::BIGINT AS j, count(*)::BIGINT AS n FROM y GROUP BY ALL""",
    "density_raster": "WITH " + _RASTER.format(x="l_quantity", y="l_discount", w=20, h=10) + " SELECT px, py, count(*)::BIGINT AS n, round(sum(l_tax), 4) AS total, max(l_tax) AS highest, round(CASE WHEN count(*) >= 3 THEN median(l_tax) END, 6) AS median FROM pix GROUP BY ALL",
    "paired_rasters": "WITH " + _RASTER.format(x="l_quantity", y="l_linenumber", w=20, h=7) + " SELECT l_returnflag, px, py, count(*)::BIGINT AS n FROM pix GROUP BY ALL",
    "composition_by_band": """WITH s AS (SELECT l_orderkey, count(*) AS size, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
        m AS (SELECT *, (count(*) OVER (ORDER BY size RANGE UNBOUNDED PRECEDING) * 2 - count(*) OVER (PARTITION BY size) + 1) / (2 * count(*) OVER ()) AS mid FROM s)
        SELECT CASE WHEN mid <= 0.5 THEN 0 WHEN mid <= 0.9 THEN 1 WHEN mid <= 0.95 THEN 2 WHEN mid <= 0.99 THEN 3 WHEN mid <= 0.999 THEN 4 ELSE 5 END::BIGINT AS band, count(*)::BIGINT AS states, round(sum(a) / sum(size), 6) AS share_A, round(sum(n) / sum(size), 6) AS share_N, round(sum(r) / sum(size), 6) AS share_R FROM m GROUP BY 1""",
    "reuse_breadth": f"WITH {_USES} SELECT round(log10(uses), 2) AS bin, count(*)::BIGINT AS parts, round(avg(log10(p_size)), 6) AS log_size FROM uses JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "topology_bands": _with(_EDGES, _GOAL, f"m AS (SELECT {_BAND.format('distinct_')} AS band, expanded, distinct_, count(*)::BIGINT AS weight FROM reach_size GROUP BY ALL), g AS (SELECT band, weight, count(*)::BIGINT AS n FROM m GROUP BY ALL)")
        + "SELECT band, weight, n, (sum(n) OVER w)::BIGINT AS rank, round(sum(n * weight) OVER w / sum(n * weight) OVER (PARTITION BY band), 6) AS share FROM g WINDOW w AS (PARTITION BY band ORDER BY weight DESC ROWS UNBOUNDED PRECEDING)",
    "comparison_columns": _with(_EDGES, _GOAL, "cut AS (SELECT root, count(*) AS after FROM reach_paths WHERE depth <= 3 GROUP BY root)") + "SELECT root, round(log10(expanded), 6) AS log_before, round(log10(after), 6) AS log_after, round(100 * (1 - after / expanded), 6) AS removed FROM reach_size JOIN cut USING (root)",
    "exact_totals": "SELECT p_brand, CASE WHEN sum(p_partkey) = 0 THEN '0' ELSE sum(p_partkey)::BIGINT::VARCHAR || repeat('0', 24) END AS exact FROM part GROUP BY p_brand",
    "overflow_safe_sum": "SELECT o_orderstatus, CASE WHEN abs(sum(o_orderkey::HUGEINT * 1099511627776)) <= 9223372036854775807 THEN sum(o_orderkey::HUGEINT * 1099511627776) END::BIGINT AS fast, sum(o_orderkey::HUGEINT * 1048576)::VARCHAR AS exact FROM orders GROUP BY o_orderstatus",
    "frequency_frame": _FREQ + "SELECT round(log10(d), 6) AS distinct_log, round(log10(e), 6) AS expanded_log, round(log10(sum(tree)), 6) AS total, round(CASE WHEN sum(tree) >= 10 THEN max(tree) / sum(tree) END, 6) AS dominance, round(log10(sum(tree)) - log10(sum(dag)), 6) AS repetition FROM f JOIN sz ON f.node = sz.root GROUP BY d, e",
    "root_reuse": _with(_EDGES, _GOAL) + "SELECT root, round(log10(expanded) - log10(distinct_), 6) AS sharing FROM reach_size",
    "context_ratios": _with(_EDGES, _HYP, _GOAL, _HREACH,
        "per AS (SELECT state, sum(expanded) AS ce, max(expanded) AS lg, sum(distinct_) AS ind, count(*) AS hyps FROM hyp JOIN hreach_size USING (root) GROUP BY state)",
        "un AS (SELECT state, count(DISTINCT node) AS sd FROM (SELECT state, node FROM hyp JOIN hreach USING (root) UNION ALL SELECT (root - 5) // 8, node FROM reach) GROUP BY state)")
        + "SELECT state, round(log10(hyps), 6) AS hyps_log, round(log10(lg * hyps / ce), 6) AS largest_to_mean_log, round(log10(ce) - log10(hyps), 6) AS mean_hyp_size, round(log10((ind + distinct_) / sd), 6) AS cross_root_sharing FROM per JOIN un USING (state) JOIN reach_size ON root = state * 8 + 5",
    "novelty": _with(_EDGES, _GOAL, _SHARED, "z AS (SELECT root, count(*) AS nodes, count(*) FILTER (node NOT IN (SELECT node FROM pats WHERE theorems > 1)) AS novel FROM reach GROUP BY root)") + "SELECT root, round(log10(nodes), 6) AS nodes_log, round(log10(novel + 1), 6) AS novel_log, round(novel / nodes, 6) AS novel_frac FROM z",
    "edge_motifs": _with(_EDGES, _GOAL, _MOTIF) + "SELECT root, bin, n FROM motif",
    "app_spines": _with(_EDGES, "one AS (SELECT parent, min(child) AS child FROM edges WHERE pos = 0 GROUP BY parent)", "sp AS (SELECT parent AS node, child AS head, 1::BIGINT AS spine FROM one UNION ALL SELECT node, child, spine + 1 FROM sp JOIN one ON head = parent)", "fin AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY node ORDER BY spine DESC) = 1)")
        + f"SELECT {_KIND.format('node')} AS kind, {_KIND.format('head')} AS head_kind, spine, count(*)::BIGINT AS nodes, count(DISTINCT head)::BIGINT AS heads FROM fin GROUP BY ALL",
    "descriptor_inputs": _with(_EDGES, _GOAL, _MOTIF, "hist AS (SELECT root, 'kinds' AS block, node % 8 AS bin, count(*) AS n FROM reach GROUP BY ALL UNION ALL SELECT root, 'motifs', bin, n FROM motif)") + "SELECT root, block, bin, round(sqrt(n / sum(n) OVER (PARTITION BY root, block) / 2), 6) AS val FROM hist",
    "coverage_at_ranks": f"WITH {_USES}, o AS (SELECT uses, row_number() OVER (ORDER BY uses DESC, l_partkey) AS rank FROM uses), c AS (SELECT rank, sum(uses) OVER (ORDER BY rank) / sum(uses) OVER () AS share, count(*) OVER () AS r FROM o), k AS (SELECT DISTINCT round_even(pow(m.r::DOUBLE, g.range / greatest(least(1000, m.r) - 1, 1)), 0)::BIGINT AS rank FROM (SELECT max(r) AS r FROM c) m CROSS JOIN range(1000) g WHERE g.range < greatest(least(1000, m.r), 2)) SELECT rank, round(share, 6) AS share FROM c JOIN k USING (rank)",
    "lorenz_rotated": f"WITH {_LORENZ} SELECT {_CELL.format('25 * ((i + 0.5) / 50 + share)')} AS a, {_CELL.format('50 * (share - (i + 0.5) / 50)')} AS b, count(*)::BIGINT AS n FROM y GROUP BY ALL",
    "lorenz_quantiles": f"WITH {_LORENZ}, g AS (SELECT i, {_CELL.format('50 * share')} AS j, count(*) AS n FROM y GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY i ORDER BY j) AS cum, sum(n) OVER (PARTITION BY i) AS total FROM g) SELECT i, " + ", ".join(f"min(j) FILTER (cum >= {q}::DOUBLE * total) AS q{round(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM r GROUP BY i",
    "active_cdf": _with(_EDGES, _HYP, _STATES, _GOAL, _HREACH, _FEAT) + "SELECT active, round(sum(rows) OVER (ORDER BY active) / sum(rows) OVER (), 6) AS share FROM (SELECT active, count(*) AS rows FROM (SELECT count(*)::BIGINT AS active FROM feat GROUP BY thm, step) GROUP BY active)",
    "name_pool": f"WITH {_CHAN}, {_LAB}, {_CHI}, top AS (SELECT label, max(one_vs_rest) AS best FROM chi GROUP BY label), rel AS (SELECT channel, max(coalesce(one_vs_rest / nullif(best, 0), 0)) AS relative, sum(o) AS count FROM chi JOIN top USING (label) GROUP BY channel), a AS (SELECT channel FROM rel ORDER BY relative DESC, count DESC, channel LIMIT 48), b AS (SELECT channel FROM pres WHERE channel NOT IN (SELECT channel FROM a) ORDER BY present DESC, channel LIMIT 16) SELECT channel, 'association' AS chosen_by FROM a UNION ALL SELECT channel, 'support' FROM b",
    "expression_attributes": """WITH e AS (SELECT p_brand, p_partkey % 5 AS k, p_size AS s FROM part), a AS (
        SELECT p_brand, 'bvar' || CASE WHEN s % 5 < 3 THEN (s % 5)::VARCHAR ELSE '3+' END AS attr FROM e WHERE k = 0
        UNION ALL SELECT p_brand, CASE s // 20 WHEN 0 THEN 'nat0' WHEN 1 THEN 'nat1' ELSE 'nat_other' END FROM e WHERE k = 1
        UNION ALL SELECT p_brand, 'prop' FROM e WHERE k = 2 AND s % 2 = 0
        UNION ALL SELECT p_brand, unnest(['binder', CASE WHEN (s + g.range) % 2 = 0 THEN 'binder_default' ELSE 'binder_implicit' END]) FROM e JOIN range(3) g ON g.range <= s % 3 WHERE k = 3)
        SELECT p_brand, attr, count(*)::BIGINT AS n FROM a GROUP BY ALL""",
    "bottom_k_sample": "SELECT o_custkey, o_orderkey, sha256(o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR) AS priority FROM orders ORDER BY priority, o_custkey, o_orderkey LIMIT 200",
    "top_scores": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 64",
    "band_topk": _with(_EDGES, _GOAL) + f"SELECT {_BAND.format('expanded')} AS band, row_number() OVER (PARTITION BY {_BAND.format('expanded')} ORDER BY expanded DESC, root) AS place, root, expanded FROM reach_size QUALIFY place <= 4",
    "extreme_roots": _with(_EDGES, _GOAL, "m AS (SELECT o_orderstatus, root, expanded, distinct_ FROM reach_size JOIN orders ON root = o_orderkey * 8 + 5)") + """SELECT o_orderstatus, (SELECT root FROM m x WHERE x.o_orderstatus = m.o_orderstatus ORDER BY expanded DESC, root LIMIT 1) AS most_expanded, (SELECT root FROM m x WHERE x.o_orderstatus = m.o_orderstatus ORDER BY distinct_ DESC, root LIMIT 1) AS most_distinct, max(expanded) AS max_expanded, max(distinct_) AS max_distinct FROM m GROUP BY o_orderstatus""",
    "common_shapes": f"WITH {_USES}, t AS (SELECT * FROM uses ORDER BY uses DESC, l_partkey LIMIT 128), o AS (SELECT p_brand, l_partkey, uses FROM t JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY uses DESC, l_partkey) = 1) SELECT * FROM o ORDER BY uses DESC, l_partkey LIMIT 12",
    "relative_change": "WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS f1 FROM orders GROUP BY ALL) SELECT o_orderpriority, month, f1, round(100 * (f1 - lag(f1) OVER w) / lag(f1) OVER w, 6) AS change FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)",
    "shape_union": "SELECT p_brand FROM part WHERE p_size > 45 UNION SELECT p_brand FROM part WHERE p_type LIKE 'PROMO%'",
    "set_differences": "SELECT k, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "confusion": f"WITH {_MATRIX} SELECT label, pred, n FROM mat",
    "class_prf": f"WITH {_PRF} SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM prf",
    "macro_scores": f"WITH {_PRF} SELECT round(avg(f1), 6) AS macro_f1, round((SELECT sum(n) FILTER (label = pred) / sum(n) FROM mat), 6) AS accuracy FROM prf",
    "topk_accuracy": f"WITH {_PROB}, pl AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, cls) AS place FROM prob) SELECT count(*)::BIGINT AS n, round(avg((place <= 1)::DOUBLE), 6) AS top1, round(avg((place <= 3)::DOUBLE), 6) AS top3, round(avg((place <= 5)::DOUBLE), 6) AS top5 FROM pl WHERE cls = label",
    "cross_entropy": f"WITH {_PROB} SELECT round(avg(-ln(p)), 6) AS cross_entropy FROM prob WHERE cls = label",
    "class_weights": "WITH c AS (SELECT quality AS label, count(*)::BIGINT AS n FROM labels GROUP BY 1), b AS (SELECT *, (sum(n) OVER ()) / ((count(*) OVER ()) * n) AS balanced FROM c) SELECT label, n, round(balanced, 6) AS balanced, round(sqrt(balanced) / (sum(sqrt(balanced) * n) OVER () / sum(n) OVER ()), 6) AS inverse_sqrt FROM b",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
