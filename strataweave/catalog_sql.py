"""The catalogue's queries in DuckDB's SQL, on the same tables."""

from __future__ import annotations

MODULES = """
p AS (SELECT p_partkey, p_size, CAST(SUBSTR(p_brand, 7) AS INTEGER) AS n, LOWER(p_type) AS t FROM part),
pm AS (SELECT p_partkey, p_size, n, CASE WHEN n = 1 THEN 'tests/' || t || '.py' WHEN n = 2 THEN 'docs/' || t || '.py' WHEN n = 3 THEN 'Brand#3/src/' || t || '.pb.go'
    WHEN n = 4 THEN 'Brand#4/src/' || t || '.md' WHEN n % 2 = 0 THEN 'Brand#' || n || '/src/' || t || '.py' ELSE 'app/Brand#' || n || '/' || t || '.py' END AS id FROM p),
modules AS (SELECT id, n, CAST(COUNT(*) * 10 AS INTEGER) AS loc, CAST(SUM(p_size) AS INTEGER) AS complexity FROM pm GROUP BY id, n),
functions AS (SELECT id || '::' || p_partkey AS id, id AS file_path, p_size AS complexity FROM pm WHERE n % 7 = 0),
lang AS (SELECT id AS lid, CASE REGEXP_EXTRACT(id, '[^/]\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' END AS language FROM modules),
nodes AS (SELECT id, 'module' AS type, id AS file_path, loc, complexity FROM modules UNION ALL SELECT id, 'function', file_path, 10, complexity FROM functions)"""

LINES = MODULES + """,
lines AS (SELECT l.*, pm.n, pm.id FROM lineitem l JOIN pm ON l_partkey = p_partkey),
commits AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit_id, ROW_NUMBER() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS seq, o_orderdate AS ts FROM orders),
tt AS (SELECT CAST(l_orderkey AS VARCHAR) AS commit_id, id AS file, CAST(SUM(l_quantity) AS BIGINT) AS churn FROM lines GROUP BY ALL),
touches AS (SELECT commit_id, seq, ts, file, churn FROM tt JOIN commits USING (commit_id)),
fixes AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS commit_id, id AS file FROM lines WHERE l_returnflag = 'R'),
freq AS (SELECT file, COUNT(*) AS change_freq, CAST(SUM(churn) AS BIGINT) AS churn_lines FROM touches GROUP BY file)"""

PAIRS = LINES + """,
small AS (SELECT commit_id FROM touches GROUP BY commit_id HAVING COUNT(*) <= 8),
st AS (SELECT t.* FROM touches t JOIN small USING (commit_id)),
pairs AS (SELECT x.file AS a, y.file AS b, COUNT(*) AS cnt FROM st x JOIN st y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY ALL),
couplings AS MATERIALIZED (SELECT a, b, cnt, cnt / LEAST(fa.change_freq, fb.change_freq) AS w FROM pairs JOIN freq fa ON fa.file = a JOIN freq fb ON fb.file = b WHERE cnt >= 5),
marks AS MATERIALIZED (SELECT ROUND(QUANTILE_CONT(w, 0.25), 9) AS p25, ROUND(QUANTILE_CONT(w, 0.5), 9) AS p50, ROUND(QUANTILE_CONT(w, 0.75), 9) AS p75, ROUND(QUANTILE_CONT(w, 0.9), 9) AS p90, ROUND(QUANTILE_CONT(w, 0.99), 9) AS p99, ROUND(QUANTILE_CONT(w, 0.999), 9) AS p999 FROM couplings),
coupled AS MATERIALIZED (SELECT c.* FROM couplings c, marks WHERE w >= p50),
sumc AS (SELECT f AS file, SUM(w) AS sum_coupling FROM (SELECT a AS f, w FROM coupled UNION ALL SELECT b, w FROM coupled) GROUP BY f),
cm AS (SELECT file AS node_id, change_freq, churn_lines, churn_lines / change_freq AS churn_rate, change_freq / (SELECT MAX(change_freq) FROM freq) AS hotspot_score, COALESCE(sum_coupling, 0) AS sum_coupling FROM freq LEFT JOIN sumc USING (file))"""

GRAPH = PAIRS + """,
follows AS (SELECT n, id AS source, LEAD(id) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lines),
fc AS (SELECT n, source, target, COUNT(*) AS cnt FROM follows WHERE target IS NOT NULL AND source <> target GROUP BY ALL),
fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY cnt DESC, target) AS r FROM fc),
imports AS MATERIALIZED (SELECT source, target FROM fr WHERE r <= CASE WHEN n % 10 = 0 THEN 18 WHEN n % 3 = 0 THEN 0 ELSE 1 END),
contains_ AS (SELECT id AS source, id || '::' || p_partkey AS target FROM pm WHERE n % 7 = 0),
bugs AS (SELECT file, COUNT(*) AS bug_count FROM fixes GROUP BY file),
dm AS (SELECT file AS node_id, bug_count, bug_count / loc AS defect_density, bug_count / change_freq AS fix_inducing_rate FROM bugs JOIN modules ON id = file JOIN freq USING (file)),
faults AS MATERIALIZED (SELECT source, target, cnt, cnt / change_freq AS weight FROM (SELECT s.file AS source, f.file AS target, COUNT(*) AS cnt FROM st s JOIN fixes f ON s.commit_id = f.commit_id AND s.file <> f.file GROUP BY ALL) JOIN freq ON file = source),
edges AS MATERIALIZED (SELECT source, target, 'structural' AS layer, 'imports' AS edge_type, 1.0::DOUBLE AS weight FROM imports UNION ALL SELECT source, target, 'structural', 'contains', 1.0 FROM contains_
    UNION ALL SELECT a, b, 'change', 'co_changes', w FROM coupled UNION ALL SELECT source, target, 'defect', 'fault_propagates', weight FROM faults),
sp AS (SELECT DISTINCT LEAST(source, target) AS lo, GREATEST(source, target) AS hi FROM edges WHERE layer = 'structural'),
fin AS (SELECT target AS id, COUNT(*) AS fan_in FROM edges WHERE layer = 'structural' GROUP BY target),
fout AS (SELECT source AS id, COUNT(*) AS fan_out FROM edges WHERE layer = 'structural' GROUP BY source),
cb AS (SELECT source AS id, COUNT(DISTINCT file_path) AS cbo FROM edges JOIN nodes ON id = target WHERE layer = 'structural' GROUP BY source),
nm AS MATERIALIZED (SELECT id, COALESCE(fan_in, 0) AS fan_in, COALESCE(fan_out, 0) AS fan_out, COALESCE(cbo, 0) AS cbo, CASE WHEN COALESCE(fan_in, 0) + COALESCE(fan_out, 0) = 0 THEN 0.0 ELSE COALESCE(fan_out, 0) / (COALESCE(fan_in, 0) + COALESCE(fan_out, 0)) END AS instability
    FROM nodes LEFT JOIN fin USING (id) LEFT JOIN fout USING (id) LEFT JOIN cb USING (id)),
cw AS (SELECT source AS f, target AS t, weight AS w FROM edges WHERE edge_type = 'co_changes' UNION ALL SELECT target, source, weight FROM edges WHERE edge_type = 'co_changes')"""


def is_test(c: str) -> str:
    return f"REGEXP_MATCHES({c}, '(^|/)(test_|tests_)[^/]*$|(_test\\.py|\\.test\\.ts|\\.test\\.js|\\.spec\\.ts|\\.spec\\.js)$|(^|/)tests?/')"


def is_source(c: str) -> str:
    return f"REGEXP_MATCHES({c}, '\\.(py|ts|tsx|js|jsx|rs|go|java|rb|cpp|c|h|cs|swift|kt|scala)$')"


def is_docs(c: str) -> str:
    return f"({c} LIKE 'docs\\_src/%' ESCAPE '\\' OR {c} LIKE 'docs/%' OR {c} LIKE 'examples/%' OR {c} LIKE 'example/%' OR CONTAINS({c}, '/docs_src/') OR CONTAINS({c}, '/examples/'))"


def is_generated(c: str) -> str:
    ends = " OR ".join(f"ENDS_WITH({c}, '{s}')" for s in (".pb.go", "_pb.go", ".pb.ts", "_pb.ts", "_pb2.py", "_pb2_grpc.py", ".generated.ts", ".generated.go", ".generated.rs", ".g.dart"))
    return f"({ends} OR CONTAINS({c}, '/generated/') OR (CONTAINS({c}, '/gen/') AND (ENDS_WITH({c}, '.go') OR ENDS_WITH({c}, '.ts') OR ENDS_WITH({c}, '.py'))))"


def is_reexport(c: str) -> str:
    return f"(SPLIT_PART({c}, '/', -1) IN ('__init__.py', 'index.ts', 'index.js', 'mod.rs'))"


def crate(c: str) -> str:
    return f"(CASE WHEN REGEXP_MATCHES({c}, '^[^/]*/src(/|$)') THEN SPLIT_PART({c}, '/', 1) END)"


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"


SIGNAL_PARTS = f"""
ghost0 AS (SELECT source, target, weight, EXISTS (SELECT 1 FROM imports x JOIN imports y ON x.source = y.source WHERE x.target = e.source AND y.target = e.target) OR COALESCE({crate("e.source")} <> {crate("e.target")}, FALSE) AS less
    FROM edges e, marks WHERE edge_type = 'co_changes' AND weight > p90 AND {is_test("source")} = {is_test("target")} AND {is_source("source")} AND {is_source("target")}
    AND NOT EXISTS (SELECT 1 FROM sp WHERE lo = LEAST(e.source, e.target) AND hi = GREATEST(e.source, e.target))),
ghost AS (SELECT 'ghost_coupling' AS signal_type, source AS node_a, target AS node_b, CASE WHEN less THEN weight * 0.3 ELSE weight END AS severity FROM ghost0, marks WHERE NOT less OR weight >= p99),
fragile AS (SELECT 'fragile_boundary' AS signal_type, e.source AS node_a, e.target AS node_b, e.weight * f.w * 10 AS severity FROM edges e
    JOIN (SELECT source, target, MIN_BY(w, back) AS w FROM (SELECT source, target, weight AS w, 0 AS back FROM faults UNION ALL SELECT target, source, weight, 1 FROM faults) GROUP BY ALL) f ON f.source = e.source AND f.target = e.target, marks
    WHERE edge_type = 'co_changes' AND e.weight > p50 AND f.w > (SELECT ROUND(QUANTILE_CONT(weight, 0.9), 9) FROM faults) AND EXISTS (SELECT 1 FROM sp WHERE lo = LEAST(e.source, e.target) AND hi = GREATEST(e.source, e.target))),
ki AS (SELECT source, target FROM imports WHERE NOT {is_reexport("source")} AND NOT {is_reexport("target")} AND NOT {is_docs("source")} AND NOT {is_docs("target")}),
fi AS (SELECT MIN((source, target)) AS e FROM (SELECT *, LEAST(source, target) AS lo, GREATEST(source, target) AS hi FROM ki) GROUP BY lo, hi),
ge AS (SELECT e[1] AS source, e[2] AS target FROM fi),
gw AS (SELECT source, target, COALESCE(w, 0) AS w FROM ge LEFT JOIN cw ON f = source AND t = target),
gk AS (SELECT gw.*, i.importers, COALESCE(n.complexity, 0) AS cx, COALESCE(c.change_freq, 0) AS fq FROM gw LEFT JOIN (SELECT target, COUNT(*) AS importers FROM imports GROUP BY target) i USING (target)
    LEFT JOIN nodes n ON n.id = gw.target LEFT JOIN cm c ON c.node_id = gw.target),
lim AS (SELECT (SELECT ROUND(QUANTILE_CONT(complexity, 0.25), 9) FROM modules) AS cx25, (SELECT ROUND(QUANTILE_CONT(change_freq, 0.25), 9) FROM freq) AS fq25),
single AS (SELECT 'over_engineering' AS signal_type, source AS node_a, target AS node_b, 0.4::DOUBLE AS severity FROM gk, marks, lim WHERE w < p50 AND importers = 1 AND cx <= cx25 AND fq <= fq25),
pass0 AS (SELECT gk.source, gk.target, o.target AS c, ac.w AS wac FROM gk JOIN imports o ON o.source = gk.target AND o.target <> gk.source JOIN cw ac ON ac.f = gk.source AND ac.t = o.target LEFT JOIN cw bc ON bc.f = gk.target AND bc.t = o.target, marks, lim
    WHERE gk.w < p75 AND NOT (importers = 1 AND cx <= cx25 AND fq <= fq25) AND ac.w > p75 AND COALESCE(bc.w, 0) < p75),
pass_ AS (SELECT 'over_engineering' AS signal_type, source AS node_a, target AS node_b, MIN_BY(wac, c) * 0.5 AS severity FROM pass0 GROUP BY source, target),
stable AS (SELECT 'stable_core' AS signal_type, id AS node_a, CAST(NULL AS VARCHAR) AS node_b, 0.1::DOUBLE AS severity FROM nm JOIN cm ON node_id = id, (SELECT ROUND(QUANTILE_CONT(change_freq, 0.1), 9) AS low FROM cm), (SELECT ROUND(QUANTILE_CONT(fan_in, 0.8), 9) AS high FROM nm)
    WHERE change_freq > 0 AND change_freq <= low AND high > 0 AND fan_in >= high AND NOT {is_test("id")} AND NOT {is_docs("id")}),
bomb AS (SELECT 'ticking_bomb' AS signal_type, cm.node_id AS node_a, CAST(NULL AS VARCHAR) AS node_b, hotspot_score * defect_density * 10 AS severity FROM cm JOIN dm USING (node_id),
    (SELECT ROUND(QUANTILE_CONT(hotspot_score, 0.7), 9) AS h, ROUND(QUANTILE_CONT(sum_coupling, 0.6), 9) AS c FROM cm), (SELECT ROUND(QUANTILE_CONT(defect_density, 0.5), 9) AS d FROM dm) WHERE hotspot_score > h AND defect_density > d AND sum_coupling > c AND h > 0 AND d > 0 AND c > 0),
god AS (SELECT 'god_module' AS signal_type, id AS node_a, CAST(NULL AS VARCHAR) AS node_b, complexity / 50.0 * (loc / 500.0) * (cbo / 15.0) AS severity FROM nodes JOIN nm USING (id) WHERE complexity >= 50 AND loc >= 100 AND cbo >= 15 AND NOT {is_test("id")} AND NOT {is_generated("id")}),
br AS (SELECT f AS id, COUNT(*) AS breadth FROM cw GROUP BY f),
shot AS (SELECT 'shotgun_surgery' AS signal_type, id AS node_a, CAST(NULL AS VARCHAR) AS node_b, breadth / lb AS severity FROM br, (SELECT ROUND(QUANTILE_CONT(breadth, 0.9), 9) AS lb FROM br) WHERE breadth >= lb AND {is_source("id")} AND NOT {is_test("id")}),
unst AS (SELECT 'unstable_dependency' AS signal_type, source AS node_a, target AS node_b, b.instability - a.instability AS severity FROM imports JOIN nm a ON a.id = source JOIN nm b ON b.id = target
    WHERE b.instability - a.instability >= 0.2 AND a.instability < 0.5 AND b.instability > 0.7 AND {is_source("source")} AND {is_source("target")} AND NOT {is_test("source")} AND NOT {is_reexport("source")} AND NOT {is_reexport("target")})"""

_REACH = """
reach AS (SELECT source, target FROM ce UNION SELECT r.source, e.target FROM reach r JOIN ce e ON e.source = r.target),
scc AS (SELECT x.source AS id, LEAST(MIN(x.target), MIN(x.source)) AS component FROM reach x JOIN reach y ON y.source = x.target AND y.target = x.source WHERE x.source <> x.target GROUP BY x.source)"""

# the cycle signal's graph: structure, and the co-changes from P99.9 on
CYCLES = """
ce AS MATERIALIZED (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges WHERE edge_type <> 'co_changes' AND layer <> 'defect' UNION ALL SELECT a, b FROM couplings, marks WHERE w >= p999) WHERE source <> target),""" + _REACH

# all layers; what no edge leaves is on no cycle
ALL_CYCLES = """
ce AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE source <> target AND target IN (SELECT source FROM edges)),""" + _REACH

SEVERITY = "SELECT signal_type, node_a, node_b, ROUND(severity, 6) AS severity FROM "
