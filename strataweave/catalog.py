"""The queries of the catalogue on the driver's tables; catalog_sql has them in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_sql import ALL_CYCLES, CYCLES, GRAPH, LINES, MODULES, PAIRS, SEVERITY, SIGNAL_PARTS, crate, is_docs, is_generated, is_reexport, is_source, is_test, q
from .functions import display, imports, paths
from .functions.ignore import IgnoreRules
from .operators import change, components, defect, graphops, metrics, ranges, signals, spectral, stress, structural
from .plans import export
from .plans import queries as fixed
from .session import cut
from .sources import files
from .sources.fixture import BUILD, Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})




# --- change layer -------------------------------------------------------------------------------------------------


@query("change_freq_churn", q(LINES, "SELECT file, change_freq, churn_lines, ROUND(churn_lines / change_freq, 6) AS churn_rate FROM freq"))
def change_freq_churn(fx: Fixture) -> DataFrame:
    return rounded(fx.frequencies().drop("last_changed"), "churn_rate")


@query("co_change_pairs", q(PAIRS, "SELECT a, b, cnt FROM pairs"))
def co_change_pairs(fx: Fixture) -> DataFrame:
    return change.co_change_pairs(fx.touches(), BUILD.max_files_per_commit)


@query("coupling_edges", q(PAIRS, "SELECT a, b, cnt, ROUND(w, 6) AS w FROM coupled"))
def coupling_edges(fx: Fixture) -> DataFrame:
    return rounded(fx.coupled(), "w")


@query("sum_coupling", q(PAIRS, "SELECT file, ROUND(sum_coupling, 6) AS sum_coupling FROM sumc"))
def sum_coupling(fx: Fixture) -> DataFrame:
    return rounded(change.sum_couplings(fx.coupled()), "sum_coupling")


@query("coupling_marks", q(PAIRS, "SELECT p25, p50, p75, p90, p99, p999 FROM marks"))
def coupling_marks(fx: Fixture) -> DataFrame:
    return fx.marks()


@query("hotspots_stored", q(PAIRS, "SELECT node_id, change_freq, churn_lines, ROUND(churn_rate, 6) AS churn_rate, ROUND(hotspot_score, 6) AS hotspot_score, ROUND(sum_coupling, 6) AS sum_coupling FROM cm"))
def hotspots_stored(fx: Fixture) -> DataFrame:
    return rounded(fx.change_metrics().drop("last_changed"), "churn_rate", "hotspot_score", "sum_coupling")


HOT = "hot AS (SELECT n.id, f.change_freq / (SELECT MAX(change_freq) FROM freq) * (COALESCE(n.complexity, 1) / (SELECT MAX(complexity) FROM nodes)) AS score, f.change_freq, n.complexity FROM nodes n JOIN freq f ON f.file = n.id WHERE f.change_freq > 0)"


@query("hotspots_topk", q(LINES + ",\n" + HOT, "SELECT id, ROUND(score, 6) AS score, change_freq, complexity FROM hot ORDER BY score DESC, id LIMIT 20"))
def hotspots_topk(fx: Fixture) -> DataFrame:
    return rounded(fixed.hotspots(fx.nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 20), "score")


@query("hotspots_ranked", q(LINES + ",\n" + HOT, "SELECT id, ROUND(score, 6) AS score, change_freq, complexity, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM hot ORDER BY score DESC, id LIMIT 50"))
def hotspots_ranked(fx: Fixture) -> DataFrame:
    return rounded(fixed.rank_hotspots(fx.nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 50), "score")


@query("bulk_cut", q(LINES, "SELECT commit_id, COUNT(*) AS n_files FROM touches GROUP BY commit_id HAVING COUNT(*) > 8"))
def bulk_cut(fx: Fixture) -> DataFrame:
    return change.bulk_commits(fx.touches(), BUILD.max_files_per_commit)


@query("time_window", q(LINES, "SELECT commit_id, seq FROM commits WHERE ts IS NULL OR ts >= (SELECT MAX(ts) FROM commits) - INTERVAL 180 DAY"))
def time_window(fx: Fixture) -> DataFrame:
    return fx.commits().join(F.broadcast(fx.now())).where(change.in_window(F.col("ts"), F.col("now"), "6 months ago")).select("commit_id", "seq")


@query(
    "early_stop",
    q(LINES, """, c AS (SELECT *, CASE WHEN ts >= (SELECT MAX(ts) FROM commits) - INTERVAL 30 DAY OR (seq % 150) = 0 THEN 1 ELSE 0 END AS i FROM commits),
r AS (SELECT *, SUM(i) OVER (ORDER BY seq) AS run FROM c), o AS (SELECT seq, ROW_NUMBER() OVER (PARTITION BY run ORDER BY seq) AS nth FROM r WHERE i = 0)
SELECT commit_id, seq FROM commits WHERE seq < COALESCE((SELECT MIN(seq) FROM o WHERE nth = 101), 1000000000)""").replace("\n,", ","),
)
def early_stop(fx: Fixture) -> DataFrame:
    """Every 150th commit counts as inside, so that runs of old commits are broken."""
    c = fx.commits().join(F.broadcast(fx.now()))
    return change.early_stop(c, change.in_window(F.col("ts"), F.col("now"), "1 month ago") | (F.col("seq") % 150 == 0)).select("commit_id", "seq")


@query("commit_cap", q(LINES, "SELECT t.commit_id, t.file FROM touches t JOIN (SELECT commit_id FROM (SELECT DISTINCT commit_id, seq FROM touches) ORDER BY seq LIMIT 500) USING (commit_id)"))
def commit_cap(fx: Fixture) -> DataFrame:
    return change.commit_cap(fx.touches(), 500).select("commit_id", "file")


@query("kept_touches", q(LINES, "SELECT file, COUNT(*) AS n FROM touches WHERE REGEXP_MATCHES(file, '[^/]\\.(py|ts|tsx|js|jsx|rs|go|vue)$') AND NOT ENDS_WITH(file, '.pb.go') GROUP BY file"))
def kept_touches(fx: Fixture) -> DataFrame:
    return change.kept_files(fx.touches()).groupBy("file").agg(F.count("*").alias("n"))


@query("change_propagates", q(PAIRS, "SELECT source, target, cnt, ROUND(cnt / change_freq, 6) AS weight FROM (SELECT x.file AS source, y.file AS target, COUNT(DISTINCT x.seq) AS cnt FROM (SELECT file, seq, UNNEST(RANGE(1, 6)) AS k FROM st) x JOIN st y ON y.seq = x.seq - x.k AND x.file <> y.file GROUP BY ALL) JOIN freq ON file = source"))
def change_propagates(fx: Fixture) -> DataFrame:
    return rounded(change.change_propagates(cut(fx.touches()), 5, BUILD.max_files_per_commit), "weight")


# --- structural layer ---------------------------------------------------------------------------------------------


@query("import_edges", q(GRAPH, "SELECT source, target FROM imports"))
def import_edges(fx: Fixture) -> DataFrame:
    wanted = fx.imports().select("source", F.col("target").alias("path"), paths.language(F.col("source")).alias("language"))
    plain = structural.direct_imports(wanted.select("source", "path"), fx.modules())
    return plain.select("source", "target")


@query("init_fallback", q(MODULES, """, w AS (SELECT id AS source, 'pkg' || n || '.py' AS path FROM modules), m AS (SELECT DISTINCT CASE WHEN n % 2 = 0 THEN 'pkg' || n || '.py' ELSE 'pkg' || n || '/__init__.py' END AS id FROM modules)
SELECT source, COALESCE(e.id, i.id) AS target FROM w LEFT JOIN m e ON e.id = path LEFT JOIN m i ON i.id = SUBSTR(path, 1, LENGTH(path) - 3) || '/__init__.py' WHERE COALESCE(e.id, i.id) IS NOT NULL""").replace("\n,", ","))
def init_fallback(fx: Fixture) -> DataFrame:
    m = fx.modules()
    name = F.concat(F.lit("pkg"), F.col("n").cast("string"))
    known = m.select(F.when(F.col("n") % 2 == 0, F.concat(name, F.lit(".py"))).otherwise(F.concat(name, F.lit("/__init__.py"))).alias("id")).distinct()
    return structural.direct_imports(m.select(F.col("id").alias("source"), F.concat(name, F.lit(".py")).alias("path")), known)


@query("prefix_imports", q(MODULES, ", f AS (SELECT DISTINCT id AS source, CASE WHEN n % 2 = 0 THEN 'app' ELSE 'Brand#' || (n + 1) END AS path FROM modules) SELECT source, id AS target FROM f JOIN modules ON STARTS_WITH(id, path || '/') WHERE source <> id").replace("\n,", ","))
def prefix_imports(fx: Fixture) -> DataFrame:
    m = fx.modules()
    path = F.when(F.col("n") % 2 == 0, F.lit("app")).otherwise(F.concat(F.lit("Brand#"), (F.col("n") + 1).cast("string")))
    return structural.folder_imports(m.select(F.col("id").alias("source"), path.alias("path")), m.select("id"))


@query("contains_edges", q(GRAPH, "SELECT source, target FROM contains_"))
def contains_edges(fx: Fixture) -> DataFrame:
    return fx.contains().select("source", "target")


@query("module_complexity", q(MODULES, "SELECT id, loc, complexity FROM modules"))
def module_complexity(fx: Fixture) -> DataFrame:
    """Through parsed files: a part is a function of its module, with its size as complexity."""
    f = F.struct(F.col("p_partkey").cast("string").alias("name"), F.lit(1).alias("line_start"), F.lit(10).alias("line_end"), F.col("p_size").cast("int").alias("complexity"))
    parsed = fx.parts().groupBy(F.col("id").alias("file_path")).agg(F.collect_list(f).alias("functions"), (F.count("*") * 10).cast("int").alias("loc"))
    none = F.array().cast("array<struct<name:string,line_start:int,line_end:int,complexity:int>>")
    return structural.module_nodes(parsed.withColumn("classes", none).withColumn("language", F.lit(None).cast("string"))).select("id", "loc", "complexity")


@query("fan_in_out", q(GRAPH, "SELECT id, fan_in, fan_out FROM nm WHERE fan_in + fan_out > 0"))
def fan_in_out(fx: Fixture) -> DataFrame:
    return metrics.fans(fx.structural())


@query("cbo", q(GRAPH, "SELECT id, cbo FROM cb"))
def cbo(fx: Fixture) -> DataFrame:
    return metrics.coupling_between(fx.structural(), fx.nodes())


@query("instability", q(GRAPH, "SELECT id, fan_in, fan_out, cbo, ROUND(instability, 6) AS instability FROM nm"))
def instability(fx: Fixture) -> DataFrame:
    return rounded(metrics.node_metrics(fx.nodes(), fx.structural()), "instability")


COUNTS = "COUNT(*) AS total_edges, COUNT_IF(layer = 'structural') AS structural_edges, COUNT_IF(layer = 'change') AS change_edges, COUNT_IF(layer = 'defect') AS defect_edges"


@query("graph_metrics", q(GRAPH, f"SELECT (SELECT COUNT(*) FROM nodes) AS total_nodes, {COUNTS} FROM edges".replace("COUNT_IF(layer", "COUNT(*) FILTER (layer")))
def graph_metrics(fx: Fixture) -> DataFrame:
    fx.settle()
    return metrics.graph_metrics(fx.nodes(), fx.edges())


@query("percentiles", q(PAIRS, "SELECT ROUND(QUANTILE_CONT(change_freq, 0.1), 9) AS freq_p10, ROUND(QUANTILE_CONT(hotspot_score, 0.9), 9) AS hotspot_p90, ROUND(QUANTILE_CONT(sum_coupling, 0.8), 6) AS coupling_p80 FROM cm"))
def percentiles(fx: Fixture) -> DataFrame:
    return fx.change_metrics().agg(metrics.percentile("change_freq", 10).alias("freq_p10"), metrics.percentile("hotspot_score", 90).alias("hotspot_p90"), metrics.percentile("sum_coupling", 80, 6).alias("coupling_p80"))


@query("merge_nodes", q(LINES, "SELECT id, COALESCE(MAX(loc), 0) AS loc, COALESCE(MAX(complexity), 0) AS complexity FROM (SELECT id, loc, complexity FROM modules UNION ALL SELECT file, NULL, NULL FROM freq UNION ALL SELECT id, NULL, NULL FROM functions) GROUP BY id"))
def merge_nodes(fx: Fixture) -> DataFrame:
    """Structural nodes win over the bare ones of the change layer."""
    first = fx.modules().select("id", "loc", "complexity")
    second = fx.touches().select(F.col("file").alias("id")).union(fx.contains().select("target")).distinct().select("id", F.lit(None).cast("int").alias("loc"), F.lit(None).cast("int").alias("complexity"))
    none = fx.contains().limit(0)
    return graphops.merge_graphs((first, none), (second, none))[0].select("id", "loc", "complexity").na.fill(0)


@query("layer_filter", q(GRAPH, "SELECT layer, edge_type, COUNT(*) AS n, ROUND(SUM(weight), 4) AS weight FROM edges WHERE layer IN ('structural', 'defect') GROUP BY ALL"))
def layer_filter(fx: Fixture) -> DataFrame:
    fx.settle()
    return fx.edges("structural", "defect").groupBy("layer", "edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


_CO = "SELECT source, target, ROUND(weight, 6) AS weight FROM edges e WHERE edge_type = 'co_changes' AND {} EXISTS (SELECT 1 FROM sp WHERE lo = LEAST(e.source, e.target) AND hi = GREATEST(e.source, e.target))"


def _co(fx: Fixture, how: str) -> DataFrame:
    fx.settle()
    co = change.co_change_edges(fx.coupled()).withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
    return rounded(co.join(signals.structural_pairs(fx.structural()), ["lo", "hi"], how).select("source", "target", "weight"), "weight")


query("structural_semi", q(GRAPH, _CO.format("")))(lambda fx: _co(fx, "left_semi"))
query("ghost_anti", q(GRAPH, _CO.format("NOT")))(lambda fx: _co(fx, "left_anti"))


@query("shared_importers", q(GRAPH, "SELECT x.target AS lo, y.target AS hi, COUNT(*) AS n FROM imports x JOIN imports y ON x.source = y.source AND x.target < y.target GROUP BY ALL"))
def shared_importers(fx: Fixture) -> DataFrame:
    g = signals.Graph(fx.nodes(), fx.structural(), fx.nodes(), fx.nodes(), fx.nodes())
    return signals.shared_importers(g)


# --- defect layer -------------------------------------------------------------------------------------------------


@query("defect_metrics", q(GRAPH, "SELECT node_id, bug_count, ROUND(defect_density, 6) AS defect_density, ROUND(fix_inducing_rate, 6) AS fix_inducing_rate FROM dm"))
def defect_metrics(fx: Fixture) -> DataFrame:
    return rounded(fx.defect_metrics(), "defect_density", "fix_inducing_rate")


@query("fault_propagation", q(GRAPH, "SELECT source, target, cnt, ROUND(weight, 6) AS weight FROM faults"))
def fault_propagation(fx: Fixture) -> DataFrame:
    return rounded(fx.faults(), "weight")


@query("co_fix", q(LINES, "SELECT x.file AS source, y.file AS target, CAST(COUNT(*) AS DOUBLE) AS weight FROM fixes x JOIN fixes y ON x.commit_id = y.commit_id AND x.file < y.file WHERE x.commit_id IN (SELECT commit_id FROM fixes GROUP BY commit_id HAVING COUNT(*) <= 8) GROUP BY ALL"))
def co_fix(fx: Fixture) -> DataFrame:
    return defect.co_fix(fx.fixes(), BUILD.max_files_per_commit)


# --- signals ------------------------------------------------------------------------------------------------------

LIMITS = {
    "signal_ghost_coupling": ("ghost", signals.ghost_coupling, {"ghost_coupling": "p90", "ghost_coupling_high": "p99"}),
    "signal_fragile_boundary": ("fragile", signals.fragile_boundary, {"fragile_coupling": "p50", "fragile_fault": "fault_p90"}),
    "signal_over_engineering_single": ("single", signals.over_engineering_single, {"over_engineering": "p50", "over_engineering_complexity": "complexity_p25", "over_engineering_freq": "freq_p25"}),
    "signal_over_engineering_pass_through": (
        "pass_",
        signals.over_engineering_pass_through,
        {"over_engineering": "p75", "pass_through_coupling": "p75", "over_engineering_complexity": "complexity_p25", "over_engineering_freq": "freq_p25"},
    ),
    "signal_stable_core": ("stable", signals.stable_core, {}),
    "signal_ticking_bomb": ("bomb", signals.ticking_bomb, {"bomb_hotspot": "70", "bomb_defect": "50", "bomb_coupling": "60"}),
    "signal_god_module": ("god", signals.god_module, {"god_loc": "100"}),
    "signal_unstable_dependency": ("unst", signals.unstable_dependency, {"unstable_gap": "0.2", "unstable_from": "0.5"}),
}


def _judged(found: DataFrame) -> DataFrame:
    return rounded(found.select("signal_type", "node_a", "node_b", "severity"), "severity")


def _detect(fx: Fixture, name: str) -> DataFrame:
    _, detector, limits = LIMITS[name]
    return detector(fx.graph(**limits))


for _name, (_cte, _, _) in LIMITS.items():
    query(_name, q(GRAPH + "," + SIGNAL_PARTS, SEVERITY + _cte))(lambda fx, n=_name: _judged(_detect(fx.settle(), n)))


def _shotgun(fx: Fixture) -> DataFrame:
    g = fx.graph()
    mark = signals.breadths(g.layer("change")).agg(metrics.percentile("breadth", 90).alias("shotgun_breadth"))
    limits = g.limits.drop("shotgun_breadth").join(mark)
    return signals.shotgun_surgery(signals.Graph(g.nodes, g.layer("change"), g.nodes, g.nodes, limits))


def _cycle_groups(fx: Fixture, node: str | None = None) -> DataFrame:
    strong = change.co_change_edges(fx.coupled("p999")).select("source", "target")
    edges = fx.structural().select("source", "target").union(strong)
    return components.strong_components(edges) if node is None else components.component_of(edges, node)


def _cycles(fx: Fixture, node: str | None = None) -> DataFrame:
    """The cycles, or the one that a node is on."""
    g = signals.Graph(fx.nodes(), fx.structural(), fx.nodes(), fx.nodes(), fx.nodes())
    return signals.dependency_cycle(g, _cycle_groups(fx, node))


query("signal_shotgun_surgery", q(GRAPH + "," + SIGNAL_PARTS, SEVERITY + "shot"))(lambda fx: _judged(_shotgun(fx.settle())))

CYCLE_SQL = f"""cyc AS (SELECT 'dependency_cycle' AS signal_type, MIN(id) AS node_a, MIN(id) FILTER (id <> component) AS node_b, COUNT(*) * 0.5::DOUBLE AS severity FROM scc GROUP BY component
HAVING COUNT(*) > 1 AND BOOL_AND({is_source("id")} AND NOT {is_generated("id")}) AND EXISTS (SELECT 1 FROM imports i JOIN scc a ON a.id = i.source JOIN scc b ON b.id = i.target WHERE a.component = b.component AND a.component = scc.component))"""
query("signal_dependency_cycle", q(GRAPH + "," + CYCLES + ",\n" + CYCLE_SQL, SEVERITY + "cyc"))(lambda fx: _judged(_cycles(fx.settle())))


def _found(fx: Fixture, *kinds: str, node: str | None = None) -> DataFrame:
    """The signals of these kinds, or of all, in no order; if a node is named, at least all that it is an end of."""
    fx.settle()
    made = {n: lambda n=n: _detect(fx, n) for n in LIMITS} | {"signal_shotgun_surgery": lambda: _shotgun(fx), "signal_dependency_cycle": lambda: _cycles(fx, node)}
    wanted = tuple(f"signal_{k}" for k in kinds or signals.DETECTORS)
    return reduce(DataFrame.unionByName, [f() for n, f in made.items() if n.startswith(wanted)])


def _all(fx: Fixture) -> DataFrame:
    return signals.ordered(cut(_found(fx)))


def _about(fx: Fixture, node: str) -> DataFrame:
    """All signals that the node is an end of, in the order of _all."""
    return signals.ordered(cut(fixed.impact_signals(_found(fx, node=node), node)))


_UNION = " UNION ALL ".join(f"SELECT * FROM {x}" for x in (*[v[0] for v in LIMITS.values()], "shot", "cyc"))
ALL_SQL = GRAPH + "," + SIGNAL_PARTS + "," + CYCLES + ",\n" + CYCLE_SQL + f",\nall_ AS MATERIALIZED ({_UNION})"
query("signals_all", q(ALL_SQL, SEVERITY + "all_"))(lambda fx: _judged(_all(fx)))
query("signals_filtered", q(ALL_SQL, SEVERITY + "all_ WHERE signal_type = 'god_module' AND severity >= 2"))(lambda fx: _judged(fixed.signals_where(_found(fx, "god_module"), "god_module", 2.0)))
query("signals_searched", q(ALL_SQL, SEVERITY + "all_ WHERE signal_type IN ('ghost_coupling', 'stable_core') AND severity >= 0.05 AND (CONTAINS(LOWER(node_a), 'promo') OR COALESCE(CONTAINS(LOWER(node_b), 'promo'), FALSE))"))(lambda fx: _judged(fixed.search_signals(signals.ordered(_found(fx, "ghost_coupling", "stable_core")), ("ghost_coupling", "stable_core"), 0.05, "PROMO")))
query("signal_counts", q(ALL_SQL, "SELECT signal_type, COUNT(*) AS n, CAST(LIST_POSITION([" + ", ".join(f"'{k}'" for k in display.SIGNAL_ORDER) + "], signal_type) AS INTEGER) AS place FROM all_ GROUP BY signal_type"))(lambda fx: fixed.signal_counts(_all(fx)))
query("signal_index", q(ALL_SQL, "SELECT node, signal_type, COUNT(*) AS n FROM (SELECT node_a AS node, signal_type FROM all_ UNION ALL SELECT node_b, signal_type FROM all_ WHERE node_b IS NOT NULL) GROUP BY ALL"))(lambda fx: fixed.signal_index(_all(fx)))
query("signal_priority", q(ALL_SQL, "SELECT priority, COUNT(*) AS n FROM (SELECT CASE WHEN signal_type IN ('fragile_boundary', 'ticking_bomb', 'dependency_cycle') THEN 'critical' WHEN signal_type = 'stable_core' THEN 'guard' WHEN signal_type = 'over_engineering' THEN 'info' ELSE 'high' END AS priority FROM all_) GROUP BY ALL"))(lambda fx: _all(fx).groupBy(display.priority(F.col("signal_type")).alias("priority")).agg(F.count("*").alias("n")))
query("stats", q(ALL_SQL, f"SELECT (SELECT COUNT(*) FROM nodes) AS total_nodes, {COUNTS}, (SELECT COUNT(*) FROM all_) AS total_signals FROM edges".replace("COUNT_IF(layer", "COUNT(*) FILTER (layer")))(lambda fx: fixed.stats(fx.settle().nodes(), fx.edges(), _all(fx)))

# --- queries ------------------------------------------------------------------------------------------------------

CENTER = "Brand#10/src/promo.py"


@query("impact_structural", q(GRAPH, f"SELECT target, edge_type, weight FROM edges WHERE source = '{CENTER}' AND layer = 'structural'"))
def impact_structural(fx: Fixture) -> DataFrame:
    return fixed.impact_structural(fx.structural(), CENTER)


@query("impact_temporal", q(GRAPH, f"SELECT DISTINCT t AS node, ROUND(w, 6) AS weight FROM cw WHERE f = '{CENTER}'"))
def impact_temporal(fx: Fixture) -> DataFrame:
    return rounded(fixed.impact_temporal(change.co_change_edges(fx.settle().coupled()), CENTER), "weight")


query("impact_signals", q(ALL_SQL, SEVERITY + f"all_ WHERE node_a = '{CENTER}' OR node_b = '{CENTER}'"))(lambda fx: _judged(_about(fx, CENTER)))
query("impact")(lambda fx: fixed.impact(fx.settle().nodes(), fx.edges(), _about(fx, CENTER), fx.change_metrics(), CENTER))


@query("scc_members", q(GRAPH + "," + ALL_CYCLES, "SELECT id, component FROM scc"))
def scc_members(fx: Fixture) -> DataFrame:
    """Over the edges of all layers; the cycle signal has its own, smaller graph."""
    return components.strong_components(fx.settle().edges())


@query(
    "modularity_groups",
    q(GRAPH, """, g AS (SELECT id, REGEXP_EXTRACT(file_path, '^([^/]*)', 1) AS grp FROM nodes), e AS (SELECT a.grp AS ga, b.grp AS gb, weight FROM edges JOIN g a ON a.id = source JOIN g b ON b.id = target),
s AS (SELECT grp AS "group", SUM(inside) AS inside, SUM(weight) AS degree FROM (SELECT ga AS grp, weight, CASE WHEN ga = gb THEN weight / 2 ELSE 0.0 END AS inside FROM e UNION ALL SELECT gb, weight, CASE WHEN ga = gb THEN weight / 2 ELSE 0.0 END FROM e) GROUP BY grp)
SELECT "group", ROUND(inside, 6) AS inside, ROUND(degree, 6) AS degree, ROUND(inside / m - POW(degree / (2 * m), 2), 6) AS q FROM s, (SELECT SUM(weight) AS m FROM edges)""").replace("\n,", ","),
)
def modularity_groups(fx: Fixture) -> DataFrame:
    """How modular the division by top folders is, over the edges of all layers."""
    groups = fx.nodes().select("id", F.regexp_extract("file_path", "^([^/]*)", 1).alias("group"))
    return rounded(spectral.modularity(fx.settle().edges(), groups), "inside", "degree", "q")


@query("eigenvector_centrality")
def eigenvector_centrality(fx: Fixture) -> DataFrame:
    """All nodes of the weighted graph by their entry of the dominant eigenvector."""
    return rounded(spectral.eigenvector(fx.settle().edges(), 1e-7)[1], "x")


STRESS_SQL = q(GRAPH + "," + SIGNAL_PARTS, """, str_sb AS (SELECT n.id, COALESCE(loc, 0) AS loc, COALESCE(complexity, 0) AS complexity, COALESCE(fan_in, 0) AS fan_in, COALESCE(fan_out, 0) AS fan_out, COALESCE(cbo, 0) AS cbo, COALESCE(churn_lines, 0) AS churn
FROM nodes n LEFT JOIN nm ON nm.id = n.id LEFT JOIN cm ON cm.node_id = n.id),
str_sp AS (SELECT id, complexity / mc * (cbo / mb) AS stiffness, CAST(GREATEST(fan_in + fan_out, 1) AS BIGINT) AS cross_section, churn / GREATEST(fan_in + fan_out, 1) AS stress, fan_out / mf AS tensile, loc / ml * (complexity / mc) * (cbo / mb) AS compressive
FROM str_sb, (SELECT CAST(MAX(complexity) AS DOUBLE) AS mc, CAST(MAX(cbo) AS DOUBLE) AS mb, CAST(MAX(fan_out) AS DOUBLE) AS mf, CAST(MAX(loc) AS DOUBLE) AS ml FROM str_sb)),
str_sv AS (SELECT *, SQRT(tensile * tensile + tensile * compressive + compressive * compressive) AS von_mises FROM str_sp), str_ss AS (SELECT *, CASE WHEN von_mises > 0 THEN 1.0 / von_mises END AS safety FROM str_sv)
SELECT id, ROUND(stiffness, 6) AS stiffness, cross_section, ROUND(stress, 6) AS stress, ROUND(tensile, 6) AS tensile, ROUND(compressive, 6) AS compressive, ROUND(von_mises, 6) AS von_mises, ROUND(safety, 6) AS safety,
CASE WHEN ROUND(safety, 9) < 1 THEN 'critical' WHEN ROUND(safety, 9) < 1.5 THEN 'danger' WHEN ROUND(safety, 9) < 2 THEN 'warning' WHEN ROUND(safety, 9) <= 3 THEN 'healthy' ELSE 'over_engineered' END AS zone FROM str_ss""").replace("\n,", ",")


@query("material_stress", STRESS_SQL)
def material_stress(fx: Fixture) -> DataFrame:
    fx.settle()
    parts = stress.material(fx.nodes(), metrics.node_metrics(fx.nodes(), fx.structural()), fx.change_metrics())
    names = ("stiffness", "stress", "tensile", "compressive", "von_mises", "safety")
    return rounded(parts.withColumn("zone", stress.zone(F.round("safety", 9))), *names).drop("yield_strength")


@query("stress_field")
def stress_field(fx: Fixture) -> DataFrame:
    """Every module's own churn as its load, spread along all layers."""
    loads = fx.change_metrics().select(F.col("node_id").alias("id"), F.col("churn_lines").alias("pressure"))
    return rounded(stress.relax(loads, fx.settle().edges(), tolerance=1e-7)[0], "stress")


def _around(depth: int) -> str:
    steps = ["h0 AS (SELECT '" + CENTER + "' AS id, 0 AS d)"]
    for i in range(1, depth + 1):
        steps.append(f"h{i} AS (SELECT * FROM h{i - 1} UNION ALL SELECT DISTINCT u.b, {i} FROM ud u JOIN h{i - 1} x ON u.a = x.id AND x.d = {i - 1} WHERE u.b NOT IN (SELECT id FROM h{i - 1}))")
    return GRAPH + ",\nue AS (SELECT source, target, layer, weight FROM edges WHERE layer IN ('structural', 'change')),\nud AS (SELECT source AS a, target AS b FROM ue UNION SELECT target, source FROM ue),\n" + ",\n".join(steps) + f""",
ins AS (SELECT * FROM ue WHERE source IN (SELECT id FROM h{depth}) AND target IN (SELECT id FROM h{depth})),
wt AS (SELECT id, SUM(weight) AS w FROM (SELECT source AS id, weight FROM ins UNION ALL SELECT target, weight FROM ins) GROUP BY id),
rk AS (SELECT id, d, ROW_NUMBER() OVER (ORDER BY d = 0 DESC, ROUND(COALESCE(w, 0), 9) DESC, d, id) AS r FROM h{depth} LEFT JOIN wt USING (id)),
kept AS (SELECT id, d FROM rk WHERE r <= 50)"""


for _d in (1, 2, 3):
    query(f"neighborhood_d{_d}", q(_around(_d), "SELECT id, CAST(d AS INTEGER) AS d FROM kept JOIN nodes USING (id)"))(lambda fx, d=_d: graphops.neighborhood(fx.nodes(), fx.settle().edges("structural", "change"), CENTER, d, ("structural", "change"))[0].select("id", "d"))
query("neighborhood_edges", q(_around(2), "SELECT source, target, layer, ROUND(weight, 6) AS weight FROM ins WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)"))(lambda fx: rounded(graphops.neighborhood(fx.nodes(), fx.settle().edges("structural", "change"), CENTER, 2, ("structural", "change"))[1].select("source", "target", "layer", "weight"), "weight"))

VIZ = GRAPH + """,
viz AS (SELECT n.id, n.type, CASE WHEN CONTAINS(n.file_path, '/') THEN SPLIT_PART(n.file_path, '/', 1) ELSE 'root' END AS module, n.loc, n.complexity, COALESCE(change_freq, 0) AS change_freq, COALESCE(churn_rate, 0) AS churn_rate, COALESCE(hotspot_score, 0) AS hotspot_score,
COALESCE(sum_coupling, 0) AS sum_coupling, COALESCE(bug_count, 0) AS bug_count, COALESCE(defect_density, 0) AS defect_density, fan_in, fan_out FROM nodes n LEFT JOIN cm ON cm.node_id = n.id LEFT JOIN dm ON dm.node_id = n.id JOIN nm ON nm.id = n.id)"""


def _viz(fx: Fixture) -> DataFrame:
    return fixed.viz_nodes(fx.nodes(), fx.settle().structural(), fx.change_metrics(), fx.defect_metrics())


query("viz_nodes", q(VIZ, "SELECT id, type, module, loc, complexity, change_freq, ROUND(churn_rate, 6) AS churn_rate, ROUND(hotspot_score, 6) AS hotspot_score, ROUND(sum_coupling, 6) AS sum_coupling, bug_count, ROUND(defect_density, 6) AS defect_density, fan_in, fan_out FROM viz"))(lambda fx: rounded(_viz(fx), "churn_rate", "hotspot_score", "sum_coupling", "defect_density"))
query("percent_ranks", q(VIZ, "SELECT id, " + ", ".join(f"ROUND(PERCENT_RANK() OVER (ORDER BY ROUND({x}, 9)), 6) AS {x}_rank" for x in fixed.RANKED) + " FROM viz"))(lambda fx: rounded(fixed.percent_ranks(_viz(fx).withColumns({x: F.round(x, 9) for x in ("churn_rate", "hotspot_score", "sum_coupling", "defect_density")})), *[f"{x}_rank" for x in fixed.RANKED]))
query("module_rollup", q(VIZ, "SELECT module, COUNT(*) AS n_nodes, CAST(SUM(GREATEST(loc, 1)) AS BIGINT) AS value FROM viz GROUP BY module"))(lambda fx: fixed.module_rollup(_viz(fx)))
query("module_zoom", q(VIZ, "SELECT id, loc FROM viz WHERE module = 'app'"))(lambda fx: _viz(fx).where("module = 'app'").select("id", "loc"))
query("max_values", q(VIZ, "SELECT " + ", ".join(f"ROUND(MAX({x}), 6) AS max_{x}" if x not in ("complexity", "loc", "change_freq") else f"MAX({x}) AS max_{x}" for x in ("hotspot_score", "complexity", "loc", "churn_rate", "sum_coupling", "defect_density", "change_freq")) + " FROM viz"))(lambda fx: rounded(fixed.max_values(_viz(fx)), "max_hotspot_score", "max_churn_rate", "max_sum_coupling", "max_defect_density"))
query("color_values", q(VIZ, "SELECT id, ROUND(hotspot_score / GREATEST((SELECT MAX(hotspot_score) FROM viz), 0.01), 6) AS value FROM viz"))(lambda fx: (lambda v: v.join(F.broadcast(fixed.max_values(v))).select("id", F.round(display.color_value(F.col("hotspot_score"), F.col("max_hotspot_score")), 6).alias("value")))(_viz(fx)))
query("module_colors", q(VIZ, "SELECT module, CAST((ROW_NUMBER() OVER (ORDER BY module) - 1) % 10 AS INTEGER) AS color FROM (SELECT DISTINCT module FROM viz)"))(lambda fx: fixed.module_colors(_viz(fx)))
query("node_search", q(VIZ, "SELECT id FROM viz WHERE CONTAINS(LOWER(id), 'promo')"))(lambda fx: fixed.search_nodes(fx.nodes(), "PROMO").select("id"))
PREFIX = MODULES + """,
paths AS (SELECT DISTINCT SPLIT_PART(file_path, '/', 1) AS top, file_path, STRING_SPLIT(file_path, '/') AS parts FROM nodes),
pre AS (SELECT top, i, ARRAY_TO_STRING(parts[:i], '/') AS prefix, COUNT(*) AS c FROM (SELECT *, UNNEST(RANGE(0, LEN(parts))) AS i FROM paths) GROUP BY ALL)"""
query("common_prefix", q(PREFIX, "SELECT top, MAX_BY(prefix, i) AS prefix FROM pre WHERE c = (SELECT COUNT(*) FROM paths p WHERE p.top = pre.top) GROUP BY top"))(lambda fx: fixed.common_prefix(fx.nodes().withColumn("top", F.substring_index("file_path", "/", 1)), by="top"))
query("dep_summary", q(GRAPH, "SELECT id, COUNT(*) FILTER (layer = 'structural' AND o) AS structural_out, COUNT(*) FILTER (layer = 'structural' AND NOT o) AS structural_in, COUNT(*) FILTER (layer = 'change' AND weight > 0.05) AS coupled, COUNT(*) FILTER (layer = 'defect') AS defects FROM (SELECT source AS id, TRUE AS o, layer, weight FROM edges UNION ALL SELECT target, FALSE, layer, weight FROM edges) GROUP BY id"))(lambda fx: fixed.dependency_summary(fx.settle().edges(), 0.05))
query("edge_index", q(GRAPH, "SELECT node, layer, COUNT(*) AS n FROM (SELECT source AS node, layer FROM edges UNION ALL SELECT target, layer FROM edges) GROUP BY ALL"))(lambda fx: fixed.edge_index(fx.settle().edges()))
query("highlighted_edges", q(ALL_SQL, "SELECT source, target, edge_type FROM edges e WHERE EXISTS (SELECT 1 FROM all_ a WHERE signal_type IN ('fragile_boundary', 'ghost_coupling', 'ticking_bomb') AND LEAST(node_a, node_b) = LEAST(e.source, e.target) AND GREATEST(node_a, node_b) = GREATEST(e.source, e.target) AND node_b IS NOT NULL)"))(lambda fx: fixed.highlighted(fx.settle().edges(), cut(_found(fx, *fixed.HIGHLIGHTS))).select("source", "target", "edge_type"))
query("granularity_rollup", q(GRAPH, "SELECT SPLIT_PART(source, '/', 1) AS source, SPLIT_PART(target, '/', 1) AS target, 'structural' AS layer, COUNT(*) AS n, COUNT(*)::DOUBLE AS weight FROM imports WHERE SPLIT_PART(source, '/', 1) <> SPLIT_PART(target, '/', 1) GROUP BY ALL"))(lambda fx: graphops.roll_up(fx.imports(), fx.modules().select("id", F.substring_index("id", "/", 1).alias("name"))))

# --- predicates, text and ranges ----------------------------------------------------------------------------------

PREDICATES = f"SELECT id, {is_test('id')} AS is_test, {is_source('id')} AS is_source, {is_docs('id')} AS is_docs, {is_generated('id')} AS is_generated, {is_reexport('id')} AS is_reexport, {crate('id')} AS crate FROM modules"


@query("path_predicates", q(MODULES, PREDICATES))
def path_predicates(fx: Fixture) -> DataFrame:
    p = F.col("id")
    return fx.modules().select("id", paths.is_test_file(p).alias("is_test"), paths.is_source_file(p).alias("is_source"), paths.is_docs_example(p).alias("is_docs"), paths.is_generated_code(p).alias("is_generated"), paths.is_reexport_module(p).alias("is_reexport"), paths.crate_prefix(p).alias("crate"))


def _sources(fx: Fixture) -> DataFrame:
    """schema.FILE_ANALYSIS of a source text for each module, in the language that its number says."""
    n, i = F.col("n"), F.col("n").cast("string")
    kinds = ("python", "typescript", "rust", "go", "vue")
    text = {
        "python": F.concat(F.lit("from .m"), i, F.lit(" import a\n\ndef f"), i, F.lit("(x):\n    if x and a:\n        return 1\n\nclass C"), i, F.lit(":\n    pass\n")),
        "typescript": F.concat(F.lit("import a from './m"), i, F.lit("'\nconst r = /[\"'/]/g\nexport const f"), i, F.lit(" = (x) => x && r ? 1 : 2\nexport class C"), i, F.lit(" {\n  m() { return `a ${ `b` }` }\n}\n")),
        "rust": F.concat(F.lit("use crate::m"), i, F.lit("::A;\npub fn f"), i, F.lit("(x: i32) -> i32 {\n    if x > 0 && true { 1 } else { 2 }\n}\nstruct C"), i, F.lit(" {}\n")),
        "go": F.concat(F.lit('package p\nimport "example.com/m/m'), i, F.lit('"\nfunc f'), i, F.lit("(x int) int {\n\tif x > 0 && true {\n\t\treturn 1\n\t}\n\treturn 2\n}\ntype C"), i, F.lit(" struct {\n}\n")),
        "vue": F.concat(F.lit("<template/>\n<script>\nimport a from '@/m"), i, F.lit("'\nfunction f"), i, F.lit("(x) { return x && a ? 1 : 2 }\nclass C"), i, F.lit(" { }\n</script>\n")),
    }
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (n % 5 + 1).cast("int"))
    content = F.coalesce(*[F.when(kind == k, text[k]) for k in kinds])
    return files.analyze(fx.modules().select(F.col("id").alias("path"), kind.alias("language"), content.cast("binary").alias("content")))


PARSED = MODULES + """,
src AS (SELECT id, n, ['python', 'typescript', 'rust', 'go', 'vue'][n % 5 + 1] AS language, [6, 6, 5, 10, 6][n % 5 + 1] AS loc, [3, 3, 2, 3, 4][n % 5 + 1] AS f_start,
[5, 3, 4, 8, 4][n % 5 + 1] AS f_end, [3, 3, 3, 3, 3][n % 5 + 1] AS complexity, [7, 4, 5, 9, 5][n % 5 + 1] AS c_start, [8, 6, 5, 10, 5][n % 5 + 1] AS c_end FROM modules)"""


@query("parsed_members", q(PARSED, "SELECT id, language, loc, 'function' AS kind, 'f' || n AS name, f_start AS line_start, f_end AS line_end, complexity FROM src UNION ALL SELECT id, language, loc, 'class', 'C' || n, c_start, c_end, 1 FROM src"))
def parsed_members(fx: Fixture) -> DataFrame:
    """The parsers, over a text of each module: declarations with their lines and complexity."""
    parsed = _sources(fx)
    of = lambda name, kind: parsed.select(F.col("file_path").alias("id"), "language", "loc", F.lit(kind).alias("kind"), F.inline(name))
    return of("functions", "function").union(of("classes", "class"))


@query("parsed_imports", q(PARSED, "SELECT id, CASE n % 5 WHEN 0 THEN REGEXP_EXTRACT(id, '^(.*)/[^/]*$', 1) || '/m' || n || '.py' WHEN 1 THEN 'm' || n WHEN 2 THEN 'src/m' || n || '/A.rs' WHEN 3 THEN 'm' || n ELSE 'src/m' || n END AS path FROM src UNION ALL SELECT id, REGEXP_EXTRACT(id, '^(.*)/[^/]*$', 1) || '/m' || n || '/a.py' FROM src WHERE n % 5 = 0"))
def parsed_imports(fx: Fixture) -> DataFrame:
    """The same texts' imports, resolved to paths."""
    return files.resolved(_sources(fx), "example.com/m").select(F.col("file_path").alias("id"), F.explode("imports").alias("path"))


RULES = "docs/\n!docs/promo.py\napp/**/small.py\nBrand#?/src/*.py\n"


@query("ignore_rules", q(MODULES, "SELECT id, CASE WHEN REGEXP_MATCHES(id, '(^|/)(Brand#[^/]/src/[^/]*\\.py|app/.*small\\.py)$') THEN TRUE WHEN id = 'docs/promo.py' THEN FALSE WHEN id LIKE 'docs/%' THEN TRUE ELSE ENDS_WITH(id, '.pb.go') END AS ignored FROM modules"))
def ignore_rules(fx: Fixture) -> DataFrame:
    return fx.modules().select("id", IgnoreRules.parse(RULES).column(F.col("id")).alias("ignored"))


@query("language_detect", q(MODULES, "SELECT id, language FROM modules LEFT JOIN (SELECT DISTINCT lid, language FROM lang) ON lid = id"))
def language_detect(fx: Fixture) -> DataFrame:
    return fx.modules().select("id", paths.language(F.col("id")).alias("language"))


@query("doc_loc", "SELECT doc_id, CAST(LEN(LIST_FILTER(STRING_SPLIT(text, CHR(10)), lambda x: TRIM(x, ' ' || CHR(9) || CHR(13)) <> '')) AS INTEGER) AS loc FROM documents")
def doc_loc(fx: Fixture) -> DataFrame:
    return fx.table("documents").select("doc_id", structural.lines_of_code(F.col("text")).alias("loc"))


@query("script_blocks", "SELECT page_id, REGEXP_EXTRACT(html, '(?si)<script([^>]*)>(.*?)</script>', 2) AS content, CAST(LENGTH(REGEXP_EXTRACT(html, '(?si)^(.*?<script[^>]*>).*?</script>', 1)) - LENGTH(REPLACE(REGEXP_EXTRACT(html, '(?si)^(.*?<script[^>]*>).*?</script>', 1), CHR(10), '')) AS INTEGER) AS line FROM pages")
def script_blocks(fx: Fixture) -> DataFrame:
    return fx.table("pages").select("page_id", structural.script_block(F.col("html")).alias("s")).select("page_id", "s.content", "s.line")


@query("href_imports", "SELECT page_id, path, COUNT(*) AS n FROM (SELECT page_id, REGEXP_REPLACE('.' || UNNEST(REGEXP_EXTRACT_ALL(html, 'href=\"(/[^\"]*)\"', 1)), '^(\\./)+', '') AS path FROM pages) GROUP BY ALL")
def href_imports(fx: Fixture) -> DataFrame:
    hrefs = fx.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("href"))
    return hrefs.select("page_id", imports.ts_import(F.concat(F.lit("."), "href")).alias("path")).groupBy("page_id", "path").agg(F.count("*").alias("n"))


@query("py_import_resolve", q(MODULES, "SELECT id, REPLACE(SPLIT_PART(id, '/', -1), '.', '/') || '.py' AS absolute, CASE WHEN CONTAINS(id, '/') THEN REGEXP_EXTRACT(id, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || 'util/x.py' AS sibling, CASE WHEN LEN(STRING_SPLIT(id, '/')) > 2 THEN ARRAY_TO_STRING(STRING_SPLIT(id, '/')[:-3], '/') || '/__init__.py' ELSE '__init__.py' END AS package FROM modules"))
def py_import_resolve(fx: Fixture) -> DataFrame:
    i = F.col("id")
    return fx.modules().select("id", imports.python_import(F.substring_index(i, "/", -1), i).alias("absolute"), imports.python_import(F.lit(".util.x"), i).alias("sibling"), imports.python_import(F.lit(".."), i).alias("package"))


@query("rust_use_resolve", q(MODULES, "SELECT id, CASE WHEN n % 2 = 0 THEN 'src/a' || n || '/b.rs' END AS used, REGEXP_EXTRACT(id, '^(.*)/[^/]*$', 1) || '/m.rs' AS plain, REGEXP_EXTRACT(id, '^(.*)/[^/]*$', 1) || '/m/mod.rs' AS nested FROM modules"))
def rust_use_resolve(fx: Fixture) -> DataFrame:
    text = F.when(F.col("n") % 2 == 0, F.concat(F.lit("use crate::a"), F.col("n").cast("string"), F.lit("::b::{C, D};"))).otherwise("use std::fmt;")
    places = imports.rust_mod(F.lit("m"), F.col("id"))
    return fx.modules().select("id", imports.rust_use(text).alias("used"), places[0].alias("plain"), places[1].alias("nested"))


@query("go_vue_imports", q(MODULES, "SELECT id, CASE WHEN n % 2 = 0 THEN 'pkg/b' || n END AS go, 'src/c' || n AS vue, CASE WHEN n % 3 = 0 THEN 'd' || n END AS ts FROM modules"))
def go_vue_imports(fx: Fixture) -> DataFrame:
    n = F.col("n").cast("string")
    go = F.when(F.col("n") % 2 == 0, F.concat(F.lit("example.com/m/pkg/b"), n)).otherwise(F.concat(F.lit("example.com/other/b"), n))
    ts = F.when(F.col("n") % 3 == 0, F.concat(F.lit("./d"), n)).otherwise(F.concat(F.lit("d"), n))
    return fx.modules().select("id", imports.go_import(go, "example.com/m").alias("go"), imports.vue_import(F.concat(F.lit("@/c"), n)).alias("vue"), imports.ts_import(ts).alias("ts"))


RANGE_SQL = """
WITH d AS (SELECT o_custkey, o_orderkey, DATEDIFF('day', TIMESTAMP '1992-01-01', o_orderdate) AS b, DATEDIFF('day', TIMESTAMP '1992-01-01', MAX(l_shipdate)) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT o_custkey, o_orderkey AS ref, l_linenumber AS line, CAST(DATEDIFF('day', TIMESTAMP '1992-01-01', l_shipdate) AS BIGINT) AS at_ FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT r.o_custkey, ref, line, at_, o_orderkey, ROW_NUMBER() OVER (PARTITION BY r.o_custkey, ref, line, at_ ORDER BY e - b, b, o_orderkey) AS n FROM r JOIN d ON d.o_custkey = r.o_custkey AND at_ BETWEEN b AND e)
SELECT o_custkey, ref, line, at_ AS "at", o_orderkey FROM m WHERE n = 1
"""


@query("range_innermost", RANGE_SQL)
def range_innermost(fx: Fixture) -> DataFrame:
    """Orders are definitions from their date to their last shipment; all shipments are references."""
    both = fx.table("orders").join(fx.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda x: F.datediff(x, F.lit("1992-01-01").cast("date")).cast("long")
    spans = both.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.max("l_shipdate").alias("last")).select("o_custkey", "o_orderkey", day(F.col("o_orderdate")).alias("b"), day(F.col("last")).alias("e")).where("e >= b")
    refs = both.select("o_custkey", F.col("o_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), day(F.col("l_shipdate")).alias("at")).distinct()
    return ranges.innermost(spans, refs, "o_custkey", "b", "e", "at", "o_orderkey")


@query("json_details", "SELECT event_id, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS k FROM events")
def json_details(fx: Fixture) -> DataFrame:
    return fx.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("age_days", q(LINES, "SELECT commit_id, CAST(DATEDIFF('day', ts, (SELECT MAX(ts) FROM commits)) AS INTEGER) AS age FROM commits"))
def age_days(fx: Fixture) -> DataFrame:
    return fx.commits().join(F.broadcast(fx.now())).select("commit_id", display.age_days(F.col("ts"), F.col("now")).alias("age"))


@query("display_values", q(MODULES, "SELECT id, CASE WHEN loc * 7 >= 1000 THEN PRINTF('%.1f', loc * 7 / 1000.0) || 'k' ELSE CAST(loc * 7 AS VARCHAR) END AS size, SPLIT_PART(id, '/', -1) AS name, ROUND(GREATEST(SQRT(loc) * 0.8, 6.0), 6) AS radius, LEAST(complexity / 400.0, 1.0) AS share FROM modules"))
def display_values(fx: Fixture) -> DataFrame:
    return fx.modules().select("id", display.short_number(F.col("loc") * 7).alias("size"), paths.file_name(F.col("id")).alias("name"), F.round(display.node_radius(F.col("loc")), 6).alias("radius"), display.normalize(F.col("complexity"), F.lit(400.0)).alias("share"))


@query("mermaid_nodes", q(LINES + ",\n" + HOT, "SELECT TRANSLATE(id, '/.:', '___') AS safe_id, score > 0.7 AS hot FROM (SELECT * FROM hot ORDER BY score DESC, id LIMIT 50)"))
def mermaid_nodes(fx: Fixture) -> DataFrame:
    top = fixed.hotspots(fx.nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 50)
    return top.select(display.mermaid_id(F.col("id")).alias("safe_id"), (F.col("score") > 0.7).alias("hot"))


@query("dot_nodes", q(LINES + ",\n" + HOT, "SELECT id, CASE WHEN score > 0.7 THEN 'red' WHEN score > 0.4 THEN 'orange' ELSE 'lightblue' END AS color FROM (SELECT * FROM hot ORDER BY score DESC, id LIMIT 50)"))
def dot_nodes(fx: Fixture) -> DataFrame:
    top = fixed.hotspots(fx.nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 50)
    return top.select("id", display.heat_color(F.col("score")).alias("color"))


def _exported(fx: Fixture, kind: str) -> DataFrame:
    fx.settle()
    top = fixed.hotspots(fx.nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 50)
    return {"dot": export.dot, "mermaid": export.mermaid}[kind](top, _all(fx))


query("export_dot")(lambda fx: _exported(fx, "dot"))
query("export_mermaid")(lambda fx: _exported(fx, "mermaid"))
query("export_viz_json")(lambda fx: export.viz_json(fixed.viz_nodes(fx.settle().nodes(), fx.structural(), fx.change_metrics(), fx.defect_metrics(), document=True), fx.edges(), _all(fx), fx.spark.createDataFrame([("time_window", "all")], "key string, value string")))


@query("export_json")
def export_json(fx: Fixture) -> DataFrame:
    found = _all(fx)
    return export.summary_json(fixed.stats(fx.nodes(), fx.edges(), found), found, fixed.hotspots(fx.nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 100))
