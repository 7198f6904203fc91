"""Further queries on the driver's tables: parsers over varied texts, changes inside files, exports as lines, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ALL_SQL, CENTER, _about, _all, query, rounded
from .catalog_sql import GRAPH, LINES, MODULES, q
from .functions import display
from .operators import intrafile, locate
from .plans import export
from .plans import queries as fixed
from .session import cut
from .sources import files
from .sources.fixture import Fixture

# --- parsers over a text for each part ----------------------------------------------------------------------------

#: language, extension, what a text begins with (lines), what it ends with, and its kinds of functions: head, branch (a
#: line that decides once), tail, complexity without branches, what is before the name.  # is the function's number.
TEXTS = (
    ("python", "py", "import os\n", "", (
        ("def f#(x):", "    if x: pass", "    return x and y or z", 3, ""),
        ("async def f#(x):", "    while x: pass", "    return [i for i in x if i]", 1, ""),
        ("def f#(x, *y):", "    assert x", '    return "if x: pass" if y else None', 2, ""),
    )),
    ("typescript", "ts", "import a from './a'\n", "", (
        ("export function f#<T extends object>(x: T): T {", "  if (x) { }", "  return x;\n}", 1, ""),
        ("export const f# = <T,>(x: T): T => {", "  for (;;) { }", "  return x ? x : y;\n};", 2, ""),
        ("const f# = async <T>(x: T): Promise<T> => {", "  while (x < 1) { }", "  return x ?? y;\n}", 1, ""),
        ("function f#(x?: number): Array<Map<string, number>> {", "  if (/[/'\"]/.test(x)) { }", "  return `${x ? `a'${y}` : '}'} if (b)`;\n}", 2, ""),
    )),
    ("typescript", "tsx", "import a from './a'\n", "", (
        ("export function f#({ x }) {", "  if (x) { }", "  return <p title=\"it's\">what's {x ? 'a' : 'b'} if (c)</p>;\n}", 2, ""),
        ("const f# = ({ x }) => {", "  if (x) { }", "  return (\n    <>\n      don't `{x && <b>{y}</b>}\n      <br/> for (;;)?\n    </>\n  );\n}", 2, ""),
        ("export const f# = <T,>({ x }: P<T>) => {", "  if (x) { }", "  return <A.B<T> on={() => x || <i>'</i>} d=\"{\" />\n}", 2, ""),
    )),
    ("rust", "rs", "use crate::a::B;\n", "", (
        ("pub fn f#(x: i32) -> i32 {", "    if x > 0 {}", "    x\n}", 1, ""),
        ("fn f#<'a, T: Clone>(x: &'a T) -> u8 {", "    while x {}", "    match x { A => 1, _ => 2 }\n}", 3, ""),
        ("pub(crate) async fn f#(x: u8) -> R {", "    loop {}", "    g(x)?;\n    Ok('\"')\n}", 2, ""),
    )),
    ("go", "go", "package p\n", "", (
        ("func f#(x int) int {", "\tif x > 0 { }", "\treturn x\n}", 1, ""),
        ("func (s *S) f#(x int) {", "\tfor x > 0 { }", "\tfor i := range x { }\n}", 2, "S::"),
        ("func f#(x int) (int, error) {", "\tif x > 0 || y { }", "\tswitch x {\n\tcase 1:\n\tdefault:\n\t}\n\treturn 1, nil\n}", 3, ""),
    )),
    ("vue", "vue", "<template><p v-if=\"a\">it's</p></template>\n<script lang=\"ts\">\n", "</script>\n", (
        ("function f#(x) {", "  if (x) { }", "  return x && y\n}", 2, ""),
        ("export const f# = (x: number): string => {", "  if (x) { }", "  return `${x}`\n}", 1, ""),
    )),
)
#: Go's third kind has branches of two decisions.
DOUBLE = "\tif x > 0 || y { }"


def _texts(fx: Fixture) -> DataFrame:
    """(path, language, content): a text of up to four functions for each part; its kinds and branches depend on the key."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = (key % len(TEXTS)).cast("int")

    def text(opening: str, closing: str, kinds: tuple) -> Column:
        array = lambda i: F.array(*[F.lit(k[i]) for k in kinds])

        def function(j: Column) -> Column:
            kind = ((key + 3 * j) % len(kinds) + 1).cast("int")
            at = lambda i: F.element_at(array(i), kind)
            return F.concat(F.replace(at(0), F.lit("#"), j.cast("string")), F.lit("\n"), F.repeat(F.concat(at(1), F.lit("\n")), (key * j % 5).cast("int")), at(2), F.lit("\n"))

        return F.concat(F.lit(opening), F.array_join(F.transform(F.sequence(F.lit(1), size % 4 + 1), function), ""), F.lit(closing))

    content = F.coalesce(*[F.when(pick == i, text(*t[2:])) for i, t in enumerate(TEXTS)])
    named = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in TEXTS]), pick + 1)
    # a table in one small file is one task, but its texts are work for all
    dealt = fx.table("part").select("p_partkey", "p_size").repartition(fx.spark.sparkContext.defaultParallelism * 4, "p_partkey")
    return dealt.select(F.concat(F.lit("src/p"), key.cast("string"), F.lit("."), named(1)).alias("path"), named(0).alias("language"), content.cast("binary").alias("content"))


_KINDS = ", ".join(f"({i}, '{t[0]}', '{t[1]}', {t[2].count(chr(10))}, {len(t[4])}, {v}, {k[2].count(chr(10)) + 2}, {k[3]}, {2 if k[1] == DOUBLE else 1}, '{k[4]}')" for i, t in enumerate(TEXTS) for v, k in enumerate(t[4]))
VARIED_SQL = f"""
WITH k(pick, language, ext, opening, kinds, v, fixed, base, each, owner) AS (VALUES {_KINDS}),
f AS (SELECT p_partkey, p_partkey % {len(TEXTS)} AS pick, UNNEST(GENERATE_SERIES(1, p_size % 4 + 1)) AS j FROM part),
m AS (SELECT f.p_partkey, f.j, k.*, f.p_partkey * f.j % 5 AS b FROM f JOIN k ON k.pick = f.pick AND k.v = (f.p_partkey + 3 * f.j) % k.kinds),
s AS (SELECT *, opening + 1 + COALESCE(SUM(fixed + b) OVER (PARTITION BY p_partkey ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM m)
SELECT 'src/p' || p_partkey || '.' || ext AS id, language, owner || 'f' || j AS name, CAST(a AS INTEGER) AS line_start, CAST(a + fixed + b - 1 AS INTEGER) AS line_end, CAST(base + b * each AS INTEGER) AS complexity FROM s
"""


@query("parsed_varied", VARIED_SQL)
def parsed_varied(fx: Fixture) -> DataFrame:
    """Functions with lines and complexity, from a text for each part in six kinds of files."""
    parsed = files.analyze(_texts(fx))
    return parsed.select(F.col("file_path").alias("id"), "language", F.inline("functions"))


# --- changes inside files -----------------------------------------------------------------------------------------

SPLIT_AT, TOGETHER, TIMES = 0.9, 0.6, 1.3  # the tables are uniform, so limits are near what they hold


def _symbols(fx: Fixture) -> DataFrame:
    """(file, symbol, line_start, line_end): a function for each part of a module, of its size and four lines, three lines
    apart, and a class around every four of them."""
    from pyspark.sql import Window as W

    order = W.partitionBy("id").orderBy("p_partkey")
    start = 3 + F.coalesce(F.sum(F.col("p_size") + 7).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = fx.parts().withColumns({"a": start.cast("int"), "k": F.floor((F.row_number().over(order) - 1) / 4)}).withColumn("b", F.col("a") + F.col("p_size") + 3)
    functions = rows.select(F.col("id").alias("file"), F.concat_ws("::", "id", F.col("p_partkey").cast("string")).alias("symbol"), F.col("a").alias("line_start"), F.col("b").alias("line_end"), "p_partkey", F.concat_ws("::C", "id", F.col("k").cast("string")).alias("owner"))
    classes = rows.groupBy("id", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    around = classes.select(F.col("id").alias("file"), F.concat_ws("::C", "id", F.col("k").cast("string")).alias("symbol"), (F.col("a") - 1).alias("line_start"), (F.col("b") + 1).alias("line_end"))
    return functions.unionByName(around, allowMissingColumns=True)


def _hunks(fx: Fixture) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hunks, symbols and (number, name): numbers stand for files, below 0, and for symbols, as names take more room on their way.

    An order line is a hunk: near its part's function, adding its quantity, or only taking lines away.
    """
    named = cut(_symbols(fx))
    number = F.monotonically_increasing_id()
    files = named.where("file is not null").select(F.col("file").alias("name")).distinct().withColumn("number", -1 - number)
    names = cut(files.unionByName(named.select(F.col("symbol").alias("name")).distinct().withColumn("number", number)))
    of = lambda end, which: names.where(which).select(F.col("name").alias(end), F.col("number").alias(f"_{end}"))
    symbols = named.join(of("symbol", "number >= 0"), "symbol").join(of("file", "number < 0"), "file", "left")
    symbols = cut(symbols.select("p_partkey", F.col("_file").alias("file"), F.col("_symbol").alias("symbol"), "line_start", "line_end"))
    own = symbols.where("p_partkey is not null").select("p_partkey", "file", "line_start")
    added = F.when(F.col("l_linenumber") % 5 == 0, 0).otherwise(F.col("l_quantity")).cast("int")
    lines = fx.table("lineitem").join(own, F.col("l_partkey") == F.col("p_partkey"))
    hunks = lines.select(F.col("l_orderkey").alias("commit_id"), "file", (F.col("l_linenumber") % 4).cast("int").alias("old_lines"), (F.col("line_start") + F.col("l_linenumber") * 7 % 11 - 5).cast("int").alias("new_start"), added.alias("new_lines"))
    return hunks, symbols.select("file", "symbol", "line_start", "line_end"), names


def _named(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """df with names in place of numbers; there are none for none."""
    for c in columns:
        df = df.join(names.select(F.col("number").alias(c), F.col("name").alias("_name")), c, "left").drop(c).withColumnRenamed("_name", c)
    return df


#: Lines of a bucket here: most hunks are in one.
WIDE = 256


def _couplings(fx: Fixture) -> DataFrame:
    hunks, symbols, names = _hunks(fx)
    named = _named(intrafile.hunk_couplings(hunks, symbols, bucket=WIDE), names, "file", "a", "b")
    return named.select("file", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cnt", "w")


SYMBOLS = MODULES + """,
fs AS (SELECT id AS file, p_partkey, (ROW_NUMBER() OVER w - 1) // 4 AS k, p_size, 3 + COALESCE(SUM(p_size + 7) OVER (PARTITION BY id ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pm WINDOW w AS (PARTITION BY id ORDER BY p_partkey)),
fn AS (SELECT file, file || '::' || p_partkey AS symbol, file || '::C' || k AS owner, p_partkey, a, a + p_size + 3 AS b FROM fs),
cl AS (SELECT file, owner AS symbol, MIN(a) - 1 AS a, MAX(b) + 1 AS b FROM fn GROUP BY file, owner),
hu AS (SELECT ROW_NUMBER() OVER () AS h, l_orderkey AS commit_id, file, l_linenumber % 4 + new AS changed, GREATEST(a + l_linenumber * 7 % 11 - 5, 1) AS f, GREATEST(new, 1) AS n
    FROM (SELECT *, CAST(CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS new FROM lineitem) l JOIN fn ON fn.p_partkey = l.l_partkey WHERE l_linenumber % 4 + new > 0),
ov AS (SELECT h, commit_id, hu.file, symbol, owner, (LEAST(b, f + n - 1) - GREATEST(a, f) + 1) * changed / n AS part FROM hu JOIN fn ON fn.file = hu.file AND a <= f + n - 1 AND b >= f),
oc AS (SELECT h, commit_id, hu.file, symbol, (LEAST(b, f + n - 1) - GREATEST(a, f) + 1) * changed / n AS part FROM hu JOIN cl ON cl.file = hu.file AND a <= f + n - 1 AND b >= f),
ol AS (SELECT o.commit_id, o.file, o.symbol, o.part - COALESCE((SELECT SUM(part) FROM ov WHERE ov.h = o.h AND ov.owner = o.symbol), 0) AS part FROM oc o),
ch AS (SELECT commit_id, file, node, SUM(part) AS lines FROM (SELECT commit_id, file, symbol AS node, part FROM ov UNION ALL SELECT commit_id, file, symbol, part FROM ol
    UNION ALL SELECT commit_id, file, file, changed FROM hu UNION ALL SELECT commit_id, file, file, -part FROM oc) GROUP BY ALL HAVING SUM(part) > 1e-6),
st AS (SELECT commit_id, file, node FROM ch WHERE node <> file), fq AS (SELECT file, node, COUNT(*) AS freq FROM st GROUP BY file, node),
pc AS (SELECT x.file, x.node AS a, y.node AS b, COUNT(*) AS cnt FROM st x JOIN st y ON x.commit_id = y.commit_id AND x.file = y.file AND x.node < y.node GROUP BY ALL HAVING COUNT(*) >= 5),
ic AS MATERIALIZED (SELECT pc.file, a, b, cnt, cnt / LEAST(fa.freq, fb.freq) AS w FROM pc JOIN fq fa ON fa.node = a JOIN fq fb ON fb.node = b)"""


@query("symbol_changes", q(SYMBOLS, "SELECT file, node, COUNT(*) AS changes, ROUND(SUM(lines), 6) AS lines FROM ch GROUP BY file, node"))
def symbol_changes(fx: Fixture) -> DataFrame:
    """Changed lines by the innermost function or class around them, or by file outside of both."""
    hunks, symbols, names = _hunks(fx)
    changes = intrafile.attributed(hunks, symbols, WIDE).groupBy("file", "node").agg(F.count("*").alias("changes"), F.sum("lines").alias("lines"))
    return rounded(_named(changes, names, "file", "node").select("file", "node", "changes", "lines"), "lines")


@query("intra_file_couplings", q(SYMBOLS, "SELECT file, a, b, cnt, ROUND(w, 6) AS w FROM ic"))
def intra_file_couplings(fx: Fixture) -> DataFrame:
    return rounded(_couplings(fx), "w")


@query(
    "signal_intra_file_hotspot",
    q(SYMBOLS, f""", sy AS (SELECT file, symbol FROM fn UNION ALL SELECT file, symbol FROM cl), fr AS (SELECT sy.file, symbol, COALESCE(freq, 0) AS freq FROM sy LEFT JOIN fq ON node = symbol),
me AS (SELECT file, AVG(freq) AS mean FROM fr GROUP BY file) SELECT symbol AS node_a, ROUND(freq / mean, 6) AS severity FROM fr JOIN me USING (file) WHERE freq > {TIMES} * mean AND freq >= 5""").replace("\n,", ","),
)
def signal_intra_file_hotspot(fx: Fixture) -> DataFrame:
    hunks, symbols, names = _hunks(fx)
    found = intrafile.hotspots(intrafile.attributed(hunks, symbols, WIDE), symbols, TIMES)
    return rounded(_named(found, names, "node_a").select("node_a", "severity"), "severity")


@query("signal_hidden_intra_file_coupling", q(SYMBOLS, f"SELECT a AS node_a, b AS node_b, ROUND(w, 6) AS severity FROM ic WHERE w > {TOGETHER} AND NOT EXISTS (SELECT 1 FROM fn WHERE (symbol = ic.a AND owner = ic.b) OR (symbol = ic.b AND owner = ic.a))"))
def signal_hidden_intra_file_coupling(fx: Fixture) -> DataFrame:
    contains = _symbols(fx).where("owner is not null").select(F.col("owner").alias("source"), F.col("symbol").alias("target"), F.lit("contains").alias("edge_type"))
    return rounded(intrafile.hidden_couplings(_couplings(fx), contains, TOGETHER), "severity")


@query(
    "signal_file_split_candidate",
    q(SYMBOLS, f""", ln AS (SELECT a, b FROM ic WHERE w >= {SPLIT_AT} UNION SELECT b, a FROM ic WHERE w >= {SPLIT_AT}), re AS (SELECT a, b FROM ln UNION SELECT re.a, ln.b FROM re JOIN ln ON ln.a = re.b),
gr AS (SELECT a AS id, MIN(b) AS g FROM re GROUP BY a), nu AS (SELECT file, COUNT(DISTINCT g) AS groups FROM (SELECT file, a AS id FROM ic UNION SELECT file, b FROM ic) JOIN gr USING (id) GROUP BY file HAVING COUNT(DISTINCT g) >= 2),
wi AS (SELECT ic.file, nu.groups, COALESCE(x.g, a) AS ga, COALESCE(y.g, b) AS gb, w FROM ic JOIN nu USING (file) LEFT JOIN gr x ON x.id = a LEFT JOIN gr y ON y.id = b),
su AS (SELECT file, groups, g, SUM(w) AS degree, SUM(i) AS inside FROM (SELECT file, groups, ga AS g, w, CASE WHEN ga = gb THEN w / 2 ELSE 0.0 END AS i FROM wi UNION ALL SELECT file, groups, gb, w, CASE WHEN ga = gb THEN w / 2 ELSE 0.0 END FROM wi) GROUP BY ALL),
tm AS (SELECT file, SUM(degree) / 2 AS m FROM su GROUP BY file) SELECT file AS node_a, groups, ROUND(1 - SUM(inside / m - POW(degree / (2 * m), 2)), 6) AS severity FROM su JOIN tm USING (file) GROUP BY file, groups""").replace("\n,", ","),
)
def signal_file_split_candidate(fx: Fixture) -> DataFrame:
    return rounded(intrafile.split_candidates(cut(_couplings(fx)), SPLIT_AT), "severity")


# --- exports as lines, lookups ------------------------------------------------------------------------------------

HOT50 = "hot AS (SELECT n.id, f.change_freq / (SELECT MAX(change_freq) FROM freq) * (COALESCE(n.complexity, 1) / (SELECT MAX(complexity) FROM nodes)) AS score FROM nodes n JOIN freq f ON f.file = n.id ORDER BY score DESC, n.id LIMIT 50)"


def _case(words: dict[str, str], other: str) -> str:
    return "CASE signal_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE '{other}' END"


DOT_SQL = q(ALL_SQL + ",\n" + HOT50, f"""SELECT 1 AS section, '  "' || id || '" [label="' || id || '\\n' || PRINTF('%.2f', score) || '", style=filled, fillcolor=' || CASE WHEN score > 0.7 THEN 'red' WHEN score > 0.4 THEN 'orange' ELSE 'lightblue' END || '];' AS line FROM hot
UNION ALL SELECT 2, '  "' || node_a || '" -> "' || node_b || '" [' || {_case(display.DOT_STYLES, 'color=black')} || ', label="' || signal_type || '"];' FROM all_ WHERE node_b IS NOT NULL
UNION ALL VALUES (0, 'digraph layers {{'), (0, '  rankdir=LR;'), (0, '  node [shape=box];'), (3, '}}')""")
MERMAID_SQL = q(ALL_SQL + ",\n" + HOT50, f"""SELECT 1 AS section, '  ' || TRANSLATE(id, '/.:', '___') || '["' || id || '\\n' || CASE WHEN score > 0.7 THEN '🔥 ' ELSE '' END || PRINTF('%.2f', score) || '"]' || CASE WHEN score > 0.7 THEN ':::hot' ELSE '' END AS line FROM hot
UNION ALL SELECT 2, '  ' || TRANSLATE(node_a, '/.:', '___') || ' ' || {_case(display.MERMAID_ARROWS, '-->')} || '|' || signal_type || '| ' || TRANSLATE(node_b, '/.:', '___') FROM all_ WHERE node_b IS NOT NULL
UNION ALL VALUES (0, 'graph LR'), (3, '  classDef hot fill:#f96,stroke:#333')""")


def _exported(fx: Fixture, lines) -> DataFrame:
    top = fixed.hotspots(fx.settle().nodes(), fx.frequencies().withColumnRenamed("file", "node_id"), 50)
    return lines(top, _all(fx)).select("section", "line")


query("export_dot_lines", DOT_SQL)(lambda fx: _exported(fx, export.dot_lines))
query("export_mermaid_lines", MERMAID_SQL)(lambda fx: _exported(fx, export.mermaid_lines))

IMPACT_SQL = q(ALL_SQL, f"""SELECT 'node' AS kind, id AS name, type AS about, CAST(NULL AS DOUBLE) AS value FROM nodes WHERE id = '{CENTER}'
UNION ALL SELECT 'dependency', target, edge_type, weight FROM edges WHERE source = '{CENTER}' AND layer = 'structural'
UNION ALL SELECT DISTINCT 'coupling', t, NULL, ROUND(w, 6) FROM cw WHERE f = '{CENTER}'
UNION ALL SELECT 'signal:' || signal_type, node_a, node_b, ROUND(severity, 6) FROM all_ WHERE node_a = '{CENTER}' OR node_b = '{CENTER}'
UNION ALL SELECT 'metric', UNNEST(['change_freq', 'churn_lines', 'hotspot_score', 'sum_coupling']), NULL, ROUND(UNNEST([change_freq, churn_lines, hotspot_score, sum_coupling]), 6) FROM cm WHERE node_id = '{CENTER}'""")


@query("impact_rows", IMPACT_SQL)
def impact_rows(fx: Fixture) -> DataFrame:
    """All that impact says of a module, a row for each thing."""
    return rounded(fixed.impact_rows(fx.settle().nodes(), fx.edges(), _about(fx, CENTER), fx.change_metrics(), CENTER), "value")


@query("node_lookup", q(LINES, "SELECT id, type, loc, complexity FROM nodes WHERE id IN (SELECT file FROM freq WHERE change_freq = (SELECT MAX(change_freq) FROM freq))"))
def node_lookup(fx: Fixture) -> DataFrame:
    """The nodes of the files that change most."""
    freq = fx.frequencies()
    most = freq.join(F.broadcast(freq.agg(F.max("change_freq").alias("top")))).where("change_freq = top").select(F.col("file").alias("id"))
    return fixed.get_nodes(fx.nodes(), most).select("id", "type", "loc", "complexity")


INTENT = "promo small brand 10"
LOCATE_SQL = q(GRAPH, f""", tk AS (SELECT id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(REGEXP_REPLACE(REGEXP_REPLACE(id, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[a-z]+|[0-9]+')) AS term FROM nodes),
po AS (SELECT term, id, COUNT(*) AS tf FROM tk GROUP BY ALL), hi AS (SELECT * FROM po WHERE term IN ({", ".join(f"'{w}'" for w in INTENT.split())})), dq AS (SELECT term, COUNT(*) AS df FROM hi GROUP BY term),
ow AS (SELECT id, SUM((1 + LN(tf)) * LN(1 + (SELECT COUNT(DISTINCT id) FROM po) / df)) AS own FROM hi JOIN dq USING (term) GROUP BY id),
wa AS (SELECT source, target, CASE WHEN layer = 'structural' THEN {locate.STRUCTURAL} ELSE {locate.TEMPORAL} * weight END AS share FROM edges WHERE source <> target AND (layer = 'structural' OR edge_type = 'co_changes')),
pa AS (SELECT target AS id, SUM(own * share) AS passed FROM (SELECT * FROM wa UNION ALL SELECT target, source, share FROM wa) b JOIN ow ON ow.id = b.source GROUP BY target)
SELECT id, ROUND(COALESCE(own, 0), 6) AS own, ROUND((COALESCE(own, 0) + COALESCE(passed, 0)) * (1 + COALESCE(hotspot_score, 0)), 6) AS score FROM ow FULL JOIN pa USING (id) LEFT JOIN cm ON cm.node_id = id""").replace("\n,", ",")


@query("locate", LOCATE_SQL)
def locate_nodes(fx: Fixture) -> DataFrame:
    """All nodes that the words lead to, with their scores."""
    return rounded(locate.ranked(locate.index(fx.nodes()), fx.settle().edges(), fx.change_metrics(), INTENT), "own", "score")
