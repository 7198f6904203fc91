"""Scripts' modes, exports in parts, appends to a store, lookups, locating, and listing of trees."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataweave.functions.ignore import IgnoreRules
from strataweave.operators import locate
from strataweave.plans import export, queries
from strataweave.plans.store import MAX_VERSIONS, Store
from strataweave.sources import files, parsers


def found(text, **how):
    f = parsers.typescript(text, **how)
    return [(m.name, m.line_start, m.line_end, m.complexity) for m in f.functions], [m.name for m in f.classes], f.imports


@pytest.mark.parametrize(
    ("text", "functions", "classes"),
    [
        ("export const f = <T,>(x: T): T => x", [("f", 1, 1, 1)], []),
        ("const g = async <T>(x: T): Promise<T> => {\n  return x ? 1 : 2\n}", [("g", 1, 3, 2)], []),
        ("const A = () => <div>it's {x ? 'a' : 'b'}</div>\nexport class D { }", [("A", 1, 1, 2)], ["D"]),
        ("const A = () => <div>\n  if (a) && b?\n</div>\nfunction z() {}", [("A", 1, 3, 1), ("z", 4, 4, 1)], []),
        ("const B = () => (<><C.D e={() => y && <i>\"</i>} f='}' /></>)\nconst k = x => x / 2 / 3", [("B", 1, 1, 2), ("k", 2, 2, 1)], []),
        ("const t = `${a ? `b${c && d}` : '`'} if (x)`\nfunction u() { return `\n` }", [("u", 2, 3, 1)], []),
        ("type F = <T>(x: T) => T;\nconst h = (a): { b: number } => ({ b: a });\nclass K<T> extends L<T> { m() { return a < b && c > d } }", [("h", 2, 2, 1)], ["K"]),
        ("const r = /[<'\"/]/g\nconst s = a < b ? <p/> : <q>x</q>\nfunction v() {}", [("v", 3, 3, 1)], []),
        ("function w() { return <Row<string> key=\"a\" on={/* it's */ () => 1}>{/* don't */}</Row> }\nconst x = (n: number): ((m: number) => void) => () => {}", [("w", 1, 1, 1), ("x", 2, 2, 1)], []),
        ("const é = () => 1\nconst y = (1 ? <a b=<c/> /> : 2)\nfunction* q() {}", [("é", 1, 1, 1), ("q", 3, 3, 1)], []),
        ("const n = <div>unclosed", [], []),
    ],
)
def test_scripts_of_many_modes(text, functions, classes):
    assert found(text)[:2] == (functions, classes)


def test_files_without_elements():
    text = "const a = <T>(x: T) => x;\nfunction b() { return <any>a; }\nclass C {}"
    assert found(text, jsx=False)[:2] == ([("a", 1, 1, 1), ("b", 2, 2, 1)], ["C"])
    vue = parsers.vue("<template>it's</template>\n<script>\nexport const f = <T,>(x: T) => x\n</script>")
    assert [(m.name, m.line_start) for m in vue.functions] == [("f", 3)]


def tables(spark):
    hot = spark.createDataFrame([(f"src/m{i}.py", i / 40) for i in range(30)], "id string, score double")
    signals = spark.createDataFrame([("ghost_coupling", f"a{i % 7}", None if i % 5 == 0 else f"b{i % 3}", i % 4 / 4, f'say "{i}"', '{"x": 1}' if i % 2 else "no json") for i in range(40)], "signal_type string, node_a string, node_b string, severity double, description string, details string")
    edges = spark.createDataFrame([(f"n{i % 4}", "m", "structural", "imports", 1.0, None) for i in range(25)], "source string, target string, layer string, edge_type string, weight double, metadata string")
    info = spark.createDataFrame([("time_window", "all")], "key string, value string")
    return hot, signals, edges, info


@pytest.mark.parametrize("parts", [1, 5])
def test_parts_in_order_are_the_text(spark, tmp_path, parts):
    hot, signals, edges, info = tables(spark)
    viz = hot.select("id", F.lit("module").alias("type"), "score")
    for name, lines in (("dot", export.dot_lines(hot, signals)), ("mermaid", export.mermaid_lines(hot, signals)), ("viz", export.viz_json_lines(viz, edges, signals, info))):
        export.write_parts(lines, str(tmp_path / name), parts)
        written = sorted((tmp_path / name).glob("part-*"))
        whole = "".join(p.read_text() for p in written)
        assert whole == export.as_text(lines).first()["text"] + "\n" and len(written) <= parts
        assert parts == 1 or sum(p.stat().st_size > 0 for p in written) > 1
    document = json.loads(whole)
    assert [len(document[k]) for k in ("nodes", "edges", "signals")] == [30, 25, 40]
    assert [s["severity"] for s in document["signals"]] == sorted((s["severity"] for s in document["signals"]), reverse=True)
    assert document["meta"]["file_count"] == 30


def test_documents_of_nothing(spark):
    hot, signals, edges, info = (t.limit(0) for t in tables(spark))
    document = json.loads(export.viz_json(hot, edges, signals, info).first()["text"])
    assert document["nodes"] == document["edges"] == document["signals"] == []
    assert export.mermaid(hot, signals).first()["text"] == "graph LR\n  classDef hot fill:#f96,stroke:#333"


def test_appends_write_only_what_is_new(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    node = lambda i, loc: (f"n{i}", "module", f"n{i}", loc)
    nodes = lambda rows: spark.createDataFrame(rows, "id string, type string, file_path string, loc int")
    edge = lambda a, b: spark.createDataFrame([(a, b, "structural", "imports", 1.0)], "source string, target string, layer string, edge_type string, weight double")
    store.append(nodes=nodes([node(0, 1), node(1, 1)]), edges=edge("n0", "n1"))
    before = {p: p.stat().st_mtime_ns for p in Path(store.path).rglob("*.parquet")}
    store.append(nodes=nodes([node(1, 5), node(2, 2)]))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    new = {p.parts[-2] for p in Path(store.path).rglob("*.parquet")} - {"layer=structural"}
    assert len(store.versions()) == 2 and new == {"nodes"}
    store.append(edges=edge("n0", "n1"))
    assert {(r["id"], r["loc"]) for r in store.table("nodes").collect()} == {("n0", 1), ("n1", 5), ("n2", 2)}
    assert store.table("edges").count() == 2 and store.table("signals").isEmpty()
    for _ in range(MAX_VERSIONS - 2):
        store.append(edges=edge("n0", "n2"))
    assert len(store.versions()) == 1 and store.table("edges").count() == MAX_VERSIONS and store.table("nodes").count() == 3
    store.write(nodes=nodes([node(9, 9)]))
    assert [r["id"] for r in store.table("nodes").collect()] == ["n9"] and store.table("edges").isEmpty()


def test_lookups(spark):
    nodes = spark.createDataFrame([("b", 1), ("a", 2)], "id string, loc int")
    assert queries.get_node(nodes, "a").first()["loc"] == 2 and queries.get_node(nodes, "x").isEmpty()
    assert [r["id"] for r in queries.node_ids(nodes).collect()] == ["a", "b"]
    assert queries.get_nodes(nodes, spark.createDataFrame([("a",), ("a",), ("x",)], "id string")).count() == 1
    edges = spark.createDataFrame([("a", "b", "imports"), ("b", "a", "imports"), ("b", "a", "co_changes")], "source string, target string, edge_type string")
    assert queries.edges_between(edges, "a", "b").select("source").collect() == [("a",)]
    assert queries.edges_between(edges, "a", "b", "co_changes").select("source").collect() == [("b",)]


def test_locate_spreads_what_words_match(spark):
    nodes = spark.createDataFrame([("src/HTTPServer2.py",), ("src/client.py",), ("src/parseServer.py",), ("docs/x.md",)], "id string")
    postings = locate.index(nodes)
    terms = {r["id"]: set(r["t"]) for r in postings.groupBy("id").agg(F.collect_set("term").alias("t")).collect()}
    assert terms["src/HTTPServer2.py"] == {"src", "http", "server", "2", "py"} and "parse" in terms["src/parseServer.py"]
    edges = spark.createDataFrame([("src/client.py", "src/HTTPServer2.py", "structural", "imports", 1.0), ("src/HTTPServer2.py", "docs/x.md", "change", "co_changes", 0.4)], "source string, target string, layer string, edge_type string, weight double")
    change = spark.createDataFrame([("src/parseServer.py", 0.5)], "node_id string, hotspot_score double")
    got = {r["id"]: r["score"] for r in locate.ranked(postings, edges, change, "the HTTP server").collect()}
    server, http = math.log(1 + 4 / 2), math.log(1 + 4 / 1)
    want = {"src/HTTPServer2.py": server + http, "src/parseServer.py": server * 1.5, "src/client.py": 0.25 * (server + http), "docs/x.md": 0.2 * (server + http)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert [r["id"] for r in locate.ranked(postings, edges, change, "the HTTP server", 1).collect()] == ["src/HTTPServer2.py"]
    assert locate.ranked(postings, edges, change, "!").isEmpty()


def test_trees_are_listed_level_by_level(spark, tmp_path, monkeypatch):
    for name in ("a.py", "_private.py", "sub/__init__.py", "sub/deep/er/b.ts", "node_modules/x.js", ".git/c.py", "sub/.hidden/d.py", "sub/dist/e.py", "docs/f.py", "sub/.dot.py", "no.txt", "sub/_x/g.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    (tmp_path / "loop").symlink_to(tmp_path)
    monkeypatch.setattr(files, "FOLDERS", 1)
    got = {r["path"]: bytes(r["content"]).decode() for r in files.walk(spark, str(tmp_path), IgnoreRules.parse("docs/\n")).collect()}
    assert got == {p: f"# {p}\n" for p in ("a.py", "_private.py", "sub/__init__.py", "sub/deep/er/b.ts", "sub/.dot.py", "sub/_x/g.go")}
    with pytest.raises(FileNotFoundError):
        files.walk(spark, str(tmp_path / "none"))
