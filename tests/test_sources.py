import json
import subprocess

from strataweave.cli import Reader, main, parser
from strataweave.config import Build, Config
from strataweave.plans.build import build
from strataweave.plans.export import load_document
from strataweave.plans.store import Store
from strataweave.server import answer
from strataweave.sources import files, gitlog, parsers, symbols
from strataweave.streaming.touches import read_touches, windowed_frequencies

PY = "import os\nfrom .util import helper\nfrom pkg import sub\n\n@deco\ndef skipped():\n    pass\n\ndef f(a):\n    if a and os:\n        return 1\n    for x in a:\n        pass\n\nclass C:\n    def m(self):\n        return 1 if self else 2\n"
TS = "import { b } from './b';\nimport x from 'lib';\nexport function f(a) {\n  if (a && b) { return 1; }\n  return a ? 1 : 2;\n}\nexport class C { m() { for (;;) {} } }\nconst g = async (e) => {\n  while (e) {}\n};\nconst n = 3;\nexport const h = function() { return 1 };\n"
RS = "use crate::a::{B, C};\nuse std::fmt;\nmod inner;\npub struct S { x: i32 }\nenum E { A }\nimpl S {\n    pub fn go(&self) -> Option<i32> {\n        if self.x > 0 && true { return None; }\n        match self.x { 1 => Some(1), _ => None }\n    }\n}\nfn top() { for i in 0..3 {} }\n"
GO = 'package main\n\nimport (\n\t"fmt"\n\t"example.com/m/pkg/db"\n)\n\ntype S struct {\n\tx int\n}\n\nfunc init() {}\nfunc init() {}\n\nfunc (s *S) Run(a int) int {\n\tif a > 0 && s.x > 1 {\n\t\treturn 1\n\t}\n\tswitch a {\n\tcase 1:\n\t\treturn 2\n\tdefault:\n\t\treturn 3\n\t}\n}\n'
VUE = "<template>\n<div/>\n</template>\n\n<script setup>\nimport A from '@/comp/a'\nimport b from './b'\nfunction go() { return 1 }\n</script>\n"


def names(members):
    return [(m.name, m.complexity) for m in members]


def test_parsers():
    py = parsers.python(PY)
    assert names(py.functions) == [("f", 4)] and names(py.classes) == [("C", 2)]
    assert py.imports == ["os", ".util", ".util.helper", "pkg", "pkg.sub"]
    ts = parsers.typescript(TS)
    assert names(ts.functions) == [("f", 4), ("g", 2), ("h", 1)] and names(ts.classes) == [("C", 2)] and ts.imports == ["./b"]
    rs = parsers.rust(RS)
    assert names(rs.functions) == [("S::go", 5), ("top", 2)] and [c.name for c in rs.classes] == ["S", "E"]
    assert rs.imports == ["use crate::a::{B,C};", "use std::fmt;", "mod inner;"]
    go = parsers.go(GO)
    assert names(go.functions) == [("init", 1), ("init_2", 1), ("S::Run", 5)] and [c.name for c in go.classes] == ["S"]
    assert go.imports == ["fmt", "example.com/m/pkg/db"]
    vue = parsers.vue(VUE)
    assert [(m.name, m.line_start) for m in vue.functions] == [("go", 8)] and vue.imports == ["@/comp/a", "./b"]
    assert parsers.vue("<template/>").functions == []
    assert files.go_module("// c\nmodule example.com/m\n\ngo 1.21\n") == "example.com/m"


def test_build_store_cli_and_server(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    (repo / "pkg").mkdir(parents=True)
    (repo / "node_modules").mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(6):
        (repo / "main.py").write_text(f"from utils import f\nimport pkg\n\ndef main():\n    return {i}\n")
        (repo / "utils.py").write_text(f"def f(a):\n    if a:\n        return {i}\n")
        (repo / "pkg" / "__init__.py").write_text("x = 1\n")
        (repo / "node_modules" / "no.py").write_text("y = 1\n")
        (repo / "bad.py").write_text("def (:\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"fix bug {i}")
    store = str(tmp_path / "store")
    g = build(spark, str(repo), store, Config(Build(min_co_changes=2)))
    assert {r["id"] for r in g.nodes.collect()} == {"main.py", "utils.py", "pkg/__init__.py", "main.py::main", "utils.py::f", "bad.py", "node_modules/no.py"}  # the history has the last two
    edges = {(r["source"], r["target"], r["edge_type"]) for r in g.edges.collect()}
    assert {("main.py", "utils.py", "imports"), ("main.py", "pkg/__init__.py", "imports"), ("main.py", "utils.py", "co_changes"), ("main.py", "main.py::main", "contains"), ("main.py", "utils.py", "co_fix")} <= edges
    freq = {r["node_id"]: r["change_freq"] for r in g.change.collect()}
    assert freq["main.py"] == 6 and freq["pkg/__init__.py"] == 1
    reader = Reader(spark, store)
    assert answer(reader, "/health")[1]["total_nodes"] == 7 and answer(reader, "/nope")[0] == 404
    status, hit = answer(reader, "/impact?target=main.py")
    assert status == 200 and hit["exists"] and {d["target"] for d in hit["dependencies"]} == {"utils.py", "pkg/__init__.py", "main.py::main"}
    assert answer(reader, "/signals?min_severity=0.1")[0] == 200 and answer(reader, "/impact")[0] == 500
    assert main(["impact", "nothing.py", "--db", store], spark) == 1
    assert main(["hotspots", "--db", store, "--top", "2", "--format", "json"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines() if x.startswith("{")]
    assert lines[-1]["rank"] == 2
    for kind in ("dot", "mermaid", "json", "viz-json"):
        out = tmp_path / kind
        assert main(["export", "--format", kind, "--db", store, "--output", str(out)], spark) == 0
    assert (tmp_path / "dot").read_text().startswith("digraph") and (tmp_path / "mermaid").read_text().startswith("graph LR")
    document = json.loads((tmp_path / "viz-json").read_text())
    assert document["meta"]["file_count"] == len(document["nodes"]) == 7 and document["meta"]["repo"] == str(repo) and document["meta"]["signal_count"] == len(document["signals"])
    node = next(n for n in document["nodes"] if n["id"] == "main.py")
    assert node["language"] == "python" and node["churn_lines"] > 0 and node["file_path"] == "main.py" and {"nesting_depth", "last_changed", "fix_inducing_rate"} <= set(node)
    n, e, s = load_document(spark, str(tmp_path / "viz-json"))
    assert n.count() == 7 and e.count() == len(document["edges"]) and {r["id"] for r in n.collect()} >= {"main.py", "utils.py"}
    Store(spark, store).append(nodes=spark.createDataFrame([("main.py", 99), ("new.py", 1)], "id string, loc int"), edges=reader.edges.limit(1))
    after = Reader(spark, store)
    assert {(r["id"], r["loc"]) for r in after.nodes.collect()} >= {("main.py", 99), ("new.py", 1)} and after.nodes.count() == 8
    assert after.edges.count() == len(document["edges"]) + 1 and after.signals.count() == len(document["signals"])
    assert main(["stats", "--db", store], spark) == 0 and main(["signals", "--db", store, "--type", "ghost_coupling"], spark) == 0


def test_scripts_without_semicolons():
    def read(text):
        found = parsers.typescript(text)
        return [(m.name, m.line_start, m.line_end) for m in found.functions], [m.name for m in found.classes], found.imports

    assert read("const f = (a) => a ? 1 : 2\nexport class C { m() { if (x) {} } }\n") == ([("f", 1, 1)], ["C"], [])
    assert read("const re = /a[/]b/g\nexport function h() { return 1 }\n") == ([("h", 2, 2)], [], [])
    assert read('const r = /["]/g;\nfunction a() { return "a"; }\nfunction b() {}\n') == ([("a", 2, 2), ("b", 3, 3)], [], [])
    nested = "const s = `x ${ a ? `y ${b}` : '}' } z`\nfunction c() {}\nconst g = async () => {\n  return 4 / 2 / 1\n}\nlet k = 3\nexport const h = (x: number): string =>\n  x + 'b'\nimport { a } from './m'\n"
    assert read(nested) == ([("c", 2, 2), ("g", 3, 5), ("h", 7, 8)], [], ["./m"])
    chained = "let i = 0\ni++\nfunction z() {}\nconst t = a\n  .map(x => x)\n  .filter(Boolean)\nfunction y() {}"
    assert read(chained) == ([("z", 3, 3), ("y", 7, 7)], [], [])
    assert parsers.typescript("const f = (a) => a ? 1 : 2\nfunction g() { if (a) {} }").functions[0].complexity == 2


def test_log_of_odd_names(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for i, message in enumerate(["prefix the debug dispatch", "Fixes: commit\tnothing", "revert it", "hotfixed"]):
        for name in ("é.py", 'q"x.py', "a b.py"):
            (repo / name).write_text(f"x = {i}\n")
        git("add", "-A")
        git("commit", "-q", "-m", message)
    gitlog.write_log(str(repo), str(tmp_path / "log"))
    touches, fixes = gitlog.read_log(spark, str(tmp_path / "log"))
    assert {r["file"] for r in touches.collect()} == {"é.py", 'q"x.py', "a b.py"} and touches.count() == 12
    assert {r["seq"] for r in touches.collect()} == {0, 1, 2, 3} and fixes.count() == 9


def test_binary_index(spark, tmp_path):
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(k, value):
        return number(k << 3) + number(value) if isinstance(value, int) else number(k << 3 | 2) + number(len(value)) + value

    def seen(symbol, roles, place):
        return part(2, part(1, b"".join(number(x) for x in place)) + part(2, symbol.encode()) + part(3, roles))

    document = part(4, b"rust") + part(1, b"a.rs") + part(3, part(1, b"A") + part(5, 17) + part(6, b"shown")) + seen("A", 1, [0, 0, 300, 0]) + seen("B", 1, [2, 0, 4, 0]) + seen("A", 0, [3, 1, 5])
    (tmp_path / "index.scip").write_bytes(part(1, b"\x08\x01") + part(2, document) + part(2, part(1, b"b.rs")))
    read = symbols.read_index(spark, str(tmp_path / "index.scip"))
    assert {r["relative_path"] for r in read.collect()} == {"a.rs", "b.rs"}
    nodes, edges = symbols.load(read)
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {("A", "function"), ("B", "module")}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("B", "A")}


def test_alias_probe(spark, tmp_path):
    parsed = spark.createDataFrame([("src/x.vue", "vue", ["@/a", "./b", "lib"], None)], "file_path string, language string, imports array<string>, error string")
    assert not files.has_alias(spark, str(tmp_path))
    (tmp_path / "vite.config.ts").write_text("")
    assert files.has_alias(spark, str(tmp_path))
    assert files.resolved(parsed).first()["imports"] == ["src/a", "b", "lib"]
    assert files.resolved(parsed, alias=False).first()["imports"] == ["@/a", "b", "lib"]


def test_cli_arguments():
    a = parser().parse_args(["build", "--repo-path", "x", "--since", "1 year ago"])
    assert (a.repo_path, a.since) == ("x", "1 year ago")
    assert parser().parse_args(["serve"]).port == 3000 and parser().parse_args(["hotspots"]).top == 20


def test_symbol_index(spark):
    rows = [("a.rs", [("A", "Function"), ("B", "Function")], [("A", 1, [0, 0, 9, 0]), ("B", 1, [2, 0, 4, 0]), ("A", 0, [3, 1, 5]), ("gone", 0, [3, 1, 5])]), ("b.rs", [("C", "Class")], [("C", 1, [0, 0, 9, 9]), ("B", 0, [1, 0, 3])]), ("c.rs", [], [])]
    nodes, edges = symbols.load(spark.createDataFrame(rows, symbols.SCHEMA))
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {("A", "function"), ("B", "function"), ("C", "class")}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("B", "A"), ("C", "B")}
    lost = [("a.rs", [("A", "Function")], [("A", 1, [5, 0, 9, 0]), ("A", 0, [1, 0, 2])])]
    df = spark.createDataFrame(lost, symbols.SCHEMA)
    assert symbols.load(df, strict=False)[1].isEmpty()
    try:
        symbols.load(df)[1].collect()
        raise AssertionError("a reference outside any definition must fail")
    except Exception as e:
        assert "no definition around" in str(e)


def test_stream(spark, tmp_path):
    import datetime as dt

    rows = [("c1", 0, dt.datetime(2024, 1, 1), "a.py", 2), ("c1", 0, dt.datetime(2024, 1, 1), "a.py", 2), ("c2", 1, dt.datetime(2024, 1, 2), "a.py", 3), ("c3", 2, dt.datetime(2024, 5, 1), "b.py", 1)]
    spark.createDataFrame(rows, "commit_id string, seq long, ts timestamp_ntz, file string, churn long").write.parquet(str(tmp_path / "in"))
    query = windowed_frequencies(read_touches(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("freq").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["file"], r["change_freq"], r["churn_lines"]) for r in spark.table("freq").collect()} == {("a.py", 2, 5)}
