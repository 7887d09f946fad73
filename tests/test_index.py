"""Imports, lookups, revisions, the index of files, and renderers on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.model import CodeModel
from codeloom.operators import governance, graph, imports, links, lookup, revision
from codeloom.plans import report
from codeloom.sources import extract, files, index, tables

PATHS = (
    "src/lib.rs src/a/mod.rs src/a/b.rs src/c.rs web/app.ts web/ui/index.tsx web/x.js pkg/__init__.py pkg/m.py pkg/sub/n.py src/tool/z.py go/util/b.go go/util/a.go "
    "inc/deep/h.h inc/main.c other/deep/k.h x/k.h t/token.sol z/a.zig z/b.zig"
).split()
CASES = [
    ("src/a/b.rs", "crate::c::Item", "src/c.rs"), ("src/a/b.rs", "super::Thing", "src/a/mod.rs"), ("src/a/b.rs", "super::super::c", "src/c.rs"), ("src/a/mod.rs", "self::b::X", "src/a/b.rs"),
    ("src/c.rs", "crate::Item", "src/lib.rs"), ("src/c.rs", "std::io", None), ("src/c.rs", "superb::io", None), ("web/app.ts", "./ui", "web/ui/index.tsx"), ("web/ui/index.tsx", "../x", "web/x.js"),
    ("web/app.ts", "react", None), ("web/app.ts", "../../x", None), ("pkg/m.py", ".", "pkg/__init__.py"), ("pkg/sub/n.py", "..m", "pkg/m.py"), ("pkg/m.py", "pkg.sub.n", "pkg/sub/n.py"),
    ("pkg/m.py", "tool.z", "src/tool/z.py"), ("pkg/m.py", "os", None), ("go/main.go", "example.com/p/util", "go/util/a.go"), ("go/main.go", "fmt", None), ("inc/main.c", "deep/h.h", "inc/deep/h.h"),
    ("x/y.c", "main.c", "inc/main.c"), ("inc/main.c", "k.h", None), ("inc/main.c", "<inc/main.c>", "inc/main.c"), ("inc/main.c", "<h.h>", None), ("inc/main.c", "/k.h", None),
    ("inc/main.c", "deep/k.h", "other/deep/k.h"), ("t/x.sol", "./token", "t/token.sol"), ("z/a.zig", "b.zig", "z/b.zig"), ("z/a.zig", "std", None), (None, "x", None), ("a.md", "x", None),
    ("pkg/m.py", None, None), ("pkg/m.py", "", None), ("src/c.rs", "", None), ("go/a.go", "", None),
]


def test_imports_by_language(spark):
    asked = spark.createDataFrame([c[:2] for c in CASES] * 2, "file_path string, spec string")
    got = {(r[0], r[1]): r[2] for r in imports.resolve_imports(asked, spark.createDataFrame([(p,) for p in PATHS + PATHS[:3]], "path string")).collect()}
    assert got == {c[:2]: c[2] for c in CASES if c[2]}
    assert imports.resolve_imports(asked, spark.createDataFrame([], "path string")).count() == 0
    plan = imports.resolve_imports(asked, spark.createDataFrame([(p,) for p in PATHS], "path string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unreadable_imports_are_skipped(spark):
    m = spark.createDataFrame([("a.py", '[{"from":"b","names":["x"]},{"names":[]}]'), ("b.py", "not json"), ("c.py", None), ("d.py", "[]")], "file_path string, imports string")
    assert [tuple(r) for r in imports.file_imports(m).collect()] == [("a.py", "b")]


def small(spark):
    s = [("m", "a.rs", "main", "a::main", "function", 1, 9), ("r", "a.rs", "run", "a::run", "function", 20, 29), ("h", "b.rs", "helper", "b::helper", "function", 1, 9), ("q", "c.rs", "quit", "c::quit", "method", 1, 9)]
    sdf = spark.createDataFrame(s, "id string, file_path string, name string, qualified_name string, kind string, line_start int, line_end int").withColumn("visibility", F.lit("public")).withColumn("brief", F.lit(None).cast("string"))
    e = spark.createDataFrame([(1, "m", "r", "run", "calls", 2), (2, "r", "h", "helper", "calls", 21), (3, "h", "q", "quit", "calls", 3), (4, "q", None, "b", "imports", 1)], "id long, source_id string, target_id string, target_name string, kind string, line int")
    f = spark.createDataFrame([(p, "rust", 0) for p in ("a.rs", "b.rs", "c.rs")], "path string, language string, last_indexed long")
    return CodeModel(sdf, e, f)


def test_files_around_a_revision(spark):
    m = small(spark)
    changed = spark.createDataFrame([("b.rs", "modified"), ("gone.rs", "deleted")], "path string, change string")
    ranges = spark.createDataFrame([("b.rs", 4, 4), ("gone.rs", 1, 9)], "file_path string, first int, last int")
    got = {r["path"]: (round(r["priority"], 6), r["reason"]) for r in revision.context(m, changed, ranges).collect()}
    assert got == {"b.rs": (1.0, "modified"), "a.rs": (0.8, "calls a change"), "c.rs": (0.3, "called by a change")}
    assert [r["path"] for r in revision.context(m, changed, ranges, changes_only=True).collect()] == ["b.rs"]
    assert {r["path"] for r in revision.context(m, changed, ranges, patterns=["a.rs"]).collect()} == {"b.rs", "a.rs"}
    status = spark.createDataFrame([("renamed", "new.rs", "old.rs"), ("added", "x.rs", None)], "change string, path string, old_path string")
    assert [r["path"] for r in revision.changed_files(status, ranges, patterns=["old.rs"]).collect()] == ["new.rs"]


def test_cascade_unbinds(spark):
    m = small(spark)
    ranks = spark.createDataFrame([("m", 0.5), ("h", 0.5)], "symbol_id string, rank double")
    left = tables.cascade(m.files, m.symbols, m.edges, {"ranks": ranks}, spark.createDataFrame([("b.rs",)], "path string"))
    assert {r["id"] for r in left["symbols"].collect()} == {"m", "r", "q"} and [r[0] for r in left["ranks"].collect()] == ["m"]
    assert {(r["id"], r["target_id"]) for r in left["edges"].collect()} == {(1, "r"), (2, None), (4, None)}
    e = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", "y", None), ("d", None, None)], "symbol_id string, provider string, model string")
    assert [r[0] for r in tables.without_embeddings(e, "x", "1").collect()] == ["b", "c", "d"] and tables.without_embeddings(e, "x").count() == 2


def test_imports_reach_the_rules(spark):
    m = small(spark)
    asked = spark.createDataFrame([("c.rs", [("crate::x",)])], "file_path string, imports array<struct<from:string>>")
    fs = spark.createDataFrame([("src/x.rs",), ("c.rs",)], "path string")
    assert [tuple(r) for r in imports.imported_files(m.symbols, m.edges, fs, asked).collect()] == [("c.rs", "src/x.rs")]
    found = imports.imported_files(m.symbols, m.edges, fs, asked)
    rules = governance.Rules.parse('[layers]\nlow = ["c.rs"]\nhigh = ["src"]\n[[forbidden]]\nfrom = "low"\nto = "high"\n')
    assert rules and found.count() == 1
    whole = CodeModel(m.symbols, m.edges, m.files.unionByName(fs.withColumn("language", F.lit("rust")).withColumn("last_indexed", F.lit(0).cast("long")).where("path <> 'c.rs'")))
    assert [(r["subject"], r["object"]) for r in governance.check(whole, rules, imports=found).collect()] == [("c.rs", "src/x.rs")]


def test_index_follows_its_files(spark, tmp_path):
    src, at = tmp_path / "src", str(tmp_path / "index")
    (src / "p").mkdir(parents=True)
    (src / "p/a.py").write_text("def one():\n    return two()\n")
    (src / "p/b.py").write_text("def two():\n    return 1\n")
    x = index.Index(spark, at)
    assert x.update(files.discover(spark, str(src)), 1) == {"added": 2, "changed": 0, "removed": 0, "same": 0, "failed": 0}
    assert x.read("edges").first()["target_id"] == "p/b.py::two@1"
    x.ranks.store(spark.createDataFrame([("p/a.py::one@1", 0.5), ("p/b.py::two@1", 0.5)], "id string, rank double"))
    assert x.ranks.load(2).count() == 2 and x.ranks.load(3) is None
    assert x.update(files.discover(spark, str(src)), 2)["same"] == 2 and x.ranks.load(2) is not None
    (src / "p/b.py").write_text("def three(:\n")
    (src / "p/c.py").write_text("def two():\n    return 3\n")
    again = index.Index(spark, at)  # an index is what its folder holds
    assert again.update(files.discover(spark, str(src)), 3) == {"added": 1, "changed": 1, "removed": 0, "same": 1, "failed": 1}
    assert again.read("edges").first()["target_id"] == "p/c.py::two@1" and again.ranks.load(2) is None
    assert again.update(files.discover(spark, str(src)), 4, ["p/b.py"])["changed"] == 1  # it failed, so it is tried again
    (src / "p/a.py").write_text("from p.c import two\nimport os\n\ndef one():\n    return two()\n")
    again.update(files.discover(spark, str(src)), 4, ["p/a.py"])
    assert [tuple(r) for r in again.imported_files().collect()] == [("p/a.py", "p/c.py")]
    (src / "p/b.py").unlink()
    assert again.update(files.discover(spark, str(src)), 5)["removed"] == 1
    assert {r["path"] for r in again.read("files").collect()} == {"p/a.py", "p/c.py"}
    with pytest.raises(ValueError):
        again.update(files.discover(spark, str(src)).where("false"), 6)


def test_what_files_import():
    of = extract.imports
    assert of("python", "import a.b, c\nfrom . import d\nfrom ..e import f\nfrom g import *\n") == ["a.b", "c", ".", ".d", "..e", "..e.f", "g"] and of("python", "def (") == []
    assert of("rust", "use crate::a::B;\npub use super::{x, y};\n// use z;\n") == ["crate::a::B", "super"]
    assert of("typescript", "import x from './a'\nimport './b'\nconst c = require(\"../c\")\nexport * from 'd'\n") == ["./a", "./b", "../c", "d"]
    assert of("go", 'package m\nimport "fmt"\nimport (\n\t"a/b"\n\tq "c/d"\n)\n') == ["fmt", "a/b", "c/d"]
    assert of("c", '#include "a.h"\n# include <b/c.h>\n') == ["a.h", "<b/c.h>"] and of(None, "x") == []
    assert of("zig", 'const s = @import("std");') == ["std"] and of("solidity", 'import {A} from "./a.sol";\nimport "./b.sol";') == ["./a.sol", "./b.sol"]


def test_evidence_of_callers(spark):
    rows = [("run(1)", "run", "run"), ("x.run(1)", "run", "run"), ("x -> run()", "run", "run"), ("a::run()", "run", "run"), ("x.run(run())", "run", "run"), (None, "run", "run"), ("T::run()", "run", "T::run"), ("run()", "run", "T::run"), (None, "run", "T::run")]
    df = spark.createDataFrame(rows, "c string, n string, q string")
    got = [r[0] for r in df.select(graph.evidence(F.col("c"), F.col("n"), F.col("q"))).collect()]
    assert got == [True, False, False, False, True, True, True, False, False]


def test_one_symbol_or_which(spark):
    m = small(spark)
    twice = CodeModel(m.symbols.unionByName(m.symbols.where("id = 'm'").withColumn("id", F.lit("m2")).withColumn("file_path", F.lit("z.rs"))), m.edges, m.files)
    assert graph.one_symbol(twice, "m") == "m" and graph.one_symbol(twice, "run") == "r" and graph.one_symbol(twice, "main", ["z.rs"]) == "m2"
    with pytest.raises(graph.Ambiguous) as e:
        graph.one_symbol(twice, "main")
    assert e.value.found == [("m", "a.rs"), ("m2", "z.rs")]
    with pytest.raises(LookupError):
        graph.one_symbol(twice, "nobody")


def test_rules_refuse_what_they_do_not_know():
    good = governance.Rules.parse('version = 1\n[layers]\na = ["a"]\nb = ["b"]\n[[rules.forbidden]]\nfrom = "a"\nto = "b"\nreason = "no"\n')
    assert good.forbidden == [{"from": "a", "to": "b", "reason": "no"}]
    for bad in ('[[rules.limit]]\nmetric = "fan_out"\nmax = 1\nmin = 2\n', '[[rules.limit]]\nmetric = "size"\nmax = 1\n', '[[rules.limit]]\nmetric = "fan_out"\n', "[rules]\nother = 1\n"):
        with pytest.raises(governance.RuleError):
            governance.Rules.parse(bad)


def test_renderers(spark):
    m = small(spark)
    deps = links.file_dependencies(m)
    text = "\n".join(report.lines(report.file_graph(deps, "dot")))
    assert text.startswith("digraph dependencies {") and text.endswith("}") and '"a.rs" -> "b.rs" [penwidth=1];' in text
    assert sum(json.loads(t)["type"] == "edge" for t in report.lines(report.file_graph(deps, "json"))) == 2
    assert sorted(report.lines(report.call_graph(links.full_call_graph(m), "mermaid")))[:3] == ["  helper[helper] --> quit[quit]", "  main[main] --> run[run]", "  run[run] --> helper[helper]"]
    with pytest.raises(ValueError):
        report.file_graph(deps, "png")
    d = spark.createDataFrame([("a/b.py", " x<1 & '\"\n\n"), ("c", None), (None, "z")], "path string, content string")
    assert "x&lt;1 &amp; '\"\n</file>" in "\n".join(report.lines(report.documents(d, "xml")))
    assert json.loads(list(report.lines(report.documents(d, "json")))[0]) == {"name": "b.py", "path": "/a/b.py", "content": "x<1 & '\""}
    assert report.documents(d.limit(0), "plain").count() == 0
    assert report.tree("r", []) == "r/\n(empty)\n"
    assert report.tree("r", [("a/b.py", 3), ("a/c/d.py", 4), ("z", None)]) == "r/\na/\n├── b.py (3 B)\n└── c/\n    └── d.py (4 B)\nz\n"
    assert report.shortened("aaaa\nbbbb\ncccc\n", 14) == "… (+3 more)\n" and report.shortened("ab\n", 3) == "ab\n" and report.shortened("abc\n", 2) == ""
    assert json.loads(report.audit(m, "json"))["scores"]["overall"] > 0 and "symbols" in report.stats(m)


def test_ignore_files_nest(spark):
    rules = [("", "*.log\n!keep.log\ngen/\n# note\n/top.py\n"), ("a", "!x.log\nsub/z.py\n")]
    names = "x.log keep.log gen/b.py gen/keep.log top.py a/top.py a/x.log a/y.log a/sub/z.py a/deep/sub/z.py a/gen".split()
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r[0] for r in paths.where(~files.layered_ignores(F.col("path"), rules)).collect()}
    assert got == {"keep.log", "a/top.py", "a/x.log", "a/deep/sub/z.py", "a/gen"}
    assert paths.where(files.layered_ignores(F.col("path"), [])).count() == 0


def test_lookups_of_nothing(spark):
    m = small(spark)
    assert lookup.symbol(m, "nope").count() == 0 and [r[0] for r in lookup.symbol_ids(m, "a.rs").collect()] == ["m", "r"]
    assert lookup.key_changes(m, m).count() == 0 and lookup.filtered_graph(links.file_dependencies(m), None).count() == 2
    assert lookup.files_within(spark.createDataFrame([], "path string, content string")).first().asDict() == {"files": 0, "chars": 0, "tokens": 0}
