"""Operators on small hand-made graphs, tables and texts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import lexer, text as tx, vectors
from codeloom.model import CodeModel
from codeloom.operators import budget, governance, graph, links, metrics, resolve, search, similarity
from codeloom.plans.sqlsurface import Refused, Surface, render, split_statements
from codeloom.sources import extract, files, gitlog, tables

SYMBOL = "id string, file_path string, name string, qualified_name string, kind string, visibility string, brief string, line_start int, line_end int"
EDGE = "id long, source_id string, target_id string, target_name string, kind string, line int"


def make(spark, symbols, edges):
    s = [(i, p, n, f"{p}::{n}", k, "public", None, a, a + 9) for i, p, n, k, a in symbols]
    e = [(n, a, b, t, k, n) for n, (a, b, t, k) in enumerate(edges)]
    sdf = spark.createDataFrame(s, SYMBOL)
    f = sdf.groupBy(F.col("file_path").alias("path")).agg(F.lit("rust").alias("language"), F.lit(0).cast("long").alias("last_indexed"))
    return CodeModel(sdf, spark.createDataFrame(e, EDGE), f)


@pytest.fixture(scope="module")
def chain(spark):
    """main -> run -> helper -> main, and a call to a name that isn't bound."""
    return make(
        spark,
        [("m", "a.rs", "main", "function", 1), ("r", "a.rs", "run", "function", 20), ("h", "b.rs", "helper", "function", 1), ("x", "c.rs", "lonely", "struct", 1)],
        [("m", "r", "run", "calls"), ("r", "h", "helper", "calls"), ("h", "m", "main", "calls"), ("r", None, "lonely", "calls"), ("r", None, "gone", "calls")],
    )


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_depth_conventions(chain):
    assert rows(graph.call_graph(chain, "main", 3), "name", "depth") == [("helper", 3), ("run", 2)]
    assert rows(graph.call_graph(chain, "main", 4), "name", "depth") == [("helper", 3), ("main", 4), ("run", 2)]
    assert rows(graph.impact_located(chain, "helper", 2), "id", "distance") == [("m", 2), ("r", 1)]
    assert graph.has_path(chain, "main", "main", 1).first()[0] and not graph.has_path(chain, "main", "lonely").first()[0]
    assert rows(graph.callers(chain, "m", 5), "id", "distance") == [("h", 1), ("r", 2)]
    assert ("gone", False, 1) in rows(graph.deps(chain, "r", 1), "name", "resolved", "distance")


def test_metrics(chain):
    got = {r["id"]: r for r in metrics.symbol_metrics(chain).collect()}
    assert (got["r"]["fan_out"], got["r"]["fan_in"], got["r"]["complexity"]) == (3, 1, 7)
    assert metrics.stats(chain).first()["functions"] == 3


def test_or_join_splits(chain):
    got = rows(links.file_dependencies(chain), "from_file", "to_file", "call_count")
    assert got == [("a.rs", "b.rs", 1), ("a.rs", "c.rs", 1), ("a.rs", "external", 1), ("b.rs", "a.rs", 1)]
    plan = links.full_call_graph(chain)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pagerank(spark, chain):
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(chain).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and abs(ranks["m"] - ranks["h"]) < 1e-4
    hub = make(spark, [(c, "f", c, "function", i) for i, c in enumerate("abcd")], [("a", "d", "d", "calls"), ("b", "d", "d", "calls"), ("c", "d", "d", "calls")])
    r = graph.pagerank(hub)
    assert max(r.collect(), key=lambda x: x["rank"])["id"] == "d"
    assert abs(sum(x["rank"] for x in graph.focus(hub, r, ["a"]).collect()) - 1) < 1e-9


def test_resolution(spark):
    m = make(spark, [("1", "a", "f", "function", 1), ("2", "b", "g", "function", 1), ("3", "a", "g", "function", 9), ("4", "c", "g", "function", 1)], [("1", None, "f", "calls"), ("1", None, "g", "calls"), ("4", None, "nope", "calls")])
    assert [r["target_id"] for r in resolve.resolve(m.edges, m.symbols).orderBy("id").collect()] == ["1", "3", None]


def test_intervals(spark, chain):
    changed = spark.createDataFrame([("a.rs", 10, 12), ("a.rs", 29, 40)], "file_path string, first int, last int")
    assert rows(links.overlapping(chain.symbols, changed), "id") == [("m",), ("r",)]
    at = spark.createDataFrame([("a.rs", 1), ("a.rs", 15), ("b.rs", 4)], "file_path string, line int")
    assert {(r["line"], r["symbol_id"]) for r in links.symbol_at(chain.symbols, at).collect()} == {(1, "m"), (15, None), (4, "h")}


def test_similarity(spark):
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (3, base), (4, " ".join(f"z{i}" for i in range(80))), (5, "short"), (6, None)], "doc_id long, text string")
    exact = similarity.exact_pairs(similarity.folded(similarity.shingled(docs, "doc_id", "text")))
    assert rows(exact, "a", "b") == [(1, 2)] == rows(similarity.near_duplicates(docs, "doc_id", "text"), "a", "b")
    assert lexer.tokens('fn a(x: i32) { return "s" + 1; } // c') == lexer.tokens("fn b(y: i32) { return 'q' + 22; }")


def test_lsh_recall_in_a_large_group(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    variants = [" ".join("edited" + str(rng.random()) if i in gone else w for i, w in enumerate(base)) for gone in ({rng.randrange(300) for _ in range(2)} for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")
    exact = {(r["a"], r["b"]): r["similarity"] for r in similarity.exact_pairs(similarity.folded(similarity.shingled(docs, "doc_id", "text"))).collect()}
    found = {(r["a"], r["b"]): r["similarity"] for r in similarity.near_duplicates(docs, "doc_id", "text").collect()}
    assert len(exact) > 20000 and len(found) >= 0.98 * len(exact)
    assert all(found[p] == exact[p] for p in found)


def test_search(spark, chain):
    assert [r["name"] for r in search.find_symbols(chain.symbols, "RUN").collect()] == ["run"]
    assert search.find_symbols(chain.symbols, "%").count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, vector array<double>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "vector")
    assert [r["vec_id"] for r in search.top_k(v, q, "cosine", 2).orderBy("rank").collect()] == [2, 3]


def test_budget(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 60), ("g", 3, 30)], "g string, i int, c long")
    assert rows(budget.stop_greedy(df, ["i"], "c", 100, by=["g"]), "i") == [(1,)]
    assert rows(budget.skip_greedy(df, ["i"], "c", 100, "g"), "i") == [(1,), (3,)]


def test_rules(chain):
    r = governance.Rules.parse('[layers]\nlow = ["a.rs"]\ntop = ["b*"]\n[[forbidden]]\nfrom = "low"\nto = "top"\n[[no_new_dependents]]\npaths = ["b.rs"]')
    assert rows(governance.check(chain, r), "rule", "subject", "object") == [("forbidden", "a.rs", "b.rs"), ("no_new_dependents", "a.rs", "b.rs")]
    for bad in ('[[forbidden]]\nfrom = "x"\nto = "y"', "version = 2", "other = 1"):
        with pytest.raises(governance.RuleError):
            governance.Rules.parse(bad)
    with pytest.raises(governance.RuleError):
        governance.Rules.parse('[layers]\na = ["a.rs"]\nb = ["*.rs"]').layered(chain.files)


def test_score_and_hotspots(spark, chain):
    changed = chain.files.select("path")
    assert {**governance.score(chain, chain, changed).first().asDict(), "files_changed": 0} == dict.fromkeys(governance.METRICS, 0)
    none = type(chain)(chain.symbols.limit(0), chain.edges.limit(0), chain.files.limit(0))
    one = governance.score(none, chain, changed, violations=changed.limit(1)).first().asDict()
    n = chain.symbols.select("file_path", "name").distinct().count()
    calls = chain.calls().count()
    assert (one["symbols_added"], one["symbols_removed"], one["fan_out_delta"], one["check_violations"], one["files_changed"]) == (n, 0, calls, 1, changed.count())
    back = governance.score(chain, none, changed).first().asDict()
    assert back["symbols_removed"] == n and back["complexity_delta"] == -one["complexity_delta"] < 0
    assert [r["failed"] for r in governance.gate(governance.score(none, chain, changed), "symbols_added >= 4, fan_out_delta > 99").collect()] == [n >= 4, False]
    with pytest.raises(governance.RuleError):
        governance.parse_conditions("lines > 3")
    hot = spark.createDataFrame([("both", 9, 9), ("complex", 2, 10), ("churned", 10, 1), ("calm", 1, 99)], "path string, churn long, complexity long")
    got = governance.hotspots(hot, ["path"]).collect()
    assert got[0]["path"] == "both" and len(got) == 3
    assert {r["category"] for r in governance.audit(chain).collect()} == {*governance.WEIGHTS, "overall"}


def _audited(spark, names, kind="function", calls=()):
    """A model of symbols in one file a name, and calls (source, target name) that nothing resolves."""
    from codeloom.model import CodeModel

    s = spark.createDataFrame([(str(i), f"f{i}", n, n, kind, "public", "doc" if i % 2 else None) for i, n in enumerate(names)], "id string, file_path string, name string, qualified_name string, kind string, visibility string, brief string")
    e = spark.createDataFrame([(i, a, None, b, "calls", 1) for i, (a, b) in enumerate(calls)], "id long, source_id string, target_id string, target_name string, kind string, line int")
    return CodeModel(s, e, spark.createDataFrame([(f"f{i}", "rust") for i in range(len(names))], "path string, language string"))


def test_audit_ladders(spark):
    """Scores by hand."""
    fan = lambda n: [("0", f"x{i}") for i in range(n)]
    for n, want in ((0, 10.0), (20, 10.0), (21, 7.9), (31, 5.8), (51, 3.5)):
        assert round(governance.audit_complexity(_audited(spark, ["a_fn"], calls=fan(n))).first()["score"], 6) == want
    m = _audited(spark, [f"work_{i}" for i in range(4)] + ["go1", "go2", "go3"])
    assert [tuple(r) for r in governance.audit_duplication(m).collect()] == [("work", 4)]
    assert governance.audit_coverage(m).first()["score"] == 4.0 and governance.audit_coverage(_audited(spark, [])).first()["score"] == 10.0
    assert governance.audit_modularity(m).first()["score"] == 9.0 and governance.audit_modularity(_audited(spark, ["a_fn"], calls=fan(2))).first()["score"] == 5.0
    named = lambda names, kind: sorted((r["name"], r["suggestion"]) for r in governance.audit_naming(_audited(spark, names, kind)).collect())
    assert named(["ok_1", "_private", "BadName", ""], "function") == [("BadName", "bad_name")]
    assert named(["Good", "T_1", "bad_type", "A_b_c"], "struct") == [("A_b_c", "ABC"), ("bad_type", "BadType")]
    assert named(["MAX", "lower_ok", "Mixed"], "constant") == [("Mixed", "MIXED")] and named(["whatEver"], "trait") == []
    total = {r["category"]: r["score"] for r in governance.audit(m).collect()}
    assert round(total["overall"], 6) == round(sum(total[k] * w for k, w in governance.WEIGHTS.items()), 6) and total["duplication"] == 8.0


def test_resolution_passes(spark):
    s = spark.createDataFrame(
        [("1", "a.rs", "run", "A::run", "function"), ("2", "b/mod.rs", "run", "B::run", "function"), ("3", "b/mod.rs", "only", "B::only", "function"), ("4", "a.rs", "new", "A::new", "method"), ("5", "c.rs", "new", "C::new", "method"), ("6", "a.rs", "caller", "A::caller", "function")],
        "id string, file_path string, name string, qualified_name string, kind string",
    )
    files = spark.createDataFrame([("a.rs", "rust"), ("b/mod.rs", "rust"), ("c.rs", "rust")], "path string, language string")
    item = resolve.ITEM
    e = [
        (1, "6", None, "run", "uses", item + "crate::b::run"), (2, "6", None, "run", "uses", item + "run"), (3, "6", None, "MAX", "uses", item + "MAX"), (4, "6", None, "run", "calls", "A::run"), (5, "6", None, "run", "calls", "x = B::run(1)"),
        (6, "6", None, "only", "calls", None), (7, "6", None, "new", "calls", "new()"), (8, "6", None, "new", "calls", "Box::new()"), (9, "6", None, "new", "calls", "v.new()"), (10, "6", None, "gone", "calls", None), (11, "6", "5", "new", "calls", None), (12, "6", None, "only", "uses", item + "only"),
    ]
    got = {r["id"]: (r["target_id"], r["resolved_by"]) for r in resolve.resolve(spark.createDataFrame(e, "id long, source_id string, target_id string, target_name string, kind string, context string"), s, files).collect()}
    assert got == {1: ("2", 0), 2: (None, None), 4: ("1", 1), 5: ("2", 2), 6: ("3", 3), 7: ("4", 4), 8: (None, None), 9: (None, None), 10: (None, None), 11: ("5", None), 12: ("3", 0)}


def test_sql_surface(chain):
    s = Surface(chain, cap=2)
    columns, got, cut = s.run("SELECT name FROM v1.symbols ORDER BY name")
    assert columns == ["name"] and [r[0] for r in got] == ["helper", "lonely"] and cut
    assert s.run("CREATE TEMP TABLE t AS SELECT 1 AS a; SELECT a FROM t")[1] == [(1,)]
    assert split_statements("SELECT ';' -- a;b\n; /* ; */ SELECT 2") == ["SELECT ';'", "SELECT 2"]
    for bad in ("DROP VIEW v1_symbols", "SET a=1", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "INSERT INTO t VALUES (1)", ""):
        with pytest.raises(Refused):
            s.frame(bad)
    assert "∅" in render(["a"], [(None,)]) and render(["a"], [(1,)], "csv").split() == ["a", "1"]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("d", None)], "path string, content_hash string")
    assert rows(tables.changes(old, new), "path", "change") == [("a", "same"), ("b", "changed"), ("c", "added"), ("d", "same")]
    assert rows(tables.upserted(old, new.where("path = 'b'"), ["path"]), "path")[1] == ("b",)
    shots = tables.Snapshots(spark, str(tmp_path / "snap"))
    assert not shots.any() and shots.write("s1", "2024-01-01", {"files": old}) and not shots.write("s1", "2024-01-01", {"files": old})
    assert shots.backfill([("s1", "2024-01-01"), ("s2", "2024-01-02")], lambda sha: {"files": new}) == {"s1": "skipped", "s2": "written"}
    assert shots.read("files").groupBy("commit_sha").count().count() == 2
    tables.append_gate_log(spark, str(tmp_path / "log"), {"gate": "score", "outcome": "pass", "metrics": {"symbols": 1}})
    assert tables.read_gate_log(spark, str(tmp_path / "log")).first()["outcome"] == "pass"
    with pytest.raises(ValueError):
        tables.guard_scope(old.limit(0), old)


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text('class C(B):\n    """Doc. More."""\n    def run(self):\n        helper(1)\n\ndef helper(x):\n    return x\n')
    (tmp_path / "src/b.rs").write_text("/// adds\npub fn add(a: i32) -> i32 {\n    sub(a)\n}\nfn sub(a: i32) -> i32 { a }\n")
    (tmp_path / "src/h.h").write_text("namespace x {}\n")
    (tmp_path / "src/bin.py").write_bytes(b"a\0b")
    (tmp_path / ".hidden.py").write_text("x = 1")
    found = files.discover(spark, str(tmp_path)).cache()
    assert rows(found, "path", "language") == [("src/a.py", "python"), ("src/b.rs", "rust"), ("src/h.h", "cpp")]
    assert files.stale(found, found).count() == 0
    s, e = extract.symbols(found), extract.edges(found)
    assert {("run", "method"), ("C", "class"), ("add", "function")} <= {(r["name"], r["kind"]) for r in s.collect()}
    assert {("helper", "calls"), ("B", "extends"), ("sub", "calls")} <= {(r["target_name"], r["kind"]) for r in e.collect()}
    bound = resolve.resolve(e, s)
    assert bound.where("target_name = 'helper'").first()["target_id"] == "src/a.py::helper@6"


def test_git(spark):
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert rows(gitlog.name_only(lines("a", "", "a", "b")), "path", "churn") == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, gitlog.name_status(lines("M\ta", "R100\told\tnew", "")).collect()), key=str) == [("modified", "a", None), ("renamed", "new", "old")]
    h = lines("@@ -1,2 +3,4 @@ x", "@@ -1 +9 @@", "@@ -1,2 +3,0 @@").withColumn("file_path", F.lit("f"))
    assert rows(gitlog.hunks(h), "first", "last") == [(3, 6), (9, 9)]
    assert rows(gitlog.numstat(lines("1\t2\ta", "-\t-\tb")), "path", "added", "deleted") == [("a", 1, 2), ("b", 0, 0)]


def test_map_and_explain(spark, chain):
    from codeloom.operators import context

    ranks = chain.symbols.select("id", F.lit(0.5).alias("rank"))
    rows_ = context.ranked_map(chain, ranks, 1000).orderBy("place").collect()
    assert len(rows_) == chain.symbols.where(F.col("kind").isin(*context.MAP_KINDS)).count() and context.ranked_map(chain, ranks, 0).count() == 0
    whole = context.render_map(context.ranked_map(chain, ranks, 1000))
    # Any budget gives the longest prefix that fits, counted on the text itself.
    for tokens in range(1, len(whole) // 4 + 2):
        got = context.render_map(context.ranked_map(chain, ranks, tokens)) if tokens % 7 == 0 else None
        assert got is None or (len(got) <= 4 * tokens and whole.startswith(got))
    assert context.render_map(context.ranked_map(chain, ranks, 1000), markdown=True).startswith("## ")
    name = chain.symbols.first()["name"]
    assert {r["relation"] for r in context.explain(chain, name).collect()} >= {"self"}
    assert context.focus_ids(chain, "a.rs").count() and context.focus_ids(chain, "*.rs").count() == chain.symbols.count() and context.focus_ids(chain, name).count()


def test_structures(spark, tmp_path):
    from codeloom.operators import context

    body = "def {f}({a}):\n    total = 0\n    for {b} in range({a}):\n        if {b} % 2 == 0:\n            total += {b} * {n}\n        else:\n            total -= {b}\n    return [total, {a}, '{f}', total * 2, total + {n}]\n"
    (tmp_path / "x.py").write_text(body.format(f="one", a="n", b="i", n=3) + "\n\n" + body.format(f="two", a="count", b="k", n=77).replace("total -=", "total +=") + "\n\ndef small():\n    return 1\n")
    found = files.discover(spark, str(tmp_path)).cache()
    s = extract.symbols(found)
    source = {r["name"]: r["source"] for r in context.source_of(found, s).collect()}
    assert source["small"] == "def small():\n    return 1" and source["two"].startswith("def two(count):")
    got = context.duplicate_functions(found, s, threshold=0.6).collect()
    assert len(got) == 1 and 0.6 <= got[0]["similarity"] < 1 and {got[0]["a"].split("::")[1][:3], got[0]["b"].split("::")[1][:3]} == {"one", "two"}
    assert context.structures(found, s).count() == 2


def test_text():
    assert tx.glob_like("src/**/*.rs") == "src/%%.rs" and tx.normalise_path("a/./b/../c") == "a/c"
    assert tx.query_terms("Find the parse_file X") == ["parse_file"]


def test_queries_have_names_and_oracles():
    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(sql) > 60


def widest(df):
    """The most rows that an operator of df's plan made."""
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(p.plan())
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined():
            yield rows.get().value()
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def shared_names(spark):
    """300 functions of one name in two files, each with an open call of that name."""
    return make(spark, [(str(i), "ab"[i % 2], "run", "function", i) for i in range(300)], [(str(i), None, "run", "calls") for i in range(300)])


def test_call_graph_of_shared_names(spark):
    m = shared_names(spark)
    got = links.full_call_graph(m)
    assert rows(got, "caller", "caller_file", "callee", "callee_file") == [("run", x, "run", y) for x in "ab" for y in "ab"]
    assert widest(got) < 2000


def test_resolution_of_shared_names(spark):
    m = shared_names(spark)
    text = F.element_at(F.array(*map(F.lit, ["a::run", "x = a::run(1)", "run("])), (F.col("id") % 3 + 1).cast("int"))
    item = F.when(F.col("id") % 4 == 0, F.concat(F.lit(resolve.ITEM), F.lit("b::run"))).otherwise(text)
    edges = m.edges.withColumn("context", item).withColumn("kind", F.when(F.col("id") % 4 == 0, "uses").otherwise("calls"))
    one = spark.createDataFrame([("one", "c", "run", "c::run", "function")], "id string, file_path string, name string, qualified_name string, kind string")
    more = edges.where("id = 1").withColumn("id", F.lit(1000).cast("long")).withColumn("context", F.lit("y = c::run()"))
    symbols = m.symbols.select("id", "file_path", "name", "qualified_name", "kind").unionByName(one)
    files = symbols.select(F.col("file_path").alias("path"), F.lit("rust").alias("language")).distinct()
    got = resolve.resolve(edges.unionByName(more), symbols, files)
    assert [(r["id"], r["target_id"], r["resolved_by"]) for r in got.collect() if r["target_id"]] == [(1000, "one", 2)]
    assert got.count() == 301 and widest(got) < 2000


@pytest.mark.parametrize("measure", ["cosine", "l2", "dot"])
def test_search_is_exact(spark, measure):
    """Against all pairs, with copies, ties, zero vectors and odd rows."""
    rng = random.Random(5)
    made = [[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(150)] + [[1.0, 0.0, 2.0, -1.0]] * 150 + [[0.0] * 4] * 4 + [[1.0, 2.0], None, [1.0, None, 0.0, 2.0], [1e160, 0.0, 0.0, 0.0]]
    v = spark.createDataFrame(list(enumerate(made)), "vec_id long, vector array<double>").repartition(3)
    q = v.where("vec_id % 7 = 0 or vec_id > 300").select(F.col("vec_id").alias("query_id"), "vector")
    score = {"cosine": vectors.cosine, "dot": vectors.dot, "l2": vectors.l2}[measure](F.col("q"), F.col("v"))
    pairs = q.withColumnRenamed("vector", "q").crossJoin(v.withColumnRenamed("vector", "v")).where("vec_id <> query_id").select("query_id", "vec_id", score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("score") if measure == "l2" else F.desc_nulls_last("score"), "vec_id")
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("query_id", "rank", "vec_id", "score").collect()
    got = search.top_k(v, q, measure, 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert widest(got) < 10000


def test_sums_in_the_order_of_events(spark, tmp_path):
    """Sums of doubles that a half of rounding tells apart don't depend on files."""
    values = [0.1, 0.3, 0.7, 1.4]  # 2.5 in this order, and less from the end
    total = back = 0.0
    for x in values:
        total += x
    for x in reversed(values):
        back += x
    assert (total >= 2.5) != (back >= 2.5)
    rows_ = [(i, x) for i, x in enumerate(values)][::-1]
    e = spark.createDataFrame([(9, 0.1), *rows_], "event_id long, value double").selectExpr("event_id", "timestamp'2024-01-01 10:00:00' AS ts", "if(event_id = 9, 2L, 1L) AS user_id", "'view' AS event_type", "value")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    from codeloom.plans.queries import QUERIES

    assert [r["mass"] for r in QUERIES["trend_hotspot_mass"](spark, str(tmp_path)).collect()] == [3 if total >= 2.5 else 2]


def test_shingles_in_arrow(spark):
    """Hashes are those of the column expression, at every length of a run, and sets are folded by their digests."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcé漢𝄞") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts = [" \t".join(rng.choice(words) for _ in range(n)) + "\n\x0b\u00a0x" for n in range(0, 120, 3)] + ["a b c d e", "", " ", None, " ".join(["q"] * 70), "q " * 70, "z" * 3000 + " b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    want = docs.select("doc_id", F.size(tokens).alias("n"), F.sort_array(tx.shingles(tokens)).alias("s"))
    sets = similarity.shingled(docs, "doc_id", "text", 5, 0)
    assert rows(sets, "key", "n_tokens", "shingles") == rows(want, "doc_id", "n", "s")
    assert {r["key"]: r["copies"] for r in similarity.folded(sets.where("n_tokens >= 60")).collect()}[len(texts) - 3] == 2
    assert rows(similarity.digests(docs, "doc_id", "text", 5, 0), "key", "digest") == rows(sets, "key", "digest")
