"""Results as text: graphs, trees, files, audits and counts.

Graphs and files become rows of text (section, place, text), so they can be written by executors whatever their size; `lines` reads
them in order, a partition at a time. Trees, audits and counts are short, and are strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.model import CodeModel
from codeloom.operators import governance, lookup, metrics

EXTERNAL = "external"
FORMATS = ("dot", "mermaid", "json", "text")
DOCUMENTS = ("xml", "markdown", "plain", "json")


def _short(c: str) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def _quoted(c: Column) -> Column:
    """A string of DOT: backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _fixed(df: DataFrame, section: int, *texts: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(section, f"{i:04d}", t) for i, t in enumerate(texts)], "section int, place string, text string")


def _rows(df: DataFrame, section: int, place: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), place.alias("place"), text.alias("text"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _known(form: str, forms: tuple[str, ...]) -> None:
    if form not in forms:
        raise ValueError(f"unknown format: {form}; known are {', '.join(forms)}")


def file_graph(deps: DataFrame, form: str = "text") -> DataFrame:
    """Dependencies (from_file, to_file, call_count) as DOT, Mermaid, lines of JSON, or text. Only text shows what is external; a line's width grows with the root of its calls."""
    _known(form, FORMATS)
    pair = F.concat_ws("\t", "from_file", "to_file")
    if form == "text":
        return _rows(deps, 1, pair, F.format_string("%s -> %s (%d calls)", "from_file", "to_file", "call_count"))
    inner = deps.where(F.col("to_file") != EXTERNAL)
    nodes = deps.select(F.col("from_file").alias("node")).union(deps.select("to_file")).where(F.col("node") != EXTERNAL).distinct()
    if form == "json":
        return _all(
            _rows(nodes, 1, F.col("node"), F.to_json(F.struct(F.lit("node").alias("type"), F.col("node").alias("file")))),
            _rows(inner, 2, pair, F.to_json(F.struct(F.lit("edge").alias("type"), F.col("from_file").alias("source"), F.col("to_file").alias("target"), F.col("call_count").alias("weight")))),
        )
    if form == "mermaid":
        name = lambda c: F.concat(F.lit("f"), F.substring(F.sha2(c, 256), 1, 12), F.lit('["'), F.replace(_short(c), F.lit('"'), F.lit("#quot;")), F.lit('"]'))
        return _all(_fixed(deps, 0, "graph LR"), _rows(inner, 1, pair, F.concat(F.lit("  "), name("from_file"), F.lit(" --> "), name("to_file"))))
    width = F.greatest(F.ceil(F.sqrt("call_count")), F.lit(1)).cast("string")
    return _all(
        _fixed(deps, 0, "digraph dependencies {", "  rankdir=LR;", "  node [shape=box];"),
        _rows(nodes, 1, F.col("node"), F.concat(F.lit("  "), _quoted(F.col("node")), F.lit(" [label="), _quoted(_short("node")), F.lit("];"))),
        _rows(inner, 2, pair, F.concat(F.lit("  "), _quoted(F.col("from_file")), F.lit(" -> "), _quoted(F.col("to_file")), F.lit(" [penwidth="), width, F.lit("];"))),
        _fixed(deps, 3, "}"),
    )


def call_graph(calls: DataFrame, form: str = "text") -> DataFrame:
    """Calls (caller, caller_file, callee, callee_file) in the same forms. In DOT, files are clusters whose lines follow one another."""
    _known(form, FORMATS)
    pair = F.concat_ws("\t", "caller_file", "caller", "callee_file", "callee")
    ends = calls.select(F.col("caller_file").alias("file"), F.col("caller").alias("name")).union(calls.select("callee_file", "callee")).distinct()
    if form == "text":
        return _rows(calls, 1, pair, F.format_string("%s (%s) -> %s (%s)", "caller", "caller_file", "callee", "callee_file"))
    if form == "json":
        return _all(
            _rows(ends, 1, F.concat_ws("\t", "file", "name"), F.to_json(F.struct(F.lit("node").alias("type"), "name", "file"))),
            _rows(calls, 2, pair, F.to_json(F.struct(F.lit("edge").alias("type"), F.col("caller").alias("source"), F.col("callee").alias("target")))),
        )
    if form == "mermaid":
        name = lambda c: F.concat(F.replace(F.col(c), F.lit("::"), F.lit("_")), F.lit("["), F.col(c), F.lit("]"))
        return _all(_fixed(calls, 0, "graph LR"), _rows(calls, 1, pair, F.concat(F.lit("  "), name("caller"), F.lit(" --> "), name("callee"))))
    key = F.substring(F.sha2("file", 256), 1, 12)
    files = ends.select("file").distinct()
    opened = F.concat(F.lit("  subgraph cluster_"), key, F.lit(" { label="), _quoted(_short("file")), F.lit("; style=filled; color=lightgrey;"))
    return _all(
        _fixed(calls, 0, "digraph call_graph {", "  rankdir=LR;", "  node [shape=ellipse];"),
        _rows(files, 1, F.concat_ws("\t", "file", F.lit("0")), opened),
        _rows(ends, 1, F.concat_ws("\t", "file", F.lit("1"), "name"), F.concat(F.lit("    "), _quoted(F.col("name")), F.lit(";"))),
        _rows(files, 1, F.concat_ws("\t", "file", F.lit("2")), F.lit("  }")),
        _rows(calls, 2, pair, F.concat(F.lit("  "), _quoted(F.col("caller")), F.lit(" -> "), _quoted(F.col("callee")), F.lit(";"))),
        _fixed(calls, 3, "}"),
    )


def _escaped(c: Column, attribute: bool = False) -> Column:
    for sign, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&apos;")] if attribute else []):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def documents(contents: DataFrame, form: str = "xml", tree: str | None = None) -> DataFrame:
    """Files (path, content) as one text in order of paths: XML, markdown, plain, or a JSON object a line. A null content is empty; outer white space goes. Each file is a row that one task makes."""
    _known(form, DOCUMENTS)
    path, body = F.col("path"), F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+\z", "")
    shown = F.concat(F.lit("/"), F.ltrim(path, F.lit("/")))
    if form == "xml":
        text = F.concat(F.lit('<file name="'), _escaped(_short("path"), True), F.lit('" path="'), _escaped(shown, True), F.lit('">\n'), _escaped(body), F.lit("\n</file>"))
        low = (tree or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        start = ["<context>"] + ([f"<project_tree>\n{low}</project_tree>"] if tree is not None else []) + ["<project_files>"]
        end = ["</project_files>", "</context>"]
    elif form == "markdown":
        fence = F.when(F.contains(body, F.lit("```")), F.lit("````")).otherwise(F.lit("```"))
        text = F.concat(F.lit("## "), shown, F.lit("\n\n"), fence, F.regexp_extract("path", r"\.([^./]+)$", 1), F.lit("\n"), body, F.lit("\n"), fence, F.lit("\n"))
        start, end = ["# Project Context\n"] + ([f"## Project Tree\n\n```\n{tree}```\n"] if tree is not None else []), []
    elif form == "plain":
        text = F.concat(F.lit("=== "), shown, F.lit(" ===\n\n"), body, F.lit("\n"))
        start, end = ([f"=== PROJECT TREE ===\n\n{tree}"] if tree is not None else []), []
    else:
        text = F.to_json(F.struct(_short("path").alias("name"), shown.alias("path"), body.alias("content")))
        start, end = ([json.dumps({"type": "tree", "content": tree}, ensure_ascii=False)] if tree is not None else []), []
    parts = [_rows(contents.where(path.isNotNull()), 1, path, text)]
    return _all(*([_fixed(contents, 0, *start)] if start else []), *parts, *([_fixed(contents, 2, *end)] if end else []))


def lines(rows: DataFrame) -> Iterator[str]:
    """The texts in order; the driver holds a partition at a time."""
    for r in rows.orderBy("section", "place", "text").select("text").toLocalIterator():
        yield r[0]


def tree(root: str, entries: list[tuple[str, int | None]]) -> str:
    """A drawing of paths, with sizes where there are any. For folded lists (metrics.tree_collapse), which are short; a path that ends in a slash is a folder."""
    if not entries:
        return f"{root}/\n(empty)\n"
    top: dict = {}
    for path, size in entries:
        at = top
        *above, last = path.strip("/").split("/")
        for part in above:
            at = at.setdefault(part + "/", {})
        if path.endswith("/"):
            at.setdefault(last + "/", {})
        else:
            at[last] = size
    out = [f"{root}/"]

    def draw(node: dict, before: str, first: bool) -> None:
        names = sorted(node, key=lambda n: n.rstrip("/"))
        for i, name in enumerate(names):
            final, child = i == len(names) - 1, node[name]
            mark = "" if first else "└── " if final else "├── "
            out.append(f"{before}{mark}{name}" + (f" ({child} B)" if isinstance(child, int) else ""))
            if isinstance(child, dict):
                draw(child, before if first else before + ("    " if final else "│   "), False)

    draw(top, "", True)
    return "\n".join(out) + "\n"


def shortened(text: str, chars: int) -> str:
    """text if it fits, else as many of its first lines as fit with a note of how many are gone; nothing if not even the note fits."""
    if len(text) <= chars:
        return text
    rows = text.splitlines()
    used, best = 0, ""
    for kept in range(len(rows)):
        note = f"… (+{len(rows) - kept} more)\n"
        if used + len(note) <= chars:
            best = "".join(r + "\n" for r in rows[:kept]) + note
        used += len(rows[kept]) + 1
    return best


def audit(m: CodeModel, form: str = "text") -> str:
    """The audit's five categories and the whole, as text, markdown or JSON."""
    _known(form, ("text", "markdown", "json"))
    rows = sorted(((r["category"], round(r["score"], 1)) for r in governance.audit(m).collect()), key=lambda r: (r[0] == "overall", r[0]))
    if form == "json":
        return json.dumps({"scores": dict(rows)}, indent=2)
    if form == "markdown":
        return "# Audit\n\n| Category | Score |\n|-|-|\n" + "".join(f"| {c} | {s:.1f} |\n" for c, s in rows)
    return "Audit\n" + "".join(f"  {c:<12} {s:4.1f} / 10\n" for c, s in rows)


def stats(m: CodeModel, limit: int = 10) -> str:
    """Counts of a code base, and its most connected functions."""
    total = metrics.stats(m).first().asDict()
    out = ["Codebase"] + [f"  {k:<10} {v}" for k, v in total.items()] + ["Most connected"]
    return "\n".join(out + [f"  {r['name']} ({r['file_path']}): {r['fan_in']} in, {r['fan_out']} out" for r in metrics.most_connected(m, limit).collect()]) + "\n"


def budget(selected: DataFrame, omitted: int, total: int) -> str:
    """A dry run: what a selection (path, tokens) would hold. It fits a budget, so the driver holds it."""
    rows = selected.orderBy("path").collect()
    head = f"{len(rows)} files, {total} tokens" + (f"; {omitted} left out" if omitted else "")
    return head + "\n" + "".join(f"  {r['path']} ({r['tokens']})\n" for r in rows)


def layers(files: DataFrame, rules: governance.Rules) -> str:
    """How many files each layer has; rules name few layers."""
    found = {r["layer"]: r["n"] for r in lookup.layer_counts(files, rules.layered(files)).collect()}
    rows = [(name, found.get(name, 0)) for name in sorted(rules.layers)] + [("(none)", found.get(None, 0))]
    return "".join(f"{name}: {n} files\n" for name, n in rows)
