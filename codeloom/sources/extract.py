"""Symbols and call edges of source files. Python is parsed; other languages are read by patterns, which see declarations and calls but not scopes, so their spans end where the next declaration begins."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.ship import ship

SYMBOL = "id string, file_path string, name string, qualified_name string, kind string, visibility string, brief string, line_start int, line_end int, parent_name string"
EDGE = "source_id string, target_name string, kind string, line int, context string, file_path string"

_DECLARE = {
    "rust": r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?P<kw>fn|struct|enum|trait|mod)\s+(?P<name>\w+)",
    "go": r"(?P<kw>func|type)\s+(?:\([^)]*\)\s*)?(?P<name>\w+)",
    "typescript": r"(?P<pub>export\s+)?(?:default\s+|async\s+|abstract\s+)*(?P<kw>function|class|interface|enum|type)\s+(?P<name>\w+)",
    "javascript": r"(?P<pub>export\s+)?(?:default\s+|async\s+)*(?P<kw>function|class)\s+(?P<name>\w+)",
    "zig": r"(?P<pub>pub\s+)?(?P<kw>fn)\s+(?P<name>\w+)",
    "solidity": r"(?P<kw>contract|interface|library|function|modifier|event|struct|enum)\s+(?P<name>\w+)[^;{]*?(?P<pub>\bpublic\b|\bexternal\b)?",
    "c": r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s\*]*?\b(?P<name>\w+)\s*\([^;{]*\)\s*\{",
    "cpp": r"(?:(?P<kw>class|struct|enum|namespace)\s+(?P<name>\w+))",
}
_KIND = {"fn": "function", "func": "function", "function": "function", "modifier": "function", "type": "type", "mod": "module", "namespace": "module", "contract": "class", "library": "class"}
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NO_CALL = frozenset("if for while switch return match catch fn func function sizeof print assert elif and or not in with def class".split())


def _python(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    symbols, edges = [], []
    lines = source.splitlines()

    def visit(node: ast.AST, parents: list[str], owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parents and isinstance(node, ast.ClassDef) else "function"
                parent = parents[-1] if parents else None
                sid = f"{path}::{parent + '::' if parent else ''}{child.name}@{child.lineno}"
                doc = (ast.get_docstring(child) or "").strip().split("\n")[0] or None
                symbols.append((sid, path, child.name, ".".join([*parents, child.name]), kind, "private" if child.name.startswith("_") else "public", doc, child.lineno, child.end_lineno, parent))
                if isinstance(child, ast.ClassDef):
                    edges.extend((sid, b.id, "extends", child.lineno, None, path) for b in child.bases if isinstance(b, ast.Name))
                visit(child, [*parents, child.name], sid)
            else:
                if owner and isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        edges.append((owner, name, "calls", child.lineno, lines[child.lineno - 1].strip()[:80], path))
                visit(child, parents, owner)

    visit(ast.parse(source), [], None)
    return symbols, edges


def _patterns(path: str, language: str, source: str) -> tuple[list[tuple], list[tuple]]:
    found = []
    for m in re.finditer(_DECLARE[language], source, re.MULTILINE):
        groups = m.groupdict()
        line = source.count("\n", 0, m.start("name")) + 1
        public = bool(groups.get("pub")) or (language == "go" and m["name"][0].isupper()) or language in ("c", "cpp")
        found.append((line, m["name"], _KIND.get(groups.get("kw") or "fn", groups.get("kw")), public))
    lines = source.splitlines()
    symbols, edges = [], []
    for i, (line, name, kind, public) in enumerate(found):
        end = found[i + 1][0] - 1 if i + 1 < len(found) else len(lines)
        sid = f"{path}::{name}@{line}"
        above = lines[line - 2].strip() if line > 1 else ""
        brief = above.lstrip("/*# ").strip() if above.startswith(("//", "/*", "#")) else None
        symbols.append((sid, path, name, name, kind, "public" if public else "private", brief or None, line, max(line, end), None))
        if kind == "function":
            for n in range(line, end + 1):
                body = lines[n - 1]
                edges.extend((sid, c, "calls", n, body.strip()[:80], path) for c in _CALL.findall(body) if c not in _NO_CALL and not (n == line and c == name))
    return symbols, edges


def broken(language: str | None, source: str) -> bool:
    """Whether a file of a parsed language can't be parsed, as while it is being edited."""
    if language != "python":
        return False
    try:
        ast.parse(source)
    except (SyntaxError, ValueError):
        return True
    return False


def parse(path: str, language: str | None, source: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and edges of one file; a file that doesn't parse, or of another language, has none."""
    if language == "python":
        try:
            return _python(path, source)
        except (SyntaxError, ValueError):
            return [], []
    return _patterns(path, language, source) if language in _DECLARE else ([], [])


def _map(which: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, lang, s in zip(b["path"], b["language"], b["content"], strict=True) for r in parse(p, lang, s or "")[which]]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content)."""
    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInPandas(_map(0, _names(SYMBOL)), SYMBOL)


def edges(files: DataFrame) -> DataFrame:
    """Edges of files; targets are names, for operators.resolve to bind."""
    ship(files.sparkSession)
    raw = files.select("path", "language", "content").mapInPandas(_map(1, _names(EDGE)), EDGE)
    key = F.xxhash64("source_id", "target_name", "line", "context", "kind")
    return raw.withColumn("id", key).withColumn("target_id", F.lit(None).cast("string"))


#: How a file of each language names others; a pattern's first group that fits is the specifier.
_IMPORT = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)",
    "typescript": r"(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*['\"]([^'\"\n]+)['\"]",
    "go": r"^(?:import\s+|\s+)(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$",
    "zig": r"@import\(\"([^\"\n]+)\"\)",
    "solidity": r"^\s*import\b[^;'\"]*['\"]([^'\"\n]+)['\"]",
    "c": r"^\s*#\s*include\s*(?:\"([^\"\n]+)\"|(<[^>\n]+>))",
}
_IMPORT |= {"javascript": _IMPORT["typescript"], "cpp": _IMPORT["c"]}


def imports(language: str | None, source: str) -> list[str]:
    """What a file imports, as it is written there, in order and without repeats; of a Rust group its common start."""
    if language == "python":
        try:
            nodes = list(ast.walk(ast.parse(source)))
        except (SyntaxError, ValueError):
            return []
        found = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
        for n in nodes:
            if isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                # A name may be a module of the package, so it is asked for too.
                found += [base] + [f"{base}{'' if base.endswith('.') else '.'}{a.name}" for a in n.names if a.name != "*"]
    elif language in _IMPORT:
        found = [next(g for g in m.groups() if g).rstrip(":") for m in re.finditer(_IMPORT[language], source, re.MULTILINE)]
    else:
        return []
    return list(dict.fromkeys(found))


#: Rows of all kinds, and of files that don't parse, by one parse of each file.
RECORD = f"path string, failed boolean, symbol struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>, edge struct<{EDGE.replace(' ', ':').replace(',:', ',')}>, spec string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = lambda text: pa.struct([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in text.split(", ")])
    schema = pa.schema([("path", pa.string()), ("failed", pa.bool_()), ("symbol", kind(SYMBOL)), ("edge", kind(EDGE)), ("spec", pa.string())])
    named = lambda text, row: dict(zip(_names(text), row, strict=True))
    for b in batches:
        for r in b.to_pylist():
            text = r["content"] or ""
            s, e = parse(r["path"], r["language"], text)
            rows = [{"path": r["path"], "failed": broken(r["language"], text)}]
            rows += [{"path": r["path"], "failed": False, "symbol": named(SYMBOL, x)} for x in s] + [{"path": r["path"], "failed": False, "edge": named(EDGE, x)} for x in e]
            rows += [{"path": r["path"], "failed": False, "spec": x} for x in imports(r["language"], text)]
            yield pa.RecordBatch.from_pylist(rows, schema)


def records(files: DataFrame) -> DataFrame:
    """(path, failed, symbol, edge, spec) of files (path, language, content): a row for the file, then one for each symbol, edge or import. Write it before reading either kind, and each file is parsed once."""
    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(_records, RECORD)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """The symbols, or the edges as edges() gives them, of records."""
    found = rows.where(F.col(kind).isNotNull()).select(f"{kind}.*")
    if kind == "symbol":
        return found
    return found.withColumn("id", F.xxhash64("source_id", "target_name", "line", "context", "kind")).withColumn("target_id", F.lit(None).cast("string"))
