"""Source files as rows: discovery, filters, language, and hash."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx

LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "pyi": "python", "go": "go", "zig": "zig",
    "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "sol": "solidity", "yml": "yaml", "yaml": "yaml",
}
#: Folders that are never part of a code base's own text.
IGNORED = ("node_modules", "target", "dist", "build", "__pycache__", ".venv", "vendor")


def language(path: Column, content: Column) -> Column:
    """By extension; a .h file is C++ if its text looks like it, else C."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    header = F.when(content.rlike(r"(?m)^\s*(?:class|namespace|template)\b|\b(?:public|private):|std::"), "cpp").otherwise("c")
    return F.when(ext == "h", header).otherwise(F.try_element_at(table, ext))


def ignore_patterns(text: str) -> list[str]:
    """The lines of an ignore file as globs over relative paths; comments, blanks and negations are left out."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if line and line[0] not in "#!":
            body = line.strip("/")
            anchored = line.startswith("/") or "/" in body
            start = "" if anchored else "**/"
            out += [f"{start}{body}/**"] if line.endswith("/") else [f"{start}{body}", f"{start}{body}/**"]
    return out


def layered_ignores(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether ignore files leave a path out. rules are (folder, text) of each file, outer folders first; its lines hold below that folder.

    Of the lines that fit a path the last decides, and one that begins with ! takes it back in. A folder that is left out takes all
    below it along, so nothing in it can come back. Lines that end in a slash mean folders only; a slash elsewhere ties a line to its file's folder.
    """
    lines: list[tuple[str, bool, bool]] = []
    for folder, text in rules:
        start = "^" + (re.escape(folder.strip("/")) + "/" if folder.strip("/") else "")
        for line in map(str.strip, text.splitlines()):
            back = line.startswith("!")
            body = line.removeprefix("!").strip("/")
            if body and not line.startswith("#"):
                tied = "/" in line.removeprefix("!").rstrip("/")
                lines.append((start + ("" if tied else "(?:.*/)?") + tx.glob_regex(body)[1:], line.endswith("/"), not back))
    if not lines:
        return F.lit(False)
    parts = F.split(path, "/")
    n = F.size(parts)

    def out(i: Column) -> Column:
        at = F.array_join(F.slice(parts, F.lit(1), i), "/")
        fits = lambda pattern, only_folder: at.rlike(pattern) & (i < n) if only_folder else at.rlike(pattern)
        return F.coalesce(*[F.when(fits(p, f), F.lit(v)) for p, f, v in reversed(lines)], F.lit(False))

    return F.exists(F.sequence(F.lit(1), n), out)


def discover(spark: SparkSession, root: str, include: list[str] | None = None, ignore: list[str] | None = None, hidden: bool = False, ignore_files: list[tuple[str, str]] | None = None) -> DataFrame:
    """Spark's reader passes over names that begin with a dot or an underscore, so ignore files come as (folder, text), and files such as __init__.py are not found. (path, size_bytes, content_hash, language, content) of the text files under root, paths relative to it. Files with a NUL byte are binary and left out; content is read by the executors."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace(raw["path"], "^file:/+", "file:/")
    prefix = full.replace("file:///", "file:/").rstrip("/") + "/"
    rows = raw.select(F.substring(plain, len(prefix) + 1, 1 << 20).alias("path"), F.col("length").alias("size_bytes"), "content")
    if ignore_files:
        rows = rows.where(~layered_ignores(F.col("path"), ignore_files))
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    rows = rows.where(~F.col("path").rlike(rf"(^|/)({'|'.join(map(str, IGNORED)).replace('.', chr(92) + '.')})/"))
    if ignore:
        rows = rows.where(~tx.matches(F.col("path"), ignore))
    rows = rows.where(tx.matches(F.col("path"), include or []))
    rows = rows.where(~F.contains(F.col("content"), F.lit(b"\x00")))
    text = F.decode("content", "UTF-8")
    return rows.select("path", "size_bytes", F.sha2("content", 256).alias("content_hash"), language(F.col("path"), text).alias("language"), text.alias("content"))


def stale(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose hash the index lacks."""
    known = indexed.select(F.col("path").alias("k_path"), F.col("content_hash").alias("k_hash"))
    return found.join(known, (F.col("path") == F.col("k_path")) & (F.col("content_hash") == F.col("k_hash")), "left_anti")
