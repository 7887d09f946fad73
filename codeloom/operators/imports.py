"""Imports as edges between files: each specifier becomes an ordered list of keys, and one join finds the first that a file answers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which rule an importing file follows, by its extension, and what may be added to a relative specifier.
RULES = {
    "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "sol": "contract", "zig": "zig", "rs": "rust", "py": "python", "go": "go",
    "c": "include", "h": "include", "cc": "include", "cpp": "include", "cxx": "include", "hh": "include", "hpp": "include", "hxx": "include", "ipp": "include", "tpp": "include",
}
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
CONTRACT_ENDINGS = ("", ".sol")
#: Files that stand for the folder they are in.
RUST_ROOTS = ("mod.rs", "lib.rs", "main.rs")
#: What a key names: a whole path, the end of just one path, or the end of a Go package's folder.
PATH, TAIL, PACKAGE = "path", "tail", "package"
_KEYS = "array<struct<space:string,key:string>>"


def folder(path: Column) -> Column:
    """What is before a path's last slash; empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _joined(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))


def normal(path: Column) -> Column:
    """path without empty, '.' and '..' steps; null if it leaves the root or nothing is left."""
    step = lambda done, s: F.when(s == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"), step)
    return F.when(F.size(kept) > 0, F.array_join(kept, "/"))


def _climbed(path: Column, steps: Column) -> Column:
    """path without its last `steps` parts; empty beyond the root."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - steps, F.lit(0))), "/")


def _keys(space: str, paths: Column) -> Column:
    return F.transform(F.filter(paths, lambda p: p.isNotNull()), lambda p: F.struct(F.lit(space).alias("space"), p.alias("key"))).cast(_KEYS)


def _parts(text: Column, mark: str) -> Column:
    return F.filter(F.split(text, mark), lambda s: s != "")


def _counted_down(n: Column, of) -> Column:
    """[of(n), ..., of(1)]; empty for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), of)).otherwise(F.array())


def _relative(spec: Column, beside: Column, endings: tuple[str, ...]) -> Column:
    found = F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(beside, e))
    return _keys(PATH, F.when(spec.startswith("./") | spec.startswith("../"), found).otherwise(F.array().cast("array<string>")))


def _include(spec: Column, beside: Column) -> Column:
    angle = F.regexp_extract(spec, "^<(.*)>$", 1)
    whole = normal(spec)
    quoted = F.concat(_keys(PATH, F.array(beside, whole)), _keys(TAIL, F.array(whole)))
    refused = spec.startswith("/") | F.contains(spec, F.lit("\\"))
    return F.when(spec.rlike("^<.*>$"), _keys(PATH, F.array(angle))).when(refused, F.array().cast(_KEYS)).otherwise(quoted)


def _rust(path: Column, spec: Column) -> Column:
    """Parts of the specifier are dropped from its end, as the last ones may be items; then comes the file of the module it starts from."""
    parts = _parts(spec, "::")
    own = F.when(F.regexp_extract(path, "([^/]*)$", 1).isin(*RUST_ROOTS), folder(path)).otherwise(F.regexp_replace(path, r"\.rs$", ""))
    up = F.ceil(F.length(F.regexp_extract(F.array_join(parts, "::"), "^((?:super(?:::|$))*)", 1)) / 7).cast("int")
    head = F.get(parts, F.lit(0))
    base = F.when(head == "crate", F.lit("src")).when(head == "self", own).when(head == "super", _climbed(own, up))
    rest = F.slice(parts, F.greatest(up, F.lit(1)) + 1, F.size(parts))
    both = lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")))
    inner = F.flatten(_counted_down(F.size(rest), lambda k: both(_joined(base, F.array_join(F.slice(rest, F.lit(1), k), "/")))))
    itself = F.when(base != "", F.array(F.concat(base, F.lit("/mod.rs")), F.concat(base, F.lit(".rs")))).otherwise(F.array().cast("array<string>"))
    root = F.when(base == "src", F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))).otherwise(F.array().cast("array<string>"))
    return F.when(base.isNull(), F.array().cast(_KEYS)).otherwise(_keys(PATH, F.concat(inner.cast("array<string>"), itself, root)))


def _python(path: Column, spec: Column) -> Column:
    """One dot is the file's own package, each more one above it; without dots, from the root and from src/."""
    both = lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    at = _climbed(folder(path), F.greatest(dots - 1, F.lit(0)))
    name = F.array_join(_parts(spec, r"\."), "/")
    package = F.when(at != "", F.array(F.concat(at, F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>"))
    plain = F.translate(spec, ".", "/")
    return _keys(PATH, F.when(dots == 0, F.concat(both(plain), both(F.concat(F.lit("src/"), plain)))).when(name == "", package).otherwise(both(_joined(at, name))))


def _go(spec: Column) -> Column:
    """The longest end of the import path that is the end of a package's folder."""
    parts = _parts(spec, "/")
    n = F.size(parts)
    return _keys(PACKAGE, _counted_down(n, lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/")).cast("array<string>"))


def keys(path: Column, spec: Column) -> Column:
    """What a specifier may mean, best first; nothing where the language or the form is unknown."""
    extension = F.regexp_extract(path, r"\.([^./]*)$", 1)
    rule = F.try_element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), extension)
    beside = normal(F.concat(folder(path), F.lit("/"), spec))
    one = F.when(spec.endswith(".zig"), F.array(beside)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(rule == "script", _relative(spec, beside, SCRIPT_ENDINGS)).when(rule == "contract", _relative(spec, beside, CONTRACT_ENDINGS)).when(rule == "zig", _keys(PATH, one))
        .when(rule == "include", _include(spec, beside)).when(rule == "rust", _rust(path, spec)).when(rule == "python", _python(path, spec)).when(rule == "go", _go(spec)).otherwise(F.array().cast(_KEYS))
    )


def _ends(path: Column, first: int) -> Column:
    """The ends of a path at its slashes: from its whole (first = 1), or from its second part on (first = 2)."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n >= first, F.transform(F.sequence(F.lit(first), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array())


def targets(files: DataFrame) -> DataFrame:
    """(space, key, to_file): each path; each end of a path that no other path has; and each end of a folder with Go files, for its first file. As many rows as the paths have parts."""
    paths = files.select("path").where(F.col("path").isNotNull()).distinct()
    whole = paths.select(F.lit(PATH).alias("space"), F.col("path").alias("key"), F.col("path").alias("to_file"))
    tails = paths.select(F.explode(_ends(F.col("path"), 2)).alias("key"), "path").groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("to_file")).where("n = 1").select(F.lit(TAIL).alias("space"), "key", "to_file")
    go = paths.where(F.col("path").endswith(".go") & F.contains("path", F.lit("/")))
    packages = go.select(F.explode(_ends(folder(F.col("path")), 1)).alias("key"), "path").groupBy("key").agg(F.min("path").alias("to_file")).select(F.lit(PACKAGE).alias("space"), "key", "to_file")
    return whole.unionByName(tails).unionByName(packages)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file, spec, to_file) of imports (file_path, spec) that mean one of files (path); those of other code, and null ones, are left out.

    Equal imports are one row. A key has one target, so the join gives no more rows than there are keys; the best one is kept by a partial aggregate.
    """
    asked = imports.select(F.col("file_path").alias("from_file"), "spec").where(F.col("from_file").isNotNull() & F.col("spec").isNotNull()).distinct()
    tried = asked.select("from_file", "spec", F.posexplode(keys(F.col("from_file"), F.col("spec"))).alias("place", "k")).select("from_file", "spec", "place", "k.space", "k.key")
    hit = tried.join(targets(files), ["space", "key"])
    return hit.groupBy("from_file", "spec").agg(F.min_by("to_file", "place").alias("to_file"))


def file_imports(modules: DataFrame) -> DataFrame:
    """(file_path, spec) of modules (file_path, imports as JSON or as an array of structs); empty and unreadable ones have none."""
    raw = F.col("imports")
    if dict(modules.dtypes)["imports"] == "string":
        raw = F.from_json(raw, "array<struct<from:string>>")
    return modules.select("file_path", F.explode(raw).alias("i")).select("file_path", F.col("i")["from"].alias("spec")).where(F.col("spec").isNotNull())


def import_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "imports")


def module_name(path: Column, index_names: tuple[str, ...]) -> Column:
    """A file's name without its extension; for index files the folder's name, null at the root."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    above = F.nullif(F.regexp_extract(folder(path), "([^/]*)$", 1), F.lit(""))
    return F.when(stem.isin(*index_names), above).otherwise(F.nullif(stem, F.lit("")))


def imported_files(symbols: DataFrame, edges: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(from_file, to_file) for governance.check: what modules and import edges without a target name, where that is a file."""
    at = symbols.select(F.col("id").alias("source_id"), "file_path")
    asked = import_edges(edges).where(F.col("target_id").isNull()).join(at, "source_id").select("file_path", F.col("target_name").alias("spec"))
    asked = asked if modules is None else asked.unionByName(file_imports(modules))
    return resolve_imports(asked, files).select("from_file", "to_file").where(F.col("from_file") != F.col("to_file")).distinct()
