"""Short questions to the base relations. Those that give rows in an order sort them last, so a limit on top stays a top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.model import DECLARATIONS, CodeModel


def symbol(m: CodeModel, key: str) -> DataFrame:
    return m.symbols.where(F.col("id") == key)


def symbols_of_file(m: CodeModel, path: str) -> DataFrame:
    return m.symbols.where(F.col("file_path") == path).orderBy("line_start", "id")


def declarations(m: CodeModel) -> DataFrame:
    """Symbols that a map may list."""
    return m.symbols.where(F.col("kind").isin(*DECLARATIONS))


def indexed_files(m: CodeModel) -> DataFrame:
    return m.files.select("path", "size_bytes").orderBy("path")


def symbol_ids(m: CodeModel, path: str | None = None, name: str | None = None) -> DataFrame:
    """Ids in order: all, or those of a file, or of a name, or of both."""
    rows = m.symbols if path is None else m.symbols.where(F.col("file_path") == path)
    return (rows if name is None else rows.where(F.col("name") == name)).select("id").orderBy("id")


def calls_of_file(m: CodeModel, path: str) -> DataFrame:
    """(id, source_id, target_name) of the calls in one file, as they were inserted."""
    inside = m.symbols.where(F.col("file_path") == path).select(F.col("id").alias("source_id"))
    return m.calls().join(inside, "source_id", "left_semi").select("id", "source_id", "target_name").orderBy("id")


def counts(m: CodeModel, ranks: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """(relation, n) of what there is; relations not given count as 0."""
    none = m.symbols.limit(0)
    sides = {"symbols": m.symbols, "ranks": none if ranks is None else ranks, "embeddings": none if embeddings is None else embeddings}
    out = None
    for name, rows in sides.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def embedded_symbols(m: CodeModel, embeddings: DataFrame) -> DataFrame:
    """Symbols with their embeddings; those of symbols that are gone are left out."""
    return m.symbols.join(embeddings.withColumnRenamed("symbol_id", "id"), "id")


def nearest_symbols(m: CodeModel, nearest: DataFrame) -> DataFrame:
    """A search's rows (query_id, rank, vec_id, score) with name, kind and file of what was found; the few rows come first, so the symbols are met once."""
    found = nearest.withColumn("id", F.col("vec_id").cast("string"))
    return found.join(m.symbols.select("id", "name", "kind", "file_path"), "id").select("query_id", "rank", "id", "name", "kind", "file_path", "score")


def fingerprints(prints: DataFrame, min_tokens: int = 50) -> DataFrame:
    return prints.where(F.col("token_count") >= min_tokens).orderBy("symbol_id")


def key_changes(before: CodeModel, now: CodeModel) -> DataFrame:
    """(change, file_path, parent_id, name) of symbols that were added or removed; null parents are equal, and overloads are one key."""
    keys = ["file_path", "parent_id", "name"]

    def own(m: CodeModel) -> DataFrame:
        s = m.symbols if "parent_id" in m.symbols.columns else m.symbols.withColumn("parent_id", F.lit(None).cast("string"))
        return s.select(*keys)

    side = lambda name, a, b: own(a).subtract(own(b)).select(F.lit(name).alias("change"), *keys)
    return side("added", now, before).unionByName(side("removed", before, now))


def layer_counts(files: DataFrame, layered: DataFrame) -> DataFrame:
    """(layer, n) of the files in each layer (path, layer); those in none count under null."""
    return files.select("path").join(layered, "path", "left").groupBy("layer").agg(F.count("*").alias("n"))


def filtered_graph(pairs: DataFrame, terms: str | None, source: str = "from_file", target: str = "to_file") -> DataFrame:
    """Rows of which either file holds one of the comma-separated terms; no terms keep all."""
    if terms is None:
        return pairs
    keep = F.lit(False)
    for t in (t.strip() for t in terms.split(",")):
        keep = keep | F.contains(F.col(source), F.lit(t)) | F.contains(F.col(target), F.lit(t))
    return pairs.where(keep)


def files_within(contents: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """(files, chars, tokens): totals of contents (path, content) that fit the patterns."""
    rows = contents.where(tx.matches(F.col("path"), patterns or []))
    text = F.coalesce("content", F.lit(""))
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.coalesce(F.sum(tx.token_estimate(text)), F.lit(0)).alias("tokens"))
