"""Edges joined with their symbols, and joins that Spark would otherwise plan as nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.model import CodeModel


def with_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with t_id, t_name and t_file of the resolved target, or else of every symbol with the target's name (null if none). The two cases are disjoint, so the OR in the join condition becomes two equi-joins."""
    t = symbols.select(F.col("id").alias("t_id"), F.col("name").alias("t_name"), F.col("file_path").alias("t_file"))
    resolved = edges.where(F.col("target_id").isNotNull()).join(t, F.col("target_id") == F.col("t_id"), "left")
    named = edges.where(F.col("target_id").isNull()).join(t, F.col("target_name") == F.col("t_name"), "left")
    return resolved.unionByName(named)


def with_source(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    s = symbols.select(F.col("id").alias("source_id"), F.col("name").alias("s_name"), F.col("file_path").alias("s_file"))
    return edges.join(s, "source_id")


def _grouped_calls(m: CodeModel) -> DataFrame:
    """Calls folded to (source, target id, target name, n): the name join then multiplies distinct edges, not every call."""
    return m.calls().groupBy("source_id", "target_id", "target_name").agg(F.count("*").alias("n"))


def file_dependencies(m: CodeModel) -> DataFrame:
    """Calls between files; targets that no symbol matches are in the file 'external'. Calls are folded by source file, and symbols by name and file, before names join, so shared names multiply files and not symbols."""
    calls = with_source(_grouped_calls(m), m.symbols).groupBy("s_file", "target_id", "target_name").agg(F.sum("n").alias("n"))
    ids = m.symbols.select(F.col("id").alias("target_id"), F.col("file_path").alias("t_file"), F.lit(1).cast("long").alias("k"))
    names = m.symbols.groupBy(F.col("name").alias("target_name"), F.col("file_path").alias("t_file")).agg(F.count("*").alias("k"))
    resolved = calls.where(F.col("target_id").isNotNull()).join(ids, "target_id", "left")
    named = calls.where(F.col("target_id").isNull()).join(names, "target_name", "left")
    both = resolved.unionByName(named).withColumn("to_file", F.coalesce("t_file", F.lit("external"))).where(F.col("s_file") != F.col("to_file"))
    return both.groupBy(F.col("s_file").alias("from_file"), "to_file").agg(F.sum(F.col("n") * F.coalesce("k", F.lit(1))).alias("call_count"))


def full_call_graph(m: CodeModel) -> DataFrame:
    """Distinct calls by names and files of both ends. Calls are folded by the caller's name and file, and symbols by name and file, before names join: each row of that join is one of the result."""
    calls = with_source(m.calls(), m.symbols).select("s_name", "s_file", "target_id", "target_name")
    ids = m.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file_path").alias("t_file"))
    names = m.symbols.select(F.col("name").alias("target_name"), F.col("name").alias("t_name"), F.col("file_path").alias("t_file")).distinct()
    resolved = calls.where(F.col("target_id").isNotNull()).join(ids, "target_id", "left").drop("target_id")
    named = calls.where(F.col("target_id").isNull()).drop("target_id").distinct().join(names, "target_name", "left")
    both = resolved.unionByName(named)
    return both.select(F.col("s_name").alias("caller"), F.col("s_file").alias("caller_file"), F.coalesce("t_name", "target_name").alias("callee"), F.coalesce("t_file", F.lit("external")).alias("callee_file")).distinct()


def recursive_functions(m: CodeModel) -> DataFrame:
    """Symbols with a call to themselves: by id, or by name where the target is unresolved."""
    own = with_source(m.calls(), m.symbols)
    same = (F.col("target_id") == F.col("source_id")) | (F.col("target_id").isNull() & (F.col("target_name") == F.col("s_name")))
    return own.where(same).select(F.col("source_id").alias("id"), F.col("s_name").alias("name"), F.col("s_file").alias("file_path")).distinct()


def cross_file(m: CodeModel) -> DataFrame:
    """Resolved edges between different files."""
    t = m.symbols.select(F.col("id").alias("target_id"), F.col("file_path").alias("t_file"))
    joined = with_source(m.edges.where(F.col("target_id").isNotNull()), m.symbols).join(t, "target_id")
    return joined.where(F.col("s_file") != F.col("t_file")).groupBy(F.col("s_file").alias("from_file"), F.col("t_file").alias("to_file"), "kind").agg(F.count("*").alias("n"))


def without_embedding(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    return symbols.join(embeddings.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def overlapping(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols that a changed range (file_path, first, last) of their file touches."""
    r = ranges.select(F.col("file_path").alias("r_file"), "first", "last")
    return symbols.join(r, (F.col("file_path") == F.col("r_file")) & (F.col("line_start") <= F.col("last")) & (F.col("first") <= F.col("line_end")), "left_semi")


def symbol_at(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """points (file_path, line) with symbol_id: the symbol that begins on the line, else the innermost around it (shortest, then latest start, then id); null if none."""
    s = symbols.select(F.col("file_path").alias("s_file"), F.col("id").alias("symbol_id"), "line_start", "line_end")
    hit = points.join(s, (F.col("file_path") == F.col("s_file")) & F.col("line").between(F.col("line_start"), F.col("line_end")), "left")
    order = Window.partitionBy("file_path", "line").orderBy((F.col("line_start") == F.col("line")).cast("int").desc(), F.col("line_end") - F.col("line_start"), F.desc("line_start"), "symbol_id")
    return hit.withColumn("place", F.row_number().over(order)).where(F.col("place") == 1).select("file_path", "line", "symbol_id")


def outgoing(m: CodeModel, symbol: str) -> DataFrame:
    return m.edges.where(F.col("source_id") == symbol)


def incoming(m: CodeModel, symbol: str) -> DataFrame:
    return m.edges.where((F.col("target_id") == symbol) | (F.col("target_name") == symbol))


def unresolved(m: CodeModel) -> DataFrame:
    at = m.symbols.select(F.col("id").alias("source_id"), "file_path")
    return m.edges.where(F.col("target_id").isNull() & F.col("line").isNotNull()).join(at, "source_id")
