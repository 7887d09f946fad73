"""Counts and complexity of symbols and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.model import CALLABLES, CodeModel

SEVERITY = ((50, "critical"), (30, "high"))


def severity(fan_out: F.Column, threshold: int = 10) -> F.Column:
    return F.when(fan_out > 50, "critical").when(fan_out > 30, "high").when(fan_out > threshold, "medium").otherwise("low")


def symbol_metrics(m: CodeModel) -> DataFrame:
    """Fan counts and complexity of functions and methods."""
    return m.with_fans().where(F.col("kind").isin(*CALLABLES)).select("id", "name", "file_path", "fan_in", "fan_out", "complexity")


def complexity(m: CodeModel, threshold: int = 10, warnings_only: bool = False) -> DataFrame:
    """symbol_metrics with a severity by fan_out; with warnings_only, those of at least the threshold."""
    out = symbol_metrics(m).withColumn("severity", severity(F.col("fan_out"), threshold))
    return out.where(F.col("fan_out") >= threshold) if warnings_only else out


def file_complexity(m: CodeModel) -> DataFrame:
    return m.with_fans().groupBy("file_path").agg(F.sum("complexity").alias("total_complexity"), F.sum("fan_out").alias("total_fan_out"), F.max("complexity").alias("max_complexity"), F.count("*").alias("symbol_count"))


def file_statistics(m: CodeModel) -> DataFrame:
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    return m.symbols.groupBy("file_path").agg(F.count("*").alias("symbol_count"), kind("function", "method").alias("function_count"), kind("struct", "class").alias("struct_count"), kind("trait", "interface").alias("trait_count"), F.count_if(F.col("visibility") == "public").alias("public_count"))


def symbol_summary(m: CodeModel) -> DataFrame:
    return m.symbols.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("visibility") == "public").alias("public_count"))


def stats(m: CodeModel) -> DataFrame:
    """Seven counts in one row; symbols are read once."""
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    s = m.symbols.agg(F.count("*").alias("symbols"), kind("function", "method").alias("functions"), kind("struct", "class").alias("structs"), kind("enum").alias("enums"), kind("trait", "interface").alias("traits"))
    return s.crossJoin(m.files.agg(F.count("*").alias("files"))).crossJoin(m.edges.agg(F.count("*").alias("edges")))  # one row each


def most_connected(m: CodeModel, limit: int = 10) -> DataFrame:
    out = symbol_metrics(m).select("id", "name", "file_path", "fan_in", "fan_out", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    return out.orderBy(F.desc("degree"), "id").limit(limit)


def fan_in_counts(m: CodeModel, ids: DataFrame) -> DataFrame:
    """Incoming resolved calls of the given ids; 0 where there are none."""
    return ids.select("id").join(m.fan_in(), "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"))


def embedding_metadata(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("provider", "model", "dimension").agg(F.count("*").alias("n"))


def tree_collapse(files: DataFrame, depth: int = 2) -> DataFrame:
    """Files below `depth` levels of folders become one row for each folder."""
    parts = F.split("path", "/")
    deep = F.size(parts) > depth + 1
    return files.groupBy(F.when(deep, F.concat_ws("/", F.slice(parts, 1, depth))).otherwise(F.col("path")).alias("entry"), deep.alias("collapsed")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
