"""The code model: schemas of the base relations, and the public views derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("content_hash", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("language", T.StringType()), T.StructField("last_indexed", T.LongType())])
SYMBOLS = T.StructType(
    [T.StructField(n, T.StringType(), n != "id") for n in ("id", "file_path", "name", "qualified_name", "kind", "visibility", "signature", "brief", "docstring")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end", "col_start", "col_end")]
    + [T.StructField("parent_id", T.StringType()), T.StructField("source", T.StringType())]
)
EDGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("target_name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("context", T.StringType())])
MODULES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("module_name", T.StringType()), T.StructField("exports", T.ArrayType(T.StringType())), T.StructField("imports", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("alias", T.StringType())])))])
EMBEDDINGS = T.StructType([T.StructField("symbol_id", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()), T.StructField("dimension", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("created_at", T.LongType())])
FINGERPRINTS = T.StructType([T.StructField("symbol_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("minhash", T.ArrayType(T.LongType())), T.StructField("token_count", T.LongType())])

SCHEMA_VERSION = 1
CALLABLES = ("function", "method")
DECLARATIONS = ("function", "method", "struct", "class", "trait", "interface", "enum")
RANKED_EDGES = ("calls", "imports", "extends", "implements")


def symbol_id(path: str = "file_path", parent: str = "parent_name", name: str = "name", line: str = "line_start") -> F.Column:
    """path::[parent::]name@line, as a column."""
    return F.concat(F.col(path), F.lit("::"), F.coalesce(F.concat(F.col(parent), F.lit("::")), F.lit("")), F.col(name), F.lit("@"), F.col(line).cast("string"))


@dataclass
class CodeModel:
    """Base relations as DataFrames; everything else is derived, lazily."""

    symbols: DataFrame
    edges: DataFrame
    files: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    def calls(self) -> DataFrame:
        return self.edges.where(F.col("kind") == "calls")

    def fan_out(self) -> DataFrame:
        """Calls by source, unresolved ones too."""
        return self.calls().groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))

    def fan_in(self) -> DataFrame:
        """Resolved calls by target."""
        return self.calls().where(F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))

    def with_fans(self) -> DataFrame:
        """symbols with fan_in, fan_out and complexity; both counts are aggregated before they join."""
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        joined = self.symbols.join(self.fan_out(), "id", "left").join(self.fan_in(), "id", "left")
        out = joined.select(*self.symbols.columns, zero("fan_in"), zero("fan_out"))
        return out.withColumn("complexity", 2 * F.col("fan_out") + F.col("fan_in"))

    def v1_symbols(self) -> DataFrame:
        return self.with_fans().select(
            "id", "name", "qualified_name", "kind", F.col("file_path").alias("file"), "line_start", "line_end", (F.col("visibility") == "public").alias("is_public"), "complexity", "fan_in", "fan_out", F.coalesce("brief", "docstring").alias("doc") if "docstring" in self.symbols.columns else F.col("brief").alias("doc")
        )

    def v1_edges(self) -> DataFrame:
        side = lambda p: self.symbols.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_symbol"), F.col("file_path").alias(f"{p}_file"))
        joined = self.edges.join(side("source"), "source_id").join(side("target"), "target_id", "left")
        return joined.select("source_id", F.col("source_symbol").alias("source_name"), "source_file", "target_id", F.coalesce("target_symbol", "target_name").alias("target_name"), "target_file", "kind", "line")

    def v1_files(self) -> DataFrame:
        sums = self.with_fans().groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbol_count"), F.sum("complexity").alias("total_complexity"))
        return self.files.join(sums, "path", "left").select("path", "language", F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"), F.coalesce("total_complexity", F.lit(0)).cast("long").alias("total_complexity"), F.timestamp_seconds("last_indexed").alias("indexed_at"))

    def v1_meta(self) -> DataFrame:
        first = self.files.agg(F.timestamp_seconds(F.min("last_indexed")).alias("index_created_at"))
        return first.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(self.meta.get("version", "0")).alias("engine_version"), "index_created_at", F.lit(self.meta.get("root", "")).alias("index_root"))

    def register(self, spark: SparkSession | None = None) -> None:
        """Registers the public views v1_symbols, v1_edges, v1_files and v1_meta."""
        for name in ("v1_symbols", "v1_edges", "v1_files", "v1_meta"):
            getattr(self, name)().createOrReplaceTempView(name)
