"""Binds the code model to the star-schema tables, in Spark and in SQL.

Parts are symbols and brands their files; a line item whose order goes on to another part is an edge
between the two. Open line items leave the target unresolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.model import CodeModel

KINDS = {"STANDARD": "function", "ECONOMY": "method", "SMALL": "struct", "MEDIUM": "class", "LARGE": "trait", "PROMO": "constant"}
EDGE_KINDS = {"A": "calls", "N": "imports", "R": "uses"}
#: How a reference to a function as a value is marked in an edge's context.
ITEM = "rust-function-item:"
LANGUAGES = ("rust", "python", "go", "typescript")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict[str, str]) -> F.Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    line = (F.col("p_size") * 10).cast("int")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_brand").alias("file_path"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"),
        _case("p_type", KINDS).alias("kind"),
        F.when(F.col("p_size") % 2 == 0, "public").otherwise("private").alias("visibility"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("brief"),
        line.alias("line_start"),
        (line + 9 + (F.col("p_partkey") % 7 * 10).cast("int")).alias("line_end"),
        (F.length("p_type") + F.col("p_size")).cast("long").alias("token_count"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    walk = items.withColumn("next_part", F.lead("l_partkey").over(steps)).withColumn("step", F.row_number().over(steps)).where(F.col("next_part").isNotNull())
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("next_part"), F.col("p_name").alias("target_name"), F.concat("p_brand", F.lit("::"), "p_name").alias("target"))
    item = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(ITEM), F.when(F.col("step") % 2 == 0, F.col("target_name")).otherwise(F.col("target"))))
    form = F.col("l_orderkey") % 6
    context = F.when(form == 0, F.col("target")).when(form == 1, F.concat(F.lit("call "), "target", F.lit("()"))).when(form == 2, F.concat(F.lit("x."), "target_name", F.lit("("))).when(form == 4, F.concat("target_name", F.lit("("))).when(form == 5, item)
    return walk.join(names, "next_part").select(
        (F.col("l_orderkey") * 100 + F.col("step")).cast("long").alias("id"),
        F.col("l_partkey").cast("string").alias("source_id"),
        F.when(F.col("l_linestatus") != "O", F.col("next_part").cast("string")).alias("target_id"),
        "target_name",
        _case("l_returnflag", EDGE_KINDS).alias("kind"),
        F.col("l_linenumber").cast("int").alias("line"),
        context.alias("context"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 4
    grouped = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sum("p_size").cast("long").alias("size_bytes"), F.max("p_partkey").cast("long").alias("last_indexed"))
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), number + 1)
    return grouped.select("path", F.sha2("path", 256).alias("content_hash"), "size_bytes", language.alias("language"), "last_indexed")


def model(spark: SparkSession, sf_dir: str) -> CodeModel:
    return CodeModel(symbols(spark, sf_dir), edges(spark, sf_dir), files(spark, sf_dir))


def _sql_case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


#: The same relations as common table expressions; queries go on with more of them or a SELECT.
CTES = f"""WITH RECURSIVE symbols AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS file_path, p_name AS name, p_brand || '::' || p_name AS qualified_name,
    {_sql_case("p_type", KINDS)} AS kind, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS visibility,
    CASE WHEN p_partkey % 3 = 0 THEN p_name END AS brief, CAST(p_size * 10 AS INTEGER) AS line_start,
    CAST(p_size * 10 + 9 + p_partkey % 7 * 10 AS INTEGER) AS line_end, CAST(length(p_type) + p_size AS BIGINT) AS token_count
  FROM part),
steps AS (
  SELECT *, lead(l_partkey) OVER w AS next_part, row_number() OVER w AS step FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
edges AS (
  SELECT CAST(l_orderkey * 100 + step AS BIGINT) AS id, CAST(l_partkey AS VARCHAR) AS source_id,
    CASE WHEN l_linestatus <> 'O' THEN CAST(next_part AS VARCHAR) END AS target_id, p_name AS target_name,
    {_sql_case("l_returnflag", EDGE_KINDS)} AS kind, CAST(l_linenumber AS INTEGER) AS line,
    CASE l_orderkey % 6 WHEN 0 THEN p_brand || '::' || p_name WHEN 1 THEN 'call ' || p_brand || '::' || p_name || '()' WHEN 2 THEN 'x.' || p_name || '(' WHEN 4 THEN p_name || '('
      WHEN 5 THEN CASE WHEN l_returnflag = 'R' THEN '{ITEM}' || CASE WHEN step % 2 = 0 THEN p_name ELSE p_brand || '::' || p_name END END END AS context
  FROM steps JOIN part ON next_part = p_partkey),
files AS (
  SELECT p_brand AS path, CAST(sum(p_size) AS BIGINT) AS size_bytes, CAST(max(p_partkey) AS BIGINT) AS last_indexed,
    list_extract({list(LANGUAGES)}, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 4 + 1) AS language
  FROM part GROUP BY p_brand),
fan_out AS (SELECT source_id AS id, count(*) AS fan_out FROM edges WHERE kind = 'calls' GROUP BY 1),
fan_in AS (SELECT target_id AS id, count(*) AS fan_in FROM edges WHERE kind = 'calls' AND target_id IS NOT NULL GROUP BY 1),
fans AS (
  SELECT s.*, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out,
    CAST(2 * coalesce(fan_out, 0) + coalesce(fan_in, 0) AS BIGINT) AS complexity
  FROM symbols s LEFT JOIN fan_out o ON s.id = o.id LEFT JOIN fan_in i ON s.id = i.id)
"""
