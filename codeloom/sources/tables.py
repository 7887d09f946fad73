"""Stored relations: change detection, upserts, deletes, snapshots and the gate log, over Parquet and JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table by one that is written beside it; see _put."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(staged)
    _put(df.sparkSession, staged, path)


def _put(spark: SparkSession, staged: str, path: str) -> None:
    """Renames the table at `staged` to `path`. An old one moves aside first and is deleted last; if the new one can't take its place, it moves back. Between two renames there is no table at `path`, but none is lost: after a crash the old one is beside it, hidden, as .name.*.old."""
    fs, p = _fs(spark, path)
    to = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    aside = f"{p.getParent()}/.{p.getName()}.{uuid.uuid4().hex}.old" if fs.exists(p) else None
    if aside and not fs.rename(p, to(aside)):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(to(staged), p):
        if aside:
            fs.rename(to(aside), p)
        raise OSError(f"{staged} can't be moved to {path}")
    if aside:
        fs.delete(to(aside), True)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two sides (path, content_hash): added, removed, changed or same; null hashes are equal."""
    o, n = old.select("path", F.col("content_hash").alias("o_hash"), F.lit(True).alias("in_old")), new.select("path", F.col("content_hash").alias("n_hash"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("o_hash").eqNullSafe(F.col("n_hash")), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", kind.alias("change"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (frame, its path column) without the rows of removed files (path)."""
    g = gone.select(F.col("path").alias("gone_path")).distinct()
    return {name: df.join(g, df[c] == g["gone_path"], "left_anti") for name, (df, c) in tables.items()}


def cascade(files: DataFrame, symbols: DataFrame, edges: DataFrame, by_symbol: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All relations without the files of gone (path): their symbols go, edges from these, and rows of by_symbol (symbol_id) such as ranks, embeddings and fingerprints. Edges to them stay, by name."""
    kept = without({"files": (files, "path"), "symbols": (symbols, "file_path")}, gone)
    lost = symbols.join(gone.select(F.col("path").alias("gone_path")).distinct(), F.col("file_path") == F.col("gone_path"), "left_semi").select(F.col("id").alias("lost_id"))
    rest = edges.join(lost, F.col("source_id") == F.col("lost_id"), "left_anti")
    dead = lost.select("lost_id", F.lit(True).alias("__dead"))
    kept["edges"] = rest.join(dead, F.col("target_id") == F.col("lost_id"), "left").withColumn("target_id", F.when(F.col("__dead").isNull(), F.col("target_id"))).select(*edges.columns)
    return kept | {name: df.join(lost, F.col("symbol_id") == F.col("lost_id"), "left_anti") for name, df in by_symbol.items()}


def without_embeddings(embeddings: DataFrame, provider: str, model: str | None = None) -> DataFrame:
    """embeddings but those of a provider, or of one of its models."""
    own = F.col("provider") == provider
    return embeddings.where(~F.coalesce(own if model is None else own & (F.col("model") == model), F.lit(False)))


def other_providers(embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """(provider, model, n) of embeddings that a search by this provider and model can't compare with."""
    same = F.col("provider").eqNullSafe(provider) & F.col("model").eqNullSafe(model)
    return embeddings.where(~same).groupBy("provider", "model").agg(F.count("*").alias("n"))


class RankCache:
    """Ranks (id, rank) beside an index. They are of no use once the number of symbols is another; load gives None then."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def store(self, ranks: DataFrame) -> None:
        swap(ranks.select("id", "rank"), self.at)

    def load(self, symbols: int) -> DataFrame | None:
        if not exists(self.spark, self.at):
            return None
        found = self.spark.read.schema("id string, rank double").parquet(self.at)
        return found if found.count() == symbols else None

    def clear(self) -> None:
        fs, p = _fs(self.spark, self.at)
        fs.delete(p, True)


def guard_scope(found: DataFrame, indexed: DataFrame) -> None:
    """Refuses a scope without files while the index has some."""
    if found.isEmpty() and not indexed.isEmpty():
        raise ValueError("the scope matches no file; the index is left as it is")


class Snapshots:
    """One folder for each commit and table: sha=<sha>/<table>. A snapshot is complete once its rename is done; there is one unless forced."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def write(self, sha: str, committed_at: str, tables: dict[str, DataFrame], force: bool = False) -> bool:
        final, staged = f"{self.at}/sha={sha}", f"{self.at}/.sha={sha}.{uuid.uuid4().hex}.tmp"
        if exists(self.spark, final) and not force:
            return False
        for name, df in tables.items():
            stamped = df.select(F.lit(sha).alias("commit_sha"), F.lit(committed_at).cast("timestamp").alias("committed_at"), *df.columns)
            stamped.write.parquet(f"{staged}/{name}")
        _put(self.spark, staged, final)
        return True

    def backfill(self, commits: list[tuple[str, str]], capture) -> dict[str, str]:
        """Writes what capture(sha) gives for each commit; a commit that fails is reported and skipped."""
        out = {}
        for sha, at in commits:
            try:
                out[sha] = "written" if self.write(sha, at, capture(sha)) else "skipped"
            except Exception as e:  # noqa: BLE001 - one bad commit must not end the history
                out[sha] = f"failed: {e}"
        return out

    def any(self) -> bool:
        fs, p = _fs(self.spark, self.at)
        return fs.exists(p) and any(s.getPath().getName().startswith("sha=") for s in fs.listStatus(p))

    def read(self, table: str) -> DataFrame:
        """All snapshots of a table, columns united by name; the folder's sha prunes the scan."""
        return self.spark.read.option("mergeSchema", True).option("basePath", self.at).parquet(f"{self.at}/sha=*/{table}").drop("sha")


GATE_LOG = "ts timestamp, schema long, gate string, outcome string, ref string, head string, changed_files long, findings long, duration_ms long, version string, actor string, metrics map<string,long>"


def append_gate_log(spark: SparkSession, at: str, row: dict) -> None:
    """Adds one evaluation as a JSON line."""
    line = spark.createDataFrame([(json.dumps(row, default=str),)], "value string")
    line.coalesce(1).write.mode("append").text(at)


def read_gate_log(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(GATE_LOG).json(at)


def stream_gate_log(spark: SparkSession, at: str) -> DataFrame:
    """The gate log as a stream; each evaluation is a new file."""
    return spark.readStream.schema(GATE_LOG).json(at)


def envelope(df: DataFrame, command: str, version: str, generated_at: str) -> DataFrame:
    """One row, json: version, command, generated_at and the rows as data. For reports, which are short."""
    return df.agg(F.collect_list(F.struct(*df.columns)).alias("data")).select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(command).alias("command"), F.lit(generated_at).alias("generated_at"), "data")).alias("json"))
