"""Tables in the folder that all executors share, and session settings that the Arrow operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.ship import ship

_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (local tests), a temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codeloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def folder(spark: SparkSession, name: str) -> str:
    """A new path of its own under root()."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there, and a lost executor costs a read."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    spark._jvm.System.gc()  # lets Spark's cleaner delete shuffle files that nothing refers to any more
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes what cut() wrote, of tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_codeloom_path", None)
        if path:
            remove(df.sparkSession, path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing, if there is none."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Makes a new file; fails if there is one, so of two writers one wins."""
    fs, where = _fs(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def arrow(spark: SparkSession) -> None:
    """Sends the package to the executors, and bounds an Arrow batch by bytes, so that long texts make small batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def aside(df: DataFrame, names: tuple[str, ...] | list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with those of its columns that clash with `names` renamed, and their former names, for back()."""
    clash = {f"__{c}_{uuid.uuid4().hex[:8]}": c for c in df.columns if c.lower() in {n.lower() for n in names}}
    for new, old in clash.items():
        df = df.withColumnRenamed(old, new)
    return df, clash


def back(df: DataFrame, clash: dict[str, str], columns: list[str]) -> DataFrame:
    """The given columns of df, under their former names."""
    former = {old: new for new, old in clash.items()}
    return df.select(*(df[former.get(c, c)].alias(c) for c in columns))
