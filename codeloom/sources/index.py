"""An index of source files that follows them: changed files are parsed again, those that are gone go, edges are bound anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.model import CodeModel
from codeloom.operators import imports, resolve
from codeloom.sources import extract, tables

FILES = "path string, content_hash string, size_bytes long, language string, last_indexed long"
_TABLES = {"files": FILES, "symbols": extract.SYMBOL, "edges": extract.EDGE + ", id long, target_id string, resolved_by int", "imports": "file_path string, spec string"}


class Index:
    """Versions of files, symbols, edges and imports in one folder, and ranks beside them. A version is whole once its folder has its name, so readers see the one before or the new one; two are kept."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self.ranks = tables.RankCache(spark, f"{self.at}/ranks")

    def _versions(self) -> list[int]:
        fs, p = tables._fs(self.spark, self.at)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))

    def read(self, table: str) -> DataFrame:
        """A table of the last version; empty before the first."""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], _TABLES[table])
        return self.spark.read.schema(_TABLES[table]).parquet(f"{self.at}/v={found[-1]}/{table}")

    def model(self) -> CodeModel:
        return CodeModel(self.read("symbols"), self.read("edges"), self.read("files"))

    def imported_files(self) -> DataFrame:
        """(from_file, to_file) of the imports that mean an indexed file, for governance.check."""
        found = imports.resolve_imports(self.read("imports"), self.read("files")).select("from_file", "to_file")
        return found.where(F.col("from_file") != F.col("to_file")).distinct()

    def update(self, found: DataFrame, now: int, scope: list[str] | None = None) -> dict[str, int]:
        """Brings the index to found (path, content_hash, size_bytes, language, content), as files.discover gives it, and says how many files were added, changed, removed, same and failed.

        With a scope (globs or paths, one file for example) only files in it count as removed. A file that doesn't parse keeps no hash, so
        the next update tries it again. If nothing changed, nothing is written; else the ranks are cleared. What is parsed is the changed
        files; the tables are rewritten, as an edge of any file may now mean another symbol.
        """
        old = {t: self.read(t) for t in _TABLES}
        inside = F.coalesce(tx.matches(F.col("path"), scope or []), F.lit(False))
        found = found.where(inside)
        tables.guard_scope(found, old["files"].where(inside))
        work = f"{self.at}/.work.{uuid.uuid4().hex}"
        tables.changes(old["files"].where(inside), found).write.parquet(f"{work}/changes")
        change = self.spark.read.parquet(f"{work}/changes")
        counts = {k: 0 for k in ("added", "changed", "removed", "same", "failed")} | {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count("*").alias("n")).collect()}
        fs, p = tables._fs(self.spark, work)
        if counts["added"] + counts["changed"] + counts["removed"]:
            fresh = found.join(change.where(F.col("change").isin("added", "changed")).select("path"), "path", "left_semi")
            extract.records(fresh).write.parquet(f"{work}/records")
            rows = self.spark.read.schema(extract.RECORD).parquet(f"{work}/records")
            failed = rows.where("failed").select("path").distinct().withColumn("failed", F.lit(True))
            counts["failed"] = failed.count()
            gone = change.where(F.col("change").isin("changed", "removed")).select("path")
            kept = tables.cascade(old["files"], old["symbols"], old["edges"], {}, gone)
            hashed = fresh.join(failed, "path", "left").select("path", F.when(F.col("failed").isNull(), F.col("content_hash")).alias("content_hash"), "size_bytes", "language", F.lit(now).cast("long").alias("last_indexed"))
            files = kept["files"].unionByName(hashed)
            symbols = kept["symbols"].unionByName(extract.of_kind(rows, "symbol"))
            open_ = kept["edges"].drop("resolved_by").unionByName(extract.of_kind(rows, "edge"))
            # Names may mean other symbols now, so all edges are bound anew.
            edges = resolve.resolve(open_.withColumn("target_id", F.lit(None).cast("string")), symbols, files)
            asked = tables.without({"imports": (old["imports"], "file_path")}, gone)["imports"].unionByName(rows.where(F.col("spec").isNotNull()).select(F.col("path").alias("file_path"), "spec"))
            version = (self._versions() or [0])[-1] + 1
            for name, df in (("files", files), ("symbols", symbols), ("edges", edges), ("imports", asked)):
                df.write.parquet(f"{work}/v/{name}")
            tables._put(self.spark, f"{work}/v", f"{self.at}/v={version}")
            self.ranks.clear()
            for v in self._versions()[:-2]:
                _, q = tables._fs(self.spark, f"{self.at}/v={v}")
                fs.delete(q, True)
        fs.delete(p, True)
        return counts
