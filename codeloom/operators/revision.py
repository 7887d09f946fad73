"""What a revision touches: its files and symbols, and the files around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.model import CodeModel
from codeloom.operators import graph, links

#: Priorities of files that call what changed, and of files that it calls; both are divided by the distance.
CALLERS, CALLEES = 0.8, 0.6


def named_symbols(m: CodeModel, names: DataFrame) -> DataFrame:
    """(name, id): for each of names (name) the symbol it means, as in graph.start_symbol: by id or qualified name, else by name; the first by file and line."""
    asked = names.select(F.col("name").alias("asked")).distinct()
    at = m.symbols.select("id", F.col("name").alias("own"), "qualified_name", "file_path", "line_start")
    hit = lambda c, rank: asked.join(at, F.col("asked") == F.col(c)).withColumn("rank", F.lit(rank))
    order = Window.partitionBy("asked").orderBy("rank", "file_path", "line_start", "id")
    found = hit("id", 0).unionByName(hit("qualified_name", 0)).unionByName(hit("own", 1))
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("asked").alias("name"), "id")


def affected(m: CodeModel, changed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols that a changed range (file_path, first, last) of a file of changed (path, change) touches; deleted files have none."""
    kept = changed.where(F.col("change") != "deleted").select(F.col("path").alias("file_path"))
    return links.overlapping(m.symbols, ranges.join(kept, "file_path", "left_semi"))


def context(m: CodeModel, changed: DataFrame, ranges: DataFrame, depth: int = 2, patterns: list[str] | None = None, changes_only: bool = False) -> DataFrame:
    """(path, priority, reason) of the files to read with a change: changed ones first, then files that call its symbols, then files that they call.

    One traversal each way starts from all symbols at once, so its cost doesn't grow with their number; a file's priority is that of its nearest symbol.
    """
    out = changed.where(F.col("change") != "deleted").select("path", F.lit(1.0).alias("priority"), F.col("change").alias("reason"))
    if not changes_only:
        start = graph.cut(named_symbols(m, affected(m, changed, ranges).select("name")).select(F.col("id").alias("node")).distinct())
        at = m.symbols.select(F.col("id").alias("node"), F.col("file_path").alias("path"))
        near = lambda back, steps: graph.hops(graph._calls(m, back), start, steps).join(at, "node").where(tx.matches(F.col("path"), patterns or []))
        callers = near(True, depth).select("path", (CALLERS / F.col("depth")).alias("priority"), F.lit("calls a change").alias("reason"))
        # A symbol has depth 1 itself, so what it calls has 2.
        callees = near(False, depth - 1).select("path", (CALLEES / (F.col("depth") + 1)).alias("priority"), F.lit("called by a change").alias("reason"))
        out = out.unionByName(callers).unionByName(callees)
    best = F.max(F.struct("priority", "reason")).alias("best")
    return out.groupBy("path").agg(best).select("path", "best.priority", "best.reason")


def changed_files(status: DataFrame, ranges: DataFrame, lines: DataFrame | None = None, patterns: list[str] | None = None) -> DataFrame:
    """status (change, path, old_path) with ranges, an array in order, and added and deleted lines; of renamed files either path may fit the patterns."""
    fits = lambda c: F.coalesce(tx.matches(F.col(c), patterns or []), F.lit(False))
    spans = ranges.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    rows = status.where(fits("path") | fits("old_path")).join(spans, "path", "left")
    if lines is not None:
        rows = rows.join(lines.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")), "path", "left")
    return rows
