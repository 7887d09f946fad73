"""Histories and diffs as rows, from the text that a version control system prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}


def name_only(lines: DataFrame) -> DataFrame:
    """(path, churn) of a log (value) of one path a line; blank lines part commits."""
    return lines.where(F.trim("value") != "").groupBy(F.trim("value").alias("path")).agg(F.count("*").alias("churn"))


def name_status(lines: DataFrame) -> DataFrame:
    """(change, path, old_path) of lines like 'M<tab>path' or 'R100<tab>old<tab>new'."""
    parts = F.split("value", "\t")
    letter = F.substring(parts[0], 1, 1)
    table = F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv])
    moved = letter.isin("R", "C")
    rows = lines.where(F.size(parts) >= 2)
    return rows.select(F.coalesce(F.try_element_at(table, letter), F.lit("unknown")).alias("change"), F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(moved, F.get(parts, F.lit(1))).alias("old_path"))


def hunks(lines: DataFrame) -> DataFrame:
    """(file_path, first, last) of the new side's ranges in diffs (file_path, value); hunks without new lines are dropped."""
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.where(F.col("value").rlike(head))
    start = F.regexp_extract("value", head, 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("value", head, 2), F.lit("")), F.lit("1")).cast("int")
    return rows.select("file_path", start.alias("first"), count.alias("n")).where(F.col("n") > 0).select("file_path", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def numstat(lines: DataFrame) -> DataFrame:
    """(path, added, deleted); binary files count as 0."""
    parts = F.split("value", "\t")
    number = lambda i: F.coalesce(F.expr(f"try_cast(get(split(value, '\\t'), {i}) AS BIGINT)"), F.lit(0))
    return lines.where(F.size(parts) == 3).select(F.get(parts, F.lit(2)).alias("path"), number(0).alias("added"), number(1).alias("deleted"))


def changed_files(*sides: DataFrame) -> DataFrame:
    """The distinct paths of several lists."""
    out = sides[0].select("path")
    for s in sides[1:]:
        out = out.union(s.select("path"))
    return out.distinct()


def rework(commits: DataFrame) -> DataFrame:
    """One row of a history (subject): commits, the share that are fixes, and the share that are reverts."""
    fix, revert = F.count_if(F.col("subject").rlike("^fix[(:! ]")), F.count_if(F.col("subject").rlike("^[Rr]evert[ :\"(]"))
    n = F.count("*")
    return commits.agg(n.alias("commits"), F.when(n > 0, fix / n).alias("fix_rate"), F.when(n > 0, revert / n).alias("revert_rate"))
