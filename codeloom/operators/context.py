"""What a reader gets to see of a code base: ranked maps, a symbol's source and surroundings, and functions of one structure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexer
from codeloom.model import CALLABLES, CodeModel
from codeloom.operators import graph, similarity
from codeloom.ship import ship

#: Kinds that a map lists; characters of a token; the least that a map's line has.
MAP_KINDS = ("function", "method", "struct", "class", "enum", "trait", "interface")
CHARS, LINE = 4, 12


def ranked_map(m: CodeModel, ranks: DataFrame, budget: int, used: int = 0) -> DataFrame:
    """(place, file_path, line_start, kind, signature, rank) of the symbols that rank highest, as many as fit `budget` tokens of text of which `used` characters are gone.

    Symbols go by rank, qualified name and id; the first that doesn't fit ends the map. A symbol in another file than the one before
    also pays for a line with its file. Only as many rows as could fit at all are ordered in one place.
    """
    chars = CHARS * budget - used
    plain = F.coalesce("signature", "name") if "signature" in m.symbols.columns else F.col("name")
    signature = F.trim(F.regexp_replace(plain, r"\s+", " "))
    rows = m.symbols.where(F.col("kind").isin(*MAP_KINDS)).join(ranks, "id", "left").select("id", "file_path", "line_start", "kind", "qualified_name", signature.alias("signature"), F.coalesce("rank", F.lit(0.0)).alias("rank"))
    order = [F.desc("rank"), "qualified_name", "id"]
    w = Window.orderBy(*order)
    first = rows.orderBy(*order).limit(max(0, chars // LINE))
    line = F.length(F.format_string("  L%d: %s [%s]\n", F.coalesce("line_start", F.lit(0)), "signature", "kind"))
    header = F.when(F.lag("file_path").over(w).eqNullSafe(F.col("file_path")), 0).otherwise(F.length("file_path") + 1)
    spent = first.withColumn("cost", line + header).withColumn("spent", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return spent.where(F.col("spent") <= chars).select("place", "file_path", "line_start", "kind", "signature", "rank")


def render_map(rows: DataFrame, markdown: bool = False) -> str:
    """A map's text. Its rows fit a budget, so the driver holds them."""
    out, file = [], None
    for r in rows.orderBy("place").collect():
        if r["file_path"] != file:
            file = r["file_path"]
            out.append(f"## {file}\n" if markdown else f"{file}\n")
        at = r["line_start"] or 0
        out.append(f"- L{at}: `{r['signature']}` [{r['kind']}]\n" if markdown else f"  L{at}: {r['signature']} [{r['kind']}]\n")
    return "".join(out)


def focus_ids(m: CodeModel, text: str) -> DataFrame:
    """(id): symbols of the file of that path, else of files that fit it as a glob, else of that name or qualified name."""
    from codeloom.functions import text as tx

    by_path = m.symbols.where(F.col("file_path") == text)
    if by_path.isEmpty():
        by_path = m.symbols.where(F.col("file_path").rlike(tx.glob_regex(text)))
    return (by_path if not by_path.isEmpty() else m.symbols.where((F.col("name") == text) | (F.col("qualified_name") == text))).select("id")


def source_of(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols with source, their lines of files (path, content); null where the file is not there."""
    body = files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("__lines"))
    part = F.array_join(F.slice("__lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return symbols.join(body, "file_path", "left").withColumn("source", F.when(F.col("__lines").isNotNull(), part)).drop("__lines")


def explain(m: CodeModel, text: str) -> DataFrame:
    """(relation, name, file_path, n) around the symbol that text means: itself with its complexity, its direct callers, and what it calls (by name where that is open)."""
    one = graph.cut(graph.start_symbol(m, text).select("id"))
    own = m.with_fans().join(one, "id").select(F.lit("self").alias("relation"), "name", "file_path", F.col("complexity").alias("n"))
    side = m.symbols.select(F.col("id").alias("other"), "name", "file_path")
    calls = m.calls()
    callers = calls.join(one.withColumnRenamed("id", "target_id"), "target_id").join(side, F.col("source_id") == F.col("other")).groupBy("name", "file_path").agg(F.count("*").alias("n")).select(F.lit("caller").alias("relation"), "name", "file_path", "n")
    out = calls.join(one.withColumnRenamed("id", "source_id"), "source_id").join(side, F.col("target_id") == F.col("other"), "left")
    callees = out.groupBy(F.coalesce("name", "target_name").alias("name"), F.coalesce("file_path", F.lit("external")).alias("file_path")).agg(F.count("*").alias("n")).select(F.lit("callee").alias("relation"), "name", "file_path", "n")
    return own.unionByName(callers).unionByName(callees)


def _structures(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, source in zip(b["id"], b["source"], strict=True):
                t = lexer.tokens(source or "")
                rows.append((key, len(t), sorted({" ".join(t[i : i + size]) for i in range(len(t) - size + 1)})))
            yield pd.DataFrame(rows, columns=["key", "n_tokens", "runs"])

    return run


def structures(files: DataFrame, symbols: DataFrame, size: int = 5, min_tokens: int = 50) -> DataFrame:
    """(key, n_tokens, shingles) of functions and methods with enough tokens: names and literals have lost their spelling, so renamed copies are equal."""
    ship(files.sparkSession)
    f = source_of(files, symbols.where(F.col("kind").isin(*CALLABLES))).select("id", "source")
    runs = f.mapInPandas(_structures(size), "key string, n_tokens long, runs array<string>").where(F.col("n_tokens") >= min_tokens)
    return runs.select("key", "n_tokens", F.transform("runs", lambda r: F.xxhash64(r)).alias("shingles"))


def duplicate_functions(files: DataFrame, symbols: DataFrame, threshold: float = 0.85, min_tokens: int = 50) -> DataFrame:
    """(a, b, similarity) of functions of nearly one structure, between representatives of equal ones; below 0.5 the threshold is 0.5."""
    return similarity.exact_pairs(similarity.folded(structures(files, symbols, 5, min_tokens)), max(0.5, threshold))
