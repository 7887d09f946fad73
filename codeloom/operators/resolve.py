"""Binding edges to the symbols they mean, pass by pass.

Each pass sees the edges that earlier ones left, and binds an edge only to a single candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.model import CALLABLES
from codeloom.operators.graph import cut

#: Marks, in the context of a `uses` edge, a name that stands where a function may be passed as a value.
ITEM = "rust-function-item:"


#: A table of so many rows at most goes to all executors.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    """df, computed once, and broadcast to joins where it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def unique_names(symbols: DataFrame) -> DataFrame:
    """(u_name, u_id) of function names that one symbol has: the table is aggregated before it joins, so an edge meets one row at most."""
    f = symbols.where(F.col("kind").isin(*CALLABLES))
    return f.groupBy(F.col("name").alias("u_name")).agg(F.count("*").alias("n"), F.min("id").alias("u_id")).where(F.col("n") == 1).drop("n")


def function_items(texts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(target_name, context, n0, b0): how many Rust functions each reference to a function as a value fits, and the least of them. A bare name means any free function of that name, a path one whose file's module path ends in it.

    Functions are folded by name and by each ending of their path, so that a reference meets one row at most.
    """
    rust = files.where(F.col("language") == "rust").select(F.col("path").alias("file_path"))
    reference = F.substring("context", len(ITEM) + 1, 1 << 20)
    path = F.contains(reference, F.lit("::"))
    asked = texts.where(F.col("context").startswith(ITEM)).select("target_name", "context", path.alias("path"), F.when(path, F.regexp_replace(reference, "^(crate|self)::", "")).otherwise(reference).alias("tail"))
    module = F.regexp_replace(F.regexp_replace("file_path", r"(/mod\.rs|\.rs)$", ""), r"[/\\]", "::")
    f = symbols.where(F.col("kind") == "function").join(rust, "file_path", "left_semi").groupBy(F.col("name").alias("target_name"), F.concat(module, F.lit("::"), "name").alias("whole")).agg(F.count("*").alias("n"), F.min("id").alias("b"))
    apart = F.filter(F.sequence(F.lit(1), F.length("whole")), lambda i: F.substr("whole", i, F.lit(2)) == "::")
    endings = F.array_distinct(F.concat(F.array("whole"), F.transform(apart, lambda i: F.substr("whole", i + 2))))
    bare = f.select("target_name", F.lit(False).alias("path"), F.col("target_name").alias("tail"), "n", "b")
    paths = f.select("target_name", F.lit(True).alias("path"), F.explode(endings).alias("tail"), "n", "b")
    fits = bare.unionByName(paths).groupBy("target_name", "path", "tail").agg(F.sum("n").alias("n0"), F.min("b").alias("b0"))
    return asked.join(fits, ["target_name", "path", "tail"]).select("target_name", "context", "n0", "b0")


def _hints(edges: DataFrame, symbols: DataFrame, files: DataFrame | None, f: DataFrame) -> DataFrame:
    """(h_name, h_context, n0, b0, b1, b2) for the distinct names and contexts of open edges: what passes 0, 1 and 2 find. Candidates are folded by what the passes compare, so that their number counts once and not for each edge."""
    texts = cut(edges.where(F.col("target_id").isNull() & F.col("context").isNotNull()).select("target_name", "context").distinct())
    whole = f.groupBy(F.col("c_qname").alias("context")).agg(F.count("*").alias("n"), F.min("c_id").alias("b1")).where(F.col("n") == 1).drop("n")
    named = f.groupBy("c_name", "c_qname").agg(F.count("*").alias("n"), F.min("c_id").alias("b2"))
    holds = (F.col("target_name") == F.col("c_name")) & F.ilike("context", F.concat(F.lit("%"), F.col("c_qname"), F.lit("%")))
    held = texts.join(named, holds).groupBy("target_name", "context").agg(F.sum("n").alias("n"), F.min("b2").alias("b2")).where(F.col("n") == 1).drop("n")
    out = texts.join(whole, "context", "left").join(held, ["target_name", "context"], "left")
    items = function_items(texts, symbols, files) if files is not None else None
    out = out.join(items, ["target_name", "context"], "left") if items is not None else out.withColumn("n0", F.lit(None).cast("long")).withColumn("b0", F.lit(None).cast("string"))
    return out.select(F.col("target_name").alias("h_name"), F.col("context").alias("h_context"), "n0", "b0", "b1", "b2")


def resolve(edges: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """edges with more target_ids, and resolved_by, the pass that bound them.

    (0) A reference to a function as a value, with one fitting function; with none it names no function, and the edge goes. Such edges take no part further on.
    (1) The context is a qualified name. (2) It holds a qualified name of the target's name. (3) The name is unique among functions.
    (4) It is unique among functions of the caller's file, unless the context calls it on something else (after ::, . or ->) and
    doesn't hold that function's qualified name.
    """
    f = symbols.where(F.col("kind").isin(*CALLABLES)).select(F.col("id").alias("c_id"), F.col("name").alias("c_name"), F.col("qualified_name").alias("c_qname"))
    edges = edges.withColumn("resolved_by", F.lit(None).cast("int"))
    sources = symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("s_file"))
    item = F.lit(False)
    if "context" in edges.columns:
        item = F.coalesce((F.col("kind") == "uses") & F.col("context").startswith(ITEM), F.lit(False))
        hints = _small(_hints(edges, symbols, files, f).withColumn("h_salt", F.lit(-1).cast("long")))
        if files is not None:
            rust = files.where(F.col("language") == "rust").select(F.col("path").alias("s_file"), F.lit(True).alias("s_rust"))
            sources = sources.join(rust, "s_file", "left")
        open_context = F.col("target_id").isNull() & F.col("context").isNotNull()
        # Edges without hints have a salt of their own, so that they don't meet in one task.
        salt = F.when(open_context, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 20))).cast("long")
        edges = edges.join(sources, "source_id", "left").withColumn("e_salt", salt)
        edges = edges.join(hints, (F.col("e_salt") == F.col("h_salt")) & F.col("target_name").eqNullSafe(F.col("h_name")) & F.col("context").eqNullSafe(F.col("h_context")), "left").drop("e_salt", "h_salt", "h_name", "h_context")
        bound = F.coalesce("b1", "b2")
        number = F.when(F.col("b1").isNotNull(), 1).when(F.col("b2").isNotNull(), 2)
        fresh = F.col("target_id").isNull() & ~item
        if files is not None:
            asked = F.col("target_id").isNull() & item & F.coalesce("s_rust", F.lit(False))
            edges = edges.where(~(asked & (F.coalesce("n0", F.lit(0)) == 0)))
            one = asked & (F.col("n0") == 1)
            bound, number, fresh = F.when(asked, F.col("b0")).otherwise(bound), F.when(asked, 0).otherwise(number), fresh | one
        edges = edges.withColumn("resolved_by", F.when(fresh, number)).withColumn("target_id", F.when(fresh, bound).otherwise(F.col("target_id"))).drop("n0", "b0", "b1", "b2", "s_rust")
    else:
        edges = edges.join(sources, "source_id", "left")
    names = _small(unique_names(symbols))
    open_ = F.col("target_id").isNull() & ~item
    edges = edges.join(names, F.col("target_name") == F.col("u_name"), "left").withColumn("resolved_by", F.when(open_ & F.col("u_id").isNotNull(), 3).otherwise(F.col("resolved_by")))
    edges = edges.withColumn("target_id", F.when(open_, F.col("u_id")).otherwise(F.col("target_id"))).drop("u_name", "u_id")
    local = symbols.where(F.col("kind").isin(*CALLABLES)).groupBy(F.col("file_path").alias("l_file"), F.col("name").alias("l_name")).agg(F.count("*").alias("n"), F.min("id").alias("l_id"), F.min("qualified_name").alias("l_qname")).where(F.col("n") == 1).drop("n")
    edges = edges.join(_small(local), (F.col("target_name") == F.col("l_name")) & (F.col("s_file") == F.col("l_file")), "left")
    own = F.lit(True)
    if "context" in edges.columns:
        after = lambda mark: F.ilike("context", F.concat(F.lit(f"%{mark}"), F.col("target_name"), F.lit("(%")))
        own = F.col("context").isNull() | ~(after("::") | after(".") | after("->")) | F.coalesce(F.ilike("context", F.concat(F.lit("%"), F.col("l_qname"), F.lit("%"))), F.lit(False))
    take = open_ & own & F.col("l_id").isNotNull()
    edges = edges.withColumn("resolved_by", F.when(take, 4).otherwise(F.col("resolved_by"))).withColumn("target_id", F.when(take, F.col("l_id")).otherwise(F.col("target_id")))
    return edges.drop("s_file", "l_file", "l_name", "l_id", "l_qname")
