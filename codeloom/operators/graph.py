"""Traversals and ranks over the edge table.

Traversals go breadth first, one join for each hop, and keep a node's least depth; paths are never
enumerated, so dense graphs cost the number of edges for each hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.model import RANKED_EDGES, CodeModel


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of an iteration: a reliable checkpoint where the session has a folder for one."""
    sc = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if where and not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def start_symbol(m: CodeModel, text: str) -> DataFrame:
    """The symbol that text means: by id or qualified name, or by name if there's none; the first by file and line."""
    exact = (F.col("id") == text) | (F.col("qualified_name") == text)
    found = m.symbols.where(exact | (F.col("name") == text)).withColumn("rank", F.when(exact, 0).otherwise(1))
    return found.orderBy("rank", "file_path", "line_start", "id").limit(1).drop("rank")


def hops(edges: DataFrame, start: DataFrame, limit: int) -> DataFrame:
    """(node, depth): nodes that 1 to `limit` steps along edges (a, b) reach from start (node), with the fewest. The start appears only if a cycle leads back to it."""
    step = cut(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    front, seen = start.select("node"), None
    for depth in range(1, limit + 1):
        front = front.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        if seen is not None:
            front = front.join(seen.select("node"), "node", "left_anti")
        front = cut(front)
        found = front.withColumn("depth", F.lit(depth))
        seen = found if seen is None else cut(seen.unionByName(found))
        if front.isEmpty():
            break
    return seen if seen is not None else start.select("node", F.lit(0).alias("depth")).limit(0)


def _calls(m: CodeModel, back: bool = False) -> DataFrame:
    c = m.calls().where(F.col("target_id").isNotNull())
    return c.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")) if back else c.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def call_graph(m: CodeModel, start: str, max_depth: int = 5) -> DataFrame:
    """What start calls. It has depth 1 itself and callees begin at 2, so max_depth - 1 hops are taken; by (name, file, kind), the least depth."""
    found = hops(_calls(m), start_symbol(m, start).select(F.col("id").alias("node")), max_depth - 1)
    return found.join(m.symbols, F.col("node") == F.col("id")).groupBy("name", "file_path", "kind").agg((F.min("depth") + 1).cast("int").alias("depth"))


def impact_located(m: CodeModel, start: str, max_depth: int = 5) -> DataFrame:
    """What calls start, by symbol; direct callers have distance 1."""
    found = hops(_calls(m, True), start_symbol(m, start).select(F.col("id").alias("node")), max_depth)
    return found.join(m.symbols, F.col("node") == F.col("id")).select("id", "name", "file_path", "kind", "line_start", F.col("depth").cast("int").alias("distance"))


def impact(m: CodeModel, start: str, max_depth: int = 5) -> DataFrame:
    return impact_located(m, start, max_depth).groupBy("name", "file_path", "kind").agg(F.min("distance").alias("distance"))


def has_path(m: CodeModel, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """One row: whether source reaches target; both match by id, qualified name or name, and a symbol reaches itself."""
    match = lambda t: m.symbols.where((F.col("id") == t) | (F.col("qualified_name") == t) | (F.col("name") == t)).select(F.col("id").alias("node"))
    start = match(source)
    reached = start.unionByName(hops(_calls(m), start, max_depth - 1).select("node"))
    return reached.join(match(target), "node", "left_semi").agg((F.count("*") > 0).alias("has_path"))


def callers(m: CodeModel, symbol: str, max_depth: int = 3) -> DataFrame:
    """Callers of one symbol id with their shortest distance, without the symbol itself."""
    seed = m.symbols.where(F.col("id") == symbol).select(F.col("id").alias("node"))
    found = hops(_calls(m, True), seed, max_depth).where(F.col("node") != symbol)
    return found.join(m.symbols, F.col("node") == F.col("id")).select("id", "name", "file_path", F.col("depth").cast("int").alias("distance"))


def evidence(context: F.Column, name: F.Column, qualified: F.Column) -> F.Column:
    """Whether a call's text speaks for a symbol: one with a qualified name of its own must be called by it; any other by its bare name somewhere, not after ::, . or ->, and a call without text will do."""
    own = qualified.isNotNull() & (qualified != name)
    bare = F.rlike(context, F.concat(F.lit(r"(?<!(?:::|\.|->)\s{0,80})\Q"), name, F.lit(r"\E")))
    return F.when(own, F.coalesce(F.contains(context, qualified), F.lit(False))).otherwise(context.isNull() | bare)


def unresolved_callers(m: CodeModel, symbol: str) -> DataFrame:
    """Calls by name only, from files of the symbol's language, whose text speaks for it: evidence, not links."""
    one = m.symbols.where(F.col("id") == symbol).select(F.col("name").alias("target_name"), "qualified_name", F.col("file_path").alias("path")).join(m.files, "path").select("target_name", F.col("qualified_name").alias("own_name"), F.col("language").alias("own"))
    source = m.symbols.select(F.col("id").alias("source_id"), "name", "file_path")
    text = F.col("context") if "context" in m.edges.columns else F.lit(None).cast("string")
    lines = m.calls().where(F.col("target_id").isNull()).join(one, "target_name").where(evidence(text, F.col("target_name"), F.col("own_name"))).join(source, "source_id")
    return lines.join(m.files.select(F.col("path").alias("file_path"), "language"), "file_path").where(F.col("language").eqNullSafe(F.col("own"))).select("source_id", "name", "file_path", "line")


class Ambiguous(ValueError):
    """A name that several symbols have; it holds them, as (id, file_path)."""

    def __init__(self, found: list[tuple[str, str]]):
        super().__init__("several symbols: " + ", ".join(f"{i} in {p}" for i, p in found))
        self.found = found


def one_symbol(m: CodeModel, text: str, patterns: list[str] | None = None, show: int = 100) -> str:
    """The id that text means: an id, or the only symbol of that name; among files that fit the patterns the first. Else LookupError, or Ambiguous with up to `show` symbols."""
    if m.symbols.where(F.col("id") == text).limit(1).count():
        return text
    named = m.symbols.where((F.col("name") == text) | (F.col("qualified_name") == text))
    named = named if patterns is None else named.where(tx.matches(F.col("file_path"), patterns))
    found = [(r["id"], r["file_path"]) for r in named.orderBy("file_path", "line_start", "id").limit(show).collect()]
    if not found:
        raise LookupError(text)
    if len(found) > 1 and patterns is None:
        raise Ambiguous(found)
    return found[0][0]


def deps(m: CodeModel, symbol: str, max_depth: int = 3) -> DataFrame:
    """What a symbol depends on by edges of any kind; unresolved targets are leaves, by name."""
    node = F.coalesce("target_id", F.concat(F.lit("?"), F.col("target_name")))
    e = m.edges.select(F.col("source_id").alias("a"), node.alias("b"))
    seed = m.symbols.where(F.col("id") == symbol).select(F.col("id").alias("node"))
    found = hops(e, seed, max_depth).where(F.col("node") != symbol)
    named = found.join(m.symbols.select("id", "name", "file_path"), F.col("node") == F.col("id"), "left")
    return named.select(F.coalesce("name", F.expr("substring(node, 2)")).alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), "node", F.col("id").isNotNull().alias("resolved"), F.col("depth").cast("int").alias("distance"))


def pagerank(m: CodeModel, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank), summing to 1: deduplicated ranked edges, uniform start, the mass of nodes without targets spread over all. Stops when the L1 change is under the tolerance (None: after all iterations).

    The normalised edges are cut once; an iteration is one join, one aggregate, and a global sum.
    """
    nodes = m.symbols.select("id")
    e = m.edges.where(F.col("kind").isin(*RANKED_EDGES) & F.col("target_id").isNotNull()).select("source_id", "target_id").distinct()
    degree = e.groupBy("source_id").agg(F.count("*").alias("degree"))
    links = cut(e.join(degree, "source_id").select("source_id", "target_id", (1.0 / F.col("degree")).alias("weight")))
    sinks = cut(nodes.join(degree, F.col("id") == F.col("source_id"), "left").select("id", F.col("degree").isNull().alias("sink")))
    n = sinks.count()
    ranks = sinks.select("id", "sink", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        lost = ranks.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        gains = links.join(ranks.select(F.col("id").alias("source_id"), "rank"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("weight")).alias("gain"))
        value = (1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") / n)
        now = ranks.withColumnRenamed("rank", "before").join(gains, "id", "left").crossJoin(F.broadcast(lost)).select("id", "sink", value.alias("rank"), "before")  # lost is one row
        now = cut(now)
        ranks = now.select("id", "sink", "rank")
        if tolerance is not None and now.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
            break
    return ranks.select("id", "rank")


def focus(m: CodeModel, ranks: DataFrame, ids: list[str], boost: float = 10.0) -> DataFrame:
    """Ranks with those of the ids and their neighbours multiplied by boost, summing to 1 again."""
    e = m.edges.where(F.col("kind").isin(*RANKED_EDGES) & F.col("target_id").isNotNull())
    near = e.where(F.col("source_id").isin(ids)).select(F.col("target_id").alias("id")).union(e.where(F.col("target_id").isin(ids)).select(F.col("source_id").alias("id")))
    chosen = near.union(m.symbols.where(F.col("id").isin(ids)).select("id")).distinct().withColumn("near", F.lit(True))
    raised = ranks.join(chosen, "id", "left").select("id", F.when(F.col("near"), F.col("rank") * boost).otherwise(F.col("rank")).alias("rank"))
    total = raised.agg(F.sum("rank").alias("total"))
    return raised.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))  # total is one row


def rank_is_stale(cached: DataFrame, m: CodeModel) -> bool:
    return cached.count() != m.symbols.count()
