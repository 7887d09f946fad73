"""The engine's queries over the star-schema tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import budget, context, governance, graph, links, metrics, resolve, search, similarity
from codeloom.plans import adapters as ad
from codeloom.plans.adapters import CTES, model, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What traversals start from, a symbol that is there at every scale.
START = "7"
#: A symbol that some calls name without being bound to it.
NAMED = "70"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


S, D = SparkSession, str


@query(CTES + "SELECT id, name, file_path AS file, complexity FROM fans ORDER BY complexity DESC, id LIMIT 10")
def v1_symbols_top_complexity(spark: S, d: D) -> DataFrame:
    return model(spark, d).v1_symbols().select("id", "name", "file", "complexity").orderBy(F.desc("complexity"), "id").limit(10)


@query(CTES + "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(complexity) AS BIGINT) AS complexity FROM fans GROUP BY kind")
def v1_symbols_by_kind(spark: S, d: D) -> DataFrame:
    model(spark, d).register()
    return spark.sql("SELECT kind, count(*) AS n, sum(complexity) AS complexity FROM v1_symbols GROUP BY kind")


@query(CTES + "SELECT id, name, file_path AS file FROM fans WHERE visibility = 'public' AND kind IN ('function', 'method') AND fan_in <= 10")
def dead_public_functions(spark: S, d: D) -> DataFrame:
    return model(spark, d).v1_symbols().where(F.col("is_public") & F.col("kind").isin("function", "method") & (F.col("fan_in") <= 10)).select("id", "name", "file")


@query(CTES + "SELECT s.file_path AS source_file, coalesce(t.file_path, '-') AS target_file, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN symbols s ON e.source_id = s.id LEFT JOIN symbols t ON e.target_id = t.id WHERE e.kind = 'uses' GROUP BY 1, 2")
def v1_edges_uses(spark: S, d: D) -> DataFrame:
    return model(spark, d).v1_edges().where(F.col("kind") == "uses").groupBy("source_file", F.coalesce("target_file", F.lit("-")).alias("target_file")).agg(F.count("*").alias("n"))


@query(CTES + "SELECT path, language, CAST(count(f.id) AS BIGINT) AS symbol_count, CAST(coalesce(sum(complexity), 0) AS BIGINT) AS total_complexity, CAST(last_indexed AS BIGINT) AS indexed FROM files LEFT JOIN fans f ON f.file_path = path GROUP BY path, language, last_indexed")
def v1_files(spark: S, d: D) -> DataFrame:
    return model(spark, d).v1_files().withColumn("indexed", F.unix_timestamp("indexed_at")).drop("indexed_at")


@query(CTES + "SELECT id, name, file_path, fan_in, fan_out, complexity FROM fans WHERE kind IN ('function', 'method')")
def symbol_metrics(spark: S, d: D) -> DataFrame:
    return metrics.symbol_metrics(model(spark, d))


@query(CTES + "SELECT id, fan_out, complexity, CASE WHEN fan_out > 50 THEN 'critical' WHEN fan_out > 30 THEN 'high' WHEN fan_out > 10 THEN 'medium' ELSE 'low' END AS severity FROM fans WHERE kind IN ('function', 'method')")
def complexity_severity(spark: S, d: D) -> DataFrame:
    return metrics.complexity(model(spark, d)).select("id", "fan_out", "complexity", "severity")


@query(CTES + "SELECT file_path, CAST(sum(complexity) AS BIGINT) AS total_complexity, CAST(sum(fan_out) AS BIGINT) AS total_fan_out, max(complexity) AS max_complexity, CAST(count(*) AS BIGINT) AS symbol_count FROM fans GROUP BY file_path")
def file_complexity(spark: S, d: D) -> DataFrame:
    return metrics.file_complexity(model(spark, d))


@query(CTES + "SELECT file_path, count(*) AS symbol_count, count(*) FILTER (WHERE kind IN ('function', 'method')) AS function_count, count(*) FILTER (WHERE kind IN ('struct', 'class')) AS struct_count, count(*) FILTER (WHERE kind IN ('trait', 'interface')) AS trait_count, count(*) FILTER (WHERE visibility = 'public') AS public_count FROM symbols GROUP BY file_path")
def file_stats_filter(spark: S, d: D) -> DataFrame:
    return metrics.file_statistics(model(spark, d))


@query(CTES + "SELECT kind, count(*) AS n, count(*) FILTER (WHERE visibility = 'public') AS public_count FROM symbols GROUP BY kind")
def symbol_summary(spark: S, d: D) -> DataFrame:
    return metrics.symbol_summary(model(spark, d))


@query(CTES + "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM symbols WHERE kind IN ('function', 'method')) AS functions, (SELECT count(*) FROM symbols WHERE kind IN ('struct', 'class')) AS structs, (SELECT count(*) FROM symbols WHERE kind = 'enum') AS enums, (SELECT count(*) FROM symbols WHERE kind IN ('trait', 'interface')) AS traits, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM edges) AS edges")
def codebase_stats(spark: S, d: D) -> DataFrame:
    return metrics.stats(model(spark, d))


@query(CTES + "SELECT id, name, file_path, fan_in, fan_out, CAST(fan_in + fan_out AS BIGINT) AS degree FROM fans WHERE kind IN ('function', 'method') ORDER BY degree DESC, id LIMIT 10")
def most_connected(spark: S, d: D) -> DataFrame:
    return metrics.most_connected(model(spark, d))


@query(CTES + "SELECT s.file_path AS from_file, coalesce(t.file_path, 'external') AS to_file, CAST(count(*) AS BIGINT) AS call_count FROM edges e JOIN symbols s ON e.source_id = s.id LEFT JOIN symbols t ON (e.target_id IS NOT NULL AND e.target_id = t.id) OR (e.target_id IS NULL AND e.target_name = t.name) WHERE e.kind = 'calls' AND s.file_path <> coalesce(t.file_path, 'external') GROUP BY 1, 2")
def file_dependencies_external(spark: S, d: D) -> DataFrame:
    return links.file_dependencies(model(spark, d))


@query(CTES + "SELECT DISTINCT s.name AS caller, s.file_path AS caller_file, coalesce(t.name, e.target_name) AS callee, coalesce(t.file_path, 'external') AS callee_file FROM edges e JOIN symbols s ON e.source_id = s.id LEFT JOIN symbols t ON (e.target_id IS NOT NULL AND e.target_id = t.id) OR (e.target_id IS NULL AND e.target_name = t.name) WHERE e.kind = 'calls'")
def full_call_graph(spark: S, d: D) -> DataFrame:
    return links.full_call_graph(model(spark, d))


@query(CTES + "SELECT DISTINCT s.id, s.name, s.file_path FROM edges e JOIN symbols s ON e.source_id = s.id WHERE e.kind = 'calls' AND (e.target_id = s.id OR (e.target_id IS NULL AND e.target_name = s.name))")
def recursive_functions(spark: S, d: D) -> DataFrame:
    return links.recursive_functions(model(spark, d))


@query(CTES + "SELECT s.file_path AS from_file, t.file_path AS to_file, e.kind, count(*) AS n FROM edges e JOIN symbols s ON e.source_id = s.id JOIN symbols t ON e.target_id = t.id WHERE s.file_path <> t.file_path GROUP BY 1, 2, 3")
def cross_file_edges(spark: S, d: D) -> DataFrame:
    return links.cross_file(model(spark, d))


@query(CTES + "SELECT id, name FROM symbols WHERE id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)")
def symbols_without_embedding(spark: S, d: D) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("symbol_id"))
    return links.without_embedding(ad.symbols(spark, d), e).select("id", "name")


_RANGES = "SELECT DISTINCT p_brand AS file_path, CAST(p_size * 7 AS INTEGER) AS first, CAST(p_size * 7 + 4 AS INTEGER) AS last FROM part WHERE p_type = 'PROMO'"


@query(CTES + f"SELECT id, name FROM symbols s WHERE EXISTS (SELECT 1 FROM ({_RANGES}) r WHERE r.file_path = s.file_path AND s.line_start <= r.last AND r.first <= s.line_end)")
def interval_overlap(spark: S, d: D) -> DataFrame:
    p = table(spark, d, "part").where(F.col("p_type") == "PROMO")
    ranges = p.select(F.col("p_brand").alias("file_path"), (F.col("p_size") * 7).cast("int").alias("first"), (F.col("p_size") * 7 + 4).cast("int").alias("last")).distinct()
    return links.overlapping(ad.symbols(spark, d), ranges).select("id", "name")


@query(
    CTES
    + "SELECT file_path, line, symbol_id FROM (SELECT p.file_path, p.line, s.id AS symbol_id, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY CASE WHEN s.line_start = p.line THEN 0 ELSE 1 END, s.line_end - s.line_start, s.line_start DESC, s.id) AS place FROM (SELECT DISTINCT p_brand AS file_path, CAST(p_size * 11 AS INTEGER) AS line FROM part) p LEFT JOIN symbols s ON s.file_path = p.file_path AND p.line BETWEEN s.line_start AND s.line_end) WHERE place = 1"
)
def innermost_symbol_at_line(spark: S, d: D) -> DataFrame:
    points = table(spark, d, "part").select(F.col("p_brand").alias("file_path"), (F.col("p_size") * 11).cast("int").alias("line")).distinct()
    return links.symbol_at(ad.symbols(spark, d), points)


def _walk(a: str, b: str, where: str, hops: int, seed: str = f"SELECT '{START}' AS node") -> str:
    return CTES.rstrip() + f", seed AS ({seed}), step AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE {where}), walk AS (SELECT node, 0 AS depth FROM seed UNION SELECT s.b, w.depth + 1 FROM walk w JOIN step s ON w.node = s.a WHERE w.depth < {hops}) "


_RESOLVED = "kind = 'calls' AND target_id IS NOT NULL"


@query(_walk("source_id", "target_id", _RESOLVED, 2) + "SELECT name, file_path, kind, CAST(min(depth) + 1 AS INTEGER) AS depth FROM walk JOIN symbols ON id = node WHERE depth > 0 GROUP BY 1, 2, 3")
def call_graph_fwd(spark: S, d: D) -> DataFrame:
    return graph.call_graph(model(spark, d), START, 3)


@query(_walk("target_id", "source_id", _RESOLVED, 2) + "SELECT id, name, file_path, kind, line_start, CAST(min(depth) AS INTEGER) AS distance FROM walk JOIN symbols ON id = node WHERE depth > 0 GROUP BY 1, 2, 3, 4, 5")
def impact_reverse(spark: S, d: D) -> DataFrame:
    return graph.impact_located(model(spark, d), START, 2)


@query(_walk("source_id", "target_id", _RESOLVED, 2) + "SELECT count(*) > 0 AS has_path FROM walk WHERE node = '11'")
def has_path(spark: S, d: D) -> DataFrame:
    return graph.has_path(model(spark, d), START, "11", 3)


@query(_walk("target_id", "source_id", _RESOLVED, 2) + f"SELECT id, name, file_path, CAST(min(depth) AS INTEGER) AS distance FROM walk JOIN symbols ON id = node WHERE depth > 0 AND node <> '{START}' GROUP BY 1, 2, 3")
def callers_bfs(spark: S, d: D) -> DataFrame:
    return graph.callers(model(spark, d), START, 2)


@query(_walk("source_id", "coalesce(target_id, '?' || target_name)", "true", 2) + f"SELECT coalesce(name, substr(node, 2)) AS name, coalesce(file_path, '') AS file_path, node, id IS NOT NULL AS resolved, CAST(min(depth) AS INTEGER) AS distance FROM walk LEFT JOIN symbols ON id = node WHERE depth > 0 AND node <> '{START}' GROUP BY 1, 2, 3, 4")
def deps_bfs(spark: S, d: D) -> DataFrame:
    return graph.deps(model(spark, d), START, 2)


@query(CTES + f"SELECT s.id AS source_id, s.name, s.file_path, e.line FROM edges e JOIN symbols s ON e.source_id = s.id JOIN files f ON f.path = s.file_path WHERE e.kind = 'calls' AND e.target_id IS NULL AND e.target_name = (SELECT name FROM symbols WHERE id = '{NAMED}') AND contains(e.context, (SELECT qualified_name FROM symbols WHERE id = '{NAMED}')) AND f.language = (SELECT language FROM files JOIN symbols ON path = file_path WHERE id = '{NAMED}')")
def unresolved_callers(spark: S, d: D) -> DataFrame:
    return graph.unresolved_callers(model(spark, d), NAMED)


_PR = (
    CTES.rstrip()
    + """, links AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind IN ('calls', 'imports', 'extends', 'implements') AND target_id IS NOT NULL),
deg AS (SELECT source_id, count(*) AS degree FROM links GROUP BY 1), nn AS (SELECT count(*) AS n FROM symbols),
r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM symbols, nn)"""
    + "".join(
        f""", l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT source_id FROM deg)),
g{i} AS (SELECT target_id AS id, sum(rank / degree) AS gain FROM links JOIN deg USING (source_id) JOIN r{i - 1} r ON r.id = source_id GROUP BY 1),
r{i} AS (SELECT s.id, 0.15 / n + 0.85 * (coalesce(gain, 0) + lost / n) AS rank FROM symbols s LEFT JOIN g{i} g ON g.id = s.id, nn, l{i})"""
        for i in range(1, 6)
    )
    + " "
)


@query(_PR + "SELECT id, round(rank, 9) AS rank FROM r5")
def pagerank_fixed_iters(spark: S, d: D) -> DataFrame:
    return graph.pagerank(model(spark, d), iterations=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query(
    _PR.rstrip()
    + f", near AS (SELECT target_id AS id FROM links WHERE source_id = '{START}' UNION SELECT source_id FROM links WHERE target_id = '{START}' UNION SELECT '{START}'), up AS (SELECT id, CASE WHEN id IN (SELECT id FROM near) THEN rank * 10 ELSE rank END AS rank FROM r5) SELECT id, round(rank / (SELECT sum(rank) FROM up), 9) AS rank FROM up"
)
def pagerank_focus(spark: S, d: D) -> DataFrame:
    m = model(spark, d)
    return graph.focus(m, graph.pagerank(m, iterations=5, tolerance=None), [START]).select("id", F.round("rank", 9).alias("rank"))


_MAP = _PR.rstrip() + r""", cand AS (SELECT s.id, file_path, line_start, kind, name AS signature, qualified_name, round(rank, 9) AS rank FROM symbols s JOIN r5 USING (id) WHERE kind IN ('function', 'method', 'struct', 'class', 'enum', 'trait', 'interface')),
placed AS (SELECT *, row_number() OVER w AS place, length('  L' || line_start || ': ' || signature || ' [' || kind || ']') + 1 + CASE WHEN lag(file_path) OVER w = file_path THEN 0 ELSE length(file_path) + 1 END AS cost FROM cand WINDOW w AS (ORDER BY rank DESC, qualified_name, id)),
spent AS (SELECT *, sum(cost) OVER (ORDER BY place) AS total FROM placed)
"""


@query(_MAP + "SELECT CAST(place AS INTEGER) AS place, file_path, line_start, kind, signature FROM spent WHERE total <= 4 * 500")
def map_ranked(spark: S, d: D) -> DataFrame:
    """What a map of 500 tokens lists."""
    m = model(spark, d)
    ranks = graph.pagerank(m, iterations=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))
    return context.ranked_map(m, ranks, 500).drop("rank")


@query(
    CTES
    + f"""SELECT 'self' AS relation, name, file_path, complexity AS n FROM fans WHERE id = '{START}'
UNION ALL SELECT 'caller', s.name, s.file_path, count(*) FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.kind = 'calls' AND e.target_id = '{START}' GROUP BY 2, 3
UNION ALL SELECT 'callee', coalesce(t.name, e.target_name), coalesce(t.file_path, 'external'), count(*) FROM edges e LEFT JOIN symbols t ON t.id = e.target_id WHERE e.kind = 'calls' AND e.source_id = '{START}' GROUP BY 2, 3"""
)
def explain_symbol(spark: S, d: D) -> DataFrame:
    return context.explain(model(spark, d), START)


_RESOLVE = CTES.rstrip() + f""", f AS (SELECT s.*, language FROM symbols s JOIN files ON path = file_path WHERE kind IN ('function', 'method')),
o AS (SELECT e.*, s.file_path AS s_file, l.language AS s_lang, coalesce(e.kind = 'uses' AND context LIKE '{ad.ITEM}%', false) AS item, regexp_replace(substr(context, {len(ad.ITEM) + 1}), '^(crate|self)::', '') AS ref FROM edges e LEFT JOIN symbols s ON s.id = e.source_id LEFT JOIN files l ON l.path = s.file_path),
c0 AS (SELECT o.id, count(f.id) AS n, min(f.id) AS bound FROM o LEFT JOIN f ON f.kind = 'function' AND f.language = 'rust' AND f.name = o.target_name AND CASE WHEN contains(ref, '::') THEN f.file_path || '::' || f.name = ref OR ends_with(f.file_path || '::' || f.name, '::' || ref) ELSE ref = f.name END
  WHERE o.item AND o.target_id IS NULL AND o.s_lang = 'rust' GROUP BY o.id),
p0 AS (SELECT o.* REPLACE (coalesce(target_id, CASE WHEN n = 1 THEN bound END) AS target_id), CASE WHEN target_id IS NULL AND n = 1 THEN 0 END AS rb FROM o LEFT JOIN c0 USING (id) WHERE coalesce(n, 1) > 0),
c1 AS (SELECT p0.id, min(f.id) AS bound FROM p0 JOIN f ON f.qualified_name = p0.context WHERE p0.target_id IS NULL AND NOT item GROUP BY 1 HAVING count(*) = 1),
p1 AS (SELECT p0.* REPLACE (coalesce(target_id, bound) AS target_id, CASE WHEN target_id IS NULL AND bound IS NOT NULL THEN 1 ELSE rb END AS rb) FROM p0 LEFT JOIN c1 USING (id)),
c2 AS (SELECT p1.id, min(f.id) AS bound FROM p1 JOIN f ON f.name = p1.target_name AND p1.context ILIKE '%' || f.qualified_name || '%' WHERE p1.target_id IS NULL AND NOT item GROUP BY 1 HAVING count(*) = 1),
p2 AS (SELECT p1.* REPLACE (coalesce(target_id, bound) AS target_id, CASE WHEN target_id IS NULL AND bound IS NOT NULL THEN 2 ELSE rb END AS rb) FROM p1 LEFT JOIN c2 USING (id)),
u AS (SELECT name, min(id) AS bound FROM f GROUP BY name HAVING count(*) = 1),
p3 AS (SELECT p2.* REPLACE (CASE WHEN target_id IS NULL AND NOT item THEN bound ELSE target_id END AS target_id, CASE WHEN target_id IS NULL AND NOT item AND bound IS NOT NULL THEN 3 ELSE rb END AS rb) FROM p2 LEFT JOIN u ON u.name = target_name),
loc AS (SELECT file_path, name, min(id) AS bound, min(qualified_name) AS q FROM f GROUP BY 1, 2 HAVING count(*) = 1),
p4 AS (SELECT p3.*, bound, target_id IS NULL AND NOT item AND bound IS NOT NULL AND (context IS NULL OR NOT (context ILIKE '%::' || target_name || '(%' OR context ILIKE '%.' || target_name || '(%' OR context ILIKE '%->' || target_name || '(%') OR context ILIKE '%' || q || '%') AS take FROM p3 LEFT JOIN loc ON loc.name = target_name AND loc.file_path = s_file),
done AS (SELECT id, source_id, CASE WHEN take THEN bound ELSE target_id END AS target_id, CASE WHEN take THEN 4 ELSE rb END AS resolved_by FROM p4)
"""


@query(_RESOLVE + "SELECT id, source_id, target_id, CAST(coalesce(resolved_by, -1) AS INTEGER) AS resolved_by FROM done")
def edge_resolution_passes(spark: S, d: D) -> DataFrame:
    m = model(spark, d)
    return resolve.resolve(m.edges, m.symbols, m.files).select("id", "source_id", "target_id", F.coalesce("resolved_by", F.lit(-1)).alias("resolved_by"))


@query(_RESOLVE + "SELECT CAST(coalesce(resolved_by, -1) AS INTEGER) AS pass, CAST(count(*) AS BIGINT) AS n FROM done GROUP BY 1")
def edge_resolution_counts(spark: S, d: D) -> DataFrame:
    """Edges by the pass that bound them; -1 for those bound before, or not at all."""
    m = model(spark, d)
    return resolve.resolve(m.edges, m.symbols, m.files).groupBy(F.coalesce("resolved_by", F.lit(-1)).alias("pass")).agg(F.count("*").alias("n"))


# Near duplicates over whole texts: distinct shingle sets, pairs of them, and who has them.

_SHINGLES = r"""WITH toks AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda t: t <> '') AS t FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct([array_to_string(t[i:i+4], ' ') for i in range(1, len(t) - 3)])) AS s FROM toks WHERE len(t) >= 50),
reps AS (SELECT min(doc_id) AS doc_id, count(*) AS copies, s FROM sets GROUP BY s),
long AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM reps),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared, p.n + q.n - count(*) AS either FROM long p JOIN long q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n)
"""


@query(_SHINGLES + "SELECT a, b, round(shared / either, 9) AS similarity FROM pairs WHERE shared >= 0.85 * either")
def near_duplicates_exact(spark: S, d: D) -> DataFrame:
    sets = similarity.folded(similarity.shingled(table(spark, d, "documents"), "doc_id", "text"))
    return similarity.exact_pairs(sets).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(_SHINGLES + "SELECT s.doc_id, r.doc_id AS rep, r.copies FROM sets s JOIN reps r ON s.s = r.s")
def duplicate_classes(spark: S, d: D) -> DataFrame:
    """Which documents have equal sets; pairs of near duplicates are between representatives."""
    hashed = graph.cut(similarity.digests(table(spark, d, "documents"), "doc_id", "text"))
    reps = hashed.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    return hashed.join(reps, "digest").select(F.col("key").alias("doc_id"), "rep", "copies")


@query()
def near_duplicates_lsh(spark: S, d: D) -> DataFrame:
    return similarity.near_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query()
def minhash_estimate(spark: S, d: D) -> DataFrame:
    """Estimated beside exact similarity of the pairs that bands propose."""
    sets = graph.cut(similarity.folded(similarity.shingled(table(spark, d, "documents"), "doc_id", "text")))
    sig = graph.cut(similarity.minhash(sets))
    pairs = similarity.similarities(graph.cut(similarity.band_candidates(sig)), sets, 0.0)
    return similarity.estimates(graph.cut(pairs), sig)


@query(
    _SHINGLES.rstrip()
    + """, now AS (SELECT a, b FROM pairs WHERE shared >= 0.85 * either)
SELECT a, b FROM now JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.lang = 'en' OR y.lang = 'en'"""
)
def new_duplication(spark: S, d: D) -> DataFrame:
    """Pairs of all documents that touch a changed one (here English ones), less those that were there without them."""
    docs = table(spark, d, "documents")
    sets = similarity.folded(similarity.shingled(docs, "doc_id", "text"))
    now = graph.cut(similarity.exact_pairs(sets).select("a", "b"))
    old = docs.where(F.col("lang") != "en").select(F.col("doc_id").alias("k"))
    before = now.join(old, F.col("a") == F.col("k"), "left_semi").join(old, F.col("b") == F.col("k"), "left_semi")
    return similarity.new_pairs(now, before)


def _vectors(spark: S, d: D) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return v, v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "vector")


def _topk(measure: str) -> str:
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    score = {
        "dot": dot.format("q.embedding", "v.embedding"),
        "cosine": f"{dot.format('q.embedding', 'v.embedding')} / (sqrt({dot.format('q.embedding', 'q.embedding')}) * sqrt({dot.format('v.embedding', 'v.embedding')}))",
        "l2": "sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))",
    }[measure]
    return f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {score} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {'' if measure == 'l2' else 'DESC'}, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5"


def _top(spark: S, d: D, measure: str) -> DataFrame:
    return search.top_k(*_vectors(spark, d), measure, 5).withColumn("score", F.round("score", 6))


@query(_topk("cosine"))
def cosine_topk(spark: S, d: D) -> DataFrame:
    return _top(spark, d, "cosine")


@query(_topk("l2"))
def l2_topk(spark: S, d: D) -> DataFrame:
    return _top(spark, d, "l2")


@query(_topk("dot"))
def dot_topk(spark: S, d: D) -> DataFrame:
    return _top(spark, d, "dot")


@query(CTES + "SELECT id, name, file_path, CASE WHEN name = 'red widget' THEN 0 WHEN name ILIKE 'red widget%' THEN 1 ELSE 2 END AS match_rank FROM symbols WHERE name ILIKE '%red widget%' OR qualified_name ILIKE '%red widget%' ORDER BY match_rank, name, id LIMIT 20")
def find_symbols(spark: S, d: D) -> DataFrame:
    return search.find_symbols(ad.symbols(spark, d), "red widget").select("id", "name", "file_path", "match_rank")


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(p_name || ' ' || p_brand || 'Of' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})))), ',') AS tokens FROM part")
def lexical_tokens(spark: S, d: D) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_brand", F.lit("Of"), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.lexical_tokens(text)), ",").alias("tokens"))


#: Terms of the English half of documents, of middling and of low frequency.
TERMS = "thanedble worthless anea"

def _bm25_sql(key: str, text: str, source: str, terms: tuple[str, ...]) -> str:
    """Common table expressions up to bm (key, score): prefix terms, lengths over all columns."""
    values = ", ".join(f"('{t}')" for t in terms)
    return rf"""tk AS (SELECT {key}, list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS terms FROM {source}),
tot AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM tk),
hit AS (SELECT {key}, len(terms) AS l, q.term, len(list_filter(terms, lambda x: starts_with(x, q.term))) AS tf FROM tk, (VALUES {values}) q(term) WHERE len(list_filter(terms, lambda x: starts_with(x, q.term))) > 0),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
bm AS (SELECT {key}, sum(CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM hit JOIN df USING (term), tot GROUP BY 1)
"""


_BM25 = "WITH " + _bm25_sql("doc_id", "coalesce(text, '')", "documents", ("thanedble", "worthless", "anea"))


@query(_BM25 + "SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark: S, d: D) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", [F.col("text")], TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_HYBRID = CTES.rstrip() + """, ex AS (SELECT id, CAST(CASE WHEN lower(name) = 'red' THEN 1.0 WHEN lower(name) LIKE 'red%' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS score FROM symbols WHERE lower(name) LIKE '%red%'),
""" + _bm25_sql("id", "concat_ws(' ', id, name, kind, brief)", "symbols", ("red", "widget")).rstrip() + """,
ft AS (SELECT id, round(score / (1 + score), 9) AS score FROM bm),
united AS (SELECT * FROM (SELECT * FROM ex ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM ft ORDER BY score DESC, id LIMIT 10))
"""


def _hybrid(spark: S, d: D) -> DataFrame:
    s = ad.symbols(spark, d)
    found = search.bm25(s, "id", [F.col("id"), F.col("name"), F.col("kind"), F.col("brief")], "red widget").select(F.col("key").alias("id"), F.round(F.col("score") / (1 + F.col("score")), 9).alias("score"))
    return search.hybrid(search.name_scores(s, "red"), found)


@query(_HYBRID + "SELECT id, CAST(max(score) AS DOUBLE) AS score FROM united GROUP BY id ORDER BY score DESC, id LIMIT 20")
def hybrid_search(spark: S, d: D) -> DataFrame:
    return _hybrid(spark, d)


@query(_HYBRID.rstrip() + ", hy AS (SELECT id, CAST(max(score) AS DOUBLE) AS score FROM united GROUP BY id ORDER BY score DESC, id LIMIT 20) SELECT f.id, f.name, hy.score, f.fan_in, f.brief FROM hy JOIN fans f ON f.id = hy.id WHERE kind IN ('function', 'method')")
def similar_keyword(spark: S, d: D) -> DataFrame:
    """Callables found by keyword, with their fan-in and one line of doc."""
    m = model(spark, d)
    s = m.with_fans().where(F.col("kind").isin("function", "method"))
    return s.join(_hybrid(spark, d), "id").select("id", "name", "score", "fan_in", tx.first_sentence(F.col("brief")).alias("brief"))


@query()
def smart_context(spark: S, d: D) -> DataFrame:
    """Files for a task: symbols that match it, what calls them and what they call, weighed by distance, packed into a token budget."""
    m = model(spark, d)
    seeds = graph.cut(_hybrid(spark, d).orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("node"), "score"))
    called = graph.hops(graph._calls(m), seeds, 2).withColumn("weight", 0.7 / F.col("depth"))
    calling = graph.hops(graph._calls(m, True), seeds, 2).withColumn("weight", 0.8 / F.col("depth"))
    rows = seeds.select("node", F.col("score").alias("weight")).unionByName(called.select("node", "weight")).unionByName(calling.select("node", "weight"))
    by_file = rows.join(m.symbols, F.col("node") == F.col("id")).groupBy("file_path").agg(F.max("weight").alias("weight"))
    sized = by_file.join(m.files, F.col("file_path") == F.col("path")).select("file_path", "weight", F.ceil(F.col("size_bytes") / 4).cast("long").alias("tokens"), F.lit("task").alias("task"), (-F.col("weight")).alias("order"))
    return budget.skip_greedy(sized, ["order", "file_path"], "tokens", 5000, "task").select("file_path", F.round("weight", 6).alias("weight"), "tokens")


# Rules: layers are groups of brands.

RULES = governance.Rules.parse("""
version = 1
[layers]
low = ["Brand#1", "Brand#2", "Brand#3"]
mid = ["Brand#4", "Brand#5", "Brand#6", "Brand#7"]
top = ["Brand#1?"]
[[forbidden]]
from = "low"
to = "top"
[[allowed_dependents]]
layer = "mid"
only = ["top"]
[[limit]]
metric = "fan_out"
max = 12
[[limit]]
scope = "file"
metric = "complexity"
max = 1000
[[no_new_dependents]]
paths = ["Brand#2?"]
""")

_DEPS = CTES.rstrip() + """, deps AS (SELECT DISTINCT s.file_path AS f, t.file_path AS t FROM edges e JOIN symbols s ON e.source_id = s.id JOIN symbols t ON e.target_id = t.id WHERE s.file_path <> t.file_path),
lay AS (SELECT path, CASE WHEN path IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'low' WHEN path IN ('Brand#4', 'Brand#5', 'Brand#6', 'Brand#7') THEN 'mid' WHEN regexp_full_match(path, 'Brand#1.') THEN 'top' END AS layer FROM files),
ld AS (SELECT f AS from_file, t AS to_file, a.layer AS fl, b.layer AS tl FROM deps JOIN lay a ON a.path = f JOIN lay b ON b.path = t)
"""


@query(_DEPS + "SELECT from_file, to_file FROM ld WHERE fl = 'low' AND tl = 'top'")
def rules_forbidden(spark: S, d: D) -> DataFrame:
    m, r = model(spark, d), RULES.forbidden[0]
    return governance.forbidden(governance.dependencies(m), RULES.layered(m.files), r["from"], r["to"])


@query(_DEPS + "SELECT from_file, to_file FROM ld WHERE tl = 'mid' AND fl IS NOT NULL AND fl NOT IN ('mid', 'top')")
def rules_allowed_dependents(spark: S, d: D) -> DataFrame:
    m, r = model(spark, d), RULES.allowed_dependents[0]
    return governance.allowed_dependents(governance.dependencies(m), RULES.layered(m.files), r["layer"], r["only"])


@query(CTES + "SELECT id, file_path, fan_out AS value FROM fans WHERE kind IN ('function', 'method') AND fan_out > 12")
def rules_limit_symbol(spark: S, d: D) -> DataFrame:
    return governance.limit_symbols(model(spark, d), "fan_out", RULES.limit[0]["max"])


@query(CTES + "SELECT file_path, CAST(sum(complexity) FILTER (WHERE kind IN ('function', 'method')) AS BIGINT) AS value FROM fans GROUP BY 1 HAVING sum(complexity) FILTER (WHERE kind IN ('function', 'method')) > 1000")
def rules_limit_file(spark: S, d: D) -> DataFrame:
    return governance.limit_files(model(spark, d), "complexity", RULES.limit[1]["max"])


@query(_DEPS + "SELECT from_file, to_file FROM ld WHERE regexp_full_match(to_file, 'Brand#2.') AND NOT regexp_full_match(from_file, 'Brand#2.')")
def rules_no_new_dependents(spark: S, d: D) -> DataFrame:
    return governance.no_new_dependents(governance.dependencies(model(spark, d)), RULES.no_new_dependents[0]["paths"])


@query(
    _DEPS
    + """SELECT rule, count(*) AS n FROM (SELECT 'forbidden' AS rule FROM ld WHERE fl = 'low' AND tl = 'top' UNION ALL SELECT 'allowed_dependents' FROM ld WHERE tl = 'mid' AND fl IS NOT NULL AND fl NOT IN ('mid', 'top')
UNION ALL SELECT 'limit' FROM fans WHERE kind IN ('function', 'method') AND fan_out > 12 UNION ALL SELECT 'limit' FROM (SELECT file_path FROM fans GROUP BY 1 HAVING sum(complexity) FILTER (WHERE kind IN ('function', 'method')) > 1000)
UNION ALL SELECT 'no_new_dependents' FROM ld WHERE regexp_full_match(to_file, 'Brand#2.') AND NOT regexp_full_match(from_file, 'Brand#2.')) GROUP BY 1"""
)
def rules_check(spark: S, d: D) -> DataFrame:
    return governance.check(model(spark, d), RULES).groupBy("rule").agg(F.count("*").alias("n"))


def _sides(spark: S, d: D) -> tuple:
    """Two versions of the same files, and which files changed: before, there were no traits, and no edges past line 4."""
    now = model(spark, d)
    before = ad.CodeModel(now.symbols.where(F.col("kind") != "trait"), now.edges.where(F.col("line") <= 4), now.files)
    return before, now, now.files.where(F.col("language").isin("rust", "go")).select("path")


def _score(spark: S, d: D) -> DataFrame:
    before, now, changed = _sides(spark, d)
    return governance.score(before, now, changed, governance.check(now, RULES, changed))


def _side(name: str, symbols: str, edges: str) -> str:
    return f""", {name}c AS (SELECT e.source_id, e.target_name, s.file_path FROM {edges} e JOIN {symbols} s ON s.id = e.source_id WHERE e.kind = 'calls' AND s.file_path IN (SELECT path FROM ch)),
{name} AS (SELECT coalesce((SELECT sum(2 * (SELECT count(*) FROM {name}c c WHERE c.source_id = s.id) + (SELECT count(*) FROM {name}c c WHERE c.file_path = s.file_path AND c.target_name = s.name)) FROM {symbols} s WHERE s.kind IN ('function', 'method') AND s.file_path IN (SELECT path FROM ch)), 0) AS x, (SELECT count(*) FROM {name}c) AS y),
{name}k AS (SELECT DISTINCT file_path, name FROM {symbols} WHERE file_path IN (SELECT path FROM ch))"""


_SCORE = (
    _DEPS.rstrip()
    + ", bs AS (SELECT * FROM symbols WHERE kind <> 'trait'), be AS (SELECT * FROM edges WHERE line <= 4), ch AS (SELECT path FROM files WHERE language IN ('rust', 'go'))"
    + _side("b", "bs", "be")
    + _side("w", "symbols", "edges")
    + """, ends AS (SELECT * FROM ld WHERE from_file IN (SELECT path FROM ch) OR to_file IN (SELECT path FROM ch)),
bad AS (SELECT 1 FROM ends WHERE fl = 'low' AND tl = 'top' UNION ALL SELECT 1 FROM ends WHERE tl = 'mid' AND fl IS NOT NULL AND fl NOT IN ('mid', 'top')
UNION ALL SELECT 1 FROM fans WHERE kind IN ('function', 'method') AND fan_out > 12 AND file_path IN (SELECT path FROM ch) UNION ALL SELECT 1 FROM (SELECT file_path FROM fans WHERE file_path IN (SELECT path FROM ch) GROUP BY 1 HAVING sum(complexity) FILTER (WHERE kind IN ('function', 'method')) > 1000)
UNION ALL SELECT 1 FROM ld WHERE regexp_full_match(to_file, 'Brand#2.') AND NOT regexp_full_match(from_file, 'Brand#2.') AND from_file IN (SELECT path FROM ch)),
sc AS (SELECT CAST(w.x - b.x AS BIGINT) AS complexity_delta, CAST(w.y - b.y AS BIGINT) AS fan_out_delta, CAST(0 AS BIGINT) AS new_duplication, (SELECT count(*) FROM bad) AS check_violations,
 (SELECT count(*) FROM (SELECT * FROM wk EXCEPT SELECT * FROM bk)) AS symbols_added, (SELECT count(*) FROM (SELECT * FROM bk EXCEPT SELECT * FROM wk)) AS symbols_removed, (SELECT count(*) FROM ch) AS files_changed FROM w, b)
"""
)


@query(_SCORE + "SELECT * FROM sc")
def score_delta(spark: S, d: D) -> DataFrame:
    return _score(spark, d)


@query(_SCORE + "SELECT 'symbols_added >= 1' AS condition, symbols_added AS value, symbols_added >= 1 AS failed FROM sc UNION ALL SELECT 'fan_out_delta < 0', fan_out_delta, fan_out_delta < 0 FROM sc")
def score_gate(spark: S, d: D) -> DataFrame:
    return governance.gate(_score(spark, d), "symbols_added >= 1, fan_out_delta < 0")


_HOT = """, b AS (SELECT min(churn) AS c0, max(churn) AS c1, min(complexity) AS x0, max(complexity) AS x1 FROM k),
s AS (SELECT k.*, round((CASE WHEN c1 = c0 THEN 1.0 ELSE (churn - c0)::DOUBLE / (c1 - c0) END) * (CASE WHEN x1 = x0 THEN 1.0 ELSE (complexity - x0)::DOUBLE / (x1 - x0) END), 9) AS score FROM k, b) """


@query("WITH k AS (SELECT CAST(user_id AS VARCHAR) AS path, count(DISTINCT event_id) AS churn, CAST(round(sum(value)) AS BIGINT) AS complexity FROM events GROUP BY 1 HAVING count(DISTINCT event_id) >= 2)" + _HOT + "SELECT path, churn, complexity, score FROM s ORDER BY score DESC, churn DESC, complexity DESC, path LIMIT 20")
def hotspots_file(spark: S, d: D) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("sha"), "ts", "value")
    rows = governance.churn(log).join(log.groupBy("path").agg(F.round(F.sum("value")).cast("long").alias("complexity")), "path")
    return governance.hotspots(rows, ["path"]).withColumn("score", F.round("score", 9))


@query(CTES.rstrip() + ", ch AS (SELECT CAST(l_partkey AS VARCHAR) AS id, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1), k AS (SELECT f.id, f.name, churn, complexity FROM fans f JOIN ch ON ch.id = f.id WHERE churn >= 2)" + _HOT + "SELECT id, name, churn, complexity, score FROM s ORDER BY score DESC, churn DESC, complexity DESC, id, name LIMIT 20")
def hotspots_symbol(spark: S, d: D) -> DataFrame:
    log = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.col("l_orderkey").alias("sha"))
    rows = model(spark, d).with_fans().join(governance.churn(log).withColumnRenamed("path", "id"), "id").select("id", "name", "churn", "complexity")
    return governance.hotspots(rows, ["id", "name"]).withColumn("score", F.round("score", 9))


@query("SELECT CAST(user_id AS VARCHAR) AS path, count(DISTINCT event_id) AS churn FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-22' GROUP BY 1")
def churn_window(spark: S, d: D) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("sha"), "ts")
    return governance.churn(log, "2024-01-08", "2024-01-22")


_TOP = "SELECT file_path, name, complexity, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY complexity DESC, name, id) AS place FROM fans) WHERE place <= 3"


@query(CTES + _TOP)
def top_symbols_per_file(spark: S, d: D) -> DataFrame:
    return governance.top_symbols_per_file(model(spark, d))


_AUDIT = CTES.rstrip() + r""", cx AS (SELECT count(*) FILTER (WHERE fan_out > 50) AS c, count(*) FILTER (WHERE fan_out > 30 AND fan_out <= 50) AS h, count(*) FILTER (WHERE fan_out > 20 AND fan_out <= 30) AS d FROM fans WHERE kind IN ('function', 'method')),
a_complexity AS (SELECT c AS critical, h AS high, d AS medium, CAST(CASE WHEN c > 0 THEN greatest(4 - least(c * 0.5, 3), 1) WHEN h > 5 THEN 5 - least((h - 5) * 0.2, 2) WHEN h > 0 THEN 6 - h * 0.2 WHEN d > 10 THEN 7 - least((d - 10) * 0.1, 1) WHEN d > 0 THEN 8 - d * 0.1 ELSE 10 END AS DOUBLE) AS score FROM cx),
a_dup AS (SELECT regexp_replace(name, '[0-9_]+$', '') AS stem, count(*) AS n FROM symbols WHERE kind IN ('function', 'method') GROUP BY 1 HAVING strlen(regexp_replace(name, '[0-9_]+$', '')) >= 4 AND count(*) >= 3),
a_cov AS (SELECT count(*) AS public, count(brief) AS documented, CAST(CASE WHEN count(*) = 0 OR count(brief) >= 0.95 * count(*) THEN 10 WHEN count(brief) >= 0.8 * count(*) THEN 8 WHEN count(brief) >= 0.6 * count(*) THEN 6 WHEN count(brief) >= 0.4 * count(*) THEN 4 ELSE 2 END AS DOUBLE) AS score FROM symbols WHERE visibility = 'public'),
fd AS (SELECT DISTINCT s.file_path AS f, coalesce(t.file_path, 'external') AS t FROM edges e JOIN symbols s ON e.source_id = s.id LEFT JOIN symbols t ON (e.target_id IS NOT NULL AND e.target_id = t.id) OR (e.target_id IS NULL AND e.target_name = t.name) WHERE e.kind = 'calls' AND s.file_path <> coalesce(t.file_path, 'external')),
md AS (SELECT count(*) AS dependencies, count(*) FILTER (WHERE t = 'external') AS external, (SELECT count(*) FROM (SELECT f FROM fd GROUP BY 1 HAVING count(*) > 20)) AS tangled, coalesce(count(*) FILTER (WHERE t = 'external')::DOUBLE / nullif(count(*), 0), 0) AS far FROM fd),
a_mod AS (SELECT dependencies, external, tangled, CAST(least(greatest(CASE WHEN far > 0.5 THEN 5 WHEN far > 0.3 THEN 6 WHEN tangled = 0 THEN 9 - far * 2 ELSE 7 - least(tangled * 0.5, 2) END, 2), 10) AS DOUBLE) AS score FROM md),
a_nam AS (SELECT id, name, kind, CASE WHEN kind IN ('function', 'method') THEN lower(name[1] || regexp_replace(name[2:], '([A-Z])', '_\1', 'g')) WHEN kind = 'constant' THEN upper(name) ELSE array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || lower(w[2:])), '') END AS suggestion FROM symbols
 WHERE (kind IN ('function', 'method') AND NOT regexp_matches(name, '^_?[a-z0-9_]*$')) OR (kind IN ('struct', 'class', 'enum', 'interface', 'type') AND NOT (regexp_matches(name, '^[A-Z]') AND length(name) - length(replace(name, '_', '')) <= 1)) OR (kind = 'constant' AND NOT regexp_matches(name, '^(_?[a-z0-9_]*|[A-Z0-9_]*)$'))),
nm AS (SELECT (SELECT count(*) FROM a_nam) AS bad, count(*) AS n FROM symbols),
parts AS (SELECT 'complexity' AS category, score, 0.25::DOUBLE AS weight FROM a_complexity UNION ALL SELECT 'duplication', CAST(CASE WHEN count(*) = 0 THEN 10 WHEN count(*) <= 2 THEN 8 WHEN count(*) <= 5 THEN 6 ELSE 4 END AS DOUBLE), 0.20 FROM a_dup UNION ALL SELECT 'coverage', score, 0.20 FROM a_cov UNION ALL SELECT 'modularity', score, 0.20 FROM a_mod
 UNION ALL SELECT 'naming', CAST(CASE WHEN n = 0 OR bad <= 0.01 * n THEN 10 WHEN bad <= 0.05 * n THEN 8 WHEN bad <= 0.2 * n THEN 6 WHEN bad <= 0.4 * n THEN 4 ELSE 2 END AS DOUBLE), 0.15 FROM nm)
"""


@query(_AUDIT + "SELECT critical, high, medium, round(score, 9) AS score FROM a_complexity")
def audit_complexity(spark: S, d: D) -> DataFrame:
    return governance.audit_complexity(model(spark, d)).withColumn("score", F.round("score", 9))


@query(_AUDIT + "SELECT stem, n FROM a_dup")
def audit_duplication(spark: S, d: D) -> DataFrame:
    return governance.audit_duplication(model(spark, d))


@query(_AUDIT + "SELECT public, documented, round(score, 9) AS score FROM a_cov")
def audit_coverage(spark: S, d: D) -> DataFrame:
    return governance.audit_coverage(model(spark, d)).withColumn("score", F.round("score", 9))


@query(_AUDIT + "SELECT dependencies, external, tangled, round(score, 9) AS score FROM a_mod")
def audit_modularity(spark: S, d: D) -> DataFrame:
    return governance.audit_modularity(model(spark, d)).withColumn("score", F.round("score", 9))


@query(_AUDIT + "SELECT id, name, kind, suggestion FROM a_nam")
def audit_naming(spark: S, d: D) -> DataFrame:
    return governance.audit_naming(model(spark, d))


@query(_AUDIT + "SELECT category, round(score, 6) AS score, weight FROM parts UNION ALL SELECT 'overall', round(sum(score * weight), 6), 1.0 FROM parts")
def audit_overall(spark: S, d: D) -> DataFrame:
    return governance.audit(model(spark, d)).withColumn("score", F.round("score", 6))


# Snapshots: a day of events is a commit, a user a file.

_SNAP = "WITH snap AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS commit_sha, CAST(date_trunc('day', ts) AS TIMESTAMP) AS committed_at, CAST(user_id AS VARCHAR) AS path, CAST(round(sum(value)) AS BIGINT) AS total_complexity, count(*) FILTER (WHERE event_type = 'error') AS violation_count FROM events GROUP BY 1, 2, 3) "


def _snap(spark: S, d: D) -> DataFrame:
    """Values are added in the order of events, whatever the partitions: sums of doubles depend on it, and so do those that round at a half."""
    day = F.date_trunc("day", "ts")
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("commit_sha"), day.alias("committed_at"), F.col("user_id").cast("string").alias("path"), "event_id", "ts", "value", "event_type")
    keys = ["commit_sha", "committed_at", "path"]
    added = F.sum("value").over(Window.partitionBy(*keys).orderBy("event_id", "ts", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("added", added).groupBy(*keys).agg(F.round(F.max("added")).cast("long").alias("total_complexity"), F.count_if(F.col("event_type") == "error").alias("violation_count"))


@query(_SNAP + "SELECT commit_sha, count(*) AS dup_pairs FROM snap GROUP BY 1")
def trend_duplication(spark: S, d: D) -> DataFrame:
    return governance.trend_duplication(_snap(spark, d)).select("commit_sha", "dup_pairs")


@query(_SNAP + "SELECT commit_sha, CAST(sum(violation_count) AS BIGINT) AS violations FROM snap GROUP BY 1")
def trend_violations(spark: S, d: D) -> DataFrame:
    return governance.trend_violations(_snap(spark, d)).select("commit_sha", "violations")


@query(_SNAP + "SELECT commit_sha, CAST(sum(total_complexity) AS BIGINT) AS mass FROM (SELECT *, percent_rank() OVER (PARTITION BY commit_sha ORDER BY total_complexity) AS pr FROM snap) WHERE pr >= 0.9 GROUP BY 1")
def trend_hotspot_mass(spark: S, d: D) -> DataFrame:
    return governance.trend_hotspot_mass(_snap(spark, d)).select("commit_sha", "mass")


@query(_SNAP + "SELECT commit_sha FROM (SELECT commit_sha, row_number() OVER (ORDER BY commit_sha DESC) - 1 AS p FROM (SELECT DISTINCT commit_sha FROM snap)) WHERE p % 3 = 0")
def sample_every_nth(spark: S, d: D) -> DataFrame:
    return governance.every_nth(_snap(spark, d).select("commit_sha").distinct(), 3, "commit_sha")


@query("SELECT conv_id, turn, running FROM (SELECT *, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM (SELECT conv_id, turn, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) + CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 5 ELSE 0 END AS cost FROM conversations)) WHERE running <= 200")
def budget_stop_greedy(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return budget.stop_greedy(rows, ["turn"], "tokens", 200, "role", 5, ["conv_id"]).select("conv_id", "turn", "running")


@query(
    "WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), w AS (SELECT conv_id, turn, tokens, i, CASE WHEN tokens <= 200 THEN 200 - tokens ELSE 200 END AS rest, tokens <= 200 AS keep FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.turn, c.tokens, c.i, CASE WHEN c.tokens <= w.rest THEN w.rest - c.tokens ELSE w.rest END, c.tokens <= w.rest FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1) SELECT conv_id, turn, tokens FROM w WHERE keep"
)
def budget_skip_greedy(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return budget.skip_greedy(rows, ["turn"], "tokens", 200, "conv_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_props(spark: S, d: D) -> DataFrame:
    return table(spark, d, "events").where(F.col("props").isNotNull()).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT page_id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) FROM pages) GROUP BY 1")
def imports_from_json(spark: S, d: D) -> DataFrame:
    """A page as a module whose imports, in JSON, are its references; pages without any are skipped."""
    from codeloom.operators.imports import file_imports

    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    as_json = F.to_json(F.transform(found, lambda u: F.struct(u.alias("from"), F.array().cast("array<string>").alias("names"))))
    modules = table(spark, d, "pages").select(F.col("page_id").alias("file_path"), as_json.alias("imports"))
    return file_imports(modules).groupBy(F.col("file_path").alias("page_id")).agg(F.count("*").alias("n_links"))


@query("SELECT count(*) AS commits, round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*), 9) AS fix_rate, round(count(*) FILTER (WHERE o_orderstatus = 'P')::DOUBLE / count(*), 9) AS revert_rate FROM orders")
def revert_fix_rate(spark: S, d: D) -> DataFrame:
    """A history with an order for each commit; its status says how the subject begins."""
    from codeloom.sources import gitlog

    start = F.when(F.col("o_orderstatus") == "F", "fix(core): ").when(F.col("o_orderstatus") == "P", 'Revert "').otherwise("fixed ")
    got = gitlog.rework(table(spark, d, "orders").select(F.concat(start, "o_orderpriority").alias("subject")))
    return got.select("commits", F.round("fix_rate", 9).alias("fix_rate"), F.round("revert_rate", 9).alias("revert_rate"))


@query(
    "WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id, sha256(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es') SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1"
)
def incremental_diff(spark: S, d: D) -> DataFrame:
    from codeloom.sources.tables import changes

    docs = table(spark, d, "documents")
    old = docs.where(F.col("lang") != "de").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    edited = F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where(F.col("lang") != "es").select(F.col("doc_id").alias("path"), F.sha2(edited, 256).alias("content_hash"))
    return changes(old, new).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def stream_index_foreach_batch(spark: S, d: D) -> DataFrame:
    from codeloom.streaming.index import drain_to_table

    got = drain_to_table(spark, d, "events", ["event_id"])
    return got.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_events_window(spark: S, d: D) -> DataFrame:
    from codeloom.streaming.index import windowed

    return windowed(spark, d).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT language, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN url LIKE '%.org/%' THEN 'org' WHEN url LIKE '%.net/%' THEN 'net' ELSE 'other' END AS language FROM pages) GROUP BY 1")
def classify_paths(spark: S, d: D) -> DataFrame:
    url = F.col("url")
    kind = F.when(url.like(tx.glob_like("**.org/**")), "org").when(url.like(tx.glob_like("**.net/**")), "net").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("language")).agg(F.count("*").alias("n"))


@query("SELECT kind, n FROM (" + CTES + "SELECT kind, count(*) AS n FROM symbols GROUP BY kind ORDER BY n DESC, kind LIMIT 3)")
def sql_surface(spark: S, d: D) -> DataFrame:
    """A statement of the read-only surface, with its temporary view and row cap."""
    from codeloom.plans.sqlsurface import Surface

    return Surface(model(spark, d)).frame("CREATE TEMP TABLE k AS SELECT kind, count(*) AS n FROM v1.symbols GROUP BY kind; SELECT kind, n FROM k ORDER BY n DESC, kind LIMIT 3")


@query("WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, strlen(html) AS size FROM pages), q AS (SELECT *, string_split(path, '/') AS parts FROM p) SELECT CASE WHEN len(parts) > 2 THEN parts[1] ELSE path END AS entry, len(parts) > 2 AS collapsed, count(*) AS files, CAST(sum(size) AS BIGINT) AS size_bytes FROM q GROUP BY 1, 2")
def tree_files(spark: S, d: D) -> DataFrame:
    """Pages as files: those below one level of folders become a row for each folder."""
    files = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("size_bytes"))
    return metrics.tree_collapse(files, 1)


@query("SELECT label, CAST(64 AS INTEGER) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_metadata(spark: S, d: D) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("provider"), F.lit("given").alias("model"), F.size("embedding").alias("dimension"))
    return metrics.embedding_metadata(e).select(F.col("provider").alias("label"), "dimension", "n")


@query("SELECT event_type, count(*) AS n, CAST(floor(min(epoch(ts))) AS BIGINT) AS first FROM events GROUP BY GROUPING SETS ((event_type), ())")
def pass_through_grouping_sets(spark: S, d: D) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("events_in")
    return spark.sql("SELECT event_type, count(*) AS n, min(unix_timestamp(ts)) AS first FROM events_in GROUP BY GROUPING SETS ((event_type), ())")


