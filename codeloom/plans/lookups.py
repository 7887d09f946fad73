"""Queries of imports, lookups, revisions and renderers over the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import imports, links, lookup, revision, search
from codeloom.plans import adapters as ad
from codeloom.plans import report
from codeloom.plans.adapters import CTES, model, table
from codeloom.plans.queries import RULES, _topk, _vectors, query

S, D = SparkSession, str

#: A part is a file that imports another one, in the form of its language; some of these aren't there.
_IMPORTS = """WITH p AS (SELECT p_partkey AS k, ['py', 'ts', 'rs', 'go', 'c'][p_partkey % 5 + 1] AS ext, 'pkg/m' || (p_size % 6) AS folder, 'm' || (p_partkey // 7 % 8) AS a, 'f' || (p_partkey % 5 + 5 * (p_partkey // 11 % 10)) AS b FROM part),
i AS (SELECT DISTINCT folder || '/f' || (k % 40) || '.' || ext AS path, folder, ext, 'pkg/' || a AS want_folder, 'pkg/' || a || '/' || b || '.' || ext AS want,
 CASE ext WHEN 'py' THEN CASE WHEN k % 2 = 0 THEN 'pkg.' || a || '.' || b ELSE '..' || a || '.' || b END WHEN 'ts' THEN '../' || a || '/' || b WHEN 'rs' THEN 'super::super::' || a || '::' || b || '::Item' WHEN 'go' THEN 'example.com/proj/' || a ELSE a || '/' || b || '.c' END AS spec FROM p),
r AS (SELECT path AS from_file, spec, CASE WHEN ext = 'go' THEN (SELECT min(f.path) FROM i f WHERE f.ext = 'go' AND f.folder = i.want_folder) ELSE (SELECT min(f.path) FROM i f WHERE f.path = i.want) END AS to_file FROM i) """


def _imports(spark: S, d: D) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    step = lambda n: F.floor(k / n)
    ext = F.element_at(F.array(*map(F.lit, ("py", "ts", "rs", "go", "c"))), (k % 5 + 1).cast("int"))
    a, b = F.concat(F.lit("m"), step(7) % 8), F.concat(F.lit("f"), k % 5 + 5 * (step(11) % 10))
    spec = (
        F.when(ext == "py", F.when(k % 2 == 0, F.concat(F.lit("pkg."), a, F.lit("."), b)).otherwise(F.concat(F.lit(".."), a, F.lit("."), b))).when(ext == "ts", F.concat(F.lit("../"), a, F.lit("/"), b))
        .when(ext == "rs", F.concat(F.lit("super::super::"), a, F.lit("::"), b, F.lit("::Item"))).when(ext == "go", F.concat(F.lit("example.com/proj/"), a)).otherwise(F.concat(a, F.lit("/"), b, F.lit(".c")))
    )
    rows = table(spark, d, "part").select(F.concat(F.lit("pkg/m"), F.col("p_size") % 6, F.lit("/f"), k % 40, F.lit("."), ext).alias("file_path"), spec.alias("spec"))
    return rows, rows.select(F.col("file_path").alias("path")).distinct()


@query(_IMPORTS + "SELECT DISTINCT * FROM r WHERE to_file IS NOT NULL")
def imports_resolved(spark: S, d: D) -> DataFrame:
    return imports.resolve_imports(*_imports(spark, d))


@query("SELECT DISTINCT 'lib/' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '/mod.rs' ELSE '/x.y.rs' END AS path, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'x.y' END AS module FROM part")
def module_names(spark: S, d: D) -> DataFrame:
    path = F.concat(F.lit("lib/"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "/mod.rs").otherwise("/x.y.rs"))
    return table(spark, d, "part").select(path.alias("path")).distinct().withColumn("module", imports.module_name(F.col("path"), ("mod", "lib", "main")))


@query(CTES + "SELECT id, name, line_start FROM symbols WHERE file_path = 'Brand#3' ORDER BY line_start, id")
def symbols_of_file(spark: S, d: D) -> DataFrame:
    return lookup.symbols_of_file(model(spark, d), "Brand#3").select("id", "name", "line_start")


@query(CTES + "SELECT id FROM symbols WHERE name = 'red widget' AND file_path = 'Brand#17' ORDER BY id")
def symbol_ids_of_name(spark: S, d: D) -> DataFrame:
    return lookup.symbol_ids(model(spark, d), "Brand#17", "red widget")


@query(CTES + "SELECT id, source_id, target_name FROM edges WHERE kind = 'calls' AND source_id IN (SELECT id FROM symbols WHERE file_path = 'Brand#3')")
def calls_of_file(spark: S, d: D) -> DataFrame:
    return lookup.calls_of_file(model(spark, d), "Brand#3")


@query(CTES + "SELECT 'symbols' AS relation, count(*) AS n FROM symbols UNION ALL SELECT 'ranks', 0 UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def relation_counts(spark: S, d: D) -> DataFrame:
    return lookup.counts(model(spark, d), embeddings=table(spark, d, "embeddings"))


@query(CTES + "SELECT id, name, kind, label FROM symbols JOIN embeddings ON id = CAST(vec_id AS VARCHAR)")
def embedded_symbols(spark: S, d: D) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("symbol_id"), "label")
    return lookup.embedded_symbols(model(spark, d), e).select("id", "name", "kind", "label")


@query(CTES + f"SELECT query_id, rank, id, name, kind, file_path, score FROM ({_topk('l2')}) k JOIN symbols ON id = CAST(vec_id AS VARCHAR)")
def nearest_symbols(spark: S, d: D) -> DataFrame:
    found = search.top_k(*_vectors(spark, d), "l2", 5).withColumn("score", F.round("score", 6))
    return lookup.nearest_symbols(model(spark, d), found)


@query(CTES.rstrip() + ", a AS (SELECT DISTINCT file_path, name FROM symbols WHERE kind <> 'trait'), b AS (SELECT DISTINCT file_path, name FROM symbols WHERE kind <> 'constant') SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def symbol_key_changes(spark: S, d: D) -> DataFrame:
    m = model(spark, d)
    side = lambda kind: ad.CodeModel(m.symbols.where(F.col("kind") != kind), m.edges, m.files)
    return lookup.key_changes(side("trait"), side("constant")).select("change", "file_path", "name")


@query(CTES + "SELECT CASE WHEN path IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'low' WHEN path IN ('Brand#4', 'Brand#5', 'Brand#6', 'Brand#7') THEN 'mid' WHEN regexp_full_match(path, 'Brand#1.') THEN 'top' END AS layer, count(*) AS n FROM files GROUP BY 1")
def layer_counts(spark: S, d: D) -> DataFrame:
    files = model(spark, d).files
    return lookup.layer_counts(files, RULES.layered(files))


_FILES = CTES.rstrip() + ", fd AS (SELECT s.file_path AS f, coalesce(t.file_path, 'external') AS t, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN symbols s ON e.source_id = s.id LEFT JOIN symbols t ON (e.target_id IS NOT NULL AND e.target_id = t.id) OR (e.target_id IS NULL AND e.target_name = t.name) WHERE e.kind = 'calls' AND s.file_path <> coalesce(t.file_path, 'external') GROUP BY 1, 2) "


@query(_FILES + "SELECT f AS from_file, t AS to_file, n AS call_count FROM fd WHERE contains(f, '#12') OR contains(t, '#12') OR contains(f, '#3') OR contains(t, '#3')")
def graph_filtered(spark: S, d: D) -> DataFrame:
    return lookup.filtered_graph(links.file_dependencies(model(spark, d)), "#12, #3")


@query(
    _FILES
    + """SELECT 0 AS section, unnest(['digraph dependencies {', '  rankdir=LR;', '  node [shape=box];']) AS text UNION ALL SELECT DISTINCT 1, '  "' || f || '" [label="' || f || '"];' FROM (SELECT f FROM fd UNION SELECT t FROM fd) WHERE f <> 'external'
UNION ALL SELECT 2, '  "' || f || '" -> "' || t || '" [penwidth=' || CAST(ceil(sqrt(n)) AS BIGINT) || '];' FROM fd WHERE t <> 'external' UNION ALL SELECT 3, '}'"""
)
def graph_dot(spark: S, d: D) -> DataFrame:
    return report.file_graph(links.file_dependencies(model(spark, d)), "dot").select("section", "text")


@query(r"""SELECT doc_id, '<file name="' || doc_id || '.txt" path="/' || source || '/' || doc_id || '.txt">' || chr(10) || replace(replace(replace(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</file>' AS text FROM documents""")
def context_xml(spark: S, d: D) -> DataFrame:
    """Documents as files of their source's folder."""
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    rows = report.documents(files, "xml").where("section = 1")
    return rows.select(F.regexp_extract("place", r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), "text")


@query("SELECT count(*) AS files, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(sum(ceil(strlen(coalesce(text, '')) / 4)) AS BIGINT) AS tokens FROM documents WHERE source = 'src3'")
def token_totals(spark: S, d: D) -> DataFrame:
    return lookup.files_within(table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content")), ["src3"])


def _revision(spark: S, d: D) -> tuple[DataFrame, DataFrame]:
    """Files in Rust were modified and those in Go deleted, and of each the lines of its promoted parts of some sizes changed."""
    files = ad.files(spark, d).where(F.col("language").isin("rust", "go")).select("path", F.when(F.col("language") == "go", "deleted").otherwise("modified").alias("change"))
    size = F.col("p_size")
    ranges = table(spark, d, "part").where((F.col("p_type") == "PROMO") & (size % 17 == 3)).select(F.col("p_brand").alias("file_path"), (size * 7).cast("int").alias("first"), (size * 7 + 4).cast("int").alias("last")).distinct()
    return files, ranges


_REVISION = (
    CTES.rstrip()
    + """, ch AS (SELECT path, CASE language WHEN 'go' THEN 'deleted' ELSE 'modified' END AS change FROM files WHERE language IN ('rust', 'go')),
rg AS (SELECT DISTINCT p_brand AS file_path, p_size * 7 AS a, p_size * 7 + 4 AS b FROM part WHERE p_type = 'PROMO' AND p_size % 17 = 3 AND p_brand IN (SELECT path FROM ch WHERE change <> 'deleted')),
hit AS (SELECT * FROM symbols s WHERE EXISTS (SELECT 1 FROM rg WHERE rg.file_path = s.file_path AND s.line_start <= b AND a <= s.line_end)),
st AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY name ORDER BY file_path, line_start, id) AS i FROM symbols WHERE name IN (SELECT name FROM hit)) WHERE i = 1),
cl AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE kind = 'calls' AND target_id IS NOT NULL),
r1 AS (SELECT DISTINCT a AS id FROM cl WHERE b IN (SELECT id FROM st)), r2 AS (SELECT DISTINCT a AS id FROM cl WHERE b IN (SELECT id FROM r1)), d1 AS (SELECT DISTINCT b AS id FROM cl WHERE a IN (SELECT id FROM st)),
op AS (SELECT path, 1.0::DOUBLE AS priority, change AS reason FROM ch WHERE change <> 'deleted' UNION ALL SELECT file_path, 0.8, 'calls a change' FROM symbols WHERE id IN (SELECT id FROM r1) UNION ALL SELECT file_path, 0.4, 'calls a change' FROM symbols WHERE id IN (SELECT id FROM r2) UNION ALL SELECT file_path, 0.3, 'called by a change' FROM symbols WHERE id IN (SELECT id FROM d1)) """
)


@query(_REVISION + "SELECT path, round(priority, 6) AS priority, reason FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority DESC, reason DESC) AS i FROM op) WHERE i = 1")
def revision_context(spark: S, d: D) -> DataFrame:
    return revision.context(model(spark, d), *_revision(spark, d)).withColumn("priority", F.round("priority", 6))


@query(_REVISION + "SELECT id, name, file_path FROM hit")
def revision_symbols(spark: S, d: D) -> DataFrame:
    return revision.affected(model(spark, d), *_revision(spark, d)).select("id", "name", "file_path")


@query(
    CTES.rstrip()
    + """, g AS (SELECT path FROM files WHERE language = 'rust'), l AS (SELECT id FROM symbols WHERE file_path IN (SELECT path FROM g)), e AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM l))
SELECT 'files' AS relation, count(*) AS n FROM files WHERE path NOT IN (SELECT path FROM g) UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT 'edges', count(*) FROM e
UNION ALL SELECT 'bound', count(*) FROM e WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT id FROM l) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM l)"""
)
def cascade_delete(spark: S, d: D) -> DataFrame:
    from codeloom.sources.tables import cascade

    m = model(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("symbol_id"))
    left = cascade(m.files, m.symbols, m.edges, {"embeddings": e}, m.files.where(F.col("language") == "rust").select("path"))
    left["bound"] = left["edges"].where(F.col("target_id").isNotNull())
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT label AS provider, 'given' AS model, count(*) AS n FROM embeddings WHERE CAST(label AS VARCHAR) <> '1' GROUP BY 1")
def other_providers(spark: S, d: D) -> DataFrame:
    from codeloom.sources.tables import other_providers as others

    e = table(spark, d, "embeddings").select(F.col("label").alias("provider"), F.lit("given").alias("model"))
    return others(e, "1", "given")
