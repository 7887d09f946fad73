"""Secret scans over a ledger of content-addressed blobs.

Every text is a blob, named by its SHA-256. The ledger says which (blob, rule version) pairs have
been scanned and what was found; a scan reads only blobs that the ledger lacks for the present rules,
each once however many paths hold it, and findings are joined back to all paths.

Only Spark's own functions run here. Kinds: assign, access, hex, and pem (private key headers). A null
text is an empty blob. Repeated paths each get the findings. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spans, _store

BASE = ("assign", "access", "hex")
#: Changes whenever a pattern or a threshold does; blobs are then due for another scan.
RULES = "2024.1"

ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+[A-Za-z0-9+/_.=-]++"""
ASSIGN = ASSIGN.replace("(?:(?i)", "(?i:", 1)
VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+([A-Za-z0-9+/_.=-]++)"""
#: A run that is too short holds no long enough one, so the length can be part of these two.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
PEM = r"-----BEGIN (?:[A-Z0-9]++ )*+PRIVATE KEY-----"

LEDGER = "blob string, rule_version string, findings " + _spans.SPAN


def found(text: Column) -> Column:
    """All spans of a text, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    flat = lambda v: lambda hit, around: F.lit(v)
    return F.array_sort(
        F.concat(
            _spans.spans(text, "assign", 1, ASSIGN, lambda h: F.char_length(F.regexp_extract(h, VALUE, 1)) >= 6, flat(0.7)),
            _spans.spans(text, "access", 2, ACCESS, lambda h: h.isNotNull(), flat(1.0), "AKIA"),
            _spans.spans(text, "hex", 3, HEX, lambda h: h.isNotNull(), flat(0.5)),
            _spans.spans(text, "pem", 4, PEM, lambda h: h.isNotNull(), flat(1.0), "-----BEGIN "),
        )
    )


def addressed(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text) of docs; blob is the SHA-256 of the text's UTF-8 bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


class Ledger:
    """Findings by (blob, rule version), as an append-only table at `at`."""

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark, self.at = spark, at or _store.folder(spark, "blob-ledger")

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.at)

    def scan(self, docs: DataFrame, path: str = "doc_id", text: str = "text", rules: str = RULES) -> DataFrame:
        """Scans what is unseen, adds it to the ledger, and gives (path, blob, findings) of every row of docs.

        One path stands for each blob (the smallest); partial sums keep groups of copies small. The text
        crosses the network once, to meet the short list of paths that stand for unseen blobs.
        """
        named = addressed(docs, path, text)
        paths = _store.cut(named.select("path", "blob"), "blob-paths")
        known = self.read().where(F.col("rule_version") == rules).select("blob")
        due = paths.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
        texts = named.join(due.withColumnRenamed("path", "due_path").withColumnRenamed("blob", "due_blob").hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("due_path")) & (F.col("blob") == F.col("due_blob")), "left_semi")
        # Rows that repeat both path and text would be scanned twice; the ledger takes them once.
        fresh = texts.select("blob", F.lit(rules).alias("rule_version"), found(F.col("text")).alias("findings"))
        fresh.write.mode("append").parquet(self.at)
        hits = self.read().where((F.col("rule_version") == rules) & (F.size("findings") > 0))
        # Written by itself, so that the join's two sides are plain exchanges, which AQE can split where a third of all paths hold one blob.
        rows = _store.cut(hits.select("blob", "findings").dropDuplicates(["blob"]), "findings")
        return paths.join(rows, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(_spans.SPAN)))
