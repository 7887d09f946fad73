"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Every stage's result is a table before the next one reads it. Defined results: null, empty
and blank texts go in the first stage; rows that repeat a doc_id share every decision; rows with a
null doc_id are never near duplicates; texts of any length are processed whole; ties go to the smaller doc_id; empty tables stay empty; extra columns pass through all but
the last stage, which keeps doc_id, lang and source of those that are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _store, bpe, decontaminate, neardup, pii, quality

#: Words in a shingle, and the similarity in hundredths, of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80
#: A document with a window of this many benchmark items goes.
LEAKS = 1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, and that are not toxic."""
    plain, clash = _store.aside(docs, ["p_weak", "score", "n_abusive", "kept", "toxic"])
    return _store.back(quality.classify(plain).where("kept AND NOT toxic"), clash, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    groups = neardup.near_duplicates(docs, SHINGLE, PERCENT)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), items=LEAKS, spans=False)  # what is kept has no window, so no span either


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids."""
    import public_tokenizers

    kept = docs.select(*(c for c in ("doc_id", "lang", "source", "text") if c in docs.columns))
    return bpe.encode(kept, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]

#: SQL can't express the trained scorer, the forest or the encoder; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, _store.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        _store.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
