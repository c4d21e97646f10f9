"""A corpus from documents to packed sequences: language, copies, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents (doc_id, text, lang, source, n_chars). run() writes each stage to the shared folder and reads it back.
Stages that number the rows of their input and read it again take it from files, or write it first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import exact_dedup, language_id, mixing, near_dedup, packing
from tremor.session import fixed, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows with unknown language, or whose best language is less probable than this, are rejected.
LEAST_SCORE = 0.5
#: DuckDB has no counterpart of the classifier, the shingle hashes and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null text, text without a letter, and text of no clear language. The model learns from labelled rows of its input."""
    model = language_id.train(language_id.learnable(docs))
    kept = language_id.predict(docs, model, *COLUMNS)
    return kept.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    docs = fixed(docs)
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__uid"))
    dropped = exact_dedup.exact_dedup(docs.select("doc_id", "text")).filter(~F.col("kept")).select(F.col("uid").alias("__uid"))
    return rows.join(dropped, "__uid", "left_anti").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (SimHash of five-word shingles, then exact Jaccard of at least 0.8) stays: the one with the smallest doc_id (null last), then the first."""
    docs = fixed(docs)
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__uid"))
    found = stored(near_dedup.components_of(docs.select("doc_id", "text")), "near")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stay = stay.select("root", F.col("best.uid").alias("stays"))
    dropped = found.join(stay, "root").filter(F.col("uid") != F.col("stays")).select(F.col("uid").alias("__uid"))
    return rows.join(dropped, "__uid", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes all of it, and once more cut to its first words where it takes a part, in the order of the schedule."""
    both = mixing.scheduled(fixed(docs), COLUMNS, "__use")
    text = F.when(F.col("__use") == 0, F.col("text")).otherwise(mixing.first_words(F.col("text"), F.col("__use")))
    return both.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("__use") == 0, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
