"""A training corpus from documents: five stages, each a written table.

Toxic documents go, then those that fail the quality rules (frequent lines are
taken out of the others), then all but one of each group of near duplicates,
then those that hold benchmark passages. What is left is packed into sequences
of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import contamination, ngram_join, packing, quality, tokens, toxicity
from sluice.llm.common import written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit. The labels' texts are looked up in the table of documents.

    Null and empty texts score 0 and stay, as do null ids and repeated rows. No rows give none.
    """
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(every, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.withColumn("_toxicity", toxicity.score(model)).filter(f"_toxicity < {toxicity.LIMIT}").select(*DOCUMENT)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without lines above the limits. Null and empty texts fail the base rule; repeated rows are judged alike."""
    kept = quality.judged(docs.select(*DOCUMENT)).filter("_quality.kept")
    return kept.selectExpr("doc_id", "coalesce(_left, text) AS text", "lang", "source",
                           "IF(_left IS NULL, n_chars, CAST(char_length(_left) AS LONG)) AS n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id, one without an id only where no other has one.

    Rows are told apart by a number of their own, so documents that share an
    id but not their text both stay, and of repeated rows one stays. Rows
    without words or text are linked with nothing and stay. No rows give none.
    """
    rows = written(docs.select(*DOCUMENT).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = ngram_join.near_duplicates(rows, id_col="_row").selectExpr("doc_id AS _row", "component_id")
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(
        F.expr("min_by(_row, struct(doc_id IS NULL AS missing, doc_id, _row)) AS _row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*DOCUMENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows. Null and empty texts hold none and stay, as do null ids and repeated rows."""
    hits = contamination.with_hits(docs.select(*DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.filter("size(_hits.spans) = 0").select(*DOCUMENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document; null and empty texts are a piece of the end id alone, repeated rows are packed each."""
    return packing.pack(docs, tokens.default_tokenizer())


STAGES = [("toxicity", toxicity_stage), ("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The stages learn, cluster and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), name)
    return rows
