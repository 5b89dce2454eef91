"""From raw documents to a training mix: five stages, each a table in the shared folder.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  Null texts count as empty, other columns may hold nulls
or clash with no result: stages name their own columns only inside.  An empty table passes through
as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, mixing, quality_rules, simhash
from tidemark.llm.common import remainder, remove, shared_folder, table, whole_row

#: Languages whose score is below this are too uncertain to keep.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of policy v1."""
    kept = quality_rules.rule_ledger(docs.select(whole_row(docs).alias("row"), "text"))
    return kept.where(quality_rules.passes(F.col("ledger.fail_bits"))).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows; it learns from three quarters of those it gets.

    Where none of these has a label, no language is known, so no document stays.
    """
    learn = F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False))
    net = language_id.fit(docs.where(learn).select("doc_id", "lang", "text"))
    found = language_id.identify(docs.select(whole_row(docs).alias("row"), "text"), net)
    return found.where(language_id.accepted(F.col("lang_pred"), F.col("lang_score"), LEAST_SCORE)).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return simhash.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    judged = decontaminate.contamination(docs.select(whole_row(docs).alias("row"), "text"), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("hits.contaminated")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "mixed.*")


STAGES = [("quality rules", quality), ("language ID", language), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", clean_of_benchmark), ("mixing", mixture)]

#: The learned language stage has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written under a new folder and read again.

    A stage's table is deleted once the next one is written; the last stays, as its rows are the result.
    """
    docs, base = table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{base}/{k - 1}.parquet")
    return docs
