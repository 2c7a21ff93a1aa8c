"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes what its predecessor kept and returns a DataFrame; ``run`` writes each stage's rows as a
table in the shared checkpoint folder and reads them again, so that a lost executor never costs more than
the stage at hand. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontamination, lines, packing, quality, simhash
from roadloom.llm.common import hinted, table
from roadloom.llm.queries import vocabulary
from roadloom.session import stored

#: Rows of an Arrow batch at most: five stages share the executors, whose Python workers keep little beside the heap.
BATCH_ROWS = 2000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS`` where it is larger; results do not depend on it."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of label 1 stay."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share go from all but one; documents stay, with what is left of them."""
    small_batches(spark)
    kept = lines.drop_shared_lines(docs)
    changed = F.col("n_dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id; null ids stay too.

    Near-duplicates have a Jaccard similarity of 0.8 or more of their shingles of five words, as for every
    stage without a contract of its own: wide SimHashes meet at anchors, and exact similarities decide.
    """
    small_batches(spark)
    groups = simhash.similar_texts(docs)
    copies = hinted(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    leaks = hinted(decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Fingerprints, trained models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; the session's Arrow batch size is given back at the end."""
    before = spark.conf.get(ARROW_ROWS)
    docs = table(spark, sf_dir, "documents")
    try:
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return docs
