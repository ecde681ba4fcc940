"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality filter, near-duplicate removal, removal of repeated strings, benchmark decontamination, packing.  All stages but
the last return the columns of documents; each works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import decontamination, near_duplicates, packing, quality, suffix_dedup
from tallybrook.llm._common import delete_path, fresh_path, prepare, table, written
from tallybrook.llm.queries import vocabulary


BATCH_ROWS = 1_000  # rows that go to a worker at a time: texts of some kilobytes make batches of a few megabytes


def lean(spark: SparkSession) -> None:
    """Set up the workers; the session's Arrow batches are BATCH_ROWS at most, as executors hold several at a time."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 1 stay; null texts are judged as empty ones, an empty table stays empty."""
    lean(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays, null ids last; of repeated rows one stays, and all
    texts without words, null or empty, stay."""
    lean(spark)
    return near_duplicates.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 200 bytes that occur again go from the texts; n_chars follows, where docs have it.

    All rows stay; null texts stay null, and texts of nothing but repeats become empty.
    """
    lean(spark)
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay."""
    lean(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in sequences of 4096; a null or empty text is one piece of the end id alone."""
    lean(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", drop_repeated_strings),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted once the next one is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        before, path = path, fresh_path(spark, f"stage-{k}")
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            delete_path(spark, before)
    return docs
