"""A corpus pipeline of five stages; each takes what the one before kept, written as Parquet and read again.

All stages take documents with nulls in any column, empty and very long texts, repeated rows, equal ids and other columns, whatever
their names; all but the last give the columns COLUMNS. An empty table gives an empty result in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import classifier, decontaminate, linededup, neardup, packing
from jobloom.llm.common import stage_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, columns unchanged; it is fitted on these documents and the folder's labels.

    Null and empty texts count as texts without words; repeated rows stay or go together; labels with null values count as none.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; those of which nothing is left go. n_chars follows the text where lines went.

    The least id keeps a window, null ids first; rows that agree in id and text are one text and keep theirs alike. Null texts and
    those of fewer than three lines pass unchanged.
    """
    out = linededup.remove_repeated_lines(docs.select(*COLUMNS))
    emptied = (F.col("_removed") > 0) & (F.length(F.btrim("text", F.lit(linededup.SPACE + "\n"))) == 0)
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more; the least (id, text hash) stays, null ids first.

    Null texts and texts without a word are copies of one another; of rows that agree in id and text one stays.
    """
    return neardup.one_of_each_group(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, columns unchanged.

    Null and empty texts hold none; null and empty items are held by none; repeated rows stay or go together.
    """
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens; see `packing.packed_documents`.

    Null and empty texts are the end id alone; repeated rows and null ids are packed row by row.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the fitted classifier, fingerprints or tokens; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result but the last is written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), stage_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{at}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
