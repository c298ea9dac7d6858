"""From raw documents to training sequences in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written to the
shared folder and read again as the next stage's docs.

Null, blank and short texts fail the quality rules and go in the first stage. Texts of any
length are handled whole. Repeated rows pass the first two stages together, where a later
one loses the lines that an earlier one has, and near-duplicates leave one of them; ties go
to the smaller id. Extra columns go along to the packing, whatever their names. An empty
table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm.common import staged
from gradeframe.llm.decontaminate import drop_contaminated
from gradeframe.llm.line_dedup import drop_repeated_lines
from gradeframe.llm.minhash import keep_one
from gradeframe.llm.packing import pack
from gradeframe.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of lines that an earlier document has."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in training sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("minhash", near_duplicates),
    ("decontamination", decontamination), ("packing", packing),
]

#: The first stage estimates its rules by iteration, which plain SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
