"""Score sheets: CSV rows with a teacher score and an optional second score."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gradeframe.plans.scorer import apply_scorer
from gradeframe.sources.tables import read_csv

SHEET_SCHEMA = StructType(
    [
        StructField("student_id", StringType()),
        StructField("question", StringType()),
        StructField("teacher_score", DoubleType()),
        StructField("max_marks", DoubleType()),
        StructField("student_answer", StringType()),
        StructField("teacher_answer", StringType()),
        StructField("ai_score", DoubleType()),
    ]
)

Scorer = Callable[[pd.DataFrame], pd.Series]


def read_score_sheet(spark: SparkSession, path: str, line_ends: bool = True) -> DataFrame:
    """A sheet by column name; ``line_ends=False`` splits large files, see :func:`read_csv`."""
    return read_csv(spark, path, SHEET_SCHEMA, line_ends=line_ends)


def scored_sheet(sheet: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Make sure every row has ``ai_score`` and ``failed``.

    An existing ``ai_score`` column is used; otherwise the scorer is called, and a
    row it fails on scores 0 and is marked failed; with neither, an error.
    """
    if "ai_score" in sheet.columns:
        return sheet.withColumn("failed", F.lit(False))
    if scorer is None:
        raise ValueError("the sheet has no ai_score column and no scorer was given")
    return apply_scorer(sheet, scorer, "ai_score").withColumn(
        "failed", F.col("problem").isNotNull()
    ).drop("problem")
