"""Rubric coverage from per-criterion probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv


def rubric_coverage(
    answers: DataFrame, scores: DataFrame, threshold: float = 0.5, key: str = "answer_id"
) -> DataFrame:
    """Coverage per answer: marks of criteria at or above the threshold over all marks.

    ``answers`` holds the key and ``question_type``; ``scores`` holds the key,
    ``criterion``, ``marks`` and ``probability``. Objective types and answers
    without criteria get 0 marks, coverage 0 and no criteria. A criterion listed
    twice counts twice in the total but is earned once. Scores are dealt by key once, for
    both aggregations and the join.
    """
    per_criterion = scores.repartition(key).groupBy(key, "criterion").agg(
        F.sum("marks").alias("_listed"),
        F.max("marks").alias("_marks"),
        F.max("probability").alias("_p"),
    )
    hit = F.coalesce(F.col("_p") >= threshold, F.lit(False))
    totals = per_criterion.groupBy(key).agg(
        F.sum("_listed").alias("total_rubric_marks"),
        F.sum(F.when(hit, F.col("_marks")).otherwise(0.0)).alias("earned_rubric_marks"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("criterion", hit.cast("int").alias("v"))))
        ).alias("criteria_scores"),
    )
    open_type = ~F.col("question_type").isin(fv.NO_RUBRIC_TYPES)
    joined = answers.join(totals, key, "left")

    def when_open(name: str):
        return F.when(open_type, F.coalesce(F.col(name), F.lit(0.0))).otherwise(F.lit(0.0))

    ratio = F.try_divide(when_open("earned_rubric_marks"), when_open("total_rubric_marks"))
    return joined.select(
        *answers.columns,
        when_open("total_rubric_marks").alias("total_rubric_marks"),
        when_open("earned_rubric_marks").alias("earned_rubric_marks"),
        F.bround(F.coalesce(ratio, F.lit(0.0)), 3).alias("coverage_ratio"),
        F.when(open_type, F.col("criteria_scores")).alias("criteria_scores"),
    )
