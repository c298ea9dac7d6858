"""Deterministic and hybrid scores, outcome texts and grade bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.rounding import clamp, exact_round


def weight_warning(weights: Mapping[str, float]) -> str | None:
    """Why a set of weights is off, or None; checked on the driver before planning."""
    total = sum(weights.values())
    if abs(total - 1.0) <= fv.WEIGHT_SUM_TOLERANCE:
        return None
    side = "inflated" if total > 1.0 else "deflated"
    return f"weights sum to {total:.4f}, not 1.0: scores are {side}"


def hybrid_score(
    llm: Column,
    similarity: Column,
    rubric: Column,
    keyword: Column,
    length: Column,
    max_marks: Column,
    weights: Mapping[str, float] = fv.HYBRID_WEIGHTS,
) -> Column:
    """Weighted sum of the components times the marks, before rounding.

    An absent component counts as 0.
    """
    llm_ratio = F.coalesce(F.when(max_marks > 0, llm / max_marks), F.lit(0.0))

    def share(name: str, value: Column) -> Column:
        return F.lit(weights[name]) * F.coalesce(value, F.lit(0.0))

    combined = (
        F.lit(weights["llm"]) * llm_ratio
        + share("similarity", similarity)
        + share("rubric", rubric)
        + share("keyword", keyword)
        + share("length", length)
    )
    return combined * max_marks


def final_score(score: Column, max_marks: Column) -> Column:
    """Clamp to ``[0, max_marks]`` and round to two decimals; pass a plain column."""
    return exact_round(clamp(score, F.lit(0.0), max_marks), 2)


def marks_or_default(marks: Column) -> Column:
    """Marks, with null and 0 read as the default."""
    return F.coalesce(F.nullif(marks, F.lit(0.0)), F.lit(fv.DEFAULT_MARKS))


def type_or_default(question_type: Column) -> Column:
    return F.coalesce(F.nullif(question_type, F.lit("")), F.lit("open_ended"))


def grade_band(percentage: Column) -> Column:
    return (
        F.when(percentage >= fv.PASS_PERCENT, "pass")
        .when(percentage >= fv.BORDERLINE_PERCENT, "borderline")
        .otherwise("fail")
    )


def with_floor(score: Column, has_diagram: Column, max_marks: Column) -> Column:
    """A detected drawing earns at least a fifth of the marks."""
    floor = max_marks * fv.DIAGRAM_FLOOR
    return F.when(
        F.coalesce(has_diagram, F.lit(False)) & (score < floor), F.bround(floor, 2)
    ).otherwise(score)


def numeric_hit(detected: Column, expected: Column, tolerance: Column) -> Column:
    """Within the relative tolerance or within a thousandth; null if not comparable."""
    gap = F.abs(detected - expected)
    return (gap <= F.abs(expected * tolerance)) | (gap < fv.NUMERIC_FLOOR)


def outcome_text(
    question_type: Column, correct: Column, detected: Column, expected: Column
) -> Column:
    """One line of feedback for an objective grade."""
    seen = F.coalesce(F.nullif(detected, F.lit("")), F.lit(fv.FEEDBACK_UNCLEAR))
    wrong = F.format_string(fv.FEEDBACK_WRONG, seen, expected)
    is_type = lambda name: question_type == name
    verdict = lambda right, other: F.when(correct, right).otherwise(other)
    return (
        F.when(is_type("mcq") & expected.isNull(), F.lit(fv.FEEDBACK_NO_OPTION))
        .when(is_type("true_false") & expected.isNull(), F.lit(fv.FEEDBACK_NO_TRUTH))
        .when(is_type("mcq"), verdict(F.format_string(fv.FEEDBACK_OPTION, detected), wrong))
        .when(is_type("true_false"), verdict(F.format_string(fv.FEEDBACK_TRUTH, expected), wrong))
        .when(is_type("numerical"), verdict(
            F.format_string(fv.FEEDBACK_NUMBER, detected, expected),
            F.format_string(fv.FEEDBACK_NUMBER_OFF, detected, expected)))
    )


def uses_components(question_type: Column) -> Column:
    """Which score components apply to a type, as a struct of flags."""
    hybrid = question_type.isin(fv.SIMILARITY_TYPES)
    return F.struct(
        hybrid.alias("similarity"),
        (question_type == "open_ended").alias("rubric"),
        hybrid.alias("keyword"),
        hybrid.alias("length"),
        question_type.isin("mcq", "true_false", "numerical").alias("objective"),
        (question_type == "diagram").alias("diagram_floor"),
    )
