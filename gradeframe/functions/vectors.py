"""Cosine similarity and best sentence matches on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.rounding import clamp
from gradeframe.functions.text import is_blank, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v
    )


def unit(vector: Column) -> Column:
    """Vector scaled to length one; a zero vector stays zero."""
    def scaled(v: Column, norm: Column) -> Column:
        return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))

    return let(vector, lambda v: let(F.sqrt(dot(v, v)), lambda norm: scaled(v, norm)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def similarity(student_text: Column, teacher_text: Column, a: Column, b: Column) -> Column:
    """Cosine limited to [0, 1]; 0 when either text is blank or a vector is missing."""
    blank = is_blank(student_text) | is_blank(teacher_text)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(a, b)))
    return F.when(blank, F.lit(0.0)).otherwise(value)


def best_matches(student: Column, teacher: Column) -> Column:
    """For each student sentence the closest teacher sentence.

    Both arguments are arrays of ``struct(sentence, vector)`` with vectors of
    length one (see :func:`unit`). The comparison stays inside the row of one
    answer: no pair is ever emitted. Ties go to the earlier teacher sentence.
    """
    def best(s: Column) -> Column:
        scored = F.transform(
            teacher,
            lambda t, i: F.struct(
                dot(s["vector"], t["vector"]).alias("score"),
                (-i).alias("order"),
                t["sentence"].alias("match"),
            ),
        )
        top = F.array_max(scored)
        return F.struct(
            s["sentence"].alias("student_sentence"),
            top["match"].alias("best_match_teacher"),
            top["score"].alias("raw"),
        )

    return F.when(F.size(teacher) == 0, F.slice(F.transform(student, best), 1, 0)).otherwise(
        F.transform(student, best)
    )


def match_rows(df: DataFrame, keys: Sequence[str], matches: str) -> DataFrame:
    """One row per student sentence: position, both sentences, shown similarity.

    The generator gets an expression rather than the bare column; for a bare
    column Spark would add a size filter and evaluate all matches once more.
    """
    shown = F.transform(
        matches,
        lambda m: F.struct(
            m["student_sentence"].alias("student_sentence"),
            m["best_match_teacher"].alias("best_match_teacher"),
            shown_similarity(m["raw"]).alias("similarity"),
        ),
    )
    return df.select(*keys, F.posexplode(shown).alias("pos", "_m")).select(*keys, "pos", "_m.*")


def overall_match(matches: Column) -> Column:
    """Mean of the best scores, limited to [0, 1], three decimals; 0 without sentences."""
    total = F.aggregate(matches, F.lit(0.0), lambda s, m: s + m["raw"])
    mean = F.coalesce(F.try_divide(total, F.size(matches)), F.lit(0.0))
    return F.bround(clamp(mean, F.lit(0.0), F.lit(1.0)), 3)


def shown_similarity(raw: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), raw), 3)
