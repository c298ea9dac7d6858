"""Roll-ups, listings and reports over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.rounding import exact_sum, percent
from gradeframe.functions.scoring import grade_band


def _with_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
                name: str) -> DataFrame:
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(
        F.count(F.lit(1)).alias(name)
    )
    return parents.join(counts, parent_key, "left").withColumn(
        name, F.coalesce(name, F.lit(0).cast("long"))
    )


def papers_listing(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """Papers with their question count, newest first."""
    return _with_count(papers, questions, "id", "paper_id", "num_questions").orderBy(
        F.desc("parsed_at"), "id"
    )


def booklets_listing(booklets: DataFrame, answers: DataFrame) -> DataFrame:
    """Booklets with their answer count, newest first."""
    return _with_count(booklets, answers, "booklet_id", "booklet_id", "num_answers").orderBy(
        F.desc("parsed_at"), "booklet_id"
    )


def system_stats(results: DataFrame) -> DataFrame:
    """Totals over all results.

    The average score divides by all rows, ungraded ones included; the average
    time leaves out missing and zero times.
    """
    total = F.count(F.lit(1))
    score = F.try_divide(F.sum(F.coalesce("final_score", F.lit(0.0))), total)
    return results.agg(
        total.alias("evaluated"),
        F.count_if(F.col("question_type") == "mcq").alias("mcq_evaluated"),
        F.count_if(F.col("question_type") == "open_ended").alias("open_ended_evaluated"),
        F.bround(F.coalesce(score, F.lit(0.0)), 2).alias("average_score"),
        F.bround(
            F.coalesce(F.avg(F.nullif("evaluation_time_sec", F.lit(0.0))), F.lit(0.0)), 2
        ).alias("average_evaluation_time_sec"),
    )


def booklet_totals(graded: DataFrame, key: str = "booklet_id") -> DataFrame:
    """Obtained and possible marks per booklet over the evaluated rows, with grade band.

    Marks are added exactly, so a share half-way between two roundings falls the same way
    in whatever order the rows come.
    """
    done = F.col("status") == "evaluated"
    totals = graded.groupBy(key).agg(
        F.coalesce(exact_sum(F.when(done, F.col("final_score"))), F.lit(0.0)).alias("_obtained"),
        F.coalesce(exact_sum(F.when(done, F.col("max_marks"))), F.lit(0.0)).alias("_possible"),
        F.count_if(done).alias("evaluated"),
        F.count(F.lit(1)).alias("pending"),
    )
    obtained, possible = F.bround("_obtained", 2), F.bround("_possible", 2)
    share = percent(F.col("_obtained"), F.col("_possible"))
    return totals.select(
        key,
        obtained.alias("total_obtained"),
        possible.alias("total_possible"),
        share.alias("percentage"),
        grade_band(share).alias("grade_band"),
        F.concat_ws(" / ", F.col("evaluated").cast("string"), F.col("pending").cast("string")).alias(
            "progress"
        ),
    )


def batch_summary(graded: DataFrame, by: Sequence[str] = (), score: str | None = None) -> DataFrame:
    """Evaluated, failed and total rows, and the sum of ``score`` if one is named."""
    sums = [F.sum(score).alias(score)] if score else []
    return graded.groupBy(*by).agg(
        *sums,
        F.count_if(F.col("status") == "evaluated").alias("evaluated"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count(F.lit(1)).alias("total"),
    )


def key_readiness(questions: DataFrame, by: Sequence[str] = ("paper_id",)) -> DataFrame:
    """Questions with a key text against all questions, per paper."""
    return questions.groupBy(*by).agg(
        F.count_if(F.length("teacher_answer") > 0).alias("answered"),
        F.count(F.lit(1)).alias("total"),
    )


def paper_insight(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """Marks without alternatives, question count and keys ready, per paper."""
    sums = questions.groupBy(F.col("paper_id").alias("id")).agg(
        F.sum(
            F.when(F.col("is_or_option"), 0.0).otherwise(F.coalesce("marks", F.lit(0.0)))
        ).alias("_sum"),
        F.count(F.lit(1)).alias("num_questions"),
        F.count_if(F.length("teacher_answer") > 0).alias("answers_ready"),
    )
    zero = F.lit(0).cast("long")
    return papers.join(sums, "id", "left").select(
        *papers.columns,
        F.coalesce(F.nullif("_sum", F.lit(0.0)), "total_marks").alias("correct_total"),
        F.coalesce("num_questions", zero).alias("num_questions"),
        F.coalesce("answers_ready", zero).alias("answers_ready"),
    )


def nested_document(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str],
                    unique: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs.

    ``unique`` names the columns that identify a child within its parent; later
    copies (by ``order``) are dropped before the collection, so an array holds
    at most one entry per question number and flag.
    """
    from gradeframe.operators.keyed import first_per_key

    single = first_per_key(children, [key, *unique], *[F.col(c) for c in order])
    rest = [*order, *[c for c in children.columns if c not in (key, *order)]]
    nested = single.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*rest))).alias(name)
    )
    return parents.join(nested, key, "left")


def mark_sheet(graded: DataFrame, student: str, question: str, score: str,
               questions: Sequence[int]) -> DataFrame:
    """One row per student: marks per question and the total."""
    sums = [
        F.bround(F.sum(F.when(F.col(question) == q, F.col(score))), 2).alias(f"q{q}")
        for q in questions
    ]
    return graded.groupBy(student).agg(*sums, F.bround(F.sum(score), 2).alias("total"))


def score_distribution(scores: DataFrame, ai: str, teacher: str, max_marks: float,
                       bins: int) -> DataFrame:
    """Histogram of both score columns side by side; the maximum falls in the last bin."""
    def bucket(value: Column) -> Column:
        return F.least(
            F.greatest(F.width_bucket(value, F.lit(0.0), F.lit(max_marks), F.lit(bins)), F.lit(1)),
            F.lit(bins),
        )

    both = scores.select(
        F.inline(
            F.array(
                F.struct(bucket(F.col(ai)).alias("bin"), F.lit(1).alias("a"), F.lit(0).alias("t")),
                F.struct(bucket(F.col(teacher)).alias("bin"), F.lit(0).alias("a"), F.lit(1).alias("t")),
            )
        )
    ).filter("bin is not null")
    return both.groupBy("bin").agg(
        F.sum("a").alias("ai_count"), F.sum("t").alias("teacher_count")
    )


def disagreement_ranking(scores: DataFrame, question: str, ai: str, teacher: str) -> DataFrame:
    """Questions by mean absolute difference, largest first."""
    return scores.groupBy(question).agg(
        F.bround(F.avg(F.abs(F.col(ai) - F.col(teacher))), 6).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    ).orderBy(F.desc("mae"), question)


def export_rows(graded: DataFrame) -> DataFrame:
    """Evaluated rows in the column order of the result export."""
    return graded.filter(F.col("status") == "evaluated").select(
        "question_number", "part_name", "question_type", "final_score", "max_marks", "feedback"
    )
