"""Equi-joins that tie answers, questions, papers, rubrics and results together.

Lookup sides are reduced to one row per key first, so a join never multiplies
rows. No side is hinted as broadcast: Spark does that itself when its statistics
show the side is small, and otherwise splits hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.scoring import marks_or_default, type_or_default
from gradeframe.functions.text import is_blank
from gradeframe.operators.keyed import first_per_key
from gradeframe.operators.skew import optional_lookup, split_lookup


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns]
    )


def resolve_questions(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Attach to each answer its question, adding ``question`` (struct) and ``matched_by``.

    A stored ``exam_question_id`` wins; then the question of the answer's paper
    with the same number and alternative flag; then any with the same number.
    Among equals the lowest id wins. Only ids are folded and looked up; the
    question rows, whose ``id`` is unique, are joined once, by the id that was found.
    """
    spread_by = list(answers.columns)
    known = questions.select(F.col("id").alias("exam_question_id"), F.lit(True).alias("_known"))
    folded = questions.groupBy("paper_id", "question_number").agg(
        F.min(F.when(~F.col("is_or_option"), F.col("id"))).alias("_plain"),
        F.min(F.when(F.col("is_or_option"), F.col("id"))).alias("_alternative"),
        F.min("id").alias("_any"),
    )
    stored = F.when(F.col("_known"), F.col("exam_question_id"))
    same_flag = F.when(F.col("is_or_option"), F.col("_alternative")).otherwise(F.col("_plain"))
    matched_by = (
        F.when(stored.isNotNull(), "stored_id")
        .when(same_flag.isNotNull(), "number_and_flag")
        .when(F.col("_any").isNotNull(), "number")
    )
    found = (
        optional_lookup(answers, known, "exam_question_id", spread_by)
        .join(folded, ["paper_id", "question_number"], "left")
        .select(*answers.columns, F.coalesce(stored, same_flag, F.col("_any")).alias("_found"), matched_by.alias("matched_by"))
    )
    rows = questions.select(F.col("id").alias("_found"), F.struct(*questions.columns).alias("question"))
    return optional_lookup(found, rows, "_found", spread_by).select(*answers.columns, "question", "matched_by")


def dispositions(resolved: DataFrame, failed: Column | None = None) -> DataFrame:
    """Why an answer is or is not graded; the first reason that applies wins.

    Also flattens the question with the usual defaults for marks, type and texts.
    """
    failed = F.lit(False) if failed is None else failed
    question = F.col("question")
    reason = (
        F.when(question.isNull(), "no_question")
        .when(is_blank(F.col("answer_text")), "empty_answer")
        .when(is_blank(question["teacher_answer"]), "no_key")
        .when(failed, "error")
        .otherwise("evaluated")
    )
    return resolved.select(
        *[c for c in resolved.columns if c != "question"],
        question["id"].alias("resolved_question_id"),
        F.coalesce(question["teacher_answer"], F.lit("")).alias("teacher_answer"),
        question["correct_option"].alias("correct_option"),
        F.when(question.isNotNull(), marks_or_default(question["marks"])).alias("max_marks"),
        F.when(question.isNotNull(), type_or_default(question["question_type"])).alias(
            "question_type"
        ),
        reason.alias("status"),
    )


def link_at_ingest(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Exact link on (paper, number, flag): adds ``exam_question_id``, ``linked_to_eq``."""
    keys = ["paper_id", "question_number", "is_or_option"]
    ids = questions.groupBy(*keys).agg(F.min("id").alias("exam_question_id"))
    return (
        answers.drop("exam_question_id")
        .join(ids, keys, "left")
        .withColumn("linked_to_eq", F.col("exam_question_id").isNotNull())
    )


def primary_question(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Lookup among the non-alternative questions only; unmatched requests drop out."""
    plain = first_per_key(
        questions.filter(~F.col("is_or_option")), ["paper_id", "question_number"], F.col("id")
    )
    return requests.join(plain, ["paper_id", "question_number"])


def with_rubrics(questions: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Add ``rubric``: the criteria of each question in id order, null when it has none."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "criterion", "marks")))
    nested = rubrics.groupBy("exam_question_id").agg(
        F.transform(
            ordered,
            lambda r: F.struct(r["criterion"].alias("criterion"), r["marks"].alias("marks")),
        ).alias("rubric")
    )
    return questions.join(
        nested.withColumnRenamed("exam_question_id", "id"), "id", "left"
    )


def apply_question(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Fill a request from its stored question.

    Texts given in the request stay; the marks are always the question's; the
    question's rubric is used only when the request brings none. ``questions``
    carries a ``rubric`` column (see :func:`with_rubrics`).
    """
    side = questions.select(
        F.col("id").alias("exam_question_id"),
        F.col("marks").alias("_marks"),
        F.col("question_text").alias("_text"),
        F.col("teacher_answer").alias("_key"),
        F.col("rubric").alias("_rubric"),
        F.lit(True).alias("_hit"),
    )
    given = F.when(F.size("rubric") > 0, F.col("rubric"))
    joined = split_lookup(requests, side, "exam_question_id")
    filled = {
        "max_marks": F.when(F.col("_hit"), F.col("_marks")).otherwise(F.col("max_marks")),
        "question": F.coalesce(F.nullif(F.col("question"), F.lit("")), F.col("_text")),
        "teacher_answer": F.coalesce(
            F.nullif(F.col("teacher_answer"), F.lit("")), F.col("_key"), F.lit("")
        ),
        "rubric": F.coalesce(given, F.col("_rubric")),
    }
    return joined.withColumns(filled).select(*requests.columns)


def lookup_papers(requests: DataFrame, papers: DataFrame, ref: str = "paper_ref") -> DataFrame:
    """Resolve a paper reference: its slug, else its numeric id when all digits."""
    slugs = papers.groupBy("paper_id").agg(F.min("id").alias("_by_slug"))
    ids = papers.select(F.col("id").alias("_number"), F.col("id").alias("_by_id"))
    number = F.when(F.col(ref).rlike(r"^\d+$"), F.col(ref).try_cast("long"))
    by_slug = requests.join(slugs, F.col(ref) == F.col("paper_id"), "left").withColumn(
        "_number", F.when(F.col("_by_slug").isNull(), number)
    )
    return optional_lookup(by_slug, ids, "_number", requests.columns).select(
        *requests.columns, F.coalesce(F.col("_by_slug"), F.col("_by_id")).alias("paper_fk")
    )


def paper_of_booklet(
    booklets: DataFrame, papers: DataFrame, override: str = "paper_override"
) -> DataFrame:
    """The caller's paper when it exists, else the stored one; ``rejected`` when neither."""
    slugs = papers.groupBy(F.col("paper_id").alias(override)).agg(F.min("id").alias("_override_fk"))
    stored = papers.select(F.col("id").alias("exam_paper_id"), F.col("id").alias("_stored_fk"))
    resolved = F.coalesce(F.col("_override_fk"), F.col("_stored_fk"))
    overridden = optional_lookup(booklets, slugs, override, booklets.columns)
    return optional_lookup(overridden, stored, "exam_paper_id", booklets.columns).select(
        *booklets.columns,
        resolved.alias("resolved_paper_id"),
        resolved.isNull().alias("rejected"),
    )


def submissions_with_results(
    submissions: DataFrame, students: DataFrame, results: DataFrame
) -> DataFrame:
    """Every submission with its student code and a result struct, null when ungraded."""
    codes = students.select(F.col("id").alias("student_id"), "student_code")
    shown = ["question_type", "final_score", "max_marks", "mcq_correct", "feedback"]
    graded = results.select(
        F.col("submission_id").alias("id"),
        F.struct(*shown).alias("result"),
    )
    coded = optional_lookup(submissions, codes, "student_id", submissions.columns)
    return coded.join(graded, "id", "left")


def result_detail(
    results: DataFrame, submissions: DataFrame, papers: DataFrame, questions: DataFrame,
    default_marks: float = 10.0,
) -> DataFrame:
    """A result with the paper and question it belongs to; both may be absent."""
    subs = submissions.select(
        F.col("id").alias("submission_id"), "exam_paper_id", "exam_question_id"
    )
    paper = papers.select(
        F.col("id").alias("exam_paper_id"), F.col("paper_id").alias("paper_slug"), "course_name"
    )
    question = questions.select(
        F.col("id").alias("exam_question_id"), "question_number", "question_text"
    )
    found = results.withColumn("max_marks", F.coalesce("max_marks", F.lit(default_marks))).join(
        subs, "submission_id"
    )
    papered = optional_lookup(found, paper, "exam_paper_id", ["submission_id"])
    return optional_lookup(papered, question, "exam_question_id", ["submission_id"])


def linked(answers: DataFrame, questions: DataFrame) -> DataFrame:
    return answers.join(_question_keys(questions), _KEYS, "left_semi")


def unlinked(answers: DataFrame, questions: DataFrame) -> DataFrame:
    return answers.join(_question_keys(questions), _KEYS, "left_anti")


_KEYS = ["paper_id", "question_number", "is_or_option"]


def _question_keys(questions: DataFrame) -> DataFrame:
    return questions.select(*_KEYS)


def booklets_of_paper(booklets: DataFrame, papers: DataFrame, paper_slug: str | None) -> DataFrame:
    """Booklets of one paper; no slug or an unknown slug leaves the list unfiltered."""
    if not paper_slug:
        return booklets
    wanted = papers.filter(F.col("paper_id") == paper_slug).agg(F.min("id")).scalar()
    return booklets.filter(F.coalesce(F.col("exam_paper_id") == wanted, wanted.isNull()))


def pending(answers: DataFrame) -> DataFrame:
    """Answers not graded yet."""
    return answers.filter(~F.coalesce(F.col("evaluated"), F.lit(False)))
