"""Keyed table maintenance as DataFrame-to-DataFrame steps.

Each function returns the new state of a table; the caller writes it. Changed
keys come in as a batch that is small next to the table, so the joins against it
are anti or left joins on the key that Spark broadcasts when they fit.

A batch may hold several rows for one key. ``arrived`` names the column that orders
them; the last one wins, as if the rows had been applied one by one. Without it the
batch must be unique per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from gradeframe import fixed_values as fv
from gradeframe.functions.text import is_blank
from gradeframe.operators.keyed import first_per_key, last_per_key


def replace_by_key(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` replace all rows of ``table`` that share their key."""
    touched = batch.select(*keys).distinct()
    return table.join(touched, list(keys), "left_anti").unionByName(batch)


def keep_missing(table: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def final_rows(batch: DataFrame, keys: Sequence[str], arrived: str | None) -> DataFrame:
    """One row per key of a batch: the last to arrive, without the order column."""
    return batch if arrived is None else last_per_key(batch, keys, F.col(arrived)).drop(arrived)


def upsert_papers(
    papers: DataFrame, parts: DataFrame, questions: DataFrame,
    new_papers: DataFrame, new_parts: DataFrame, new_questions: DataFrame,
    arrived: str | None = None,
) -> dict[str, DataFrame]:
    """Replace papers by slug together with their parts and questions.

    Headers of known slugs are overwritten, their children are dropped and
    inserted anew. ``status`` lists each incoming slug as created or updated. With
    ``arrived``, which then orders all three batches, a slug that comes twice keeps
    its last header and the children that came with it.
    """
    if arrived is not None:
        last = new_papers.groupBy("paper_id").agg(F.max(arrived).alias(arrived))
        new_parts, new_questions = (
            children.join(last, ["paper_id", arrived], "left_semi").drop(arrived) for children in (new_parts, new_questions)
        )
        new_papers = final_rows(new_papers, ["paper_id"], arrived)
    known = papers.select("paper_id").distinct().withColumn("_known", F.lit(True))
    status = new_papers.join(known, "paper_id", "left").select(
        "paper_id", F.when(F.col("_known"), "updated").otherwise("created").alias("status")
    )
    touched = new_papers.select("paper_id").distinct()
    return {
        "papers": replace_by_key(papers, new_papers, ["paper_id"]),
        "parts": keep_missing(parts, touched, ["paper_id"]).unionByName(new_parts),
        "questions": keep_missing(questions, touched, ["paper_id"]).unionByName(new_questions),
        "status": status,
    }


def link_answer_key(questions: DataFrame, keys: DataFrame, arrived: str | None = None) -> DataFrame:
    """Set the key text on all questions of a paper with that number, both alternatives.

    ``keys`` holds (paper_id, question_number, answer_text).
    Adds ``key_linked`` to tell touched rows apart.
    """
    keys = final_rows(keys, ["paper_id", "question_number"], arrived)
    new = keys.select("paper_id", "question_number", F.col("answer_text").alias("_new"))
    return (
        questions.join(new, ["paper_id", "question_number"], "left")
        .withColumn("key_linked", F.col("_new").isNotNull())
        .withColumn("teacher_answer", F.coalesce("_new", "teacher_answer"))
        .select(*questions.columns, "key_linked")
    )


def key_link_counts(linked_questions: DataFrame, keys: DataFrame) -> DataFrame:
    """Per paper: question rows updated and answers extracted."""
    updated = linked_questions.groupBy("paper_id").agg(
        F.count_if("key_linked").alias("answers_linked")
    )
    extracted = keys.groupBy("paper_id").agg(F.count(F.lit(1)).alias("total_answers_extracted"))
    return extracted.join(updated, "paper_id", "left").select(
        "paper_id",
        F.coalesce("answers_linked", F.lit(0).cast("long")).alias("answers_linked"),
        "total_answers_extracted",
    )


def patch_rows(
    table: DataFrame, patches: DataFrame, keys: Sequence[str], order: str,
    always: Mapping[str, Column] | None = None, arrived: str | None = None,
) -> DataFrame:
    """Overwrite non-null patch fields on the first row of each key.

    ``order`` decides which row is first. ``always`` sets further columns on the
    patched row, such as resetting a flag. Of several patches for one key the last
    value of each field wins.
    """
    keys = list(keys)
    fields = [c for c in patches.columns if c not in keys and c != arrived]
    if arrived is not None:
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrived))).alias(c) for c in fields]
        patches = patches.groupBy(*keys).agg(*latest) if latest else patches.select(*keys).distinct()
    first = table.groupBy(*keys).agg(F.min(order).alias("_first"))
    side = (
        patches.join(first, keys)
        .withColumnRenamed("_first", order)
        .select(*keys, order, *[F.col(c).alias("_p_" + c) for c in fields], F.lit(True).alias("_hit"))
    )
    changes = {c: F.coalesce(F.col("_p_" + c), F.col(c)) for c in fields}
    for name, value in (always or {}).items():
        changes[name] = F.when(F.col("_hit"), value).otherwise(F.col(name))
    return table.join(side, [*keys, order], "left").withColumns(changes).select(*table.columns)


def patch_questions(questions: DataFrame, patches: DataFrame, arrived: str | None = None) -> DataFrame:
    return patch_rows(questions, patches, ["paper_id", "question_number"], "id", arrived=arrived)


def patch_answers(answers: DataFrame, patches: DataFrame, arrived: str | None = None) -> DataFrame:
    """Correct an answer's text; the answer becomes pending again."""
    return patch_rows(
        answers, patches, ["booklet_id", "question_number"], "id", {"evaluated": F.lit(False)}, arrived
    )


def replace_rubrics(
    rubrics: DataFrame, uploads: DataFrame, exam_questions: DataFrame, legacy_questions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace the rubric set of each uploaded question.

    The id is looked up among the exam questions first, then the legacy ones.
    Returns the new rubric table and the uploads that match neither.
    """
    current = exam_questions.select(F.col("id").alias("_current")).distinct()
    legacy = legacy_questions.select(F.col("id").alias("_legacy")).distinct()
    resolved = (
        uploads.join(current, F.col("upload_id") == F.col("_current"), "left")
        .join(legacy, F.col("upload_id") == F.col("_legacy"), "left")
        .withColumn("exam_question_id", F.col("_current"))
        .withColumn("question_id", F.when(F.col("_current").isNull(), F.col("_legacy")))
    )
    found = resolved.filter("exam_question_id is not null or question_id is not null")
    rejected = resolved.filter("exam_question_id is null and question_id is null")
    kept = rubrics.join(
        found.select("exam_question_id").filter("exam_question_id is not null").distinct(),
        "exam_question_id", "left_anti",
    ).join(
        found.select("question_id").filter("question_id is not null").distinct(),
        "question_id", "left_anti",
    )
    columns = ["exam_question_id", "question_id", "criterion", "marks"]
    return (
        kept.select(*columns).unionByName(found.select(*columns)),
        rejected.select(*uploads.columns),
    )


def replace_results(results: DataFrame, batch: DataFrame, arrived: str | None = None) -> DataFrame:
    """One result per submission: the batch replaces what is stored."""
    return replace_by_key(results, final_rows(batch, ["submission_id"], arrived), ["submission_id"])


def newest_results(history: DataFrame, version: str) -> DataFrame:
    """One result per submission from an append-only history: the newest wins."""
    return last_per_key(history, ["submission_id"], F.col(version))


def delete_papers(
    papers: DataFrame, parts: DataFrame, questions: DataFrame, doomed: DataFrame
) -> dict[str, DataFrame]:
    """Remove papers by slug with their parts and questions."""
    return {
        "papers": keep_missing(papers, doomed, ["paper_id"]),
        "parts": keep_missing(parts, doomed, ["paper_id"]),
        "questions": keep_missing(questions, doomed, ["paper_id"]),
    }


def delete_booklets(booklets: DataFrame, answers: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    return {
        "booklets": keep_missing(booklets, doomed, ["booklet_id"]),
        "answers": keep_missing(answers, doomed, ["booklet_id"]),
    }


def student_code(explicit: Column, register_number: Column, roll_number: Column) -> Column:
    """The explicit code, else the register number, else the roll number."""
    return F.coalesce(
        F.nullif(explicit, F.lit("")),
        F.nullif(register_number, F.lit("")),
        F.nullif(roll_number, F.lit("")),
    )


def get_or_create_students(students: DataFrame, covers: DataFrame) -> DataFrame:
    """Students plus one new row per unseen code on the covers.

    An explicitly given code is only looked up, never created.
    """
    code = student_code(F.lit(None), F.col("register_number"), F.col("roll_number"))
    fresh = (
        covers.filter(F.coalesce(F.col("student_code"), F.lit("")) == "")
        .select(code.alias("student_code"))
        .filter("student_code is not null")
        .distinct()
        .join(students.select("student_code"), "student_code", "left_anti")
        .withColumn("name", F.concat(F.lit("Student "), F.col("student_code")))
    )
    return students.unionByName(fresh, allowMissingColumns=True)


def conform(df: DataFrame, schema: StructType, defaults: Mapping[str, object]) -> DataFrame:
    """Bring old rows to the current schema: cast, add missing columns, fill defaults.

    Applying it twice changes nothing.
    """
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults and field.name not in df.columns:
            value = F.lit(defaults[field.name]).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Normalise the coded fields and list every broken rule in ``problems``."""
    kind = F.lower(F.trim("question_type"))
    option = F.upper(F.trim("correct_option"))
    rules = {
        "question_type": ~F.coalesce(kind.isin([*fv.QUESTION_TYPES, "auto"]), F.lit(False)),
        "correct_option": ~F.coalesce(option.isin(fv.OPTION_LETTERS), F.lit(True)),
        "max_marks": ~F.coalesce(F.col("max_marks") > 0, F.lit(False)),
        "question_text": is_blank(F.col("question_text")) | (F.length("question_text") < 5),
        "teacher_answer": is_blank(F.col("teacher_answer")) | (F.length("teacher_answer") < 5),
        "question_number": ~F.coalesce(F.col("question_number") >= 1, F.lit(False)),
    }
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return requests.withColumns(
        {"problems": problems, "question_type": kind, "correct_option": option}
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rows set aside with their problems."""
    ok = F.size("problems") == 0
    return checked.filter(ok).drop("problems"), checked.filter(~ok)


def first_of_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Keep the first row of each key in the given order."""
    return first_per_key(df, keys, *order)
