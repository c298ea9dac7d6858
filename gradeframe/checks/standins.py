"""Exam tables derived from the driver tables, row for row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.checks.registry import Tables

KINDS = ["mcq", "true_false", "fill_blank", "short_answer", "numerical", "open_ended", "diagram", ""]


def qa_pairs(t: Tables) -> DataFrame:
    """A user turn as the student's answer, the reply that follows as the key."""
    said = t.conversations
    student = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("student"))
    teacher = said.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("teacher")
    )
    return student.join(teacher, ["conv_id", "turn"])


@lru_cache(maxsize=1)
def question_id(t: Tables) -> Column:
    """Keys and quantity of an order line as one number, the same as in the SQL.

    It is a ``bigint`` as there while all of the table's numbers fit in 64 bits. Order keys
    above 18 million exceed them; the number is a decimal then, because the SQL's 64-bit
    product would overflow.
    """
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rest = (F.col("l_partkey") * 5000 + F.col("l_suppkey")) * 64 + F.col("l_quantity").cast("long")
    factor = 200000 * 5000 * 64
    most = t.lineitem.agg(F.max(line).alias("line"), F.max(rest).alias("rest")).first()
    fits = (most["line"] or 0) * factor + (most["rest"] or 0) < 2**63
    return line.cast("bigint" if fits else "decimal(20,0)") * factor + rest


def questions(t: Tables) -> DataFrame:
    """Order lines as questions of the paper with the order's number."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_partkey") % 8 + 1).cast("int"))
    return t.lineitem.select(
        question_id(t).alias("id"),
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_linenumber").alias("question_number"),
        (F.col("l_returnflag") == "R").alias("is_or_option"),
        F.when(F.col("l_quantity") == 50, None).when(F.col("l_quantity") == 49, 0.0)
        .otherwise(F.col("l_quantity") % 12 + 1).alias("marks"),
        kind.alias("question_type"),
        F.when(F.col("l_discount") > 0.09, "").otherwise(
            F.concat(F.lit("key "), F.col("l_partkey").cast("string"))
        ).alias("teacher_answer"),
        F.substring(F.lit("ABCDE"), (F.col("l_suppkey") % 5 + 1).cast("int"), F.lit(1)).alias(
            "correct_option"
        ),
        F.concat(F.lit("Question "), F.col("l_partkey").cast("string")).alias("question_text"),
        F.when(F.col("l_linenumber") >= 4, "Part-B").otherwise("Part-A").alias("part_name"),
    )


def answers(t: Tables) -> DataFrame:
    """Order lines as answers of the booklet with the order's number."""
    shift = F.when(F.col("l_tax") > 0.07, 1).otherwise(0)
    return t.lineitem.select(
        question_id(t).alias("id"),
        F.col("l_orderkey").alias("booklet_id"),
        F.col("l_orderkey").alias("paper_id"),
        (F.col("l_linenumber") + shift).cast("int").alias("question_number"),
        (F.col("l_linestatus") == "F").alias("is_or_option"),
        F.when(F.col("l_returnflag") == "A", question_id(t)).alias("exam_question_id"),
        F.when(F.col("l_quantity") < 3, "  ").otherwise(
            F.concat(F.lit("text "), F.col("l_suppkey").cast("string"))
        ).alias("answer_text"),
        (F.col("l_tax") > 0.06).alias("evaluated"),
        (F.col("l_quantity") % 7).alias("score"),
    )


def papers(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("paper_id"),
        F.col("o_orderpriority").alias("course_name"),
        F.col("o_totalprice").alias("total_marks"),
        F.col("o_orderdate").alias("parsed_at"),
        F.col("o_orderstatus").alias("state"),
    )


def marked(t: Tables, marks: Sequence[tuple[str, str]]) -> DataFrame:
    """Documents whose line-initial capitals are preceded by marker text."""
    text = F.concat(F.lit("\n"), F.col("text"))
    for letter, marker in marks:
        text = F.replace(text, F.lit("\n" + letter), F.lit("\n" + marker + letter))
    return t.documents.select("doc_id", text.alias("text"))


def marked_sql(marks: Sequence[tuple[str, str]]) -> str:
    """The same documents in SQL, as relation ``marked(doc_id, text)``."""
    text = "chr(10) || text"
    for letter, marker in marks:
        to = marker.replace("'", "''").replace("\n", "' || chr(10) || '")
        text = f"replace({text}, chr(10) || '{letter}', chr(10) || '{to}{letter}')"
    return f"marked AS (SELECT doc_id, {text} AS text FROM documents)"
