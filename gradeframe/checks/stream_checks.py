"""Incremental grading over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe.checks.registry import Tables, check
from gradeframe.plans.grading import grade
from gradeframe.session import fresh_dir
from gradeframe.streaming import incremental as inc

KEYS = ["conv_id", "turn"]
RESULT = (
    "conv_id long, turn long, version long, question_type string, final_score double, max_marks double, "
    "similarity_score double, mcq_detected_answer string, mcq_correct_answer string"
)


def _grade(rows: DataFrame) -> DataFrame:
    """Grade conversation turns on length, or on the letters they name."""
    asked = rows.select(
        *KEYS, "version", F.col("text").alias("answer_text"), F.lit("a key of several words").alias("teacher_answer"),
        F.when(F.col("role") == "system", "mcq").otherwise("diagram").alias("question_type"),
        F.lit(10.0).alias("max_marks"), F.lit("B").alias("correct_option"),
        (F.length("text") % 11).cast("double").alias("llm_score"),
        (F.col("conv_id") % 10 / 10).alias("similarity_score"),
    )
    return grade(asked).withColumnsRenamed(
        {"detected_answer": "mcq_detected_answer", "expected_answer": "mcq_correct_answer"}
    )


def _run(t: Tables) -> str:
    """Grade the conversation table as a stream; later, user turns come again, patched.

    Both arrive in three files, so the number of batches does not follow the files of
    the table: every batch writes the buckets it touches anew, here all of them.
    Returns the result folder.
    """
    from pyspark.sql.types import StructType

    folder, source = fresh_dir(t.spark, "graded"), fresh_dir(t.spark, "arriving")
    schema = StructType.fromDDL(RESULT)
    turns = t.conversations.withColumn("version", F.lit(1).cast("long"))
    patched = turns.filter("role = 'user'").withColumns(
        {"text": F.concat(F.lit("patched "), F.col("text")), "version": F.lit(2).cast("long")}
    )
    for rows in (turns, patched):
        rows.repartition(3, *KEYS).write.mode("append").parquet(f"{source}/conversations.parquet")
        stream = inc.stream_table(t.spark, source, "conversations", turns.schema, 2)
        inc.grade_stream(stream, _grade, schema, KEYS, folder)
    return folder


_TURNS = """turns AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'patched ' || text ELSE text END AS text,
    CASE role WHEN 'user' THEN 2 ELSE 1 END AS version FROM conversations),
  scored AS (SELECT *, CASE WHEN trim(text) = '' THEN 0.0 ELSE least(length(text) % 11, 10)::DOUBLE END AS score FROM turns)"""


@check(
    "incremental_grading", "I1",
    f"""WITH {_TURNS} SELECT conv_id, turn, CASE role WHEN 'system' THEN 'mcq' ELSE 'diagram' END AS question_type, version::BIGINT AS version,
      version::INT AS batches, CASE WHEN role <> 'system' THEN score END AS final_score FROM scored""",
)
def _(t: Tables) -> DataFrame:
    """Every turn is graded once for each version; the newest grade counts."""
    from pyspark.sql.types import StructType

    folder = _run(t)
    schema = StructType.fromDDL(RESULT)
    counts = inc.read_history(t.spark, folder, schema).groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("batches"))
    return inc.current_results(t.spark, folder, schema, KEYS).join(counts, KEYS).select(
        *KEYS, "question_type", "version", "batches",
        F.when(F.col("question_type") == "diagram", F.col("final_score")).alias("final_score"),
    )


@check(
    "incremental_snapshot", "I2 A10 D20",
    f"""WITH {_TURNS}, p AS (SELECT score AS a, 10 * coalesce(nullif(conv_id % 10 / 10, 0), 0.5) AS g FROM scored WHERE role <> 'system')
    SELECT (SELECT count(*) FROM scored) AS total_evaluated, count(*) AS n_open, round(avg(abs(a - g)), 6) AS mae, round(corr(a, g), 6) AS pearson_r FROM p""",
)
def _(t: Tables) -> DataFrame:
    stored = inc.stored_snapshot(t.spark, _run(t))
    opened = F.from_json("open_ended", "n_samples long, mae double, pearson_r double")
    return stored.withColumn("o", opened).select(
        "total_evaluated", F.col("o.n_samples").alias("n_open"), F.round("o.mae", 6).alias("mae"),
        F.round("o.pearson_r", 6).alias("pearson_r"),
    )


@check(
    "pending_after_patch", "I1 A14",
    """SELECT count(*) AS pending FROM conversations WHERE role = 'user'""",
)
def _(t: Tables) -> DataFrame:
    """Patched turns carry a higher version and are the only ones pending again."""
    graded = t.conversations.select(*KEYS, F.lit(1).alias("version"))
    patched = t.conversations.select(
        *KEYS, "text", F.when(F.col("role") == "user", 2).otherwise(1).alias("version")
    )
    left = inc.not_yet_graded(patched, graded, KEYS, "version")
    return left.agg(F.count(F.lit(1)).alias("pending"))
