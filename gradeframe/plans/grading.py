"""Grade linked answers in one plan without a shuffle of its own.

Input columns of :func:`grade`: ``answer_text``, ``teacher_answer``,
``question_type``, ``max_marks``; optional: ``correct_option`` (key of objective
types), ``llm_score``, ``similarity_score``, ``rubric_score``, ``has_diagram``,
``ocr_confidence``, ``external_option``, ``tolerance``, ``llm_problem``. Work
that depends on the key only is done once per question by :func:`prepare_keys`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import extract, scoring
from gradeframe.functions.rounding import clamp, exact_round, float_text
from gradeframe.functions.text import (
    is_blank, keyword_coverage, keywords, length_norm, normalize, strip, word_count,
)

OPTIONAL = {
    "correct_option": "string", "llm_score": "double", "similarity_score": "double",
    "rubric_score": "double", "has_diagram": "boolean", "ocr_confidence": "double",
    "external_option": "string", "tolerance": "double", "llm_problem": "string",
}


def prepare_keys(questions: DataFrame, teacher: str = "teacher_answer") -> DataFrame:
    """Add ``key_keywords`` and ``key_words`` so they are computed once per question."""
    return questions.withColumns(
        {"key_keywords": keywords(F.col(teacher)), "key_words": word_count(F.col(teacher))}
    )


def with_components(answers: DataFrame) -> DataFrame:
    """Add ``cleaned_text``, ``keyword_score`` and ``length_score``.

    The student's text is compared normalised, the key as written. Types without
    a similarity component, and empty keys, score 0.
    """
    ready = answers if "key_keywords" in answers.columns else prepare_keys(answers)
    applies = F.col("question_type").isin(fv.SIMILARITY_TYPES) & (F.col("teacher_answer") != "")
    cleaned = ready.withColumn("cleaned_text", normalize(F.col("answer_text")))
    found = F.when(applies, keywords(F.col("cleaned_text")))
    counted = cleaned.withColumns(
        {"_found": found, "_words": F.when(applies, word_count(F.col("cleaned_text")))}
    )
    return counted.withColumns({
        "keyword_score": F.when(
            applies, keyword_coverage(F.col("_found"), F.col("key_keywords"))
        ).otherwise(0.0),
        "length_score": F.when(applies, length_norm(F.col("_words"), F.col("key_words"))).otherwise(0.0),
    }).drop("_found", "_words", "key_keywords", "key_words")


def objective_grades(
    answers: DataFrame, question_type: str = "question_type", answer: str = "answer_text",
    key: str = "correct_option", max_marks: str = "max_marks", confidence: str | None = None,
    external_option: str | None = None, tolerance: str | None = None,
) -> DataFrame:
    """Grade option, truth-value and numeric answers.

    Adds ``handled`` (false: the model path decides), ``detected_answer``,
    ``expected_answer``, ``is_correct``, ``objective_score`` and ``feedback``. An
    external option counts only when none was read and the page was recognised
    with little confidence. The steps are separate projections because each
    result is used several times by the next.
    """
    kind, text, marks = F.col(question_type), F.col(answer), F.col(max_marks)
    is_mcq, is_bool, is_num = kind == "mcq", kind == "true_false", kind == "numerical"
    lettered = F.when(is_mcq, extract.option_letter(text))
    if external_option:
        sure = F.coalesce(F.col(confidence), F.lit(1.0)) if confidence else F.lit(1.0)
        offered = F.nullif(F.upper(F.trim(external_option)), F.lit(""))
        lettered = F.coalesce(lettered, F.when(is_mcq & (sure < fv.LOW_OCR_CONFIDENCE), offered))
    limit = F.coalesce(F.col(tolerance), F.lit(fv.NUMERIC_TOLERANCE)) if tolerance else F.lit(
        fv.NUMERIC_TOLERANCE
    )
    read = answers.withColumns({
        "_wanted": F.when((is_mcq | is_bool) & ~is_blank(F.col(key)), F.upper(strip(F.col(key)))),
        "_read": F.when(is_mcq, lettered).when(is_bool, extract.truth_value(text)),
        "_number": F.when(is_num, extract.last_number(text)),
        "_target": F.when(is_num, extract.number_text(F.col(key))),
    })
    comparable = F.col("_number").isNotNull() & F.col("_target").isNotNull()
    coded = is_mcq | is_bool
    seen = read.withColumns({
        "handled": F.coalesce(coded | (is_num & comparable), F.lit(False)),
        "detected_answer": F.when(
            coded, F.when(F.col("_wanted").isNotNull(), F.col("_read"))
        ).when(comparable, float_text(F.col("_number"))),
        "expected_answer": F.when(coded, F.col("_wanted")).when(
            comparable, float_text(F.col("_target"))
        ),
        "is_correct": F.when(
            coded,
            F.when(
                F.col("_wanted").isNotNull(),
                F.coalesce(F.col("_read") == F.col("_wanted"), F.lit(False)),
            ),
        ).when(comparable, scoring.numeric_hit(F.col("_number"), F.col("_target"), limit)),
    })
    return seen.withColumns({
        "objective_score": F.when(
            F.col("handled"), F.when(F.col("is_correct"), marks).otherwise(F.lit(0.0))
        ),
        "feedback": F.when(
            F.col("handled"),
            scoring.outcome_text(
                kind, F.col("is_correct"), F.col("detected_answer"), F.col("expected_answer")
            ),
        ),
    }).withColumns({
        c: F.coalesce(F.col(c), F.lit("")) for c in ("detected_answer", "expected_answer")
    }).drop("_wanted", "_read", "_number", "_target")


def grade(answers: DataFrame, weights: Mapping[str, float] = fv.HYBRID_WEIGHTS) -> DataFrame:
    """Grade every row by its type; a row that cannot be graded becomes a zero row.

    Adds the components, ``detected_answer``, ``expected_answer``, ``is_correct``,
    ``final_score``, ``feedback`` and ``status`` (``evaluated`` or ``error``).
    """
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in answers.columns}
    rows = with_components(answers.withColumns(missing) if missing else answers)
    rows = objective_grades(
        rows, confidence="ocr_confidence", external_option="external_option", tolerance="tolerance"
    )
    # blank answers never reach a model and score 0 on that component
    blank = is_blank(F.col("answer_text"))
    llm = F.when(blank, F.lit(0.0)).otherwise(F.coalesce("llm_score", F.lit(0.0)))
    hybrid = scoring.hybrid_score(
        llm, F.col("similarity_score"),
        F.when(F.col("question_type") == "open_ended", F.col("rubric_score")),
        F.col("keyword_score"), F.col("length_score"), F.col("max_marks"), weights,
    )
    by_model = F.when(F.col("question_type").isin(fv.SIMILARITY_TYPES), hybrid).otherwise(llm)
    problem = F.when(F.col("max_marks").isNull(), "no marks given").otherwise(F.col("llm_problem"))
    graded = (
        rows.withColumn(
            "_raw", F.when(F.col("handled"), F.col("objective_score")).otherwise(by_model)
        )
        .withColumn("_capped", clamp(F.col("_raw"), F.lit(0.0), F.col("max_marks")))
        .withColumn("_score", exact_round(F.col("_capped"), 2))
        .withColumn("_problem", problem)
    )
    floored = F.when(
        F.col("question_type") == "diagram",
        scoring.with_floor(F.col("_score"), F.col("has_diagram"), F.col("max_marks")),
    ).otherwise(F.col("_score"))
    failed = F.col("_problem").isNotNull()
    return graded.withColumns({
        "final_score": F.when(failed, F.lit(0.0)).otherwise(floored),
        "feedback": F.when(failed, F.col("_problem")).otherwise(F.col("feedback")),
        "status": F.when(failed, "error").otherwise("evaluated"),
    }).drop("handled", "objective_score", "_raw", "_capped", "_score", "_problem", *missing)
