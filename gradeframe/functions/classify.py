"""Question types from wording, and from model replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import is_blank, strip, word_count


def compact_type(text: Column) -> Column:
    """Question type by the first compact rule that matches."""
    low, chain = F.lower(text), None
    for kind, pattern, lowered in fv.COMPACT_RULES:
        hit = (low if lowered else text).rlike(pattern)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("open_ended")


def classify(question: Column) -> Column:
    """Struct of ``question_type``, ``confidence``, ``reasoning``, ``method`` by rule."""
    text = strip(question)
    low = F.lower(text)
    lettered = text.rlike(fv.CLASSIFY_OPTION_CASED)
    for pattern in fv.CLASSIFY_OPTION:
        lettered = lettered | low.rlike(pattern)
    hits = [
        lettered,
        low.rlike(fv.CLASSIFY_TRUE_FALSE),
        low.rlike(fv.CLASSIFY_BLANK),
        low.rlike(fv.CLASSIFY_COMPUTE) & low.rlike(fv.CLASSIFY_QUANTITY),
        low.rlike(fv.CLASSIFY_DRAW),
        low.rlike(fv.CLASSIFY_SHORT) & (word_count(text) < fv.SHORT_QUESTION_WORDS),
        low.rlike(fv.CLASSIFY_ESSAY),
    ]

    def outcome(kind: str, confidence: float, reason: str) -> Column:
        return F.struct(
            F.lit(kind).alias("question_type"),
            F.lit(confidence).alias("confidence"),
            F.lit(reason).alias("reasoning"),
            F.lit("rule_based").alias("method"),
        )

    chain = F.when(is_blank(question), outcome("open_ended", 0.0, "empty question"))
    for hit, rule in zip(hits, fv.CLASSIFIER_RULES):
        chain = chain.when(hit, outcome(*rule))
    return chain.otherwise(outcome(*fv.CLASSIFIER_RULES[-1]))


def classify_with_reply(question: Column, reply: Column) -> Column:
    """Use the model's reply when it names a known type, else the rules."""
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"```json|```", "")
    body = F.from_json(
        F.regexp_extract(bare, r"(?s)\{.*\}", 0),
        "question_type string, confidence string, reasoning string",
    )
    kind = F.lower(F.trim(body["question_type"]))
    from_model = F.struct(
        kind.alias("question_type"),
        F.coalesce(body["confidence"].try_cast("double"), F.lit(0.8)).alias("confidence"),
        F.coalesce(body["reasoning"], F.lit("")).alias("reasoning"),
        F.lit("llm").alias("method"),
    )
    usable = kind.isin(fv.QUESTION_TYPES) & ~is_blank(question)
    return F.when(usable, from_model).otherwise(classify(question))
