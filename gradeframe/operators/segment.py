"""Split whole booklet and answer-key texts into one row per question.

A document is one row, so all of this is row-local array work: no shuffle, no
window, and no key that could run hot. Stages are separate projections whose
arrays are used more than once by the next stage, which keeps Spark from
inlining an array into a lambda and recomputing it per element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import is_blank, let, strip


def stripped_lines(text: Column) -> Column:
    """Lines without surrounding white space, blank ones removed."""
    return F.filter(F.transform(F.split(text, fv.LINE_BREAK), strip), lambda l: l != "")


def first_marker(line: Column, patterns: Sequence[str], lowest: int, highest: int) -> Column:
    """``struct(number, rest)`` of the first pattern whose number is in range, else null."""
    def attempt(pattern: str) -> Column:
        def parsed(found: Column) -> Column:
            in_range = (found != "") & found.cast("int").between(lowest, highest)
            rest = strip(F.regexp_extract(line, pattern, 2))
            return F.when(in_range, F.struct(found.cast("int").alias("number"), rest.alias("rest")))

        return let(F.regexp_extract(line, pattern, 1), parsed)

    tries = [attempt(pattern) for pattern in patterns]
    return F.coalesce(*tries)


def _starts(lines: str) -> Column:
    """Positions of the marker lines with their number and remaining text."""
    indexed = F.transform(
        lines,
        lambda l, i: F.struct(
            i.alias("at"), l["mark"]["number"].alias("number"), l["mark"]["rest"].alias("rest")
        ),
    )
    return F.filter(indexed, lambda s: s["number"].isNotNull())


def _following(lines: str, starts: str, start: Column, k: Column) -> Column:
    """The line texts between a marker and the next one."""
    stop = F.coalesce(F.get(F.col(starts), k + 1)["at"], F.size(lines))
    between = F.slice(lines, start["at"] + 2, stop - start["at"] - 1)
    return F.transform(between, lambda l: l["line"])


def _merge_repeats(segments: str) -> Column:
    """One entry per number in ascending order; repeats joined by a line end."""
    numbers = F.array_sort(F.array_distinct(F.transform(segments, lambda s: s["number"])))

    def merged(number: Column) -> Column:
        same = F.filter(segments, lambda s: s["number"] == number)
        return F.struct(
            number.alias("question_number"),
            F.array_join(F.transform(same, lambda s: s["text"]), "\n").alias("answer_text"),
        )

    return F.transform(numbers, merged)


def booklet_answers(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per (document, question) of student booklets.

    Adds ``question_number``, ``answer_text``, ``part_name``, ``is_or_option``.
    Text before the first marker is left out; a document without any segment
    becomes question 0 of part ``unknown`` (see :func:`valid_answers`).
    """
    keys = list(keys)
    kept = F.filter(stripped_lines(F.col(text)), lambda l: ~l.contains(fv.PAGE_BREAK))

    def parse(line: Column) -> Column:
        mark = F.when(
            line.rlike(fv.BOOKLET_CANDIDATE),
            first_marker(line, fv.BOOKLET_MARKERS, 1, fv.BOOKLET_LAST_NUMBER),
        )
        return F.struct(line.alias("line"), mark.alias("mark"))

    def segment(start: Column, k: Column) -> Column:
        lead = F.filter(F.array(start["rest"]), lambda r: r != "")
        pieces = F.concat(lead, _following("_lines", "_starts", start, k))
        return F.struct(
            start["number"].alias("number"), strip(F.array_join(pieces, "\n")).alias("text")
        )

    whole = strip(F.replace(F.col(text), F.lit(fv.PAGE_BREAK), F.lit("")))
    fallback = F.filter(
        F.array(F.struct(F.lit(0).alias("question_number"), whole.alias("answer_text"))),
        lambda r: r["answer_text"] != "",
    )
    return (
        documents.select(*keys, text, F.transform(kept, parse).alias("_lines"))
        .select(*keys, text, "_lines", _starts("_lines").alias("_starts"))
        .select(*keys, text, F.transform("_starts", segment).alias("_all"))
        .select(
            *keys, text,
            F.filter("_all", lambda s: F.length(s["text"]) >= fv.BOOKLET_MIN_CHARS).alias("_segments"),
        )
        .select(
            *keys,
            F.inline(F.when(F.size("_segments") == 0, fallback).otherwise(_merge_repeats("_segments"))),
        )
        .withColumn(
            "part_name",
            F.when(F.col("question_number") == 0, "unknown")
            .when(F.col("question_number") >= fv.PART_B_FROM, "Part-B")
            .otherwise("Part-A"),
        )
        .withColumn("is_or_option", F.lit(False))
    )


def valid_answers(answers: DataFrame) -> DataFrame:
    """Answers with a real question number and some text."""
    numbered = F.coalesce(F.col("question_number"), F.lit(0)) != 0
    return answers.filter(numbered & ~is_blank(F.col("answer_text"))).withColumn(
        "answer_text", strip(F.col("answer_text"))
    )


def key_answers(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per (document, question) of answer keys.

    Header and separator lines are skipped. A marker line that only repeats the
    question (ends in ``?``, under 200 characters) contributes no text; the lines
    below it do, once, with any ``Answer:`` prefix removed.
    """
    keys = list(keys)
    skip = fv.KEY_SKIP

    def wanted(line: Column) -> Column:
        return ~(
            line.rlike(fv.KEY_SKIP_CANDIDATE)
            & (line.rlike(skip[0]) | line.rlike(skip[1]) | line.rlike(skip[2]))
        )

    def bare(line: Column) -> Column:
        answer = F.regexp_extract(line, fv.KEY_ANSWER_PREFIX, 1)
        return F.when(answer != "", answer).otherwise(line)

    def parse(line: Column) -> Column:
        mark = F.when(line.rlike(fv.KEY_CANDIDATE), first_marker(line, fv.KEY_MARKERS, 0, 99))
        return F.struct(F.when(mark.isNull(), bare(line)).alias("line"), mark.alias("mark"))

    def segment(start: Column, k: Column) -> Column:
        question_only = start["rest"].endswith("?") & (
            F.length(start["rest"]) < fv.KEY_QUESTION_MAX_CHARS
        )
        lead = F.filter(
            F.array(F.when(question_only, F.lit("")).otherwise(bare(start["rest"]))),
            lambda r: r != "",
        )
        pieces = F.concat(lead, _following("_lines", "_starts", start, k))
        return F.struct(
            start["number"].alias("number"), strip(F.array_join(pieces, " ")).alias("text")
        )

    kept = F.filter(stripped_lines(F.col(text)), wanted)
    return (
        documents.select(*keys, F.transform(kept, parse).alias("_lines"))
        .select(*keys, "_lines", _starts("_lines").alias("_starts"))
        .select(*keys, F.transform("_starts", segment).alias("_all"))
        .select(
            *keys,
            F.filter("_all", lambda s: F.length(s["text"]) >= fv.KEY_MIN_CHARS).alias("_segments"),
        )
        .select(*keys, F.inline(_merge_repeats("_segments")))
    )


def number_segments(rows: Column) -> Column:
    """Write rows back as a numbered booklet text; the inverse of segmentation.

    ``rows`` is an array of ``struct(question_number, answer_text)``.
    """
    return F.array_join(
        F.transform(rows, lambda r: F.concat(r["question_number"].cast("string"), F.lit(". "),
                                             r["answer_text"])),
        "\n",
    )
