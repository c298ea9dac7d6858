"""Read an option letter, a truth value or a number out of answer text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def option_letter(text: Column) -> Column:
    """Selected option A–E: the first pattern that matches decides; null if none."""
    return F.upper(F.coalesce(*[_group(text, p) for p in fv.OPTION_PATTERNS]))


def truth_value(text: Column) -> Column:
    """``TRUE`` or ``FALSE`` when only one side's words occur, else null."""
    low = F.lower(text)
    says_true, says_false = low.rlike(fv.TRUE_WORDS), low.rlike(fv.FALSE_WORDS)
    return F.when(says_true & ~says_false, F.lit("TRUE")).when(
        says_false & ~says_true, F.lit("FALSE")
    )


def last_number(text: Column) -> Column:
    """The last number of the text, thousands commas removed; null if none."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(fv.NUMBER), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def number_text(text: Column) -> Column:
    """A number written as text, commas removed; null when it is not a number."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")
