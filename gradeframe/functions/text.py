"""Text clean-up, tokens and coverage as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def digits(text: Column, kind: str = "int") -> Column:
    """A number from text that is either all digits or empty; empty gives null.

    The test comes first because a failed cast is slow: it raises inside the JVM
    even when the result is only null. Pass a materialised column or lambda value.
    """
    return F.when(text != "", text.cast(kind))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind.

    A trim looks at the ends only; a pattern would scan the whole text.
    """
    return F.btrim(text, F.lit(fv.WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Printable ASCII on one line: line ends become sentence ends."""
    printable = F.regexp_replace(text, r"[^\x20-\x7E\n]", " ")
    ended = F.regexp_replace(printable, r"(?<![.!?])\n+", ". ")
    joined = F.regexp_replace(ended, r"([.!?])\n+", "$1 ")
    squeezed = F.regexp_replace(joined, r" {2,}", " ")
    return F.trim(F.regexp_replace(squeezed, r"\.([A-Z])", ". $1"))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def period_sentences(text: Column) -> Column:
    """Split on a period followed by one blank, keeping every piece."""
    return F.split(text, r"\. ")


def tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-case alphabetic tokens without the stop words, in text order."""
    bare = F.transform(
        words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    )
    return F.filter(bare, lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(stop_words))


def keywords(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case ASCII words of three or more letters, minus stop words."""
    found = F.regexp_extract_all(
        F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"), F.lit(0)
    )
    stop = fv.KEYWORD_STOP_WORDS if stop_words is None else stop_words
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(stop)))


def keyword_coverage(student: Column, teacher: Column) -> Column:
    """Share of the teacher's keyword set found in the student's, 1.0 when it is empty.

    Both arguments are keyword arrays (see :func:`keywords`).
    """
    shared = F.size(F.array_intersect(teacher, student))
    return F.when(F.size(teacher) == 0, F.lit(1.0)).otherwise(
        F.bround(shared / F.size(teacher), 4)
    )


def length_norm(student_words: Column, teacher_words: Column) -> Column:
    """Length ratio scaled so that 60 % of the key's length counts as full."""
    ratio = (student_words / teacher_words) / F.lit(fv.FULL_LENGTH_RATIO)
    return F.when(teacher_words == 0, F.lit(1.0)).otherwise(
        F.bround(F.least(F.lit(1.0), ratio), 4)
    )


def word_count(text: Column) -> Column:
    return F.size(words(text))


def real_word_count(text: Column) -> Column:
    """Words holding at least one letter."""
    return F.size(F.filter(words(text), lambda w: w.rlike(r"\p{L}")))


def fix_confusions(text: Column) -> Column:
    """Repair zero/letter-o confusions, squeeze blanks, apply the fixed word list."""
    repaired = F.regexp_replace(text, r"(?U)\b0([a-zA-Z])", "o$1")
    repaired = F.regexp_replace(repaired, r"(?U)([a-zA-Z])0\b", "$1o")
    fixes = F.create_map(*[F.lit(v) for v in chain.from_iterable(fv.OCR_WORD_FIXES.items())])

    def fix(word: Column) -> Column:
        bare = F.btrim(F.lower(word), F.lit(".,;:!?()[]\"'"))
        known = bare.isin(list(fv.OCR_WORD_FIXES))
        return F.when(known, F.replace(word, bare, F.try_element_at(fixes, bare))).otherwise(word)

    return F.array_join(F.transform(words(repaired), fix), " ")


def normalize_label(text: Column) -> Column:
    """Squeeze white space and drop it before closing punctuation."""
    squeezed = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, r"(?U)\s([?.!,;:])", "$1")


def left_chars(text: Column, size: int) -> Column:
    return F.left(text, F.lit(size))


def preview(text: Column, size: int = 120) -> Column:
    """The first ``size`` characters, with an ellipsis only when text was cut."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(
        F.length(whole) > size, F.concat(F.left(whole, F.lit(size)), F.lit("…"))
    ).otherwise(whole)


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Cut text into pieces of ``size``; the last piece ends the text.

    Without overlap every character is in one piece. With overlap each piece
    repeats the last ``overlap`` characters of the one before.
    """
    length = F.length(text)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((length - size) / F.lit(step))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))
    )


def slug(course: Column, exam: Column, set_name: Column) -> Column:
    """Natural key of a paper: ``course_exam_set`` in safe characters."""
    base = F.concat(
        F.coalesce(F.nullif(course, F.lit("")), F.lit("UNKNOWN")), F.lit("_"),
        F.coalesce(F.nullif(exam, F.lit("")), F.lit("EXAM")), F.lit("_"),
        F.coalesce(set_name, F.lit("")),
    )
    safe = F.regexp_replace(F.btrim(base, F.lit("_")), r"[^A-Za-z0-9_\-]", "_")
    return F.left(F.btrim(F.regexp_replace(safe, "_+", "_"), F.lit("_")), F.lit(180))


def discretize(score: Column, step: float = 0.5) -> Column:
    """Truncate a score to a step and scale by ten to an integer; null if it is no number."""
    return F.rint((score / F.lit(step)).try_cast("int") * F.lit(step) * 10).cast("int")


def page_texts(text: Column) -> Column:
    """Pages of typed text: form feeds or three or more line ends part pages."""
    parts = F.transform(F.split(text, r"\f|\n{3,}"), strip)
    return F.filter(parts, lambda p: p != "")
