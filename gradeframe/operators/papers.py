"""Read question papers: header fields, parts, and questions with alternatives.

A paper is one text cell, so all of it is row-local array work: lines are parsed once
into an array, numbered and part lines bound stretches of it, and each question is made
from the stretches around its number. No shuffle, no window, one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.classify import compact_type
from gradeframe.functions.text import digits, let, strip
from gradeframe.operators.keyed import first_per_key
from gradeframe.operators.segment import first_marker


def _found(line: Column, pattern: str) -> Column:
    return F.nullif(strip(F.regexp_extract(line, pattern, 1)), F.lit(""))


def header_fields(lines: str) -> Column:
    """Header struct from the line array: the last matching line wins per field."""
    rules: dict[str, list[str]] = {}
    for pattern, field in fv.HEADER_RULES:
        rules.setdefault(field, []).append(pattern)
    fields = []
    for field, patterns in rules.items():
        values = F.array_compact(
            F.transform(lines, lambda l: F.coalesce(*[_found(l, p) for p in reversed(patterns)]))
        )
        value = F.try_element_at(values, F.lit(-1))
        if field == "course_name":
            value = strip(F.get(F.split(value, fv.COURSE_NAME_CUT), F.lit(0)))
        if field == "total_marks":
            value = F.coalesce(value.try_cast("double"), F.lit(0.0))
        elif field == "duration_hours":
            value = F.coalesce(value.try_cast("double"), F.lit(fv.DEFAULT_DURATION_HOURS))
        else:
            value = F.coalesce(value, F.lit(""))
        fields.append(value.alias(field))
    return F.struct(*fields)


def marks_per_question(line: Column) -> Column:
    """Marks stated in a part header: ``(7 x 2 = 14)`` or ``12 Marks Each``; else null."""
    def found(pattern: str, group: int) -> Column:
        return let(F.regexp_extract(line, pattern, group), lambda x: digits(x, "double"))

    return F.coalesce(found(fv.MARKS_PRODUCT, 2), found(fv.MARKS_EACH, 1))


def _part_headers(lines: str) -> Column:
    def header(line: Column, i: Column) -> Column:
        letter = F.upper(_found(line, fv.PART_HEADER))
        default = F.when(letter == "A", fv.PART_A_MARKS).otherwise(fv.OTHER_PART_MARKS)
        marks = F.coalesce(
            marks_per_question(line), marks_per_question(F.get(F.col(lines), i + 1)), default
        )
        return F.when(
            letter.isNotNull(),
            F.struct(
                letter.alias("letter"),
                marks.alias("marks_per_question"),
                F.coalesce(_found(line, fv.PART_INSTRUCTIONS), F.lit("")).alias("instructions"),
            ),
        )

    return F.array_compact(F.transform(lines, header))


def _first_headers(headers: str) -> Column:
    """The first header of each letter; a lone Part A when there is none."""
    letters = F.array_distinct(F.transform(headers, lambda h: h["letter"]))
    firsts = F.transform(
        letters, lambda l: F.get(F.filter(headers, lambda h: h["letter"] == l), F.lit(0))
    )
    lone = F.array(
        F.struct(
            F.lit("A").alias("letter"),
            F.lit(fv.PART_A_MARKS).alias("marks_per_question"),
            F.lit("").alias("instructions"),
        )
    )
    return F.when(F.size(headers) == 0, lone).otherwise(firsts)


def without_outcome_tags(text: Column) -> Column:
    """Drop course-outcome tags and squeeze white space.

    The cheap test keeps the Unicode word-boundary search to texts that need it.
    """
    untagged = F.when(
        text.rlike(fv.OUTCOME_CANDIDATE), F.regexp_replace(text, fv.COURSE_OUTCOME_TAG, "")
    ).otherwise(text)
    return strip(F.regexp_replace(untagged, r"\s{2,}", " "))


def _starts_with_any(words: Sequence[str], institution: str | None) -> str:
    extra = [institution] if institution else []
    return "(?iU)^(" + "|".join([*words, *extra]) + r")\b"


def is_header_line(line: Column, institution: str | None = None) -> Column:
    """Header, instruction or marks line that carries no question text."""
    return line.rlike(_starts_with_any(fv.FLOW_SKIP_WORDS, institution)) | line.rlike(fv.MARKS_LINE)


def paper_lines(documents: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per paper: its non-blank lines with their numbers, and its parts."""
    rows = F.transform("_lines", lambda l, i: F.struct(i.alias("line_no"), strip(l).alias("line")))
    return (
        documents.select(*keys, F.split(text, fv.LINE_BREAK).alias("_lines"))
        .select(*keys, "_lines", _part_headers("_lines").alias("_headers"))
        .select(*keys, F.filter(rows, lambda r: r["line"] != "").alias("_rows"),
                _first_headers("_headers").alias("_parts"))
    )


def _running_letters(bounds: Column, first: Column) -> Column:
    """For each bound the last letter stated at or before it, in one walk over the array."""
    stated = F.filter(
        F.transform(bounds, lambda b, i: F.struct(i.alias("at"), b["letter"].alias("letter"))),
        lambda s: s["letter"].isNotNull(),
    )
    starts = F.concat(F.array(F.struct(F.lit(0).alias("at"), first.alias("letter"))), stated)

    def runs(s: Column) -> Column:
        return F.transform(s, lambda x, k: F.array_repeat(
            x["letter"], F.coalesce(F.get(s, k + 1)["at"], F.size(bounds)) - x["at"]))

    return F.flatten(let(starts, runs))


def _between(rows: Column, low: Column, high: Column) -> Column:
    """The rows after position ``low`` and before ``high``, counted from 0."""
    return F.slice(rows, low + 2, high - low - 1)


def _bounds(rows: Column, is_bound) -> Column:
    placed = F.transform(rows, lambda r, i: r.withField("at", i))
    return F.filter(placed, is_bound)


def _marked_questions(rows: Column, bounds: Column, parts: Column, question) -> Column:
    """``question(bound, previous, before, after)`` of every numbered bound, with its part's marks.

    ``before`` and ``after`` are the rows between it and its neighbours among the bounds.
    """
    first = F.array_min(F.transform(parts, lambda p: p["letter"]))

    def whole(letters: Column) -> Column:
        def asked(b: Column, k: Column) -> Column:
            previous, letter = F.get(bounds, k - 1), F.get(letters, k)
            before = _between(rows, F.coalesce(previous["at"], F.lit(-1)), b["at"])
            after = _between(rows, b["at"], F.coalesce(F.get(bounds, k + 1)["at"], F.size(rows)))
            part = F.get(F.filter(parts, lambda p: p["letter"] == letter), F.lit(0))

            def finished(q: Column) -> Column:
                return F.struct(
                    b["line_no"].alias("line_no"), b["number"].alias("question_number"),
                    q["text"].alias("question_text"),
                    F.coalesce(q["stated"], part["marks_per_question"], F.lit(fv.DEFAULT_MARKS)).alias("marks"),
                    F.concat(F.lit("Part-"), letter).alias("part_name"), q["is_or"].alias("is_or_option"),
                )

            found = let(before, lambda x: question(b, previous, x, after))
            return F.when(b["number"].isNotNull(), let(found, lambda q: F.when(q["text"].isNotNull(), finished(q))))

        return F.array_compact(F.transform(bounds, asked))

    return let(_running_letters(bounds, first), whole)


def _flow_line(line: Column, institution: str | None) -> Column:
    """``struct(kind, number, text, letter)`` of a line; null for lines the layout ignores."""
    def made(kind: str, number: Column, text: Column, letter: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"),
                        text.alias("text"), letter.cast("string").alias("letter"))

    def numbered(kind: str, pattern: str, min_chars: int) -> Column:
        def body(number: Column) -> Column:
            rest = let(F.regexp_extract(line, pattern, 2), without_outcome_tags) if min_chars else F.lit("")
            found = let(rest, lambda r: F.when(F.length(r) >= min_chars, made(kind, number, r, F.lit(None))))
            return F.when((number != "") & number.cast("int").between(1, fv.FLOW_LAST_NUMBER), found)

        return let(F.regexp_extract(line, pattern, 1), body)

    none, empty = F.lit(None), F.lit("")
    numbers = F.coalesce(numbered("only", fv.FLOW_NUMBER_ONLY, 0), numbered("inline", fv.FLOW_NUMBER_INLINE, 3),
                         numbered("bare", fv.FLOW_NUMBER_BARE, 6))
    return (
        F.when(is_header_line(line, institution), None)
        .when(line.rlike(fv.PART_LINE), made("part", none, empty, F.upper(F.regexp_extract(line, fv.PART_LINE, 1))))
        .when(line.rlike(fv.OR_LINE), made("or", none, empty, none))
        # only lines that start with a digit are searched for a number
        .otherwise(F.coalesce(F.when(line.rlike("^[0-9]"), numbers), made("text", none, without_outcome_tags(line), none)))
    )


def _with_flow(lines: DataFrame, institution: str | None) -> DataFrame:
    """Add ``_flow``, the questions of the column-flow layout.

    Text between a part header (or the start) and the part's first number belongs
    to that number, unless an OR line or a number without punctuation discards it;
    later text continues the open question. The question after an OR line is the
    alternative.
    """
    noise = _starts_with_any(fv.FLOW_NOISE_WORDS, institution)

    def pending(r: Column) -> Column:
        """Text above a number is kept only when it is long enough and no header."""
        return (r["kind"] == "text") & (F.length(r["text"]) >= fv.FLOW_PENDING_MIN_CHARS) & ~(
            r["line"].rlike(noise) | r["text"].rlike(noise))

    def question(b: Column, previous: Column, before: Column, after: Column) -> Column:
        last_or = F.array_max(F.transform(before, lambda r, i: F.when(r["kind"] == "or", i)))
        ahead = F.when(
            F.coalesce(previous["kind"] == "part", F.lit(True)) & (b["kind"] != "bare"),
            let(F.coalesce(last_or, F.lit(-1)), lambda o: F.filter(before, lambda r, i: (i > o) & pending(r))),
        )
        pieces = F.concat(F.coalesce(ahead, F.slice(before, 1, 0)), F.array(b.dropFields("at")), after)
        texts = F.filter(F.transform(pieces, lambda r: r["text"]), lambda t: t != "")
        text = let(F.array_join(texts, " "), without_outcome_tags)
        return F.struct(
            let(text, lambda t: F.when(F.length(t) >= fv.FLOW_MIN_CHARS, t)).alias("text"),
            F.lit(None).cast("double").alias("stated"),
            F.exists(before, lambda r: r["kind"] == "or").alias("is_or"),
        )

    def parsed(r: Column) -> Column:
        return let(_flow_line(r["line"], institution), lambda p: F.when(p.isNotNull(), F.struct(
            r["line_no"].alias("line_no"), r["line"].alias("line"), *[p[c].alias(c) for c in ("kind", "number", "text", "letter")])))

    rows, bounds = F.col("_flow_rows"), F.col("_flow_bounds")
    columns = lines.columns
    return (
        lines.select(*columns, F.array_compact(F.transform("_rows", parsed)).alias("_flow_rows"))
        .select(*columns, "_flow_rows", _bounds(
            rows, lambda r: r["number"].isNotNull() | (r["kind"] == "part")).alias("_flow_bounds"))
        .select(*columns, _marked_questions(rows, bounds, F.col("_parts"), question).alias("_flow"))
    )


def _listed(rows: Column, parts: Column) -> Column:
    """The questions of a plain numbered list.

    Marks in brackets at the end of the marker line override the part's. The
    question after an OR line is the alternative.
    """
    letters = F.transform(parts, lambda p: p["letter"])

    def parsed(r: Column) -> Column:
        line = r["line"]
        known = F.array_intersect(
            F.transform(F.regexp_extract_all(line, F.lit(fv.LIST_PART_LINE), F.lit(1)), F.upper), letters)
        mark = F.when(line.rlike(fv.LIST_CANDIDATE), first_marker(line, fv.LIST_MARKERS, 0, 99))
        stated = F.when(line.endswith(")") | line.rlike(r"(?i)marks?$"), F.regexp_extract(line, fv.LIST_INLINE_MARKS, 1))

        def row(m: Column) -> Column:
            number = F.when(m["number"] <= fv.LIST_LAST_NUMBER, m["number"])
            is_or = line.rlike(fv.OR_LINE)
            mute = F.coalesce(m["number"] > fv.LIST_LAST_NUMBER, F.lit(False)) | line.rlike(fv.LIST_PART_SKIP)
            return F.struct(
                r["line_no"].alias("line_no"), number.alias("number"), F.array_max(known).alias("letter"),
                is_or.alias("is_or"),
                F.when(number.isNotNull(), let(stated, lambda x: digits(x, "double"))).alias("stated"),
                F.when(number.isNotNull(), m["rest"]).when(~is_or & ~mute, line).alias("text"),
            )

        return let(mark, row)

    def question(b: Column, previous: Column, before: Column, after: Column) -> Column:
        texts = F.array_compact(F.transform(F.concat(F.array(b.dropFields("at")), after), lambda r: r["text"]))
        joined = let(strip(F.array_join(texts, " ")), lambda t: F.when(
            F.length(t) >= fv.LIST_MIN_CHARS, strip(F.regexp_replace(t, fv.LIST_OR_TAG, ""))))
        return F.struct(joined.alias("text"), b["stated"].alias("stated"),
                        (b["is_or"] | F.exists(before, lambda r: r["is_or"])).alias("is_or"))

    def with_bounds(found: Column) -> Column:
        bounds = _bounds(found, lambda r: r["number"].isNotNull() | r["letter"].isNotNull())
        return let(bounds, lambda b: _marked_questions(found, b, parts, question))

    return let(F.transform(rows, parsed), with_bounds)


def flow_questions(lines: DataFrame, keys: Sequence[str], institution: str | None = None) -> DataFrame:
    """One row per question of the column-flow layout, from :func:`paper_lines`."""
    # an expression, not the bare column: for that Spark would add a size filter and
    # compute the array once more below it
    return _with_flow(lines, institution).select(*keys, F.inline(F.array_compact("_flow")))


def list_questions(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per question of a plain numbered list, from :func:`paper_lines`."""
    return lines.select(*keys, F.inline(_listed(F.col("_rows"), F.col("_parts"))))


def minimal_questions(text: Column) -> Column:
    """Any numbered item that starts with a capital and runs past ten characters."""
    pattern = F.lit(r"(?:^|\n)" + fv.MINIMAL_ITEM[1:])
    pairs = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda n, t: F.struct(
            n.try_cast("int").alias("question_number"),
            strip(t).alias("question_text"),
            F.lit(fv.DEFAULT_MARKS).alias("marks"),
            F.lit("Part-A").alias("part_name"),
            F.lit(False).alias("is_or_option"),
        ),
    )
    return F.filter(
        pairs,
        lambda q: q["question_number"].between(1, fv.MINIMAL_LAST_NUMBER)
        & (F.length(q["question_text"]) > 10),
    )


def paper_headers(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per paper: ``header`` struct and the ``parts`` array; no shuffle."""
    keys = list(keys)
    return (
        documents.select(*keys, F.split(text, fv.LINE_BREAK).alias("_lines"))
        .select(
            *keys, header_fields("_lines").alias("header"), _part_headers("_lines").alias("_headers")
        )
        .select(*keys, "header", _first_headers("_headers").alias("parts"))
    )


QUESTION = ("question_number", "question_text", "marks", "part_name", "is_or_option")


def _good(q) -> Column:
    return (F.length(q["question_text"]) >= 3) & (q["question_number"] > 0) & q["marks"].isNotNull()


def _firsts(questions: str) -> Column:
    """The first valid question of each (number, alternative flag); numbers are bounded, so pairs are few."""
    flag = lambda q: F.struct(q["question_number"], q["is_or_option"])
    return let(F.filter(questions, _good), lambda found: F.transform(
        F.array_distinct(F.transform(found, flag)), lambda f: F.get(F.filter(found, lambda q: flag(q) == f), F.lit(0))))


def paper_questions(
    documents: DataFrame, keys: Sequence[str], text: str = "text",
    model_rows: DataFrame | None = None, institution: str | None = None,
) -> DataFrame:
    """One row per question, from the first strategy that yields any per document.

    Order: rows a model already extracted, column flow, numbered list, minimal; a
    strategy runs only where those before it found nothing. Only valid questions are
    kept, and of each (number, alternative flag) the first. ``institution`` is a
    pattern for the letterhead line to skip. All strategies work inside the document's
    row; only rows of a model are shuffled and joined, where there are any.
    """
    keys = list(keys)
    papers = documents
    if model_rows is not None:
        papers = documents.join(model_rows.select(*keys).distinct(), keys, "left_anti")
    plain = lambda found: F.transform(found, lambda q: F.struct(*[q[c].alias(c) for c in QUESTION]))
    named = lambda name, found: F.struct(F.lit(name).alias("strategy"), found.alias("rows"))
    lines = _with_flow(paper_lines(papers.select(*keys, F.col(text).alias("_text")), [*keys, "_text"], "_text"), institution)
    later = let(_listed(F.col("_rows"), F.col("_parts")), lambda found: F.when(
        F.size(found) > 0, named("list", plain(found))).otherwise(named("minimal", minimal_questions(F.col("_text")))))
    tried = F.when(F.size("_flow") > 0, named("flow", plain(F.col("_flow")))).otherwise(later)
    rows = (
        lines.select(*keys, tried.alias("_tried"))
        .select(*keys, "_tried.strategy", F.col("_tried.rows").alias("_found"))
        .select(*keys, "strategy", F.inline(_firsts("_found")))
        .select(*keys, *QUESTION, "strategy")
    )
    if model_rows is not None:
        given = first_per_key(model_rows.filter(_good({c: F.col(c) for c in QUESTION})),
                              [*keys, "question_number", "is_or_option"], F.col("line_no"))
        rows = given.select(*keys, *QUESTION, F.lit("model").alias("strategy")).unionByName(rows)
    return rows.withColumn("question_type", compact_type(F.col("question_text")))


def paper_totals(questions: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals without alternatives, under both precedences.

    The stored paper takes the sum of its questions and the header only when that
    is 0; the reader takes the header and the sum only when the header is missing.
    """
    summed = questions.groupBy(*keys).agg(
        F.sum(F.when(F.col("is_or_option"), 0.0).otherwise(F.col("marks"))).alias("_sum"),
        F.count(F.lit(1)).alias("num_questions"),
    )
    # taken below the join: the patterns of the other header fields are not searched then
    marks = headers.select(*keys, F.col("header.total_marks").alias("_stated"))
    stated, total = F.col("_stated"), F.coalesce("_sum", F.lit(0.0))
    return marks.join(summed, list(keys), "left").select(
        *keys,
        F.coalesce("num_questions", F.lit(0).cast("long")).alias("num_questions"),
        F.coalesce(F.nullif(total, F.lit(0.0)), stated).alias("stored_total"),
        F.coalesce(F.nullif(stated, F.lit(0.0)), total).alias("reader_total"),
    )


def part_counts(questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Questions per part, and those that are not alternatives."""
    return questions.groupBy(*keys, "part_name").agg(
        F.count(F.lit(1)).alias("num_questions"),
        F.count_if(~F.col("is_or_option")).alias("num_primary"),
    )
