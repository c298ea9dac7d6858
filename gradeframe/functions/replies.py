"""Decode model replies held as text; a bad reply becomes a row, never an error.

Numbers are read as text first and then cast, so ``"8"`` and ``8`` both count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.rounding import clamp
from gradeframe.functions.text import let, strip

REPLY_FIELDS = (
    "score string, confidence string, strengths string, missing_concepts string, "
    "feedback string, explanation string"
)
COVER_FIELDS = [
    "roll_number", "register_number", "set_name", "course_code", "course_name", "exam_name",
    "programme", "semester", "date_of_exam",
]
OFFLINE_SCORE, OFFLINE_CONFIDENCE = 5.0, 0.3
_LENIENT = {"allowUnquotedControlChars": "true"}


def json_body(raw: Column) -> Column:
    """Text between the first ``{`` and the last ``}``, code fences removed."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"```json|```|`", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def is_json_object(body: Column) -> Column:
    """Whether the text parses as a JSON object."""
    return F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))


def _list(text: Column) -> Column:
    """A JSON array of strings; anything else becomes an empty array."""
    return F.coalesce(
        F.from_json(F.when(text.startswith("["), text), "array<string>"),
        F.array().cast("array<string>"),
    )


def _number(text: Column, default: str) -> Column:
    """Number from text; the pattern test spares the slow failing cast."""
    return let(
        F.trim(F.coalesce(text, F.lit(default))),
        lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.cast("double")),
    )


def _decoded(raw: Column, outcome) -> Column:
    """Parse a reply once and build the result struct.

    ``outcome(ok, broken, score, sure)`` returns the final score and confidence.
    """
    corrupt = {"columnNameOfCorruptRecord": "_corrupt"}
    fields = F.from_json(json_body(raw), REPLY_FIELDS + ", _corrupt string", corrupt)

    def parsed(f: Column) -> Column:
        ok = f.isNotNull() & f["_corrupt"].isNull()
        return F.struct(
            ok.alias("ok"), f.alias("f"),
            _number(F.when(ok, f["score"]), "0").alias("score"),
            _number(F.when(ok, f["confidence"]), "0.7").alias("sure"),
        )

    def built(p: Column) -> Column:
        broken = p["score"].isNull() | p["sure"].isNull()
        score, sure, unread = outcome(p["ok"], broken, p["score"], p["sure"])
        feedback = (
            F.when(broken, F.lit("Evaluation failed: score is not a number."))
            .when(~p["ok"], F.lit(unread))
            .otherwise(F.coalesce(p["f"]["feedback"], F.lit("No feedback generated.")))
        )
        return F.struct(
            score.alias("score"),
            sure.alias("confidence"),
            _list(F.when(p["ok"], p["f"]["strengths"])).alias("strengths"),
            _list(F.when(p["ok"], p["f"]["missing_concepts"])).alias("missing_concepts"),
            feedback.alias("feedback"),
            p["ok"].alias("parsed"),
        )

    return let(let(fields, parsed), built)


def graded_reply(raw: Column, max_marks: Column) -> Column:
    """Decode a graded reply of the open types.

    Unparsable: score 0, confidence 0.3. Parsable with a score that is no number:
    score 0, confidence 0. Otherwise both values are limited to their range.
    """
    def outcome(ok: Column, broken: Column, score: Column, sure: Column):
        return (
            F.when(~ok | broken, F.lit(0.0)).otherwise(clamp(score, F.lit(0.0), max_marks)),
            F.when(~ok, F.lit(0.3)).when(broken, F.lit(0.0)).otherwise(
                clamp(sure, F.lit(0.0), F.lit(1.0))
            ),
            "Evaluation response could not be parsed.",
        )

    return _decoded(raw, outcome)


def simple_reply(raw: Column, max_marks: Column) -> Column:
    """Decode a reply of the other types: unparsable text scores 0 at confidence 0.7."""
    def outcome(ok: Column, broken: Column, score: Column, sure: Column):
        return (
            F.when(broken, F.lit(0.0)).otherwise(clamp(score, F.lit(0.0), max_marks)),
            F.when(broken, F.lit(0.0)).otherwise(sure),
            "No feedback generated.",
        )

    return _decoded(raw, outcome)


def model_score(question_type: Column, raw: Column, max_marks: Column) -> Column:
    """Route a reply to the decoder of its question type."""
    return F.when(
        question_type.isin(fv.JSON_REPLY_TYPES), graded_reply(raw, max_marks)
    ).otherwise(simple_reply(raw, max_marks))


def first_reply(replies: Sequence[Column], names: Sequence[str]) -> Column:
    """First non-null reply in provider order, else the offline constant.

    Struct of ``text`` and ``provider``.
    """
    offline = (
        f'{{"score": {OFFLINE_SCORE}, "feedback": "Evaluation unavailable.", '
        f'"strengths": [], "missing_concepts": [], "confidence": {OFFLINE_CONFIDENCE}}}'
    )
    chain = None
    for reply, name in zip(replies, names):
        chain = F.when(reply.isNotNull(), name) if chain is None else chain.when(
            reply.isNotNull(), name
        )
    return F.struct(
        F.coalesce(*replies, F.lit(offline)).alias("text"),
        chain.otherwise("offline").alias("provider"),
    )


def _escaped(text: Column) -> Column:
    """Double every backslash that starts no valid JSON escape."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu0-9])', r"\\\\")


_ANSWER = "question_number string, answer_text string, part_name string, is_or_option boolean"
_ANSWERS = (
    "answers array<struct<question_number:string,answer_text:string,part_name:string,"
    "is_or_option:boolean>>"
)


def _complete(text: Column) -> Column:
    """Whether JSON text parses once raw control characters are accepted."""
    spaced = F.regexp_replace(text, r"[\n\r\t]", " ")
    return F.coalesce(F.try_parse_json(spaced).isNotNull(), F.lit(False))


def _whole_number(text: Column) -> Column:
    """Integer from text, null for anything else or beyond 64 bits, without a failing cast."""
    return let(F.trim(text), lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("long")))


def answer_list(raw: Column) -> Column:
    """Answers of a segmentation reply, repaired where needed.

    Attempts in order: the whole object (stray backslashes doubled, raw line ends
    inside strings accepted); each flat ``{…}`` of the list on its own; field by
    field for objects that still do not parse. Array of
    ``struct(question_number, answer_text, part_name, is_or_option)``.
    """
    def by_field(obj: Column) -> Column:
        text = F.regexp_extract(obj, r'(?s)"answer_text"\s*:\s*"(.*?)"(?=\s*,\s*"|\s*\})', 1)
        part = F.nullif(F.regexp_extract(obj, r'"part_name"\s*:\s*"(.*?)"', 1), F.lit(""))

        def built(number: Column) -> Column:
            default = F.when(_whole_number(number) >= fv.PART_B_FROM, "Part-B").otherwise("Part-A")
            return F.when(
                number != "",
                F.struct(
                    number.alias("question_number"),
                    F.replace(text, F.lit('\\"'), F.lit('"')).alias("answer_text"),
                    F.coalesce(part, default).alias("part_name"),
                    F.lit(False).alias("is_or_option"),
                ),
            )

        return let(F.regexp_extract(obj, r'"question_number"\s*:\s*(\d+)', 1), built)

    def rescued(obj: Column) -> Column:
        return let(
            F.from_json(F.when(_complete(obj), obj), _ANSWER, _LENIENT),
            lambda parsed: F.when(parsed["question_number"].isNotNull(), parsed).otherwise(by_field(obj)),
        )

    def pieces(body: Column) -> Column:
        objects = F.regexp_extract_all(body, F.lit(r"(\{[^{}]+\})"), F.lit(1))
        return F.array_compact(F.transform(objects, lambda o: rescued(o)))

    def typed(a: Column) -> Column:
        return F.struct(
            _whole_number(a["question_number"]).alias("question_number"),
            F.coalesce(a["answer_text"], F.lit("")).alias("answer_text"),
            F.coalesce(a["part_name"], F.lit("")).alias("part_name"),
            F.coalesce(a["is_or_option"], F.lit(False)).alias("is_or_option"),
        )

    found = let(
        _escaped(json_body(raw)),
        lambda body: F.coalesce(
            F.from_json(F.when(_complete(body), body), _ANSWERS, _LENIENT)["answers"], pieces(body)
        ),
    )
    return F.transform(found, typed)


def answer_map(raw: Column) -> Column:
    """Key answers as ``map<int, string>`` from either reply form.

    ``{"answers": [{question_number, answer_text}]}`` or ``{"1": "…"}``; entries
    without a whole number are left out, as are blank listed answers. Of repeated
    numbers the last counts.
    """
    def entry(key: Column, value: Column) -> Column:
        return F.struct(_whole_number(key).alias("k"), strip(value).alias("v"))

    def entries(body: Column) -> Column:
        listed = F.from_json(
            body, "answers array<struct<question_number:string,answer_text:string>>", _LENIENT
        )["answers"]
        from_list = F.filter(
            F.transform(listed, lambda a: entry(a["question_number"], a["answer_text"])),
            lambda e: e["k"].isNotNull() & (F.coalesce(e["v"], F.lit("")) != ""),
        )
        direct = F.map_entries(F.from_json(body, "map<string,string>", _LENIENT))
        from_map = F.filter(
            F.transform(direct, lambda e: entry(e["key"], e["value"])), lambda e: e["k"].isNotNull()
        )
        return F.coalesce(from_list, from_map)

    def as_map(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda e: e["k"]))
        last = F.transform(
            keys, lambda k: F.element_at(F.filter(found, lambda e: e["k"] == k), -1)["v"]
        )
        return F.when(found.isNotNull(), F.map_from_arrays(keys, last))

    body = json_body(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```json\s*|```\s*", ""))
    usable = let(body, lambda b: F.when(_complete(b), b))
    return let(let(usable, entries), as_map)


def closed_json(raw: Column) -> Column:
    """Close a reply that was cut off: drop the last partial object, end the list."""
    bare = strip(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```json\s*|```\s*", ""))
    cut = F.regexp_replace(bare, r",\s*\{[^}]*$", "")
    closed = F.when(cut.endswith("]}"), cut).otherwise(
        F.concat(F.regexp_replace(F.rtrim(cut), r",+$", ""), F.lit("]}"))
    )
    body = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(is_json_object(body), body).when(is_json_object(closed), closed)


def cover_fields(raw: Column) -> Column:
    """The nine cover-page fields as a struct, missing ones empty."""
    body = F.from_json(json_body(raw), ", ".join(f"{f} string" for f in COVER_FIELDS))
    return F.struct(*[F.coalesce(body[f], F.lit("")).alias(f) for f in COVER_FIELDS])


def json_list(values: Column) -> Column:
    """Store a list column as JSON text; null is stored as an empty list."""
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def read_json_list(text: Column) -> Column:
    return F.coalesce(
        F.from_json(F.coalesce(text, F.lit("[]")), "array<string>"),
        F.array().cast("array<string>"),
    )
