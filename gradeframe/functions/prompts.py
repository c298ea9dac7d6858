"""Render grading requests for batch inference from a template table.

Templates are rows ``(name, body)`` with ``{placeholder}`` marks, so a caller can
bring their own wording; :data:`TEMPLATES` holds one short default per question
type. All defaults ask for the same reply fields the decoders in ``replies`` read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

_REPLY = (
    'Reply with one JSON object only: {"score": number from 0 to {max_marks}, '
    '"confidence": number from 0 to 1, "strengths": [strings], '
    '"missing_concepts": [strings], "feedback": string}'
)
_BODY = (
    "{instruction}\nQuestion: {question}\nReference answer: {teacher_answer}\n"
    "Student answer: {student_answer}\nMaximum marks: {max_marks}\n{rubric}"
) + _REPLY

INSTRUCTIONS = {
    "open_ended": "Grade this long answer on its content; ignore recognition errors.",
    "rubric": "Grade this long answer against every criterion of the rubric.",
    "short_answer": "Grade this short answer on its key facts.",
    "fill_blank": "Grade the words given for the blank; accept equivalents.",
    "numerical": "Grade the result and the working of this calculation.",
    "diagram": "Grade the labels read from this drawing.",
}
TEMPLATES = {name: _BODY.replace("{instruction}", text) for name, text in INSTRUCTIONS.items()}
OPTION_TEMPLATE = (
    "Which option did the student mark?\nQuestion: {question}\nA) {option_a}\nB) {option_b}\n"
    "C) {option_c}\nD) {option_d}\nRecognised text: {student_answer}\n"
    'Reply with one JSON object only: {"detected_option": letter or null, '
    '"confidence": number from 0 to 1, "reasoning": string}'
)


def rubric_lines(rubric: Column) -> Column:
    """One line per criterion with its marks; empty text without a rubric."""
    lines = F.array_join(
        F.transform(
            rubric,
            lambda r: F.concat(F.lit("  - "), r["criterion"], F.lit(": "),
                               r["marks"].cast("string"), F.lit(" marks")),
        ),
        "\n",
    )
    return F.when(F.size(rubric) > 0, F.concat(F.lit("Rubric:\n"), lines, F.lit("\n"))).otherwise("")


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` marks. Values are put in through unlikely sentinels first,
    so that braces inside a value are never taken for a mark."""
    out = template
    for name in values:
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"\u0001{name}\u0002"))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"\u0001{name}\u0002"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def template_for(question_type: Column, has_rubric: Column,
                 templates: Mapping[str, str] = TEMPLATES) -> Column:
    """Template text of a question type; open questions with a rubric use the rubric one."""
    chain = F.when((question_type == "open_ended") & has_rubric, templates["rubric"])
    for name, body in templates.items():
        if name not in ("rubric", "open_ended"):
            chain = chain.when(question_type == name, body)
    return chain.otherwise(templates["open_ended"])


def prompt(question_type: Column, question: Column, teacher: Column, student: Column,
           max_marks: Column, rubric: Column, templates: Mapping[str, str] = TEMPLATES) -> Column:
    """The filled prompt of one answer."""
    has_rubric = F.coalesce(F.size(rubric) > 0, F.lit(False))
    return fill(
        template_for(question_type, has_rubric, templates),
        {
            "question": question, "teacher_answer": teacher, "student_answer": student,
            "max_marks": max_marks, "rubric": F.coalesce(rubric_lines(rubric), F.lit("")),
        },
    )


def option_prompt(question: Column, options: Column, student: Column) -> Column:
    """Prompt for an option that could not be read; ``options`` maps letter to text."""
    values = {f"option_{k.lower()}": F.coalesce(options[k], F.lit("")) for k in "ABCD"}
    return fill(F.lit(OPTION_TEMPLATE), {"question": question, "student_answer": student, **values})
