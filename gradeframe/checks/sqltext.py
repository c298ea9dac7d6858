"""Pieces of DuckDB SQL used by several counterparts."""

from __future__ import annotations

from gradeframe import fixed_values as fv


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def normalize(x: str) -> str:
    s = rf"regexp_replace({x}, '[^\x20-\x7E\n]', ' ', 'g')"
    s = rf"regexp_replace({s}, '(^|[^.!?])\n+', '\1. ', 'g')"
    s = rf"regexp_replace({s}, '([.!?])\n+', '\1 ', 'g')"
    s = rf"regexp_replace({s}, ' {{2,}}', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\.([A-Z])', '. \1', 'g'))"


def keywords(x: str) -> str:
    return (
        rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), "
        rf"lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {in_list(fv.KEYWORD_STOP_WORDS)}))"
    )


def coverage(student: str, teacher: str) -> str:
    return (
        f"CASE WHEN len({teacher}) = 0 THEN 1.0 ELSE "
        f"round_even(len(list_intersect({teacher}, {student})) / len({teacher})::DOUBLE, 4) END"
    )


def length_norm(student: str, teacher: str) -> str:
    return (
        f"CASE WHEN {teacher} = 0 THEN 1.0 ELSE "
        f"round_even(least(1.0, ({student}::DOUBLE / {teacher}) / 0.6), 4) END"
    )


def exact_round2(x: str) -> str:
    """Two decimals, ties judged on the binary value."""
    n = f"round_even(abs({x}) * 1000.0, 0)"
    hi = f"(abs({x}) * 134217729.0 - (abs({x}) * 134217729.0 - abs({x})))"
    gap = f"(({hi} * 1000.0 - {n}) + (abs({x}) - {hi}) * 1000.0)"
    up, down = f"(({n} + 5) / 10 / 100)", f"(({n} - 5) / 10 / 100)"
    return (
        f"CASE WHEN {n} % 10 = 5 AND abs({gap}) < 1e-3 THEN sign({x}) * CASE WHEN {gap} > 0 THEN {up} "
        f"WHEN {gap} < 0 THEN {down} WHEN (({n} - 5) / 10) % 2 = 0 THEN {down} ELSE {up} END "
        f"ELSE round_even({x}, 2) END"
    )


def text_round1(x: str) -> str:
    """One decimal, ties judged half-even on the shortest decimal text; for values that are not negative."""
    tenths = f"(({x})::VARCHAR::DECIMAL(26, 20) * 10::DECIMAL(2, 0))"
    rest = f"({tenths} - floor({tenths}))"
    up = f"({rest} > 0.5 OR ({rest} = 0.5 AND floor({tenths})::BIGINT % 2 = 1))"
    return f"((floor({tenths})::BIGINT + {up}::BIGINT) / 10::DOUBLE)"


QA = """qa AS (
  SELECT u.conv_id, u.turn, u.text AS student, a.text AS teacher
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

QUESTION_ID = (
    "((((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 5000 + l_suppkey) * 64 + l_quantity::BIGINT)"
)

QUESTIONS = f"""questions AS (
  SELECT {QUESTION_ID} AS id, l_orderkey AS paper_id, l_linenumber AS question_number,
    l_returnflag = 'R' AS is_or_option,
    CASE WHEN l_quantity = 50 THEN NULL WHEN l_quantity = 49 THEN 0.0 ELSE l_quantity % 12 + 1 END AS marks,
    CASE l_partkey % 8 WHEN 0 THEN 'mcq' WHEN 1 THEN 'true_false' WHEN 2 THEN 'fill_blank'
      WHEN 3 THEN 'short_answer' WHEN 4 THEN 'numerical' WHEN 5 THEN 'open_ended'
      WHEN 6 THEN 'diagram' ELSE '' END AS question_type,
    CASE WHEN l_discount > 0.09 THEN '' ELSE 'key ' || l_partkey END AS teacher_answer,
    substr('ABCDE', (l_suppkey % 5 + 1)::INT, 1) AS correct_option,
    'Question ' || l_partkey AS question_text,
    CASE WHEN l_linenumber >= 4 THEN 'Part-B' ELSE 'Part-A' END AS part_name
  FROM lineitem)"""

ANSWERS = f"""answers AS (
  SELECT {QUESTION_ID} AS id, l_orderkey AS booklet_id, l_orderkey AS paper_id,
    (l_linenumber + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END)::INT AS question_number,
    l_linestatus = 'F' AS is_or_option,
    CASE WHEN l_returnflag = 'A' THEN {QUESTION_ID} END AS exam_question_id,
    CASE WHEN l_quantity < 3 THEN '  ' ELSE 'text ' || l_suppkey END AS answer_text,
    l_tax > 0.06 AS evaluated,
    l_quantity % 7 AS score
  FROM lineitem)"""

PAPERS = """papers AS (
  SELECT o_orderkey AS id, 'P' || o_orderkey AS paper_id, o_orderpriority AS course_name,
    o_totalprice AS total_marks, o_orderdate AS parsed_at, o_orderstatus AS state
  FROM orders)"""
