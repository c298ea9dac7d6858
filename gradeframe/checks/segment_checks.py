"""Segmentation, paper reading and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.checks import sqltext as q, standins as s
from gradeframe.checks.registry import Tables, check
from gradeframe.functions import classify as cl
from gradeframe.operators import pages as pg, papers as pp, segment as sg

BOOKLET = [
    ("A", "1. "), ("B", "2) "), ("D", "(3) "), ("E", "Q4: "), ("I", "Ans 5: "), ("L", "12. "),
    ("O", "25) "), ("R", "q.7) "), ("T", "8.\n"), ("W", "Q9\n"), ("S", "--- PAGE BREAK ---\n"),
    ("H", "answer 15) "), ("N", "Q3 "),
]


def sql_pattern(pattern: str) -> str:
    """A stored pattern in the other engine's dialect (ASCII classes, no U flag)."""
    for java, other in (("(?iU)", "(?i)"), ("(?iUm)", "(?im)"), ("(?U)", "")):
        pattern = pattern.replace(java, other)
    return q.quoted(pattern)


def marker_sql(line: str, patterns, low: int, high: int, group: int) -> str:
    """First pattern with a number in range: its number (group 1) or rest (group 2)."""
    tries = []
    for p in patterns:
        number = f"TRY_CAST(regexp_extract({line}, {sql_pattern(p)}, 1) AS INT)"
        value = number if group == 1 else q.strip(f"regexp_extract({line}, {sql_pattern(p)}, 2)")
        tries.append(f"CASE WHEN {number} BETWEEN {low} AND {high} THEN {value} END")
    return "coalesce(" + ", ".join(tries) + ")"


LINES = f"""raw AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (
    SELECT doc_id, string_split(text, chr(10)) AS l FROM marked)),
  lines AS (SELECT doc_id, i, raw, {q.strip('raw')} AS line FROM raw WHERE {q.strip('raw')} <> '')"""

BOOKLET_SQL = f"""{s.marked_sql(BOOKLET)}, {LINES},
  m AS (SELECT doc_id, i, line, {marker_sql('line', fv.BOOKLET_MARKERS, 1, 20, 1)} AS number,
      {marker_sql('line', fv.BOOKLET_MARKERS, 1, 20, 2)} AS rest FROM lines WHERE NOT contains(line, '--- PAGE BREAK ---')),
  w AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM m),
  segs AS (SELECT doc_id, seg, max(number) AS number,
      {q.strip("string_agg(CASE WHEN number IS NULL THEN line ELSE nullif(rest, '') END, chr(10) ORDER BY i)")} AS text
    FROM w WHERE seg > 0 GROUP BY doc_id, seg),
  kept AS (SELECT doc_id, number AS question_number, string_agg(text, chr(10) ORDER BY seg) AS answer_text
    FROM segs WHERE length(text) > 5 GROUP BY doc_id, number),
  booklet AS (SELECT *, CASE WHEN question_number >= 8 THEN 'Part-B' ELSE 'Part-A' END AS part_name FROM kept
    UNION ALL SELECT doc_id, 0, {q.strip("replace(text, '--- PAGE BREAK ---', '')")}, 'unknown' FROM marked
      WHERE doc_id NOT IN (SELECT doc_id FROM kept) AND {q.strip("replace(text, '--- PAGE BREAK ---', '')")} <> '')"""


@check(
    "booklet_segments", "E1",
    f"WITH {BOOKLET_SQL} SELECT doc_id, question_number, part_name, answer_text FROM booklet",
)
def _(t: Tables) -> DataFrame:
    return sg.booklet_answers(s.marked(t, BOOKLET), ["doc_id"]).drop("is_or_option")


@check(
    "valid_booklet_answers", "B13",
    f"WITH {BOOKLET_SQL} SELECT doc_id, question_number, length({q.strip('answer_text')}) AS n FROM booklet WHERE question_number <> 0",
)
def _(t: Tables) -> DataFrame:
    return sg.valid_answers(sg.booklet_answers(s.marked(t, BOOKLET), ["doc_id"])).select(
        "doc_id", "question_number", F.length("answer_text").cast("long").alias("n")
    )


@check(
    "conversation_round_trip", "E1",
    """SELECT conv_id, turn + 1 AS question_number, length(regexp_replace(text, '\\n', ' ', 'g')) AS n FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    """Number the turns of each conversation, segment the text, get the turns back."""
    said = t.conversations.select(
        "conv_id", (F.col("turn") + 1).alias("question_number"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("answer_text")
    )
    booklets = said.groupBy("conv_id").agg(
        sg.number_segments(F.array_sort(F.collect_list(F.struct("question_number", "answer_text")))).alias("text")
    )
    return sg.booklet_answers(booklets, ["conv_id"]).select(
        "conv_id", F.col("question_number").cast("long").alias("question_number"),
        F.length("answer_text").cast("long").alias("n"),
    )


KEY = [
    ("A", "1. "), ("B", "2, "), ("D", "3: What is meant?\n"), ("E", "Q4 "), ("I", "Answer 5: "), ("L", "Answer: "),
    ("O", "OR\n"), ("R", "Sol. "), ("T", "7) Ans: "), ("W", "PART - B\n"), ("S", "Set A\n"), ("H", "11] "),
]
_SKIP = " OR ".join(f"regexp_matches(line, {sql_pattern(p)})" for p in fv.KEY_SKIP).replace(
    "[A-Z]\\b", "[A-Z]([^\\p{L}\\p{N}_]|$)"
)


def _bare(x: str) -> str:
    p = sql_pattern(fv.KEY_ANSWER_PREFIX)
    return f"CASE WHEN regexp_extract({x}, {p}, 1) <> '' THEN regexp_extract({x}, {p}, 1) ELSE {x} END"


@check(
    "answer_key_segments", "E2 E3",
    f"""WITH {s.marked_sql(KEY)}, {LINES},
    m AS (SELECT doc_id, i, line, {marker_sql('line', fv.KEY_MARKERS, 0, 99, 1)} AS number,
        {marker_sql('line', fv.KEY_MARKERS, 0, 99, 2)} AS rest FROM lines WHERE NOT ({_SKIP})),
    w AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM m),
    segs AS (SELECT doc_id, seg, max(number) AS number, {q.strip(f'''string_agg(CASE WHEN number IS NULL THEN {_bare('line')}
        WHEN rest LIKE '%?' AND length(rest) < 200 THEN NULL ELSE nullif({_bare('rest')}, '') END, ' ' ORDER BY i)''')} AS text
      FROM w WHERE seg > 0 GROUP BY doc_id, seg)
    SELECT doc_id, number AS question_number, string_agg(text, chr(10) ORDER BY seg) AS answer_text
    FROM segs WHERE length(text) > 3 GROUP BY doc_id, number""",
)
def _(t: Tables) -> DataFrame:
    return sg.key_answers(s.marked(t, KEY), ["doc_id"])


# --- papers --------------------------------------------------------------------

PAPER = [
    ("A", "1\n"), ("B", "Time : 3 Hours\n"), ("C", "Part-B 12 Marks Each\n"), ("D", "2. "), ("E", "3 "), ("F", "Course Code : ABC123\n"),
    ("G", "Batch : 2024-2028\n"), ("H", "OR\n"), ("I", "14) CO2 "), ("L", "Course Name : Logic Sem: IV\n"), ("M", "CAE-1 Test\n"),
    ("N", "Part-A (7 x 2 = 14)\n"), ("O", "45. "), ("P", "Date: 01.02.2024\n"), ("Q", "Answer ALL questions CO1\n"),
    ("R", "(7 x 2 = 14)\n"), ("S", "Max. Marks : 50\n"), ("T", "C03 "), ("U", "Part-C\n(3 x 5 = 15)\n"), ("W", "21 CO4\n"),
]
_WB = r"([^\p{L}\p{N}_]|$)"
_LETTER = rf"upper(nullif(regexp_extract(raw, '(?i)Part[-\s–—]*([A-Z]){_WB}', 1), ''))"


def _mpq(x: str) -> str:
    return (
        f"coalesce(TRY_CAST(regexp_extract({x}, {sql_pattern(fv.MARKS_PRODUCT)}, 2) AS DOUBLE), "
        f"TRY_CAST(regexp_extract({x}, {sql_pattern(fv.MARKS_EACH)}, 1) AS DOUBLE))"
    )


PARTS = f"""heads AS (SELECT doc_id, i, {_LETTER} AS letter, coalesce({_mpq('raw')}, {_mpq("lead(raw) OVER (PARTITION BY doc_id ORDER BY i)")}) AS mpq FROM raw),
  parts AS (SELECT doc_id, letter, coalesce(arg_min(coalesce(mpq, -1), i), -1) AS mpq FROM heads WHERE letter IS NOT NULL GROUP BY ALL),
  partm AS (SELECT doc_id, letter, CASE WHEN mpq >= 0 THEN mpq WHEN letter = 'A' THEN 2.0 ELSE 12.0 END AS mpq FROM parts
    UNION ALL SELECT doc_id, 'A', 2.0 FROM marked WHERE doc_id NOT IN (SELECT doc_id FROM parts)),
  firstp AS (SELECT doc_id, min(letter) AS first_letter FROM partm GROUP BY 1)"""


@check(
    "paper_parts", "E9 H23",
    f"WITH {s.marked_sql(PAPER)}, {LINES}, {PARTS} SELECT doc_id, 'Part-' || letter AS part_name, mpq AS marks_per_question FROM partm",
)
def _(t: Tables) -> DataFrame:
    heads = pp.paper_headers(s.marked(t, PAPER), ["doc_id"])
    return heads.select("doc_id", F.explode(F.filter("parts", lambda p: p["letter"].isNotNull())).alias("p")).select(
        "doc_id", F.concat(F.lit("Part-"), F.col("p.letter")).alias("part_name"), "p.marks_per_question"
    )


def _field(field: str, cast: str = "", default: str = "''") -> str:
    patterns = [p for p, f in fv.HEADER_RULES if f == field]
    one = "coalesce(" + ", ".join(
        f"nullif({q.strip(f'regexp_extract(line, {sql_pattern(p)}, 1)')}, '')" for p in reversed(patterns)
    ) + ")"
    last = f"arg_max({one}, i) FILTER ({one} IS NOT NULL)"
    if field == "course_name":
        last = q.strip(rf"regexp_replace({last}, '(?i)\s+Sem\s*:.*', '')")
    return f"coalesce({'TRY_CAST(' + last + ' AS DOUBLE)' if cast else last}, {default}) AS {field}"


@check(
    "paper_headers", "H22",
    f"WITH {s.marked_sql(PAPER)}, {LINES} SELECT doc_id, " + ", ".join([
        _field("course_code"), _field("course_name"), _field("total_marks", "d", "0.0"), _field("duration_hours", "d", "2.0"),
        _field("batch"), _field("semester"), _field("date"), _field("exam_name"),
    ]) + " FROM lines GROUP BY doc_id",
)
def _(t: Tables) -> DataFrame:
    return pp.paper_headers(s.marked(t, PAPER), ["doc_id"]).select("doc_id", "header.*")


_CO = rf"(^|[^\p{{L}}\p{{N}}_])C[Oo0][0-9]"


def _untag(x: str) -> str:
    return q.strip(rf"regexp_replace(regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])C[Oo0][0-9]($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s{{2,}}', ' ', 'g')")


def _begins(words) -> str:
    # a boundary after a colon needs a word character next, after a word none
    each = [w + (r"[\p{L}\p{N}_]" if w.endswith(":") else _WB) for w in words]
    return f"regexp_matches(line, '(?i)^({'|'.join(each)})')"


def _num(p: str) -> str:
    return f"TRY_CAST(regexp_extract(line, {sql_pattern(p)}, 1) AS INT)"


def _rest(p: str) -> str:
    return _untag(f"regexp_extract(line, {sql_pattern(p)}, 2)")


FLOW = f"""fl AS (SELECT doc_id, i, line, CASE
      WHEN regexp_matches(line, '(?i)^Part[-\\s–—]*([A-Z]){_WB}') THEN 'part' WHEN regexp_matches(line, {sql_pattern(fv.OR_LINE)}) THEN 'or'
      WHEN {_num(fv.FLOW_NUMBER_ONLY)} BETWEEN 1 AND 30 THEN 'only'
      WHEN {_num(fv.FLOW_NUMBER_INLINE)} BETWEEN 1 AND 30 AND length({_rest(fv.FLOW_NUMBER_INLINE)}) > 2 THEN 'inline'
      WHEN {_num(fv.FLOW_NUMBER_BARE)} BETWEEN 1 AND 30 AND length({_rest(fv.FLOW_NUMBER_BARE)}) > 5 THEN 'bare' ELSE 'text' END AS kind
    FROM lines WHERE NOT ({_begins(fv.FLOW_SKIP_WORDS)}) AND NOT regexp_matches(line, {sql_pattern(fv.MARKS_LINE)})),
  fk AS (SELECT *, CASE WHEN kind IN ('only', 'inline', 'bare') THEN TRY_CAST(regexp_extract(line, '^\\d{{1,2}}') AS INT) END AS number,
      CASE kind WHEN 'text' THEN {_untag('line')} WHEN 'inline' THEN {_rest(fv.FLOW_NUMBER_INLINE)} WHEN 'bare' THEN {_rest(fv.FLOW_NUMBER_BARE)} ELSE '' END AS txt,
      CASE WHEN kind = 'part' THEN upper(regexp_extract(line, '(?i)^Part[-\\s–—]*([A-Z])', 1)) END AS letter FROM fl),
  fw AS (SELECT *, count(*) FILTER (kind = 'part') OVER w AS block, last_value(letter IGNORE NULLS) OVER w AS cur FROM fk WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  fb AS (SELECT *, count(number) OVER w AS q, count(*) FILTER (kind = 'or') OVER w AS ors FROM fw WINDOW w AS (PARTITION BY doc_id, block ORDER BY i)),
  fq AS (SELECT doc_id, block, q, i, number, kind AS mk, ors, cur,
      lag(ors, 1, 0) OVER (PARTITION BY doc_id, block ORDER BY i) AS ors_before FROM fb WHERE number IS NOT NULL),
  fp AS (SELECT fq.doc_id, fq.block, fq.q, fq.i, fq.number, fq.ors > fq.ors_before AS is_or, fq.cur, string_agg(t.txt, ' ' ORDER BY t.i) AS txt
    FROM fq LEFT JOIN fb t ON t.doc_id = fq.doc_id AND t.block = fq.block AND t.txt <> '' AND (t.q = fq.q
      OR (fq.q = 1 AND t.q = 0 AND t.kind = 'text' AND fq.mk <> 'bare' AND t.ors = fq.ors AND length(t.txt) > 8
        AND NOT {_begins(fv.FLOW_NOISE_WORDS).replace('(line', '(t.line')} AND NOT {_begins(fv.FLOW_NOISE_WORDS).replace('(line', '(t.txt')}))
    GROUP BY ALL),
  flow AS (SELECT doc_id, i, number AS question_number, {_untag('coalesce(txt, %s)' % "''")} AS question_text, coalesce(mpq, 2.0) AS marks,
      'Part-' || coalesce(cur, first_letter) AS part_name, is_or AS is_or_option
    FROM fp JOIN firstp USING (doc_id) LEFT JOIN partm ON partm.doc_id = fp.doc_id AND partm.letter = coalesce(cur, first_letter)
    WHERE length({_untag('coalesce(txt, %s)' % "''")}) >= 4)"""


@check(
    "paper_questions_flow_layout", "E4 E6 E7 H24 B10",
    f"WITH {s.marked_sql(PAPER)}, {LINES}, {PARTS}, {FLOW} SELECT doc_id, question_number, question_text, marks, part_name, is_or_option FROM flow",
)
def _(t: Tables) -> DataFrame:
    lines = pp.paper_lines(s.marked(t, PAPER), ["doc_id"], "text")
    return pp.flow_questions(lines, ["doc_id"]).drop("line_no")


LISTED = [
    ("A", "Q1. "), ("B", "2) "), ("C", "PART - B\n"), ("D", "(3) "), ("E", "4. Evaluate (4 marks)\n"), ("H", "(OR)\n"),
    ("I", "Q. 5: "), ("L", "60. "), ("N", "Part A 3 marks each\n"), ("O", "7] "), ("S", "Q9) see (OR) "), ("T", "10. Tell (6 Marks)\n"),
]
LIST = f"""ll AS (SELECT doc_id, i, line, raw, list_max(list_intersect(list_transform(regexp_extract_all(raw, '(?i)\\bPART\\s*[-–]?\\s*([A-Z])(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), lambda x: upper(x)),
      (SELECT list(letter) FROM partm WHERE partm.doc_id = lines.doc_id))) AS letter,
      {marker_sql('line', fv.LIST_MARKERS, 0, 99, 1)} AS number, {marker_sql('line', fv.LIST_MARKERS, 0, 99, 2)} AS rest,
      regexp_matches(line, {sql_pattern(fv.OR_LINE)}) AS is_or, regexp_matches(line, {sql_pattern(fv.LIST_PART_SKIP)}) AS skip,
      TRY_CAST(regexp_extract(line, {sql_pattern(fv.LIST_INLINE_MARKS)}, 1) AS DOUBLE) AS stated FROM lines),
  lw AS (SELECT *, last_value(letter IGNORE NULLS) OVER w AS cur, count(*) FILTER (number <= 50 OR letter IS NOT NULL) OVER w AS seg FROM ll WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  lq AS (SELECT doc_id, seg, max(i) FILTER (number <= 50) AS i, max(number) FILTER (number <= 50) AS number, max(cur) FILTER (number <= 50) AS cur, max(stated) FILTER (number <= 50) AS stated,
      string_agg(CASE WHEN number <= 50 THEN rest WHEN number > 50 OR is_or OR skip OR letter IS NOT NULL THEN NULL ELSE line END, ' ' ORDER BY i) AS txt,
      bool_or(is_or AND letter IS NULL) AS or_after FROM lw GROUP BY ALL),
  lo AS (SELECT *, coalesce(lag(or_after) OVER (PARTITION BY doc_id ORDER BY seg), false) AS is_or FROM lq),
  listed AS (SELECT lo.doc_id, i, number AS question_number, {q.strip(f'''regexp_replace({q.strip('txt')}, '\\s*\\(OR\\)\\s*', '', 'g')''')} AS question_text,
      coalesce(stated, mpq, 2.0) AS marks, 'Part-' || coalesce(cur, first_letter) AS part_name, is_or AS is_or_option
    FROM lo JOIN firstp USING (doc_id) LEFT JOIN partm ON partm.doc_id = lo.doc_id AND partm.letter = coalesce(cur, first_letter)
    WHERE number IS NOT NULL AND length({q.strip('txt')}) >= 5)"""


@check(
    "paper_questions_numbered_list", "E5 E6 E7",
    f"WITH {s.marked_sql(LISTED)}, {LINES}, {PARTS}, {LIST} SELECT doc_id, question_number, question_text, marks, part_name, is_or_option FROM listed",
)
def _(t: Tables) -> DataFrame:
    lines = pp.paper_lines(s.marked(t, LISTED), ["doc_id"], "text")
    return pp.list_questions(lines, ["doc_id"]).drop("line_no")


MINIMAL = f"""mini AS (SELECT doc_id, TRY_CAST(n AS INT) AS question_number, {q.strip('x')} AS question_text, k AS i FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, {q.quoted('(?:^|' + chr(92) + 'n)' + fv.MINIMAL_ITEM[1:])}, 1)) AS n,
      unnest(regexp_extract_all(text, {q.quoted('(?:^|' + chr(92) + 'n)' + fv.MINIMAL_ITEM[1:])}, 2)) AS x,
      generate_subscripts(regexp_extract_all(text, {q.quoted('(?:^|' + chr(92) + 'n)' + fv.MINIMAL_ITEM[1:])}, 1), 1) AS k FROM marked)
    WHERE TRY_CAST(n AS INT) BETWEEN 1 AND 30 AND length({q.strip('x')}) > 10)"""


@check(
    "minimal_questions", "E11",
    f"WITH {s.marked_sql(PAPER)}, {MINIMAL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, question_number, question_text FROM mini",
)
def _(t: Tables) -> DataFrame:
    return s.marked(t, PAPER).select(
        "doc_id", F.posexplode(pp.minimal_questions(F.col("text"))).alias("pos", "q")
    ).select("doc_id", "pos", "q.question_number", "q.question_text")


_MIXED = f"""{s.marked_sql(LISTED)}, {LINES}, {PARTS}, {FLOW}, {LIST}, {MINIMAL},
  every AS (SELECT 1 AS rank, 'flow' AS strategy, doc_id, i, question_number, question_text, marks, part_name, is_or_option FROM flow
    UNION ALL SELECT 2, 'list', doc_id, i, question_number, question_text, marks, part_name, is_or_option FROM listed
    UNION ALL SELECT 3, 'minimal', doc_id, i, question_number, question_text, 2.0, 'Part-A', false FROM mini),
  best AS (SELECT * FROM every QUALIFY rank = min(rank) OVER (PARTITION BY doc_id)),
  uniq AS (SELECT * FROM best WHERE length(question_text) >= 3 AND question_number > 0
    QUALIFY row_number() OVER (PARTITION BY doc_id, question_number, is_or_option ORDER BY i) = 1)"""


def _questions(t: Tables) -> DataFrame:
    return pp.paper_questions(s.marked(t, LISTED), ["doc_id"])


@check(
    "paper_questions", "E8 E12 B12",
    f"WITH {_MIXED} SELECT doc_id, strategy, question_number, question_text, marks, part_name, is_or_option FROM uniq",
)
def _(t: Tables) -> DataFrame:
    return _questions(t).drop("question_type")


@check(
    "paper_totals", "D7",
    f"""WITH {_MIXED}, sums AS (SELECT doc_id, sum(CASE WHEN is_or_option THEN 0 ELSE marks END) AS s, count(*) AS n FROM uniq GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS num_questions, coalesce(nullif(coalesce(s, 0.0), 0), 0.0) AS stored_total, coalesce(s, 0.0) AS reader_total
    FROM marked LEFT JOIN sums USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    heads = pp.paper_headers(s.marked(t, LISTED), ["doc_id"])
    return pp.paper_totals(_questions(t), heads, ["doc_id"])


@check(
    "questions_per_part", "D6",
    f"WITH {_MIXED} SELECT doc_id, part_name, count(*) AS num_questions, count(*) FILTER (NOT is_or_option) AS num_primary FROM uniq GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    return pp.part_counts(_questions(t), ["doc_id"])


# --- classification ---------------------------------------------------------------

FORMS = [
    "Which of the following is {n}? A) x B) y", "State whether true or false: {n}", "Fill in the blank: {n} is ___",
    "Calculate the total value of {n}", "Draw and explain the {n}", "Define {n}", "Explain {n} in detail", "On {n}",
    "Find {n}", "Choose the best {n}", "Complete the {n}", "List {n}. (a) one", "Compare {n} and others", "Who wrote {n}",
]


def _asked(t: Tables) -> DataFrame:
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    return t.part.select("p_partkey", F.replace(form, F.lit("{n}"), F.col("p_name")).alias("question"))


_ASKED = "asked AS (SELECT p_partkey, replace(CASE " + " ".join(
    f"WHEN p_partkey % {len(FORMS)} = {i} THEN {q.quoted(f)}" for i, f in enumerate(FORMS)
) + " END, '{n}', p_name) AS question FROM part)"


def _rx(x: str, p: str) -> str:
    return f"regexp_matches({x}, {sql_pattern(p)})"


_RULES = [
    _rx("question", fv.CLASSIFY_OPTION_CASED) + " OR " + " OR ".join(_rx("lower(question)", p) for p in fv.CLASSIFY_OPTION),
    _rx("lower(question)", fv.CLASSIFY_TRUE_FALSE), _rx("lower(question)", fv.CLASSIFY_BLANK),
    _rx("lower(question)", fv.CLASSIFY_COMPUTE) + " AND " + _rx("lower(question)", fv.CLASSIFY_QUANTITY),
    _rx("lower(question)", fv.CLASSIFY_DRAW),
    _rx("lower(question)", fv.CLASSIFY_SHORT) + f" AND len({q.words('question')}) < 30",
    _rx("lower(question)", fv.CLASSIFY_ESSAY),
]


def _case(part: int) -> str:
    value = lambda r: q.quoted(r[part]) if isinstance(r[part], str) else f"{r[part]}::DOUBLE"
    return "CASE " + " ".join(
        f"WHEN {cond} THEN {value(rule)}" for cond, rule in zip(_RULES, fv.CLASSIFIER_RULES)
    ) + f" ELSE {value(fv.CLASSIFIER_RULES[-1])} END"


@check(
    "question_types", "H20",
    f"WITH {_ASKED} SELECT p_partkey, {_case(0)} AS question_type, {_case(1)} AS confidence FROM asked",
)
def _(t: Tables) -> DataFrame:
    return _asked(t).withColumn("c", cl.classify(F.col("question"))).select(
        "p_partkey", "c.question_type", "c.confidence"
    )


_COMPACT = "CASE " + " ".join(
    f"WHEN {_rx('lower(question)' if low else 'question', p)} THEN '{k}'" for k, p, low in fv.COMPACT_RULES
) + " ELSE 'open_ended' END"


@check("question_types_compact", "H21", f"WITH {_ASKED} SELECT p_partkey, {_COMPACT} AS question_type FROM asked")
def _(t: Tables) -> DataFrame:
    return _asked(t).select("p_partkey", cl.compact_type(F.col("question")).alias("question_type"))


@check(
    "question_types_from_replies", "H34",
    f"""WITH {_ASKED}, r AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'numerical' WHEN 1 THEN 'diagram' END AS kind FROM asked)
    SELECT p_partkey, coalesce(kind, {_case(0)}) AS question_type, CASE WHEN kind IS NULL THEN 'rule_based' ELSE 'llm' END AS method,
      CASE kind WHEN 'numerical' THEN 0.75::DOUBLE WHEN 'diagram' THEN 0.8::DOUBLE ELSE {_case(1)} END AS confidence FROM r""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    reply = (
        F.when(k == 0, '```json\n{"question_type": " Numerical", "confidence": "0.75"}\n```')
        .when(k == 1, 'Sure: {"question_type": "diagram", "reasoning": "x"} done')
        .when(k == 2, '{"question_type": "riddle"}')
        .when(k == 3, "no json")
    )
    return _asked(t).withColumn("c", cl.classify_with_reply(F.col("question"), reply)).select(
        "p_partkey", "c.question_type", "c.method", "c.confidence"
    )


# --- chunk outputs ------------------------------------------------------------------


@check(
    "longest_answers_across_chunks", "F3",
    """SELECT conv_id, role, arg_max(text, (length(text), -turn)) AS answer_text FROM conversations GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.conversations.withColumnRenamed("text", "answer_text")
    return pg.longest_answers(rows, ["conv_id", "role"], "turn")


@check(
    "merged_chunk_answers", "G2 H26",
    """WITH p AS (SELECT conv_id, role, turn, trim(text, ' ' || chr(10)) AS text FROM conversations)
    SELECT conv_id, role, list_reduce(list(text ORDER BY turn), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || chr(10) || x END) AS answer_text
    FROM p GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "role", "turn", F.col("text").alias("answer_text"))
    # the same piece again under a later number must not be appended twice
    again = rows.withColumn("turn", F.col("turn") + 100)
    return pg.merge_chunks(rows.unionByName(again), ["conv_id", "role"], "turn")
