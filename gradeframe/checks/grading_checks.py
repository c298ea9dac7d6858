"""Grading, coverage and score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.checks import sqltext as q, standins as s
from gradeframe.checks.registry import Tables, check
from gradeframe.functions import extract, rounding, scoring, text as tx
from gradeframe.operators import reports
from gradeframe.operators.skew import salted_left_join
from gradeframe.plans.grading import grade, objective_grades, prepare_keys
from gradeframe.plans.scorer import apply_scorer

KINDS = ["open_ended", "short_answer", "fill_blank", "diagram", "open_ended"]


def graded_conversations(t: Tables) -> DataFrame:
    """Every user turn graded against the reply that follows it.

    Model outputs come from the ids, as a stand-in for a score table.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = s.qa_pairs(t).select(
        conv.alias("booklet_id"), turn.alias("question_number"),
        F.col("student").alias("answer_text"), F.col("teacher").alias("teacher_answer"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), ((conv + turn) % 5 + 1).cast("int")).alias(
            "question_type"
        ),
        (turn * 2 + 2).cast("double").alias("max_marks"),
        ((conv * 7 + turn * 3) % 11 / 10 * (turn * 2 + 2)).alias("llm_score"),
        ((conv * 13 + turn) % 100 / 100).alias("similarity_score"),
        ((conv + turn) % 5 / 4).alias("rubric_score"),
        (conv % 3 == 0).alias("has_diagram"),
    )
    return grade(prepare_keys(rows))


GRADED = f"""{q.QA}, inputs AS (
  SELECT conv_id AS booklet_id, turn AS question_number, student, teacher,
    CASE (conv_id + turn) % 5 WHEN 1 THEN 'short_answer' WHEN 2 THEN 'fill_blank'
      WHEN 3 THEN 'diagram' ELSE 'open_ended' END AS question_type,
    (turn * 2 + 2)::DOUBLE AS max_marks,
    ((conv_id * 7 + turn * 3) % 11)::DOUBLE / 10 * (turn * 2 + 2) AS llm,
    ((conv_id * 13 + turn) % 100)::DOUBLE / 100 AS sim, ((conv_id + turn) % 5)::DOUBLE / 4 AS rub,
    conv_id % 3 = 0 AS has_diagram, {q.normalize('student')} AS cleaned
  FROM qa), parts AS (
  SELECT *, {q.keywords('cleaned')} AS ks, {q.keywords('teacher')} AS kt,
    len({q.words('cleaned')}) AS ws, len({q.words('teacher')}) AS wt FROM inputs), comp AS (
  SELECT *,
    CASE WHEN question_type IN ('open_ended', 'short_answer') THEN {q.coverage('ks', 'kt')} ELSE 0.0 END AS keyword_score,
    CASE WHEN question_type IN ('open_ended', 'short_answer') THEN {q.length_norm('ws', 'wt')} ELSE 0.0 END AS length_score
  FROM parts), raw AS (
  SELECT *, CASE WHEN question_type IN ('open_ended', 'short_answer') THEN
      (0.4::DOUBLE * (llm / max_marks) + 0.25::DOUBLE * sim
       + 0.2::DOUBLE * (CASE WHEN question_type = 'open_ended' THEN rub ELSE 0.0 END)
       + 0.1::DOUBLE * keyword_score + 0.05::DOUBLE * length_score) * max_marks
      ELSE llm END AS raw_score FROM comp), capped AS (
  SELECT *, greatest(0.0, least(max_marks, raw_score)) AS c FROM raw), rounded AS (
  SELECT *, {q.exact_round2('c')} AS r FROM capped), graded AS (
  SELECT booklet_id, question_number, question_type, max_marks, keyword_score, length_score,
    CASE WHEN question_type = 'diagram' AND has_diagram AND r < max_marks * 0.2
      THEN round_even(max_marks * 0.2, 2) ELSE r END AS final_score FROM rounded)"""


@check(
    "grade_conversation_answers", "H5 H6 H7 H14 H16 H17 B7",
    f"WITH {GRADED} SELECT booklet_id, question_number, question_type, max_marks, "
    "keyword_score, length_score, final_score FROM graded",
)
def _(t: Tables) -> DataFrame:
    return graded_conversations(t).select(
        "booklet_id", "question_number", "question_type", "max_marks", "keyword_score",
        "length_score", "final_score",
    )


@check(
    "booklet_totals", "D4 B8 B9",
    f"""WITH {GRADED}, sums AS (SELECT booklet_id, sum(final_score::DECIMAL(18, 2))::DOUBLE AS o, sum(max_marks) AS p, count(*) AS n
      FROM graded GROUP BY 1), shares AS (SELECT *, {q.text_round1('100 * o / p')} AS share FROM sums)
    SELECT booklet_id, round_even(o, 2) AS total_obtained, p AS total_possible,
      coalesce(share, 0.0) AS percentage,
      CASE WHEN share >= 60 THEN 'pass' WHEN share >= 40 THEN 'borderline' ELSE 'fail' END AS grade_band,
      n || ' / ' || n AS progress FROM shares""",
)
def booklet_totals(t: Tables) -> DataFrame:
    return reports.booklet_totals(graded_conversations(t))


@check(
    "keyword_coverage_by_source", "H5 H6 G1",
    f"""WITH longest AS (SELECT source, arg_max(text, (length(text), -doc_id)) AS teacher
        FROM documents GROUP BY source), sets AS (
      SELECT doc_id, {q.keywords('text')} AS ks, kt FROM documents
      JOIN (SELECT source, {q.keywords('teacher')} AS kt FROM longest) USING (source))
    SELECT doc_id, len(list_intersect(kt, ks)) AS shared, len(kt) AS key_size,
      {q.coverage('ks', 'kt')} AS keyword_score FROM sets""",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents
    keys = (
        docs.groupBy("source")
        .agg(F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("teacher"))
        .select("source", tx.keywords(F.col("teacher")).alias("kt"))
    )
    # few sources, one of which may hold much of the table: its documents are spread over many tasks
    rows = docs.filter("source is not null").select("doc_id", "source", tx.keywords(F.col("text")).alias("ks"))
    sets = salted_left_join(rows, keys, ["source"], ["doc_id"], 64)
    return sets.select(
        "doc_id",
        F.size(F.array_intersect("kt", "ks")).cast("long").alias("shared"),
        F.size("kt").cast("long").alias("key_size"),
        tx.keyword_coverage(F.col("ks"), F.col("kt")).alias("keyword_score"),
    )


@check(
    "length_ratio", "H7",
    f"WITH {q.QA} SELECT conv_id, turn, "
    + q.length_norm(f"len({q.words('student')})", f"len({q.words('teacher')})")
    + " AS length_score FROM qa",
)
def _(t: Tables) -> DataFrame:
    return s.qa_pairs(t).select(
        "conv_id", "turn",
        tx.length_norm(tx.word_count(F.col("student")), tx.word_count(F.col("teacher"))).alias(
            "length_score"
        ),
    )


# The driver texts hold accented letters; written as plain letters outside A–E and
# the word lists they count as word characters in every engine.
PLAIN = r"regexp_replace(text, '[^\x00-\x7F]', 'z', 'g')"


def _plain(column: str = "text"):
    return F.regexp_replace(column, r"[^\x00-\x7F]", "z")


OPTION_SQL = "upper(coalesce(" + ", ".join(
    f"nullif(regexp_extract(text, {q.quoted(p.replace('(?iUm)', '(?im)'))}, 1), '')"
    for p in fv.OPTION_PATTERNS
) + "))"


@check(
    "option_letter", "H8",
    f"WITH p AS (SELECT doc_id, {PLAIN} AS text FROM documents) "
    f"SELECT doc_id, {OPTION_SQL} AS option_letter FROM p",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", extract.option_letter(_plain()).alias("option_letter"))


TRUE_SQL = fv.TRUE_WORDS.replace("(?U)", "")
FALSE_SQL = fv.FALSE_WORDS.replace("(?U)", "")


@check(
    "truth_value", "H9",
    f"""WITH p AS (SELECT doc_id, lower(regexp_replace(left_words, '[^\\x00-\\x7F]', 'z', 'g')) AS text
      FROM (SELECT doc_id, text AS left_words FROM documents))
    SELECT doc_id, CASE WHEN regexp_matches(text, '{TRUE_SQL}') AND NOT regexp_matches(text, '{FALSE_SQL}') THEN 'TRUE'
      WHEN regexp_matches(text, '{FALSE_SQL}') AND NOT regexp_matches(text, '{TRUE_SQL}') THEN 'FALSE' END AS truth
    FROM p""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", extract.truth_value(_plain()).alias("truth"))


NUMBERED = (
    "'lines ' || l_linenumber || ' cost 1,' || l_partkey || ' then ' || "
    "CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_quantity::INT || '.5 or -' || l_suppkey END"
)


@check(
    "last_number", "H10",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {NUMBERED} AS text FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      regexp_extract_all(replace(text, ',', ''), '-?\\d+(?:\\.\\d+)?')[-1]::DOUBLE AS number FROM p""",
)
def _(t: Tables) -> DataFrame:
    def s_(c: str):
        return F.col(c).cast("string")

    text = F.concat(
        F.lit("lines "), s_("l_linenumber"), F.lit(" cost 1,"), s_("l_partkey"), F.lit(" then "),
        F.when(F.col("l_returnflag") == "N", "none").otherwise(
            F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5 or -"), s_("l_suppkey"))
        ),
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", extract.last_number(text).alias("number")
    )


@check(
    "objective_grades", "H11 H12 H13 H45",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS marks,
        CASE l_partkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'true_false' ELSE 'numerical' END AS kind,
        CASE l_partkey % 3 WHEN 0 THEN CASE WHEN l_tax = 0 THEN '' ELSE substr('ABCDE', (l_partkey % 5 + 1)::INT, 1) END
          WHEN 1 THEN CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'false' END
          ELSE (l_extendedprice::BIGINT * 1000)::VARCHAR END AS k,
        CASE l_partkey % 3 WHEN 0 THEN CASE WHEN l_returnflag = 'N' THEN '42' ELSE 'Ans: ' || substr('abcde', (l_suppkey % 5 + 1)::INT, 1) END
          WHEN 1 THEN CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no way' ELSE 'maybe' END
          ELSE CASE WHEN l_returnflag = 'R' THEN 'none' ELSE 'R = ' || (l_extendedprice::BIGINT * 1000 + l_suppkey) || '.25' END END AS answer
      FROM lineitem), d AS (SELECT *,
        CASE WHEN kind = 'mcq' AND k <> '' THEN upper(nullif(regexp_extract(answer, 'Ans: ([a-e])', 1), ''))
          WHEN kind = 'true_false' THEN CASE answer WHEN 'yes' THEN 'TRUE' WHEN 'no way' THEN 'FALSE' END
          WHEN kind = 'numerical' AND answer <> 'none' THEN regexp_extract(answer, '\\d+\\.\\d+') END AS detected
      FROM a), g AS (SELECT *, CASE WHEN kind = 'mcq' AND k = '' THEN NULL
          WHEN kind IN ('mcq', 'true_false') THEN coalesce(detected = upper(k), false)
          WHEN detected IS NOT NULL THEN abs(detected::DOUBLE - k::DOUBLE) <= abs(k::DOUBLE * 0.01)
            OR abs(detected::DOUBLE - k::DOUBLE) < 0.001 END AS ok FROM d)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, ok AS is_correct,
      kind <> 'numerical' OR detected IS NOT NULL AS handled,
      CASE WHEN kind <> 'numerical' OR detected IS NOT NULL THEN CASE WHEN ok THEN marks ELSE 0.0 END END AS score,
      CASE WHEN kind = 'mcq' AND k = '' THEN 'Correct option not provided for MCQ grading.'
        WHEN kind = 'mcq' AND ok THEN '✅ Correct! You selected option ' || detected || '.'
        WHEN kind = 'true_false' AND ok THEN '✅ Correct! The answer is ' || upper(k) || '.'
        WHEN kind <> 'numerical' THEN '❌ Incorrect. Detected ''' || coalesce(detected, 'unclear') || ''', correct answer is ''' || upper(k) || '''.'
        WHEN ok THEN '✅ Correct numerical answer: ' || detected::DOUBLE || ' (expected ' || k::DOUBLE || ').'
        WHEN detected IS NOT NULL THEN '❌ Numerical answer ' || detected::DOUBLE || ' outside tolerance. Expected ' || k::DOUBLE || '.'
      END AS feedback FROM g""",
)
def _(t: Tables) -> DataFrame:
    part, flag = F.col("l_partkey"), F.col("l_returnflag")
    price = F.rint("l_extendedprice").cast("long")
    letter = lambda letters, c: F.substring(F.lit(letters), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    kind = F.when(part % 3 == 0, "mcq").when(part % 3 == 1, "true_false").otherwise("numerical")
    key = (
        F.when(part % 3 == 0, F.when(F.col("l_tax") == 0, "").otherwise(letter("ABCDE", "l_partkey")))
        .when(part % 3 == 1, F.when(F.col("l_linestatus") == "O", "True").otherwise("false"))
        .otherwise((price * 1000).cast("string"))
    )
    answer = (
        F.when(
            part % 3 == 0,
            F.when(flag == "N", "42").otherwise(F.concat(F.lit("Ans: "), letter("abcde", "l_suppkey"))),
        )
        .when(part % 3 == 1, F.when(flag == "A", "yes").when(flag == "N", "no way").otherwise("maybe"))
        .otherwise(
            F.when(flag == "R", "none").otherwise(
                F.concat(F.lit("R = "), (price * 1000 + F.col("l_suppkey")).cast("string"), F.lit(".25"))
            )
        )
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.lineitem.select(
        *keys, F.col("l_quantity").alias("marks"), kind.alias("kind"), key.alias("k"), answer.alias("answer")
    )
    graded = objective_grades(rows, "kind", "answer", "k", "marks")
    return graded.select(
        *keys, "kind", "is_correct", "handled", F.col("objective_score").alias("score"),
        "feedback",
    )


@check(
    "external_option_fallback", "H11 H38",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'A'
        WHEN value / 500 < 0.5 THEN upper(substr(event_type, 1, 1)) END AS detected,
      coalesce(CASE WHEN event_type = 'click' THEN 'A'
        WHEN value / 500 < 0.5 THEN upper(substr(event_type, 1, 1)) END = 'E', false) AS is_correct FROM events""",
)
def _(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.lit("mcq").alias("kind"), F.lit("E").alias("k"), F.lit(1.0).alias("marks"),
        F.when(F.col("event_type") == "click", "(a)").otherwise("42").alias("answer"),
        (F.col("value") / 500).alias("sure"), F.substring("event_type", 1, 1).alias("offered"),
    )
    graded = objective_grades(rows, "kind", "answer", "k", "marks", "sure", "offered")
    return graded.select(
        "event_id", F.nullif("detected_answer", F.lit("")).alias("detected"), "is_correct"
    )


@check(
    "diagram_floor", "H17",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_returnflag = 'R' AND l_tax * 100 < l_quantity * 0.2 THEN round_even(l_quantity * 0.2, 2)
        ELSE l_tax * 100 END + 0.0 AS score FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (scoring.with_floor(F.col("l_tax") * 100, F.col("l_returnflag") == "R", F.col("l_quantity"))
         + F.lit(0.0)).alias("score"),
    )


@check(
    "component_routing", "H16",
    """SELECT question_type, count(*) AS n,
      sum(CASE WHEN question_type IN ('open_ended', 'short_answer') THEN 1 ELSE 0 END)::BIGINT AS similarity,
      sum(CASE WHEN question_type = 'open_ended' THEN 1 ELSE 0 END)::BIGINT AS rubric,
      sum(CASE WHEN question_type IN ('mcq', 'true_false', 'numerical') THEN 1 ELSE 0 END)::BIGINT AS objective
    FROM (SELECT CASE l_partkey % 8 WHEN 0 THEN 'mcq' WHEN 1 THEN 'true_false' WHEN 2 THEN 'fill_blank'
      WHEN 3 THEN 'short_answer' WHEN 4 THEN 'numerical' WHEN 5 THEN 'open_ended'
      WHEN 6 THEN 'diagram' ELSE '' END AS question_type FROM lineitem) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    routed = s.questions(t).withColumn("u", scoring.uses_components(F.col("question_type")))
    return routed.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(f"u.{c}").alias(c) for c in ("similarity", "rubric", "objective")],
    )


@check(
    "clamp_and_percent", "B7 B8 B9",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        greatest(0.0, least(20.0, l_quantity * 1.115 - 5)) AS x FROM lineitem), r AS (
      SELECT *, {q.exact_round2('x')} AS score FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score,
      coalesce(round_even(100.0 * score / 20.0, 1), 0.0) AS percentage,
      CASE WHEN round_even(100.0 * score / 20.0, 1) >= 60 THEN 'pass'
        WHEN round_even(100.0 * score / 20.0, 1) >= 40 THEN 'borderline' ELSE 'fail' END AS grade_band FROM r""",
)
def _(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    raw = t.lineitem.select(*keys, (F.col("l_quantity") * 1.115 - 5).alias("x"))
    scored = raw.select(*keys, scoring.final_score(F.col("x"), F.lit(20.0)).alias("score"))
    share = rounding.percent(F.col("score"), F.lit(20.0))
    return scored.select(*keys, "score", share.alias("percentage"), scoring.grade_band(share).alias("grade_band"))


@check(
    "batch_with_failures", "D5 D30 J1",
    f"""WITH {q.QA}, m AS (SELECT *, CASE WHEN length(student) % 10 = 0 THEN 1 ELSE 0 END AS bad FROM qa)
    SELECT turn, (count(*) - sum(bad))::BIGINT AS evaluated, sum(bad)::BIGINT AS errors, count(*) AS total,
      round(sum(CASE WHEN bad = 1 THEN 0 ELSE least(1.0, length(student)::DOUBLE / length(teacher)) * 10 END), 4) AS score
    FROM m GROUP BY turn""",
)
def _(t: Tables) -> DataFrame:
    def scorer(rows):
        if (rows["student"].str.len() % 10 == 0).any():
            raise ValueError("cannot score")
        return (rows["student"].str.len() / rows["teacher"].str.len()).clip(upper=1.0) * 10

    scored = apply_scorer(s.qa_pairs(t).select("turn", "student", "teacher"), scorer, "ai_score").select(
        "turn", F.col("ai_score").alias("score"),
        F.when(F.col("problem").isNotNull(), "error").otherwise("evaluated").alias("status"),
    )
    return reports.batch_summary(scored, ["turn"], "score").withColumn("score", F.round("score", 4))
