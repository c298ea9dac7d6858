"""Model reply, prompt, rubric, page, region and corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.checks import sqltext as q, standins as s
from gradeframe.checks.registry import Tables, check
from gradeframe.functions import prompts as pr, regions as rg, replies as rp
from gradeframe.operators import pages as pg, regions as ro, rubric as rb
from gradeframe.sources import labels as lb


def _reply(kind: str):
    value = F.col("value").cast("string")
    return (
        F.when(F.col("event_type") == "click", F.concat(F.lit('```json\n{"score": '), value, F.lit(
            ', "confidence": "0.85", "strengths": ["a", "b"], "missing_concepts": "none", "feedback": "ok"}\n```')))
        .when(F.col("event_type") == "view", F.concat(F.lit('Result: {"score": "'), value, F.lit('", "confidence": 1.5} thanks')))
        .when(F.col("event_type") == "purchase", F.lit("not valid json {{{{"))
        .when(F.col("event_type") == "signup", F.lit('{"score": "high", "feedback": "x"}'))
        .otherwise(F.lit('{"confidence": 0.4, "missing_concepts": ["m"]}'))
    )


def _reply_sql(unparsed_confidence: float, clamp: bool) -> str:
    return f"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN least(100.0, value) ELSE 0.0 END::DOUBLE AS score,
      CASE event_type WHEN 'click' THEN 0.85 WHEN 'view' THEN {1.0 if clamp else 1.5} WHEN 'purchase' THEN {unparsed_confidence} WHEN 'signup' THEN 0.0 ELSE 0.4 END::DOUBLE AS confidence,
      CASE event_type WHEN 'click' THEN 2 ELSE 0 END::BIGINT AS strengths, CASE event_type WHEN 'error' THEN 1 ELSE 0 END::BIGINT AS missing FROM events"""


def _decoded(t: Tables, decoder) -> DataFrame:
    return t.events.withColumn("r", decoder(_reply("x"), F.lit(100.0))).select(
        "event_id", "r.score", "r.confidence", F.size("r.strengths").cast("long").alias("strengths"),
        F.size("r.missing_concepts").cast("long").alias("missing"),
    )


@check("graded_replies", "H29", _reply_sql(0.3, True))
def _(t: Tables) -> DataFrame:
    return _decoded(t, rp.graded_reply)


@check("simple_replies", "H30", _reply_sql(0.7, False))
def _(t: Tables) -> DataFrame:
    return _decoded(t, rp.simple_reply)


@check(
    "repaired_answer_lists", "H31",
    """WITH p AS (SELECT conv_id, turn, role, replace(text, chr(10), ' | ') AS txt FROM conversations)
    SELECT conv_id, turn, (turn + 1)::BIGINT AS question_number, CASE role WHEN 'user' THEN txt || chr(10) || 'C:\\y' WHEN 'assistant' THEN txt || ' "q" ' ELSE txt END AS answer_text,
      CASE role WHEN 'assistant' THEN CASE WHEN turn + 1 >= 8 THEN 'Part-B' ELSE 'Part-A' END ELSE 'Part-A' END AS part_name FROM p
    UNION ALL SELECT conv_id, turn, 9, '', 'Part-B' FROM p WHERE role NOT IN ('user', 'assistant')""",
)
def _(t: Tables) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(" | "))
    number = (F.col("turn") + 1).cast("string")
    whole = F.concat(
        F.lit('{"answers": [{"question_number": '), number, F.lit(', "answer_text": "'), text,
        F.lit('\nC:\\y", "part_name": "Part-A"}]}'),
    )
    # an object with a bare quote that no parser accepts: read field by field
    broken = F.concat(
        F.lit('{"answers": [{"question_number": '), number, F.lit(' "oops", "answer_text": "'), text, F.lit(' \\"q\\" "}]}')
    )
    cut = F.concat(
        F.lit('{"answers": [{"question_number": "'), number, F.lit('", "answer_text": "'), text,
        F.lit('", "part_name": "Part-A"}, {"question_number": 9, "answer_te'), F.lit("}"),
    )
    raw = F.when(F.col("role") == "user", whole).when(F.col("role") == "assistant", broken).otherwise(cut)
    rows = t.conversations.select("conv_id", "turn", raw.alias("raw"))
    return rows.select("conv_id", "turn", F.explode(F.filter(rp.answer_list(F.col("raw")), lambda a: a["question_number"].isNotNull())).alias("a")).select(
        "conv_id", "turn", "a.question_number", "a.answer_text", "a.part_name"
    )


@check(
    "answer_maps", "H32",
    """WITH p AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS txt FROM conversations)
    SELECT conv_id, turn, (turn + 1)::BIGINT AS question_number, txt AS answer_text FROM p
    UNION ALL SELECT conv_id, turn, 90123456789, 'second' FROM p WHERE role <> 'user'""",
)
def _(t: Tables) -> DataFrame:
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    number = (F.col("turn") + 1).cast("string")
    listed = F.concat(
        F.lit('```json\n{"answers": [{"question_number": '), number, F.lit(', "answer_text": " '), text,
        F.lit('\n"}, {"question_number": "x", "answer_text": "no"}, {"question_number": 5, "answer_text": " "}]}\n```'),
    )
    direct = F.concat(F.lit('{"'), number, F.lit('": "'), text, F.lit('", "90123456789": "second", "note": "skip"}'))
    raw = F.when(F.col("role") == "user", listed).otherwise(direct)
    return t.conversations.select("conv_id", "turn", F.explode(F.map_entries(rp.answer_map(raw))).alias("e")).select(
        "conv_id", "turn", F.col("e.key").alias("question_number"), F.col("e.value").alias("answer_text")
    )


@check(
    "closed_replies", "H33",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN user_id::INT ELSE 1 END AS first_number,
      CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN NULL ELSE 2 END AS n FROM events""",
)
def _(t: Tables) -> DataFrame:
    raw = (
        F.when(F.col("event_type") == "click", F.concat(
            F.lit('{"questions": [{"n": '), F.col("user_id").cast("string"), F.lit('}, {"n": 2, "te')))
        .when(F.col("event_type") == "error", "nothing to close")
        .otherwise('```json\n{"questions": [{"n": 1}, {"n": 2}]}\n```')
    )
    body = F.from_json(rp.closed_json(raw), "questions array<struct<n:int>>")
    return t.events.withColumn("b", body).select(
        "event_id", F.get("b.questions", F.lit(0))["n"].alias("first_number"),
        F.when(F.col("b.questions").isNotNull(), F.size("b.questions")).alias("n"),
    )


@check(
    "provider_fallback", "H35",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'first' WHEN event_type = 'error' THEN 'offline' ELSE 'second' END AS provider,
      CASE WHEN event_type IN ('click', 'view') THEN 1.0 WHEN event_type = 'error' THEN 5.0 ELSE 2.0 END::DOUBLE AS score,
      CASE WHEN event_type = 'error' THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM events""",
)
def _(t: Tables) -> DataFrame:
    first = F.when(F.col("event_type").isin("click", "view"), '{"score": 1}')
    second = F.when(F.col("event_type") != "error", '{"score": 2}')
    chosen = rp.first_reply([first, second], ["first", "second"])
    return t.events.withColumn("c", chosen).withColumn(
        "r", rp.graded_reply(F.col("c.text"), F.lit(10.0))
    ).select("event_id", "c.provider", "r.score", "r.confidence")


@check(
    "cover_fields", "H36",
    """SELECT o_orderkey, 'R' || o_custkey AS roll_number, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS exam_name, '' AS semester FROM orders""",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit('```json {"roll_number": "R'), F.col("o_custkey").cast("string"), F.lit('"'),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(
            F.concat(F.lit(', "exam_name": "'), F.col("o_orderpriority"), F.lit('"'))
        ),
        F.lit("} ```"),
    )
    return t.orders.withColumn("c", rp.cover_fields(raw)).select(
        "o_orderkey", "c.roll_number", "c.exam_name", "c.semester"
    )


@check(
    "rendered_prompts", "H37",
    f"""WITH {q.QA} SELECT conv_id, turn, {q.quoted(pr._BODY).replace("'{instruction}", "CASE turn % 2 WHEN 0 THEN " + q.quoted(pr.INSTRUCTIONS['rubric']) + " ELSE " + q.quoted(pr.INSTRUCTIONS['short_answer']) + " END || '")
      .replace('{question}', "Q' || turn || '").replace('{teacher_answer}', "' || teacher || '").replace('{student_answer}', "' || student || '")
      .replace('{max_marks}', "5.0").replace('{rubric}', "' || CASE turn % 2 WHEN 0 THEN 'Rubric:' || chr(10) || '  - facts: 2.0 marks' || chr(10) || '  - style: 1.5 marks' || chr(10) ELSE '' END || '")} AS prompt FROM qa""",
)
def _(t: Tables) -> DataFrame:
    row = lambda c, m: F.struct(F.lit(c).alias("criterion"), F.lit(m).alias("marks"))
    rubric = F.when(F.col("turn") % 2 == 0, F.array(row("facts", 2.0), row("style", 1.5)))
    kind = F.when(F.col("turn") % 2 == 0, "open_ended").otherwise("short_answer")
    return s.qa_pairs(t).select(
        "conv_id", "turn",
        pr.prompt(kind, F.concat(F.lit("Q"), F.col("turn").cast("string")), F.col("teacher"), F.col("student"), F.lit(5.0), rubric).alias("prompt"),
    )


@check(
    "option_prompts", "H38",
    "SELECT p_partkey, " + q.quoted(pr.OPTION_TEMPLATE).replace("{question}", "' || p_name || '").replace("{option_a}", "' || p_brand || '")
    .replace("{option_b}", "' || p_type || '").replace("{option_c}", "").replace("{option_d}", "").replace("{student_answer}", "' || p_size || '") + " AS prompt FROM part",
)
def _(t: Tables) -> DataFrame:
    options = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"))
    values = F.map_concat(options, F.create_map(F.lit("C"), F.lit(None).cast("string"), F.lit("D"), F.lit("")))
    return t.part.select("p_partkey", pr.option_prompt(F.col("p_name"), values, F.col("p_size").cast("string")).alias("prompt"))


@check(
    "rubric_coverage", "D23",
    f"""WITH {q.QUESTIONS}, r AS (SELECT * FROM (SELECT {q.QUESTION_ID} AS id, 'tax' AS c, l_linenumber AS m, l_tax * 10 AS p FROM lineitem
      UNION ALL SELECT {q.QUESTION_ID}, 'disc', 2, l_discount * 10 FROM lineitem UNION ALL SELECT {q.QUESTION_ID}, 'size', 3, l_quantity / 50 FROM lineitem) WHERE m > 1),
    s AS (SELECT id, sum(m)::DOUBLE AS total, sum(CASE WHEN p >= 0.5 THEN m ELSE 0 END)::DOUBLE AS earned, string_agg(c || (p >= 0.5)::INT, ',' ORDER BY c) AS shown FROM r GROUP BY 1)
    SELECT id AS answer_id, CASE WHEN open THEN total ELSE 0.0 END AS total_rubric_marks, CASE WHEN open THEN earned ELSE 0.0 END AS earned_rubric_marks,
      CASE WHEN open THEN round_even(earned / total, 3) ELSE 0.0 END AS coverage_ratio, CASE WHEN open THEN shown END AS shown
    FROM (SELECT id, question_type NOT IN ('mcq', 'true_false', 'numerical') AS open FROM questions) JOIN s USING (id)""",
)
def _(t: Tables) -> DataFrame:
    row = lambda c, m, p: F.struct(F.lit(c).alias("criterion"), m.cast("double").alias("marks"), p.alias("probability"))
    scores = t.lineitem.select(
        s.question_id(t).alias("answer_id"),
        F.inline(F.array(
            row("tax", F.col("l_linenumber"), F.col("l_tax") * 10), row("disc", F.lit(2), F.col("l_discount") * 10),
            row("size", F.lit(3), F.col("l_quantity") / 50),
        )),
    ).filter("marks > 1")
    answers = s.questions(t).select(F.col("id").alias("answer_id"), "question_type")
    covered = rb.rubric_coverage(answers, scores)
    shown = F.transform(F.map_entries("criteria_scores"), lambda e: F.concat(e["key"], e["value"].cast("string")))
    return covered.select(
        "answer_id", "total_rubric_marks", "earned_rubric_marks", "coverage_ratio", F.array_join(shown, ",").alias("shown")
    )


# --- pages -------------------------------------------------------------------------

ENGINES = ["google", "mistral", "azure", "paddle", "tesseract", "trocr"]


def _results(t: Tables) -> DataFrame:
    """Events as recognition results: one page per user, one engine per (user, kind)."""
    engine = F.element_at(F.array(*[F.lit(e) for e in ENGINES]), (F.col("user_id") * 7 % 4 + F.col("kind")).cast("int"))
    kinds = t.events.select(
        "user_id", "event_id", "value",
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3).alias("kind"),
    )
    text = F.repeat(F.lit("ab 1 "), (F.col("value") / 60).cast("int"))
    return kinds.select(
        F.pmod(F.col("event_id"), F.lit(5000)).alias("page"), engine.alias("engine"), text.alias("text"),
        (F.rint(F.col("value")) % 100 / 100).alias("confidence"), "event_id",
    )


_RESULTS = f"""res AS (SELECT event_id % 5000 AS page, event_id, CASE (user_id * 7 % 4 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END)
      {' '.join(f"WHEN {i + 1} THEN '{e}'" for i, e in enumerate(ENGINES))} END AS engine,
    repeat('ab 1 ', floor(value / 60)::INT) AS text, floor(value / 60) AS n, round_even(value, 0) % 100 / 100 AS confidence FROM events)"""


@check(
    "chosen_page_results", "F1",
    f"""WITH {_RESULTS}, c AS (SELECT *, n * 0.7 + confidence * 0.3 AS score, length(trim(text)) > 10 AS ok,
        CASE engine WHEN 'google' THEN 1 WHEN 'mistral' THEN 2 WHEN 'azure' THEN 3 END AS auth FROM res),
    b AS (SELECT page, arg_max({{'e': engine, 's': score, 't': text, 'c': confidence}}, (-auth, score, confidence, text)) FILTER (ok AND auth IS NOT NULL) AS a,
        arg_max({{'e': engine, 's': score, 't': text, 'c': confidence}}, (score, CASE engine WHEN 'paddle' THEN 1 ELSE 0 END, confidence, text)) FILTER (ok AND engine IN ('paddle', 'tesseract')) AS l,
        max(confidence) FILTER (ok AND engine IN ('paddle', 'tesseract')) AS conf,
        arg_max({{'e': engine, 's': score, 't': text, 'c': confidence}}, (score, confidence, text)) FILTER (n > 0 AND engine = 'trocr') AS t FROM c GROUP BY page)
    SELECT page, coalesce(w.e, 'none') AS engine, coalesce(w.t, '') AS text, coalesce(w.c, 0.0) AS confidence
    FROM (SELECT page, coalesce(a, CASE WHEN l IS NULL OR (conf < 0.4 AND t.s > l.s) THEN coalesce(t, l) ELSE l END) AS w FROM b)""",
)
def _(t: Tables) -> DataFrame:
    return pg.choose_page_result(_results(t), ["page"])


@check(
    "chosen_configs", "F2",
    f"""WITH {_RESULTS} SELECT page, max(n + confidence) AS best FROM res GROUP BY page""",
)
def _(t: Tables) -> DataFrame:
    best = pg.choose_config(_results(t), ["page"], "event_id")
    from gradeframe.functions.text import real_word_count

    return best.select("page", (real_word_count(F.col("text")) + F.col("confidence")).alias("best"))


# an empty page beside each third one, which only its number shows in the result
_PAGES = """pages AS (SELECT conv_id, turn AS page_no, role AS engine, text, turn / 10 AS confidence FROM conversations
    UNION ALL SELECT conv_id, turn + 100, role, '', turn / 10 FROM conversations WHERE turn = 3)"""


@check(
    "documents_from_pages", "D22",
    f"""WITH {_PAGES}, f AS (SELECT conv_id, engine, min(page_no) AS first FROM pages GROUP BY ALL), e AS (SELECT conv_id, string_agg(engine, '+' ORDER BY first) AS engine FROM f GROUP BY 1),
    p AS (SELECT conv_id, string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY page_no) AS text, round_even(avg(confidence), 4) AS confidence FROM pages GROUP BY 1)
    SELECT conv_id, text, confidence, engine FROM p JOIN e USING (conv_id)""",
)
def _(t: Tables) -> DataFrame:
    return pg.join_pages(_page_rows(t), "conv_id")


def _page_rows(t: Tables) -> DataFrame:
    pages = t.conversations.select(
        "conv_id", F.col("turn").alias("page_no"), F.col("role").alias("engine"), "text", (F.col("turn") / 10).alias("confidence"),
    )
    empty = pages.filter("page_no = 3").withColumns({"page_no": F.col("page_no") + 100, "text": F.lit("")})
    return pages.unionByName(empty)


@check(
    "stitched_booklets", "H27",
    f"""WITH {_PAGES} SELECT conv_id, string_agg('[Page ' || (page_no + 1) || ']' || chr(10) || text,
      chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no) AS text FROM pages WHERE page_no > 0 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return pg.stitch_booklet(_page_rows(t), "conv_id")


# --- regions -------------------------------------------------------------------------


def _boxes(t: Tables) -> DataFrame:
    """Order lines as boxes on the page of their order."""
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    return t.lineitem.select(
        F.col("l_orderkey").alias("page_id"), x.alias("x1"), y.alias("y1"),
        (x + F.col("l_quantity") + 1).cast("long").alias("x2"), (y + F.col("l_linenumber") * 6).cast("long").alias("y2"),
        F.when(F.col("l_returnflag") == "A", "Flowchart-1").when(F.col("l_returnflag") == "N", "person").otherwise("a TABLE").alias("label"),
        (F.col("l_tax") * 10).alias("confidence"), s.question_id(t).alias("id"),
    )


_BOXES = f"""boxes AS (SELECT l_orderkey AS page_id, l_partkey % 40 AS x1, l_suppkey % 30 AS y1, (l_partkey % 40 + l_quantity + 1)::BIGINT AS x2,
    (l_suppkey % 30 + l_linenumber * 6)::BIGINT AS y2, CASE l_returnflag WHEN 'A' THEN 'Flowchart-1' WHEN 'N' THEN 'person' ELSE 'a TABLE' END AS label,
    l_tax * 10 AS confidence, {q.QUESTION_ID} AS id FROM lineitem)"""


@check(
    "kept_regions", "H42",
    f"""WITH {_BOXES}, r AS (SELECT *, round_even((x2 - x1) * (y2 - y1) / (100.0 * 100.0)::DOUBLE, 4) AS area_ratio FROM boxes)
    SELECT id, area_ratio, round_even(least(0.5 + area_ratio, 0.85), 3) AS heuristic_confidence FROM r WHERE (label <> 'person' OR confidence >= 0.55) AND area_ratio >= 0.01""",
)
def _(t: Tables) -> DataFrame:
    size = rg.area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = _boxes(t).withColumn("area_ratio", rg.area_ratio(size, F.lit(100), F.lit(100)))
    kept = rows.filter(rg.keeps_region(F.col("label"), F.col("confidence"), F.col("area_ratio")))
    return kept.select("id", "area_ratio", rg.heuristic_confidence(F.col("area_ratio")).alias("heuristic_confidence"))


_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_SHARED = "greatest(0, least(k.x2, b[1].x2) - greatest(k.x1, b[1].x1)) * greatest(0, least(k.y2, b[1].y2) - greatest(k.y1, b[1].y1))"


@check(
    "regions_without_overlaps", "H43",
    f"""WITH {_BOXES}, d AS (SELECT DISTINCT page_id, x1, y1, x2, y2 FROM boxes),
    o AS (SELECT page_id, list([{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2) AS bs FROM d GROUP BY 1),
    f AS (SELECT page_id, unnest(list_reduce(bs, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k:
        {_SHARED} / ({_AREA.format("k")} + {_AREA.format("b[1]")} - {_SHARED} + 1e-6) >= {fv.OVERLAP_THRESHOLD})) > 0 THEN kept ELSE list_concat(kept, b) END)) AS k FROM o)
    SELECT page_id, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM f""",
)
def _(t: Tables) -> DataFrame:
    return ro.suppress_overlaps(_boxes(t), ["page_id"])


@check(
    "region_crops", "H44",
    f"WITH {_BOXES} SELECT id, greatest(0, x1 - 10) AS x1, greatest(0, y1 - 10) AS y1, least(60, x2 + 10) AS x2, least(50, y2 + 10) AS y2 FROM boxes",
)
def _(t: Tables) -> DataFrame:
    box = rg.padded(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(60).cast("long"), F.lit(50).cast("long"))
    return _boxes(t).select("id", box.alias("b")).select("id", "b.*")


@check(
    "primary_regions", "F4",
    f"""WITH {_BOXES}, r AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM boxes)
    SELECT page_id, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a DESC, x1, y1, x2, y2) AS n FROM r) WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    size = rg.area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = _boxes(t).select("page_id", "x1", "y1", "x2", "y2", size.alias("area_ratio"))
    return ro.primary_region(rows, ["page_id"]).drop("area_ratio")


# --- label corpora ----------------------------------------------------------------------


@check(
    "word_index_labels", "A3",
    """SELECT 'w' || p_partkey AS word_id, p_name AS transcript FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS p_name, p_size FROM part)
    WHERE p_size % 3 <> 0 AND p_size % 5 <> 0 AND length(p_name) BETWEEN 2 AND 60""",
)
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    line = F.concat(
        F.when(size % 5 == 0, "# ").otherwise(" "), F.lit("w"), F.col("p_partkey").cast("string"),
        F.when(size % 3 == 0, " er").otherwise(" ok"), F.lit(" 154 1 408 768 27 51 AT "), F.replace("p_name", F.lit(" "), F.lit("_")),
    )
    return lb.word_index_labels(t.part.select(line.alias("value")))


@check(
    "file_name_labels", "A4",
    r"""WITH f AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || '.7' ELSE p_name || '@' END AS l, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size % 4 = 2 THEN left(l, length(l) - 2) ELSE l END AS transcript FROM f WHERE p_size % 4 <> 3 AND p_size % 7 <> 0""",
)
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    label = (
        F.when(size % 4 == 0, F.col("p_name")).when(size % 4 == 1, F.replace("p_name", F.lit(" "), F.lit("-")))
        .when(size % 4 == 2, F.concat("p_name", F.lit(".7"))).otherwise(F.concat("p_name", F.lit("@")))
    )
    path = F.concat(F.lit("/x/y-z/0001-1-0-0-"), label, F.when(size % 7 == 0, ".jpg").when(size % 2 == 0, ".tif").otherwise(".png"))
    return lb.file_name_labels(t.part.select("p_partkey", path.alias("path"))).select("p_partkey", "transcript")


@check(
    "tab_labels", "A5",
    """SELECT p_partkey, p_partkey || '.png' AS file_name, p_name || chr(9) || 'more' AS label FROM part WHERE p_size % 3 <> 0""",
)
def _(t: Tables) -> DataFrame:
    line = F.concat(
        F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".png"), F.when(F.col("p_size") % 3 == 0, " ").otherwise("\t"),
        F.col("p_name"), F.when(F.col("p_size") % 3 == 0, " ").otherwise("\t"), F.lit("more  "),
    )
    return lb.tab_labels(t.part.select("p_partkey", line.alias("value")))


@check(
    "joint_labels", "A6 F6",
    """SELECT 'iam_' || p_partkey || '.png' AS file_name, p_name AS label FROM part UNION ALL SELECT 'cvl_' || s_suppkey || '.png', s_name FROM supplier""",
)
def _(t: Tables) -> DataFrame:
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(".png")).alias("file_name")
    return lb.joint_labels(
        t.part.select(name("iam_", "p_partkey"), F.col("p_name").alias("label")),
        t.supplier.select(name("cvl_", "s_suppkey"), F.col("s_name").alias("label")),
    )


@check(
    "checked_uploads", "A7",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'application/pdf' WHEN '2-HIGH' THEN 'image/jpeg' WHEN '3-MEDIUM' THEN 'image/png' END AS content_type,
      CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'unsupported type' WHEN o_totalprice * 100 > 20971520 THEN 'too large' END AS problem FROM orders""",
)
def _(t: Tables) -> DataFrame:
    level = F.col("o_orderpriority")
    manifest = t.orders.select(
        "o_orderkey",
        F.concat(F.lit("a.b/file"), F.when(level == "1-URGENT", ".PDF").when(level == "2-HIGH", ".jpeg").otherwise(".tiff")).alias("file_name"),
        F.when(level == "3-MEDIUM", "image/png").otherwise("application/octet-stream").alias("content_type"),
        (F.col("o_totalprice") * 100).alias("size_bytes"),
    )
    return lb.check_uploads(manifest).select("o_orderkey", "content_type", "problem")


@check(
    "usable_samples", "B11",
    """SELECT count(*) FILTER (p_size >= 8 AND p_retailprice / 30 >= 32 AND trim(p_name) <> '') AS kept, count(*) FILTER (NOT (p_size >= 8 AND p_retailprice / 30 >= 32)) AS skipped FROM part""",
)
def _(t: Tables) -> DataFrame:
    samples = t.part.select(F.col("p_name").alias("label"), (F.col("p_retailprice") / 30).alias("width"), F.col("p_size").alias("height"))
    return lb.sample_counts(lb.usable_samples(samples))
