"""Join, lookup and table maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gradeframe import fixed_values as fv
from gradeframe.checks import sqltext as q, standins as s
from gradeframe.checks.registry import Tables, check
from gradeframe.functions import replies as rp
from gradeframe.operators import link, maintain as mt, reports
from gradeframe.operators.skew import salted_left_join
from gradeframe.schemas import DEFAULTS, schema_of

RESOLVED = f"""{q.QUESTIONS}, {q.ANSWERS},
  uniq AS (SELECT *, row_number() OVER (PARTITION BY paper_id, question_number, is_or_option ORDER BY id) AS r1,
      row_number() OVER (PARTITION BY paper_id, question_number ORDER BY id) AS r2 FROM questions),
  resolved AS (SELECT a.*, coalesce(b.id, c.id, d.id) AS qid,
      CASE WHEN b.id IS NOT NULL THEN 'stored_id' WHEN c.id IS NOT NULL THEN 'number_and_flag' WHEN d.id IS NOT NULL THEN 'number' END AS matched_by
    FROM answers a LEFT JOIN questions b ON b.id = a.exam_question_id
      LEFT JOIN uniq c ON c.paper_id = a.paper_id AND c.question_number = a.question_number AND c.is_or_option = a.is_or_option AND c.r1 = 1
      LEFT JOIN uniq d ON d.paper_id = a.paper_id AND d.question_number = a.question_number AND d.r2 = 1)"""


@check(
    "resolved_questions", "C1 E10",
    f"WITH {RESOLVED} SELECT id, qid, matched_by FROM resolved",
)
def _(t: Tables) -> DataFrame:
    return link.resolve_questions(s.answers(t), s.questions(t)).select(
        "id", F.col("question.id").alias("qid"), "matched_by"
    )


@check(
    "answer_dispositions", "B3 B4 B5",
    f"""WITH {RESOLVED} SELECT r.id, CASE WHEN qid IS NULL THEN 'no_question' WHEN trim(answer_text) = '' THEN 'empty_answer'
      WHEN q.teacher_answer = '' THEN 'no_key' WHEN r.score = 6 THEN 'error' ELSE 'evaluated' END AS status,
      CASE WHEN qid IS NOT NULL THEN coalesce(nullif(q.marks, 0), 2.0) END AS max_marks,
      CASE WHEN qid IS NOT NULL THEN coalesce(nullif(q.question_type, ''), 'open_ended') END AS question_type,
      coalesce(q.teacher_answer, '') AS teacher_answer
    FROM resolved r LEFT JOIN questions q ON q.id = r.qid WHERE NOT r.evaluated""",
)
def _(t: Tables) -> DataFrame:
    resolved = link.resolve_questions(link.pending(s.answers(t)), s.questions(t))
    return link.dispositions(resolved, F.col("score") == 6).select(
        "id", "status", "max_marks", "question_type", "teacher_answer"
    )


@check(
    "dispositions_by_type", "B3 B4 B5 D5",
    f"""WITH {RESOLVED}, d AS (SELECT CASE WHEN qid IS NULL THEN 'no_question' WHEN trim(answer_text) = '' THEN 'empty_answer'
        WHEN q.teacher_answer = '' THEN 'no_key' WHEN r.score = 6 THEN 'error' ELSE 'evaluated' END AS status,
      CASE WHEN qid IS NOT NULL THEN coalesce(nullif(q.marks, 0), 2.0) END AS m,
      CASE WHEN qid IS NOT NULL THEN coalesce(nullif(q.question_type, ''), 'open_ended') END AS question_type
      FROM resolved r LEFT JOIN questions q ON q.id = r.qid WHERE NOT r.evaluated)
    SELECT status, question_type, count(*) AS n, sum(m) AS marks FROM d GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    resolved = link.resolve_questions(link.pending(s.answers(t)), s.questions(t))
    return link.dispositions(resolved, F.col("score") == 6).groupBy("status", "question_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("max_marks").alias("marks")
    )


@check(
    "linked_at_ingest", "C2",
    f"""WITH {q.QUESTIONS}, {q.ANSWERS}, k AS (SELECT paper_id, question_number, is_or_option, min(id) AS qid FROM questions GROUP BY ALL)
    SELECT a.id, k.qid AS exam_question_id, k.qid IS NOT NULL AS linked_to_eq FROM answers a LEFT JOIN k USING (paper_id, question_number, is_or_option)""",
)
def _(t: Tables) -> DataFrame:
    return link.link_at_ingest(s.answers(t), s.questions(t)).select("id", "exam_question_id", "linked_to_eq")


@check(
    "primary_questions", "C3",
    f"""WITH {q.QUESTIONS}, {q.ANSWERS}, k AS (SELECT paper_id, question_number, min(id) AS qid FROM questions WHERE NOT is_or_option GROUP BY ALL)
    SELECT a.id AS answer_id, k.qid FROM answers a JOIN k USING (paper_id, question_number)""",
)
def _(t: Tables) -> DataFrame:
    requests = s.answers(t).select(F.col("id").alias("answer_id"), "paper_id", "question_number")
    return link.primary_question(requests, s.questions(t)).select("answer_id", F.col("id").alias("qid"))


def rubrics(t: Tables) -> DataFrame:
    """Up to three criteria per order line: its three smaller amounts."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(name).alias("criterion"), F.rint(F.col(col) * by).alias("marks"))
        for i, (name, col, by) in enumerate([("tax", "l_tax", 100), ("discount", "l_discount", 100), ("size", "l_quantity", 1)])
    ])
    return t.lineitem.select(s.question_id(t).alias("exam_question_id"), F.inline(rows)).filter("marks > 1")


RUBRICS = f"""rubrics AS (SELECT * FROM (
    SELECT {q.QUESTION_ID} AS exam_question_id, 0 AS id, 'tax' AS criterion, round_even(l_tax * 100, 0) AS marks FROM lineitem
    UNION ALL SELECT {q.QUESTION_ID}, 1, 'discount', round_even(l_discount * 100, 0) FROM lineitem
    UNION ALL SELECT {q.QUESTION_ID}, 2, 'size', round_even(l_quantity, 0) FROM lineitem) WHERE marks > 1)"""


@check(
    "questions_with_rubrics", "C4",
    f"""WITH {q.QUESTIONS}, {RUBRICS}, n AS (SELECT exam_question_id, string_agg(criterion || '=' || marks::INT, ';' ORDER BY id) AS rubric FROM rubrics GROUP BY 1)
    SELECT id, rubric FROM questions LEFT JOIN n ON exam_question_id = id""",
)
def _(t: Tables) -> DataFrame:
    nested = link.with_rubrics(s.questions(t), rubrics(t))
    shown = F.transform("rubric", lambda r: F.concat(r["criterion"], F.lit("="), r["marks"].cast("int").cast("string")))
    return nested.select("id", F.when(F.col("rubric").isNotNull(), F.array_join(shown, ";")).alias("rubric"))


@check(
    "requests_with_overrides", "C5",
    f"""WITH {q.QUESTIONS}, {RUBRICS}, n AS (SELECT exam_question_id, count(*) AS n FROM rubrics GROUP BY 1)
    SELECT {q.QUESTION_ID} AS request_id,
      CASE WHEN q.id IS NOT NULL THEN q.marks ELSE 10.0 END AS max_marks,
      CASE WHEN l_tax > 0.04 THEN 'own question' ELSE q.question_text END AS question,
      CASE WHEN l_discount > 0.05 THEN 'own key' ELSE coalesce(q.teacher_answer, '') END AS teacher_answer,
      CASE WHEN l_linestatus = 'O' THEN 1 ELSE n.n END AS criteria
    FROM lineitem LEFT JOIN questions q ON l_returnflag <> 'N' AND q.id = {q.QUESTION_ID} LEFT JOIN n ON n.exam_question_id = q.id""",
)
def _(t: Tables) -> DataFrame:
    own = F.array(F.struct(F.lit("own").alias("criterion"), F.lit(1.0).alias("marks")))
    requests = t.lineitem.select(
        s.question_id(t).alias("request_id"),
        F.when(F.col("l_returnflag") != "N", s.question_id(t)).alias("exam_question_id"),
        F.lit(10.0).alias("max_marks"),
        F.when(F.col("l_tax") > 0.04, "own question").otherwise("").alias("question"),
        F.when(F.col("l_discount") > 0.05, "own key").alias("teacher_answer"),
        F.when(F.col("l_linestatus") == "O", own).alias("rubric"),
    )
    filled = link.apply_question(requests, link.with_rubrics(s.questions(t), rubrics(t)))
    return filled.select(
        "request_id", "max_marks", "question", "teacher_answer",
        F.when(F.col("rubric").isNotNull(), F.size("rubric")).cast("long").alias("criteria"),
    )


@check(
    "paper_lookup", "B1",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN a.o_orderkey WHEN 'N' THEN a.o_orderkey END AS paper_fk
    FROM lineitem LEFT JOIN orders a ON a.o_orderkey = l_orderkey""",
)
def _(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    number = F.col("l_orderkey").cast("string")
    ref = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("P"), number)).when(
        F.col("l_returnflag") == "N", number
    ).otherwise(F.concat(F.lit("x"), number))
    requests = t.lineitem.select(*keys, ref.alias("paper_ref"))
    return link.lookup_papers(requests, s.papers(t)).select(*keys, "paper_fk")


@check(
    "booklets_of_known_paper", "B2",
    "SELECT o_orderkey AS booklet_id FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_name = 'Customer#000000007')",
)
def _(t: Tables) -> DataFrame:
    booklets = t.orders.select(F.col("o_orderkey").alias("booklet_id"), F.col("o_custkey").alias("exam_paper_id"))
    papers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("paper_id"))
    return link.booklets_of_paper(booklets, papers, "Customer#000000007").select("booklet_id")


@check("booklets_of_unknown_paper", "B2", "SELECT o_orderkey AS booklet_id FROM orders")
def _(t: Tables) -> DataFrame:
    booklets = t.orders.select(F.col("o_orderkey").alias("booklet_id"), F.col("o_custkey").alias("exam_paper_id"))
    papers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("paper_id"))
    return link.booklets_of_paper(booklets, papers, "nobody").select("booklet_id")


@check(
    "booklet_papers", "C6",
    """SELECT o_orderkey AS booklet_id, coalesce(b.c_custkey, CASE WHEN o_orderstatus <> 'F' THEN a.c_custkey END) AS resolved_paper_id,
      coalesce(b.c_custkey, CASE WHEN o_orderstatus <> 'F' THEN a.c_custkey END) IS NULL AS rejected
    FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey
      LEFT JOIN customer b ON o_orderpriority IN ('1-URGENT', '2-HIGH') AND b.c_custkey = o_orderkey""",
)
def _(t: Tables) -> DataFrame:
    booklets = t.orders.select(
        F.col("o_orderkey").alias("booklet_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("exam_paper_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.format_string("Customer#%09d", "o_orderkey"))
        .alias("paper_override"),
    )
    papers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("paper_id"))
    return link.paper_of_booklet(booklets, papers).select("booklet_id", "resolved_paper_id", "rejected")


def _submissions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("student_id"),
        F.col("o_custkey").alias("exam_paper_id"), F.col("o_orderkey").alias("exam_question_id"),
    )


def _order_results(t: Tables) -> DataFrame:
    """The first line of each order as the order's stored result."""
    from gradeframe.operators.keyed import first_per_key

    rows = t.lineitem.select(
        F.col("l_orderkey").alias("submission_id"), s.question_id(t).alias("rid"),
        F.lit("mcq").alias("question_type"), F.col("l_quantity").alias("final_score"),
        F.when(F.col("l_returnflag") != "N", F.lit(50.0)).alias("max_marks"),
        (F.col("l_returnflag") == "R").alias("mcq_correct"), F.col("l_linestatus").alias("feedback"),
    )
    return first_per_key(rows, ["submission_id"], F.col("rid"))


_ORDER_RESULTS = f"""res AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {q.QUESTION_ID}) = 1)"""


@check(
    "submissions_with_results", "C7",
    f"""WITH {_ORDER_RESULTS} SELECT o_orderkey AS id, c_name AS student_code, l_orderkey IS NOT NULL AS graded, l_quantity AS final_score, l_returnflag = 'R' AS mcq_correct
    FROM orders LEFT JOIN customer ON o_orderstatus <> 'P' AND c_custkey = o_custkey LEFT JOIN res ON l_orderkey = o_orderkey""",
)
def _(t: Tables) -> DataFrame:
    students = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("student_code"))
    return link.submissions_with_results(_submissions(t), students, _order_results(t)).select(
        "id", "student_code", F.col("result").isNotNull().alias("graded"), "result.final_score", "result.mcq_correct"
    )


@check(
    "result_details", "C8",
    f"""WITH {_ORDER_RESULTS} SELECT l_orderkey AS submission_id, CASE WHEN l_returnflag <> 'N' THEN 50.0 ELSE 10.0 END::DOUBLE AS max_marks, c_mktsegment AS course_name, p_name AS question_text
    FROM res JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = o_orderkey""",
)
def _(t: Tables) -> DataFrame:
    papers = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("paper_id"), F.col("c_mktsegment").alias("course_name")
    )
    questions = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("question_number"), F.col("p_name").alias("question_text")
    )
    return link.result_detail(_order_results(t), _submissions(t), papers, questions).select(
        "submission_id", "max_marks", "course_name", "question_text"
    )


_KEYS_SQL = "(paper_id, question_number, is_or_option) {} (SELECT (paper_id, question_number, is_or_option) FROM questions)"


@check("linked_answers", "C9", f"WITH {q.QUESTIONS}, {q.ANSWERS} SELECT id FROM answers WHERE {_KEYS_SQL.format('IN')}")
def _(t: Tables) -> DataFrame:
    return link.linked(s.answers(t), s.questions(t)).select("id")


@check("unlinked_answers", "C9", f"WITH {q.QUESTIONS}, {q.ANSWERS} SELECT id FROM answers WHERE {_KEYS_SQL.format('NOT IN')}")
def _(t: Tables) -> DataFrame:
    return link.unlinked(s.answers(t), s.questions(t)).select("id")


@check(
    "salted_part_lookup", "C1",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
)
def _(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return salted_left_join(t.lineitem.select(*keys), parts, ["l_partkey"], ["l_orderkey", "l_suppkey"])


# --- maintenance -------------------------------------------------------------------


def _upsert(t: Tables) -> dict[str, DataFrame]:
    """Finished and open orders are stored papers; open and pending ones arrive."""
    cols = ["paper_id", "course_name", "total_marks"]
    papers = s.papers(t)
    stored = papers.filter("state <> 'P'").select(*cols)
    incoming = papers.filter("state <> 'F'").select(
        "paper_id", F.lower("course_name").alias("course_name"), (F.col("total_marks") + 1).alias("total_marks"),
        F.lit(2).alias("arrived"),
    )
    # every slug comes twice; the first version is overtaken within the batch
    incoming = incoming.unionByName(incoming.select("paper_id", F.lit("early").alias("course_name"), "total_marks", F.lit(1).alias("arrived")))
    lines = t.lineitem.join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey"
    ).select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("paper_id"),
        s.question_id(t).alias("id"), "o_orderstatus",
    )
    old = lines.filter("o_orderstatus <> 'P'").select("paper_id", "id")
    new = lines.filter("o_orderstatus <> 'F'").select("paper_id", (-F.col("id")).alias("id"))
    new = new.select("*", F.lit(2).alias("arrived")).unionByName(new.select("paper_id", F.lit(0).cast("long").alias("id"), F.lit(1).alias("arrived")))
    return mt.upsert_papers(stored, old, old, incoming, new, new, "arrived")


@check(
    "upserted_papers", "A11",
    """SELECT 'P' || o_orderkey AS paper_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE lower(o_orderpriority) END AS course_name,
      CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 1 END AS total_marks,
      CASE o_orderstatus WHEN 'O' THEN 'updated' WHEN 'P' THEN 'created' END AS status FROM orders""",
)
def _(t: Tables) -> DataFrame:
    state = _upsert(t)
    return state["papers"].join(state["status"], "paper_id", "left")


@check(
    "upserted_questions", "A11",
    f"""SELECT 'P' || l_orderkey AS paper_id, CASE WHEN o_orderstatus = 'F' THEN {q.QUESTION_ID} ELSE -{q.QUESTION_ID} END AS id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(t: Tables) -> DataFrame:
    return _upsert(t)["questions"]


def _keys(t: Tables) -> DataFrame:
    """A key text for some question numbers of every paper."""
    return t.lineitem.filter("l_returnflag = 'N'").groupBy(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("question_number")
    ).agg(F.concat(F.lit("new "), F.min("l_partkey").cast("string")).alias("answer_text"))


_KEYS = """keys AS (SELECT l_orderkey AS paper_id, l_linenumber AS question_number, 'new ' || min(l_partkey) AS answer_text
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)"""


@check(
    "linked_answer_keys", "A12",
    f"""WITH {q.QUESTIONS}, {_KEYS} SELECT id, coalesce(answer_text, teacher_answer) AS teacher_answer, answer_text IS NOT NULL AS key_linked
    FROM questions LEFT JOIN keys USING (paper_id, question_number)""",
)
def _(t: Tables) -> DataFrame:
    keys = _keys(t).withColumn("arrived", F.lit(2))
    twice = keys.unionByName(keys.withColumns({"answer_text": F.lit("early"), "arrived": F.lit(1)}))
    return mt.link_answer_key(s.questions(t), twice, "arrived").select("id", "teacher_answer", "key_linked")


@check(
    "answer_key_counts", "A12",
    f"""WITH {q.QUESTIONS}, {_KEYS} SELECT paper_id, count(DISTINCT question_number) AS total_answers_extracted, count(*) AS answers_linked
    FROM keys JOIN questions USING (paper_id, question_number) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    keys = _keys(t)
    return mt.key_link_counts(mt.link_answer_key(s.questions(t), keys), keys)


@check(
    "patched_questions", "A13 E10",
    f"""WITH {q.QUESTIONS}, p AS (SELECT paper_id, question_number, min(id) AS id FROM questions GROUP BY ALL)
    SELECT q.id, CASE WHEN p.id IS NOT NULL THEN 'patched' ELSE q.teacher_answer END AS teacher_answer,
      CASE WHEN p.id IS NULL THEN q.correct_option WHEN p.question_number % 2 = 0 THEN 'E' WHEN p.question_number % 3 = 0 THEN 'D' ELSE q.correct_option END AS correct_option
    FROM questions q LEFT JOIN p ON p.id = q.id""",
)
def _(t: Tables) -> DataFrame:
    questions = s.questions(t)
    patches = questions.select("paper_id", "question_number").distinct().select(
        "paper_id", "question_number", F.lit("patched").alias("teacher_answer"),
        F.when(F.col("question_number") % 2 == 0, "E").alias("correct_option"),
    )
    early = patches.select(
        "paper_id", "question_number", F.lit("early").alias("teacher_answer"),
        F.when(F.col("question_number") % 3 == 0, "D").alias("correct_option"), F.lit(1).alias("arrived"),
    )
    twice = patches.withColumn("arrived", F.lit(2)).unionByName(early)
    return mt.patch_questions(questions, twice, "arrived").select("id", "teacher_answer", "correct_option")


@check(
    "patched_answers", "A14",
    f"""WITH {q.ANSWERS}, p AS (SELECT booklet_id, question_number, min(id) AS id FROM answers WHERE question_number > 3 GROUP BY ALL)
    SELECT a.id, CASE WHEN p.id IS NOT NULL THEN 'corrected' ELSE a.answer_text END AS answer_text, p.id IS NULL AND a.evaluated AS evaluated
    FROM answers a LEFT JOIN p ON p.id = a.id""",
)
def _(t: Tables) -> DataFrame:
    answers = s.answers(t)
    patches = answers.filter("question_number > 3").select("booklet_id", "question_number").distinct().withColumn(
        "answer_text", F.lit("corrected")
    )
    twice = patches.withColumn("arrived", F.lit(2)).unionByName(patches.withColumns({"answer_text": F.lit("early"), "arrived": F.lit(1)}))
    return mt.patch_answers(answers, twice, "arrived").select("id", "answer_text", "evaluated")


@check(
    "replaced_rubrics", "A15",
    """WITH stored AS (SELECT p_partkey AS exam_question_id, NULL::BIGINT AS question_id, p_name AS criterion, p_size::DOUBLE AS marks FROM part
      UNION ALL SELECT NULL, s_suppkey, s_name, s_acctbal FROM supplier), up AS (SELECT DISTINCT l_partkey + 1000 AS id FROM lineitem),
    r AS (SELECT up.id, p_partkey AS e, CASE WHEN p_partkey IS NULL THEN c_custkey END AS q FROM up LEFT JOIN part ON p_partkey = up.id LEFT JOIN customer ON c_custkey = up.id)
    SELECT exam_question_id, question_id, criterion, marks FROM stored WHERE coalesce(exam_question_id, -1) NOT IN (SELECT e FROM r WHERE e IS NOT NULL)
      AND coalesce(question_id, -1) NOT IN (SELECT q FROM r WHERE q IS NOT NULL)
    UNION ALL SELECT e, q, 'new', 1.0 FROM r WHERE e IS NOT NULL OR q IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    none = F.lit(None).cast("long")
    stored = t.part.select(
        F.col("p_partkey").alias("exam_question_id"), none.alias("question_id"), F.col("p_name").alias("criterion"),
        F.col("p_size").cast("double").alias("marks"),
    ).unionByName(t.supplier.select(
        none.alias("exam_question_id"), F.col("s_suppkey").alias("question_id"), F.col("s_name").alias("criterion"),
        F.col("s_acctbal").alias("marks"),
    ))
    uploads = t.lineitem.select((F.col("l_partkey") + 1000).alias("upload_id")).distinct().select(
        "upload_id", F.lit("new").alias("criterion"), F.lit(1.0).alias("marks")
    )
    current = t.part.select(F.col("p_partkey").alias("id"))
    legacy = t.customer.select(F.col("c_custkey").alias("id"))
    return mt.replace_rubrics(stored, uploads, current, legacy)[0]


@check(
    "replaced_results", "A16",
    """SELECT o_orderkey AS submission_id, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS final_score FROM orders""",
)
def _(t: Tables) -> DataFrame:
    stored = t.orders.select(F.col("o_orderkey").alias("submission_id"), F.col("o_totalprice").alias("final_score"))
    batch = t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("submission_id"), (-F.col("o_totalprice")).alias("final_score")
    )
    twice = batch.withColumn("arrived", F.lit(2)).unionByName(batch.withColumns({"final_score": F.lit(0.0), "arrived": F.lit(1)}))
    return mt.replace_results(stored, twice, "arrived")


@check(
    "newest_results", "A16",
    """SELECT user_id AS submission_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    history = t.events.select(F.col("user_id").alias("submission_id"), "event_id", "value")
    return mt.newest_results(history, "event_id").select("submission_id", "event_id", "value")


def _doomed(t: Tables) -> DataFrame:
    return s.papers(t).filter("state = 'F'").select("paper_id")


@check(
    "papers_after_delete", "A17",
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS papers,
      (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F') AS questions""",
)
def _(t: Tables) -> DataFrame:
    children = t.lineitem.select(F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("paper_id"))
    left = mt.delete_papers(s.papers(t), children, children, _doomed(t))
    count = F.count(F.lit(1))
    return left["papers"].agg(count.alias("papers")).select(
        "papers", left["questions"].agg(count).scalar().alias("questions")
    )


@check(
    "booklet_answers_after_delete", "A17",
    f"WITH {q.ANSWERS} SELECT id FROM answers WHERE booklet_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(t: Tables) -> DataFrame:
    booklets = t.orders.select(F.col("o_orderkey").alias("booklet_id"), "o_orderpriority")
    doomed = booklets.filter("o_orderpriority = '1-URGENT'")
    return mt.delete_booklets(booklets, s.answers(t), doomed)["answers"].select("id")


@check(
    "students_after_covers", "A18",
    """WITH known AS (SELECT c_name AS student_code, c_mktsegment AS name FROM customer),
    codes AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'O' THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN o_orderstatus = 'P' THEN 'R' || o_custkey END AS c
      FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT * FROM known UNION ALL SELECT c, 'Student ' || c FROM codes WHERE c IS NOT NULL AND c NOT IN (SELECT student_code FROM known)""",
)
def _(t: Tables) -> DataFrame:
    students = t.customer.select(F.col("c_name").alias("student_code"), F.col("c_mktsegment").alias("name"))
    covers = t.orders.select(
        F.when(F.col("o_orderpriority") == "5-LOW", "X9").alias("student_code"),
        F.when(F.col("o_orderstatus") == "O", F.format_string("Customer#%09d", "o_custkey")).otherwise("").alias("register_number"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("R"), F.col("o_custkey").cast("string"))).alias("roll_number"),
    )
    return mt.get_or_create_students(students, covers)


@check(
    "conformed_results", "A19",
    """SELECT event_id AS submission_id, 'open_ended' AS question_type, value AS final_score, 10.0::DOUBLE AS max_marks, 0.0::DOUBLE AS llm_score,
      NULL::VARCHAR AS mcq_detected_answer FROM events""",
)
def _(t: Tables) -> DataFrame:
    old = t.events.select(F.col("event_id").alias("submission_id"), F.col("value").alias("final_score"))
    once = mt.conform(old, schema_of("results"), DEFAULTS["results"])
    twice = mt.conform(once, schema_of("results"), DEFAULTS["results"])
    return twice.select(
        "submission_id", "question_type", "final_score", "max_marks", "llm_score", "mcq_detected_answer"
    )


@check(
    "validated_requests", "A20",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE l_partkey % 4 WHEN 0 THEN ' MCQ ' WHEN 1 THEN 'essay' WHEN 2 THEN 'auto' ELSE 'diagram' END AS k,
      CASE l_suppkey % 4 WHEN 0 THEN ' b' WHEN 1 THEN 'F' WHEN 2 THEN NULL ELSE 'E' END AS o, l_quantity - 5 AS m, l_linenumber - 1 AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(trim(k)) AS question_type, upper(trim(o)) AS correct_option,
      array_to_string(list_filter([CASE WHEN k = 'essay' THEN 'question_type' END, CASE WHEN o = 'F' THEN 'correct_option' END,
        CASE WHEN m <= 0 THEN 'max_marks' END, CASE WHEN m > 40 THEN 'question_text' END, CASE WHEN n < 1 THEN 'question_number' END], lambda x: x IS NOT NULL), ',') AS problems FROM r""",
)
def _(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    part, supp = F.col("l_partkey") % 4, F.col("l_suppkey") % 4
    requests = t.lineitem.select(
        *keys,
        F.when(part == 0, " MCQ ").when(part == 1, "essay").when(part == 2, "auto").otherwise("diagram").alias("question_type"),
        F.when(supp == 0, " b").when(supp == 1, "F").when(supp == 2, None).otherwise("E").alias("correct_option"),
        (F.col("l_quantity") - 5).alias("max_marks"), (F.col("l_linenumber") - 1).alias("question_number"),
        F.when(F.col("l_quantity") > 45, "why").otherwise("why so?").alias("question_text"), F.lit("because").alias("teacher_answer"),
    )
    return mt.validate_requests(requests).select(
        *keys, "question_type", "correct_option", F.array_join("problems", ",").alias("problems")
    )


@check(
    "first_row_per_question", "E8 E10",
    f"SELECT l_orderkey, l_linenumber, min({q.QUESTION_ID}) AS id FROM lineitem GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", s.question_id(t).alias("id"))
    return mt.first_of_key(rows, ["l_orderkey", "l_linenumber"], F.col("id"))


@check(
    "json_lists", "A9",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '[]' ELSE '["' || event_type || '","x"]' END AS stored,
      CASE WHEN event_type = 'error' THEN 0 ELSE 2 END::BIGINT AS n FROM events""",
)
def _(t: Tables) -> DataFrame:
    listed = F.when(F.col("event_type") != "error", F.array(F.col("event_type"), F.lit("x")))
    stored = t.events.select("event_id", rp.json_list(listed).alias("stored"))
    return stored.select("event_id", "stored", F.size(rp.read_json_list(F.col("stored"))).cast("long").alias("n"))


# --- reports -----------------------------------------------------------------------


@check(
    "papers_listing", "D1 F5",
    f"""WITH {q.PAPERS}, {q.QUESTIONS}, n AS (SELECT paper_id AS id, count(*) AS n FROM questions GROUP BY 1)
    SELECT p.id, p.paper_id, course_name, coalesce(n, 0) AS num_questions FROM papers p LEFT JOIN n USING (id) ORDER BY parsed_at DESC, p.id""",
)
def _(t: Tables) -> DataFrame:
    return reports.papers_listing(s.papers(t), s.questions(t)).select("id", "paper_id", "course_name", "num_questions")


@check(
    "booklets_listing", "D2 F5",
    f"""WITH {q.ANSWERS}, n AS (SELECT booklet_id, count(*) AS n FROM answers GROUP BY 1)
    SELECT o_orderkey AS booklet_id, coalesce(n, 0) AS num_answers FROM orders LEFT JOIN n ON booklet_id = o_orderkey ORDER BY o_orderdate DESC, 1""",
)
def _(t: Tables) -> DataFrame:
    booklets = t.orders.select(F.col("o_orderkey").alias("booklet_id"), F.col("o_orderdate").alias("parsed_at"))
    return reports.booklets_listing(booklets, s.answers(t)).select("booklet_id", "num_answers")


@check(
    "key_readiness", "D8",
    f"WITH {q.QUESTIONS} SELECT paper_id, count(*) FILTER (teacher_answer <> '') AS answered, count(*) AS total FROM questions GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return reports.key_readiness(s.questions(t))


@check(
    "paper_insight", "D7 D9",
    f"""WITH {q.PAPERS}, {q.QUESTIONS}, n AS (SELECT paper_id AS id, sum(CASE WHEN is_or_option THEN 0 ELSE coalesce(marks, 0) END) AS s, count(*) AS n,
        count(*) FILTER (teacher_answer <> '') AS ready FROM questions GROUP BY 1)
    SELECT p.id, coalesce(nullif(s, 0), total_marks) AS correct_total, coalesce(n, 0) AS num_questions, coalesce(ready, 0) AS answers_ready
    FROM papers p LEFT JOIN n USING (id)""",
)
def _(t: Tables) -> DataFrame:
    return reports.paper_insight(s.papers(t), s.questions(t)).select(
        "id", "correct_total", "num_questions", "answers_ready"
    )


@check(
    "nested_papers", "D10",
    f"""WITH {q.PAPERS}, {q.QUESTIONS}, u AS (SELECT *, row_number() OVER (PARTITION BY paper_id, question_number, is_or_option ORDER BY id) AS r FROM questions),
    n AS (SELECT paper_id AS id, count(*) AS n, string_agg(question_number || CASE WHEN is_or_option THEN 'or' ELSE '' END, ',' ORDER BY question_number, id) AS shown FROM u WHERE r = 1 GROUP BY 1)
    SELECT p.id, n AS n_questions, shown FROM papers p LEFT JOIN n USING (id)""",
)
def _(t: Tables) -> DataFrame:
    questions = s.questions(t).select(
        F.col("paper_id").alias("pid"), "question_number", "id", "is_or_option", "question_text", "marks"
    )
    papers = s.papers(t).select(F.col("id").alias("pid"), "paper_id")
    nested = reports.nested_document(
        papers, questions, "pid", ["question_number", "id"], ["question_number", "is_or_option"], "questions"
    )
    shown = F.transform(
        "questions",
        lambda x: F.concat(x["question_number"].cast("string"), F.when(x["is_or_option"], "or").otherwise("")),
    )
    return nested.select(
        F.col("pid").alias("id"), F.when(F.col("questions").isNotNull(), F.size("questions")).cast("long").alias("n_questions"),
        F.array_join(shown, ",").alias("shown"),
    )


@check(
    "mark_sheet", "D27",
    f"WITH {q.ANSWERS} SELECT booklet_id, " + ", ".join(
        f"round_even(sum(score) FILTER (question_number = {i}), 2) AS q{i}" for i in range(1, 9)
    ) + ", round_even(sum(score), 2) AS total FROM answers GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return reports.mark_sheet(s.answers(t), "booklet_id", "question_number", "score", range(1, 9))


@check(
    "result_export", "A8",
    f"""WITH {q.ANSWERS} SELECT question_number, 'Part-A' AS part_name, 'open_ended' AS question_type, score AS final_score, 7.0::DOUBLE AS max_marks, answer_text AS feedback
    FROM answers WHERE evaluated""",
)
def _(t: Tables) -> DataFrame:
    graded = s.answers(t).select(
        "question_number", F.lit("Part-A").alias("part_name"), F.lit("open_ended").alias("question_type"),
        F.col("score").alias("final_score"), F.lit(7.0).alias("max_marks"), F.col("answer_text").alias("feedback"),
        F.when(F.col("evaluated"), "evaluated").otherwise("skipped").alias("status"),
    )
    return reports.export_rows(graded)
