"""Table operators on small fixtures with hand-computed results."""

import csv
import json
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeframe import fixed_values as fv
from gradeframe.operators import agreement as ag, error_rates as er, link, maintain as mt, pages as pg
from gradeframe.operators import papers as pp, regions as ro, reports, rubric, segment as sg
from gradeframe.operators.skew import optional_lookup, salted_left_join, split_lookup
from gradeframe.plans.scorer import apply_scorer
from gradeframe.schemas import DEFAULTS, TABLES, schema_of
from gradeframe.sources import labels as lb, tables as tb
from gradeframe.sources.score_sheets import read_score_sheet, scored_sheet
from gradeframe.streaming import incremental as inc

TEACHER = [2, 4, 6, 8]
AI = [2.5, 4, 5, 8.5]


def scores(spark, ai, teacher):
    return spark.createDataFrame([(float(a), float(t)) for a, t in zip(ai, teacher)], "a double, t double")


def test_score_list_metrics(spark):
    got = ag.score_summary(scores(spark, AI, TEACHER), "a", "t").first()
    # deviations (-2.5, -1, 0, 3.5) and (-3, -1, 1, 3); labels (2, 4, 5, 8) and (2, 4, 6, 8)
    assert got.n_samples == 4 and got.mae == 0.5 and round(got.pearson_r, 6) == round(19 / (20 * 19.5) ** 0.5, 6)
    assert (got.accuracy_within_1, got.accuracy_within_0_5, got.cohen_kappa) == (1.0, 0.75, 0.9)
    sheet = scores(spark, AI, TEACHER).toDF("ai_score", "teacher_score")
    assert ag.score_sheet_report(sheet).first().cohen_kappa == 0.2


def test_scores_that_are_no_numbers_stop_nothing(spark):
    pairs = scores(spark, [7, 8, float("nan")], [7, 7, 5])
    assert ag.weighted_kappa(pairs, "a", "t").first()[0] == ag.weighted_kappa(pairs.limit(2), "a", "t").first()[0]
    sheet = pairs.toDF("ai_score", "teacher_score")
    assert ag.score_sheet_report(sheet).first().n == 3


def test_weighted_kappa_drops_labels_out_of_range(spark):
    pairs = scores(spark, [7, 8, 9, 3, 12], [7, 7, 8, 5, 4])
    assert round(ag.weighted_kappa(pairs, "a", "t").first()[0], 9) == 0.5


def test_kappa_without_any_pair_in_range(spark):
    assert ag.weighted_kappa(scores(spark, [50], [60]), "a", "t").first()[0] == 0.0
    grouped = scores(spark, [50, 1, 2], [60, 1, 3]).withColumn("g", F.when(F.col("a") == 50, "x").otherwise("y"))
    got = {r.g: r.cohen_kappa for r in ag.weighted_kappa(grouped, "a", "t", ["g"]).collect()}
    assert got["x"] == 0.0 and got["y"] > 0


def test_constant_scores_do_not_raise(spark):
    got = ag.score_summary(scores(spark, [7, 7, 7], [7, 8, 9]), "a", "t").first()
    assert got.pearson_r == 0.0 and got.mae == 1.0
    assert ag.plain_kappa(scores(spark, [1, 1], [1, 1]), F.col("a"), F.col("t")).first()[0] == 1.0


def test_option_letters(spark):
    rows = spark.createDataFrame([("A", "a"), ("B", "C"), ("C", "C")], "p string, c string")
    got = ag.option_accuracy(rows, "p", "c").first()
    assert (got.mcq_n_correct, got.mcq_n_wrong, round(got.mcq_accuracy, 4)) == (2, 1, 0.6667)


def test_adhoc_lists(spark):
    rows = spark.createDataFrame([(1, "3.25,9,1.5,4", "3,8,2.75,4.5"), (2, "1", "1"), (3, "1,2", "1"), (4, "x,1", "1,2")],
                                 "k int, ai_scores string, teacher_scores string")
    got = {r.k: (r.problem, r.mae) for r in ag.adhoc_report(rows, "k").collect()}
    assert got[1] == (None, 0.75)
    assert got[2][0].startswith("At least 2") and got[3][0].startswith("Length mismatch: 2 vs 1")
    assert got[4][0].startswith("Scores must be")


def test_snapshot_of_nothing_has_null_parts(spark):
    empty = spark.createDataFrame([], schema_of("results"))
    got = ag.snapshot(empty).first()
    assert (got.open_ended, got.mcq, got.total_evaluated) == (None, None, 0)


BOOKLET = (
    "cover noise\n1. alpha one\nmore\n--- PAGE BREAK ---\nQ2: beta text\n25) not a question\n1) again text\n3. ab"
)
KEY = "PART - A\n1. What is DBMS?\nAnswer: A system.\n2, Relation: a set\nOR\nQ3: third answer"
PAPER = (
    "Course Code : ABC123\nMax. Marks : 50\nPart-A (7 x 2 = 14)\nDefine a relation in full\n1\n2. List two keys CO1\n"
    "Part-B 12 Marks Each\n8. Explain joins\nOR\n9. Discuss views"
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_booklet_fixture(spark):
    got = sg.booklet_answers(docs(spark, BOOKLET, "no markers", ""), ["doc_id"]).orderBy("doc_id", "question_number").collect()
    assert [(r.doc_id, r.question_number, r.answer_text, r.part_name) for r in got] == [
        (0, 1, "alpha one\nmore\nagain text", "Part-A"), (0, 2, "beta text\n25) not a question", "Part-A"),
        (1, 0, "no markers", "unknown"),
    ]
    kept = sg.valid_answers(sg.booklet_answers(docs(spark, BOOKLET, "no markers"), ["doc_id"]))
    assert kept.filter("doc_id = 1").count() == 0


def test_key_fixture(spark):
    got = sg.key_answers(docs(spark, KEY), ["doc_id"]).collect()
    assert {r.question_number: r.answer_text for r in got} == {
        1: "A system.", 2: "Relation: a set", 3: "third answer",
    }


def test_paper_fixture(spark):
    questions = pp.paper_questions(docs(spark, PAPER), ["doc_id"])
    got = {r.question_number: (r.question_text, r.marks, r.part_name, r.is_or_option) for r in questions.collect()}
    assert got == {
        1: ("Define a relation in full", 2.0, "Part-A", False), 2: ("List two keys", 2.0, "Part-A", False),
        8: ("Explain joins", 12.0, "Part-B", False), 9: ("Discuss views", 12.0, "Part-B", True),
    }
    heads = pp.paper_headers(docs(spark, PAPER), ["doc_id"])
    total = pp.paper_totals(questions, heads, ["doc_id"]).first()
    assert (total.stored_total, total.reader_total) == (16.0, 50.0)


def test_paper_totals_search_no_other_header_fields(spark):
    papers = docs(spark, PAPER)
    totals = pp.paper_totals(pp.paper_questions(papers, ["doc_id"]), pp.paper_headers(papers, ["doc_id"]), ["doc_id"])
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    patterns = {field: pattern for pattern, field in fv.HEADER_RULES}
    assert patterns["total_marks"] in plan
    assert not [field for field, pattern in patterns.items() if field != "total_marks" and pattern in plan]


def test_model_rows_come_first(spark):
    rows = spark.createDataFrame([(0, 0, 5, "From the model", 3.0, "Part-A", False)],
                                 "doc_id int, line_no int, question_number int, question_text string, marks double, part_name string, is_or_option boolean")
    got = pp.paper_questions(docs(spark, PAPER, PAPER), ["doc_id"], model_rows=rows).collect()
    assert {(r.doc_id, r.strategy) for r in got} == {(0, "model"), (1, "flow")}


def test_marks_in_header(spark):
    lines = spark.createDataFrame([("(7 x 2 = 14)",), ("12 MARKS EACH",), ("none",)], "l string")
    assert [r[0] for r in lines.select(pp.marks_per_question(F.col("l"))).collect()] == [2.0, 12.0, None]


def test_resolution_order_and_hot_paper(spark):
    questions = spark.createDataFrame(
        [(1, 10, 1, False), (2, 10, 1, True), (3, 10, 1, False), (4, 10, 2, True)],
        "id long, paper_id long, question_number int, is_or_option boolean",
    )
    answers = spark.createDataFrame(
        [(1, 10, 3, 1, False), (2, 10, None, 1, False), (3, 10, None, 1, True), (4, 10, None, 2, False), (5, 10, None, 9, False)],
        "a long, paper_id long, exam_question_id long, question_number int, is_or_option boolean",
    )
    got = link.resolve_questions(answers, questions).orderBy("a").select("question.id", "matched_by").collect()
    assert [tuple(r) for r in got] == [
        (3, "stored_id"), (1, "number_and_flag"), (2, "number_and_flag"), (4, "number"), (None, None),
    ]


def test_salted_join_equals_plain_join_on_a_hot_key(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain, salted = facts.join(lookup, "k", "left"), salted_left_join(facts, lookup, ["k"], ["id"])
    assert plain.exceptAll(salted.select(*plain.columns)).count() == 0 and salted.count() == 3000


def test_optional_lookup_equals_plain_join_with_null_keys(spark):
    facts = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 40).alias("k"))
    lookup = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain, spread = facts.join(lookup, "k", "left"), optional_lookup(facts, lookup, "k", ["id"])
    assert plain.exceptAll(spread.select(*plain.columns)).count() == 0 and spread.count() == 2000


def test_upsert_twice_changes_nothing(spark):
    papers = spark.createDataFrame([("a", 1), ("b", 2)], "paper_id string, v int")
    parts = spark.createDataFrame([("a", "x"), ("b", "y")], "paper_id string, p string")
    new, new_parts = papers.filter("paper_id = 'b'").withColumn("v", F.lit(9)), parts.filter("paper_id = 'b'")
    once = mt.upsert_papers(papers, parts, parts, new, new_parts, new_parts)
    twice = mt.upsert_papers(once["papers"], once["parts"], once["questions"], new, new_parts, new_parts)
    for name in ("papers", "parts", "questions"):
        assert sorted(once[name].collect()) == sorted(twice[name].collect())
    assert [tuple(r) for r in once["status"].collect()] == [("b", "updated")]


def test_conform_fills_defaults_for_every_table(spark):
    row = spark.range(1).select(F.lit(1).alias("unrelated"))
    for table in TABLES:
        got = mt.conform(row, schema_of(table), DEFAULTS.get(table, {})).first().asDict()
        assert {k: got[k] for k in DEFAULTS.get(table, {})} == DEFAULTS.get(table, {})


def test_validation_split(spark):
    rows = spark.createDataFrame([(" MCQ", "b ", 1.0, "what?", "because", 1), ("essay", "F", 0.0, "x", "", 0)],
                                 "question_type string, correct_option string, max_marks double, question_text string, teacher_answer string, question_number int")
    good, bad = mt.split_valid(mt.validate_requests(rows))
    assert good.first().question_type == "mcq" and good.first().correct_option == "B"
    assert len(bad.first().problems) == 6


def test_rubric_edges(spark):
    answers = spark.createDataFrame([(1, "open_ended"), (2, "mcq"), (3, "open_ended")], "answer_id int, question_type string")
    rows = spark.createDataFrame([(1, "a", 2.0, 0.5), (1, "b", 2.0, 0.49), (2, "a", 2.0, 0.9)],
                                 "answer_id int, criterion string, marks double, probability double")
    got = {r.answer_id: r for r in rubric.rubric_coverage(answers, rows).collect()}
    assert (got[1].coverage_ratio, got[1].criteria_scores) == (0.5, {"a": 1, "b": 0})
    assert (got[2].earned_rubric_marks, got[2].criteria_scores) == (0.0, None)
    assert got[3].coverage_ratio == 0.0


def test_word_edits(spark):
    rows = spark.createDataFrame([("the cat sat on mat", "the cat sit on the mat"), ("a b c", "b c"), ("", "x y"), ("x", "")], "r string, h string")
    got = er.with_word_edits(rows, "r", "h").collect()
    assert [r.word_edits for r in got] == [2, 1, 2, 1]


def test_word_edits_have_no_bound_on_words(spark):
    """More different words than there are characters to write them with, here as numbers."""
    n = 1_200_000
    reference = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ")
    rows = spark.range(1).select(reference.alias("r")).withColumn("h", F.regexp_replace("r", "^1 2 3 ", "1 3 x "))
    got = er.with_word_edits(rows, "r", "h").select("word_edits", "reference_words").first()
    assert (got.word_edits, got.reference_words) == (2, n)


def test_null_texts_are_samples_without_word_edits(spark):
    rows = spark.createDataFrame([("a b", "a c"), (None, "a b"), ("a", None)], "r string, h string")
    got = er.error_rates(rows, "r", "h").first()
    assert (got.n_samples, got.wer) == (3, 0.5)


@pytest.mark.parametrize("masks", [er.MOST_MASKS, 0])
def test_character_edits_equal_the_built_in_distance(spark, monkeypatch, masks):
    """``masks`` 0: the bits of rare symbols are made when they are met."""
    monkeypatch.setattr(er, "MOST_MASKS", masks)
    rng = random.Random(4)
    texts = ["", "a", "abcdefgh", "abxdefgh", "hgfedcba", "🙂é🙂", "é🙂🙂", None] + [
        "".join(rng.choice("abé🙂") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = er.with_character_edits(rows, "a", "b").select("*", F.levenshtein("a", "b").alias("want")).collect()
    assert all(r.character_edits == r.want for r in got) and len(got) == len(texts) ** 2


def test_word_edits_equal_brute_force(spark):
    random.seed(5)
    pairs = [(" ".join(random.choices("abcdé", k=random.randint(0, 9))), " ".join(random.choices("abcdé", k=random.randint(0, 9)))) for _ in range(80)]

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = er.with_word_edits(spark.createDataFrame(pairs, "r string, h string").coalesce(1), "r", "h").collect()
    assert [r.word_edits for r in got] == [slow(a.split(), b.split()) for a, b in pairs]


def test_page_choice(spark):
    rows = spark.createDataFrame([
        (1, "google", "short text", 0.9), (1, "mistral", "eleven char", 0.1), (1, "paddle", "many words of real text", 0.9),
        (2, "google", "short text", 0.9), (2, "paddle", "aaa bbb ccc", 0.5), (2, "tesseract", "ddd eee fff", 0.5), (2, "trocr", "a b c d e f", 1.0),
        (3, "paddle", "aaa bbb ccc", 0.3), (3, "trocr", "a b c d e f", 0.2), (4, "trocr", " ", 0.9), (5, "trocr", "x", 0.1),
    ], "page int, engine string, text string, confidence double")
    got = {r.page: r.engine for r in pg.choose_page_result(rows, ["page"]).collect()}
    assert got == {1: "mistral", 2: "paddle", 3: "trocr", 4: "none", 5: "trocr"}


def test_suppression_equals_greedy_loop(spark):
    random.seed(11)
    boxes = []
    for page in range(12):
        for _ in range(random.randint(1, 25)):
            x, y = random.randint(0, 30), random.randint(0, 30)
            boxes.append((page, x, y, x + random.randint(2, 25), y + random.randint(2, 25)))

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        size = lambda k: (k[2] - k[0]) * (k[3] - k[1])
        return inter / (size(a) + size(b) - inter + 1e-6)

    expected = set()
    for page in range(12):
        mine = sorted({b[1:] for b in boxes if b[0] == page}, key=lambda k: (-(k[2] - k[0]) * (k[3] - k[1]), k))
        kept = []
        for box in mine:
            if all(iou(k, box) < 0.3 for k in kept):
                kept.append(box)
        expected |= {(page, *k) for k in kept}
    rows = spark.createDataFrame(boxes, "page long, x1 long, y1 long, x2 long, y2 long")
    assert {tuple(r) for r in ro.suppress_overlaps(rows, ["page"]).collect()} == expected


def test_chunk_merge(spark):
    rows = spark.createDataFrame([(1, 0, "abc def"), (1, 1, " def "), (1, 2, "ghi"), (2, 0, "")], "q int, chunk_no int, answer_text string")
    got = {r.q: r.answer_text for r in pg.merge_chunks(rows, ["q"]).collect()}
    assert got == {1: "abc def\nghi", 2: ""}


def test_booklet_totals_of_nothing_evaluated(spark):
    rows = spark.createDataFrame([(1, "no_key", 0.0, 2.0)], "booklet_id int, status string, final_score double, max_marks double")
    got = reports.booklet_totals(rows).first()
    assert (got.percentage, got.grade_band, got.progress) == (0.0, "fail", "0 / 1")


# --- files ---------------------------------------------------------------------


def test_score_sheet_file(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(
        'student_id,question,teacher_score,max_marks,student_answer,teacher_answer,ai_score\n'
        'p7,"Area, exact",3,4,twelve,12,2.75\np9,Unit,1,4,cm,cm2,1.5\np9,"Say ""why""",4,4,x,y,4\n'
    )
    sheet = scored_sheet(read_score_sheet(spark, str(tmp_path / "sheet.csv")))
    got = ag.score_sheet_report(sheet).first()
    assert got.n == 3 and got.mae == 0.25
    (tmp_path / "plain.csv").write_text("student_id,question,teacher_score,max_marks,student_answer,teacher_answer\ns1,Q,8,10,abc,b\ns2,Q,8,10,,b\n")
    plain = read_score_sheet(spark, str(tmp_path / "plain.csv"))
    with pytest.raises(ValueError):
        scored_sheet(plain)
    rows = scored_sheet(plain, lambda b: b["student_answer"].map(len)).orderBy("student_id").collect()
    assert [(r.ai_score, r.failed) for r in rows] == [(3.0, False), (0.0, True)]


def test_large_sheets_are_split_where_cells_hold_no_line_ends(spark, tmp_path):
    lines = [f'p{i},"Q, {i % 7}",{i % 5},4,"said ""{i}""",t,{i % 5 / 2}' for i in range(4000)]
    (tmp_path / "sheet.csv").write_text("student_id,question,teacher_score,max_marks,student_answer,teacher_answer,ai_score\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split, whole = (read_score_sheet(spark, str(tmp_path / "sheet.csv"), line_ends=x) for x in (False, True))
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert sorted(split.collect()) == sorted(whole.collect()) and split.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_label_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# c\n\na01-000u-00-00 ok 154 1 408 768 27 51 AT AB\nx er 1 1 1 1 1 1 AT CD\ny ok 1 1 1 1 1 AB\n")
    words = lb.word_index_labels(lb.read_lines(spark, str(tmp_path / "words.txt")))
    assert [tuple(r) for r in words.collect()] == [("a01-000u-00-00", "AB")]
    names = spark.createDataFrame([("p/0001-1-0-0-hello.tif",), ("0001-1-0-0-well-known.png",), ("0001-1-0-x.tif",), ("0001-1-0-0-x.tif",)], "path string")
    assert sorted(r.transcript for r in lb.file_name_labels(names).collect()) == ["hello", "well-known"]
    joint = lb.joint_labels(words.toDF("file_name", "label"), words.toDF("file_name", "label"))
    lb.write_tab_labels(joint, str(tmp_path / "out"))
    back = lb.tab_labels(lb.read_lines(spark, str(tmp_path / "out")))
    assert sorted(back.collect()) == sorted(joint.collect())
    assert lb.joint_labels(joint, limit=1).count() == 1


def test_upload_manifest(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"y")
    checked = lb.check_uploads(lb.upload_manifest(spark, str(tmp_path))).collect()
    assert sorted((r.content_type or "", r.problem or "") for r in checked) == [("", "unsupported type"), ("application/pdf", "")]


def test_table_and_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, 'q"uote,'), (3, 'two\nlines, "x"'), (4, " b ")], "k int, v string")
    tb.save_table(rows, str(tmp_path / "t.parquet"))
    assert sorted(tb.open_table(spark, str(tmp_path), "t").collect()) == sorted(rows.collect())
    tb.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert sorted(tb.read_csv(spark, str(tmp_path / "csv"), rows.schema).collect()) == sorted(rows.collect())
    with open(next((tmp_path / "csv").glob("part-*.csv")), newline="") as file:
        assert sorted((int(r["k"]), r["v"]) for r in csv.DictReader(file)) == sorted(map(tuple, rows.collect()))


def test_csv_of_another_writer(spark, tmp_path):
    cells = ['plain', 'a "quoted" word', 'first line\nsecond, line', '']
    with open(tmp_path / "sheet.csv", "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(["student_id", "teacher_score", "student_answer"])
        writer.writerows([f"s{i}", "8" if i else "eight", c] for i, c in enumerate(cells))
    schema = StructType.fromDDL("student_id string, teacher_score double, student_answer string")
    got = tb.read_csv(spark, str(tmp_path / "sheet.csv"), schema, "problems").orderBy("student_id").collect()
    assert [r.student_answer or "" for r in got] == cells
    assert [(r.teacher_score, r.problems) for r in got] == [(None, ["teacher_score"])] + [(8.0, [])] * 3


def test_jdbc_reader_refuses_partitions_without_a_column(spark):
    with pytest.raises(ValueError):
        tb.read_jdbc(spark, "jdbc:none", "t", partitions=4)


# --- one row per key within a batch ----------------------------------------------


def test_last_row_of_a_batch_wins(spark):
    batch = spark.createDataFrame([(1, 5.0, 1), (1, 7.0, 2), (2, 3.0, 1)], "submission_id int, final_score double, arrived int")
    stored = spark.createDataFrame([(1, 0.0), (3, 9.0)], "submission_id int, final_score double")
    assert sorted(map(tuple, mt.replace_results(stored, batch, "arrived").collect())) == [(1, 7.0), (2, 3.0), (3, 9.0)]
    table = spark.createDataFrame([(1, 1, 10, "old", "A"), (1, 1, 11, "old", "A")], "paper_id int, question_number int, id int, teacher_answer string, correct_option string")
    patches = spark.createDataFrame([(1, 1, "x", "B", 1), (1, 1, "y", None, 2)], "paper_id int, question_number int, teacher_answer string, correct_option string, arrived int")
    assert sorted(map(tuple, mt.patch_questions(table, patches, "arrived").collect())) == [(1, 1, 10, "y", "B"), (1, 1, 11, "old", "A")]
    keys = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "y", 2)], "paper_id int, question_number int, answer_text string, arrived int")
    linked = mt.link_answer_key(table, keys, "arrived").collect()
    assert len(linked) == 2 and {r.teacher_answer for r in linked} == {"y"}
    papers = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "c", 1)], "paper_id string, name string, arrived int")
    children = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("q", 3, 1)], "paper_id string, id int, arrived int")
    state = mt.upsert_papers(papers.limit(0).drop("arrived"), children.limit(0).drop("arrived"), children.limit(0).drop("arrived"),
                             papers, children, children, "arrived")
    assert sorted(map(tuple, state["papers"].collect())) == [("p", "b"), ("q", "c")]
    assert sorted(map(tuple, state["questions"].collect())) == [("p", 2), ("q", 3)]


def test_page_choice_does_not_depend_on_row_order(spark):
    rows = [(1, "google", "a long enough text", 0.5), (1, "google", "another long text b", 0.5), (1, "paddle", "words and words", 0.9)]
    schema = "page int, engine string, text string, confidence double"
    both = [pg.choose_page_result(spark.createDataFrame(r, schema).coalesce(1), ["page"]).first() for r in (rows, rows[::-1])]
    assert both[0] == both[1] and both[0].engine == "google"


def test_a_scorer_names_its_failing_rows_in_one_call(spark):
    """One row in ten fails: as many calls as batches, and every other row keeps its value."""
    calls = spark.sparkContext.accumulator(0)

    def scorer(batch):
        calls.add(1)
        bad = batch["id"] % 10 == 3
        return batch.assign(value=(batch["id"] * 2.0).where(~bad), problem=["bad row" if b else None for b in bad])[["value", "problem"]]

    rows = spark.range(0, 1000, 1, 1).sort("id")
    got = apply_scorer(rows, scorer, "y").collect()
    assert calls.value == 1
    assert all((r.y, r.problem) == ((0.0, "bad row") if r.id % 10 == 3 else (r.id * 2.0, None)) for r in got)
    short = apply_scorer(spark.range(3).coalesce(1), lambda b: b.assign(value=1.0, problem=None)[["value", "problem"]].iloc[1:], "y").collect()
    assert {r.problem for r in short} == {"0 results for 1 rows"}


def test_failing_rows_are_found_by_halving(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(batch):
        calls.add(1)
        if (batch["id"] == 700).any():
            raise ValueError("bad row")
        return batch["id"] * 1.0

    scored = apply_scorer(spark.range(0, 1000, 1, 1), scorer, "score").collect()
    assert [(r.id, r.score, r.problem) for r in scored if r.problem] == [(700, 0.0, "bad row")]
    assert sum(r.score for r in scored) == sum(range(1000)) - 700 and calls.value < 40


# --- streams of tables ------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_reads_a_table_in_a_folder_or_a_file(spark, tmp_path, parts):
    rows = spark.range(50).selectExpr("id", "id % 5 AS version", "'a' AS text")
    rows.repartition(parts).write.parquet(str(tmp_path / "t.parquet"))
    if parts == 1:
        part = next((tmp_path / "t.parquet").glob("part-*.parquet"))
        part.rename(tmp_path / "file.parquet")
    rows.limit(1).write.parquet(str(tmp_path / "t2.parquet"))  # a table whose name begins alike
    stream = inc.stream_table(spark, str(tmp_path), "file" if parts == 1 else "t", rows.schema, 1)
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    stream.writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_snapshot_parts_add_up(spark):
    schema = ("question_type string, final_score double, max_marks double, similarity_score double, "
              "mcq_detected_answer string, mcq_correct_answer string")
    rows = [("open_ended", float(i % 7), 10.0, (i % 10) / 10, None, None) for i in range(40)]
    rows += [("mcq", 1.0, 1.0, None, "A", "ab"[i % 2]) for i in range(9)]
    first, second = spark.createDataFrame(rows[:25], schema), spark.createDataFrame(rows[25:], schema)
    show = lambda df: df.select("open_ended", "mcq", "total_evaluated").first()
    whole = ag.snapshot(first.unionByName(second))
    merged = ag.snapshot_of(ag.added(ag.snapshot_parts(first), ag.snapshot_parts(second)))
    assert show(whole) == show(merged)
    back = ag.added(ag.snapshot_parts(first.unionByName(second)), ag.negated(ag.snapshot_parts(second)))
    assert json.loads(show(ag.snapshot_of(back)).open_ended) == pytest.approx(json.loads(show(ag.snapshot(first)).open_ended))


def test_salted_lookup_is_not_broadcast_by_its_size_before_copying(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("name "), "id").alias("name")).write.parquet(f"{tmp_path}/l")
    lookup = spark.read.parquet(f"{tmp_path}/l")
    facts = spark.range(9000).select("id", (F.col("id") % 4000).alias("k"))
    size = int(str(lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 * size))
    try:
        joined = salted_left_join(facts, lookup, ["k"], ["id"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.name for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: f"name {i % 4000}" if i % 4000 < 3000 else None for i in range(9000)}


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    facts = spark.range(0, 8000, 1, 8).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    lookup = spark.range(8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    expected = {(i, i if i % 10 == 0 else None, i * 2 if i % 10 == 0 else None) for i in range(8000)}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for joined in (optional_lookup(facts, lookup, "k", ["id"]), split_lookup(facts, lookup, "k")):
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 8000 and max(sizes) <= 1300
            assert {(r.id, r.k, r.v) for r in joined.collect()} == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rubric_scores_are_dealt_once(spark):
    scores = spark.range(3000).select(
        (F.col("id") % 1000).alias("answer_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("criterion"),
        F.lit(2.0).alias("marks"), (F.col("id") % 2 / 1.0).alias("probability"))
    answers = spark.range(1000).select(F.col("id").alias("answer_id"), F.lit("open_ended").alias("question_type"))
    covered = rubric.rubric_coverage(answers.hint("merge"), scores)
    plan = covered._jdf.queryExecution().executedPlan().toString()
    # the scores, and the answers that they are joined with
    assert plan.count("Exchange hashpartitioning") == 2
    assert covered.agg(F.sum("total_rubric_marks"), F.sum("earned_rubric_marks")).first()[:] == (6000.0, 3000.0)


def test_labels_of_a_request_are_made_once(spark):
    rows = spark.createDataFrame([("1,2", "2,2")], "ai_scores string, teacher_scores string").withColumn("k", F.lit(1))
    plan = ag.adhoc_report(rows.repartition(2), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rint(") == 2


def test_booklet_totals_do_not_depend_on_the_order_of_rows(spark):
    # 100 * 12.9 / 24 is 53.75; in some orders the doubles add up to a little less
    columns = "booklet_id int, status string, final_score double, max_marks double"
    rows = [(i, "evaluated", m, 6.0) for i, order in enumerate(permutations([0.74, 1.69, 5.93, 4.54])) for m in order]
    totals = {tuple(r)[1:] for r in reports.booklet_totals(spark.createDataFrame(rows, columns).coalesce(1)).collect()}
    assert totals == {(12.9, 24.0, 53.8, "borderline", "4 / 4")}
    odd = spark.createDataFrame([(1, "evaluated", float("nan"), 6.0), (1, "evaluated", 1.0, 6.0)], columns)
    assert str(reports.booklet_totals(odd).first().total_obtained) == "nan"
