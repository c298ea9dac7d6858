"""Scalar rules with hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import classify, extract, prompts, replies, rounding, scoring, text as tx, vectors
from gradeframe.operators import spelling
from gradeframe.plans.grading import grade, objective_grades
from gradeframe.plans.scorer import apply_scorer


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_option_letter(spark):
    given = ["Ans: c", "(B)", "d) because", "I chose a bus", "Answer because", "42", "été"]
    assert column(spark, given, extract.option_letter) == ["C", "B", "D", "A", "B", None, None]


def test_truth_value(spark):
    given = ["True", "it is not correct", "no, that is incorrect", "yes and no", "T", "maybe", "nô"]
    assert column(spark, given, extract.truth_value) == ["TRUE", "TRUE", "FALSE", None, "TRUE", None, None]


def test_last_number(spark):
    given = ["R = 1,250.5 ohm", "a 3 then -4", "2-5", "none"]
    assert column(spark, given, extract.last_number) == [1250.5, -4.0, -5.0, None]


def test_numeric_tolerance(spark):
    rows = spark.createDataFrame(
        [("101", "100"), ("101.1", "100"), ("0.0009", "0"), ("0.001", "0"), ("none", "5")], "a string, k string"
    ).withColumns({"kind": F.lit("numerical"), "m": F.lit(4.0)})
    graded = objective_grades(rows, "kind", "a", "k", "m").collect()
    assert [r.objective_score for r in graded] == [4.0, 0.0, 4.0, 0.0, None]
    assert [r.handled for r in graded] == [True, True, True, True, False]


def test_exact_rounding_matches_python(spark):
    random.seed(7)
    values = [2.675, 1.005, 0.575, 0.545, 2.5, 0.125, 12.125, 1.015, -2.675, 0.0]
    values += [k * 0.005 * 3 for k in range(400)] + [random.uniform(0, 20) for _ in range(400)]
    got = column(spark, values, lambda x: rounding.exact_round(x, 2), "double")
    assert got == [round(v, 2) for v in values]


def test_percent_and_band(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (6.0, 10.0), (4.0, 10.0)], "a double, b double")
    share = rounding.percent(F.col("a"), F.col("b"))
    got = rows.select(share.alias("p"), scoring.grade_band(share).alias("g")).collect()
    assert [tuple(r) for r in got] == [(0.0, "fail"), (33.3, "fail"), (60.0, "pass"), (40.0, "borderline")]


def test_normalize(spark):
    given = ["a.\n\nb\nc", "This  has   multiple    spaces", "café.Bon", "x!\ny"]
    assert column(spark, given, tx.normalize) == [
        "a. . b. c", "This has multiple spaces", "caf . Bon", "x! y",
    ]


def test_sentences(spark):
    got = column(spark, ["First sentence. Second sentence! Third sentence?"], tx.sentences)[0]
    assert got == ["First sentence.", "Second sentence!", "Third sentence?"]


def test_keywords_respect_accents(spark):
    assert column(spark, ["The être data DATA ab abc_d naïve sets"], tx.keywords)[0] == ["data", "sets"]


def test_length_norm(spark):
    rows = spark.createDataFrame([(3, 10), (6, 10), (5, 0)], "s int, t int")
    assert [r[0] for r in rows.select(tx.length_norm(F.col("s"), F.col("t"))).collect()] == [0.5, 1.0, 1.0]


def test_strip_knows_unicode_blanks(spark):
    assert column(spark, [" \t a b  \n"], tx.strip) == ["a b"]


def test_dictionary_fix_is_case_sensitive(spark):
    given = ["the databse, Alogrithm g0 0ne"]
    assert column(spark, given, tx.fix_confusions) == ["the database, Alogrithm go one"]


@pytest.mark.parametrize("size,overlap", [(5, 0), (8, 3), (1000, 10)])
def test_chunks_cover_the_text(spark, size, overlap):
    whole = "abcdefghijklmnopqrstuvwxyz"
    got = column(spark, [whole], lambda x: tx.chunks(x, size, overlap))[0]
    rebuilt = got[0] + "".join(c[overlap:] for c in got[1:])
    assert rebuilt == whole and all(len(c) <= size for c in got)


def test_hybrid_score(spark):
    row = spark.createDataFrame([(7.5, 0.8, 0.75, 0.5, 1.0, 10.0)], "l double, s double, r double, k double, n double, m double")
    score = scoring.hybrid_score(*[F.col(c) for c in "lsrkn"], F.col("m"))
    zero = scoring.hybrid_score(*[F.lit(0.0)] * 5, F.lit(10.0))
    got = row.select(F.bround(score, 2), zero).first()
    assert tuple(got) == (7.5, 0.0)


def test_weight_warning():
    assert scoring.weight_warning({"a": 0.6, "b": 0.4}) is None
    assert "inflated" in scoring.weight_warning({"a": 0.9, "b": 0.4})
    assert "deflated" in scoring.weight_warning({"a": 0.1, "b": 0.4})


def test_grade_isolates_bad_rows(spark):
    rows = spark.createDataFrame(
        [("words here", "words here", "open_ended", 10.0, 5.0, None), ("x", "y", "open_ended", None, 5.0, None),
         ("x", "y", "short_answer", 10.0, None, "timeout")],
        "answer_text string, teacher_answer string, question_type string, max_marks double, llm_score double, llm_problem string",
    )
    got = grade(rows).select("status", "final_score", "feedback").collect()
    assert [r.status for r in got] == ["evaluated", "error", "error"]
    assert [r.final_score for r in got] == [3.5, 0.0, 0.0]
    assert got[1].feedback == "no marks given" and got[2].feedback == "timeout"


def test_classifier_goldens(spark):
    given = ["Which of the following is right? A) x", "State whether true or false: yes",
             "Calculate the value of the resistance.", "Explain the topic in detail.", "  "]
    got = column(spark, given, lambda x: classify.classify(x)["question_type"])
    assert got == ["mcq", "true_false", "numerical", "open_ended", "open_ended"]


def test_replies_never_fail(spark):
    given = ['{"score": 7.5, "confidence": 0.85}', '```json\n{"score": 8}\n```', "not valid json {{{{", "", None,
             '{"score": 99}', '{"score": "x"}']
    got = column(spark, given, lambda x: replies.graded_reply(x, F.lit(10.0)))
    assert [r.score for r in got] == [7.5, 8.0, 0.0, 0.0, 0.0, 10.0, 0.0]
    assert [r.confidence for r in got] == [0.85, 0.7, 0.3, 0.3, 0.3, 0.7, 0.0]
    simple = column(spark, given, lambda x: replies.simple_reply(x, F.lit(10.0)))
    assert [r.confidence for r in simple] == [0.85, 0.7, 0.7, 0.7, 0.7, 0.7, 0.0]


def test_answer_list_keeps_stray_backslash(spark):
    raw = '{"answers": [{"question_number": "2", "answer_text": "a\\y\nb"}]}'
    got = column(spark, [raw], replies.answer_list)[0]
    assert [(a.question_number, a.answer_text) for a in got] == [(2, "a\\y\nb")]


def test_answer_map_forms(spark):
    given = ['{"1": " a ", "x": "b"}', '{"answers": [{"question_number": 3, "answer_text": "c"}]}', "nothing"]
    assert column(spark, given, replies.answer_map) == [{1: "a"}, {3: "c"}, None]


def test_prompt_keeps_braces_of_values(spark):
    got = column(spark, ["set {question}"], lambda x: prompts.fill(F.lit("A {student} {question}"), {"student": x, "question": F.lit("Q")}))
    assert got == ["A set {question} Q"]


def test_best_match_ties_and_empty_side(spark):
    vec = "array<struct<sentence:string,vector:array<double>>>"
    rows = spark.createDataFrame(
        [([("s", [1.0, 0.0])], [("t1", [0.0, 1.0]), ("t2", [1.0, 0.0]), ("t3", [1.0, 0.0])]), ([("s", [1.0, 0.0])], [])],
        f"s {vec}, t {vec}",
    )
    got = rows.select(vectors.best_matches(F.col("s"), F.col("t")).alias("m")).select(
        "m", vectors.overall_match(F.col("m")).alias("o")).collect()
    assert got[0].m[0].best_match_teacher == "t2" and got[0].o == 1.0
    assert got[1].m == [] and got[1].o == 0.0


def test_scorer_marks_only_failing_rows(spark):
    def scorer(rows):
        if (rows["x"] == 2).any():
            raise ValueError("bad two")
        return rows["x"] * 2.0

    got = apply_scorer(spark.range(4).withColumnRenamed("id", "x").coalesce(1), scorer, "y").collect()
    assert [(r.x, r.y, r.problem) for r in got] == [(0, 0.0, None), (1, 2.0, None), (2, 0.0, "bad two"), (3, 6.0, None)]


def one_edit(word, letters="abcd"):
    """All strings one deletion, swap, replacement or insertion away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return (
        {a + b[1:] for a, b in cuts if b}
        | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        | {a + c + b[1:] for a, b in cuts if b for c in letters}
        | {a + c + b for a, b in cuts for c in letters}
    )


def test_corrections_equal_brute_force(spark):
    random.seed(3)
    vocab = {"".join(random.choice("abcd") for _ in range(random.randint(3, 6))): random.randint(1, 9) for _ in range(60)}
    tokens = sorted({"".join(random.choice("abcd") for _ in range(random.randint(3, 7))) for _ in range(150)})
    expected = {}
    for word in tokens:
        if word in vocab:
            continue
        once = one_edit(word)
        near = once & vocab.keys() or {e for o in once for e in one_edit(o)} & vocab.keys()
        if near:
            expected[word] = min(near, key=lambda v: (-vocab[v], v))
    counts = spark.createDataFrame([(w, 1) for w in tokens], "word string, n long")
    words = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert {r.word: r.correction for r in spelling.corrections(counts, words).collect()} == expected


def test_two_close_swaps_are_two_edits(spark):
    """Swapped pairs side by side can be three plain edits apart."""
    counts = spark.createDataFrame([("gylghxxb", 1), ("fnzrhcguq", 1)], "word string, n long")
    vocab = spark.createDataFrame([("ygglhxxb", 3), ("fnzhrgcuq", 2)], "word string, n long")
    got = {r.word: r.correction for r in spelling.corrections(counts, vocab).collect()}
    assert got == {"gylghxxb": "ygglhxxb", "fnzrhcguq": "fnzhrgcuq"}


def test_correct_texts_keeps_case_and_marks(spark):
    texts = spark.createDataFrame([(1, "The Algoritm, works NASA x1y  fine."), (2, "")], "k int, text string")
    fixes = spark.createDataFrame([("algoritm", "algorithm")], "word string, correction string")
    got = {r.k: r.text for r in spelling.correct_texts(texts, ["k"], "text", fixes).collect()}
    assert got == {1: "The Algorithm, works NASA x1y fine.", 2: ""}


def test_texts_with_two_close_swaps_are_corrected(spark):
    texts = spark.createDataFrame([(1, "A Piepilne, done."), (2, "A pipeline.")], "k int, text string")
    counts = spelling.word_counts(texts, "text")
    fixes = spelling.corrections(counts, counts.filter("word = 'pipeline'"))
    got = {r.k: r.text for r in spelling.correct_texts(texts, ["k"], "text", fixes).collect()}
    assert got == {1: "A Pipeline, done.", 2: "A pipeline."}


def test_long_words_meet_on_pieces(spark):
    """Two edits anywhere in a long word, swaps included, leave one of its pieces whole."""
    rng = random.Random(11)
    pairs = []
    for i in range(60):
        word = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(14, 40) if i else 5000))
        other = list(word)
        for _ in range(2):
            at = rng.randrange(len(other) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                del other[at]
            elif kind == 1:
                other.insert(at, "z")
            elif kind == 2:
                other[at] = "y"
            else:
                other[at], other[at + 1] = other[at + 1], other[at]
        pairs.append((word, "".join(other)))
    unknown = spark.createDataFrame([(o,) for _, o in pairs], "word string").distinct()
    vocab = spark.createDataFrame([(w, 1) for w, _ in pairs], "word string, n long")
    found = {(r.correction, r.word) for r in spelling.candidate_pairs(unknown, vocab).collect()}
    assert set(pairs) <= found


def test_beginnings_of_words_within_two_edits_share_a_key(spark, monkeypatch):
    """Two edits of any kind at and around the end of the beginning, by brute force."""
    monkeypatch.setattr(spelling, "PREFIX", 3)
    words = ["abcd", "bacdbc", "abc", "dcbaabcd", "aabb"]
    pairs = {(w, x) for w in words for o in one_edit(w) for x in one_edit(o) if x}
    unknown = spark.createDataFrame(sorted({(x,) for _, x in pairs}), "word string")
    vocab = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert pairs <= {(r.correction, r.word) for r in spelling.candidate_pairs(unknown, vocab).collect()}


def test_a_word_in_every_text_heats_no_task(spark):
    texts = spark.range(4000).select(F.col("id").alias("k"), F.concat(
        F.lit("The algoritm, here "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("zq fine")).alias("text"))
    fixes = spark.createDataFrame([("algoritm", "algorithm"), ("abcdzq", "abcd"), ("unused", "used")], "word string, correction string")
    wanted = texts.select("k", F.explode(spelling._wanted("text")).alias("word"))
    assert wanted.groupBy("word").count().filter("count = 4000").count() == 4
    rare = spelling.rare_words(wanted, spelling.frequent_words(wanted, fixes))
    sizes = sorted(r["count"] for r in rare.repartition(16, "word").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8] and sum(sizes) == 4000 + 4 - spelling.FREQUENT
    got = {r.k: r.text for r in spelling.correct_texts(texts, ["k"], "text", fixes).collect()}
    assert len(got) == 4000 and all(t.startswith("The algorithm, here ") for t in got.values())
    assert got[12] == "The algorithm, here bczq fine" and got[123] == "The algorithm, here bcdzq fine"


def test_float_text(spark):
    values = [1.0, -0.5, 12000000.0, 0.0, 123456789.125, 1e15, 1e16, 1.5e-5, 0.0001, 1e22, 3.3333333333333335]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows.select(rounding.float_text(F.col("x"))).collect()] == [repr(v) for v in values]
