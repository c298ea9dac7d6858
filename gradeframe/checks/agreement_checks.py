"""Score agreement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe.checks import sqltext as q
from gradeframe.checks.registry import Tables, check
from gradeframe.functions.text import discretize
from gradeframe.operators import agreement as ag, reports

AI, GT = "l_quantity", "teacher"


def scores(t: Tables) -> DataFrame:
    """Quantities as one rater, a shifted and coarser copy as the other."""
    teacher = F.col("l_quantity") + (F.col("l_partkey") % 5 - 2) + F.rint(F.col("l_tax") * 100) / 8
    kind = F.element_at(
        F.array(F.lit("open_ended"), F.lit("short_answer"), F.lit("mcq"), F.lit("numerical")),
        (F.col("l_suppkey") % 4 + 1).cast("int"),
    )
    return t.lineitem.select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_partkey", "l_suppkey",
        teacher.alias("teacher"), kind.alias("question_type"),
    )


SCORES = """s AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, l_partkey, l_suppkey,
    l_quantity + (l_partkey % 5 - 2) + round_even(l_tax * 100, 0) / 8 AS teacher,
    CASE l_suppkey % 4 WHEN 0 THEN 'open_ended' WHEN 1 THEN 'short_answer' WHEN 2 THEN 'mcq' ELSE 'numerical' END AS question_type
  FROM lineitem)"""


@check(
    "mean_absolute_error", "D11",
    f"WITH {SCORES} SELECT l_returnflag, round(avg(abs(l_quantity - teacher)), 8) AS mae FROM s GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return scores(t).groupBy("l_returnflag").agg(
        F.round(ag.mae(F.col(AI), F.col(GT)), 8).alias("mae")
    )


@check(
    "pearson_by_flag", "D12",
    f"""WITH {SCORES} SELECT l_returnflag, round(corr(l_quantity, teacher), 8) AS r, 0.0::DOUBLE AS r_constant FROM s GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return scores(t).groupBy("l_returnflag").agg(
        F.round(ag.pearson(F.col(AI), F.col(GT)), 8).alias("r"),
        ag.pearson(F.lit(7.0) + F.col(AI) * 0, F.col(GT)).alias("r_constant"),
    )


@check(
    "accuracy_within_margins", "D13",
    f"""WITH {SCORES} SELECT l_returnflag, round(avg((abs(l_quantity - teacher) <= 1)::INT), 8) AS within_1,
      round(avg((abs(l_quantity - teacher) <= 0.5)::INT), 8) AS within_05,
      round(avg((abs(l_quantity - teacher) <= 2)::INT), 8) AS within_2 FROM s GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    a, g = F.col(AI), F.col(GT)
    return scores(t).groupBy("l_returnflag").agg(
        F.round(ag.within(a, g, 1.0), 8).alias("within_1"),
        F.round(ag.within(a, g, 0.5), 8).alias("within_05"),
        F.round(ag.within(a, g, 2.0), 8).alias("within_2"),
    )


KAPPA = """lab AS (SELECT {by} AS g, round_even({ai}, 0)::BIGINT AS a, round_even({gt}, 0)::BIGINT AS b FROM {src}),
  ok AS (SELECT * FROM lab WHERE a BETWEEN 0 AND {top} AND b BETWEEN 0 AND {top}),
  tot AS (SELECT g, count(*) AS n, avg(abs(a - b)) AS o FROM ok GROUP BY g),
  ma AS (SELECT g, a, count(*) AS na FROM ok GROUP BY ALL), mb AS (SELECT g, b, count(*) AS nb FROM ok GROUP BY ALL),
  ex AS (SELECT ma.g, sum(na::DOUBLE * nb * abs(a - b)) AS e FROM ma JOIN mb ON ma.g = mb.g GROUP BY ALL),
  kap AS (SELECT tot.g, 1 - o / (e / (n::DOUBLE * n)) AS k FROM tot JOIN ex ON tot.g = ex.g)"""


def kappa(by: str, ai: str, gt: str, src: str, top: int) -> str:
    return KAPPA.format(by=by, ai=ai, gt=gt, src=src, top=top)


@check(
    "weighted_kappa", "D15",
    f"WITH {SCORES}, {kappa('l_returnflag', 'l_quantity', 'teacher', 's', 50)} "
    "SELECT g AS l_returnflag, round(k, 8) AS cohen_kappa FROM kap",
)
def _(t: Tables) -> DataFrame:
    return ag.weighted_kappa(scores(t), AI, GT, ["l_returnflag"], 50).withColumn(
        "cohen_kappa", F.round("cohen_kappa", 8)
    )


@check(
    "weighted_kappa_default_marks", "D15",
    f"WITH {SCORES}, {kappa('1', 'l_quantity', 'teacher', 's', 10)} SELECT round(k, 8) AS cohen_kappa FROM kap",
)
def _(t: Tables) -> DataFrame:
    return ag.weighted_kappa(scores(t), AI, GT).withColumn("cohen_kappa", F.round("cohen_kappa", 8))


@check(
    "plain_kappa_on_half_marks", "D16 H41",
    f"""WITH {SCORES}, d AS (SELECT l_linestatus, trunc(l_quantity / 0.5) * 5 AS a, trunc(teacher / 0.5) * 5 AS b FROM s),
    n AS (SELECT l_linestatus, count(*) AS n, avg((a = b)::INT) AS po FROM d GROUP BY 1),
    e AS (SELECT x.l_linestatus, sum(x.c::DOUBLE * y.c) AS e FROM (SELECT l_linestatus, a, count(*) AS c FROM d GROUP BY ALL) x
      JOIN (SELECT l_linestatus, b, count(*) AS c FROM d GROUP BY ALL) y ON x.l_linestatus = y.l_linestatus AND x.a = y.b GROUP BY 1)
    SELECT n.l_linestatus, round_even((po - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 4) AS kappa FROM n JOIN e USING (l_linestatus)""",
)
def _(t: Tables) -> DataFrame:
    return ag.plain_kappa(
        scores(t), discretize(F.col(AI)), discretize(F.col(GT)), ["l_linestatus"]
    )


@check(
    "option_accuracy", "D17",
    """SELECT l_returnflag, count(*) AS n_samples, count(*) FILTER (substr('abcde', (l_partkey % 5 + 1)::INT, 1) = substr('abcde', (l_suppkey % 5 + 1)::INT, 1)) AS mcq_n_correct,
      count(*) FILTER (substr('abcde', (l_partkey % 5 + 1)::INT, 1) <> substr('abcde', (l_suppkey % 5 + 1)::INT, 1)) AS mcq_n_wrong,
      round(avg((l_partkey % 5 = l_suppkey % 5)::INT), 10) AS mcq_accuracy FROM lineitem GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    letter = lambda letters, c: F.substring(F.lit(letters), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    rows = t.lineitem.select(
        "l_returnflag", letter("abcde", "l_partkey").alias("p"), letter("ABCDE", "l_suppkey").alias("c")
    )
    return ag.option_accuracy(rows, "p", "c", ["l_returnflag"])


@check(
    "binary_scores", "D18",
    """SELECT l_linestatus, count(*) AS n_samples, count(*) FILTER (l_partkey % 2 = l_suppkey % 2) AS mcq_n_correct,
      count(*) FILTER (l_partkey % 2 <> l_suppkey % 2) AS mcq_n_wrong, round(avg((l_partkey % 2 = l_suppkey % 2)::INT), 10) AS mcq_accuracy,
      round(avg(abs(l_partkey % 2 - l_suppkey % 2)), 10) AS mae, 1.0::DOUBLE AS accuracy_within_1 FROM lineitem GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_linestatus", (F.col("l_partkey") % 2).cast("double").alias("a"),
        (F.col("l_suppkey") % 2).cast("double").alias("g"),
    )
    return ag.binary_summary(rows, "a", "g", ["l_linestatus"])


REPORT = f"""{SCORES}, {kappa('question_type', 'l_quantity', 'teacher', 's', 50)}"""


@check(
    "report_by_question_type", "D11 D12 D13 D14 D15 D18 D19",
    f"""WITH {REPORT} SELECT question_type, count(*) AS n_samples, round(avg(abs(l_quantity - teacher)), 8) AS mae,
      CASE WHEN question_type <> 'mcq' THEN round(corr(l_quantity, teacher), 8) END AS pearson_r,
      round(avg((abs(l_quantity - teacher) <= 1)::INT), 8) AS accuracy_within_1,
      CASE WHEN question_type <> 'mcq' THEN round(avg((abs(l_quantity - teacher) <= 0.5)::INT), 8) END AS accuracy_within_0_5,
      CASE WHEN question_type <> 'mcq' THEN round(avg(l_quantity), 8) END AS mean_ai_score,
      CASE WHEN question_type <> 'mcq' THEN round(avg(teacher), 8) END AS mean_teacher_score,
      CASE WHEN question_type <> 'mcq' THEN round(any_value(k), 8) END AS cohen_kappa,
      CASE WHEN question_type = 'mcq' THEN count(*) FILTER (l_quantity = teacher) END AS mcq_n_correct,
      CASE WHEN question_type = 'mcq' THEN count(*) FILTER (l_quantity <> teacher) END AS mcq_n_wrong,
      CASE WHEN question_type = 'mcq' THEN round(avg((l_quantity = teacher)::INT), 8) END AS mcq_accuracy
    FROM s JOIN kap ON g = question_type GROUP BY question_type""",
)
def _(t: Tables) -> DataFrame:
    report = ag.report_by_type(scores(t), AI, GT, max_marks=50)
    doubles = [c for c, k in report.dtypes if k == "double"]
    return report.withColumns({c: F.round(c, 8) for c in doubles})


def results(t: Tables) -> DataFrame:
    """Order lines as stored results."""
    letter = lambda c: F.substring(F.lit("ABCDE"), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    kinds = F.array(*[F.lit(k) for k in ("open_ended", "short_answer", "diagram", "mcq", "numerical")])
    return t.lineitem.select(
        "l_orderkey", "l_returnflag",
        F.element_at(kinds, (F.col("l_partkey") % 5 + 1).cast("int")).alias("question_type"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity") % 11).alias("final_score"),
        F.when(F.col("l_quantity") == 7, 0.0).otherwise(10.0).alias("max_marks"),
        F.when(F.col("l_linenumber") != 2, F.rint(F.col("l_discount") * 100) / 10).alias("similarity_score"),
        F.when(F.col("l_linenumber") != 3, F.rint(F.col("l_tax") * 100) / 4).alias("evaluation_time_sec"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(letter("l_partkey")).alias("mcq_detected_answer"),
        letter("l_suppkey").alias("mcq_correct_answer"),
    )


RESULTS = """results AS (SELECT l_orderkey, l_returnflag,
    CASE l_partkey % 5 WHEN 0 THEN 'open_ended' WHEN 1 THEN 'short_answer' WHEN 2 THEN 'diagram' WHEN 3 THEN 'mcq' ELSE 'numerical' END AS question_type,
    CASE WHEN l_quantity <> 13 THEN l_quantity % 11 END AS final_score,
    CASE WHEN l_quantity = 7 THEN 0.0 ELSE 10.0 END AS max_marks,
    CASE WHEN l_linenumber <> 2 THEN round_even(l_discount * 100, 0) / 10 END AS similarity_score,
    CASE WHEN l_linenumber <> 3 THEN round_even(l_tax * 100, 0) / 4 END AS evaluation_time_sec,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE substr('ABCDE', (l_partkey % 5 + 1)::INT, 1) END AS detected,
    substr('ABCDE', (l_suppkey % 5 + 1)::INT, 1) AS correct FROM lineitem)"""


@check(
    "metric_snapshot", "D20 A10",
    f"""WITH {RESULTS}, o AS (SELECT final_score AS ai, max_marks * coalesce(nullif(similarity_score, 0), 0.5) AS gt FROM results
        WHERE question_type IN ('open_ended', 'short_answer', 'diagram') AND final_score IS NOT NULL AND max_marks <> 0),
      m AS (SELECT * FROM results WHERE question_type = 'mcq' AND detected <> ''),
      {kappa('1', 'ai', 'gt', 'o', 10)}
    SELECT (SELECT count(*) FROM results) AS total_evaluated, (SELECT count(*) FROM o) AS n_open,
      round((SELECT avg(abs(ai - gt)) FROM o), 6) AS mae, round((SELECT corr(ai, gt) FROM o), 6) AS pearson_r,
      round((SELECT k FROM kap), 6) AS cohen_kappa, (SELECT count(*) FROM m) AS n_mcq,
      (SELECT count(*) FILTER (detected = correct) FROM m) AS n_correct""",
)
def _(t: Tables) -> DataFrame:
    shot = ag.snapshot(results(t))
    opened = F.from_json("open_ended", "n_samples long, mae double, pearson_r double, cohen_kappa double")
    mcq = F.from_json("mcq", "n_samples long, n_correct long")
    return shot.withColumns({"o": opened, "m": mcq}).select(
        "total_evaluated", F.col("o.n_samples").alias("n_open"), F.round("o.mae", 6).alias("mae"),
        F.round("o.pearson_r", 6).alias("pearson_r"), F.round("o.cohen_kappa", 6).alias("cohen_kappa"),
        F.col("m.n_samples").alias("n_mcq"), F.col("m.n_correct").alias("n_correct"),
    )


@check(
    "system_stats", "D3",
    f"""WITH {RESULTS} SELECT count(*) AS evaluated, count(*) FILTER (question_type = 'mcq') AS mcq_evaluated,
      count(*) FILTER (question_type = 'open_ended') AS open_ended_evaluated,
      round_even(sum(coalesce(final_score, 0)) / count(*), 2) AS average_score,
      round_even(avg(nullif(evaluation_time_sec, 0)), 2) AS average_evaluation_time_sec FROM results""",
)
def _(t: Tables) -> DataFrame:
    return reports.system_stats(results(t))


_MEASURES = {
    "mae": "list_sum(list_transform(range(1, 5), lambda i: abs(a[i] - g[i]))) / 4",
    "within_1": "len(list_filter(range(1, 5), lambda i: abs(a[i] - g[i]) <= 1)) / 4",
    "within_0_5": "len(list_filter(range(1, 5), lambda i: abs(a[i] - g[i]) <= 0.5)) / 4",
    "right_": "len(list_filter(range(1, 5), lambda i: a[i] = g[i]))",
    "mean_a": "list_avg(a)", "mean_g": "list_avg(g)",
}


@check(
    "adhoc_metrics", "D21",
    f"""WITH l AS (SELECT event_id, event_type, [value % 10, value % 10 + 1, user_id % 10, 5] AS a, [user_id % 10, value % 10, value % 10 + 0.25, 5] AS g FROM events),
    m AS (SELECT event_id, event_type, {', '.join(f"{sql} AS {name}" for name, sql in _MEASURES.items())} FROM l),
    u AS (SELECT event_id, unnest(a) AS x, unnest(g) AS y FROM l), r AS (SELECT event_id, coalesce(corr(x, y), 0) AS r FROM u GROUP BY 1),
    d AS (SELECT event_id, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM u), k AS (SELECT * FROM d WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10),
    e AS (SELECT p.event_id, avg(abs(p.x - o.y)) AS e FROM k p JOIN k o USING (event_id) GROUP BY 1), o AS (SELECT event_id, avg(abs(x - y)) AS o FROM k GROUP BY 1),
    c AS (SELECT event_id, 1 - o / e AS c FROM e JOIN o USING (event_id))
    SELECT event_id, CASE event_type WHEN 'error' THEN 'Length mismatch: 4 vs 2' WHEN 'signup' THEN 'Scores must be comma-separated floats.' END AS problem,
      CASE WHEN ok THEN round(mae, 6) END AS mae, CASE WHEN ok THEN within_1 END AS accuracy_within_1,
      CASE WHEN cont THEN round(r, 6) END AS pearson_r, CASE WHEN cont THEN round(c, 6) END AS cohen_kappa,
      CASE WHEN cont THEN within_0_5 END AS accuracy_within_0_5, CASE WHEN cont THEN round(mean_a, 6) END AS mean_ai_score,
      CASE WHEN cont THEN round(mean_g, 6) END AS mean_teacher_score, CASE WHEN ok AND NOT cont THEN right_ / 4 END AS mcq_accuracy,
      CASE WHEN ok AND NOT cont THEN right_::BIGINT END AS mcq_n_correct, CASE WHEN ok AND NOT cont THEN 4 - right_::BIGINT END AS mcq_n_wrong
    FROM (SELECT *, event_type NOT IN ('error', 'signup') AS ok, event_type NOT IN ('error', 'signup', 'click') AS cont FROM m) JOIN r USING (event_id) JOIN c USING (event_id)""",
)
def _(t: Tables) -> DataFrame:
    value, user = F.col("value") % 10, F.col("user_id") % 10
    v, u = value.cast("string"), user.cast("string")
    plus = lambda x: (value + x).cast("string")
    teacher = (
        F.when(F.col("event_type") == "error", F.concat_ws(", ", u, v))
        .when(F.col("event_type") == "signup", F.concat_ws(",", u, F.lit("x"), v, F.lit("5")))
        .otherwise(F.concat_ws(" ,", u, v, F.lit(""), plus(0.25), F.lit("5")))
    )
    requests = t.events.select(
        "event_id", F.concat_ws(",", v, plus(1), u, F.lit("5")).alias("ai_scores"), teacher.alias("teacher_scores"),
        F.when(F.col("event_type") == "click", "mcq").otherwise("open_ended").alias("question_type"),
    )
    report = ag.adhoc_report(requests, "event_id", question_type="question_type").drop("n_samples")
    rounded = ["mae", "pearson_r", "cohen_kappa", "mean_ai_score", "mean_teacher_score"]
    return report.withColumns({c: F.round(c, 6) for c in rounded})


@check(
    "score_sheet_report", "A2",
    """WITH s AS (SELECT value / 50 AS t, value / 50 + (user_id % 5 - 2) * 0.25 AS a FROM events),
    d AS (SELECT trunc(t / 0.5) * 5 AS x, trunc(a / 0.5) * 5 AS y FROM s),
    e AS (SELECT sum(p.c::DOUBLE * r.c) AS e FROM (SELECT x, count(*) AS c FROM d GROUP BY 1) p JOIN (SELECT y, count(*) AS c FROM d GROUP BY 1) r ON x = y),
    n AS (SELECT count(*)::DOUBLE AS n, avg((x = y)::INT) AS po FROM d)
    SELECT round_even(avg(abs(t - a)), 4) AS mae, round_even(corr(t, a), 4) AS pearson_r, 1.0::DOUBLE AS accuracy_within_1,
      round_even(avg((abs(a - t) <= 0.5)::INT), 4) AS accuracy_within_05, count(*) AS n,
      (SELECT round_even((po - e / (n * n)) / (1 - e / (n * n)), 4) FROM n, e) AS cohen_kappa FROM s""",
)
def _(t: Tables) -> DataFrame:
    sheet = t.events.select(
        (F.col("value") / 50).alias("teacher_score"),
        (F.col("value") / 50 + (F.col("user_id") % 5 - 2) * 0.25).alias("ai_score"),
    )
    return ag.score_sheet_report(sheet)


@check(
    "label_agreement", "D11 D16",
    """WITH n AS (SELECT count(*)::DOUBLE AS n, avg((quality = 1 - toxic)::INT) AS po, avg(quality) AS p, avg(1 - toxic) AS r FROM labels)
    SELECT round_even((po - (p * r + (1 - p) * (1 - r))) / (1 - (p * r + (1 - p) * (1 - r))), 4) AS kappa FROM n""",
)
def _(t: Tables) -> DataFrame:
    return ag.plain_kappa(t.labels, F.col("quality"), 1 - F.col("toxic"))


@check(
    "score_distribution", "D28",
    f"""WITH {SCORES}, b AS (SELECT least(greatest(floor(l_quantity / 5) + 1, 1), 10)::INT AS bin, 1 AS a, 0 AS t FROM s
      UNION ALL SELECT least(greatest(floor(teacher / 5) + 1, 1), 10)::INT, 0, 1 FROM s)
    SELECT bin, sum(a)::BIGINT AS ai_count, sum(t)::BIGINT AS teacher_count FROM b GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return reports.score_distribution(scores(t), AI, GT, 50.0, 10).withColumn("bin", F.col("bin").cast("int"))


@check(
    "disagreement_ranking", "D29",
    f"""WITH {SCORES} SELECT l_partkey, round_even(avg(abs(l_quantity - teacher)), 6) AS mae, count(*) AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def _(t: Tables) -> DataFrame:
    return reports.disagreement_ranking(scores(t), "l_partkey", AI, GT)
