"""Agreement between two score columns, per group.

Group keys may be hot: every statistic is an aggregate with partial merging, and
the kappas work on the table of observed label pairs, never on row pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gradeframe import fixed_values as fv
from gradeframe.functions.text import let


def mae(ai: Column, teacher: Column) -> Column:
    return F.avg(F.abs(ai - teacher))


def pearson(ai: Column, teacher: Column) -> Column:
    """Correlation, 0 when a side is constant, limited to [-1, 1]."""
    return correlation(F.stddev_pop(ai), F.stddev_pop(teacher), F.covar_pop(ai, teacher))


def correlation(spread_a: Column, spread_t: Column, covariance: Column) -> Column:
    r = F.coalesce(F.try_divide(covariance, spread_a * spread_t), F.lit(0.0))
    r = F.when(F.isnan(r), F.lit(0.0)).otherwise(r)
    varied = (spread_a > 1e-9) & (spread_t > 1e-9)
    return F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(F.lit(0.0))


def within(ai: Column, teacher: Column, margin: float) -> Column:
    """Share of pairs no further apart than ``margin``."""
    return F.avg((F.abs(ai - teacher) <= margin).cast("double"))


def _label_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and label: how often each side used it, and the pair statistics.

    ``pairs`` has integer columns ``_a`` and ``_b``. The agreement and distance
    sums ride on side a's rows so that one pass serves both kappas.
    """
    cells = pairs.groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("_a").alias("label"), F.col("_n").alias("na"), zero.alias("nb"),
            F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(zero).alias("same"),
            (F.col("_n") * F.abs(F.col("_a") - F.col("_b"))).alias("distance"),
        ),
        F.struct(
            F.col("_b").alias("label"), zero.alias("na"), F.col("_n").alias("nb"),
            zero.alias("same"), zero.alias("distance"),
        ),
    )
    return (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("na", "nb", "same", "distance")])
    )


#: Up to this many marks a group's pairs of labels are one array, from which its kappa follows.
MOST_LABELS = 100


def weighted_kappa(
    df: DataFrame, ai: str, teacher: str, by: Sequence[str] = (), max_marks: float = 10.0
) -> DataFrame:
    """Linear-weighted kappa on half-even rounded scores, labels 0…⌊max_marks⌋.

    Pairs with a label outside the range, or a score that is no number, are left out. The expected distance
    between two independent labels equals the sum over label boundaries t of
    P(a≤t)P(b>t) + P(b≤t)P(a>t), so running totals over the (few) labels replace
    any pairing of labels. Groups without a pair in range score 0; a group whose
    labels never vary has no defined kappa (NaN).
    """
    by = list(by)
    labelled = df.select(
        *by, F.rint(ai).try_cast("long").alias("_a"), F.rint(teacher).try_cast("long").alias("_b")
    )
    in_range = F.col("_a").between(0, int(max_marks)) & F.col("_b").between(0, int(max_marks))
    counts = _label_counts(labelled.filter(in_range), by)
    group = Window.partitionBy(*by)
    ordered = group.orderBy("label")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.select(
        *by, "na", "distance",
        (F.sum("na").over(upto) / F.sum("na").over(group)).alias("_fa"),
        (F.sum("nb").over(upto) / F.sum("nb").over(group)).alias("_fb"),
        F.coalesce(F.lead("label").over(ordered) - F.col("label"), F.lit(0)).alias("_gap"),
    )
    expected = F.sum(
        (F.col("_fa") * (1 - F.col("_fb")) + F.col("_fb") * (1 - F.col("_fa"))) * F.col("_gap")
    )
    observed = F.sum("distance") / F.sum("na")
    kappa = F.coalesce(1 - F.try_divide(observed, expected), F.lit(float("nan")))
    scored = steps.groupBy(*by).agg(F.sum("na").alias("_m"), kappa.alias("_k"))
    if not by:
        none = F.coalesce(F.col("_m"), F.lit(0)) == 0
        return scored.select(F.when(none, F.lit(0.0)).otherwise(F.col("_k")).alias("cohen_kappa"))
    groups = labelled.select(*by).distinct()
    return groups.join(scored, by, "left").select(
        *by, F.coalesce(F.col("_k"), F.lit(0.0)).alias("cohen_kappa")
    )


def plain_kappa(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted kappa over the observed categories of two integer columns."""
    counts = _label_counts(df.select(*by, a.cast("long").alias("_a"), b.cast("long").alias("_b")), by)
    total = F.sum("na")
    observed = F.sum("same") / total
    chance = F.sum(F.col("na").cast("double") * F.col("nb")) / (total * total.cast("double"))
    kappa = F.when(chance == 1.0, F.lit(1.0)).otherwise(
        F.bround(F.try_divide(observed - chance, 1 - chance), 4)
    )
    return counts.groupBy(*by).agg(kappa.alias("kappa"))


def score_cells(df: DataFrame, ai: str, teacher: str, by: Sequence[str], max_marks: float,
                counted: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of a group by their pair of labels: a small table with sums and moments of each cell.

    Labels outside 0 to ``max_marks``, and scores that are no numbers, share one cell
    without labels. ``counted`` adds sums of further columns.
    """
    a, t = F.col(ai), F.col(teacher)
    label_a, label_t = F.rint(a).try_cast("long"), F.rint(t).try_cast("long")
    ranged = F.coalesce(label_a.between(0, int(max_marks)) & label_t.between(0, int(max_marks)), F.lit(False))
    gap, both = F.abs(a - t), a.isNotNull() & t.isNotNull()
    zero = F.lit(0.0)
    sums = {
        "gap": gap, "within_1": (gap <= 1.0).cast("double"), "within_05": (gap <= 0.5).cast("double"),
        "a": a, "t": t, "pair_a": F.when(both, a), "pair_t": F.when(both, t),
    }
    counts = {"n_gap": F.count(gap), "n_a": F.count(a), "n_t": F.count(t), "n_pair": F.count(F.when(both, 1))}
    moments = {  # sums of squares and products around the means of the cell
        "aa": F.var_pop(a) * F.count(a), "tt": F.var_pop(t) * F.count(t),
        "at": F.covar_pop(a, t) * F.count(F.when(both, 1)),
    }
    rows = df.select("*", F.when(ranged, label_a).alias("_a"), F.when(ranged, label_t).alias("_b"))
    return rows.groupBy(*by, "_a", "_b").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(v.cast("double")), zero).alias(k) for k, v in sums.items()],
        *[v.alias(k) for k, v in counts.items()], *[F.coalesce(v, zero).alias(k) for k, v in moments.items()],
        *[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(k) for k, v in (counted or {}).items()])


def _kappa_of_cells(cells: str, max_marks: float) -> Column:
    """Linear-weighted kappa from an array of (label, label, count), by counts up to each label."""
    add = lambda value: F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s + value(x))
    ranged = lambda x, v: F.when(x["_a"].isNotNull(), v).otherwise(F.lit(0).cast("long"))
    upto = lambda side, k: add(lambda x: ranged(x, F.when(x[side] <= k, x["n"]).otherwise(0)))
    m = add(lambda x: ranged(x, x["n"])).cast("double")
    distance = add(lambda x: ranged(x, x["n"] * F.abs(x["_a"] - x["_b"])))

    def kappa(m: Column) -> Column:
        crossings = F.transform(F.sequence(F.lit(0), F.lit(int(max_marks))), lambda k: let(
            F.struct(upto("_a", k).alias("x"), upto("_b", k).alias("y")),
            lambda u: u["x"] * (m - u["y"]) + u["y"] * (m - u["x"])))
        expected = F.aggregate(crossings, F.lit(0.0), lambda s, x: s + x) / (m * m)
        value = F.coalesce(1 - F.try_divide(distance / m, expected), F.lit(float("nan")))
        return F.when(m == 0, 0.0).otherwise(value)

    return let(m, kappa)


def score_summary(
    df: DataFrame, ai: str, teacher: str, by: Sequence[str] = (), max_marks: float = 10.0,
    counted: Mapping[str, Column] | None = None,
) -> DataFrame:
    """All continuous-score measures per group, each rounded to ten decimals, from one scan.

    Rows are merged to cells, one for each pair of labels, and a group's cells to its
    measures; means come first, then squares around them, so that no digits cancel.
    ``counted`` adds sums of further columns.
    """
    by = list(by)
    small = int(max_marks) <= MOST_LABELS
    cells = score_cells(df, ai, teacher, by, max_marks if small else MOST_LABELS, counted)
    sums = [c for c in cells.columns if c not in (*by, "_a", "_b", "aa", "tt", "at")]
    # a group has as many cells as pairs of labels, and one more
    kept = [c for c in cells.columns if c not in by]
    whole = cells.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.collect_list(F.struct(*kept)).alias("_cells"))
    mean = lambda c, n: F.try_divide(F.col(c), F.col(n))
    means = whole.withColumns({"_ma": mean("a", "n_a"), "_mt": mean("t", "n_t"), "_pa": mean("pair_a", "n_pair"), "_pt": mean("pair_t", "n_pair")})

    def around(n: str, own: Sequence[str], inside: str, centre: Sequence[str]) -> Column:
        """Sum of products around the group's means from those around the cells' means."""
        def cell(x: Column) -> Column:
            off = [x[o] / x[n] - F.col(c) for o, c in zip(own, centre)]
            return F.when(x[n] > 0, x[inside] + x[n] * off[0] * off[1]).otherwise(0.0)

        return F.try_divide(F.aggregate("_cells", F.lit(0.0), lambda s, x: s + cell(x)), F.col(n))

    spread_a, spread_t = F.sqrt(around("n_a", ("a", "a"), "aa", ("_ma", "_ma"))), F.sqrt(around("n_t", ("t", "t"), "tt", ("_mt", "_mt")))
    squares = means.withColumns({"_sa": spread_a, "_st": spread_t, "_c": around("n_pair", ("pair_a", "pair_t"), "at", ("_pa", "_pt"))})
    ten = lambda c, name: F.bround(c, 10).alias(name)
    kappa = [ten(_kappa_of_cells("_cells", max_marks), "cohen_kappa")] if small else []
    stats = squares.select(
        *by, F.col("n").alias("n_samples"), ten(mean("gap", "n_gap"), "mae"),
        ten(correlation(F.col("_sa"), F.col("_st"), F.col("_c")), "pearson_r"),
        ten(mean("within_1", "n_gap"), "accuracy_within_1"), ten(mean("within_05", "n_gap"), "accuracy_within_0_5"),
        ten(F.col("_ma"), "mean_ai_score"), ten(F.col("_mt"), "mean_teacher_score"), *kappa, *(counted or {}))
    if small:
        return stats
    kappa = weighted_kappa(df, ai, teacher, by, max_marks).withColumn(
        "cohen_kappa", F.bround("cohen_kappa", 10)
    )
    if by:
        return stats.join(kappa, by)
    return stats.select("*", kappa.scalar().alias("cohen_kappa"))


def option_accuracy(df: DataFrame, predicted: str, correct: str, by: Sequence[str] = ()) -> DataFrame:
    """Option letters compared without case."""
    hit = F.upper(F.col(predicted)) == F.upper(F.col(correct))
    n, right = F.count(F.lit(1)), F.count_if(hit)
    return df.groupBy(*by).agg(
        n.alias("n_samples"),
        right.alias("mcq_n_correct"),
        (n - right).alias("mcq_n_wrong"),
        F.bround(F.coalesce(F.try_divide(right, n), F.lit(0.0)), 10).alias("mcq_accuracy"),
    )


def binary_summary(df: DataFrame, ai: str, teacher: str, by: Sequence[str] = ()) -> DataFrame:
    """Right/wrong scores (1 or 0) compared, with the score measures that still apply."""
    a, t = F.col(ai), F.col(teacher)
    n, right = F.count(F.lit(1)), F.count_if(a == t)
    return df.groupBy(*by).agg(
        n.alias("n_samples"),
        right.alias("mcq_n_correct"),
        (n - right).alias("mcq_n_wrong"),
        F.bround(F.coalesce(F.try_divide(right, n), F.lit(0.0)), 10).alias("mcq_accuracy"),
        F.bround(mae(a, t), 10).alias("mae"),
        F.bround(within(a, t, 1.0), 10).alias("accuracy_within_1"),
    )


def report_by_type(
    df: DataFrame, ai: str, teacher: str, question_type: str = "question_type",
    max_marks: float = 10.0,
) -> DataFrame:
    """One report row per question type; ``mcq`` is compared as right or wrong."""
    a, t = F.col(ai), F.col(teacher)
    is_mcq = F.col(question_type) == "mcq"
    both = df.filter(F.col(question_type).isNotNull()).withColumn("_right", a == t)
    rows = score_summary(both, ai, teacher, [question_type], max_marks, {"_n_right": F.col("_right")})
    rows = rows.withColumn("_accuracy", F.bround(F.col("_n_right") / F.col("n_samples"), 10))
    shared = ["n_samples", "mae", "accuracy_within_1"]
    continuous = [c for c in rows.columns if c not in (question_type, *shared, "_n_right", "_accuracy")]
    return rows.select(
        question_type, *shared, *[F.when(~is_mcq, F.col(c)).alias(c) for c in continuous],
        F.when(is_mcq, F.col("_n_right")).alias("mcq_n_correct"),
        F.when(is_mcq, F.col("n_samples") - F.col("_n_right")).alias("mcq_n_wrong"),
        F.when(is_mcq, F.col("_accuracy")).alias("mcq_accuracy"),
    )


def score_sheet_report(df: DataFrame, ai: str = "ai_score", teacher: str = "teacher_score") -> DataFrame:
    """The four-decimal report of a score sheet, with a plain kappa on half-mark steps."""
    from gradeframe.functions.text import discretize

    a, t = F.col(ai), F.col(teacher)
    stats = df.agg(
        F.bround(mae(a, t), 4).alias("mae"),
        F.bround(pearson(a, t), 4).alias("pearson_r"),
        F.bround(within(a, t, 1.0), 4).alias("accuracy_within_1"),
        F.bround(within(a, t, 0.5), 4).alias("accuracy_within_05"),
        F.count(F.lit(1)).alias("n"),
    )
    kappa = plain_kappa(df, discretize(t), discretize(a))
    return stats.select("*", kappa.scalar().alias("cohen_kappa"))


def with_teacher_proxy(results: DataFrame) -> DataFrame:
    """Open-type results with a stand-in teacher score.

    The stand-in is the marks times the similarity, a missing or zero similarity
    counting as one half. It shows self-consistency, not accuracy.
    """
    similarity = F.coalesce(F.nullif(F.col("similarity_score"), F.lit(0.0)), F.lit(0.5))
    open_type = F.col("question_type").isin(fv.JSON_REPLY_TYPES)
    usable = F.col("final_score").isNotNull() & (F.coalesce(F.col("max_marks"), F.lit(0.0)) != 0)
    return results.filter(open_type & usable).withColumn(
        "teacher_proxy", F.col("max_marks") * similarity
    )


def snapshot_parts(results: DataFrame, max_marks: float = 10.0) -> DataFrame:
    """What the snapshot needs, as sums by kind of row and pair of labels.

    Parts of disjoint sets of results may be added, and subtracted with
    ``negated``, so a snapshot can be kept up to date without the old results.
    """
    kinds = results.withColumn("_open", F.coalesce(
        F.col("question_type").isin(fv.JSON_REPLY_TYPES) & F.col("final_score").isNotNull()
        & (F.coalesce(F.col("max_marks"), F.lit(0.0)) != 0), F.lit(False)))
    answered = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    lettered = (F.col("question_type") == "mcq") & answered("mcq_detected_answer") & answered("mcq_correct_answer")
    similarity = F.coalesce(F.nullif(F.col("similarity_score"), F.lit(0.0)), F.lit(0.5))
    a, t = F.col("final_score"), F.col("max_marks") * similarity
    label = lambda c: F.rint(c).try_cast("long")
    ranged = F.col("_open") & label(a).between(0, int(max_marks)) & label(t).between(0, int(max_marks))
    gap = F.abs(a - t)
    hit = F.upper("mcq_detected_answer") == F.upper("mcq_correct_answer")
    sums = {
        "gap": gap, "a": a, "t": t, "aa": a * a, "tt": t * t, "at": a * t,
        "within_1": (gap <= 1.0).cast("double"), "within_05": (gap <= 0.5).cast("double"),
    }
    rows = kinds.select(
        F.when(F.col("_open"), "open").when(lettered, "mcq").otherwise("other").alias("kind"),
        F.when(ranged, label(a)).alias("label_a"), F.when(ranged, label(t)).alias("label_t"),
        *[F.when(F.col("_open"), v).otherwise(0.0).alias(n) for n, v in sums.items()],
        F.when(lettered & hit, 1).otherwise(0).cast("long").alias("right"),
    )
    return rows.groupBy("kind", "label_a", "label_t").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in (*sums, "right")]
    )


PART_KEYS = ("kind", "label_a", "label_t")


def negated(parts: DataFrame) -> DataFrame:
    return parts.select(*PART_KEYS, *[(-F.col(c)).alias(c) for c in parts.columns if c not in PART_KEYS])


def added(parts: DataFrame, more: DataFrame) -> DataFrame:
    """Parts of both sets together; a few hundred rows at most."""
    both = parts.unionByName(more)
    return both.groupBy(*PART_KEYS).agg(*[F.sum(c).alias(c) for c in both.columns if c not in PART_KEYS])


def snapshot_of(parts: DataFrame, max_marks: float = 10.0) -> DataFrame:
    """The one-row metric snapshot of some parts, JSON fields null when empty."""
    opened, mcq = F.col("kind") == "open", F.col("kind") == "mcq"
    of = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    ranged = opened & F.col("label_a").isNotNull()
    labels = range(int(max_marks) + 1)
    sums = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), of(opened, "n").alias("n"), of(ranged, "n").alias("m"),
        *[of(opened, c).alias(c) for c in ("gap", "a", "t", "aa", "tt", "at", "within_1", "within_05")],
        of(mcq, "n").alias("n_mcq"), of(mcq, "right").alias("right"),
        F.coalesce(F.sum(F.when(ranged, F.col("n") * F.abs(F.col("label_a") - F.col("label_t")))), F.lit(0)).alias("distance"),
        F.array(*[of(ranged & (F.col("label_a") <= k), "n") for k in labels]).alias("upto_a"),
        F.array(*[of(ranged & (F.col("label_t") <= k), "n") for k in labels]).alias("upto_t"),
    )
    n, m = F.col("n"), F.col("m")
    mean = lambda c: F.try_divide(F.col(c), n)
    spread = lambda c, cc: mean(cc) - mean(c) * mean(c)
    # a variance this far below the squares is rounding
    varied = lambda c, cc: spread(c, cc) > 1e-12 * F.greatest(F.lit(1.0), mean(cc))
    pearson_r = F.when(varied("a", "aa") & varied("t", "tt"), F.try_divide(
        mean("at") - mean("a") * mean("t"), F.sqrt(spread("a", "aa")) * F.sqrt(spread("t", "tt")))).otherwise(0.0)
    share = F.zip_with("upto_a", "upto_t", lambda x, y: (x * (m - y) + y * (m - x)) / (m * m))
    expected = F.aggregate(share, F.lit(0.0), lambda x, y: x + y)
    kappa_value = F.when(m == 0, 0.0).otherwise(
        F.coalesce(1 - F.try_divide(F.col("distance") / m, expected), F.lit(float("nan"))))
    ten = lambda c, name: F.bround(c, 10).alias(name)
    accuracy = F.coalesce(F.try_divide("right", "n_mcq"), F.lit(0.0))
    return sums.select(
        F.lit(1).alias("id"),
        F.when(n >= 2, F.to_json(F.struct(
            n.alias("n_samples"), ten(mean("gap"), "mae"), ten(pearson_r, "pearson_r"), ten(kappa_value, "cohen_kappa"),
            ten(mean("within_1"), "accuracy_within_1_mark"), ten(mean("within_05"), "accuracy_within_0_5_mark"),
            ten(mean("a"), "mean_ai_score"), ten(mean("t"), "mean_teacher_score")))).alias("open_ended"),
        F.when(F.col("n_mcq") > 0, F.to_json(F.struct(
            F.col("n_mcq").alias("n_samples"), ten(accuracy, "accuracy"), F.bround(accuracy * 100, 1).alias("accuracy_pct"),
            F.col("right").alias("n_correct"), (F.col("n_mcq") - F.col("right")).alias("n_wrong")))).alias("mcq"),
        F.col("total").alias("total_evaluated"),
        F.current_timestamp().alias("computed_at"),
    )


def snapshot(results: DataFrame, max_marks: float = 10.0) -> DataFrame:
    """The one-row metric snapshot over all stored results, in one pass over them."""
    return snapshot_of(snapshot_parts(results, max_marks), max_marks)


def adhoc_pairs(requests: DataFrame, ai: str = "ai_scores", teacher: str = "teacher_scores") -> DataFrame:
    """Validate two comma lists per request.

    Adds ``problem`` (null when valid) and ``pairs``, an array of
    ``struct(ai, teacher)`` that is empty for a rejected request.
    """
    def parsed(name: str) -> Column:
        pieces = F.transform(F.split(F.coalesce(F.col(name), F.lit("")), ","), lambda p: F.trim(p))
        return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: p.try_cast("double"))

    lists = requests.withColumns({"_ai": parsed(ai), "_gt": parsed(teacher)})
    bad_number = F.exists("_ai", lambda v: v.isNull()) | F.exists("_gt", lambda v: v.isNull())
    problem = (
        F.when(bad_number, F.lit(fv.SCORES_NOT_NUMBERS))
        .when(
            F.size("_ai") != F.size("_gt"),
            F.format_string(fv.SCORES_UNEVEN, F.size("_ai"), F.size("_gt")),
        )
        .when(F.size("_ai") < 2, F.lit(fv.SCORES_TOO_FEW))
    )
    pairs = F.zip_with("_ai", "_gt", lambda a, g: F.struct(a.alias("ai"), g.alias("teacher")))
    return lists.withColumn("problem", problem).withColumn(
        "pairs", F.when(F.col("problem").isNull(), pairs).otherwise(F.slice(pairs, 1, 0))
    ).drop("_ai", "_gt")


def _row_labels(pairs: Column, max_marks: float) -> Column:
    """The labels of one array of pairs, without pairs outside the scale."""
    return F.filter(
        F.transform(pairs, lambda p: F.struct(
            F.rint(p["ai"]).try_cast("long").alias("a"), F.rint(p["teacher"]).try_cast("long").alias("b"))),
        lambda p: p["a"].between(0, int(max_marks)) & p["b"].between(0, int(max_marks)),
    )


def _row_kappa(labelled: Column, max_marks: float) -> Column:
    """Weighted kappa of one array of labels, from their counts.

    Pass a materialised column: an expression would be evaluated anew for each label.
    """
    n = F.size(labelled)
    upto = lambda side, edge: F.size(F.filter(labelled, lambda p: p[side] <= edge)) / n

    def crossing(total: Column, edge: Column) -> Column:
        a, b = upto("a", edge), upto("b", edge)
        return total + a * (1 - b) + b * (1 - a)

    expected = F.aggregate(F.sequence(F.lit(0), F.lit(int(max_marks))), F.lit(0.0), crossing)
    observed = F.aggregate(labelled, F.lit(0.0), lambda total, p: total + F.abs(p["a"] - p["b"])) / n
    return F.when(n == 0, 0.0).otherwise(F.coalesce(1 - F.try_divide(observed, expected), F.lit(float("nan"))))


def adhoc_report(
    requests: DataFrame, key: str, ai: str = "ai_scores", teacher: str = "teacher_scores",
    max_marks: float = 10.0, question_type: str | None = None,
) -> DataFrame:
    """Measures for every valid request; rejected requests keep only ``problem``.

    ``question_type`` names a column: requests of type ``mcq`` get the right/wrong
    measures of their scores, all others the continuous ones. A request's lists are
    one row, so everything is computed there: no shuffle.
    """
    checked = adhoc_pairs(requests, ai, teacher)
    pairs, n = F.col("pairs"), F.size("pairs")
    checked = checked.withColumn("_labels", _row_labels(pairs, max_marks))
    mcq = F.coalesce(F.col(question_type) == "mcq", F.lit(False)) if question_type else F.lit(False)
    valid = F.col("problem").isNull()
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda x, p: x + f(p))
    share = lambda test: total(lambda p: test(p).cast("double")) / n
    sums = checked.withColumn("_m", F.when(valid, F.struct(
        (total(lambda p: p["ai"]) / n).alias("a"), (total(lambda p: p["teacher"]) / n).alias("t"))))
    off = lambda p, side, mean: p[side] - F.col(f"_m.{mean}")
    spread = lambda side, mean: F.sqrt(total(lambda p: off(p, side, mean) * off(p, side, mean)) / n)
    both = sums.withColumn("_s", F.when(valid, F.struct(
        spread("ai", "a").alias("a"), spread("teacher", "t").alias("t"),
        (total(lambda p: off(p, "ai", "a") * off(p, "teacher", "t")) / n).alias("c"))))
    varied = (F.col("_s.a") > 1e-9) & (F.col("_s.t") > 1e-9)
    pearson_r = F.when(varied, F.try_divide(F.col("_s.c"), F.col("_s.a") * F.col("_s.t"))).otherwise(0.0)
    right = total(lambda p: (p["ai"] == p["teacher"]).cast("double"))
    gap = lambda p: F.abs(p["ai"] - p["teacher"])
    continuous, letters = valid & ~mcq, valid & mcq
    at = lambda when, value: F.when(when, F.bround(value, 10))
    return both.select(
        key, "problem", F.when(valid, n).alias("n_samples"),
        at(valid, total(gap) / n).alias("mae"), at(continuous, pearson_r).alias("pearson_r"),
        at(valid, share(lambda p: gap(p) <= 1.0)).alias("accuracy_within_1"),
        at(continuous, share(lambda p: gap(p) <= 0.5)).alias("accuracy_within_0_5"),
        at(continuous, F.col("_m.a")).alias("mean_ai_score"), at(continuous, F.col("_m.t")).alias("mean_teacher_score"),
        at(continuous, _row_kappa(F.col("_labels"), max_marks)).alias("cohen_kappa"),
        at(letters, right / n).alias("mcq_accuracy"), F.when(letters, right.cast("long")).alias("mcq_n_correct"),
        F.when(letters, n - right.cast("long")).alias("mcq_n_wrong"),
    )
