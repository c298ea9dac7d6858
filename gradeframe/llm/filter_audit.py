"""How the filters of a corpus interact: what each removes in every order of application.

Five filters judge whole texts (null: empty; words are the stretches between ASCII white
space, case counts):

* A: fewer than 50 words
* B: fewer than 65 different words in 100 words
* C: more than 5 capitals A to Z in 100 code points
* D: one of the characters ``#$%&*|``
* E: the same text as some row with a smaller id, whether that is removed or not

E is a left-semi join with an earlier row on hash, exact text and smaller id. The earlier
row is the first of its text, found by an aggregate that merges copies before the shuffle,
so copies are not paired, and adaptive execution can split a text that many rows have.
These rows and those that fail the other filters are one union of failures, which adds up
to a set of letters for each row, and the rows are counted by part and set: at most 32
counts a part, from which all 120 orders follow.

Rows without an id fail E never and have no smaller id; ids may repeat, and rows with one
id and text are counted one by one. Of labels that repeat the larger counts. A null
source and an empty one are the same part. Empty tables give no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import let, staged, whole_text

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
SPACES = "\t\n\x0b\x0c\r"


def failures(text: Column) -> Column:
    """The letters A to D that a text fails, as bits."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")

    def bits(w: Column) -> Column:
        n = F.size(w)
        return ((n < LEAST_WORDS).cast("int") + (100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * n).cast("int") * 2)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (let(words, bits) + (100 * capitals > MOST_CAPITALS * F.length(text)).cast("int") * 4
            + text.rlike(SIGNS).cast("int") * 8)


def repeats(docs: DataFrame) -> DataFrame:
    """The rows (part, doc_id, hash) of texts that a row with a smaller id has too."""
    first = docs.groupBy(F.col("hash").alias("h"), F.col("text").alias("t")).agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = staged(first, "firsts")  # a table of its own lets Spark split the other side's hot texts
    same = (F.col("hash") == F.col("h")) & (F.col("text") == F.col("t")) & (F.col("first") < F.col("doc_id"))
    return docs.join(first, same, "left_semi").select("part", "doc_id", "hash")


def combinations(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 part: str = "source") -> DataFrame:
    """(part, failed, n, good, toxic): rows of each part by the set of letters they fail, as bits."""
    whole = whole_text(text)
    docs = docs.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(key).alias("doc_id"), whole.alias("text"),
                       F.unhex(F.md5(whole.cast("binary"))).alias("hash"))
    rows = staged(docs.select("part", "doc_id", "hash", F.lit(1).alias("n"), failures(F.col("text")).alias("bits")), "judged")
    copies = repeats(docs).withColumns({"n": F.lit(0), "bits": F.lit(16)})
    judged = rows.unionByName(copies).groupBy("part", "doc_id", "hash").agg(
        F.sum("n").alias("n"), F.bit_or("bits").alias("failed"))
    marks = labels.groupBy(F.col(key).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return judged.join(marks, "doc_id", "left").groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - F.lit(ord(LETTERS[0])))


def steps(rows: DataFrame) -> DataFrame:
    """Each row once for every step of every order, with the bits of its own filter and the earlier ones."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    places = F.sequence(F.lit(1), F.lit(len(LETTERS)))
    earlier = F.aggregate(F.filter(places, lambda i: i < F.col("step")), F.lit(0),
                          lambda s, i: s + bit(F.substring("filter_order", i, F.lit(1))))
    return rows.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(places)).withColumns(
        {"own": bit(F.substring("filter_order", F.col("step"), F.lit(1))), "earlier": earlier})


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """Counts of every part at every step of every order of the filters."""
    parts = combinations(docs, labels, key, text, part).groupBy("part").agg(
        F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))  # at most 32

    def total(value: str, fits: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("sets", lambda x: fits(x["failed"])), F.lit(0).cast("long"),
                           lambda s, x: s + x[value])

    own, earlier = F.col("own"), F.col("earlier")
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) == 0)
    n_orders = len(list(permutations(LETTERS)))
    # of the filters that a row fails each is the first in as many orders
    share = F.aggregate(F.filter("sets", lambda x: x["failed"].bitwiseAND(own) != 0), F.lit(0).cast("long"),
                        lambda s, x: s + x["n"] * (F.lit(n_orders) / F.bit_count(x["failed"])).cast("long"))
    return steps(parts).select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"))


def audit_sql() -> str:
    """The audit of ``documents`` and ``labels`` with unique ids, in SQL."""
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(LETTERS))
    return rf"""
WITH f(letter, b) AS (VALUES {letters}),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
judged AS (
  SELECT d.doc_id, part, (CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(d.t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(d.t, '{SIGNS}') THEN 8 ELSE 0 END)
    + (CASE WHEN first < d.doc_id THEN 16 ELSE 0 END) AS failed
  FROM d JOIN firsts USING (t)),
sets AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic
  FROM judged LEFT JOIN labels l USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a JOIN f b ON b.b <> a.b JOIN f c ON c.b NOT IN (a.b, b.b) JOIN f d ON d.b NOT IN (a.b, b.b, c.b)
    JOIN f e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
steps AS (
  SELECT filter_order, step, f.b AS own,
    (SELECT coalesce(sum(g.b), 0)::BIGINT FROM f g WHERE strpos(filter_order, g.letter) < step) AS earlier
  FROM orders CROSS JOIN range(1, {len(LETTERS) + 1}) r(step) JOIN f ON f.letter = filter_order[step]),
x AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (failed & (own | earlier) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed & own <> 0 AND failed & earlier <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM sets CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM x"""
