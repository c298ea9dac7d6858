"""Removal of repeated passages by windows of three lines, in DataFrame functions only.

A window is three consecutive lines that hold more than white space. Windows are
compared over the whole table by two 64-bit hashes of their lines. The first
occurrence of a window, by document and then by position, stays; the lines that any
later occurrence covers go. Overlapping windows merge because lines are removed as a
set of positions. Blank lines stay where they are.

Documents are ordered by their key, null first, then by a hash of their text. Rows
that agree in key and text count as one document, so they keep or lose the same
lines. Null texts stay null, texts of fewer than three such lines stay whole, an
empty table gives an empty result, and extra columns pass through.

Counting windows is a sum that is merged before the shuffle. Only windows that occur
more than once are joined back; they are written first, so both sides of that join
are plain exchanges, whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import free_name, let, staged, whole_text

def text_key(text: str) -> Column:
    """Tells apart texts under one key; null and empty differ."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each window: (key, t, a, b, at) with the positions of its lines in ``at``."""
    lines = F.split(whole_text(text), "\n")
    spoken = let(lines, lambda ls: F.filter(
        F.transform(ls, lambda x, i: F.struct(F.rtrim(x).alias("x"), i.alias("i"))), lambda s: s["x"].rlike("[^ \\t-\\r]")))
    at = lambda s, i, k: F.get(s, i + k)
    made = let(spoken, lambda s: F.when(F.size(s) >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(s) - 3, F.lit(0))), lambda i: F.struct(
            F.xxhash64(*[at(s, i, k)["x"] for k in range(3)]).alias("a"),
            F.xxhash64(F.lit("second"), *[at(s, i, k)["x"] for k in (2, 0, 1)]).alias("b"),
            F.array(*[at(s, i, k)["i"] for k in range(3)]).alias("at")))))
    return docs.select(F.col(key).alias("key"), text_key(text).alias("t"), F.explode(made).alias("w")).select(
        "key", "t", "w.*")


def removed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t, removed): sorted positions of the lines that later occurrences cover."""
    found = windows(docs, key, text)
    place = F.struct("key", "t", F.col("at")[0].alias("line"))
    counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    repeated = staged(counted.filter("n > 1").select("a", "b", "first"), "line-windows")
    later = found.join(repeated, ["a", "b"]).filter(place > F.col("first"))
    return later.select("key", "t", F.explode("at").alias("line")).groupBy("key", "t").agg(
        F.sort_array(F.collect_set("line")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                        into: str | None = None) -> DataFrame:
    """``docs`` with texts that have lost their repeated passages.

    ``into`` names a struct to add, with n_lines and n_removed.
    """
    removed = removed_lines(docs, key, text)
    t, gone = free_name(docs, "text_key"), free_name(docs, "removed_lines")
    found = removed.select(F.col("key").alias(gone + "k"), F.col("t").alias(t + "t"), F.col("removed").alias(gone))
    joined = docs.withColumn(t, text_key(text)).join(
        found.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(gone + "k")) & (F.col(t) == F.col(t + "t")), "left")
    lines = F.split(F.col(text), "\n")
    left = let(lines, lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i)), "\n"))
    out = [F.when(F.col(gone).isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(c)
           for c in docs.columns]
    if into:
        n_lines = F.when(F.length(whole_text(text)) > 0, F.size(lines)).otherwise(0)
        out.append(F.struct(n_lines.cast("long").alias("n_lines"),
                            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")).alias(into))
    return joined.select(*out)


def dedup_sql() -> str:
    """doc_id, n_lines, n_removed and the digest of the kept text, over ``documents`` with unique doc_id."""
    return """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), spoken AS (
  SELECT doc_id, rtrim(x, ' ') AS x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM lines WHERE regexp_matches(x, '[^ \t-\r]')
), three AS (
  SELECT a.doc_id, a.i AS i0, b.i AS i1, c.i AS i2, a.x || chr(10) || b.x || chr(10) || c.x AS w
  FROM spoken a JOIN spoken b ON a.doc_id = b.doc_id AND b.r = a.r + 1
  JOIN spoken c ON a.doc_id = c.doc_id AND c.r = a.r + 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i0) AS n FROM three
), gone AS (
  SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM ranked WHERE n > 1
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept,
         count(g.i) AS n_removed, count(*) AS n
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n END::BIGINT AS n_lines,
       coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""
