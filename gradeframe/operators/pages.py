"""Recognised pages: pick a result per page, join pages, merge chunk outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import is_blank, real_word_count, strip


def _rank(engine: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in order]), engine)


def page_score(text: Column, confidence: Column) -> Column:
    """Weight of real words against recognition confidence."""
    return real_word_count(text) * fv.WORD_WEIGHT + confidence * fv.CONFIDENCE_WEIGHT


def choose_page_result(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One recognition result per page.

    The first authoritative engine with more than ten characters wins. Otherwise
    the best-scoring local result; the last-resort engine joins only when no other
    local result exists or all of them are below 0.4 confidence. Several results of
    one engine go by score, confidence and text, so row order never decides. One
    aggregation with partial merging, no window.
    """
    keys = list(keys)
    row = F.struct("engine", "text", "confidence", "_score")
    long_enough = F.length(strip(F.col("text"))) >= fv.PAGE_MIN_CHARS
    trusted = F.col("_authority") > 0
    last = F.col("engine") == fv.LAST_RESORT_ENGINE
    local = (F.col("_local") > 0) & ~last & long_enough
    best = F.struct("_score", -F.col("_local"), "confidence", "text")
    scored = results.withColumns({
        "_authority": _rank(F.col("engine"), fv.AUTHORITATIVE_ENGINES),
        "_local": _rank(F.col("engine"), fv.LOCAL_ENGINES),
        "_score": page_score(F.col("text"), F.col("confidence")),
    })
    picked = scored.groupBy(*keys).agg(
        F.max_by(row, F.when(trusted & long_enough, F.struct(-F.col("_authority"), "_score", "confidence", "text"))).alias("_trusted"),
        F.max_by(row, F.when(local, best)).alias("_best"),
        F.max(F.when(local, F.col("confidence"))).alias("_sure"),
        F.max_by(row, F.when(last & ~is_blank(F.col("text")), best)).alias("_last"),
    )
    use_last = F.col("_best").isNull() | (
        (F.col("_sure") < fv.LAST_RESORT_BELOW) & (F.col("_last._score") > F.col("_best._score"))
    )
    chosen = F.coalesce(
        F.col("_trusted"), F.when(use_last, F.col("_last")), F.col("_best")
    )
    return picked.select(*keys, chosen.alias("_c")).select(
        *keys,
        F.coalesce("_c.engine", F.lit("none")).alias("engine"),
        F.coalesce("_c.text", F.lit("")).alias("text"),
        F.coalesce("_c.confidence", F.lit(0.0)).alias("confidence"),
    )


def choose_config(results: DataFrame, keys: Sequence[str], order: str = "config_no") -> DataFrame:
    """Best of several settings by real words plus confidence; the earlier wins ties."""
    score = real_word_count(F.col("text")) + F.col("confidence")
    best = F.max_by(
        F.struct("text", "confidence", order),
        F.when(score > 0, F.struct(score.alias("s"), (-F.col(order)).alias("o"))),
    )
    return results.groupBy(*keys).agg(best.alias("_b")).select(
        *keys,
        F.coalesce("_b.text", F.lit("")).alias("text"),
        F.coalesce("_b.confidence", F.lit(0.0)).alias("confidence"),
        F.col(f"_b.{order}").alias(order),
    )


def join_pages(pages: DataFrame, key: str, page_no: str = "page_no") -> DataFrame:
    """Document text, mean confidence over all pages, engines in first-seen order."""
    ordered = F.array_sort(F.collect_list(F.struct(page_no, "engine", "text")))
    return (
        pages.groupBy(key)
        .agg(ordered.alias("_pages"), F.bround(F.avg("confidence"), 4).alias("confidence"))
        .select(
            key,
            F.array_join(
                F.transform(F.filter("_pages", lambda p: p["text"] != ""), lambda p: p["text"]),
                "\n\n",
            ).alias("text"),
            "confidence",
            F.array_join(
                F.array_distinct(F.transform("_pages", lambda p: p["engine"])), "+"
            ).alias("engine"),
        )
    )


def stitch_booklet(pages: DataFrame, key: str, page_no: str = "page_no",
                   skip_cover: bool = True) -> DataFrame:
    """Whole booklet text: numbered page headers, page-break separators, no cover.

    ``page_no`` counts from 0; the cover is page 0.
    """
    content = pages.filter(F.col(page_no) > 0) if skip_cover else pages
    number = F.col(page_no) + (1 if skip_cover else 2)
    page = F.concat(F.lit("[Page "), number.cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(page_no, page.alias("t"))))
    return content.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), f"\n\n{fv.PAGE_BREAK}\n\n").alias("text")
    )


def merge_chunks(rows: DataFrame, keys: Sequence[str], chunk: str = "chunk_no") -> DataFrame:
    """Join a question's answers across chunks, skipping text already present."""
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct(chunk, strip(F.col("answer_text")).alias("t")))),
        lambda p: p["t"],
    )

    def fold(text: Column, piece: Column) -> Column:
        return F.when((piece == "") | text.contains(piece), text).when(text == "", piece).otherwise(
            F.concat(text, F.lit("\n"), piece)
        )

    return rows.groupBy(*keys).agg(pieces.alias("_p")).select(
        *keys, F.aggregate("_p", F.lit(""), fold).alias("answer_text")
    )


def longest_answers(rows: DataFrame, keys: Sequence[str], chunk: str = "chunk_no") -> DataFrame:
    """Longest answer per question across overlapping chunks; the earlier wins ties."""
    rank = F.struct(F.length("answer_text").alias("n"), (-F.col(chunk)).alias("c"))
    return rows.groupBy(*keys).agg(F.max_by("answer_text", rank).alias("answer_text"))
