"""Nearest-word correction against a vocabulary, without comparing all pairs.

Candidates come from an equi-join. An edit (insertion, deletion, replacement or swap of
neighbours) costs each of two words one letter, at most, of what their beginnings have in
common, also where it pushes a letter over the end of the beginning. So the first letters
of words within two edits share a string left after deleting at most two of them, and a
word has a bounded number of keys however long it is. Length and plain distance are
tested inside the join, so only near pairs leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import words


def letters_of(word: Column) -> Column:
    return F.regexp_replace(word, "[^a-zA-Z]", "")


def is_correctable(word: Column) -> Column:
    """Words with digits, in capitals, or of two letters or fewer are left alone."""
    bare = letters_of(word)
    return (F.length(bare) > 2) & ~word.rlike(r"(?U)\d") & bare.rlike("[a-z]")


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """Correctable words in lower case with how often they occur."""
    return (
        texts.select(F.explode(words(F.col(text))).alias("_w"))
        .filter(is_correctable(F.col("_w")))
        .groupBy(F.lower(letters_of(F.col("_w"))).alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(counts: DataFrame, one_in: int) -> DataFrame:
    """Words that are at least one in ``one_in`` of all counted words, plus the technical terms.

    A share keeps its meaning at every size; counts are compared as integers.
    """
    extra = counts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(w) for w in fv.TECHNICAL_WORDS])).alias("word"),
        F.lit(1).cast("long").alias("n"),
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return (
        counts.filter(F.col("n") * one_in >= total.scalar())
        .select("word", "n")
        .unionByName(extra)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _without_one(word: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )


def deletions(word: Column) -> Column:
    """The word and every string left after deleting one or two letters."""
    one = F.array_distinct(_without_one(word))
    two = F.flatten(F.transform(one, _without_one))
    return F.array_distinct(F.concat(F.array(word), one, two))


def swaps(word: Column) -> Column:
    """The word with each pair of neighbouring letters exchanged."""
    pairs = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    return F.transform(
        pairs,
        lambda i: F.concat(
            F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)),
            F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word)),
        ),
    )


def edit_rank(word: Column, other: Column, distance: Column) -> Column:
    """1 or 2 for words one or two edits apart (a swap is one edit), else null.

    ``distance`` is their plain edit distance. A swap costs two plain edits, so
    the swap tests are needed only at distances 2 to 4. Two swaps that are close
    together (rhcg, hrgc) can be three plain edits apart.
    """
    near = lambda a, b: F.levenshtein(a, b, 1) >= 0
    swap_and_edit = F.exists(swaps(word), lambda s: near(s, other)) | F.exists(
        swaps(other), lambda s: near(s, word)
    )
    two_swaps = F.arrays_overlap(swaps(word), swaps(other))
    return (
        F.when(distance <= 1, 1)
        .when(distance == 2, F.when(F.array_contains(swaps(word), other), 1).otherwise(2))
        .when(distance == 3, F.when(swap_and_edit | two_swaps, 2))
        .when(distance == 4, F.when(two_swaps, 2))
    )


#: Letters at the beginning of a word whose deletions are its keys.
PREFIX = 8


def candidate_pairs(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, correction, n, _d) for all words that can be within two edits: at most four plain ones."""
    keys = F.explode(deletions(F.substring("word", 1, PREFIX))).alias("_key")
    left = unknown.select("word", keys)
    right = vocab.select(F.col("word").alias("correction"), "n", keys)
    near = F.abs(F.length("word") - F.length("correction")) <= 2
    distance = F.levenshtein("word", "correction", MOST_PLAIN_EDITS)
    met = left.join(right, (left["_key"] == right["_key"]) & near & (distance >= 0))
    return met.select("word", "correction", "n").distinct().withColumn("_d", distance)


#: Two edits, swaps included, are at most so many insertions, deletions and replacements.
MOST_PLAIN_EDITS = 4


def corrections(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, correction)`` for unknown words that have a neighbour in the vocabulary.

    Fewest edits first, then the most frequent word, then alphabetical order.
    """
    unknown = counts.select("word").join(vocab.select("word"), "word", "left_anti")
    ranked = candidate_pairs(unknown, vocab).withColumn(
        "edits", edit_rank(F.col("word"), F.col("correction"), F.col("_d"))
    ).filter("edits is not null")
    return ranked.groupBy("word").agg(
        F.min_by("correction", F.struct("edits", -F.col("n"), "correction")).alias("correction")
    )


#: The most frequent words, which are looked up without a shuffle. Any other is at most
#: one in so many of all words looked up.
FREQUENT = 1000


def _wanted(text: str) -> Column:
    """The different correctable words of a text, in lower case."""
    every = words(F.coalesce(F.col(text), F.lit("")))
    return F.array_distinct(F.transform(F.filter(every, is_correctable), lambda w: F.lower(letters_of(w))))


def frequent_words(wanted: DataFrame, fixes: DataFrame) -> DataFrame:
    """(word, fix) of the FREQUENT words that most rows have; fix is null where there is none.

    Counts are merged before the shuffle.
    """
    top = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "word").limit(FREQUENT)
    found = top.join(fixes.select("word", F.col("correction").alias("fix")), "word", "left").select("word", "fix").collect()
    return wanted.sparkSession.createDataFrame([tuple(r) for r in found], "word string, fix string")  # FREQUENT rows


def rare_words(wanted: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of words that are not frequent: what has to be shuffled."""
    return wanted.join(F.broadcast(frequent), "word", "left_anti")


def correct_texts(
    texts: DataFrame, keys: Sequence[str], text: str, fixes: DataFrame
) -> DataFrame:
    """Apply corrections word by word, keeping the initial capital and punctuation.

    Words are split on white space and joined by single blanks. Only the distinct
    correctable words of a text meet the corrections: frequent ones a bounded list that
    every task has, the others in a shuffle by word. What is found comes back as one
    map for the text and is applied inside its row.
    """
    keys = list(keys)
    every = words(F.coalesce(F.col(text), F.lit("")))
    wanted = texts.select(*keys, F.explode(_wanted(text)).alias("word"))
    frequent = frequent_words(wanted, fixes)
    common = wanted.join(F.broadcast(frequent.filter("fix is not null")), "word").select(*keys, "word", F.col("fix").alias("correction"))
    met = common.unionByName(rare_words(wanted, frequent).join(fixes.select("word", "correction"), "word").select(
        *keys, "word", "correction"))
    found = met.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("_fixes"))

    def fixed(w: Column) -> Column:
        bare, plain = letters_of(w), F.lower(letters_of(w))
        new = F.when(is_correctable(w), F.get(F.transform(F.array(plain), lambda k: F.col("_fixes")[k]), F.lit(0)))
        cased = F.when(bare.rlike("^[A-Z]"), F.initcap(new)).otherwise(new)
        return F.when(new.isNull(), w).otherwise(F.replace(w, bare, cased))

    # null-safe: a row without a key has its corrections too
    at = found.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "_fixes")
    same = [texts[k].eqNullSafe(at[f"_at_{k}"]) for k in keys]
    joined = texts.select(*keys, text).join(at, same, "left")
    # a text without fixes keeps its words
    return joined.select(*keys, F.when(F.col("_fixes").isNull(), F.array_join(every, " ")).otherwise(
        F.array_join(F.transform(every, fixed), " ")).alias(text))
