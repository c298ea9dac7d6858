"""Character and word error rates of recognised text against references."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import words


#: Bytes that the bits of a pair's symbols may take all at once; beyond, only of frequent ones.
MOST_MASKS = 1 << 26


def _edits():
    """A function over two columns of texts, or of word lists: their distance in characters or words.

    Each symbol of the reference is one bit; a symbol of the hypothesis updates the column
    of all bits at once, as differences between neighbouring cells, so a pair costs one
    step a symbol on numbers as long as the reference. Any two symbols differ or not, so
    there is no bound on how many there are, and common ends cost next to nothing.
    Spark's own distance goes cell by cell and knows no word lists.
    """
    def distance(a, b) -> int:
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[head:], b[head:]
        tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
        a, b = a[:len(a) - tail], b[:len(b) - tail]
        if not a or not b:
            return len(a) + len(b)
        places: dict = {}
        for i, symbol in enumerate(a):
            places.setdefault(symbol, []).append(i)

        def mask(at: list[int]) -> int:
            bits = bytearray(at[-1] // 8 + 1)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            return int.from_bytes(bits, "little")

        # few symbols, or those in more than the root of all places: their bits are kept
        often = 0 if len(places) * len(a) <= 8 * MOST_MASKS else len(a) ** 0.5
        kept = {symbol: mask(at) for symbol, at in places.items() if len(at) > often}
        every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
        up, down, edits = every, 0, len(a)
        for symbol in b:
            same = kept.get(symbol)
            if same is None:
                same = mask(places[symbol]) if symbol in places else 0
            level = (((same & up) + up) ^ up) | same | down
            rise, fall = down | (every & ~(level | up)), up & level
            edits += bool(rise & last) - bool(fall & last)
            rise, fall = ((rise << 1) | 1) & every, (fall << 1) & every
            up, down = fall | (every & ~(level | rise)), rise & level
        return edits

    def measure(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        whole = lambda x: x if isinstance(x, str) else list(x)
        return pd.Series([None if a is None or b is None else distance(whole(a), whole(b))
                          for a, b in zip(reference, hypothesis)], dtype="Int64")

    return F.pandas_udf(measure, "long")


def with_character_edits(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add ``character_edits`` and ``reference_characters``; null where a text is null."""
    return pairs.select(
        *pairs.columns, _edits()(reference, hypothesis).alias("character_edits"),
        F.length(reference).alias("reference_characters"))


def with_word_edits(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add ``word_edits`` and ``reference_words``: word-level distance and length."""
    carried = pairs.columns
    split = pairs.select(
        *carried, words(F.col(reference)).alias("_r"), words(F.col(hypothesis)).alias("_h")
    )
    return split.select(
        *carried, F.size("_r").alias("reference_words"), _edits()("_r", "_h").alias("word_edits")
    )


def error_rates(
    pairs: DataFrame, reference: str, hypothesis: str, by: Sequence[str] = ()
) -> DataFrame:
    """Corpus-level character and word error rates: summed edits over summed lengths.

    Pairs with a null text count as samples and are in neither sum of ``wer``.
    """
    measured = with_character_edits(
        with_word_edits(pairs.select(*by, reference, hypothesis), reference, hypothesis), reference, hypothesis)
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.try_divide(F.sum("character_edits"), F.sum("reference_characters")).alias("cer"),
        F.try_divide(F.sum("word_edits"), F.sum(F.when(F.col("word_edits").isNotNull(), F.col("reference_words")))).alias("wer"),
    )


def character_error_rate(
    pairs: DataFrame, reference: str, hypothesis: str, by: Sequence[str] = ()
) -> DataFrame:
    measured = with_character_edits(pairs.select(*by, reference, hypothesis), reference, hypothesis)
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("character_edits").alias("edits"),
        F.sum("reference_characters").alias("characters"),
        F.try_divide(F.sum("character_edits"), F.sum("reference_characters")).alias("cer"),
    )


def _tier(value: Column, tiers, last: str) -> Column:
    chain = None
    for bound, name in tiers:
        chain = F.when(value < bound, name) if chain is None else chain.when(value < bound, name)
    return chain.otherwise(last)


def quality_tier(cer: Column) -> Column:
    return _tier(cer, fv.CER_TIERS, "poor")


def size_tier(total: Column) -> Column:
    return _tier(total, fv.SIZE_TIERS, "large")


def split_sizes(labels: DataFrame, split: str = "split") -> DataFrame:
    """Samples per split."""
    return labels.groupBy(split).agg(F.count(F.lit(1)).alias("n_samples"))
