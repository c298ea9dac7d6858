"""Joins that survive a hot key without relying on run-time statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def salted_left_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    buckets: int = 16,
) -> DataFrame:
    """Left join whose hot keys are spread over ``buckets`` tasks.

    Each fact row gets a bucket from ``spread_by``; every lookup row is repeated
    once per bucket. Meant for lookups that are unique per key and small next to
    the facts. The result is that of a plain left join.

    The copies come from a join with the bucket numbers, not from ``explode``, whose
    size estimate stays that of the rows before it: a lookup just small enough to be
    broadcast would be collected ``buckets`` times over.
    """
    salted = facts.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int")
    )
    numbers = lookup.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    copies = lookup.crossJoin(F.broadcast(numbers))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def optional_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, spread_by: Sequence[str], buckets: int = 1024
) -> DataFrame:
    """Left join on a key that is often null.

    Null keys never match but would all be sent to one task; a second join column
    that is 0 for real keys spreads them. The result is that of a plain left join.
    The lookup's 0 is computed from its key: a plain constant would be folded into a test
    on the facts' side, and rows would be dealt by the key alone.
    """
    salt = F.when(
        F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int")
    ).otherwise(F.lit(0))
    spread = facts.withColumn("_null_salt", salt)
    return spread.join(
        lookup.withColumn("_null_salt", F.pmod(F.xxhash64(key), F.lit(1)).cast("int")), [key, "_null_salt"], "left"
    ).drop("_null_salt")


def split_lookup(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is often null, for facts that are cheap to scan twice.

    Rows without a key are not shuffled, and a lookup that is already dealt by the key
    is not dealt again. The result is that of a plain left join.
    """
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name != key]
    keyed = facts.filter(F.col(key).isNotNull()).join(lookup, key, "left")
    return keyed.unionByName(facts.filter(F.col(key).isNull()).select(*facts.columns, *rest))
