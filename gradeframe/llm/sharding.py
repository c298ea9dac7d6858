"""Sharding by extendible hashing.

A row's address is a string of bits: 60 of the md5 of its key, then 60 that differ
between rows with one key. The directory starts with one bucket; a bucket is split
on its next bit only while it is larger than the byte limit, so shards have prefixes
of different lengths and every shard fits, whatever the sizes or the keys. A single
row larger than the limit is a shard of its own.

Splits are found from sums by prefix: a round sums the rows by a prefix some bits
beyond the expected depth, rolls these sums up to each shorter prefix, and follows
the oversized ones. Rows below a prefix that is still oversized go to the next round
with more bits. Only the sums are aggregated; rows are not moved to one task.

Null keys count as the empty key and null texts as empty texts (0 bytes). Rows that
agree in every column differ in the last 60 bits, so a hot key is split as well;
which of them goes where is not defined, the sizes are. An empty table gives an
empty result. Extra columns pass through; one named like an output is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import staged, whole_text

SHARD_BYTES = 16 * 1024 * 1024
KEY_BITS = 60
ADDED = ("n_bytes", "address", "shard", "depth", "shard_bytes")


def addressed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add n_bytes and the bits of the address."""
    bits = lambda number: F.lpad(F.bin(number), KEY_BITS, "0")
    keyed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    own = F.md5(F.monotonically_increasing_id().cast("string"))
    first = lambda digest: F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    return docs.withColumns({
        "n_bytes": F.octet_length(whole_text(text)).cast("long"),
        "address": F.concat(bits(first(keyed)), bits(first(own))),
    })


def split_round(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, bool]:
    """Shards of each prefix of ``high`` bits: (leaf, depth, shard_bytes); whether some go deeper.

    ``depth`` counts the oversized prefixes from ``low`` bits on, so ``high + 1``
    marks a leaf that is oversized itself.
    """
    leaves = rows.groupBy(F.substring("address", 1, high).alias("leaf")).agg(
        F.sum("n_bytes").alias("leaf_bytes"), F.count(F.lit(1)).alias("leaf_rows"))
    paths = staged(leaves, "shard-leaves").select(
        "leaf", "leaf_bytes", "leaf_rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
    paths = paths.withColumn("prefix", F.expr("substring(leaf, 1, d)"))
    sums = paths.groupBy("prefix").agg(F.sum("leaf_bytes").alias("bytes"), F.sum("leaf_rows").alias("n"))
    sums = staged(sums, "shard-sums")
    over = (F.col("bytes") > limit) & (F.col("n") > 1)
    shards = (
        paths.select("leaf", "prefix", "d").join(sums, "prefix")
        .groupBy("leaf").agg(
            (F.lit(low) + F.sum(over.cast("int"))).cast("int").alias("depth"),
            F.max(F.when(~over, F.struct(-F.col("d"), F.col("bytes")))).alias("first"))
        .select("leaf", "depth", F.col("first.bytes").alias("shard_bytes"))
    )
    shards = staged(shards, "shard-directory")
    return shards, bool(shards.filter(F.col("depth") > high).take(1))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  limit_bytes: int = SHARD_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Add n_bytes, shard (its prefix of bits), depth and shard_bytes to every row.

    ``carry`` names the columns to return with them; all by default. To assign shards
    without moving texts, carry the key only.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    rows = addressed(docs, key, text).select(*kept, "n_bytes", "address")
    rows = staged(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, max(4, math.ceil(math.log2(max(1, total / limit_bytes))) + 4)
    done = []
    while True:
        shards, deeper = split_round(rows, low, high, limit_bytes)
        placed = rows.withColumn("leaf", F.substring("address", 1, high)).join(shards, "leaf")
        done.append(placed.filter(F.col("depth") <= high).select(
            *kept, "n_bytes", F.expr("substring(address, 1, depth)").alias("shard"), "depth", "shard_bytes"))
        if not deeper:
            return reduce(DataFrame.unionAll, done)
        if high >= 2 * KEY_BITS:
            raise ValueError(f"rows above the limit agree in all {high} bits; nothing tells them apart")
        rows = staged(placed.filter(F.col("depth") > high).select(*kept, "n_bytes", "address"), "shard-rows")
        low, high = high, min(2 * KEY_BITS, high + 8)


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write one folder for each shard; a shard's rows meet in one task, which its limit bounds."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def shards_sql(limit_bytes: int = SHARD_BYTES, bits: int = 14) -> str:
    """Shards of ``documents`` in SQL, for unique keys and directories of at most ``bits`` bits."""
    hexbits = "(CASE h " + " ".join(f"WHEN '{i:x}' THEN '{i:04b}'" for i in range(16)) + " END)"
    sums = ", ".join(f"sum(b) OVER (PARTITION BY a[1:{d}]) AS s{d}, count(*) OVER (PARTITION BY a[1:{d}]) AS c{d}"
                     for d in range(1, bits + 1))
    over = " + ".join(["(sum(b) OVER () > {0} AND count(*) OVER () > 1)::INT".format(limit_bytes)] +
                      [f"(s{d} > {limit_bytes} AND c{d} > 1)::INT" for d in range(1, bits + 1)])
    size = "CASE depth WHEN 0 THEN sum(b) OVER () " + " ".join(
        f"WHEN {d} THEN s{d}" for d in range(1, bits + 1)) + " END"
    return f"""
WITH addressed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b,
         array_to_string(list_transform(string_split(md5(coalesce(doc_id::VARCHAR, ''))[1:15], ''),
                                        lambda h: {hexbits}), '') AS a
  FROM documents
), sums AS (SELECT *, {sums} FROM addressed
), depths AS (SELECT *, {over} AS depth FROM sums)
SELECT doc_id, b::BIGINT AS n_bytes, a[1:depth] AS shard, depth::INT AS depth, ({size})::BIGINT AS shard_bytes
FROM depths"""
