"""Removal of every byte in a 200-byte string that starts more than once, by suffix arrays.

A suffix array of the whole corpus does not fit one task, so equal strings are brought
together first. The smallest hashed 32-byte string of a 200-byte window is its anchor
(equal windows have equal anchors), and consecutive windows with one anchor form a
stretch. Counts by anchor settle most of the input: an anchor that occurs once is
unique, and if all stretches of an anchor are equal, all their windows repeat. What is
left are stretches that share an anchor but differ, at the edges of repeats. Their
distinct texts, once each, are cut in two parts that know 116 bytes around the anchor.
Parts whose known bytes occur once are dropped, the others go to shards by those bytes.

In a shard the parts' texts form one string, its suffix array is built by induced
sorting, and the permuted common prefixes tell the starts that share 200 bytes with
another. Known bytes shared by more parts than ``hot_parts`` would make a large shard;
the windows of such parts are counted one by one over all tasks, which is as exact.

Positions are bytes of UTF-8, in the input, not in what is left. Rows that agree in key
and text repeat each other and lose the same bytes. Null texts count as empty, texts
under 200 bytes lose nothing, texts above ``BLOCK`` are taken in overlapping blocks, empty
tables give empty results, and extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gradeframe.llm.common import free_name, staged, whole_text
from gradeframe.llm.line_dedup import text_key
from gradeframe.llm.suffixes import common_prefixes, suffix_array
from gradeframe.llm.textbytes import BYTE_VALUE, mix, powers, slices

LENGTH, GRAM, SIDE = 200, 32, 84
#: Positions of a text are taken in blocks of this many bytes, which a place has the bits for.
BLOCK, PLACE_BITS = 1 << 23, np.uint64(24)
SHARD_BYTES, HOT_PARTS = 1 << 20, 4096
SHARDS_PER_TASK = 16
SEPARATOR = 0


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:-1], out=sums[1:])
    n = len(data) - GRAM + 1
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray):
    """(row, start, windows, place of the anchor from the start, anchor, content) of each stretch."""
    import xxhash

    found = []
    raw = data.tobytes()
    for base in range(0, max(1, len(data)), BLOCK):  # one block, unless a single text is longer
        part = data[base:base + BLOCK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        grams = gram_hashes(part)
        place = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
        least = smallest((grams & ~place) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
        anchor = (least & place).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(base, base + len(anchor)), "right") - 1
        inside = np.arange(base, base + len(anchor)) + LENGTH <= offsets[row + 1]
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        start = np.flatnonzero(inside & change)
        stop = np.ones(len(anchor), bool)
        stop[:-1] = change[1:] | ~inside[1:]
        end = np.flatnonzero(inside & stop)
        content = np.array([xxhash.xxh3_64_intdigest(raw[base + a:base + b + LENGTH])
                            for a, b in zip(start.tolist(), end.tolist())], np.uint64)
        found.append((row[start], base + start - offsets[row[start]], end - start + 1, anchor[start] - start,
                      grams[anchor[start]], content))
    if not found:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*found)]


def all_stretches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t, a, n, p, g, c): start, windows, anchor's place, anchor and content of every stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(2)):
                row, a, n, p, g, c = stretches(data, offsets)
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(a), pa.array(n.astype(np.int16)),
                    pa.array(p.astype(np.int16)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))],
                    ["key", "t", "a", "n", "p", "g", "c"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_key(text).alias("t"), whole_text(text)).mapInArrow(
        run, f"key {kind}, t long, a long, n short, p short, g long, c long")


def known(data: bytes) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(data))))


def parts_of(stretch: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(g, c, at, k, bytes): both parts of each stretch; ``at`` windows of the stretch come before it."""
    wanted = stretch.groupBy("key", "t").agg(F.collect_list(F.struct("a", "n", "p", "g", "c")).alias("xs"))
    source = docs.select(F.col(key).alias("dk"), text_key(text).alias("dt"), whole_text(text).cast("binary").alias("b"))
    rows = source.join(wanted.hint("shuffle_hash"), F.col("dk").eqNullSafe(F.col("key")) & (F.col("dt") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, xs in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                for x in xs.as_py():
                    a, b, p = x["a"], x["a"] + x["n"] - 1, x["a"] + x["p"]
                    for side, low, high in ((b"<", a, min(b, p - SIDE)), (b">", max(a, p - SIDE + 1), b)):
                        if low <= high:
                            told = data[p - SIDE:p + GRAM] if side == b"<" else data[p:p + LENGTH - SIDE + 1]
                            out.append((x["g"], x["c"], low - a, known(side + told), data[low:high + LENGTH]))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int64()),
                    pa.array([r[4] for r in out], pa.binary())], ["g", "c", "at", "k", "bytes"])

    # rows that agree in key and text hold the same stretches: each is wanted once
    return rows.select("b", "xs").mapInArrow(run, "g long, c long, at int, k long, bytes binary").dropDuplicates(["g", "c", "at"])


RUNS = "g long, c long, low int, high int"


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last position of each run of marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def shard_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of one shard's parts that share LENGTH bytes with another window there."""
    rows = rows.sort_values(["k", "g", "c", "at"], ignore_index=True)
    size = rows["bytes"].str.len().to_numpy()
    text = np.full(int(size.sum()) + len(rows), SEPARATOR, np.uint16)
    starts = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    for at, data in zip(starts, rows["bytes"]):
        text[at:at + len(data)] = np.frombuffer(data, np.uint8)
        text[at:at + len(data)] += 1
    prefix, before = common_prefixes(text, suffix_array(text, 257))
    # a window never reaches a separator; strings across one are left out
    inside = np.zeros(len(text), bool)
    for at, n in zip(starts, size):
        inside[at:at + n - LENGTH + 1] = True
    same = np.flatnonzero((prefix >= LENGTH) & inside)
    repeated = np.zeros(len(text), bool)
    repeated[same] = repeated[before[same]] = True
    out = [(g, c, at + low, at + high) for g, c, at, start, n in zip(rows["g"], rows["c"], rows["at"], starts, size)
           for low, high in runs(repeated[start:start + n - LENGTH + 1])]
    return pd.DataFrame(out, columns=["g", "c", "low", "high"])


def counted_runs(parts: DataFrame) -> DataFrame:
    """The same for parts in any number: each window is counted by a 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for g, c, at, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                out += [(g, c, at + i, xxhash.xxh3_128_digest(data[i:i + LENGTH])) for i in range(len(data) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary())], ["g", "c", "at", "h"])

    windows = staged(parts.select("g", "c", "at", "bytes").mapInArrow(run, "g long, c long, at int, h binary"), "windows")
    twice = staged(windows.groupBy("h").count().filter("count > 1").select("h"), "repeated-windows")
    return windows.join(twice, "h").select("g", "c", F.col("at").alias("low"), F.col("at").alias("high"))


def repeated_spans(docs: DataFrame, key: str, text: str, shard_bytes: int = SHARD_BYTES,
                   hot_parts: int = HOT_PARTS) -> DataFrame:
    """(key, t, spans): sorted disjoint spans (s, e) of the bytes to remove."""
    found = all_stretches(docs, key, text)
    anchors = found.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"))
    anchors = staged(anchors.filter("m > 1").select("g", (F.col("low") == F.col("high")).alias("alike")), "anchors")
    found = staged(found.join(anchors, "g"), "stretches")

    contents = found.filter(~F.col("alike")).groupBy("g", "c").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "t", "a", "n", "p")).alias("x"))
    contents = staged(contents.select("g", "c", "m", "x.*"), "contents")
    parts = staged(parts_of(contents.drop("m"), docs, key, text), "parts")
    keys = staged(parts.groupBy("k").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("bytes")).alias("size")).filter("parts > 1"), "parts-by-key")
    met = staged(parts.join(keys.select("k", "parts"), "k"), "met-parts")
    total = keys.filter(F.col("parts") <= hot_parts).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = 1 + total // shard_bytes
    # small in bytes but not in work: a fixed number of partitions is not merged at run time
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_PER_TASK))
    some = met.filter(F.col("parts") <= hot_parts).withColumn("shard", F.pmod("k", F.lit(shards))).repartition(int(tasks), "shard")
    some = some.groupBy("shard").applyInPandas(shard_runs, RUNS)
    partly = some.unionByName(counted_runs(met.filter(F.col("parts") > hot_parts)))
    whole = contents.filter("m > 1").select("g", "c", F.lit(0).alias("low"), (F.col("n") - 1).cast("int").alias("high"))
    # a stretch that occurs twice repeats as a whole, whatever else its parts share
    result = staged(partly.unionByName(whole), "runs")
    edges = found.filter(~F.col("alike")).join(result, ["g", "c"]).select(
        "key", "t", (F.col("a") + F.col("low")).alias("s"), (F.col("a") + F.col("high") + LENGTH).alias("e"))
    inner = found.filter("alike").select("key", "t", F.col("a").alias("s"), (F.col("a") + F.col("n") - 1 + LENGTH).alias("e"))
    spans = edges.unionByName(inner).groupBy("key", "t").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "repeats",
                   carry: list[str] | None = None, **sizes: int) -> DataFrame:
    """Add the struct ``into``: n_bytes, n_removed, spans (s, e) and the bytes that are kept.

    The kept bytes are binary: a cut may fall inside a character. ``carry`` names the
    columns to return beside the struct; all by default.
    """
    spans = repeated_spans(docs, key, text, **sizes)
    carried = docs.columns if carry is None else carry
    k, t, s = (free_name(docs, n) for n in ("repeats_key", "repeats_text", "repeats_spans"))
    found = spans.select(F.col("key").alias(k), F.col("t").alias(t), F.col("spans").alias(s))
    rows = docs.withColumn(t + "d", text_key(text)).join(
        found.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(k)) & (F.col(t + "d") == F.col(t)), "left")
    rows = rows.select(*carried, F.col(s).alias(s), whole_text(text).cast("binary").alias(t))
    span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
    result = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, out = batch.num_columns - 1, []
            for xs, data in zip(batch.column(last - 1), batch.column(last)):
                data, merged = data.as_py(), []
                for x in xs.as_py() or ():
                    if merged and x["s"] <= merged[-1]["e"]:
                        merged[-1]["e"] = max(merged[-1]["e"], x["e"])
                    else:
                        merged.append({"s": x["s"], "e": x["e"]})
                edges = [0, *[v for m in merged for v in (m["s"], m["e"])], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append({"n_bytes": len(data), "n_removed": len(data) - len(kept), "spans": merged, "kept": kept})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last - 1], pa.array(out, result)], [*batch.schema.names[:last - 1], into])

    spans_type = rows.schema[s].dataType
    schema = StructType([*rows.schema.fields[:-2], StructField(into, StructType([
        StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
        StructField("spans", spans_type), StructField("kept", BinaryType())]))])
    return rows.mapInArrow(run, schema)


def repeats_sql() -> str:
    """The digest of the query over ``documents`` with unique ids, every window by itself, in SQL."""
    return f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, b, substr(h, 1000 * b + 1, {2 * (500 + LENGTH - 1)}) AS p
  FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 1000 + 1)::BIGINT)) AS b FROM h)
), windows AS (
  SELECT doc_id, 500 * b + j AS i, md5(substr(p, 2 * j + 1, {2 * LENGTH})) AS s
  FROM (SELECT doc_id, b, p, unnest(range(0, least(500, len(p) // 2 - {LENGTH - 1})::BIGINT)) AS j FROM blocks)
), hits AS (
  SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
), edges AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hits
), islands AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM edges
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + {LENGTH} AS e FROM islands GROUP BY doc_id, island
), gaps AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k,
         sum(e - s) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)"""
