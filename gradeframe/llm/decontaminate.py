"""Benchmark decontamination: a prefix-filtered join of shingle sets with exact verification.

A benchmark item is cut into windows of ten consecutive words (one window of all its
words if it has fewer). As a set, a window holds the shingles of five words (or its
only one) and a document that contains the window contains them all, so the needed
overlap is the whole set and the prefix that must meet has one token: the window's
rarest shingle, by its count over all documents. Documents emit a row only where such
a shingle stands, with the words around it. The rows meet the windows on the shingle,
its offset in the window fixes where the window would start (position bound), the
start and the number of words must lie in the document (length bound), and then the
words are compared one by one.

Documents are read twice, for the counts and for the join; what both emit follows the
matches, not the input. A bitmap of the shingles goes to the tasks. Its size is
bounded by ``block_shingles``: larger benchmarks are taken in several blocks. The
join is a plain one on the shingle, whose hot partitions Spark splits; sums are merged
before the shuffle.

Null and empty texts have no words: such documents are clean and such items are never
found. An item without an id goes by the empty string. Rows are told apart by a number
of their own, so repeated keys or rows are each judged. Empty tables give empty
results or clean documents. Extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from gradeframe.llm.common import free_name, staged
from gradeframe.llm.textbytes import LOWER, shingle_hashes, slices, span_hashes, word_spans

WINDOW, SHINGLE = 10, 5
BLOCK_SHINGLES = 4_000_000
BITS_PER_SHINGLE = 64


def spoken(data: np.ndarray, start: int, end: int) -> str:
    return LOWER[data[start:end]].tobytes().decode("utf-8", "replace")


def item_windows(benchmark: DataFrame, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item_id, words, hashes): the windows of each item and the shingles of each window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for first, data, offsets in slices(batch.column(1)):
                start, end, before = word_spans(data, offsets)
                hashes = span_hashes(data, start, end)
                for i in range(len(offsets) - 1):
                    low, high = before[i], before[i + 1]
                    n = min(window, high - low)
                    k = min(shingle, n)
                    if n:
                        own = shingle_hashes(hashes[low:high], k).view(np.int64).tolist()
                        words = [spoken(data, start[w], end[w]) for w in range(low, high)]
                        rows += [(ids[first + i], words[w:w + n], own[w:w + n - k + 1])
                                 for w in range(high - low - n + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item_id", "words", "hashes"])

    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    return source.mapInArrow(cut, "item_id string, words array<string>, hashes array<long>")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Marks the low bits of the hashes; about one of 64 bits is set."""
    bits = 1 << max(16, int(np.ceil(np.log2(max(1, len(hashes)) * BITS_PER_SHINGLE))))
    marks = np.zeros(bits, bool)
    marks[(hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 != 0


def places(data, offsets, bits, sizes):
    """(row, words before the row, starts, ends, k, word index, hash) of marked shingles, by k."""
    start, end, before = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    for k in sizes:
        hashes = shingle_hashes(words, k)
        found = np.flatnonzero(marked(bits, hashes)) if len(hashes) else np.zeros(0, np.int64)
        found = found[row_of[found] == row_of[found + k - 1]]
        yield start, end, before, row_of, k, found, hashes[found]


def shingle_counts(docs: DataFrame, text: str, bits, sizes) -> DataFrame:
    """(h, n): how often each marked shingle stands in the documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[-1] for _, data, offsets in slices(batch.column(0))
                     for x in places(data, offsets, bits.value, sizes)]
            h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = docs.select(text).mapInArrow(count, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n"))


def shingle_places(docs: DataFrame, text: str, bits, sizes, window: int) -> tuple[DataFrame, dict[str, str]]:
    """(row, n_words, places) for each row; places: (h, k, at, words from ``at - window + k`` on, first)."""
    place = pa.struct([("h", pa.int64()), ("k", pa.int32()), ("at", pa.int32()), ("first", pa.int32()),
                       ("words", pa.list_(pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for first, data, offsets in slices(batch.column(batch.num_columns - 1)):
                for start, end, before, row_of, k, at, hashes in places(data, offsets, bits.value, sizes):
                    n_words[first:first + len(offsets) - 1] = np.diff(before)
                    for w, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        r = row_of[w]
                        low = max(before[r], w - (window - k)) if k == SHINGLE else w
                        high = min(before[r + 1], w + window) if k == SHINGLE else w + k
                        found[first + r].append({
                            "h": h, "k": k, "at": int(w - before[r]), "first": int(low - before[r]),
                            "words": [spoken(data, start[x], end[x]) for x in range(low, high)]})
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.arange(row, row + batch.num_rows)), pa.array(n_words), pa.array(found, pa.list_(place))],
                [*batch.schema.names[:-1], names["row"], names["n_words"], names["places"]])
            row += batch.num_rows

    names = {n: free_name(docs, n) for n in ("row", "n_words", "places")}
    scanned = free_name(docs, "scanned")
    schema = StructType([*docs.schema.fields, StructField(names["row"], LongType()), StructField(names["n_words"], LongType()),
                         StructField(names["places"], DataType.fromDDL("array<struct<h:long,k:int,at:int,first:int,words:array<string>>>"))])
    return docs.withColumn(scanned, F.col(text)).mapInArrow(find, schema), names


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text", window: int = WINDOW, into: str = "overlap",
          carry: list[str] | None = None, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Add the struct ``into`` (n_words, n_hit, item_ids) to every row.

    ``carry`` names the columns to return beside it; all by default.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, item, item_text, window, SHINGLE)
    windows = staged(windows.groupBy("words", "hashes").agg(F.collect_set("item_id").alias("items")), "windows")
    total = windows.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    blocks = -(-max(1, total) // block_shingles)
    carried = docs.columns if carry is None else carry
    hits, rows, number = [], None, None
    if blocks > 1:  # every block has to number the rows alike, whatever order a scan gives them in
        number = free_name(docs, "number")
        docs = staged(docs.select(*dict.fromkeys([*carried, text]), F.monotonically_increasing_id().alias(number)), "numbered")
    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        shingles = part.select("words", F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), F.posexplode("hashes").alias("offset", "h"))
        sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())

        def marks(of: DataFrame):
            """Broadcast bitmap; a block has at most about ``block_shingles`` of them."""
            got = np.fromiter((r[0] for r in of.select("h").distinct().toLocalIterator()), np.int64)
            return spark.sparkContext.broadcast(bitmap(got))

        counts = shingle_counts(docs, text, marks(shingles), sizes)
        rarest = (
            shingles.join(counts, "h", "left").groupBy("words")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "h", "offset", "k")).alias("x"))
            .select("words", "x.h", "x.offset", "x.k")
        )
        anchors = staged(rarest.join(part.select("words", "items"), "words"), "anchors")
        found, names = shingle_places(docs, text, marks(anchors), sizes, window)
        if number:
            found, names = found.drop(names["row"]), names | {"row": number}
        keep = [*(carried if rows is None else []), names["row"], names["n_words"], names["places"]]
        found = staged(found.select(*keep), "places")
        rows = found.drop(names["places"]) if rows is None else rows
        place = found.select(F.col(names["row"]).alias("row"), F.col(names["n_words"]).alias("n_words"),
                             F.explode(names["places"]).alias("p")).select("row", "n_words", "p.*")
        start = F.col("at") - F.col("offset")
        hits.append(
            place.join(anchors.withColumnRenamed("words", "window"), ["h", "k"])
            .filter((start >= F.col("first")) & (start + F.size("window") <= F.col("n_words")))
            .filter(F.expr("slice(words, at - offset - first + 1, size(window)) = window"))
            .select("row", start.alias("start"), F.size("window").alias("n"), "items"))
    overlaps = reduce(DataFrame.unionAll, hits)
    spans = overlaps.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(
            F.greatest(a["to"], s["start"] + s["n"]).alias("to"),
            (a["sum"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["to"], s["start"]))).alias("sum")),
        lambda a: a["sum"])
    row = names["row"]
    spans = spans.select(F.col("row").alias(row), covered.alias(row + "hit"), F.col("item_ids").alias(row + "items"))
    return rows.join(spans.hint("shuffle_hash"), row, "left").select(*carried, F.struct(
        F.col(names["n_words"]).alias("n_words"), F.coalesce(F.col(row + "hit"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.col(row + "items"), F.array().cast("array<string>")).alias("item_ids")).alias(into))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    into = free_name(docs, "overlap")
    return match(docs, benchmark, text, into=into).filter(F.col(f"{into}.n_hit") == 0).select(*docs.columns)


def contamination_sql() -> str:
    """The digest of the query over ``documents`` and ``benchmark`` with unique ids, in SQL."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents
), b AS (SELECT item_id, {words} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, n, i, item_id FROM places JOIN windows USING (n, s)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
