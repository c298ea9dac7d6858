"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Statistics are counted on the bytes of many texts at once. The trees are fitted on the
driver on at most ``max_rows`` labelled documents, chosen by a hash of their key, and
travel as flat arrays; tasks walk all rows of a batch through a tree together. Scoring
is a scan: no shuffle, whatever the sizes or the sources.

Labels are joined by key; several labels of one key vote, and a tie counts as 1. Keys
without a label, null keys and null labels are scored but not learned from. Repeated
rows are scored alike; of a key with several texts the least is learned from. A very long
text is counted as a slice of its own. Null and empty texts have statistics of zero and get a score like any other. Without labels of
both kinds every text gets the share of label 1. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradeframe.llm import boosting
from gradeframe.llm.common import free_name
from gradeframe.llm.textbytes import slices, span_hashes, word_spans

MAX_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Kinds of bytes that are counted.
KINDS = {
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)), "capital": bytes(range(65, 91)), "digit": b"0123456789",
    "space": b" ", "line": b"\n", "stop": b".", "comma": b",;:", "mark": b"!?", "symbol": b"#*$%&|<>", "bar": b"|",
    "bracket": b"()[]{}", "quote": b"\"'", "path": b"/\\_=@~^+-", "control": bytes(range(9)) + bytes(range(14, 32)),
    "beyond": bytes(range(128, 256)), "lead": bytes(range(192, 256)),
}
TABLE = np.zeros((len(KINDS), 256), bool)
for _k, _bytes in enumerate(KINDS.values()):
    TABLE[_k, list(_bytes)] = True
MARK = np.zeros(256, bool)
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
STATISTICS = [*KINDS, "bytes", "words", "word_bytes", "distinct", "doubled", "long_words", "line_bytes", "closed_lines"]


def per_row(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``before``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[before[1:]] - sums[before[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    found = [np.zeros((0, len(STATISTICS)))]
    for _, data, offsets in slices(texts):
        size = np.maximum(np.diff(offsets), 1)
        counts = [per_row(row[data], offsets) for row in TABLE]
        start, end, before = word_spans(data, offsets)
        n_words = np.diff(before)
        words = np.maximum(n_words, 1)
        length = end - start
        row_of = np.repeat(np.arange(len(offsets) - 1), n_words)
        own = np.stack([row_of.astype(np.uint64), span_hashes(data, start, end)])
        order = np.lexsort(own[::-1])
        fresh = np.ones(len(start), np.int64)
        fresh[1:] = (own[:, order][:, 1:] != own[:, order][:, :-1]).any(axis=0)
        doubled = np.zeros(len(data), bool)
        if len(data) > 1:
            doubled[1:] = (data[1:] == data[:-1]) & MARK[data[1:]]
        lines = counts[list(KINDS).index("line")] + 1
        ended = np.zeros(len(data), bool)
        if len(data) > 1:
            ended[:-1] = (data[1:] == 10) & np.isin(data[:-1], list(b'.!?:;"'))
        found.append(np.stack([
            *[c / size for c in counts], np.log1p(np.diff(offsets)), np.log1p(n_words), per_row(length, before) / words,
            per_row(fresh, before) / words, per_row(doubled, offsets) / size, per_row(length > 14, before) / words,
            np.log1p(size / lines), per_row(ended, offsets) / lines], axis=1))
    return np.concatenate(found)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str,
                  max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled keys."""
    votes = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("share"))
    chosen = (
        votes.filter(learn).orderBy(F.xxhash64(key), key).limit(max_rows)
        .select(F.col(key).alias("chosen"), (F.col("share") >= 0.5).cast("double").alias("y"))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["y", "x"])

    # at most max_rows keys are broadcast, and as many rows come back: of a repeated key the least text counts
    joined = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("chosen")).groupBy("chosen").agg(
        F.first("y").alias("y"), F.min(text).alias("text")).select("y", "text")
    rows = joined.mapInArrow(count, "y double, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = rows.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # not the order in which tasks ended
    return x[order], y[order]


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
                    label: str = "quality", max_rows: int = MAX_ROWS, into: str = "score",
                    carry: list[str] | None = None) -> DataFrame:
    """Add ``into``: the probability that the label is 1. ``learn`` tells keys that may be learned from."""
    x, y = training_rows(docs, labels, learn, key, text, label, max_rows)
    trees = boosting.fit(x, y)
    carried = docs.columns if carry is None else carry
    read = free_name(docs, "scored_text")
    fields = [f for f in docs.select(*carried).schema if f.name != into]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            scores = trees.scores(statistics(batch.column(last)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(scores)], [*batch.schema.names[:last], into])

    return docs.select(*[f.name for f in fields], F.col(text).alias(read)).mapInArrow(
        score, StructType([*fields, StructField(into, DoubleType())]))


def held_out(key: str) -> Column:
    """The fold of a key that is not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
