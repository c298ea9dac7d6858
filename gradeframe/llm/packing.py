"""Packing of documents into training sequences by harmonic classes.

A piece of length r belongs to class k = capacity // r, and k pieces of class k always
fit one sequence, so a bin is full when it has k pieces, whatever they are: no search,
no state beyond a counter for each class. A document is cut into whole sequences; its
rest becomes one piece if that nearly fills a slot of its class (``capacity // k``),
else a piece as long as the slots of the next class, and so on with what is left. So
padding is a small part of each slot.

Every task fills the bins of its own documents. Pieces in bins that a task leaves
unfinished are numbered through over all tasks, from counts by class and task, and
fill bins of their class again. At most k - 1 pieces of each class are left then: a
number that capacity alone bounds, not the input. They are packed in one small group,
longest first into the fullest sequence with room.

Null and empty texts have only the end token. A very long text is encoded as a whole and
cut into as many pieces as it takes. Repeated ids or rows are packed each on
its own, an empty table gives an empty result, and columns beyond the id and the text
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeframe.llm.common import staged

CAPACITY, END = 2048, 1
#: A slot may stay empty by this share of its length, or by two tokens.
SLACK = 1 / 64
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LONG_RUN = 2000
MERGED, REST = 1 << 30, (1 << 30) + (1 << 20)


def tokenizer_paths() -> tuple[str, str]:
    """The public vocabulary, as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


class Encoder:
    """Token ids of a text, as the tokenizer file defines them.

    Plain text (ASCII, Latin letters, common punctuation, no very long runs) takes the
    faster encoder over the same ranks; both give the same ids there. Everything else
    takes the tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import base64
        import os
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.odd = re.compile("[^\t\n\r -~¡-¬®-ɏ‐-‧]")

    def plain(self, text: str) -> bool:
        return not ("<|" in text or self.odd.search(text) or len(text) > LONG_RUN and (
            max(map(len, text.split()), default=0) > LONG_RUN or any(c * LONG_RUN in text for c in " \n\t\r")))

    def ids(self, text: str) -> np.ndarray:
        if self.plain(text):
            found = self.fast.encode_ordinary(text)
        else:
            found = self.full.encode(text, add_special_tokens=False).ids
        return np.array(found, dtype="<u4")


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of a document's pieces, in order."""
    pieces = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left
        slot = capacity // k
        if slot - left <= max(2, slack * slot):
            pieces.append(left)
            break
        smaller = capacity // (k + 1)
        pieces.append(smaller)
        left -= smaller
    return pieces


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, task int, class int, bin long, slot int, place long"


def cut_pieces(docs: DataFrame, key: str, text: str, capacity: int, tokenizer: str, ranks: str,
               with_ids: bool) -> DataFrame:
    """One row for each piece. ``bin`` is -1 where the task left a bin unfinished; ``slot`` then counts those."""
    schema = StructType([docs.schema[key], *StructType.fromDDL(PIECE + (", ids array<int>" if with_ids else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get().partitionId(), Encoder(tokenizer, ranks)
        open_bins: dict[int, list] = {}
        n_bins = 0

        def out(rows: list) -> pa.RecordBatch:
            table = pd.DataFrame(rows, columns=[f.name for f in schema])
            return pa.RecordBatch.from_arrays(
                [pa.array(table[f.name], to_arrow(f)) for f in schema], [f.name for f in schema])

        def to_arrow(field):
            if field.name == key:
                return key_type[0]
            return {"integer": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}.get(
                field.dataType.simpleString(), pa.list_(pa.int32()))

        key_type = [None]
        for batch in batches:
            key_type[0], rows = batch.schema.field(0).type, []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(content.as_py() or ""), np.array([END], "<u4"))
                at = 0
                for length in cuts(len(ids), capacity):
                    own = ids[at:at + length]
                    k = capacity // length
                    bin_ = open_bins.setdefault(k, [])
                    bin_.append([doc, at, length, zlib.crc32(own.tobytes()), len(ids), task, k, -1, len(bin_), 0]
                                + ([own.astype(np.int32).tolist()] if with_ids else []))
                    at += length
                    if len(bin_) == k:
                        place = 0
                        for row in bin_:
                            row[7], row[9] = n_bins, place
                            place += row[2]
                        rows += bin_
                        n_bins, open_bins[k] = n_bins + 1, []
            if rows:
                yield out(rows)
        rows = [row for bin_ in open_bins.values() for row in bin_]
        if rows:
            yield out(rows)

    return docs.select(key, text).mapInArrow(run, schema)


def fill(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length: longest first, each into the fullest sequence with room."""
    rooms: list[tuple[int, int]] = []  # (room, sequence), by room
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(rooms, (lengths[i], -1))
        room, sequence = rooms.pop(at) if at < len(rooms) else (capacity, len(rooms))
        placed[i] = (sequence, capacity - room)
        insort(rooms, (room - lengths[i], sequence))
    return placed


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    default = tokenizer_paths()
    pieces = staged(cut_pieces(docs, key, text, capacity, tokenizer or default[0], ranks or default[1], with_ids), "pieces")
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    sequence = lambda space, bin_: (space.cast("long") * F.lit(1 << 32) + bin_).alias("sequence_id")

    own = pieces.filter("bin >= 0").withColumn("offset", F.col("place")).select(
        "*", sequence(F.col("task"), F.col("bin"))).select(*columns)

    open_ = pieces.filter("bin < 0")
    counts = open_.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("class")
    before = counts.select(
        "class", "task",
        (F.sum("n").over(by_class.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(by_class).alias("of_class"))
    ranked = open_.join(before, ["class", "task"]).withColumn("rank", F.col("before") + F.col("slot"))
    ranked = staged(ranked.withColumn("bin", F.floor(F.col("rank") / F.col("class"))), "open-pieces")
    finished = F.col("rank") < F.col("of_class") - F.col("of_class") % F.col("class")
    order = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        ranked.filter(finished).withColumn("offset", F.sum("length").over(order) - F.col("length"))
        .select("*", sequence(F.lit(MERGED) + F.col("class"), F.col("bin"))).select(*columns)
    )

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["class", "rank"], ignore_index=True)
        placed = fill(rows["length"].tolist(), capacity)
        rows["sequence_id"] = [(REST << 32) + s for s, _ in placed]
        rows["offset"] = [o for _, o in placed]
        return rows[columns]

    # fewer than k pieces of each class k: a group that capacity bounds
    rest = ranked.filter(~finished).groupBy(F.lit("rest").alias("rest")).applyInPandas(last, merged.schema)
    return own.unionByName(merged).unionByName(rest)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with ids; a sequence holds ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
