"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-random rotation (three rounds of random signs and a
fast Hadamard transform) and named after the signed axis it is then nearest to. A table
names each vector by one or more such rotations, the last of them over a part of the
axes, as many as leave some ``BUCKET`` vectors to a bucket. A query looks, in each of the
``TABLES`` tables, into the buckets whose axes it is nearest to in sum, best first. How
many it takes is measured, not guessed: for ``SAMPLE`` queries the true neighbours are
found by comparing them with every row, and the number of probes is the least with which
the share ``RECALL`` of them is met.

Equal vectors are one class with its smallest ids, one more than are asked for, so a
vector that a third of the rows have is hashed and compared once and no answer is lost.
Buckets with more rows than ``HEAVY``-th part of all are dealt in blocks, of vectors and of
queries, to several tasks; their keys are a list of a bounded length. A task streams its
buckets and keeps the best of each query, so a bucket's size costs time but no memory. The
best found are measured again on the original vectors, in double precision, and
ordered by that. Queries that met too few vectors are compared with all of them in blocks.

Null vectors, those with a null or non-finite component, those whose squared length is
zero or infinite, those whose length is not the table's most frequent one and rows without
an id take no part. Of rows with one id the smallest vector counts, so repeated rows
are one row. Ties go to the smaller id. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.common import staged

TABLES, BUCKET = 8, 64
SAMPLE, RECALL = 128, 0.99
#: Buckets above total / HEAVY rows are split; there are at most 2 * HEAVY such keys.
HEAVY = 50_000
#: The least number of rows of a bucket that is split; queries and vectors compared at once.
LEAST_HEAVY, QUERIES, CHUNK = 4096, 512, 4096
#: Numbers in the largest temporary array of a step that ranks buckets.
ROOM = 1 << 22
#: More candidates than results are measured again, since sums differ in their last bits.
SPARE = 4
ROUNDS = 3
PAIRS = "q long, v long, near double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; a power of two columns."""
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def plan_axes(rows: int, width: int) -> list[int]:
    """How many coordinates each rotation of a table uses, for buckets of about BUCKET rows."""
    full = width.bit_length()  # log2 of the signed axes
    bits = max(1, round(np.log2(max(2, rows / BUCKET))))
    dims = [width] * (bits // full)
    return dims + [2 ** (bits % full - 1)] * (bits % full > 0)


def turned(unit: np.ndarray, table: int, step: int, dims: int) -> np.ndarray:
    """Closeness of each row to each signed axis of one rotation: ``2 * dims`` columns."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    signs = np.random.default_rng([table, step]).integers(0, 2, (ROUNDS, width)) * 2.0 - 1.0
    x = np.zeros((len(unit), width))
    x[:, :unit.shape[1]] = unit
    for k in range(ROUNDS):
        x = hadamard(x * signs[k])
    return np.concatenate([x[:, :dims], -x[:, :dims]], axis=1)


def own_bucket(unit: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    """The bucket of each row: its nearest signed axes, as one number."""
    key = np.zeros(len(unit), np.int64)
    for step, dims in enumerate(axes):
        key = key * (2 * dims) + turned(unit, table, step, dims).argmax(axis=1)
    return key


def best_buckets(unit: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """The ``probes`` buckets of each row whose axes are nearest in sum, best first.

    A bucket among the best has a beginning among the best beginnings, so each step
    extends only as many as are asked for.
    """
    key, near = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for step, dims in enumerate(axes):
        more = turned(unit, table, step, dims)
        key = (key[:, :, None] * (2 * dims) + np.arange(2 * dims)).reshape(len(unit), -1)
        near = (near[:, :, None] + more[:, None, :]).reshape(len(unit), -1)
        if near.shape[1] > probes:
            at = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            key, near = np.take_along_axis(key, at, 1), np.take_along_axis(near, at, 1)
    return np.take_along_axis(key, np.argsort(-near, axis=1, kind="stable"), 1)


def rows_at_once(axes: list[int], probes: int) -> int:
    """How many queries are ranked against buckets at once."""
    return max(1, min(2048, ROOM // (2 * max(axes) * max(1, probes))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow list column of one length, scaled to unit length."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def clean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): one usable vector for each id."""
    x = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).filter("id is not null")
    sizes = x.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("size > 0")
    usual = sizes.orderBy(F.desc("n"), "size").limit(1).collect()  # one row
    square = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    fits = F.size("vec") == (usual[0]["size"] if usual else 0)
    length = F.when(fits & F.forall("vec", lambda c: c.isNotNull()), square)
    return x.filter((length > 0) & (length < float("inf"))).groupBy("id").agg(F.min("vec").alias("vec"))


def classes_of(vectors: DataFrame, most: int) -> DataFrame:
    """(v, vec, ids): each different vector, named by its smallest id, with its ``most`` smallest ids."""
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    ids = vectors.withColumn("nth", first).filter(F.col("nth") <= most)
    return ids.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("v"), "vec", "ids")


class Best:
    """The ``most`` best vectors of each query that a task has met, in bounded memory."""

    def __init__(self, most: int, room: int = 400_000):
        self.most, self.room, self.parts, self.held = most, room, [], 0

    def add(self, q: np.ndarray, v: np.ndarray, near: np.ndarray) -> None:
        """Scores of queries (rows) against vectors (columns)."""
        if near.shape[1] > self.most:
            at = np.argpartition(-near, self.most - 1, axis=1)[:, :self.most]
            v, near = v[at], np.take_along_axis(near, at, 1)
        else:
            v = np.broadcast_to(v, near.shape)
        self.parts.append((np.repeat(q, near.shape[1]), v.ravel(), near.ravel()))
        self.held += near.size
        if self.held > 2 * self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, v, near = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((v, q))
        q, v, near = q[order], v[order], near[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, near = q[fresh], v[fresh], near[fresh]
        order = np.lexsort((v, -near, q))
        q, v, near = q[order], v[order], near[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[:len(q)])
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        at = nth < self.most
        self.parts, self.held = [(q[at], v[at], near[at])], int(at.sum())
        self.room = max(self.room, self.held)
        return self.parts[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        q, v, near = self.settle()
        for at in range(0, len(q), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 50_000]) for x in (q, v, near)], ["q", "v", "near"])


def compare(dealt: DataFrame, width: int, most: int) -> DataFrame:
    """(q, v, near): the best of each query over the buckets of (key, block, kind, v, vec).

    Queries (kind 0) and vectors (kind 1) of one key and block meet in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group, names, asked = Best(most), None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, kind, v = (np.asarray(batch.column(k)) for k in range(4))
            unit = matrix(batch.column(4), width)
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.append(0, edge).tolist(), np.append(edge, len(key)).tolist()):
                if group != (key[a], block[a]):
                    group, names, asked = (key[a], block[a]), [], []
                if kind[a] == 0:
                    names += [v[c:min(b, c + QUERIES)] for c in range(a, b, QUERIES)]
                    asked += [unit[c:min(b, c + QUERIES)] for c in range(a, b, QUERIES)]
                elif names:
                    for name, q in zip(names, asked):
                        for c in range(a, b, CHUNK):
                            best.add(name, v[c:min(b, c + CHUNK)], q @ unit[c:min(b, c + CHUNK)].T)
        yield from best.batches()

    kept = dealt.select("key", "block", "kind", "v", "vec").repartition("key", "block")
    return kept.sortWithinPartitions("key", "block", "kind").mapInArrow(run, PAIRS)


def sample_links(classes: DataFrame, asked: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of sampled queries and of their true neighbours, pair by pair."""
    rows = asked.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()  # SAMPLE rows
    q = np.array([r["v"] for r in rows], np.int64)
    unit = np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), width)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(most + 1)
        for batch in batches:
            if batch.num_rows:
                v, x = np.asarray(batch.column(0)), matrix(batch.column(1), width)
                for c in range(0, len(v), CHUNK):
                    best.add(q, v[c:c + CHUNK], unit @ x[c:c + CHUNK].T)
        yield from best.batches()

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "v"))
    near = classes.select("v", "vec").mapInArrow(run, PAIRS).filter("q <> v").withColumn("nth", nth).filter(
        F.col("nth") <= most)
    pairs = near.join(classes.select("v", "vec"), "v").select("q", "vec").collect()  # SAMPLE * most rows
    at = {k: i for i, k in enumerate(q.tolist())}
    other = np.array([p["vec"] for p in pairs], np.float64).reshape(len(pairs), width)
    other /= np.sqrt(np.einsum("ij,ij->i", other, other))[:, None]
    return unit[[at[p["q"]] for p in pairs]], other


def probes_needed(asked: np.ndarray, other: np.ndarray, axes: list[int], recall: float) -> int:
    """The least number of probes a table with which the share ``recall`` of the pairs meet."""
    limit = int(np.prod([2.0 * d for d in axes]).clip(max=1 << 15))
    found, step = np.full(len(asked), limit), rows_at_once(axes, limit)
    for table in range(TABLES):
        home = own_bucket(other, table, axes)
        for a in range(0, len(asked), step):
            part = slice(a, a + step)
            hit = best_buckets(asked[part], table, axes, limit) == home[part, None]
            found[part] = np.minimum(found[part], np.where(hit.any(axis=1), hit.argmax(axis=1), limit))
    if not len(found):
        return 1
    return min(limit, int(np.sort(found)[max(0, int(np.ceil(recall * len(found))) - 1)]) + 1)


def keyed(part: DataFrame, width: int, axes: list[int], probes: int, vectors: bool,
          split: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """(key, block, kind, v, vec) of vectors (``probes`` 0) or queries; without vec if only counted.

    Rows of a split bucket are dealt by their id over the blocks of their own side and
    repeated for those of the other side.
    """
    split, step = split or {}, rows_at_once(axes, probes)
    heavy = np.array(sorted(split), np.int64)
    sides = np.array([split[k] for k in heavy.tolist()], np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                v, unit = np.asarray(batch.column(0)), matrix(batch.column(1), width)
                for table in range(TABLES):
                    found = best_buckets(unit, table, axes, probes) if probes else own_bucket(unit, table, axes)[:, None]
                    key = (found * TABLES + table).ravel()
                    at, block = np.repeat(np.arange(len(v)), found.shape[1]), np.zeros(len(key), np.int64)
                    if len(heavy):
                        where = np.searchsorted(heavy, key).clip(max=len(heavy) - 1)
                        hot = np.flatnonzero(heavy[where] == key)
                        cold = np.flatnonzero(heavy[where] != key)
                        own, rest = sides[where[hot]].T if probes else sides[where[hot]].T[::-1]
                        mixed = (v[at[hot]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                        turn, again = mixed.astype(np.int64) % own, np.repeat(np.arange(len(hot)), rest)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(rest) - rest, rest)
                        # blocks are numbered query side first
                        block = np.concatenate([block[cold], turn[again] * rest[again] + other if probes
                                                else other * own[again] + turn[again]])
                        key, at = np.concatenate([key[cold], key[hot][again]]), np.concatenate([at[cold], at[hot][again]])
                    columns = [pa.array(key), pa.array(block), pa.array(np.full(len(key), 0 if probes else 1, np.int32))]
                    if vectors:
                        columns += [pa.array(v[at]), batch.column(1).take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "block", "kind", "v", "vec"][:len(columns)])

    kind = part.schema["vec"].dataType.simpleString()
    schema = "key long, block long, kind int" + f", v long, vec {kind}" * vectors
    return part.select("v", "vec").mapInArrow(run, schema)


def heavy_keys(members: DataFrame, queries: DataFrame, rows: int) -> dict[int, tuple[int, int]]:
    """The blocks (of queries, of vectors) of each bucket with too many of either."""
    most = max(LEAST_HEAVY, rows // HEAVY)
    counts = members.union(queries).groupBy("key").agg(
        F.sum(1 - F.col("kind")).alias("n_q"), F.sum("kind").alias("n_v"))
    over = counts.filter((F.col("n_q") > most) | (F.col("n_v") > most)).filter("n_q > 0 and n_v > 0")
    return {r["key"]: (-(-r["n_q"] // most), -(-r["n_v"] // most)) for r in over.collect()}  # at most 2 * HEAVY


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, c: s + c)

    def times(x: str, y: str) -> Column:
        return F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))

    return total(times(a, b)) / (F.sqrt(total(times(a, a))) * F.sqrt(total(times(b, b))))


def measured(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(v, found): the ``most`` best classes of each query, as (score, ids), measured on the vectors."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "v"))
    once = pairs.groupBy("q", "v").agg(F.max("near").alias("near"))
    near = once.withColumn("nth", nth).filter(F.col("nth") <= most).select("q", "v")
    near = near.join(classes, "v").select("q", F.col("vec").alias("b"), "ids")
    near = near.join(classes.select(F.col("v").alias("q"), F.col("vec").alias("a")), "q")
    return near.select(F.col("q").alias("v"), cosine("a", "b").alias("score"), "ids").groupBy("v").agg(
        F.collect_list(F.struct("score", "ids")).alias("found"))


def ranked(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, hits): the k best of each query, its own row left out; ties to the smaller id."""
    every = F.flatten(F.transform("found", lambda f: F.transform(
        f["ids"], lambda i: F.struct((-f["score"]).alias("far"), i.alias("id")))))
    return queries.join(found, "v", "left").select(
        F.col("id").alias("query_id"), "v",
        F.slice(F.sort_array(F.filter(F.coalesce(every, F.array()), lambda x: x["id"] != F.col("id"))), 1, k).alias("hits"))


def nearest(rows: DataFrame, asks: Callable[[Column], Column], k: int = 5, key: str = "vec_id",
            vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that ``asks(id)`` picks."""
    vectors = staged(clean(rows, key, vector), "vectors")
    classes = staged(classes_of(vectors, k + 1), "vector-classes")
    n = classes.count()
    queries = vectors.filter(asks(F.col("id"))).join(classes.select("vec", "v"), "vec").select("id", "v")
    queries = staged(queries, "queries")
    asked = staged(classes.select("v", "vec").join(queries.select("v").distinct(), "v"), "asked")
    first = classes.select(F.size("vec").alias("width")).take(1)
    width, most = (first[0]["width"] if first else 1), k + SPARE
    axes = plan_axes(n, 1 << max(0, width - 1).bit_length())
    probes = probes_needed(*sample_links(classes, asked, width, k), axes, recall)

    def both(vectors: bool, split: dict[int, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
        return (keyed(classes, width, axes, 0, vectors, split), keyed(asked, width, axes, probes, vectors, split))

    total = TABLES * n + TABLES * probes * asked.count()
    members, searches = both(True, heavy_keys(*both(False), total))
    found = measured(compare(members.union(searches), width, most + 1), classes, most + 1)
    hits = staged(ranked(queries, found, k), "hits")
    # Queries that met too few vectors are compared with all of them, in blocks.
    lost = staged(hits.filter(F.size("hits") < k).select("v").distinct().join(asked, "v"), "lost")
    if lost.take(1):
        blocks = -(-n // LEAST_HEAVY)
        every = classes.select(F.lit(0).alias("key"), F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"),
                               F.lit(1).alias("kind"), "v", "vec")
        again = lost.select(F.lit(0).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                            F.lit(0).alias("kind"), "v", "vec")
        more = measured(compare(every.union(again), width, most + 1), classes, most + 1)
        left = queries.join(lost.select("v"), "v", "left_semi")
        hits = hits.filter(F.size("hits") >= k).unionByName(ranked(left, more, k))
    return hits.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
