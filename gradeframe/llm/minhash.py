"""Near-duplicate groups by DartMinHash, a banded join and exact verification.

A text is the multiset of its shingles of five words (one shingle of all its words if
it has fewer). Each unit of a shingle's weight is a cell of area one per unit of rank,
into which darts fall at rate one; how many, where and at which rank is a function of
the cell alone. A text throws only the darts below the rank at which about
``k ln k + 2k`` are expected, whatever its length, goes on until each of the k
coordinates is hit, and keeps the earliest dart of each. Two texts keep the same dart
of a coordinate with a probability equal to their weighted Jaccard similarity. Bands
of four coordinates make the keys of the join.

Texts that are equal share one id, a 128-bit hash, and are one node from then on. In
each bucket members are compared with a hub instead of with each other: the one with
the largest share of cells that others have too. Buckets whose members are not all in
one component are compared again with more hubs, up to all of them, so no link that the
bands propose is lost to the shortcut, while a large group of copies costs one
comparison each. Two exact bounds keep pairs that cannot be similar enough from being
formed: cells that no other text of the larger buckets has, and bitmaps of some bits a
cell, whose differences are differences of the texts. A family of loosely related texts
thus gives few pairs besides its links. Comparisons count shared cells (32-bit fingerprints,
wrong in about n * n / 2**32 of them), so a link is a similarity of 0.8 or more; see
``BANDS`` for how rarely such a pair meets in no band. Groups are the components of
the links.

Null texts count as empty; texts without words are grouped only with equal ones. A very
long text is a slice of its own while it is hashed, and its cells are one array in one row.
Repeated rows and keys are grouped by their text. Null keys are never the name of a
group unless all its keys are null. Empty tables give empty results. Extra columns
pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import free_name, staged
from gradeframe.llm.textbytes import GOLDEN, mix, shingle_hashes, slices, span_hashes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares no band with a probability of (1 - 0.8**4)**24, about 3 in a million.
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: The first level holds ranks up to this; each next level doubles the rank.
LOWEST_RANK = 2.0**-6
ROW_BITS = np.uint64(12)
HUB_GROWTH = 8
#: Bits of a text's bitmap for each of its cells, before rounding up to a power of two.
BITS = 4


def cells_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row): a 64-bit name for each unit of weight of each row's shingles."""
    start, end, before = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    n_words = np.diff(before)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    hashes, rows = [], []
    for k in range(1, SHINGLE + 1):
        found = shingle_hashes(words, k)
        at = np.flatnonzero((row_of[:len(found)] == row_of[k - 1:k - 1 + len(found)])
                            & ((k == SHINGLE) | (n_words == k))[row_of[:len(found)]])
        hashes.append(found[at])
        rows.append(row_of[at])
    low = (np.uint64(1) << ROW_BITS) - np.uint64(1)
    key = np.sort((np.concatenate(hashes) & ~low) | np.concatenate(rows).astype(np.uint64))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return mix((key & ~low) + (nth.astype(np.uint64) + np.uint64(1)) * GOLDEN), (key & low).astype(np.uint16)


def poisson(mean: float) -> np.ndarray:
    """Probability of at most 0, 1, 2, ... darts."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = n * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(n[1:]))])
    return np.minimum(1, np.cumsum(np.exp(logs)))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def darts(cells: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the cell, dart, rank) of the darts in the cells at one level of ranks."""
    low, high = (LOWEST_RANK * 2.0 ** (level - 1) if level else 0.0), LOWEST_RANK * 2.0**level
    own = mix(cells ^ mix(np.array([level + 1], np.uint64) * GOLDEN))
    table, u = poisson(high - low), unit(own)
    hit = np.flatnonzero(u >= table[0])
    count = np.searchsorted(table, u[hit], "right")
    cell = np.repeat(hit, count)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(own[cell] + (nth.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    return cell, dart, low + (high - low) * unit(mix(dart + GOLDEN))


def signatures(cells: np.ndarray, row: np.ndarray, n_rows: int, k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate; rows without cells keep zeros."""
    weight = np.bincount(row, minlength=n_rows)
    wanted = (k * np.log(k) + 2 * k) / np.maximum(weight, 1) / LOWEST_RANK
    last = np.maximum(0, np.ceil(np.log2(wanted))).astype(np.int64)
    last[weight == 0] = -1
    kept, rank = np.zeros((n_rows, k), np.uint64), np.full((n_rows, k), np.inf)
    level = 0
    while (last >= level).any():
        at = np.flatnonzero(last[row] >= level)
        cell, dart, when = darts(cells[at], level)
        slot = row[at][cell].astype(np.int64) * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(-when, kind="stable")  # of darts in one slot the earliest is written last
        best_rank, best = np.full(n_rows * k, np.inf), np.zeros(n_rows * k, np.uint64)
        best_rank[slot[order]], best[slot[order]] = when[order], dart[order]
        better = (best_rank.reshape(n_rows, k) < rank)
        kept[better], rank[better] = best.reshape(n_rows, k)[better], best_rank.reshape(n_rows, k)[better]
        open_ = np.isinf(rank).any(axis=1) & (last == level)
        last[open_] += 1
        level += 1
    return kept


def band_keys(kept: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    parts = kept.reshape(len(kept), BANDS, ROWS)
    total = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN)[None, :].repeat(len(kept), axis=0)
    for j in range(ROWS):
        total = mix(total + parts[:, :, j])
    return total.view(np.int64)


def text_ids(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    import hashlib

    whole = data.tobytes()
    return [hashlib.md5(whole[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, n, bands) of each row; no bands without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, bands = [], [], []
            for _, data, offsets in slices(batch.column(1)):
                cells, row = cells_of(data, offsets)
                n = np.bincount(row, minlength=len(offsets) - 1)
                keys = band_keys(signatures(cells, row, len(n)))
                ids += text_ids(data, offsets)
                sizes.append(n)
                bands += [x if w else None for x, w in zip(keys, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(np.concatenate(sizes or [np.zeros(0)]).astype(np.int32)),
                 pa.array(bands, pa.list_(pa.int64()))], [key, "id", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, id binary, n int, bands array<long>")


def bitmap(cells: np.ndarray) -> np.ndarray:
    """One bit for each of the cells' names modulo a power of two, BITS or more of them for each cell."""
    width = max(64, BITS << max(0, len(cells) - 1).bit_length())
    on = np.zeros(width, bool)
    on[cells.view(np.uint32) & np.uint32(width - 1)] = True
    return np.packbits(on, bitorder="little").view(np.int64)


def bitmaps(cells: DataFrame) -> DataFrame:
    """(id, bits) of texts by their cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bitmap(np.asarray(x.values, np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "bits"])

    return cells.select("id", "cells").mapInArrow(run, "id binary, bits array<long>")


def differing(a: str, b: str) -> Column:
    """At least so many cells are in only one of two texts, by their bitmaps; the wider is folded first."""
    def folded(x: str, other: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(
            F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(F.col(x))

    apart = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.coalesce(F.bit_count(p.bitwiseXOR(q)), F.lit(0)))
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x)


def fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """(id, cells) of each text; a task gives each id once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                cells, row = cells_of(data, offsets)
                order = np.argsort(row, kind="stable")
                short = (cells[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])
                rows = []
                for i, x in enumerate(text_ids(data, offsets)):
                    if x not in seen and at[i + 1] > at[i]:
                        seen.add(x)
                        rows.append((x, np.unique(short[at[i]:at[i + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(
                    [r[1] for r in rows], pa.list_(pa.int32()))], ["id", "cells"])

    return docs.select(text).mapInArrow(run, "id binary, cells array<int>")


def shared_cells(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, n, s): how many cells each text has, and how many of them another of the texts has too."""
    units = cells.join(ids, "id", "left_semi").select("id", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    common = staged(units.groupBy("cell").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("cell"), "common-cells")
    return units.join(common.withColumn("common", F.lit(1)), "cell", "left").groupBy("id").agg(
        F.first("n").alias("n"), F.coalesce(F.sum("common"), F.lit(0)).cast("int").alias("s"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, its smaller id first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(pairs: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are as similar as asked for."""
    a = cells.select(F.col("id").alias("a"), F.col("cells").alias("cells_a"))
    b = cells.select(F.col("id").alias("b"), F.col("cells").alias("cells_b"))
    both = pairs.join(b, "b").join(a, "a")
    shared = F.size(F.array_intersect("cells_a", "cells_b"))
    return both.filter(shared >= similarity * (F.size("cells_a") + F.size("cells_b") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge; the root is the smallest id of its component.

    Labels take the smallest label around them and then the label of their label, so
    the number of rounds grows with the logarithm of the longest chain.
    """
    both = staged(edges.union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        lower = staged(lower, "labels-near")
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("lowest"))
        after = staged(lower.join(jump, "low").select("id", "root", F.least("low", "lowest").alias("next")), "labels")
        done = not after.filter("root <> next").take(1)
        labels = after.select("id", F.col("next").alias("root"))
        if done:
            return labels


def grouped_texts(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, id) of every row, and (id, copy_of, root) of every different text."""
    rows = staged(signed(docs, key, text), "signatures")
    texts = staged(rows.groupBy("id").agg(
        F.min(key).alias("copy_of"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    banded = texts.select("id", "n", F.xxhash64("id").alias("r"), F.explode("bands").alias("band"))
    buckets = staged(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    members = staged(banded.join(buckets, "band"), "members")
    candidates = members.select("id").distinct()
    cells = fingerprints(docs, text).join(candidates, "id", "left_semi").groupBy("id").agg(F.first("cells").alias("cells"))
    cells = staged(cells, "cells")
    shared = staged(shared_cells(members.filter("m > 2").select("id").distinct(), cells), "shared-cells")
    members = members.filter("m = 2").withColumn("s", F.col("n")).unionByName(
        members.filter("m > 2").drop("n").join(shared, "id").filter(F.col("s") >= similarity * F.col("n")).select(
            "id", "n", "r", "band", "m", "s"))
    members = staged(members, "members")

    def alike(n: str, s: str, other_n: str, other_s: str) -> Column:
        """Whether two texts can be similar enough, by their sizes and shared cells."""
        most = F.least(s, other_s)
        return (F.least(n, other_n) >= similarity * F.greatest(n, other_n)) & (
            most >= similarity * (F.col(n) + F.col(other_n) - most))

    hubs = members.groupBy("band").agg(F.max(F.struct(F.col("s") / F.col("n"), "r", "id", "n", "s")).alias("hub"))
    hubs = hubs.select("band", F.col("hub.id").alias("a"), F.col("hub.n").alias("hub_n"), F.col("hub.s").alias("hub_s"))
    near = members.join(staged(hubs, "hubs"), "band").filter(
        (F.col("id") != F.col("a")) & alike("n", "s", "hub_n", "hub_s"))
    # of its hubs a text meets the best one first, which settles most buckets with one comparison
    best = near.filter("m > 2").groupBy("id").agg(F.max(F.struct(F.col("hub_s") / F.col("hub_n"), "a")).alias("best"))
    pairs = ordered(near.filter("m = 2").select("a", F.col("id").alias("b")).unionByName(
        best.select("best.a", F.col("id").alias("b"))))
    seen = staged(pairs, "pairs")
    roots = components(links(seen, cells, similarity))
    tested, share = 0.0, float(HUB_GROWTH)
    while True:
        rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        # buckets of two are done, and those whose members were all hubs
        more = rooted.filter(F.col("m") > max(2.0, tested)).join(mixed.filter("low <> high").select("band"), "band")
        more = staged(more, "open-members")
        if not more.take(1):
            break
        bits = bitmaps(cells.join(more.select("id").distinct(), "id", "left_semi"))
        more = staged(more.join(bits, "id"), "open-bitmaps")
        part = F.shiftrightunsigned(F.col("r"), 11) * F.lit(2.0**-53) * F.col("m")
        hub = more.filter((part < share) & (part >= tested)).select(
            "band", F.col("id").alias("a"), F.col("n").alias("hub_n"), F.col("s").alias("hub_s"), F.col("root").alias("hub_root"),
            F.col("bits").alias("hub_bits"))
        most_apart = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("hub_n")) + 1e-6
        pairs = more.join(hub, "band").filter(
            (F.col("root") != F.col("hub_root")) & alike("n", "s", "hub_n", "hub_s")
            & (differing("bits", "hub_bits") <= most_apart)).select("a", F.col("id").alias("b"))
        pairs = staged(ordered(pairs).join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = seen.unionByName(pairs)
        found = staged(links(pairs, cells, similarity), "found")
        # join components: their roots are the nodes now
        name = lambda end: found.select(F.col(end).alias("id"), *found.columns).join(roots, "id", "left")
        ends = name("a").select("a", "b", F.coalesce("root", "a").alias("ra"))
        ends = ends.withColumn("id", F.col("b")).join(roots, "id", "left").select(
            F.col("ra").alias("a"), F.coalesce("root", "b").alias("b"))
        joined = components(ends)
        known = roots.select("id", "root").union(
            joined.select("id", F.col("id").alias("root")).join(roots.select("id"), "id", "left_anti"))
        up = joined.select(F.col("id").alias("root"), F.col("root").alias("top"))
        roots = staged(known.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")
        tested, share = share, share * HUB_GROWTH
    named = staged(texts.select("id", "copy_of").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    return rows.select(key, "id"), named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """(key, copy_of, class_id) for every row: the smallest keys of its equal texts and of its group."""
    rows, named = grouped_texts(docs, key, text, similarity)
    groups = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    classes = staged(named.join(groups, "root").select("id", "copy_of", "class_id"), "classes")
    return rows.join(classes, "id").select(key, "copy_of", "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, the one with the smallest key, with its own columns.

    Of rows that agree in key and text one stays.
    """
    _, named = grouped_texts(docs, key, text, similarity)
    place = F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "id")
    kept = staged(named.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.id").alias("id")), "kept")
    first = F.struct(F.col(key).isNull(), F.col(key))
    rows = docs.groupBy(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("id")).agg(
        F.min_by(F.struct(*docs.columns), first).alias("row"))
    return rows.join(kept, "id", "left_semi").select("row.*")


def groups_sql(similarity: float = SIMILARITY) -> str:
    """The groups of ``documents`` with unique ids from all pairs that share a shingle, in SQL."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w
  FROM documents
), s AS (
  SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS x, count(*) AS m
  FROM (SELECT doc_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i
        FROM w WHERE len(w) > 0) GROUP BY ALL
), n AS (SELECT doc_id, sum(m) AS n FROM s GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.m, b.m)) AS i
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE i::DOUBLE >= {similarity}::DOUBLE * (na.n + nb.n - i)::DOUBLE
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b
    ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id < b.doc_id
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
)
SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy_of, class_id
FROM documents d JOIN (SELECT id, min(r) AS class_id FROM reach GROUP BY 1) ON id = d.doc_id"""
