"""A Merkle tree over a dataset, kept as node rows, and proofs by a climbing recursive query.

Each row is a leaf, the SHA-256 of its columns with their lengths. In each group leaves
ascend by key; ``ARITY`` consecutive nodes become their parent until one is left, and the
groups' roots are the leaves of a top tree. All hashes take lower-case hex text.

The tree is built ``STRIDE`` levels at a time: up to ``ARITY ** STRIDE`` consecutive nodes
meet in one row, which is all a task holds of a group. What is stored are node rows: the
node, its parent link ``STRIDE`` levels up, the digest there, and the siblings left and
right of the way between. A Spark recursive query then ascends from the leaves along the
links: each step joins the node row, appends the siblings and folds each leaf's (possibly
tampered) hash with them, until the top tree's root. Leaves of one row have all further
ancestors in common, so they travel together: each keeps its own hash, the siblings they
share are carried once, and those below are read off the row in the end. With a stride of
one a step is one level; longer strides shuffle less and give the same result.

A group's leaves are numbered by a range partitioning over (group, key) and counts of each
partition, so a group may hold any share of the rows. The climb's joins shuffle rows of
leaves; adaptive execution splits the hot keys near the roots.

A null column is ``-``; null keys come first and are not tampered with; rows with one key
ascend by digest, so equal rows are interchangeable neighbours. A null group comes first
and is another than the empty one. Empty tables give no rows. Other columns than the five
are in no hash, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.common import staged

ARITY, STRIDE = 3, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the groups' roots.
TOP = -1
ROW_LIMIT, LEVEL_LIMIT = "spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row: each value with its length in bytes, or ``-``."""
    def coded(x: Column) -> Column:
        x = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return digest(F.concat(*[coded(v) for v in values]))


def hex_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, start): the digest of each row and of its tampered form."""
    id_, source, lang, n_chars, text = (F.col(c) for c in COLUMNS)
    tampered = F.when(F.crc32(id_.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit("")))
    changed = (tampered != text)
    whole = docs.select(*COLUMNS).withColumn("leaf", leaf_of([id_, source, lang, n_chars, text]))
    return whole.select(
        "doc_id", "source", F.unhex("leaf").alias("leaf"),
        F.unhex(F.when(changed, leaf_of([id_, source, lang, n_chars, tampered])).otherwise(F.col("leaf"))).alias("start"))


def ordered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in their order (``at``), and the runs of a group in one partition: (g, run, first, before, size)."""
    at = staged(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(
        "at", F.monotonically_increasing_id()), "ordered")
    run = F.shiftrightunsigned("at", 33).alias("run")
    runs = at.groupBy(group, run).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return at, staged(runs.select(F.col(group).alias("g"), "run", "first", before.alias("before"),
                                  F.sum("n").over(whole).alias("size")), "runs")


def placed(at: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Rows with their number in their group, from 0 (``place``), and what else the runs say."""
    on = F.col(group).eqNullSafe(F.col("g")) & (F.shiftrightunsigned("at", 33) == F.col("run"))
    return at.join(runs, on).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop(
        "at", "g", "run", "first", "before")


def levels_up(size: Column, stride: int) -> Column:
    """How many levels there are above ``size`` nodes, at most ``stride``."""
    return sum(((size > ARITY**k).cast("int") for k in range(stride)), F.lit(0))


def above(nodes: Column) -> Column:
    """The parents of consecutive nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")),
                       lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), "")))


def gathered(rows: DataFrame, stride: int, carry: list[str]) -> DataFrame:
    """Consecutive nodes under one ancestor in one row: (tree, block, size, nodes); at most ``ARITY ** stride`` of them."""
    return rows.groupBy("tree", F.floor(F.col("place") / ARITY**stride).alias("block")).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "node", *carry))).alias("nodes"))


def with_levels(met: DataFrame, stride: int) -> DataFrame:
    """Add the digests of every level above ``nodes``: ``level_0`` is theirs, the last has one."""
    met = met.withColumn("levels", levels_up(F.col("size"), stride)).withColumn(
        "level_0", F.transform("nodes", lambda x: hex_of(x["node"])))
    for k in range(stride):
        below = F.col(f"level_{k}")
        met = met.withColumn(f"level_{k + 1}", F.when(F.col("levels") > k, above(below)).otherwise(below))
    return met


def path(at: Column, stride: int) -> Column:
    """The siblings to the left and right of the way up from node number ``at`` of a row with levels."""
    def siblings(k: int) -> Column:
        nth = F.floor(at / ARITY**k).cast("int")
        head = (nth - nth % ARITY).cast("int")
        row = F.col(f"level_{k}")
        return F.struct(F.unhex(F.array_join(F.slice(row, head + 1, nth - head), "")).alias("left"),
                        F.unhex(F.array_join(F.slice(row, nth + 2, head + ARITY - nth - 1), "")).alias("right"))

    return F.slice(F.array(*[siblings(k) for k in range(stride)]), 1, F.col("levels"))


def fold(way: Column, start: Column) -> Column:
    """The digest at the end of the way when it begins with ``start``."""
    return F.aggregate(way, start, lambda below, p: F.unhex(digest(F.concat(hex_of(p["left"]), hex_of(below), hex_of(p["right"])))))


def append(way: Column, proof: Column) -> Column:
    return F.aggregate(way, proof, lambda all_, p: F.concat(all_, p["left"], p["right"]))


def linked(met: DataFrame, level: int, stride: int, top: bool) -> DataFrame:
    """Add the parent link: the next stored node of the tree, or the tree's own node in the top tree."""
    last = F.col("size") <= ARITY**stride
    return met.withColumn("top", F.unhex(F.col(f"level_{stride}")[0])).withColumns({
        "up_tree": F.when(last, F.lit(None if top else TOP)).otherwise(F.col("tree")).cast("long"),
        "up_level": F.when(last, 0).otherwise(level + 1), "up_place": F.when(last, F.col("tree")).otherwise(F.col("block"))})


LINK = ("up_tree", "up_level", "up_place", "top")
NODE = ("tree", "level", "place", "node", *LINK, "path")


def split_heads(met: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """(nodes of the next stored level, roots of the trees that end here)."""
    last = F.col("size") <= ARITY**stride
    return met.filter(~last).select(
        "tree", F.col("block").alias("place"), F.ceil(F.col("size") / ARITY**stride).alias("size"), F.col("top").alias("node")
    ), met.filter(last).select("tree", F.col("top").alias("node"))


def grown(rows: DataFrame, stride: int, level: int, top: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """(node rows, roots), level by level, of all trees from ``level`` on."""
    stored, roots = [], []
    while not stored or rows.take(1):
        met = linked(with_levels(gathered(rows, stride, []), stride), level, stride, top)
        wide = ARITY**stride
        each = F.transform("nodes", lambda x: F.struct(x.alias("row"), path(x["place"] % wide, stride).alias("path")))
        part = staged(met.select("tree", "block", "size", *LINK, F.explode(each).alias("x")).select(
            "tree", "block", "size", F.lit(level).alias("level"), *LINK, "x.row.*", "x.path"), "nodes")
        stored.append(part.select(*NODE))
        rows, ended = split_heads(part.filter(F.col("place") % wide == 0), stride)
        roots.append(ended)
        level += 1
    return stored, roots


CLIMB = f"""
WITH RECURSIVE climb (size, up_tree, up_level, up_place, top, leaves, proof, subroot) AS (
  SELECT size, up_tree, up_level, up_place, top, leaves, CAST('' AS BINARY), CAST(NULL AS BINARY) FROM {{blocks}}
  UNION ALL
  SELECT c.size, n.up_tree, n.up_level, n.up_place, n.top,
    transform(c.leaves, l -> named_struct('doc_id', l.doc_id, 'node', l.node, 'folded',
      aggregate(n.path, l.folded, (below, p) ->
        unhex(sha2(concat(lower(hex(p.left)), lower(hex(below)), lower(hex(p.right))), 256))))),
    aggregate(n.path, c.proof, (all, p) -> concat(all, p.left, p.right)),
    coalesce(c.subroot, CASE WHEN n.tree = {TOP} AND n.level = 0 THEN n.node END)
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.place = c.up_place
) SELECT size, leaves AS nodes, proof, subroot, top AS root FROM climb WHERE up_tree IS NULL"""


def climb(blocks: DataFrame, nodes: DataFrame, stride: int) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded): every leaf's way to the root, as digests.

    The session's limits on the rows and depth of a recursive query do not hold for it.
    """
    spark = blocks.sparkSession
    start = with_levels(blocks, stride).withColumn("leaves", F.transform("nodes", lambda x, i: F.struct(
        x["doc_id"].alias("doc_id"), x["node"].alias("node"), fold(path(i, stride), x["start"]).alias("folded"))))
    limits = {k: spark.conf.get(k, None) for k in (ROW_LIMIT, LEVEL_LIMIT)}
    try:
        for k in limits:
            spark.conf.set(k, "-1")
        ended = staged(spark.sql(CLIMB, blocks=start.select("size", *LINK, "leaves"), nodes=nodes), "climb")
    finally:
        for k, value in limits.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    own = F.transform("nodes", lambda x, i: F.struct(x.alias("leaf"), append(path(i, stride), F.lit(b"")).alias("own")))
    return with_levels(ended, stride).select("subroot", "root", "proof", F.explode(own).alias("x")).select(
        "x.leaf.doc_id", F.col("x.leaf.node").alias("leaf"), "subroot", "root",
        F.concat("x.own", "proof").alias("proof"), "x.leaf.folded")


def manifest(docs: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """The tree of a dataset: (rows of neighbouring leaves, upper node rows), each with the link to its ancestor."""
    # written first: a range partitioning reads its input twice, and this one is small
    at, runs = ordered(staged(leaves(docs), "leaves"), "source", ["doc_id", "leaf"])
    groups, group_runs = ordered(runs.select(F.col("g").alias("source"), F.lit(0).alias("all")).distinct(), "all", ["source"])
    trees = staged(placed(groups, group_runs, "all").select(
        "source", F.col("place").alias("tree"), F.col("size").alias("trees")), "trees")
    runs = runs.join(trees, F.col("g").eqNullSafe(F.col("source"))).drop("source")
    rows = placed(at, runs, "source").select("tree", "place", "size", F.col("leaf").alias("node"), "doc_id", "start")
    met = with_levels(gathered(rows, stride, ["doc_id", "start"]), stride)
    blocks = staged(linked(met, 0, stride, False).select("tree", "block", "size", *LINK, "nodes"), "leaf-blocks")
    heads, ended = split_heads(blocks, stride)
    upper, roots = grown(heads, stride, 1, False)
    for more in roots:
        ended = ended.unionByName(more)
    tops, _ = grown(ended.join(trees, "tree").select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("size"), "node"), stride, 0, True)
    nodes = tops[0]
    for part in [*upper, *tops[1:]]:
        nodes = nodes.unionByName(part)
    return blocks, staged(nodes, "upper-nodes")


def verify(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Each row's leaf, roots, proof, the root folded from its tampered form, and whether they agree."""
    proved = climb(*manifest(docs, stride), stride)
    return proved.select(
        "doc_id", *[hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], digest(hex_of(F.col("proof"))).alias("proof_sha256"),
        hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def manifest_sql() -> str:
    """The same over ``documents`` with unique ids, one level at a time, in SQL."""
    def leaf(text: str) -> str:
        coded = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
                 for c in (*COLUMNS[:-1], text)]
        return f"sha256({' || '.join(coded)})"

    crc = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda x: 0::BIGINT), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
    sides = """coalesce(string_agg(h, '') OVER (before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (before ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS start FROM documents
), up AS (
  SELECT source, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, leaf AS h,
    count(*) OVER (PARTITION BY source) AS m, doc_id, start FROM d
  UNION ALL
  SELECT source, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (m + {ARITY - 1}) // {ARITY}, NULL, NULL
  FROM up WHERE m > 1 GROUP BY source, level, i // {ARITY}, m
), top AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS m, source FROM up WHERE m = 1
  UNION ALL
  SELECT level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (m + {ARITY - 1}) // {ARITY}, NULL
  FROM top WHERE m > 1 GROUP BY level, i // {ARITY}, m
), run AS (
  SELECT source, level, i, {sides} FROM up WINDOW before AS (PARTITION BY source, level, i // {ARITY} ORDER BY i)
), top_run AS (
  SELECT level, i, {sides} FROM top WINDOW before AS (PARTITION BY level, i // {ARITY} ORDER BY i)
), climb AS (
  SELECT doc_id, source, level, i, m, h AS leaf, start AS folded, '' AS proof FROM up WHERE level = 0
  UNION ALL
  SELECT doc_id, c.source, c.level + 1, c.i // {ARITY}, (m + {ARITY - 1}) // {ARITY}, leaf, sha256(l || folded || r), proof || l || r
  FROM climb c JOIN run n ON n.source IS NOT DISTINCT FROM c.source AND n.level = c.level AND n.i = c.i WHERE m > 1
), last AS (
  SELECT doc_id, 0 AS level, t.i, t.m, leaf, folded, proof, t.h AS subroot
  FROM climb c JOIN top t ON t.level = 0 AND t.source IS NOT DISTINCT FROM c.source WHERE c.m = 1
  UNION ALL
  SELECT doc_id, c.level + 1, c.i // {ARITY}, (m + {ARITY - 1}) // {ARITY}, leaf, sha256(l || folded || r), proof || l || r, subroot
  FROM last c JOIN top_run n ON n.level = c.level AND n.i = c.i WHERE m > 1
)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE m = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT h FROM top WHERE m = 1) AS verified FROM last WHERE m = 1"""
