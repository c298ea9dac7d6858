"""Incremental grading: each run grades only what is new or was changed.

Every micro-batch leaves four things below the result folder, each in a folder of its
own number, so replaying a batch overwrites its own and nothing else:

* ``results``: the rows it graded, the append-only history
* ``state``: the buckets of current rows it changed, written anew as a whole
* ``directory``: where the current buckets are
* ``commits``: one row, written last, that names what a complete batch has written

The current state is the newest row of each key, in buckets by leading bits of the
key's hash. A bucket that has grown beyond ``BUCKET_ROWS`` is split by further bits when
it is next written, so a batch of a few keys reads and writes a few buckets of bounded
size, however long the history is. Only the directory, one short row a bucket, is
written as a whole. Metric snapshots are kept as sums that a batch adds to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from gradeframe.operators.agreement import added, negated, snapshot_of, snapshot_parts
from gradeframe.operators.keyed import last_per_key

#: A bucket above this many rows is split when it is written.
BUCKET_ROWS = 4096
#: ``prefix`` is "b" and the leading bits; ``batch_id`` is the batch that wrote the bucket.
DIRECTORY = "prefix string, depth int, n_rows long, batch_id long"
COMMIT = "batch_id long, previous long, n_graded long, n_current long, with_sums boolean"
HASH_BITS = 64


def _stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """A stored table, or nothing where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def read_history(spark: SparkSession, folder: str, result_schema: StructType) -> DataFrame:
    """All graded rows with the batch that wrote them."""
    schema = StructType(list(result_schema.fields)).add("batch_id", LongType())
    found = _stored(spark, f"{folder}/results", schema)
    return spark.createDataFrame([], schema) if found is None else found


def read_commits(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each complete batch."""
    found = _stored(spark, f"{folder}/commits", COMMIT)
    return spark.createDataFrame([], COMMIT) if found is None else found


def read_buckets(spark: SparkSession, folder: str, result_schema: StructType, entries) -> DataFrame:
    """The rows of some entries of a directory."""
    paths = [f"{folder}/state/batch_id={e['batch_id']}/prefix={e['prefix']}" for e in entries if e["n_rows"]]
    return spark.read.schema(result_schema).parquet(*paths) if paths else spark.createDataFrame([], result_schema)


def directory_of(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    return _stored(spark, f"{folder}/directory/batch_id={batch_id}", DIRECTORY)


def _root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("b", 0, 0, None)], DIRECTORY)


def last_commit(spark: SparkSession, folder: str):
    """The commit of the newest complete batch; None before the first."""
    return read_commits(spark, folder).orderBy(F.desc("batch_id")).first()


def current_results(spark: SparkSession, folder: str, result_schema: StructType,
                    keys: Sequence[str]) -> DataFrame:
    """Newest graded row per key, from the current buckets."""
    commit = last_commit(spark, folder)
    if commit is None:
        return spark.createDataFrame([], result_schema)
    directory = directory_of(spark, folder, commit.batch_id)
    if directory is None:
        raise ValueError(f"batch {commit.batch_id} is committed, but its directory is missing")
    return read_buckets(spark, folder, result_schema, directory.filter("n_rows > 0").collect())  # one entry a bucket


def not_yet_graded(batch: DataFrame, history: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of a batch with no graded row of the same or a later version.

    A patched answer arrives with a higher version and so becomes pending again.
    Within the batch the highest version of a key is kept.
    """
    newest = last_per_key(batch, keys, F.col(version))
    seen = history.groupBy(*keys).agg(F.max(version).alias("_seen"))
    pending = F.coalesce(F.col(version) > F.col("_seen"), F.lit(True))
    return newest.join(seen, list(keys), "left").filter(pending).drop("_seen")


def _bits(keys: Sequence[str]) -> Column:
    return F.lpad(F.bin(F.xxhash64(*keys)), HASH_BITS, "0")


def _prefix(keys: Sequence[str], depth: Column) -> Column:
    return F.concat(F.lit("b"), F.substring(_bits(keys), F.lit(1), depth))


def located(rows: DataFrame, directory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the directory's entry of their bucket as ``_bucket``.

    Buckets differ in depth; a row is looked up once for each depth in use.
    """
    depths = [r[0] for r in directory.select("depth").distinct().collect()]  # at most 65
    entry = F.struct("prefix", "depth", "n_rows", "batch_id").alias("_bucket")
    looked = rows.withColumn("_prefix", F.explode(F.array(*[_prefix(keys, F.lit(d)) for d in depths])))
    return looked.join(directory.select(F.col("prefix").alias("_prefix"), entry), "_prefix").drop("_prefix")


def _entries(rows: DataFrame, directory: DataFrame, keys: Sequence[str]) -> list:
    """The entries of the buckets that some rows belong to; at most as many as there are buckets."""
    return located(rows.select(*keys), directory, keys).select("_bucket.*").distinct().collect()


def _write_state(spark: SparkSession, folder: str, result_schema: StructType, keys: Sequence[str], batch_id: int,
                 directory: DataFrame, rows: DataFrame, bucket_rows: int) -> None:
    """Write whole buckets anew from all their rows, split where they have grown, and the directory after that."""
    counts = located(rows, directory, keys).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    more = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / bucket_rows)).cast("int"))
    split = counts.select("_bucket.prefix", "_bucket.depth", F.least(more, F.lit(HASH_BITS) - F.col("_bucket.depth")).alias("more"))
    split.write.mode("overwrite").parquet(f"{folder}/splits/batch_id={batch_id}")
    split = spark.read.schema("prefix string, depth int, more int").parquet(f"{folder}/splits/batch_id={batch_id}")
    placed = located(rows, directory, keys).withColumn("prefix", F.col("_bucket.prefix")).join(
        split.select("prefix", "more"), "prefix").withColumn("prefix", _prefix(keys, F.col("_bucket.depth") + F.col("more")))
    columns = [f.name for f in result_schema]
    placed.select(*columns, "prefix").repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(
        f"{folder}/state/batch_id={batch_id}")
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more")) - 1
    child = F.explode(F.sequence(F.lit(0).cast("long"), last))
    children = split.withColumn("_i", child).select(
        F.when(F.col("more") == 0, F.col("prefix")).otherwise(
            F.concat("prefix", F.lpad(F.bin("_i"), F.col("more"), F.lit("0")))).alias("prefix"),
        (F.col("depth") + F.col("more")).alias("depth"))
    written = _stored(spark, f"{folder}/state/batch_id={batch_id}", StructType(list(result_schema.fields)).add("prefix", "string"))
    sizes = written.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_rows"))
    fresh = children.join(sizes, "prefix", "left").select(
        "prefix", "depth", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(batch_id).cast("long").alias("batch_id"))
    rest = directory.join(split.select("prefix"), "prefix", "left_anti")
    rest.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory/batch_id={batch_id}")


def _write_commit(spark: SparkSession, folder: str, batch_id: int, n_graded: int, metrics: bool) -> None:
    n_current = directory_of(spark, folder, batch_id).agg(F.sum("n_rows")).first()[0]
    row = (batch_id - 1 if batch_id else None, n_graded, n_current, metrics)
    spark.createDataFrame([row], "previous long, n_graded long, n_current long, with_sums boolean").coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/commits/batch_id={batch_id}")


def _write_sums(spark: SparkSession, folder: str, batch_id: int, sums: DataFrame) -> None:
    sums.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sums/batch_id={batch_id}")
    state = spark.read.schema(sums.schema).parquet(f"{folder}/sums/batch_id={batch_id}")
    snapshot_of(state).write.mode("overwrite").parquet(f"{folder}/snapshots/batch_id={batch_id}")


def _complete(spark: SparkSession, folder: str, batch_id: int, metrics: bool) -> bool:
    """Whether a batch is committed and what its commit says is there."""
    commit = read_commits(spark, folder).filter(F.col("batch_id") == batch_id).first()
    directory = directory_of(spark, folder, batch_id)
    if commit is None or directory is None or directory.agg(F.sum("n_rows")).first()[0] != commit.n_current:
        return False
    if not metrics:
        return True
    sums = _stored(spark, f"{folder}/sums/batch_id={batch_id}", "n long")
    return commit.with_sums and sums is not None and (sums.agg(F.sum("n")).first()[0] or 0) == commit.n_current


def rebuild(spark: SparkSession, folder: str, result_schema: StructType, keys: Sequence[str], batch_id: int,
            metrics: bool = True, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write state, sums and commit of a batch anew from the history up to it.

    The history must be whole: every batch has the rows that its commit counts, and a
    batch without a commit has some. If not, nothing is written and an error says which.
    """
    history = read_history(spark, folder, result_schema).filter(F.col("batch_id") <= batch_id)
    counts = {r["batch_id"]: r["n"] for r in history.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    commits = {r["batch_id"]: r["n_graded"] for r in read_commits(spark, folder).collect()}
    lost = [k for k in range(batch_id + 1) if counts.get(k, 0) != commits.get(k, counts.get(k))]
    if lost:
        raise ValueError(f"graded rows of batches {lost[:10]} are missing below {folder}; the state cannot be rebuilt")
    current = last_per_key(history, keys, F.col("batch_id")).drop("batch_id")
    _write_state(spark, folder, result_schema, keys, batch_id, _root(spark), current, bucket_rows)
    if metrics:
        entries = directory_of(spark, folder, batch_id).collect()
        _write_sums(spark, folder, batch_id, snapshot_parts(read_buckets(spark, folder, result_schema, entries)))
    _write_commit(spark, folder, batch_id, counts.get(batch_id, 0), metrics)


def grade_batch(batch: DataFrame, batch_id: int, grade: Callable[[DataFrame], DataFrame], result_schema: StructType,
                keys: Sequence[str], folder: str, version: str, metrics: bool = True, bucket_rows: int = BUCKET_ROWS) -> None:
    """Grade what is pending in one batch and bring the state up to date.

    A predecessor that is not complete is rebuilt from the history first.
    """
    spark, columns = batch.sparkSession, [f.name for f in result_schema]
    if batch_id and not _complete(spark, folder, batch_id - 1, metrics):
        rebuild(spark, folder, result_schema, keys, batch_id - 1, metrics, bucket_rows)
    directory = directory_of(spark, folder, batch_id - 1) if batch_id else _root(spark)
    earlier = read_buckets(spark, folder, result_schema, _entries(batch, directory, keys))
    graded = grade(not_yet_graded(batch, earlier, keys, version)).select(*columns)
    graded.write.mode("overwrite").parquet(f"{folder}/results/batch_id={batch_id}")
    written = spark.read.schema(result_schema).parquet(f"{folder}/results/batch_id={batch_id}")
    changed = read_buckets(spark, folder, result_schema, _entries(written, directory, keys))
    kept = changed.join(written.select(*keys), list(keys), "left_anti")
    _write_state(spark, folder, result_schema, keys, batch_id, directory, kept.unionByName(written), bucket_rows)
    if metrics:
        replaced = changed.join(written.select(*keys), list(keys), "left_semi")
        change = added(snapshot_parts(written), negated(snapshot_parts(replaced)))
        if batch_id:
            change = added(spark.read.schema(change.schema).parquet(f"{folder}/sums/batch_id={batch_id - 1}"), change)
        _write_sums(spark, folder, batch_id, change)
    _write_commit(spark, folder, batch_id, written.count(), metrics)


def grade_stream(
    answers: DataFrame,
    grade: Callable[[DataFrame], DataFrame],
    result_schema: StructType,
    keys: Sequence[str],
    folder: str,
    version: str = "version",
    metrics: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> None:
    """Grade everything available on the answer stream, then stop.

    ``folder`` must be reachable by every executor; it holds the results, the state, the
    metric snapshots and the stream's checkpoint. ``grade`` must keep the key and
    version columns and yield the columns of ``result_schema``. ``bucket_rows`` may
    change between runs.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        grade_batch(batch, batch_id, grade, result_schema, keys, folder, version, metrics, bucket_rows)

    query = (
        answers.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stored_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The metric snapshot of the newest complete batch."""
    commit = last_commit(spark, folder)
    if commit is None or not _complete(spark, folder, commit.batch_id, True):
        raise ValueError(f"the newest batch below {folder} has no complete snapshot")
    return spark.read.parquet(f"{folder}/snapshots/batch_id={commit.batch_id}")


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType,
                 files_per_batch: int | None = None) -> DataFrame:
    """Stream one Parquet table of a folder, stored as one file or as a folder of part files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a pattern that only this name fits: Spark takes a file there as well as a folder
    return reader.parquet(f"{folder}/{name}.parque[t]")
