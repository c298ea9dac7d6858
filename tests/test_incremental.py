"""Incremental grading: what a batch reads, how buckets split, and what happens when a part is lost."""

import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from gradeframe.operators import agreement as ag
from gradeframe.streaming import incremental as inc

RESULT = StructType()
for _name, _kind in (("k", LongType()), ("version", LongType()), ("question_type", StringType()), ("final_score", DoubleType()),
                     ("max_marks", DoubleType()), ("similarity_score", DoubleType()),
                     ("mcq_detected_answer", StringType()), ("mcq_correct_answer", StringType())):
    RESULT.add(_name, _kind)


def answers(spark, start, stop, version=1):
    return spark.range(start, stop).select(F.col("id").alias("k"), F.lit(version).cast("long").alias("version"))


def graded(rows):
    return rows.select(
        "k", "version", F.lit("open_ended").alias("question_type"), ((F.col("k") + F.col("version")) % 11).cast("double").alias("final_score"),
        F.lit(10.0).alias("max_marks"), (F.col("k") % 10 / 10).alias("similarity_score"),
        F.lit(None).cast("string").alias("mcq_detected_answer"), F.lit(None).cast("string").alias("mcq_correct_answer"))


def run(spark, folder, batch_id, rows, **more):
    inc.grade_batch(rows, batch_id, graded, RESULT, ["k"], str(folder), "version", **more)


def state(spark, folder):
    rows = inc.current_results(spark, str(folder), RESULT, ["k"]).collect()
    assert len({r.k for r in rows}) == len(rows)
    return {r.k: (r.version, r.final_score) for r in rows}


def wanted(changes):
    out = {}
    for start, stop, version in changes:
        out.update({k: (version, float((k + version) % 11)) for k in range(start, stop) if version > out.get(k, (0,))[0]})
    return out


def bytes_read(spark, job):
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    job()
    return read() - before


def plain_snapshot(spark, folder):
    row = ag.snapshot(inc.current_results(spark, str(folder), RESULT, ["k"])).first()
    return row.total_evaluated, row.open_ended


def test_a_batch_reads_what_its_keys_need(spark, tmp_path):
    seen = {}
    for name, size in (("small", 400), ("large", 40_000)):
        run(spark, tmp_path / name, 0, answers(spark, 0, size), bucket_rows=64)
        seen[name] = bytes_read(spark, lambda: run(spark, tmp_path / name, 1, answers(spark, 7, 10, 2), bucket_rows=64))
        stored = sum(f.stat().st_size for f in (tmp_path / name / "state" / "batch_id=0").rglob("*.parquet"))
        seen[name + " state"] = stored
        assert state(spark, tmp_path / name) == wanted([(0, size, 1), (7, 10, 2)])
    assert seen["large state"] > 50 * seen["small state"]
    assert seen["large"] < 3 * seen["small"]


def test_buckets_split_as_they_fill_and_only_those_that_changed(spark, tmp_path):
    changes = [(0, 100, 1), (50, 400, 1), (0, 5, 2), (400, 1500, 1), (0, 1500, 1)]
    for k, (start, stop, version) in enumerate(changes):
        run(spark, tmp_path, k, answers(spark, start, stop, version), bucket_rows=100)
        assert state(spark, tmp_path) == wanted(changes[:k + 1])
        entries = inc.directory_of(spark, str(tmp_path), k).collect()
        assert sum(2.0 ** -e.depth for e in entries) == 1 and max(e.n_rows for e in entries) <= 200
        assert sum(e.n_rows for e in entries) == len(wanted(changes[:k + 1]))
    before = {e.prefix for e in inc.directory_of(spark, str(tmp_path), 1).collect()}
    third = inc.directory_of(spark, str(tmp_path), 2).collect()
    assert sum(e.batch_id == 2 for e in third) <= 5 and len(before) >= 4
    assert not [e for e in inc.directory_of(spark, str(tmp_path), 4).collect() if e.batch_id == 4]  # nothing was pending
    commits = inc.read_commits(spark, str(tmp_path)).orderBy("batch_id").collect()
    assert [(c.previous, c.n_graded) for c in commits] == [(None, 100), (0, 300), (1, 5), (2, 1100), (3, 0)]


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    run(spark, tmp_path, 0, answers(spark, 0, 300), bucket_rows=50)
    for _ in range(2):
        run(spark, tmp_path, 1, answers(spark, 100, 350, 2), bucket_rows=50)
        assert state(spark, tmp_path) == wanted([(0, 300, 1), (100, 350, 2)])
        row = inc.stored_snapshot(spark, str(tmp_path)).first()
        assert (row.total_evaluated, row.open_ended) == plain_snapshot(spark, tmp_path)


@pytest.mark.parametrize("lost", ["commits", "sums", "directory"])
def test_a_lost_predecessor_is_rebuilt(spark, tmp_path, lost):
    run(spark, tmp_path, 0, answers(spark, 0, 200), bucket_rows=50)
    run(spark, tmp_path, 1, answers(spark, 150, 260, 2), bucket_rows=50)
    shutil.rmtree(tmp_path / lost / "batch_id=1")
    run(spark, tmp_path, 2, answers(spark, 250, 300, 3), bucket_rows=50)
    assert state(spark, tmp_path) == wanted([(0, 200, 1), (150, 260, 2), (250, 300, 3)])
    row = inc.stored_snapshot(spark, str(tmp_path)).first()
    assert (row.total_evaluated, row.open_ended) == plain_snapshot(spark, tmp_path)


def test_lost_results_stop_the_next_batch(spark, tmp_path):
    run(spark, tmp_path, 0, answers(spark, 0, 50))
    run(spark, tmp_path, 1, answers(spark, 50, 60))
    shutil.rmtree(tmp_path / "sums" / "batch_id=1")
    shutil.rmtree(tmp_path / "results" / "batch_id=0")
    with pytest.raises(ValueError, match=r"\[0\]"):
        run(spark, tmp_path, 2, answers(spark, 60, 70))
    shutil.rmtree(tmp_path / "snapshots")
    with pytest.raises(ValueError):
        inc.stored_snapshot(spark, str(tmp_path))


def test_metrics_may_be_left_out_for_a_while(spark, tmp_path):
    run(spark, tmp_path, 0, answers(spark, 0, 80))
    run(spark, tmp_path, 1, answers(spark, 60, 90, 2), metrics=False)
    run(spark, tmp_path, 2, answers(spark, 85, 99, 3))
    row = inc.stored_snapshot(spark, str(tmp_path)).first()
    assert (row.total_evaluated, row.open_ended) == plain_snapshot(spark, tmp_path)


def test_batches_do_not_follow_the_files_of_the_table(spark, tmp_path):
    """The patched turns came in one file a partition of the table, two of them a batch."""
    from gradeframe.checks import stream_checks
    from gradeframe.checks.registry import Tables

    rows = spark.range(48).select((F.col("id") % 12).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("said so").alias("text"))
    rows.repartition(24).write.parquet(f"{tmp_path}/conversations.parquet")
    table = Tables(spark, str(tmp_path))
    assert table.conversations.rdd.getNumPartitions() > 6
    folder = stream_checks._run(table)
    commits = inc.read_commits(spark, folder).orderBy("batch_id").collect()
    assert [c.batch_id for c in commits] == [0, 1, 2, 3] and commits[-1].n_current == 48
    assert sum(c.n_graded for c in commits) == 96
