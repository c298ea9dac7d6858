"""The pipeline against a plain chain of its rules on a small table, and its guard."""

import corpus_pipeline
from gradeframe.llm import checks

from .cases import documents, odd_documents, prose


def write_tables(spark, folder, rows, items):
    frame = documents(spark, rows).selectExpr("doc_id", "text", "lang", "'s' AS source", "length(text) AS n_chars")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return frame


def test_stages_take_effect(spark, tmp_path):
    passage = prose(300, 14)
    rows = [(i, prose(i, 120) + ".", "en") for i in range(30)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " one more word", "en"), (102, prose(101, 60) + " " + passage + ".", "en"),
             (103, " | ".join(prose(5, 80).split()), "en"), (104, "short", "en"), (105, None, "en")]
    rows += [(200 + i, " | ".join(prose(600 + i, 80).split()), "en") for i in range(8)]
    block = "\n".join(prose(s, 15) + "." for s in range(400, 404))
    rows += [(106, prose(106, 90) + ".\n" + block, "en"), (107, block + "\n" + prose(107, 90) + ".", "en")]
    frame = write_tables(spark, tmp_path, rows, [(1, passage)])
    docs = frame
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"out-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == frame.columns
    good = set(range(30)) | {100, 101, 102, 106, 107}
    assert set(kept["quality_rules"]) == good
    assert block in kept["line_dedup"][106].text and block not in kept["line_dedup"][107].text
    assert set(kept["minhash"]) == good - {100, 101}
    assert set(kept["decontamination"]) == set(kept["packing"]) == good - {100, 101, 102}
    ran = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect()}


def test_pipeline_over_nothing_and_over_odd_rows(spark, tmp_path):
    write_tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    write_tables(spark, tmp_path / "odd", odd_documents(), [(1, None), (2, "")])
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).count() > 0


def test_every_operator_has_one_query():
    numbers = sorted(int(name.split("_")[0][2:]) for name in checks.QUERIES)
    assert numbers == list(range(1, 14))
