"""Every registered query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import compare, duck

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert compare(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_corrected_texts_of_odd_rows(spark, tmp_path):
    """One row each for rows without words, of one key or without a key; in the SQL as well."""
    said = [(1, 0, "Pipelnie, pipeline."), (2, 0, " é "), (2, 1, None), (3, 0, "An pipeline."), (3, 0, "It pipelin."),
            (None, 0, "Pipelnie."), (None, None, "Pipelin!"), (4, 0, "pipeline " * 6000)]
    rows = spark.createDataFrame([(a, b, "user", c) for a, b, c in said], "conv_id long, turn long, role string, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = entry.queries()["corrected_texts"](spark, str(tmp_path)).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()["corrected_texts"]).df()) is None
    assert sorted(got["text"]) == sorted([
        "Pipeline, pipeline.", "", "", "An pipeline.", "It pipeline.", "Pipeline.", "Pipeline!", "pipeline " * 5999 + "pipeline"])


@pytest.mark.parametrize("name", ["upserted_questions", "resolved_questions", "kept_regions"])
@pytest.mark.parametrize("shift, kind", [(1_000_000, "bigint"), (54_000_000, "decimal(33,0)")])
def test_question_ids_of_large_order_keys(spark, tmp_path, name, shift, kind):
    """Ids beyond 64 bits are exact; the same SQL over 128-bit keys gives them too."""
    con = duckdb.connect()
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        file = f"{tmp_path}/{table}.parquet"
        con.execute(f"COPY (SELECT * REPLACE ({key} + {shift} AS {key}) FROM '{SMALL}/{table}.parquet') TO '{file}'")
        con.execute(f"CREATE VIEW {table} AS SELECT * REPLACE ({key}::HUGEINT AS {key}) FROM '{file}'")
    got = QUERIES[name](spark, str(tmp_path))
    assert dict(got.dtypes)["id"] == kind
    want = con.execute(f"SELECT id::VARCHAR FROM ({SQL[name]})").fetchall()
    assert sorted(str(r.id) for r in got.collect()) == sorted(w[0] for w in want)
