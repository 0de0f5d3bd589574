"""Queries that SQL can express, against DuckDB on the small tables and on odd rows."""

import duckdb
import pytest

from kinelake.llm.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"

TABLES = "documents benchmark labels pages".split()


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR if not folder else folder}/{t}.parquet{'/*.parquet' if folder else ''}')")
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries()[name](spark, folder or SF_DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_small_tables(spark, name):
    compare(spark, None, name)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_odd_rows(spark, odd, tmp_path, name):
    # SQL counts documents by id, so repeated ids and NULL ids are left to test_edges.
    odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    for t in TABLES[1:]:
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    compare(spark, str(tmp_path), name)
