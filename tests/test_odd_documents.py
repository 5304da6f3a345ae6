"""Queries over documents that the tables do not have: none, empty, and with null bytes."""

import duckdb
import pytest

from paperloom import plans

from .compare import assert_same


@pytest.mark.parametrize("name", ["s14_text_validation"])
def test_odd_documents(name, spark, tmp_path):
    texts = [None, "", "a\0b", " ", "é" * 1999, "é" * 2000, "x" * 3998, "x" * 3999, "x" * 4000, "x" * 4001]
    rows = [(4 * i + k, text) for i, text in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert_same(plans.QUERIES[name](spark, str(tmp_path)), con, plans.SQL[name])
