"""Queries against their SQL twins where documents have no text, no words, no id or come twice."""

import duckdb
import pytest

import oracle_check
from loomery import plans

QUERIES, SQL = plans.load()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    lines = "\n".join(f"Line {i} has some words of a text that is long enough to be cut into chunks, {i}." for i in range(120))
    rows = [
        (1, "HEAD\n\nA first line.\n  \nA second one.", "src1"),
        (2, None, "src1"),
        (3, "", "src1"),
        (4, " \n\t\n ", "src2"),
        (5, lines, "src2"),
        (6, lines + "\nthe end", "src3"),
        (6, lines + "\nthe end", "src3"),
        (7, "The same.\n\nThe same.", "src3"),
        (7, "The same.\n\nThe same.", "src3"),
        (8, None, None),
        (8, "Only one of two has a text.", None),
        (None, "A text without an id.", "src1"),
    ]
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def con(odd):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["document_detail", "parsed_summary"])
def test_query(spark, con, odd, name):
    got = QUERIES[name](spark, odd).toPandas()
    assert oracle_check.compare(got, con.execute(SQL[name]).df()) is None
