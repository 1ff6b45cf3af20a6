import glob

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, fp long, digest string, host string, n long, uid long, word string"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(sf_dir):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, columns whose names clash with those that operators use."""
    long = " ".join(f"word{i % 977} Tail{i % 13}" for i in range(60_000))
    rows = [(1, "a b c d"), (2, None), (3, ""), (4, " \n "), (5, long), (6, "a b c d"), (6, "a b c d"), (None, "a b c d"), (None, None), (7, "a\x00b ｃ 　é</s>[INST]"), (8, long)]
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "x", "h", 4, 5, "w") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.filter("doc_id > 1000")


@pytest.fixture(scope="session")
def db(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return c
