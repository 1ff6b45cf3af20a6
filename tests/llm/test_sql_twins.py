import pytest

from cardloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, db, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = db.sql(f'SELECT {", ".join(cols)} FROM ({queries.oracle_sql()[name]})').fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))
