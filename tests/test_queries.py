"""Every card query against its SQL twin, and the shape of the plans that matter."""

import duckdb
import pytest

from cardloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr([None if v is None else int(v) if hasattr(v, "as_tuple") and v == int(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, db, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    sql = f'SELECT {", ".join(cols)} FROM ({registry.oracle_sql()[name]})'
    assert plain(df.select(*cols).collect()) == plain(db.sql(sql).fetchall())


def test_mapping_counts(spark, sf_dir):
    from cardloom.sources.fixtures import Domain

    if not sf_dir.endswith("sf0.001"):
        pytest.skip("counts are those of the smallest tables")
    d = Domain(spark, sf_dir)
    b = d.benefit
    assert (b.count(), b.filter("benefit_value IS NOT NULL").count(), b.filter("max_limit IS NOT NULL").count()) == (1707, 1592, 1700)
    assert (d.bridge.count(), d.bridge.select("benefit_id").distinct().count()) == (2265, 1543)
    assert (d.transactions.count(), d.owned.count(), d.engagement.count()) == (6000, 414, 398)
    assert b.filter("benefit_title IS NULL AND benefit_content IS NULL").count() == 107


def test_scores_need_one_exchange_of_benefits(spark, sf_dir):
    plan = registry.queries()["practicality_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the mapping's row numbers, and the sum by card


@pytest.mark.parametrize("name", ["card_verdicts", "switch_alternatives", "recommended_combo"])
def test_advice_is_one_exchange_by_user(spark, sf_dir, name):
    initial = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert initial.count("Exchange hashpartitioning(user_id") == 1
    assert initial.count("Exchange hashpartitioning(company") == 1  # the candidates' window stands there once


def test_basket(spark, sf_dir):
    rows = registry.queries()["compare_basket"](spark, sf_dir).collect()
    assert rows and all(len(r.basket.split(",")) <= 3 for r in rows)
