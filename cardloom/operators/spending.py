"""Spending: totals, shares, fit of cards, usage. Keyed by ``user_id`` throughout; what is card-side is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions.numeric import percent


def spend_by_category(tx: DataFrame, since=None, until=None) -> DataFrame:
    """``user_id, spend_category, amount`` from raw transactions, with an optional half-open period of ``ts``."""
    rows = tx
    if since is not None:
        rows = rows.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("ts") < F.lit(until))
    return rows.groupBy("user_id", "spend_category").agg(F.sum("amount").alias("amount"))


def spend_summary(spend: DataFrame) -> DataFrame:
    """Total, categories, the top category (the last of equal ones) and its share."""
    top = F.max(F.struct("amount", "spend_category"))
    rows = spend.groupBy("user_id").agg(F.sum("amount").alias("total"), F.count("spend_category").alias("n_categories"), top.alias("top"))
    return rows.select("user_id", "total", "n_categories", F.col("top.spend_category").alias("top_category"), percent(F.col("top.amount"), F.col("total")).alias("top_share"))


def spend_share(spend: DataFrame) -> DataFrame:
    """Each category's share of its user's total, and its place from high to low."""
    user = W.partitionBy("user_id")
    return spend.select("user_id", "spend_category", "amount", percent(F.col("amount"), F.sum("amount").over(user)).alias("share"), F.row_number().over(user.orderBy(F.desc("amount"), "spend_category")).cast("long").alias("place"))


def spend_coverage(benefits: DataFrame, match_map: DataFrame) -> DataFrame:
    """``card_id, spend_category``: spending that some benefit of the card matches, once each."""
    return benefits.join(F.broadcast(match_map), "category_id").select("card_id", "spend_category").distinct()


def covered_categories(benefits: DataFrame, match_map: DataFrame) -> DataFrame:
    """The coverage as one array a card."""
    return spend_coverage(benefits, match_map).groupBy("card_id").agg(F.collect_set("spend_category").alias("covered"))


def user_spending(spend: DataFrame) -> DataFrame:
    """One row per user: total and a map of at most as many entries as there are categories."""
    return spend.groupBy("user_id").agg(F.sum("amount").alias("total"), F.map_from_entries(F.collect_list(F.struct("spend_category", "amount"))).alias("by_category"))


def covered_amount(by_category: Column, covered: Column) -> Column:
    """Spending in the covered categories."""
    return F.aggregate(F.coalesce(covered, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(F.try_element_at(by_category, c), F.lit(0)))


def card_fit(spend: DataFrame, coverage: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fit of every candidate for every user: percent of the amount in covered categories; null for a total of 0.

    Candidates are one card an issuer, with their coverage in one array each; users meet them in an array
    of candidates, so transactions never join benefits and the grid needs no second shuffle.
    """
    cards = candidates.join(coverage, "card_id", "left").select(F.struct("card_id", "candidate_pos", F.coalesce("covered", F.array().cast("array<bigint>")).alias("covered")).alias("c"))
    grid = cards.agg(F.sort_array(F.collect_list("c")).alias("cards"))
    rows = user_spending(spend).join(F.broadcast(grid), F.lit(True)).select("user_id", "total", "by_category", F.inline("cards"))
    return rows.select("user_id", "card_id", "candidate_pos", percent(covered_amount(F.col("by_category"), F.col("covered")), F.col("total")).alias("fit"))


def card_usage(tx: DataFrame, limits: DataFrame, month: Column, months: int = 3) -> DataFrame:
    """This month's and the last ``months`` months' spend per user and card, and the month's percent of the limit. ``month`` is the first instant of the month."""
    after = F.add_months(month, 1)
    window = tx.filter((F.col("ts") >= F.add_months(month, 1 - months)) & (F.col("ts") < after))
    sums = window.groupBy("user_id", "card_id").agg(F.sum(F.when(F.col("ts") >= month, F.col("amount")).otherwise(0)).alias("this_month"), F.sum("amount").alias("last_months"))
    return sums.join(limits, "user_id").select("user_id", "card_id", "this_month", "last_months", "card_limit", percent(F.col("this_month"), F.col("card_limit")).alias("used"))
