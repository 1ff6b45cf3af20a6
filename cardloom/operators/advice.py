"""Matches of benefits to spending, overlaps, verdicts and switch advice, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions.numeric import percent
from cardloom.operators.spending import covered_amount, user_spending

KEEP_FROM, MIDDLE_FROM, OVERLAP_PENALTY, ALTERNATIVES = 60, 40, 12, 3


def fit_band(fit: Column) -> Column:
    return F.when(fit >= KEEP_FROM, "high").when(fit >= MIDDLE_FROM, "mid").otherwise("low")


def rank_by_fit(fit: DataFrame) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("fit"), "candidate_pos")
    return fit.select("user_id", "card_id", "fit", fit_band(F.col("fit")).alias("band"), F.row_number().over(order).cast("long").alias("place"))


def owned_benefits(owned: DataFrame, benefits: DataFrame) -> DataFrame:
    """Benefits of the cards that users own; candidates' benefits are few rows."""
    return owned.select("user_id", "card_id").join(benefits.select("card_id", "benefit_id", "benefit_pos", "category_id"), "card_id")


def matched_benefits(owned: DataFrame, spend: DataFrame, match_map: DataFrame) -> DataFrame:
    """Owned benefits whose category matches some spending of the user."""
    wanted = spend.join(F.broadcast(match_map), "spend_category").select("user_id", "category_id").distinct()
    return owned.join(wanted, ["user_id", "category_id"], "left_semi").select("user_id", "card_id", "benefit_id", "category_id")


def overlap_categories(sets: DataFrame, benefits: DataFrame, key: str = "user_id", with_cards: bool = True) -> DataFrame:
    """Categories that more than one benefit row of a set of cards has, and which cards these are."""
    rows = sets.select(key, "card_id").join(benefits.select("card_id", "category_id"), "card_id").groupBy(key, "category_id")
    told = [F.concat_ws(",", F.transform(F.array_sort(F.collect_set("card_id")), lambda x: x.cast("string"))).alias("cards")] if with_cards else []
    return rows.agg(F.count(F.lit(1)).alias("n"), *told).filter("n > 1")


def benefit_status(owned: DataFrame, spend: DataFrame, match_map: DataFrame) -> DataFrame:
    """Overlap, else active with the first matching spending (in the order of spend_category), else unused."""
    seen = spend.join(F.broadcast(match_map), "spend_category").groupBy("user_id", "category_id").agg(F.min_by("amount", "spend_category").alias("matched"))
    count = F.count(F.lit(1)).over(W.partitionBy("user_id", "category_id"))
    rows = owned.withColumn("n", count).join(seen, ["user_id", "category_id"], "left")
    status = F.when(F.col("n") > 1, "overlap").when(F.col("matched").isNotNull(), "active").otherwise("unused")
    return rows.select("user_id", "card_id", "benefit_id", status.alias("status"), F.when(status == "active", F.col("matched")).alias("matched"))


def combo_coverage(combos: DataFrame, coverage: DataFrame, spend: DataFrame) -> DataFrame:
    """Percent of each user's spending that some card of the combination covers. ``coverage`` has one array a card."""
    union = combos.join(coverage, "card_id", "left").groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("covered", F.array().cast("array<bigint>"))))).alias("covered"))
    rows = union.join(user_spending(spend), "user_id")
    return rows.select("user_id", percent(covered_amount(F.col("by_category"), F.col("covered")), F.col("total")).alias("coverage"))
