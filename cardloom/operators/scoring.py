"""Five scores of every card for every persona.

Benefits carry their category ids as an array, so the persona weights come from a literal map and the
best weight of a benefit is a function of its row: one exchange by ``card_id`` sums everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.numeric import reverse_score, whole_div
from cardloom.sources import dims

FEE_BASE, PERFORMANCE_BASE, LIMIT_BASE, ALL_CATEGORIES = 50_000, 1_000_000, 50_000, 12


def annual_fee_score(fee: Column) -> Column:
    return reverse_score(fee, FEE_BASE)


def performance_score(performance: Column) -> Column:
    return reverse_score(performance, PERFORMANCE_BASE)


def persona_key(persona: Column) -> Column:
    """Upper-cased; omitted is the default persona, an unknown one weighs like another known one."""
    key = F.upper(persona)
    return F.when(persona.isNull(), dims.DEFAULT_PERSONA).when(key.isin(*dims.PERSONAS), key).otherwise(dims.UNKNOWN_PERSONA)


def best_weight(category_ids: Column, persona: str) -> Column:
    """Largest weight of a benefit's categories in ten-thousandths, never under the lowest."""
    high, middle = dims.PERSONAS[persona]
    overlaps = lambda ids: F.arrays_overlap(category_ids, F.array(*[F.lit(i).cast("long") for i in ids]))
    return F.when(overlaps(high), dims.HIGH_WEIGHT).when(overlaps(middle), dims.MIDDLE_WEIGHT).otherwise(dims.LOW_WEIGHT).cast("long")


def _practicality(persona: str) -> Column:
    """Aggregate: values capped at 15 weigh in; benefits without value or category are skipped. In integers, so that order of summation is without effect."""
    value = (F.least(F.col("benefit_value"), F.lit(15).cast("decimal(12,2)")) * 100).cast("long")
    counted = F.col("benefit_value").isNotNull() & (F.size("category_ids") > 0)
    total = F.coalesce(F.sum(F.when(counted, value * best_weight(F.col("category_ids"), persona))), F.lit(0))
    return F.least(F.lit(100).cast("long"), whole_div(total * 200 + 15_000_000, F.lit(30_000_000)))


def diversity(count: Column) -> Column:
    """12 distinct categories are 100."""
    return F.least(F.lit(100).cast("long"), whole_div(count * 100, F.lit(ALL_CATEGORIES)))


def _limit() -> Column:
    """Aggregate: one unlimited benefit with a value is 100; else the limits' sum over its base, halves up."""
    open_end = F.coalesce(F.bool_or(F.col("max_limit").isNull() & F.col("benefit_value").isNotNull()), F.lit(False))
    total = F.coalesce(F.sum("max_limit"), F.lit(0))
    return F.when(open_end, F.lit(100).cast("long")).otherwise(F.least(F.lit(100).cast("long"), whole_div(total * 200 + LIMIT_BASE, F.lit(2 * LIMIT_BASE))))


def benefit_scores(benefits: DataFrame) -> DataFrame:
    """``card_id, practicality (array by persona), diversity_score, limit_score``: one pass over the benefits. Distinct categories are 21 at most."""
    practicality = F.array(*[F.struct(F.lit(p).alias("persona"), _practicality(p).alias("practicality_score")) for p in dims.PERSONAS])
    distinct = F.size(F.array_distinct(F.flatten(F.collect_set("category_ids"))))
    return benefits.groupBy("card_id").agg(practicality.alias("practicality"), diversity(distinct.cast("long")).alias("diversity_score"), _limit().alias("limit_score"))


def practicality_score(benefits: DataFrame) -> DataFrame:
    return benefit_scores(benefits).select("card_id", F.inline("practicality"))


def diversity_score(benefits: DataFrame) -> DataFrame:
    return benefit_scores(benefits).select("card_id", "diversity_score")


def limit_score(benefits: DataFrame) -> DataFrame:
    return benefit_scores(benefits).select("card_id", "limit_score")


def fee_performance_score(cards: DataFrame) -> DataFrame:
    return cards.select("card_id", annual_fee_score(F.col("annual_fee_dom_basic")).alias("annual_fee_score"), performance_score(F.col("min_performance")).alias("performance_score"))


def card_scores(cards: DataFrame, benefits: DataFrame) -> DataFrame:
    """One row per card and persona. A card without benefits scores 0 where benefits count."""
    joined = fee_performance_score(cards).join(benefit_scores(benefits), "card_id", "left")
    none = F.array(*[F.struct(F.lit(p).alias("persona"), F.lit(0).cast("long").alias("practicality_score")) for p in dims.PERSONAS])
    filled = joined.select("card_id", "annual_fee_score", "performance_score", F.coalesce("diversity_score", F.lit(0)).alias("diversity_score"), F.coalesce("limit_score", F.lit(0)).alias("limit_score"), F.coalesce("practicality", none).alias("practicality"))
    return filled.select("card_id", "annual_fee_score", "performance_score", "diversity_score", "limit_score", F.inline("practicality"))
