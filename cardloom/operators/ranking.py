"""Popularity from views and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions.numeric import percent
from cardloom.sources.io import stored


def engagement_monthly(events: DataFrame) -> DataFrame:
    """Views and clicks per card and month; counted before anything is ranked, so hot cards are cheap."""
    month = F.date_trunc("month", "ts").cast("date").alias("month")
    return events.groupBy(month, "card_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))


def filter_ranked(rows: DataFrame, allowed: list[str] | None = None, card_type: str | None = None, issuer: str | None = None) -> DataFrame:
    if allowed is not None:
        rows = rows.filter(F.col("company").isin(allowed))
    if card_type:
        rows = rows.filter(F.col("card_type") == card_type)
    return rows.filter(F.col("company") == issuer) if issuer else rows


def medal(place: Column) -> Column:
    return F.when(place <= 3, place)


def placed(rows: DataFrame, scope: list[str], order: list[Column], most: str) -> DataFrame:
    """Adds ``place``, from 1 within each scope in the given order, and ``top``, the scope's largest ``most``; no task ever holds a whole scope.

    Rows are range-partitioned by scope and order and stored with their number within the partition. What a scope has
    in a partition is one small row; the places before it are the sum of such rows, and the top is their maximum.
    Rows that are equal in scope and order must be interchangeable: give an order without ties, or ties get any places.
    """
    ranged = rows.repartitionByRange(*scope, *order).sortWithinPartitions(*scope, *order).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id"), "ranked")
    pieces = ranged.groupBy(*scope, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max(most).alias("_top"))
    listed = pieces.groupBy(*scope).agg(F.collect_list(F.struct("_part", "_first", "_n")).alias("_pieces"), F.max("_top").alias("top"))
    before = lambda p: F.aggregate(F.filter("_pieces", lambda q: q["_part"] < p["_part"]), F.lit(0).cast("long"), lambda a, q: a + q["_n"])
    based = listed.select(*(F.col(c).alias(f"_of_{c}") for c in scope), "top", F.inline(F.transform("_pieces", lambda p: F.struct(p["_part"].alias("_in"), (before(p) - p["_first"]).alias("_base")))))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in scope]
    met = ranged.join(based, [*same, F.col("_part") == F.col("_in")])
    return met.select(*rows.columns, (F.col("_at") + F.col("_base") + 1).alias("place"), "top")


def popularity_ranking(rows: DataFrame, scope: list[str]) -> DataFrame:
    """``rows (scope, card_id, views, clicks)`` ranked by views and clicks in each scope; ``bar`` is the percent of the scope's top score."""
    scored = rows.withColumn("score", F.col("views") + F.col("clicks")).select(*scope, "card_id", "score")
    ranked = placed(scored, scope, [F.desc("score"), F.asc("card_id")], "score")
    return ranked.select(*scope, "card_id", "score", "place", percent(F.col("score"), F.col("top")).alias("bar"), medal(F.col("place")).alias("medal"))


def with_issuer_meta(rows: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    """Left join with the issuers' own table, which has one row an issuer."""
    return rows.join(meta, on, "left")


def issuer_top_n(cards: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` cards of each issuer by stored rank; no rank counts as 99."""
    order = W.partitionBy("company").orderBy(F.coalesce("card_rank", F.lit(99)), "card_id")
    return cards.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n).select("company", "card_id", "place")


def candidate_cards(ranked: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """The first card with rank 1 of each issuer; ``issuers (company, issuer_pos)`` gives the order, else the name does."""
    best = ranked.filter("card_rank = 1").groupBy("company").agg(F.min("card_id").alias("card_id"))
    if issuers is not None:
        return best.join(issuers, "company").select("company", "card_id", F.col("issuer_pos").alias("candidate_pos"))
    return best.select("company", "card_id", (F.row_number().over(W.orderBy("company")) - 1).cast("long").alias("candidate_pos"))
