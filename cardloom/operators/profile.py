"""The advice chain as functions of one row a user: what they spend, what they own, and all candidate cards in one array.

Transactions and owned cards meet in one exchange by user, with partial sums before it. Everything after it, from the
fit of each candidate to the recommended combination, is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.numeric import percent
from cardloom.operators.advice import ALTERNATIVES, KEEP_FROM, OVERLAP_PENALTY
from cardloom.operators.spending import covered_amount

CATEGORY_COUNTS = "array<struct<category_id: bigint, n: bigint>>"


def candidate_grid(candidates: DataFrame, benefits: DataFrame, match_map: DataFrame) -> DataFrame:
    """One row: ``cards``, the candidates in their order, each with the spending it covers and how many benefit rows of a category it has.

    ``candidates (card_id, candidate_pos)`` has one card an issuer; ``benefits (card_id, category_id)`` are counted
    to (card, category) before anything is gathered, so a card with many benefits is as many entries as categories.
    """
    counts = candidates.select("card_id", "candidate_pos").join(benefits.select("card_id", "category_id"), "card_id", "left").groupBy("card_id", "candidate_pos", "category_id").agg(F.count("category_id").alias("n"))
    rows = counts.groupBy("card_id", "candidate_pos").agg(F.array_sort(F.collect_list(F.when(F.col("category_id").isNotNull(), F.struct("category_id", "n")))).alias("rows"))
    known = match_map.agg(F.collect_set(F.struct("category_id", "spend_category")).alias("known"))
    has = lambda m: F.exists("rows", lambda r: r["category_id"] == m["category_id"])
    covered = F.array_distinct(F.transform(F.filter("known", has), lambda m: m["spend_category"]))
    cards = rows.join(F.broadcast(known), F.lit(True)).select(F.struct("candidate_pos", "card_id", covered.alias("covered"), "rows").alias("c"))
    return cards.agg(F.sort_array(F.collect_list("c")).alias("cards"))


def user_profiles(tx: DataFrame, owned: DataFrame, categories: list) -> DataFrame:
    """``user_id, total, by_category, owned`` of every user with transactions, by one exchange.

    ``categories`` are the spending categories that some card can cover, a dimension of few values; what is spent on
    others counts in the total alone. ``owned (user_id, candidate_pos)`` may repeat; places that no candidate has are ignored later.
    """
    kind = tx.schema["spend_category"].dataType
    both = tx.select("user_id", "spend_category", "amount", F.lit(True).alias("spent"), F.lit(None).cast("long").alias("candidate_pos"))
    both = both.unionByName(owned.select("user_id", F.lit(None).cast(kind).alias("spend_category"), F.lit(None).cast("long").alias("amount"), F.lit(False).alias("spent"), "candidate_pos"))
    sums = [F.sum(F.when(F.col("spend_category") == c, F.col("amount"))).alias(f"c{k}") for k, c in enumerate(categories)]
    rows = both.groupBy("user_id").agg(F.sum("amount").alias("total"), F.bool_or("spent").alias("spent"), F.collect_set("candidate_pos").alias("owned"), *sums)
    by_category = F.map_from_arrays(F.array(*[F.lit(c).cast(kind) for c in categories]), F.array(*[f"c{k}" for k in range(len(categories))]))
    return rows.filter("spent").select("user_id", "total", by_category.alias("by_category"), "owned")


def advised(profiles: DataFrame, grid: DataFrame, n: int = ALTERNATIVES) -> DataFrame:
    """Adds ``mine`` (owned cards with their fit and verdict) and ``others`` (the ``n`` best cards they do not own, best first).

    A candidate loses 12 points for each of its benefit rows in a category that an owned card has. A total of 0 has no
    fit: no verdict but to switch, and candidates in their own order.
    """
    rows = profiles.join(F.broadcast(grid), F.lit(True))
    fit = lambda c: percent(covered_amount(F.col("by_category"), c["covered"]), F.col("total"))
    is_mine = lambda c: F.array_contains("owned", c["candidate_pos"])
    held = F.array_distinct(F.flatten(F.transform(F.filter("cards", is_mine), lambda c: F.transform(c["rows"], lambda r: r["category_id"]))))
    mine = F.transform(F.filter("cards", is_mine), lambda c: F.struct(c["card_id"].alias("card_id"), fit(c).alias("fit")))
    mine = F.transform(mine, lambda m: F.struct(m["card_id"].alias("card_id"), m["fit"].alias("fit"), F.when(m["fit"] >= KEEP_FROM, "keep").otherwise("switch").alias("verdict")))

    def best(own: Column) -> Column:
        """The best other cards, for the categories ``own`` of the owned ones."""
        overlaps = lambda c: F.aggregate(F.filter(c["rows"], lambda r: F.array_contains(own, r["category_id"])), F.lit(0).cast("long"), lambda a, r: a + r["n"])
        open_cards = F.transform(F.filter("cards", lambda c: ~is_mine(c)), lambda c: F.struct(c["candidate_pos"].alias("candidate_pos"), c["card_id"].alias("card_id"), fit(c).alias("fit"), overlaps(c).alias("n_overlaps")))
        ordered = F.array_sort(F.transform(open_cards, lambda o: F.struct((o["n_overlaps"] * OVERLAP_PENALTY - o["fit"]).alias("behind"), o["candidate_pos"].alias("candidate_pos"), o["card_id"].alias("card_id"), o["fit"].alias("fit"), o["n_overlaps"].alias("n_overlaps"))))
        return F.slice(ordered, 1, n)

    # bound as a lambda's variable, the owned categories are found once a user: as a column they would be put into the inner lambda and found for each benefit row
    others = F.flatten(F.transform(F.array(held), best))
    return rows.select("user_id", mine.alias("mine"), others.alias("others"))


def verdicts(users: DataFrame) -> DataFrame:
    """Keep an owned card from a fit of 60 on, else switch."""
    return users.select("user_id", F.inline_outer("mine")).filter("card_id IS NOT NULL")


def alternatives(users: DataFrame) -> DataFrame:
    rows = users.select("user_id", F.posexplode_outer("others").alias("at", "o")).filter("o IS NOT NULL")  # outer: else the list is made again to test that it is not empty
    return rows.select("user_id", "o.card_id", "o.fit", "o.n_overlaps", (-F.col("o.behind")).alias("score"), (F.col("at") + 1).cast("long").alias("place"))


def combination(users: DataFrame) -> DataFrame:
    """Kept cards, and the best other card where some card is to be switched."""
    part = lambda cards, name: F.transform(cards, lambda c: F.struct(c["card_id"].alias("card_id"), F.lit(name).alias("part")))
    kept = part(F.filter("mine", lambda m: m["verdict"] == "keep"), "kept")
    moves = F.exists("mine", lambda m: m["verdict"] == "switch")
    new = part(F.when(moves, F.slice("others", 1, 1)).otherwise(F.slice("others", 1, 0)), "new")
    return users.select("user_id", F.inline_outer(F.concat(kept, new))).filter("card_id IS NOT NULL")
