"""Per-user histories: views, comparisons, favourites, the capped basket."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIEWS, COMPARES, BASKET = 10, 5, 3


def recent_views(events: DataFrame, n: int = VIEWS) -> DataFrame:
    """The last ``n`` distinct cards of each user, newest first. Events are reduced to (user, card) before any window."""
    last = events.groupBy("user_id", "card_id").agg(F.max("ts").alias("last"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last"), "card_id")).cast("long")
    return last.withColumn("place", place).filter(F.col("place") <= n).select("user_id", "card_id", "place")


def history_cards(history: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards of a history in its order; unknown ids are dropped."""
    return history.join(cards, "card_id")


def recent_compares(events: DataFrame, n: int = COMPARES) -> DataFrame:
    """The last ``n`` distinct sets of two cards or more of each user, whatever their order; the newest order is kept.

    ``events (user_id, card_ids, ts, set_id)``; equal times break on set_id. ``number`` counts from the oldest kept entry.
    """
    key = F.array_sort("card_ids")
    last = events.filter(F.size("card_ids") >= 2).groupBy("user_id", key.alias("key")).agg(F.max(F.struct("ts", "set_id", "card_ids")).alias("e"))
    user = W.partitionBy("user_id")
    kept = last.withColumn("place", F.row_number().over(user.orderBy(F.desc("e.ts"), F.desc("e.set_id"))).cast("long")).filter(F.col("place") <= n)
    number = (F.count(F.lit(1)).over(user) - F.col("place") + 1).cast("long")
    return kept.select("user_id", F.concat_ws(",", F.transform("e.card_ids", lambda x: x.cast("string"))).alias("cards"), "place", number.alias("number"))


def compare_events(items: DataFrame) -> DataFrame:
    """Items of comparison sets as one event a set."""
    rows = items.groupBy("set_id", "user_id", "ts").agg(F.sort_array(F.collect_list(F.struct("pos", "card_id"))).alias("c"))
    return rows.select("set_id", "user_id", "ts", F.col("c.card_id").alias("card_ids"))


def favourites(toggles: DataFrame) -> DataFrame:
    """Cards that a user toggled an odd number of times."""
    return toggles.groupBy("user_id", "card_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("user_id", "card_id")


def compare_basket(toggles: DataFrame, most: int = BASKET) -> DataFrame:
    """What each user's basket holds after all toggles in time order, where additions to a full basket are ignored.

    Every toggle depends on those before it, so a user's toggles stream in order through one task, which holds one
    basket at a time, however many they are. Toggles without a card change nothing.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held, begun = None, [], False
        for batch in batches:
            done = []
            for who, card in zip(batch.column("user_id").to_pylist(), batch.column("card_id").to_pylist(), strict=True):
                if begun and who != user:
                    done.append((user, held))
                if not begun or who != user:
                    user, held, begun = who, [], True
                if card in held:
                    held.remove(card)
                elif card is not None and len(held) < most:
                    held.append(card)
            yield _baskets(done, batch.schema.field("user_id").type)
        if begun:
            yield _baskets([(user, held)], batch.schema.field("user_id").type)

    ordered = toggles.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id", "card_id").select("user_id", "card_id")
    return ordered.mapInArrow(fold, f"user_id {ordered.schema['user_id'].dataType.simpleString()}, basket string")


def _baskets(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], key), pa.array([",".join(map(str, h)) for _, h in done], pa.string())], ["user_id", "basket"])


def viewed_lists(views: DataFrame) -> DataFrame:
    """Recent views as one row a user, newest first: as many entries as a history has."""
    rows = views.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "card_id"))).alias("v"))
    return rows.select("user_id", F.col("v.card_id").alias("viewed"))


def compared_lists(compares: DataFrame) -> DataFrame:
    """Recent comparisons (``cards`` joined by commas, ``place``) as one row a user, newest first."""
    rows = compares.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "cards"))).alias("c"))
    return rows.select("user_id", F.transform("c.cards", lambda x: F.split(x, ",").cast("array<bigint>")).alias("compared"))


def viewed_favourites(viewed: DataFrame, favourites: DataFrame) -> DataFrame:
    """Views of ``viewed (user_id, viewed)`` with their place and whether they are favourites. Both sides are by user; tables bucketed by user meet without an exchange."""
    sets = favourites.groupBy("user_id").agg(F.collect_set("card_id").alias("liked"))
    met = viewed.join(sets.hint("merge"), "user_id", "left").select("user_id", F.posexplode("viewed").alias("at", "card_id"), "liked")
    return met.select("user_id", "card_id", (F.col("at") + 1).cast("long").alias("place"), F.coalesce(F.array_contains("liked", F.col("card_id")), F.lit(False)).alias("favourite"))


def write_history(rows: DataFrame) -> DataFrame:
    """Lists of views and comparisons as the JSON texts that a browser keeps; no list is an empty one."""
    text = lambda c: F.to_json(F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return rows.select("user_id", text("viewed").alias("viewed"), text("compared").alias("compared"))


def parse_history(rows: DataFrame) -> DataFrame:
    """Stored JSON lists ``viewed`` and ``compared`` as arrays; text that is no such list gives null."""
    return rows.select("user_id", F.from_json("viewed", "array<bigint>").alias("viewed"), F.from_json("compared", "array<array<bigint>>").alias("compared"))
