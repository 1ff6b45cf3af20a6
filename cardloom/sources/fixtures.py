"""The card domain as views of the public star-schema tables; every rule is the same in ``plans.sql``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.sources import dims


class Domain:
    """Domain tables over one folder of parquet tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def card(self) -> DataFrame:
        key = F.col("p_partkey")
        network = F.get(F.array(*map(F.lit, dims.NETWORKS)), (key % 5).cast("int"))
        return self.raw("part").select(
            key.alias("card_id"), F.col("p_name").alias("card_name"), F.col("p_brand").alias("company"),
            F.when(F.col("p_type").isin("PROMO", "SMALL"), "체크").otherwise("신용").alias("card_type"),
            network.alias("network"),
            (F.col("p_size") % 15 * 10_000).cast("int").alias("annual_fee_dom_basic"), (F.col("p_size") % 7 * 100_000).cast("int").alias("min_performance"),
            F.replace("p_name", F.lit(" "), F.lit(" / ")).alias("summary"), F.split("p_name", " ").alias("tags"),
            (key % 3 == 0).alias("has_cashback"), (key % 2 == 0).alias("has_transport"),
            F.round(F.col("p_retailprice") * 100).cast("long").alias("max_benefit"), (key % 11 + 40).alias("rating_x10"),
        )

    @cached_property
    def _benefit_rows(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_linenumber <= 2")
        order = W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
        return rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax").withColumn("benefit_pos", F.row_number().over(order).cast("long"))

    @cached_property
    def benefit(self) -> DataFrame:
        tax, off = F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int")
        return self._benefit_rows.select(
            F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("benefit_pos").cast("string")).alias("benefit_id"), F.col("l_partkey").alias("card_id"), "benefit_pos",
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("T"), (F.col("l_suppkey") % 4).cast("string"))).alias("benefit_title"),
            F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("C"), (F.col("l_suppkey") % 6).cast("string"))).alias("benefit_content"),
            F.when(tax != 8, (F.round(F.col("l_discount") * 200) + F.col("l_suppkey") % 4 * 0.25).cast("decimal(12,2)")).alias("benefit_value"),
            F.when(F.col("l_linestatus") == "O", "%").alias("benefit_unit"),
            F.when(~((off == 1) & (tax == 0)), F.round(F.col("l_extendedprice") / 100).cast("long")).alias("max_limit"),
            F.get(F.array(*map(F.lit, [*dims.KIND_LABELS["comparison"], "gift"])), (F.col("l_suppkey") % 6).cast("int")).alias("benefit_kind"),
            F.when(F.col("l_suppkey") % 3 == 0, dims.NO_CONDITION).when(F.col("l_suppkey") % 11 != 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string"))).alias("condition"),
            self._category_ids.alias("category_ids"),
        )

    @property
    def _category_ids(self):
        """Sorted distinct category ids of a benefit; empty for some. The bridge, kept with its benefit."""
        first = F.col("l_suppkey") % 21 + 1
        second = F.when(F.col("l_linenumber") == 2, (F.col("l_suppkey") + F.col("l_quantity").cast("long")) % 21 + 1)
        both = F.array_sort(F.array_distinct(F.array_compact(F.array(first, second))))
        return F.when(F.col("l_suppkey") % 13 == 0, F.array().cast("array<bigint>")).otherwise(both)

    @cached_property
    def bridge(self) -> DataFrame:
        return self.benefit.select("benefit_id", "card_id", "benefit_pos", F.explode("category_ids").alias("category_id"))

    @cached_property
    def match_map(self) -> DataFrame:
        return self.spark.range(18).select((F.col("id") / 2).cast("long").alias("spend_category"), (F.col("id") + 1).alias("category_id"))

    @cached_property
    def card_rank(self) -> DataFrame:
        order = W.partitionBy("company").orderBy(F.desc("max_benefit"), "card_id")
        return self.card.withColumn("card_rank", F.row_number().over(order).cast("long"))

    @cached_property
    def candidate(self) -> DataFrame:
        """One card an issuer: as many rows as issuers."""
        best = self.card_rank.filter("card_rank = 1")
        return best.select("card_id", "company", (F.row_number().over(W.orderBy("company")) - 1).cast("long").alias("candidate_pos"))

    @cached_property
    def owned_places(self) -> DataFrame:
        """Owned cards by their candidate's place; some places may have no candidate."""
        u = F.col("c_custkey")
        return self.raw("customer").select(u.alias("user_id"), F.explode(F.array_distinct(F.array(u % 25, (u * 7 + 3) % 25, (u * 11 + 5) % 25))).alias("candidate_pos"))

    @cached_property
    def owned(self) -> DataFrame:
        return self.owned_places.join(self.candidate, "candidate_pos").select("user_id", "card_id", "candidate_pos")

    @cached_property
    def transactions(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s"), F.round("l_extendedprice").cast("long").alias("amount"))
        rows = lines.join(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts")), "l_orderkey")
        return rows.select("user_id", "ts", (F.col("s") % 9).alias("spend_category"), "amount", (F.col("s") % 25).alias("candidate_pos"))

    @cached_property
    def card_limit(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 30 * 100_000 + 1_000_000).alias("card_limit"))

    def _events(self, *kinds: str, live: bool = False) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        rows = self.raw("events")
        if live:
            rows = self.spark.readStream.schema(rows.schema).parquet(f"{self.sf_dir}/events.parque[t]")  # a pattern stands for a file as well as for a folder
        return rows.filter(F.col("event_type").isin(*kinds)).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", k.alias("k"))

    @cached_property
    def engagement(self) -> DataFrame:
        return self._events("view", "click").select("event_id", "user_id", "ts", "event_type", F.col("k").alias("card_id"))

    @cached_property
    def live_engagement(self) -> DataFrame:
        """The same rows as a stream of the folder's event files."""
        return self._events("view", "click", live=True).select("event_id", "user_id", "ts", "event_type", F.col("k").alias("card_id"))

    @cached_property
    def toggles(self) -> DataFrame:
        return self._events("purchase").select("event_id", "user_id", "ts", (F.col("k") % 10).alias("card_id"))

    @cached_property
    def compare_items(self) -> DataFrame:
        """``set_id, user_id, ts, card_id, pos``: up to three cards of each order's comparison set."""
        lines = self.raw("lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 40).alias("card_id")).agg(F.min("l_linenumber").alias("line"))
        order = W.partitionBy("l_orderkey").orderBy("line", "card_id")
        top = lines.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).filter("pos <= 2")
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
        return top.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("set_id"), "user_id", "ts", "card_id", "pos")

    @cached_property
    def first_category(self) -> DataFrame:
        """Benefits with their smallest category id; those without a category are left out."""
        return self.benefit.filter(F.size("category_ids") > 0).withColumn("category_id", F.col("category_ids")[0])

    @cached_property
    def signups(self) -> DataFrame:
        k = F.col("c_custkey")
        email = F.when(k % 10 == 0, "nomail").otherwise(F.concat(F.lit("u"), (k % 1000).cast("string"), F.lit("@x.kr")))
        password = F.when(k % 13 == 0, "short").otherwise("longenough")
        return self.raw("customer").select(
            k.alias("signup_id"), F.when(k % 17 == 0, "A").otherwise(F.col("c_name")).alias("name"), email.alias("email"), password.alias("password"),
            F.when(k % 11 == 0, "other").otherwise(password).alias("password_confirm"), F.concat(F.lit("010"), (k + 10_000_000).cast("string")).alias("phone"),
        )

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").filter(k % 4 == 0).select(k.alias("user_id"), F.concat(F.lit("u"), k.cast("string"), F.lit("@x.kr")).alias("email"))

    def _chosen(self, names: tuple) -> DataFrame:
        k = F.col("n_nationkey")
        at = lambda x: F.get(F.array(*[F.lit(n) for n in names]), (x % (len(names) + 1)).cast("int"))
        return self.raw("nation").select(k.alias("request_id"), F.explode(F.array(at(k), at(k * 3 + 1), at(F.when(k % 2 == 0, k * 5).otherwise(k)))).alias("category"))

    @cached_property
    def selections(self) -> DataFrame:
        """``request_id, category``: three categories a nation, some null, some the same."""
        return self._chosen(("A", "B", "pin", "re", "C", "RING"))

    @cached_property
    def category_selections(self) -> DataFrame:
        return self._chosen(("백화점/아울렛", "편의점", "반려동물", "쇼핑", "의료", "외", "카페/베이"))

    @cached_property
    def searches(self) -> DataFrame:
        """Pieces of the words of card names; the id tells the piece."""
        words = self.raw("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
        sized = words.select("w", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
        piece = F.expr("substring(w, 1 + length(w) % 3, k)")
        rows = sized.select(F.concat("w", F.lit("/"), F.col("k").cast("string")).alias("search_id"), F.when(F.col("k") % 2 == 0, F.upper(piece)).otherwise(piece).alias("query"))
        issuers = self.raw("part").select(F.concat(F.lit("of/"), F.col("p_brand")).alias("search_id"), F.upper("p_brand").alias("query")).distinct()
        return rows.unionByName(issuers).unionByName(self.spark.sql("SELECT 'all' AS search_id, '' AS query UNION ALL SELECT 'none', NULL"))
