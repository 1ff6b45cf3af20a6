"""All card queries by name, over the domain of ``sources.fixtures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import numeric, text
from cardloom.operators import accounts, advice, catalogue, compare, history, profile, quality, ranking, scoring, spending
from cardloom.plans import sql
from cardloom.sources import dims, io
from cardloom.sources.fixtures import Domain
from cardloom.streaming import jobs

KEYWORDS = {"A": ("ring",), "B": ("widget", "bolt"), "C": ()}
USAGE_MONTH = "1997-06-01"
ISSUERS_ALLOWED = sql.ISSUERS_ALLOWED

_FOUND: dict[str, Callable[[Domain], DataFrame]] = {}


def query(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    _FOUND[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))) for name, f in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()


# ---------------------------------------------------------------- catalogue


@query
def card_list(d: Domain) -> DataFrame:
    return catalogue.card_list(d.card)


@query
def card_filter(d: Domain) -> DataFrame:
    found = catalogue.Criteria(card_type="신용", fee_band="~10만원", performance_cap="~50만원", has_event=True, companies=["Brand#11", "Brand#12", "Brand#21", "Brand#22", "Brand#31", "Brand#32", "Brand#41", "Brand#42", "Brand#51", "Brand#52"])
    return catalogue.filter_cards(d.card, found).select("card_id", "company", "card_type", "annual_fee_dom_basic", "min_performance")


def _keywords(d: Domain) -> DataFrame:
    return d.spark.createDataFrame([(c, list(w)) for c, w in KEYWORDS.items()], "category string, keywords array<string>")


@query
def category_keyword_match(d: Domain) -> DataFrame:
    """Six selections as rows: listed categories alone and together, one without keywords, an unlisted one, and none."""
    wanted = (["A"], ["B"], ["A", "B"], ["C"], ["pin"], [None])
    rows = d.spark.createDataFrame([(",".join(filter(None, s)), c) for s in wanted for c in s], "request_id string, category string")
    return catalogue.match_selections(d.card, rows, _keywords(d)).select("card_id", F.col("request_id").alias("selected"))


@query
def selection_matches(d: Domain) -> DataFrame:
    """The selections of all nations: listed, unlisted, unknown, empty and repeated categories by their key."""
    return catalogue.match_selections(d.card, d.selections, _keywords(d))


@query
def selection_category_hits(d: Domain) -> DataFrame:
    """The same selections against the names of benefit categories."""
    return catalogue.selection_hits(d.bridge, d.category_selections, dims.keyword_map(d.spark), dims.categories(d.spark))


@query
def card_searches(d: Domain) -> DataFrame:
    """Searches for pieces of the names that cards have, in both cases, of one character up to whole words, and for nothing."""
    return catalogue.search_many(d.card, d.searches)


@query
def card_search(d: Domain) -> DataFrame:
    return catalogue.search_cards(d.card, "RING", d.card.filter("card_id % 10 = 0").select("card_id")).select("card_id", "card_name", "company")


@query
def decode_dimensions(d: Domain) -> DataFrame:
    return catalogue.decode_dimensions(d.card)


@query
def card_sort(d: Domain) -> DataFrame:
    return catalogue.sort_cards(d.card, "benefit_desc")


@query
def card_preview(d: Domain) -> DataFrame:
    return catalogue.card_preview(d.card)


@query
def card_detail(d: Domain) -> DataFrame:
    return catalogue.unnested(catalogue.card_detail(d.card, d.benefit))


@query
def benefit_groups(d: Domain) -> DataFrame:
    return catalogue.benefit_groups(catalogue.detail_rows(d.card, d.benefit))


@query
def selected_category_hits(d: Domain) -> DataFrame:
    return catalogue.selected_category_hits(d.bridge, ["백화점/아울렛", "편의점", "반려동물", "쇼핑", "의료"], {**dims.CATEGORY_KEYWORDS})


@query
def facet_counts(d: Domain) -> DataFrame:
    return catalogue.facet_counts(d.card)


# ---------------------------------------------------------------- scoring


@query
def practicality_score(d: Domain) -> DataFrame:
    return scoring.practicality_score(d.benefit)


@query
def fee_performance_score(d: Domain) -> DataFrame:
    return scoring.fee_performance_score(d.card)


@query
def diversity_score(d: Domain) -> DataFrame:
    return scoring.diversity_score(d.benefit)


@query
def limit_score(d: Domain) -> DataFrame:
    return scoring.limit_score(d.benefit)


@query
def card_scores(d: Domain) -> DataFrame:
    return scoring.card_scores(d.card, d.benefit)


# ---------------------------------------------------------------- spending and advice


def _spend(d: Domain) -> DataFrame:
    return spending.spend_by_category(d.transactions)


def _candidate_rows(d: Domain) -> DataFrame:
    """Bridge rows of the candidates: one card an issuer."""
    return d.bridge.join(d.candidate.select("card_id"), "card_id")


def _coverage(d: Domain) -> DataFrame:
    return spending.covered_categories(_candidate_rows(d), d.match_map)


def _fit(d: Domain) -> DataFrame:
    return spending.card_fit(_spend(d), _coverage(d), d.candidate.select("card_id", "candidate_pos"))


def _owned_rows(d: Domain) -> DataFrame:
    return advice.owned_benefits(d.owned, _candidate_rows(d))


@query
def spend_by_category(d: Domain) -> DataFrame:
    return _spend(d)


@query
def spend_summary(d: Domain) -> DataFrame:
    return spending.spend_summary(_spend(d))


@query
def spend_share(d: Domain) -> DataFrame:
    return spending.spend_share(_spend(d))


@query
def card_fit(d: Domain) -> DataFrame:
    return _fit(d).select("user_id", "card_id", "fit")


@query
def candidate_cards(d: Domain) -> DataFrame:
    return ranking.candidate_cards(d.card_rank)


@query
def candidate_by_fit(d: Domain) -> DataFrame:
    return advice.rank_by_fit(_fit(d))


@query
def matched_benefits(d: Domain) -> DataFrame:
    return advice.matched_benefits(_owned_rows(d), _spend(d), d.match_map)


@query
def benefit_status(d: Domain) -> DataFrame:
    firsts = d.first_category.select("card_id", "benefit_id", "benefit_pos", "category_id").join(d.candidate.select("card_id"), "card_id")
    return advice.benefit_status(advice.owned_benefits(d.owned, firsts), _spend(d), d.match_map)


@query
def overlap_categories(d: Domain) -> DataFrame:
    return advice.overlap_categories(d.owned, _candidate_rows(d))


def _advised(d: Domain) -> DataFrame:
    """One row a user, from which verdicts, alternatives and the combination are read."""
    grid = profile.candidate_grid(d.candidate, d.bridge, d.match_map)
    return profile.advised(profile.user_profiles(d.transactions, d.owned_places, list(range(9))), grid)


@query
def card_verdicts(d: Domain) -> DataFrame:
    return profile.verdicts(_advised(d))


@query
def switch_alternatives(d: Domain) -> DataFrame:
    return profile.alternatives(_advised(d))


@query
def recommended_combo(d: Domain) -> DataFrame:
    return profile.combination(_advised(d))


@query
def combo_coverage(d: Domain) -> DataFrame:
    return advice.combo_coverage(d.owned.select("user_id", "card_id"), _coverage(d), _spend(d))


@query
def card_usage(d: Domain) -> DataFrame:
    tx = d.transactions.join(d.candidate.select("card_id", "candidate_pos"), "candidate_pos")
    return spending.card_usage(tx, d.card_limit, F.lit(USAGE_MONTH).cast("timestamp"))


# ---------------------------------------------------------------- ranking


@query
def engagement_monthly(d: Domain) -> DataFrame:
    return ranking.engagement_monthly(d.engagement)


def _ranked(d: Domain) -> DataFrame:
    monthly = ranking.engagement_monthly(d.engagement).join(d.card.select("card_id", "company", "card_type"), "card_id")
    return ranking.popularity_ranking(ranking.filter_ranked(monthly, card_type="신용"), ["month"])


@query
def issuer_ranking(d: Domain) -> DataFrame:
    return _ranked(d)


@query
def ranking_with_issuer(d: Domain) -> DataFrame:
    """Ranked cards with their issuer's own figures: one row an issuer."""
    meta = d.card.groupBy("company").agg(F.count(F.lit(1)).alias("n_cards"), F.max("max_benefit").alias("top_benefit")).filter("n_cards > 2")
    rows = _ranked(d).select("month", "card_id", "place").join(d.card.select("card_id", "company"), "card_id")
    return ranking.with_issuer_meta(rows, meta, "company").select("month", "card_id", "place", "company", "n_cards", "top_benefit")


@query
def issuer_top5(d: Domain) -> DataFrame:
    ranked = d.card_rank.withColumn("card_rank", F.when(F.col("card_id") % 9 != 0, F.col("card_rank")))
    return ranking.issuer_top_n(ranked)


# ---------------------------------------------------------------- comparison


def _sets(d: Domain) -> DataFrame:
    return compare.at_least_two(d.compare_items.select("set_id", "card_id", "pos"))


def _met(d: Domain, *columns: str) -> DataFrame:
    return compare.met_sets(_sets(d), compare.first_rates(d.first_category), *columns)


def _rates(d: Domain) -> DataFrame:
    return compare.set_rates(_met(d, "rate"))


def _plain(rows: DataFrame) -> DataFrame:
    """Rates as text with their two decimals, which is exact in any engine."""
    return rows.withColumns({c: F.col(c).cast("decimal(12,2)").cast("string") for c in rows.columns if c.startswith("rate")})


def _scores(d: Domain) -> DataFrame:
    counts = d.benefit.groupBy("card_id").agg(F.count(F.lit(1)).alias("n_benefits"))
    cards = d.card.select("card_id", "max_benefit", "annual_fee_dom_basic", "min_performance", "rating_x10")
    return compare.score_sets(_sets(d), cards, counts)


@query
def compare_scores(d: Domain) -> DataFrame:
    return compare.compare_scores(_scores(d))


@query
def score_unpivot(d: Domain) -> DataFrame:
    return compare.score_matrix(_scores(d))


@query
def compare_categories(d: Domain) -> DataFrame:
    return compare.set_categories(_met(d, "benefit_pos"))


@query
def shared_categories(d: Domain) -> DataFrame:
    return compare.shared_categories(_met(d, "benefit_pos"))


@query
def rate_matrix(d: Domain) -> DataFrame:
    return _plain(compare.rate_matrix(_met(d, "rate")))


@query
def benefit_cells(d: Domain) -> DataFrame:
    return _plain(compare.benefit_cells(_sets(d), compare.first_rates(d.first_category)))


@query
def shared_rate_diff(d: Domain) -> DataFrame:
    return _plain(compare.shared_rate_diff(_rates(d)))


@query
def pair_headline(d: Domain) -> DataFrame:
    return compare.pair_headline(_rates(d))


@query
def best_badge(d: Domain) -> DataFrame:
    return _plain(compare.best_badge(_rates(d)))


@query
def max_benefit_winner(d: Domain) -> DataFrame:
    return compare.max_benefit_winner(_sets(d), d.card)


# ---------------------------------------------------------------- history, accounts, labels, quality


@query
def recent_views(d: Domain) -> DataFrame:
    views = history.recent_views(d.engagement.filter("event_type = 'view'"))
    return history.history_cards(views, d.card.select("card_id", "card_name")).select("user_id", "card_id", "place", "card_name")


@query
def recent_compares(d: Domain) -> DataFrame:
    return history.recent_compares(history.compare_events(d.compare_items))


@query
def favourites(d: Domain) -> DataFrame:
    return history.favourites(d.toggles)


@query
def compare_basket(d: Domain) -> DataFrame:
    return history.compare_basket(d.toggles)


@query
def signup_validation(d: Domain) -> DataFrame:
    return accounts.validate_signups(d.signups, d.users)


@query
def phone_format(d: Domain) -> DataFrame:
    phone = F.expr("substring(phone, 1, cast(signup_id % 12 as int))")
    return d.signups.select("signup_id", text.format_phone(F.col("phone")).alias("phone"), text.format_phone(F.concat(F.lit("+"), phone)).alias("part"))


@query
def parse_selection(d: Domain) -> DataFrame:
    listed = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("%20,")), F.lit(" , a+b,%EC%B9%B4,"))
    return d.raw("part").select(F.col("p_partkey").alias("card_id"), F.concat_ws("|", text.parse_selection(listed)).alias("items"))


@query
def money_labels(d: Domain) -> DataFrame:
    fee, need = F.col("annual_fee_dom_basic"), F.col("min_performance")
    return d.card.select("card_id", numeric.won_label(fee).alias("fee"), numeric.manwon_label(F.col("max_benefit")).alias("benefit"), numeric.manwon_label(F.col("max_benefit"), 1).alias("benefit1"), numeric.performance_label(need).alias("performance"))


@query
def unmapped_categories(d: Domain) -> DataFrame:
    return quality.unmapped_categories(d.bridge, d.match_map, "category_id")


# ---------------------------------------------------------------- arms of operators that no other query takes


@query
def issuer_names(d: Domain) -> DataFrame:
    """Issuers named by short name, long name or a name that the alias table lacks."""
    names = [short for _, short in dims.ISSUERS] + [name for name, _ in dims.ISSUERS]
    named = F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("card_id") % (len(names) + 1)).cast("int")), F.col("company"))
    return catalogue.canonical_issuer(d.card.select("card_id", named.alias("named")), "named").select("card_id", "named", "issuer")


@query
def benefit_kinds(d: Domain) -> DataFrame:
    """Labels of a benefit's kind in both vocabularies; some kinds are null or unknown."""
    kind = F.get(F.array(*map(F.lit, [*dims.KIND_LABELS["comparison"], "gift"])), (F.col("card_id") % 6).cast("int"))
    label = {v: catalogue.decode_benefit_kind(kind, v).alias(v) for v in dims.KIND_LABELS}
    return d.benefit.select("benefit_id", label["comparison"], label["ranking"])


@query
def card_lookup(d: Domain) -> DataFrame:
    """Cards asked for by key, and the keys that no card has."""
    hits, misses = catalogue.lookup_cards(d.card.select("card_id", "card_name"), d.engagement.select((F.col("card_id") * 7).alias("card_id")).distinct())
    return hits.select("card_id", "card_name", F.lit(True).alias("found")).unionByName(misses.select("card_id", F.lit(None).cast("string").alias("card_name"), F.lit(False).alias("found")))


@query
def ranking_of_issuers(d: Domain) -> DataFrame:
    """Popularity of the cards of allowed issuers, and of one issuer's credit cards among them."""
    monthly = ranking.engagement_monthly(d.engagement).join(d.card.select("card_id", "company", "card_type"), "card_id")
    allowed = ranking.filter_ranked(monthly, allowed=ISSUERS_ALLOWED)
    one = ranking.filter_ranked(allowed, card_type="신용", issuer=ISSUERS_ALLOWED[0])
    arms = [ranking.popularity_ranking(rows, ["month"]).withColumn("arm", F.lit(name)) for name, rows in (("allowed", allowed), ("one", one))]
    return arms[0].unionByName(arms[1])


@query
def card_words(d: Domain) -> DataFrame:
    """The last word of a card's name, and the persona that a word in any case, an unknown one or none stands for."""
    persona = F.get(F.array(F.lit("worker"), F.lit("Senior"), F.lit("FAMILY"), F.lit("nobody")), (F.col("card_id") % 5).cast("int"))
    return d.card.select("card_id", text.last_word(F.col("card_name")).alias("word"), scoring.persona_key(persona).alias("persona"))


@query
def engagement_daily(d: Domain) -> DataFrame:
    """The daily stream's job over the whole table at once."""
    return jobs.engagement_stream(d.engagement)


@query
def engagement_rolled_up(d: Domain) -> DataFrame:
    """Months summed from the table that the daily stream keeps."""
    table = jobs.DayTable(d.spark, io.scratch_path(d.spark, "days"))
    jobs.engagement_into(d.live_engagement, table, io.scratch_path(d.spark, "days-progress"))
    return table.months()


@query
def favourite_counts(d: Domain) -> DataFrame:
    """The favourites stream's job over the whole table at once."""
    return jobs.favourites_stream(d.toggles)


# ---------------------------------------------------------------- tables written and read back


def _statements(d: Domain) -> DataFrame:
    tx = d.transactions.join(d.candidate.select("candidate_pos", "card_id"), "candidate_pos")
    return tx.select("user_id", "card_id", "ts", F.get(F.array(*map(F.lit, dims.SPENDING_MATCH)), F.col("spend_category").cast("int")).alias("category"), "amount")


def _summed(statements: DataFrame) -> DataFrame:
    rows = statements.groupBy("user_id", "card_id", "category")
    return rows.agg(F.count("amount").alias("n"), F.sum("amount").alias("amount"), F.max(F.col("ts").cast("date")).alias("last_day"), F.count("_corrupt_record").alias("damaged"))


@query
def statements_csv(d: Domain) -> DataFrame:
    """Sums of statements that were written as CSV and read by the statement schema."""
    path = io.scratch_path(d.spark, "statements-csv")
    _statements(d).write.option("header", True).csv(path)
    return _summed(io.read_statements_csv(d.spark, path))


@query
def statements_json(d: Domain) -> DataFrame:
    """Sums of statements that were written as JSON lines and read by the statement schema."""
    path = io.scratch_path(d.spark, "statements-json")
    io.write_table(_statements(d), path, form="json")
    return _summed(io.read_statements_json(d.spark, path))


@query
def stored_views(d: Domain) -> DataFrame:
    """Recent views and favourites, written as tables bucketed by user and joined without an exchange."""
    views = io.bucketed(history.viewed_lists(recent_views(d)), *io.scratch_table(d.spark, "views"), buckets=16)
    liked = io.bucketed(favourites(d), *io.scratch_table(d.spark, "favourites"), buckets=16)
    return history.viewed_favourites(views, liked)


@query
def history_texts(d: Domain) -> DataFrame:
    """Histories as JSON texts, and what is read from these again: lengths and sums of what they list."""
    lists = history.viewed_lists(recent_views(d)).join(history.compared_lists(recent_compares(d)), "user_id", "full")
    texts = history.write_history(lists)
    back = history.parse_history(texts).withColumnsRenamed({"viewed": "v", "compared": "c"})
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    counts = [F.size("v").cast("long").alias("n_viewed"), total(F.col("v")).alias("viewed_sum"), F.size("c").cast("long").alias("n_compared"), total(F.flatten("c")).alias("compared_sum")]
    return texts.join(back, "user_id").select("user_id", "viewed", "compared", *counts)


@query
def nested_catalogue(d: Domain) -> DataFrame:
    """Cards with their benefits, tags and event notes, written as nested JSON lines and read back as rows of each kind."""
    path = io.scratch_path(d.spark, "catalogue")
    io.write_table(catalogue.nest_catalogue(d.card, d.benefit), path, form="json")
    parts = catalogue.normalise_catalogue(io.read_catalogue(d.spark, path))
    told = {
        "card": (F.lit(0), F.concat_ws("|", "name", "issuer", "type", "network", "annualFee", "minSpending", "maxBenefit")), "benefit": ("benefit_pos", F.concat_ws("|", "category", "description", "type", "maxMonthly", F.col("discountRate").cast("decimal(12,2)"), "condition")),
        "tag": ("pos", "tag"), "event": ("pos", "event"),
    }
    rows = [parts[k].select(F.lit(k).alias("kind"), F.col("id").cast("long").alias("card_id"), (F.col(at) if isinstance(at, str) else at).cast("long").alias("pos"), (F.col(v) if isinstance(v, str) else v).alias("value")) for k, (at, v) in told.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query
def cards_by_jdbc(d: Domain) -> DataFrame:
    """Cheap cards from a database table that is read in four ranges of its key; the fee is tested in the database."""
    url = io.scratch_database(d.spark)
    cards = d.card.select(F.when(F.col("card_id") % 7 != 0, F.col("card_id")).alias("card_key"), "card_id", "card_name", "company", "annual_fee_dom_basic")
    cards.write.format("jdbc").options(url=url, dbtable="card", createTableColumnTypes="card_name VARCHAR(200), company VARCHAR(80)").mode("overwrite").save()
    read = io.read_tables(d.spark, {"url": url}, ["card"], partition_column="card_key", num_partitions=4)["card"]
    return read.filter("annual_fee_dom_basic <= 50000").select("card_key", "card_id", "card_name", "company")
