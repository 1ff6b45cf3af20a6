"""Hand-made cases for the rules that are easy to get wrong."""

import datetime

import pytest
from pyspark.sql import functions as F

from cardloom.operators import accounts, advice, catalogue, compare, history, profile, quality, ranking, scoring, spending, substrings
from cardloom.sources import dims, io

BENEFIT = "card_id long, benefit_pos long, benefit_id string, benefit_title string, benefit_content string, benefit_value decimal(12,2), benefit_unit string, max_limit long, category_ids array<long>"


def benefits(spark, rows):
    from decimal import Decimal

    full = [(c, p, f"{c}-{p}", t, x, None if v is None else Decimal(v), None, m, ids) for c, p, t, x, v, m, ids in rows]
    return spark.createDataFrame(full, BENEFIT)


def scores(spark, rows):
    return {r.card_id: r for r in scoring.benefit_scores(benefits(spark, rows)).collect()}


def practicality(row, persona):
    return next(p.practicality_score for p in row.practicality if p.persona == persona)


def test_practicality(spark):
    got = scores(spark, [(1, 1, None, None, 10, 1, [20]), (2, 1, None, None, 1000, 1, [13, 20]), (3, 1, None, None, None, 1, [20]), (4, 1, None, None, 10, 1, [])])
    assert practicality(got[1], "STUDENT") == 17
    assert practicality(got[2], "STUDENT") == 25
    assert practicality(got[3], "STUDENT") == practicality(got[4], "STUDENT") == 0


def test_persona_key(spark):
    rows = spark.createDataFrame([("student",), ("nobody",), (None,)], "p string").select(scoring.persona_key(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["STUDENT", "SINGLE", "STUDENT"]


def test_diversity_and_limit(spark):
    got = scores(spark, [
        (1, 1, None, None, 1, 5000, [1, 2]), (1, 2, None, None, 1, 7500, [2, 3, 4, 5]),
        (2, 1, None, None, 1, None, [*range(1, 14)]), (3, 1, None, None, None, None, []),
    ])
    assert (got[1].diversity_score, got[1].limit_score) == (41, 25)
    assert (got[2].diversity_score, got[2].limit_score) == (100, 100)
    assert (got[3].diversity_score, got[3].limit_score) == (0, 0)


def test_card_without_benefits_scores_zero(spark):
    cards = spark.createDataFrame([(9, 0, 0)], "card_id long, annual_fee_dom_basic int, min_performance int")
    rows = scoring.card_scores(cards, benefits(spark, [(1, 1, None, None, 1, 1, [1])])).collect()
    assert len(rows) == len(dims.PERSONAS)
    assert {(r.annual_fee_score, r.performance_score, r.practicality_score, r.diversity_score, r.limit_score) for r in rows} == {(100, 100, 0, 0, 0)}


def test_groups_keep_nulls_of_the_first_row(spark):
    b = benefits(spark, [(1, 1, "", "x", None, None, [15]), (1, 2, "x", "y", 5, 9, [15]), (1, 3, None, None, 5, 9, [15]), (1, 4, "z", "y", 5, 9, [])])
    got = {r.title: r for r in catalogue.benefit_groups(catalogue.detail_rows(spark.createDataFrame([(1,)], "card_id long"), b)).collect()}
    assert set(got) == {"x", "기타 혜택"}
    assert (got["x"].value_text, got["x"].max_limit, got["x"].contents, got["x"].preview) == ("", None, "x|y", "x")


def test_keywords(spark):
    cards = spark.createDataFrame([(1, "마트 할인"), (2, None), (3, "쇼핑 / 뷰티")], "card_id long, summary string")
    found = lambda *s: [r.card_id for r in catalogue.match_categories(cards, list(s)).orderBy("card_id").collect()]
    assert found() == [1, 2, 3]
    assert found("백화점/아울렛") == [1, 3]
    assert found("백화점/아울렛", "패션/뷰티") == [3]
    assert found("반려동물") == []
    assert found("할인") == [1]


def test_fee_bands_leave_free_cards_out(spark):
    fees = spark.createDataFrame([(0,), (1,), (10_000,), (10_001,)], "f int")
    assert [r.f for r in fees.filter(catalogue.fee_band(F.col("f"), "~1만원")).collect()] == [1, 10_000]


def test_lookup(spark):
    cards, keys = spark.createDataFrame([(1, "a")], "card_id long, n string"), spark.createDataFrame([(1,), (2,)], "card_id long")
    hits, misses = catalogue.lookup_cards(cards, keys)
    assert [r.card_id for r in hits.collect()] == [1] and [r.card_id for r in misses.collect()] == [2]


def test_issuer_aliases(spark):
    rows = spark.createDataFrame([("국민",), ("KB국민카드",), ("x",)], "company string")
    assert sorted(r.issuer for r in catalogue.canonical_issuer(rows).collect()) == ["KB국민카드", "KB국민카드", "x"]
    kinds = spark.createDataFrame([("special",)], "k string").select(catalogue.decode_benefit_kind(F.col("k")), catalogue.decode_benefit_kind(F.col("k"), "ranking")).first()
    assert tuple(kinds) == ("특별", "할인")


def test_sample_card_on_sample_spending(spark):
    """Spending of 1,500,000 in nine categories; a card that covers five of them by 885,000 fits 59 percent and is to be switched."""
    amounts = [450_000, 320_000, 180_000, 150_000, 120_000, 90_000, 75_000, 60_000, 55_000]
    spend = spark.createDataFrame([(1, k, a) for k, a in enumerate(amounts)], "user_id long, spend_category long, amount long")
    coverage = spark.createDataFrame([(7, [0, 3, 4, 5, 6])], "card_id long, covered array<long>")
    candidates = spark.createDataFrame([(7, 0), (8, 1)], "card_id long, candidate_pos long")
    fit = spending.card_fit(spend, coverage, candidates)
    got = {r.card_id: r.fit for r in fit.collect()}
    assert got == {7: 59, 8: 0}
    top = spending.spend_summary(spend).first()
    assert (top.total, top.n_categories, top.top_category, top.top_share) == (1_500_000, 9, 0, 30)


def advice_of(spark, tx, owned, cards, benefits, match=((0, 5), (1, 6), (2, 9))):
    """Users advised from tiny tables: ``tx (user, category, amount)``, ``owned (user, place)``, ``cards (card, place)``, ``benefits (card, category)``."""
    table = lambda rows, names: spark.createDataFrame(list(rows), ", ".join(f"{c} long" for c in names.split()))
    grid = profile.candidate_grid(table(cards, "card_id candidate_pos"), table(benefits, "card_id category_id"), table(match, "spend_category category_id"))
    return profile.advised(profile.user_profiles(table(tx, "user_id spend_category amount"), table(owned, "user_id candidate_pos"), [0, 1, 2]), grid)


def test_alternatives_and_combination(spark):
    """User 1 owns cards 1 (fits 70) and 2 (fits 20); cards 3 and 4 are open, and 4 has two benefit rows in a category that they hold."""
    cards = [(1, 0), (2, 1), (3, 2), (4, 3)]
    benefits = [(1, 5), (2, 6), (2, 6), (4, 5), (4, 5), (3, 9), (3, 40)]
    users = advice_of(spark, [(1, 0, 70), (1, 1, 20), (1, 2, 10), (1, 7, None)], [(1, 0), (1, 1), (1, 1), (1, 99), (2, 0)], cards, benefits)
    assert sorted(tuple(r) for r in profile.verdicts(users).collect()) == [(1, 1, 70, "keep"), (1, 2, 20, "switch")]  # user 2 spends nothing
    assert [tuple(r) for r in profile.alternatives(users).orderBy("place").collect()] == [(1, 4, 70, 2, 46, 1), (1, 3, 10, 0, 10, 2)]
    assert sorted((r.card_id, r.part) for r in profile.combination(users).collect()) == [(1, "kept"), (4, "new")]


def test_advice_ends_and_ties(spark):
    cards = [(k, k) for k in range(5)]
    users = advice_of(spark, [(1, 8, 50), (2, 0, 0), (3, 0, 10), (None, 0, 1)], [(3, k) for k in range(5)], cards, [(0, 5), (1, 5)])
    got = [tuple(r) for r in profile.alternatives(users).collect()]
    assert sorted(r[1] for r in got if r[0] == 1) == [0, 1, 2] and {r[2] for r in got if r[0] == 1} == {0}  # ties in the order of the cards; spending that no card covers
    assert [(r[1], r[2]) for r in sorted(got, key=str) if r[0] == 2] == [(0, None), (1, None), (2, None)]  # a total of 0 has no fit
    assert not [r for r in got if r[0] == 3]  # owns them all
    assert {tuple(r) for r in profile.combination(users).collect()} == {(3, 0, "kept"), (3, 1, "kept")}
    assert sorted(r[1] for r in got if r[0] is None) == [0, 1, 2]
    none = advice_of(spark, [], [(1, 0)], cards, [])
    assert profile.alternatives(none).count() == profile.verdicts(none).count() == 0
    no_cards = advice_of(spark, [(1, 0, 5)], [(1, 0)], [], [])
    assert profile.alternatives(no_cards).count() == profile.combination(no_cards).count() == 0


def test_sample_verdict(spark):
    """The sample spending's card fits 59 percent: switch."""
    amounts = [450_000, 320_000, 180_000, 150_000, 120_000, 90_000, 75_000, 60_000, 55_000]
    users = advice_of(spark, [(1, 0, 885_000), (1, 9, sum(amounts) - 885_000)], [(1, 0)], [(7, 0)], [(7, 5)])
    assert [tuple(r) for r in profile.verdicts(users).collect()] == [(1, 7, 59, "switch")]


def test_overlap_counts_rows(spark):
    sets = spark.createDataFrame([(1, 1)], "user_id long, card_id long")
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "card_id long, category_id long")
    got = advice.overlap_categories(sets, rows).collect()
    assert [(r.category_id, r.n, r.cards) for r in got] == [(5, 2, "1")]


def test_last_wins_on_ties(spark):
    sets = spark.createDataFrame([(1, c, p) for p, c in enumerate((5, 6, 7))], "set_id long, card_id long, pos long")
    cards = spark.createDataFrame([(5, 10), (6, 10), (7, 3)], "card_id long, max_benefit long")
    got = compare.max_benefit_winner(sets, cards).first()
    assert (got.winner, got.tied) == (6, 2)


def test_pair_headline_divides_by_the_second(spark):
    rows = spark.createDataFrame([(1, 5, 0, 2, 1, 5), (1, 6, 1, 2, 1, 10), (2, 5, 0, 2, 1, 4), (2, 6, 1, 2, 1, 4)], "set_id long, card_id long, pos long, set_size long, category_id long, rate long")
    assert [tuple(r) for r in compare.pair_headline(rows).collect()] == [(1, 1, 6, 50)]


def test_histories(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    views = [(1, c, at(c)) for c in range(1, 12)] + [(1, 2, at(30))]
    got = [r.card_id for r in history.recent_views(spark.createDataFrame(views, "user_id long, card_id long, ts timestamp")).orderBy("place").collect()]
    assert got == [2, 11, 10, 9, 8, 7, 6, 5, 4, 3]
    events = spark.createDataFrame([(1, [1, 2], at(1), 1), (1, [2, 1], at(2), 2), (1, [3], at(3), 3)], "user_id long, card_ids array<long>, ts timestamp, set_id long")
    assert [(r.cards, r.number) for r in history.recent_compares(events).collect()] == [("2,1", 1)]


def test_basket_ignores_a_fourth(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    toggles = [(1, m, at(m), c) for m, c in enumerate((1, 2, 3, 4, 1, 4))]
    assert history.compare_basket(spark.createDataFrame(toggles, "user_id long, event_id long, ts timestamp, card_id long")).first().basket == "2,3,4"


def test_baskets_of_many_users_and_odd_rows(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "user_id long, event_id long, ts timestamp, card_id long"
    toggles = [(1, 1, at(1), 7), (1, 2, at(1), None), (1, 3, at(2), 8), (1, 4, None, 9), (2, 5, at(1), None), (None, 6, at(3), 5), (3, 7, at(1), 4), (3, 8, at(2), 4)]
    toggles += [(4, 100 + m, at(m % 50), m % 2) for m in range(30_001)]
    got = {r.user_id: r.basket for r in history.compare_basket(spark.createDataFrame(toggles, schema)).collect()}
    held = []
    for _, _, c in sorted((t, e, c) for u, e, t, c in toggles if u == 4):
        held = [x for x in held if x != c] if c in held else [*held, c]
    assert got == {1: "9,7,8", 2: "", None: "5", 3: "", 4: ",".join(map(str, held))}
    assert history.compare_basket(spark.createDataFrame([], schema)).count() == 0


def test_stored_histories(spark):
    got = history.parse_history(spark.createDataFrame([(1, "[3,1]", "[[1,2]]"), (2, "x", None)], "user_id long, viewed string, compared string")).orderBy("user_id").collect()
    assert (got[0].viewed, got[0].compared, got[1].viewed, got[1].compared) == ([3, 1], [[1, 2]], None, None)


def test_signups(spark):
    rows = [(1, "Ann", "a@x", "longenough", "longenough"), (2, "Bob", "a@x", "longenough", "longenough"), (3, "C", "", "short", "other"), (4, "Dan", "t@x", "short", "short"), (5, None, None, None, None)]
    got = {r.signup_id: r for r in accounts.validate_signups(spark.createDataFrame(rows, "signup_id long, name string, email string, password string, password_confirm string"), spark.createDataFrame([("t@x",)], "email string")).collect()}
    assert [got[k].accepted for k in range(1, 6)] == [True, False, False, False, False]
    assert got[3].form_errors == "name,email,password,password_confirm" and got[3].server_error == "password"
    assert got[4].server_error == "email" and got[5].form_errors == "name,email,password"
    assert "password" not in [c for c in got[1].asDict() if c == "password"]


def test_unmapped(spark):
    rows = spark.createDataFrame([("카페",), ("배달",), ("배�",)], "benefit_category string")
    got = {r.benefit_category: (r.n, r.damaged) for r in quality.unmapped_categories(rows, dims.match_map(spark), "benefit_category").collect()}
    assert got == {"배달": (1, False), "배�": (1, True)}


def test_candidates_in_issuer_order(spark):
    ranked = spark.createDataFrame([("b", 1, 1), ("b", 2, 1), ("a", 3, 1), ("a", 4, 2)], "company string, card_id long, card_rank long")
    order = spark.createDataFrame([("b", 0), ("a", 1)], "company string, issuer_pos long")
    assert sorted((r.candidate_pos, r.card_id) for r in ranking.candidate_cards(ranked, order).collect()) == [(0, 1), (1, 3)]


def test_statements_and_catalogue(spark, tmp_path):
    (tmp_path / "s.csv").write_text("user_id,card_id,ts,category,amount\n1,2,2024-01-01 00:00:00,카페,100\nx,2,bad,카페,y\n")
    rows = io.read_statements_csv(spark, str(tmp_path / "s.csv")).cache()
    assert rows.filter("_corrupt_record IS NULL").count() == 1 and rows.count() == 2
    (tmp_path / "s.json").write_text('{"user_id":1,"card_id":2,"ts":"2024-01-01 00:00:00","category":"c","amount":5}\n{broken\n')
    rows = io.read_statements_json(spark, str(tmp_path / "s.json")).cache()
    assert rows.filter("_corrupt_record IS NOT NULL").count() == 1
    (tmp_path / "c.json").write_text('[{"id":1,"name":"a","tags":["x","y"],"benefits":[{"category":"카페","discountRate":5.5},{"category":"주유"}],"eventBenefits":[]},{"id":2,"name":"b"}]')
    parts = catalogue.normalise_catalogue(io.read_catalogue(spark, str(tmp_path / "c.json"), lines=False))
    assert {k: v.count() for k, v in parts.items()} == {"card": 2, "benefit": 2, "tag": 2, "event": 0, "damaged": 0}
    assert [r.benefit_pos for r in parts["benefit"].orderBy("benefit_pos").collect()] == [1, 2]


@pytest.mark.parametrize("buckets", [None, 4])
def test_write_and_read(spark, tmp_path, buckets):
    df = spark.createDataFrame([(u, u % 2) for u in range(20)], "user_id long, company long")
    io.write_table(df, str(tmp_path / "t.parquet"), ["company"], user_buckets=buckets)
    back = io.read_tables(spark, str(tmp_path), ["t"])["t"]
    assert back.count() == 20 and set(df.columns) <= set(back.columns)


def test_places_of_one_month_over_many_partitions(spark, sf_dir):
    """Long runs of ties cross the partitions' bounds; every place is the one that a sort of the whole month gives."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = spark.range(5_000).select(F.lit("m1").alias("month"), ((F.col("id") * 7919) % 5_000).alias("card_id"), (F.col("id") % 3).alias("views"), F.lit(1).alias("clicks"))
        rows = rows.unionByName(spark.createDataFrame([(None, 1, 0, 0), (None, 2, 4, 0), ("m2", 9, 0, 0)], "month string, card_id long, views long, clicks int"))
        plan = ranking.popularity_ranking(rows, ["month"])._jdf.queryExecution().executedPlan().toString()
        parts = ranking.placed(rows.withColumn("score", F.col("views")), ["month"], [F.desc("score"), F.asc("card_id")], "score")
        got = ranking.popularity_ranking(rows, ["month"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "Window" not in plan and parts.count() == 5_003
    month = [r for r in got if r.month == "m1"]
    assert [r.card_id for r in sorted(month, key=lambda r: r.place)] == [r.card_id for r in sorted(month, key=lambda r: (-r.score, r.card_id))]
    assert sorted(r.place for r in month) == list(range(1, 5_001))
    assert {(r.month, r.card_id, r.place, r.bar) for r in got if r.month != "m1"} == {(None, 2, 1, 100), (None, 1, 2, 0), ("m2", 9, 1, None)}


def test_ranking_of_nothing(spark):
    assert ranking.popularity_ranking(spark.createDataFrame([], "month string, card_id long, views long, clicks long"), ["month"]).count() == 0


def test_first_of_equal_emails(spark):
    rows = [(k, "Ann", "a@x", "longenough" if k else "short", "longenough" if k else "short", None) for k in range(5)] + [(9, "Bo", "b@x", "longenough", "longenough", None), (8, "Bo", None, "longenough", "longenough", None), (7, "Bo", "t@x", "longenough", "longenough", None)]
    signups = spark.createDataFrame(rows, "signup_id long, name string, email string, password string, password_confirm string, phone string")
    users = spark.createDataFrame([("t@x",), ("t@x",)], "email string")
    got = {r.signup_id: r.accepted for r in accounts.validate_signups(signups, users).collect()}
    assert len(got) == len(rows) and {k for k, v in got.items() if v} == {1, 9}


def test_substring_pairs_are_those_of_all_pairs(spark):
    texts = ["", "a", "abc", "abcabc", "여행/숙박", "행", "aXbXc", "xx xx", None, "abc", "zz" * 500]
    needles = ["", "a", "b", "bc", "abc", "cab", "abcabcabc", "행/숙", "여행/숙박", "X", "xx x", None, "zzzz", "q", "abc"]
    got = substrings.substring_pairs(spark.createDataFrame([(t, 1) for t in texts], "text string, n long"), spark.createDataFrame([(n, 1) for n in needles], "needle string, size long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(t, n) for t in texts for n in needles if t is not None and n is not None and n in t})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    nothing = spark.createDataFrame([], "text string, needle string")
    assert substrings.substring_pairs(nothing, nothing).count() == 0


def test_many_searches_are_the_single_ones(spark):
    cards = spark.createDataFrame([(1, "Gold Ring", "KB", ["Ring", "X"], 0), (2, "ring ring", None, None, 0), (3, None, "ringer", [], 0), (4, "카드 하나", "BC", ["하나"], 0)], "card_id long, card_name string, company string, tags array<string>, query long")
    asked = ["RING", "ring", "", "x", "X", "kb", "하나", "드 하", "none", "g r"]
    searches = spark.createDataFrame([(k, q) for k, q in enumerate(asked)] + [(99, None), (100, "ring")], "search_id long, query string")
    got = catalogue.search_many(cards, searches)
    for k, q in [*enumerate(asked), (100, "ring")]:
        assert sorted(r.card_id for r in got.filter(F.col("search_id") == k).collect()) == sorted(r.card_id for r in catalogue.search_cards(cards, q).collect())
    assert got.filter("search_id = 99").count() == 0


def test_many_selections_are_the_single_ones(spark):
    cards = spark.createDataFrame([(1, "쇼핑 / 마트"), (2, "영화 / 카페"), (3, None), (4, "Ring"), (5, "쇼핑 / 영화")], "card_id long, summary string")
    asked = {1: ["온라인쇼핑"], 2: ["백화점/아울렛", "문화/엔터"], 3: ["반려동물"], 4: ["ring"], 5: [None], 6: ["온라인쇼핑", None, "온라인쇼핑"], 7: ["반려동물", "온라인쇼핑"]}
    rows = spark.createDataFrame([(k, c) for k, v in asked.items() for c in v], "request_id long, category string")
    got = catalogue.match_selections(cards, rows, dims.keyword_map(spark)).collect()
    for k, v in asked.items():
        assert sorted(r.card_id for r in got if r.request_id == k) == sorted(r.card_id for r in catalogue.match_categories(cards, list(dict.fromkeys(filter(None, v)))).collect())


def test_selection_hits_are_the_single_ones(spark):
    bridge = spark.createDataFrame([(k, f"b{k}", k) for k in range(1, 22)], "card_id long, benefit_id string, category_id long")
    asked = {1: ["편의점", "쇼핑"], 2: ["의료", "의료"], 3: ["반려동물"], 4: [None], 5: ["외"]}
    rows = spark.createDataFrame([(k, c) for k, v in asked.items() for c in v], "request_id long, category string")
    got = catalogue.selection_hits(bridge, rows, dims.keyword_map(spark), dims.categories(spark)).collect()
    for k, v in asked.items():
        one = {(r.card_id, r.category_name) for r in catalogue.selected_category_hits(bridge, list(filter(None, v))).collect()}
        assert sorted((r.card_id, r.category_name) for r in got if r.request_id == k) == sorted(one)


def test_catalogue_lines_are_split_and_damage_is_kept(spark, tmp_path):
    """One file of lines is read by many tasks; lines that are no card are kept as text and are no card."""
    lines = ['{"id":%d,"name":"card %d","tags":["x",null],"benefits":[{"category":"카페","discountRate":5.5,"maxMonthly":10},null],"eventBenefits":["e"]}' % (k, k) for k in range(20_000)]
    (tmp_path / "c.json").write_text("\n".join([*lines, "{broken", '{"id":"no number"}', "", '{"id":20000}']))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert io.scan_catalogue(spark, str(tmp_path / "c.json")).rdd.getNumPartitions() > 5
        parts = catalogue.normalise_catalogue(io.read_catalogue(spark, str(tmp_path / "c.json")))
        assert {k: v.count() for k, v in parts.items()} == {"card": 20_001, "benefit": 20_000, "tag": 40_000, "event": 20_000, "damaged": 2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_card_with_very_many_benefits_is_many_chunks(spark):
    cards = spark.createDataFrame([(1, "hot", "x"), (2, "none", "x"), (3, "one", "x")], "card_id long, card_name string, company string")
    hot = spark.range(1, 100_001).select(F.lit(1).cast("long").alias("card_id"), F.col("id").alias("benefit_pos"))
    rows = hot.unionByName(spark.createDataFrame([(3, 1)], "card_id long, benefit_pos long"))
    benefits = rows.select(
        "*", F.concat_ws("-", "card_id", "benefit_pos").alias("benefit_id"), F.array().cast("array<bigint>").alias("category_ids"), F.lit("t").alias("benefit_title"),
        F.lit(None).cast("string").alias("benefit_content"), F.lit(None).cast("decimal(12,2)").alias("benefit_value"), F.lit("%").alias("benefit_unit"), F.lit(None).cast("long").alias("max_limit"),
    )
    detail = catalogue.card_detail(cards, benefits).cache()
    got = detail.select("card_id", "chunk", "n_chunks", F.size("benefits").alias("n"), F.get("benefits", F.lit(0))["benefit_pos"].alias("first")).collect()
    assert sorted((r.chunk, r.n_chunks, r.n, r.first) for r in got if r.card_id == 1) == [(k, 100, 1_000, k * 1_000 + 1) for k in range(100)]
    assert sorted((r.card_id, r.chunk, r.n_chunks, r.n) for r in got if r.card_id > 1) == [(2, 0, 1, 0), (3, 0, 1, 1)]
    flat = catalogue.unnested(detail)
    assert flat.count() == 100_002 and flat.filter("card_id = 2").first().benefit_pos is None


def test_tables_bucketed_by_user_meet_without_an_exchange(spark):
    views = spark.createDataFrame([(u, [u, 5, 7]) for u in range(50)] + [(None, [1])], "user_id long, viewed array<long>")
    liked = spark.createDataFrame([(u, c) for u in range(0, 60, 2) for c in (5, u)], "user_id long, card_id long")
    a, b = io.bucketed(views, *io.scratch_table(spark, "a"), buckets=8), io.bucketed(liked, *io.scratch_table(spark, "b"), buckets=8)
    met = history.viewed_favourites(a, b)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = {(u, c, k, u % 2 == 0 and c in (5, u)) for u in range(50) for k, c in enumerate((u, 5, 7), 1)} | {(None, 1, 1, False)}
    assert {tuple(r) for r in met.collect()} == want
    files = [r.f for r in b.select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) <= 8


def test_jdbc_is_read_in_ranges_with_nulls_and_pushed_filters(spark):
    url = io.scratch_database(spark)
    cards = spark.createDataFrame([(k if k % 10 else None, k, f"card {k}") for k in range(100)], "card_key long, fee long, name string").coalesce(2)
    cards.write.format("jdbc").options(url=url, dbtable="card", createTableColumnTypes="name VARCHAR(40)").save()
    cards.limit(0).write.format("jdbc").options(url=url, dbtable="empty", createTableColumnTypes="name VARCHAR(40)").save()
    read = io.read_tables(spark, {"url": url}, ["card", "empty"], "card_key", 4)
    assert read["card"].rdd.getNumPartitions() == 4 and read["card"].count() == 100 and read["card"].filter("card_key IS NULL").count() == 10
    sizes = read["card"].groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4
    some = read["card"].filter("fee >= 90").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fee,90)" in plan and "fee" not in plan.partition("ReadSchema")[2]
    assert {r.name for r in some.collect()} == {f"card {k}" for k in range(90, 100)}
    assert read["empty"].count() == 0 and read["empty"].rdd.getNumPartitions() == 1


def test_histories_come_back_from_their_texts(spark):
    rows = spark.createDataFrame([(1, [3, 1], [[1, 2], [3, 4, 5]]), (2, [], []), (3, None, None), (None, [9], [[]])], "user_id long, viewed array<long>, compared array<array<long>>")
    texts = history.write_history(rows)
    assert {(r.user_id, r.viewed, r.compared) for r in texts.collect()} == {(1, "[3,1]", "[[1,2],[3,4,5]]"), (2, "[]", "[]"), (3, "[]", "[]"), (None, "[9]", "[[]]")}
    back = {r.user_id: (r.viewed, r.compared) for r in history.parse_history(texts).collect()}
    assert back == {1: ([3, 1], [[1, 2], [3, 4, 5]]), 2: ([], []), 3: ([], []), None: ([9], [[]])}


def test_cells_show_the_kind_and_a_real_condition(spark):
    sets = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "set_id long, card_id long, pos long")
    rates = spark.createDataFrame([(5, 3, 5.0, "%", 9, "cashback", "제한없음"), (6, 3, 1.0, None, None, "gift", "월 1회"), (6, 4, 1.0, None, None, None, None), (9, 9, 1.0, None, None, None, None)], "card_id long, category_id long, rate double, unit string, max_limit long, benefit_kind string, condition string")
    sets = sets.unionByName(spark.createDataFrame([(2, 7, 0), (2, 5, 1), (3, 7, 0), (3, 8, 1)], sets.schema))  # cards without rates
    got = {(r.set_id, r.card_id, r.category_id): (r.rate, r.kind, r.condition) for r in compare.benefit_cells(sets, rates).collect()}
    assert got == {(1, 5, 3): (5.0, "캐시백", None), (1, 6, 3): (1.0, None, "월 1회"), (1, 6, 4): (1.0, None, None), (1, 5, 4): (None, None, None), (2, 5, 3): (5.0, "캐시백", None), (2, 7, 3): (None, None, None)}


def test_searches_tell_each_card_once_without_comparing_rows(spark):
    cards = spark.createDataFrame([(1, "Gold Ring", "Ring Co", ["Ring", "Ring", "ring"]), (2, None, "ringer", None), (3, "x", None, ["ring", None, "rings"])], "card_id long, card_name string, company string, tags array<string>")
    searches = spark.createDataFrame([(1, "ring"), (1, "ring"), (1, "RING"), (1, "gold"), (1, None), (2, ""), (3, "ings")], "search_id long, query string")
    got = catalogue.search_many(cards, searches)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # a search may find most cards: no task keeps what it has told


def compared_sets(spark):
    sets = [(1, 5, 0), (1, 6, 1), (1, 7, 2), (2, 6, 0), (2, 5, 1), (3, 7, 0), (3, 8, 1), (4, 8, 0), (4, 5, 2)]
    rates = [(5, 3, 5.0, 4), (5, 2, 1.0, 1), (6, 3, 2.0, 1), (6, 9, 0.5, 1), (7, 3, 7.0, 2), (99, 3, 9.0, 1)]
    return spark.createDataFrame(sets, "set_id long, card_id long, pos long"), spark.createDataFrame(rates, "card_id long, category_id long, rate double, benefit_pos long")


def is_told_from_one_row(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Aggregate" not in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_rate_matrix_is_told_from_one_row_a_set(spark):
    got = compare.rate_matrix(compare.met_sets(*compared_sets(spark), "rate"))
    want = {(1, 3, 5.0, 2.0, 7.0), (1, 2, 1.0, 0.0, 0.0), (1, 9, 0.0, 0.5, 0.0), (2, 3, 2.0, 5.0, 0.0), (2, 2, 0.0, 1.0, 0.0), (2, 9, 0.5, 0.0, 0.0), (3, 3, 7.0, 0.0, 0.0), (4, 3, 0.0, 0.0, 5.0), (4, 2, 0.0, 0.0, 1.0)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and is_told_from_one_row(got)


def test_cells_are_told_from_one_row_a_set(spark):
    sets, rates = compared_sets(spark)
    got = compare.benefit_cells(sets, rates.selectExpr("*", "'%' AS unit", "1L AS max_limit", "'cashback' AS benefit_kind", "'x' AS condition"))
    cells = {(r.set_id, r.card_id, r.category_id): r.rate for r in got.collect()}
    assert len(cells) == got.count() == 9 + 6 + 2 + 4 and cells[1, 7, 3] == 7.0 and cells[4, 8, 2] is None and is_told_from_one_row(got)


def test_shared_categories_are_told_from_one_row_a_set(spark):
    got = compare.shared_categories(compare.met_sets(*compared_sets(spark), "rate"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3), (2, 3)] and is_told_from_one_row(got)


def test_set_categories_are_told_from_one_row_a_set(spark):
    got = compare.set_categories(compare.met_sets(*compared_sets(spark), "benefit_pos"))
    want = [(1, 2, 1), (1, 3, 2), (1, 9, 3), (2, 2, 3), (2, 3, 1), (2, 9, 2), (3, 3, 1), (4, 2, 1), (4, 3, 2)]
    assert sorted(tuple(r) for r in got.collect()) == want and is_told_from_one_row(got)


def test_scores_are_told_from_one_row_a_set(spark):
    sets, _ = compared_sets(spark)
    cards = spark.createDataFrame([(5, 10, 0, 0, 40), (6, 10, 0, 0, 40), (7, 5, None, 4, 50)], "card_id long, max_benefit long, annual_fee_dom_basic int, min_performance int, rating_x10 long")
    scores = compare.score_sets(sets, cards, spark.createDataFrame([(6, 2), (7, 1)], "card_id long, n_benefits long"))
    rows = {(r.set_id, r.card_id): (r.total, r.place, r.medal) for r in compare.compare_scores(scores).collect()}
    assert rows == {(1, 6): (97, 0, 1), (1, 5): (87, 1, 2), (1, 7): (None, 2, 3), (2, 6): (97, 0, 1), (2, 5): (87, 1, 2), (3, 7): (None, 0, 1), (4, 5): (87, 0, 1)}
    wide = compare.score_matrix(scores)
    assert wide.count() == 20 and {tuple(r) for r in wide.filter("subject = 'diversity_score'").collect()} == {(1, "diversity_score", 0, 100, 50), (2, "diversity_score", 100, 0, None), (3, "diversity_score", 100, None, None), (4, "diversity_score", None, None, 0)}
    assert is_told_from_one_row(wide)
