"""DuckDB SQL twins of the card queries, over the same raw tables and by the same mapping rules."""

from __future__ import annotations

from cardloom.sources import dims

ISSUERS_ALLOWED = [f"Brand#{i}" for i in range(11, 20)]

DOMAIN = """
card AS (
  SELECT p_partkey AS card_id, p_name AS card_name, p_brand AS company,
         CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '체크' ELSE '신용' END AS card_type,
         CASE p_partkey % 5 WHEN 0 THEN 'VISA' WHEN 1 THEN 'Mastercard' WHEN 2 THEN 'BC' WHEN 3 THEN '신한' END AS network,
         (p_size % 15 * 10000)::INT AS annual_fee_dom_basic, (p_size % 7 * 100000)::INT AS min_performance,
         replace(p_name, ' ', ' / ') AS summary, string_split(p_name, ' ') AS tags,
         p_partkey % 3 = 0 AS has_cashback, p_partkey % 2 = 0 AS has_transport,
         round(p_retailprice * 100)::BIGINT AS max_benefit, 40 + p_partkey % 11 AS rating_x10
  FROM part),
benefit0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS benefit_pos
  FROM lineitem WHERE l_linenumber <= 2),
benefit AS (
  SELECT l_partkey || '-' || benefit_pos AS benefit_id, l_partkey AS card_id, benefit_pos,
         CASE WHEN l_returnflag <> 'N' THEN 'T' || (l_suppkey % 4) END AS benefit_title,
         CASE WHEN l_suppkey % 7 <> 0 THEN 'C' || (l_suppkey % 6) END AS benefit_content,
         CASE WHEN round(l_tax * 100)::INT <> 8 THEN (round(l_discount * 200) + l_suppkey % 4 * 0.25)::DECIMAL(12, 2) END AS benefit_value,
         CASE WHEN l_linestatus = 'O' THEN '%' END AS benefit_unit,
         CASE WHEN NOT (round(l_discount * 100)::INT = 1 AND round(l_tax * 100)::INT = 0) THEN round(l_extendedprice / 100)::BIGINT END AS max_limit,
         CASE l_suppkey % 6 WHEN 0 THEN 'discount' WHEN 1 THEN 'cashback' WHEN 2 THEN 'point' WHEN 3 THEN 'special' WHEN 4 THEN 'gift' END AS benefit_kind,
         CASE WHEN l_suppkey % 3 = 0 THEN '제한없음' WHEN l_suppkey % 11 <> 0 THEN 'S' || (l_suppkey % 5) END AS condition,
         l_suppkey, l_linenumber, l_quantity
  FROM benefit0),
bridge AS (
  SELECT benefit_id, card_id, benefit_pos, l_suppkey % 21 + 1 AS category_id FROM benefit WHERE l_suppkey % 13 <> 0
  UNION
  SELECT benefit_id, card_id, benefit_pos, (l_suppkey + l_quantity::BIGINT) % 21 + 1 FROM benefit WHERE l_suppkey % 13 <> 0 AND l_linenumber = 2),
category AS (SELECT * FROM (VALUES {categories}) AS t(category_id, category_name)),
persona_weight AS (SELECT * FROM (VALUES {weights}) AS t(persona, category_id, weight)),
match_map AS (SELECT i // 2 AS spend_category, i + 1 AS category_id FROM range(18) AS t(i)),
card_rank AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY max_benefit DESC, card_id) AS card_rank FROM card),
candidate AS (SELECT card_id, company, row_number() OVER (ORDER BY company) - 1 AS candidate_pos FROM card_rank WHERE card_rank = 1),
owned AS (
  SELECT DISTINCT c_custkey AS user_id, card_id, candidate_pos FROM customer,
         unnest([c_custkey % 25, (c_custkey * 7 + 3) % 25, (c_custkey * 11 + 5) % 25]) AS u(p) JOIN candidate ON candidate_pos = p),
tx AS (
  SELECT o_custkey AS user_id, o_orderdate AS ts, l_suppkey % 9 AS spend_category, round(l_extendedprice)::BIGINT AS amount, l_suppkey % 25 AS candidate_pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
spend AS (SELECT user_id, spend_category, sum(amount)::BIGINT AS amount FROM tx GROUP BY ALL),
total AS (SELECT user_id, sum(amount)::BIGINT AS total FROM spend GROUP BY ALL),
crows AS (SELECT * FROM bridge WHERE card_id IN (SELECT card_id FROM candidate)),
coverage AS (SELECT DISTINCT card_id, spend_category FROM crows JOIN match_map USING (category_id)),
fit AS (
  SELECT user_id, c.card_id, candidate_pos, (200 * coalesce(sum(amount), 0)::BIGINT + total) // (2 * total) AS fit
  FROM total CROSS JOIN candidate c LEFT JOIN (SELECT card_id, user_id, amount FROM coverage JOIN spend USING (spend_category)) USING (user_id, card_id)
  GROUP BY user_id, c.card_id, candidate_pos, total),
orows AS (SELECT o.user_id, c.* FROM owned o JOIN crows c USING (card_id)),
verdict AS (SELECT user_id, card_id, fit, CASE WHEN fit >= 60 THEN 'keep' ELSE 'switch' END AS verdict FROM owned JOIN fit USING (user_id, card_id)),
alternative AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, candidate_pos) AS place FROM (
    SELECT f.user_id, f.card_id, f.candidate_pos, f.fit, count(m.category_id) AS n_overlaps, f.fit - 12 * count(m.category_id) AS score
    FROM (SELECT * FROM fit ANTI JOIN owned USING (user_id, card_id)) f
    LEFT JOIN crows r ON r.card_id = f.card_id
    LEFT JOIN (SELECT DISTINCT user_id, category_id FROM orows) m ON m.user_id = f.user_id AND m.category_id = r.category_id
    GROUP BY f.user_id, f.card_id, f.candidate_pos, f.fit)),
event AS (SELECT event_id, user_id, ts, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
monthly AS (
  SELECT date_trunc('month', ts)::DATE AS month, k AS card_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks
  FROM event WHERE event_type IN ('view', 'click') GROUP BY ALL),
popular AS (
  SELECT month, card_id, views + clicks AS score, row_number() OVER (PARTITION BY month ORDER BY views + clicks DESC, card_id) AS place,
         (200 * (views + clicks) + max(views + clicks) OVER (PARTITION BY month)) // (2 * max(views + clicks) OVER (PARTITION BY month)) AS bar
  FROM monthly JOIN card USING (card_id) WHERE card_type = '신용'),
item AS (
  SELECT set_id, o_custkey AS user_id, o_orderdate AS ts, card_id, pos FROM (
    SELECT l_orderkey AS set_id, card_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, card_id) - 1 AS pos
    FROM (SELECT l_orderkey, l_partkey % 40 AS card_id, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)) JOIN orders ON set_id = o_orderkey
  WHERE pos <= 2),
sets AS (SELECT * FROM (SELECT set_id, card_id, pos, count(*) OVER (PARTITION BY set_id) AS set_size FROM item) WHERE set_size >= 2),
firsts AS (SELECT b.*, c.category_id FROM benefit b JOIN (SELECT benefit_id, min(category_id) AS category_id FROM bridge GROUP BY ALL) c USING (benefit_id)),
rate AS (
  SELECT card_id, category_id, coalesce(benefit_value, 0)::DECIMAL(12, 2) AS rate, (coalesce(benefit_value, 0) * 100)::BIGINT AS cents, benefit_unit AS unit, max_limit, benefit_pos, benefit_kind, condition
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id, category_id ORDER BY benefit_pos) AS k FROM firsts) WHERE k = 1),
rates AS (SELECT * FROM sets JOIN rate USING (card_id)),
counts AS (SELECT card_id, count(*) AS n_benefits FROM benefit GROUP BY ALL),
top AS (
  SELECT set_id, card_id, pos, max_benefit, annual_fee_dom_basic, min_performance, rating_x10, coalesce(n_benefits, 0) AS n,
         greatest(max(max_benefit) OVER s, 1) AS mb, greatest(max(annual_fee_dom_basic) OVER s, 1)::BIGINT AS mf,
         greatest(max(min_performance) OVER s, 1)::BIGINT AS mp, greatest(max(coalesce(n_benefits, 0)) OVER s, 1) AS mn
  FROM sets JOIN card USING (card_id) LEFT JOIN counts USING (card_id) WINDOW s AS (PARTITION BY set_id)),
part_scores AS (
  SELECT set_id, card_id, pos, (200 * max_benefit + mb) // (2 * mb) AS benefit_score, (200 * (mf - annual_fee_dom_basic) + mf) // (2 * mf) AS fee_score,
         (200 * (mp - min_performance) + mp) // (2 * mp) AS spending_score, 2 * rating_x10 AS rating_score, (200 * n + mn) // (2 * mn) AS diversity_score FROM top),
scores AS (
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY total DESC, pos) - 1 AS place FROM (
    SELECT *, (30 * benefit_score + 25 * fee_score + 20 * spending_score + 15 * rating_score + 10 * diversity_score + 50) // 100 AS total FROM part_scores)),
shared AS (SELECT *, count(*) OVER (PARTITION BY set_id, category_id) AS n FROM rates QUALIFY n = set_size),
detail AS (
  SELECT card_id, card_name, benefit_id, benefit_pos, CASE WHEN benefit_id IS NOT NULL THEN coalesce(category_name, '기타') END AS category, benefit_title, benefit_content,
         CASE WHEN benefit_id IS NOT NULL THEN coalesce(benefit_value::VARCHAR, '') || coalesce(benefit_unit, '') END AS value_text, max_limit
  FROM card LEFT JOIN benefit USING (card_id) LEFT JOIN (SELECT benefit_id, min(category_id) AS category_id FROM bridge GROUP BY ALL) USING (benefit_id) LEFT JOIN category USING (category_id))
"""

STATEMENTS = """SELECT user_id, card_id, ([{spending}])[spend_category + 1] AS category, count(*) AS n, sum(amount)::BIGINT AS amount, max(ts)::DATE AS last_day, 0::BIGINT AS damaged
        FROM tx JOIN candidate USING (candidate_pos) GROUP BY ALL"""

QUERIES = {
    "card_list": "SELECT card_id, card_name, company, card_type, annual_fee_dom_basic AS annual_fee, min_performance, summary, has_cashback AS has_event, has_transport FROM card",
    "card_filter": """SELECT card_id, company, card_type, annual_fee_dom_basic, min_performance FROM card
        WHERE card_type = '신용' AND annual_fee_dom_basic BETWEEN 1 AND 100000 AND min_performance <= 500000 AND has_cashback
          AND company IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22', 'Brand#31', 'Brand#32', 'Brand#41', 'Brand#42', 'Brand#51', 'Brand#52')""",
    "category_keyword_match": """SELECT card_id, selected FROM card, (VALUES ('A'), ('B'), ('A,B'), ('pin'), ('')) AS t(selected)
        WHERE CASE selected WHEN 'A' THEN contains(lower(summary), 'ring') WHEN 'B' THEN contains(lower(summary), 'widget') OR contains(lower(summary), 'bolt')
              WHEN 'A,B' THEN contains(lower(summary), 'ring') AND (contains(lower(summary), 'widget') OR contains(lower(summary), 'bolt'))
              WHEN 'pin' THEN contains(lower(summary), 'pin') ELSE true END""",
    "card_search": """SELECT card_id, card_name, company FROM card WHERE card_id % 10 <> 0
        AND (contains(lower(card_name), 'ring') OR contains(lower(company), 'ring') OR len(list_filter(tags, lambda t: contains(t, 'RING'))) > 0)""",
    "card_searches": """SELECT search_id, card_id FROM card, (
          SELECT w || '/' || k AS search_id, CASE WHEN k % 2 = 0 THEN upper(p) ELSE p END AS query FROM (
            SELECT w, k, substring(w, 1 + length(w) % 3, k) AS p FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), range(1, 6) AS t(k))
          UNION ALL SELECT DISTINCT 'of/' || p_brand, upper(p_brand) FROM part UNION ALL SELECT 'all', '')
        WHERE contains(lower(card_name), lower(query)) OR contains(lower(company), lower(query)) OR len(list_filter(tags, lambda t: contains(t, query))) > 0""",
    "selection_matches": """SELECT request_id, card_id FROM card, ({chosen_cards}) GROUP BY ALL
        HAVING bool_and(category IS NULL OR CASE category WHEN 'A' THEN contains(lower(summary), 'ring') WHEN 'B' THEN contains(lower(summary), 'widget') OR contains(lower(summary), 'bolt')
               WHEN 'C' THEN false ELSE contains(lower(summary), lower(category)) END)""",
    "selection_category_hits": """SELECT DISTINCT request_id, card_id, benefit_id, category_name FROM bridge JOIN category USING (category_id) JOIN ({chosen_names}) ON
          CASE category WHEN '백화점/아울렛' THEN contains(category_name, '마트') OR contains(category_name, '쇼핑') WHEN '반려동물' THEN false
               WHEN '의료' THEN contains(category_name, '의료') OR contains(category_name, '병원') OR contains(category_name, '약국') ELSE contains(category_name, category) END""",
    "decode_dimensions": """SELECT card_id, CASE card_type WHEN '신용' THEN 'credit' ELSE 'debit' END AS type, card_type AS type_back,
        coalesce(network, 'VISA') AS network, company FROM card""",
    "card_sort": "SELECT card_id, len(list_filter(list_transform(string_split(summary, '/'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS items FROM card",
    "card_preview": """SELECT card_id, array_to_string(tags[1:2], ',') AS tags, array_to_string(i[1:2], ',') AS items, len(i)::BIGINT AS n_items
        FROM (SELECT *, list_filter(list_transform(string_split(summary, '/'), lambda x: trim(x)), lambda x: x <> '') AS i FROM card)""",
    "card_detail": "SELECT card_id, card_name, benefit_pos, category, benefit_title, benefit_content, value_text, max_limit FROM detail",
    "benefit_groups": """SELECT card_id, category, title, value_text, max_limit, contents, arg_min(title, p) OVER (PARTITION BY card_id, category) AS preview FROM (
          SELECT card_id, category, title, min(benefit_pos) AS p, max(value_text) FILTER (k = 1) AS value_text, max(max_limit) FILTER (k = 1) AS max_limit,
                 coalesce(string_agg(benefit_content, '|' ORDER BY benefit_pos) FILTER (benefit_content IS NOT NULL AND f = 1), '') AS contents
          FROM (SELECT *, row_number() OVER (PARTITION BY card_id, category, title ORDER BY benefit_pos) AS k,
                       row_number() OVER (PARTITION BY card_id, category, title, benefit_content ORDER BY benefit_pos) AS f
                FROM (SELECT *, coalesce(benefit_title, benefit_content, '기타 혜택') AS title FROM detail WHERE benefit_id IS NOT NULL AND category <> '기타'))
          GROUP BY ALL)""",
    "selected_category_hits": """SELECT card_id, benefit_id, category_name, selected FROM bridge JOIN category USING (category_id)
        JOIN (SELECT DISTINCT category_id, selected FROM category JOIN (VALUES ('백화점/아울렛', '마트'), ('백화점/아울렛', '쇼핑'), ('편의점', '편의점'), ('쇼핑', '쇼핑'),
              ('의료', '의료'), ('의료', '병원'), ('의료', '약국')) AS t(selected, keyword) ON contains(category_name, keyword)) USING (category_id)""",
    "facet_counts": """SELECT CASE WHEN grouping(company) = 1 THEN '전체' ELSE company END AS company, CASE WHEN grouping(card_type) = 1 THEN 'all' ELSE card_type END AS card_type, count(*) AS n
        FROM card GROUP BY CUBE (company, card_type)""",
    "practicality_score": """SELECT card_id, persona, least(100, (200 * s + 15000000) // 30000000)::BIGINT AS practicality_score FROM (
          SELECT card_id, persona, coalesce(sum(CASE WHEN benefit_value IS NOT NULL AND w IS NOT NULL THEN (least(benefit_value, 15) * 100)::BIGINT * w END), 0)::BIGINT AS s
          FROM benefit CROSS JOIN (SELECT DISTINCT persona FROM persona_weight)
          LEFT JOIN (SELECT benefit_id, persona, max(weight) AS w FROM bridge JOIN persona_weight USING (category_id) GROUP BY ALL) USING (benefit_id, persona) GROUP BY ALL)""",
    "fee_performance_score": """SELECT card_id, greatest(0, 100 - annual_fee_dom_basic::BIGINT * 100 // 50000) AS annual_fee_score, greatest(0, 100 - min_performance::BIGINT * 100 // 1000000) AS performance_score FROM card""",
    "diversity_score": "SELECT card_id, least(100, count(DISTINCT category_id) * 100 // 12)::BIGINT AS diversity_score FROM benefit LEFT JOIN bridge USING (card_id, benefit_id) GROUP BY ALL",
    "limit_score": """SELECT card_id, CASE WHEN bool_or(max_limit IS NULL AND benefit_value IS NOT NULL) THEN 100
        ELSE least(100, (200 * coalesce(sum(max_limit), 0) + 50000) // 100000) END::BIGINT AS limit_score FROM benefit GROUP BY ALL""",
    "card_scores": """SELECT c.card_id, c.annual_fee_score, c.performance_score, coalesce(d.diversity_score, 0) AS diversity_score, coalesce(l.limit_score, 0) AS limit_score, p.persona,
        coalesce(q.practicality_score, 0) AS practicality_score FROM ({fee_performance_score}) c CROSS JOIN (SELECT DISTINCT persona FROM persona_weight) p
        LEFT JOIN ({diversity_score}) d ON d.card_id = c.card_id LEFT JOIN ({limit_score}) l ON l.card_id = c.card_id LEFT JOIN ({practicality_score}) q ON q.card_id = c.card_id AND q.persona = p.persona""",
    "spend_by_category": "SELECT * FROM spend",
    "spend_summary": """SELECT user_id, total, count(*) AS n_categories, arg_max(spend_category, (amount, spend_category)) AS top_category, (200 * max(amount) + total) // (2 * total) AS top_share
        FROM spend JOIN total USING (user_id) GROUP BY user_id, total""",
    "spend_share": """SELECT user_id, spend_category, amount, (200 * amount + total) // (2 * total) AS share, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, spend_category) AS place FROM spend JOIN total USING (user_id)""",
    "card_fit": "SELECT user_id, card_id, fit FROM fit",
    "candidate_cards": "SELECT company, card_id, candidate_pos FROM candidate",
    "candidate_by_fit": """SELECT user_id, card_id, fit, CASE WHEN fit >= 60 THEN 'high' WHEN fit >= 40 THEN 'mid' ELSE 'low' END AS band,
        row_number() OVER (PARTITION BY user_id ORDER BY fit DESC, candidate_pos) AS place FROM fit""",
    "matched_benefits": """SELECT user_id, card_id, benefit_id, category_id FROM orows SEMI JOIN (SELECT user_id, category_id FROM spend JOIN match_map USING (spend_category)) USING (user_id, category_id)""",
    "benefit_status": """SELECT user_id, card_id, benefit_id, CASE WHEN n > 1 THEN 'overlap' WHEN matched IS NOT NULL THEN 'active' ELSE 'unused' END AS status,
          CASE WHEN n = 1 THEN matched END AS matched FROM (
          SELECT o.user_id, f.card_id, f.benefit_id, f.category_id, count(*) OVER (PARTITION BY o.user_id, f.category_id) AS n FROM owned o JOIN firsts f USING (card_id))
        LEFT JOIN (SELECT user_id, category_id, arg_min(amount, spend_category) AS matched FROM spend JOIN match_map USING (spend_category) GROUP BY ALL) USING (user_id, category_id)""",
    "overlap_categories": """SELECT user_id, category_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(card_id))), ',') AS cards FROM orows GROUP BY ALL HAVING count(*) > 1""",
    "card_verdicts": "SELECT * FROM verdict",
    "switch_alternatives": "SELECT user_id, card_id, fit, n_overlaps, score, place FROM alternative WHERE place <= 3",
    "recommended_combo": """SELECT user_id, card_id, 'kept' AS part FROM verdict WHERE verdict = 'keep'
        UNION ALL SELECT user_id, card_id, 'new' FROM alternative WHERE place = 1 AND user_id IN (SELECT user_id FROM verdict WHERE verdict = 'switch')""",
    "combo_coverage": """SELECT user_id, (200 * coalesce(sum(amount), 0)::BIGINT + total) // (2 * total) AS coverage FROM (SELECT DISTINCT user_id FROM owned) JOIN total USING (user_id)
        LEFT JOIN (SELECT DISTINCT o.user_id, s.spend_category, s.amount FROM owned o JOIN coverage USING (card_id) JOIN spend s USING (user_id, spend_category)) USING (user_id) GROUP BY user_id, total""",
    "card_usage": """SELECT user_id, card_id, this_month, last_months, card_limit, (200 * this_month + card_limit) // (2 * card_limit) AS used FROM (
          SELECT user_id, card_id, coalesce(sum(amount) FILTER (ts >= TIMESTAMP '1997-06-01'), 0)::BIGINT AS this_month, sum(amount)::BIGINT AS last_months,
                 1000000 + 100000 * (user_id % 30) AS card_limit
          FROM tx JOIN candidate USING (candidate_pos) WHERE ts >= TIMESTAMP '1997-04-01' AND ts < TIMESTAMP '1997-07-01' AND user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id, card_id)""",
    "engagement_monthly": "SELECT * FROM monthly",
    "issuer_ranking": "SELECT month, card_id, score, place, bar, CASE WHEN place <= 3 THEN place END AS medal FROM popular",
    "ranking_with_issuer": """SELECT month, card_id, place, company, n_cards, top_benefit FROM popular JOIN card USING (card_id)
        LEFT JOIN (SELECT company, count(*) AS n_cards, max(max_benefit) AS top_benefit FROM card GROUP BY ALL HAVING count(*) > 2) USING (company)""",
    "issuer_top5": """SELECT company, card_id, place FROM (SELECT company, card_id, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN card_id % 9 <> 0 THEN card_rank ELSE 99 END, card_id) AS place FROM card_rank) WHERE place <= 5""",
    "compare_scores": "SELECT *, CASE WHEN place <= 2 THEN place + 1 END AS medal FROM scores",
    "score_unpivot": """SELECT set_id, subject, max(score) FILTER (pos = 0) AS card0, max(score) FILTER (pos = 1) AS card1, max(score) FILTER (pos = 2) AS card2
        FROM (UNPIVOT (SELECT set_id, pos, benefit_score, fee_score, spending_score, rating_score, diversity_score FROM scores)
              ON benefit_score, fee_score, spending_score, rating_score, diversity_score INTO NAME subject VALUE score) GROUP BY ALL""",
    "compare_categories": """SELECT set_id, category_id, row_number() OVER (PARTITION BY set_id ORDER BY p, b, category_id) AS place FROM (
          SELECT set_id, category_id, min(pos) AS p, arg_min(benefit_pos, pos) AS b FROM rates GROUP BY ALL)""",
    "shared_categories": "SELECT DISTINCT set_id, category_id FROM shared",
    "rate_matrix": """SELECT set_id, category_id, coalesce(max(rate) FILTER (pos = 0), 0)::DECIMAL(12, 2)::VARCHAR AS rate0, coalesce(max(rate) FILTER (pos = 1), 0)::DECIMAL(12, 2)::VARCHAR AS rate1,
        coalesce(max(rate) FILTER (pos = 2), 0)::DECIMAL(12, 2)::VARCHAR AS rate2 FROM rates GROUP BY ALL""",
    "benefit_cells": """SELECT s.set_id, s.card_id, c.category_id, r.rate::VARCHAR AS rate, r.unit, r.max_limit, nullif(r.condition, '제한없음') AS condition,
          CASE r.benefit_kind WHEN 'discount' THEN '할인' WHEN 'cashback' THEN '캐시백' WHEN 'point' THEN '적립' WHEN 'special' THEN '특별' END AS kind
        FROM sets s JOIN (SELECT DISTINCT set_id, category_id FROM rates) c USING (set_id)
        LEFT JOIN rates r ON r.set_id = s.set_id AND r.pos = s.pos AND r.category_id = c.category_id""",
    "shared_rate_diff": """SELECT set_id, category_id, card_id, rate::VARCHAR AS rate, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN b = 0 THEN 100 ELSE (200 * a + b) // (2 * b) - 100 END AS diff,
          CASE WHEN m > 0 THEN (200 * cents + m) // (2 * m) ELSE 0 END AS bar, cents = m AS is_best FROM (
          SELECT *, cents * (n - 1) AS a, (sum(cents) OVER w - cents)::BIGINT AS b, max(cents) OVER w AS m FROM shared WINDOW w AS (PARTITION BY set_id, category_id))""",
    "pair_headline": """SELECT set_id, category_id, CASE WHEN d > 0 THEN c0 ELSE c1 END AS winner, abs(d) AS by_percent FROM (
          SELECT *, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN b = 0 THEN 100 ELSE (200 * a + b) // (2 * b) - 100 END AS d FROM (
            SELECT set_id, category_id, max(cents) FILTER (pos = 0) AS a, max(cents) FILTER (pos = 1) AS b, max(card_id) FILTER (pos = 0) AS c0, max(card_id) FILTER (pos = 1) AS c1
            FROM shared WHERE set_size = 2 GROUP BY ALL)) WHERE d <> 0""",
    "best_badge": """SELECT set_id, category_id, card_id, rate::VARCHAR AS rate FROM (
          SELECT *, sum((rate = m)::INT) OVER (PARTITION BY set_id, category_id) AS ties FROM (SELECT *, max(rate) OVER (PARTITION BY set_id, category_id) AS m FROM rates))
        WHERE rate = m AND m > 0 AND ties < set_size""",
    "max_benefit_winner": """SELECT set_id, arg_max(card_id, (max_benefit, pos)) AS winner, count(*) FILTER (max_benefit = m) AS tied
        FROM (SELECT *, max(max_benefit) OVER (PARTITION BY set_id) AS m FROM sets JOIN card USING (card_id)) GROUP BY ALL""",
    "recent_views": """SELECT user_id, card_id, place, card_name FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, card_id) AS place FROM (SELECT user_id, k AS card_id, max(ts) AS t FROM event WHERE event_type = 'view' GROUP BY ALL))
        JOIN card USING (card_id) WHERE place <= 10""",
    "recent_compares": """SELECT user_id, array_to_string(ids, ',') AS cards, place, count(*) OVER (PARTITION BY user_id) - place + 1 AS number FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, set_id DESC) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, list_sort(ids) ORDER BY ts DESC, set_id DESC) AS k
            FROM (SELECT set_id, user_id, ts, list(card_id ORDER BY pos) AS ids FROM item GROUP BY ALL) WHERE len(ids) >= 2) WHERE k = 1) WHERE place <= 5""",
    "stored_views": """SELECT user_id, card_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS place, (user_id, card_id) IN ({favourites}) AS favourite FROM ({recent_views})""",
    "history_texts": """SELECT user_id, coalesce(viewed, '[]') AS viewed, coalesce(compared, '[]') AS compared, coalesce(n_viewed, 0) AS n_viewed, coalesce(viewed_sum, 0) AS viewed_sum,
          coalesce(n_compared, 0) AS n_compared, coalesce(compared_sum, 0) AS compared_sum
        FROM (SELECT user_id, '[' || string_agg(card_id, ',' ORDER BY place) || ']' AS viewed, count(*) AS n_viewed, sum(card_id)::BIGINT AS viewed_sum FROM ({recent_views}) GROUP BY user_id)
        FULL JOIN (SELECT user_id, '[' || string_agg('[' || cards || ']', ',' ORDER BY place) || ']' AS compared, count(*) AS n_compared,
                          sum(list_sum(list_transform(string_split(cards, ','), lambda x: x::BIGINT)))::BIGINT AS compared_sum FROM ({recent_compares}) GROUP BY user_id) USING (user_id)""",
    "nested_catalogue": """SELECT 'card' AS kind, card_id, 0 AS pos, concat_ws('|', card_name, company, CASE card_type WHEN '신용' THEN 'credit' ELSE 'debit' END, coalesce(network, 'VISA'),
            annual_fee_dom_basic, min_performance, max_benefit) AS value FROM card
        UNION ALL SELECT 'benefit', card_id, benefit_pos, concat_ws('|', category, d.benefit_content, benefit_kind, d.max_limit, benefit_value, condition) FROM detail d JOIN (SELECT benefit_id, benefit_kind, benefit_value, condition FROM benefit) USING (benefit_id)
        UNION ALL SELECT 'tag', card_id, i, tags[i] FROM card, unnest(range(1, len(tags) + 1)) AS t(i)
        UNION ALL SELECT 'event', card_id, i, CASE i WHEN 1 THEN 'event of ' || card_name ELSE 'cashback' END FROM card, (VALUES (1), (2)) AS t(i) WHERE has_cashback""",
    "cards_by_jdbc": "SELECT CASE WHEN card_id % 7 <> 0 THEN card_id END AS card_key, card_id, card_name, company FROM card WHERE annual_fee_dom_basic <= 50000",
    "favourites": "SELECT user_id, k % 10 AS card_id FROM event WHERE event_type = 'purchase' GROUP BY ALL HAVING count(*) % 2 = 1",
    "compare_basket": """SELECT user_id, array_to_string(list_reduce(e, lambda held, x: CASE WHEN list_contains(held, x[1]) THEN list_filter(held, lambda y: y <> x[1])
          WHEN len(held) < 3 THEN list_append(held, x[1]) ELSE held END, []::BIGINT[]), ',') AS basket
        FROM (SELECT user_id, list([k % 10] ORDER BY ts, event_id, k % 10) AS e FROM event WHERE event_type = 'purchase' GROUP BY user_id)""",
    "signup_validation": """SELECT signup_id, form_errors, coalesce(server_error, '') AS server_error, ok AND row_number() OVER (PARTITION BY email, ok ORDER BY signup_id) = 1 AS accepted FROM (
          SELECT *, form_errors = '' AND server_error IS NULL AS ok FROM (
            SELECT signup_id, email, concat_ws(',', CASE WHEN length(name) < 2 THEN 'name' END, CASE WHEN NOT contains(email, '@') THEN 'email' END,
                   CASE WHEN length(pw) < 8 THEN 'password' END, CASE WHEN pw <> pc THEN 'password_confirm' END) AS form_errors,
                   CASE WHEN email IN (SELECT 'u' || c_custkey || '@x.kr' FROM customer WHERE c_custkey % 4 = 0) THEN 'email'
                        WHEN length(pw) < 8 THEN 'password' WHEN pw <> pc THEN 'password_confirm' END AS server_error
            FROM (SELECT *, CASE WHEN signup_id % 11 = 0 THEN 'other' ELSE pw END AS pc FROM (
              SELECT c_custkey AS signup_id, CASE WHEN c_custkey % 17 = 0 THEN 'A' ELSE c_name END AS name,
                     CASE WHEN c_custkey % 10 = 0 THEN 'nomail' ELSE 'u' || (c_custkey % 1000) || '@x.kr' END AS email,
                     CASE WHEN c_custkey % 13 = 0 THEN 'short' ELSE 'longenough' END AS pw FROM customer))))""",
    "phone_format": """SELECT signup_id, p[1:3] || '-' || p[4:7] || '-' || p[8:11] AS phone,
          CASE WHEN length(q) <= 3 THEN q WHEN length(q) <= 7 THEN q[1:3] || '-' || q[4:] ELSE q[1:3] || '-' || q[4:7] || '-' || q[8:11] END AS part
        FROM (SELECT c_custkey AS signup_id, '010' || (10000000 + c_custkey) AS p, left('010' || (10000000 + c_custkey), (c_custkey % 12)::INT) AS q FROM customer)""",
    "parse_selection": """SELECT p_partkey AS card_id, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') || '|a+b|카' AS items FROM part""",
    "money_labels": """SELECT card_id, CASE WHEN annual_fee_dom_basic = 0 THEN '무료' ELSE format('{{:,}}', annual_fee_dom_basic) || '원' END AS fee,
          (max_benefit + 5000) // 10000 || '만원' AS benefit, (max_benefit + 500) // 10000 || '.' || (max_benefit + 500) // 1000 % 10 || '만원' AS benefit1,
          CASE WHEN min_performance = 0 THEN '무실적' ELSE min_performance // 10000 || '만원' END AS performance FROM card""",
    "unmapped_categories": "SELECT category_id, count(*) AS n, false AS damaged FROM bridge WHERE category_id > 18 GROUP BY ALL",
    "issuer_names": """SELECT card_id, named, coalesce(issuer, named) AS issuer FROM (
          SELECT card_id, coalesce(([{short}, {long}])[(card_id % {issuers} + 1)::INT], company) AS named FROM card)
        LEFT JOIN (SELECT unnest([{short}]) AS alias, unnest([{long}]) AS issuer UNION ALL SELECT i, i FROM (SELECT unnest([{long}]) AS i)) ON named = alias""",
    "benefit_kinds": """SELECT benefit_id, CASE card_id % 6 WHEN 0 THEN '할인' WHEN 1 THEN '캐시백' WHEN 2 THEN '적립' WHEN 3 THEN '특별' END AS comparison,
          CASE card_id % 6 WHEN 1 THEN '캐시백' WHEN 2 THEN '적립' ELSE '할인' END AS ranking FROM benefit""",
    "card_lookup": """SELECT k.card_id, card_name, c.card_id IS NOT NULL AS found FROM (SELECT DISTINCT k * 7 AS card_id FROM event WHERE event_type IN ('view', 'click')) k
        LEFT JOIN card c ON c.card_id = k.card_id""",
    "ranking_of_issuers": """SELECT arm, month, card_id, score, place, bar, CASE WHEN place <= 3 THEN place END AS medal FROM (
          SELECT arm, month, card_id, score, row_number() OVER (w ORDER BY score DESC, card_id) AS place, (200 * score + max(score) OVER w) // (2 * max(score) OVER w) AS bar FROM (
            SELECT arm, month, card_id, views + clicks AS score FROM monthly JOIN card USING (card_id), (VALUES ('allowed'), ('one')) AS a(arm)
            WHERE company IN ({allowed}) AND (arm = 'allowed' OR company = {first} AND card_type = '신용')) WINDOW w AS (PARTITION BY arm, month))""",
    "card_words": """SELECT card_id, string_split(card_name, ' ')[-1] AS word,
          CASE card_id % 5 WHEN 0 THEN 'WORKER' WHEN 1 THEN 'SENIOR' WHEN 2 THEN 'FAMILY' WHEN 3 THEN 'SINGLE' ELSE 'STUDENT' END AS persona FROM card""",
    "engagement_daily": """SELECT ts::DATE AS day, k AS card_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks
        FROM event WHERE event_type IN ('view', 'click') GROUP BY ALL""",
    "engagement_rolled_up": "SELECT month, card_id, views, clicks FROM monthly",
    "favourite_counts": "SELECT user_id, k % 10 AS card_id, count(*) AS n, count(*) % 2 = 1 AS favourite FROM event WHERE event_type = 'purchase' GROUP BY ALL",
    "statements_csv": STATEMENTS,
    "statements_json": STATEMENTS,
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT" for x in r) + ")" for r in rows)


def oracles() -> dict[str, str]:
    """Each query behind the domain's views."""
    weights = [(p, c, dims.HIGH_WEIGHT if c in hi else dims.MIDDLE_WEIGHT if c in mid else dims.LOW_WEIGHT) for p, (hi, mid) in dims.PERSONAS.items() for c in range(1, len(dims.CATEGORIES) + 1)]
    domain = DOMAIN.format(categories=_values(list(enumerate(dims.CATEGORIES, 1))), weights=_values(weights))
    parts = {k: QUERIES[k] for k in ("fee_performance_score", "diversity_score", "limit_score", "practicality_score", "recent_views", "recent_compares", "favourites")}
    parts |= {k: ", ".join(f"'{x}'" for x in v) for k, v in (("long", [i[0] for i in dims.ISSUERS]), ("short", [i[1] for i in dims.ISSUERS]), ("allowed", ISSUERS_ALLOWED), ("spending", dims.SPENDING_MATCH), ("first", ISSUERS_ALLOWED[:1]))}
    chosen = "SELECT n_nationkey AS request_id, ([{names}])[x % {n} + 1] AS category FROM nation, unnest([n_nationkey, n_nationkey * 3 + 1, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 5 ELSE n_nationkey END]) AS t(x)"
    for k, v in (("chosen_cards", ("A", "B", "pin", "re", "C", "RING")), ("chosen_names", ("백화점/아울렛", "편의점", "반려동물", "쇼핑", "의료", "외", "카페/베이"))):
        parts[k] = chosen.format(names=", ".join(f"'{x}'" for x in v), n=len(v) + 1)
    parts["issuers"] = str(2 * len(dims.ISSUERS) + 1)
    return {name: f"WITH {domain} {body.format(**parts)}" for name, body in QUERIES.items()}
