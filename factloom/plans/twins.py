"""Queries whose text runs in Spark SQL and in DuckDB alike. Each name starts with its operator's number in the survey."""

from __future__ import annotations

from factloom.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# --- projection, filter, predicate ---
R.sql("p1_equality_projection", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND user_id = 7")
R.sql("p2_prefix_match", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_type LIKE 'ECON%'")
R.sql("p3_negative_patterns", "SELECT p_partkey, p_name FROM part WHERE NOT (p_name LIKE '%ring%') AND NOT (p_name LIKE '%widget%') AND NOT (p_name LIKE 'red%')")
R.sql("p4_json_field", "SELECT event_id, user_id FROM events WHERE CAST(get_json_object(props, '$.k') AS INT) >= 90", "SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90")
R.sql("p5_id_list_semi_join", "SELECT event_id, value FROM events LEFT SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON user_id = c.c_custkey",
      "SELECT event_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
R.sql("p6_json_list_members", "SELECT event_id FROM events WHERE user_id IN (SELECT explode(from_json('[3, 5, 8, 13, 21]', 'array<bigint>')))", "SELECT event_id FROM events WHERE user_id IN (3, 5, 8, 13, 21)")
R.sql("p7_half_open_buckets", "SELECT CASE WHEN p_size >= 1 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 30 THEN 'medium' WHEN p_size >= 30 THEN 'large' END AS bucket, count(*) AS n FROM part GROUP BY 1")
R.sql("p8_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.05 AND 0.06")
R.sql("p9_tri_state", """SELECT count(*) FILTER (WHERE l.quality IS NULL) AS unknown, count(*) FILTER (WHERE coalesce(l.quality, 0) = 0) AS not_good,
      count(*) FILTER (WHERE l.quality = 0) AS bad, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")  # fmt: skip
R.sql("p10_scalar_subquery", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY')")
R.sql("p11_latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1")
R.sql("p12_boolean_sums", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(*) AS n FROM events GROUP BY user_id")
R.sql("p13_first_match_ladder", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND value >= 100 THEN 'done'
      WHEN value >= 100 THEN 'near' WHEN value >= 20 THEN 'open' ELSE 'stuck' END AS state FROM events""")  # fmt: skip
R.sql("p14_reason_codes", """SELECT reason, count(*) AS n FROM (SELECT coalesce(CASE WHEN p_size > 40 THEN 'too_large' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END,
      CASE WHEN p_retailprice > 1500 THEN 'dear' END, 'selected') AS reason FROM part) x GROUP BY reason""")  # fmt: skip
R.sql("p15_score_tiers", "SELECT CASE WHEN value >= 200 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS tier, event_type, count(*) AS n FROM events GROUP BY 1, 2")
R.sql("p17_strict_records", """SELECT CASE WHEN c_custkey IS NULL OR c_custkey < 0 THEN 'bad_key' WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'bad_balance'
      WHEN NOT (c_name LIKE 'Customer#%') THEN 'bad_name' ELSE 'ok' END AS verdict, count(*) AS n FROM customer GROUP BY 1""")  # fmt: skip

# --- joins ---
R.sql("j1_fact_to_dimension", "SELECT e.event_id, e.value, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.value > 100")
R.sql("j2_star_join", """SELECT r.r_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")  # fmt: skip
R.sql("j3_dimension_self_join", """SELECT DISTINCT s.s_name AS caller, p.p_name AS callee FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
      JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity = 50""")  # fmt: skip
R.sql("j4_parent_child_edges", """SELECT p.conv_id, p.turn AS parent_turn, c.turn AS child_turn, length(c.text) - length(p.text) AS grown FROM conversations p
      JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 WHERE p.text <> c.text""")  # fmt: skip
R.sql("j5_left_outer", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
R.sql("j6_null_filter_anti", "WITH first AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT c.c_custkey FROM customer c LEFT JOIN first f ON c.c_custkey = f.user_id WHERE f.user_id IS NULL")
R.sql("j7_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
R.sql("j8_never_reached", """WITH open AS (SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value >= 150)),
      latest AS (SELECT user_id, max(event_id) AS event_id FROM open WHERE event_type <> 'error' GROUP BY user_id)
      SELECT o.user_id, o.event_id, o.value FROM open o JOIN latest l ON o.event_id = l.event_id""")  # fmt: skip
R.sql("j9_not_in_rewrite", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
R.sql("j10_status_by_both_sides", """SELECT CASE WHEN d.doc_id IS NULL THEN 'only_label' WHEN l.doc_id IS NULL THEN 'only_document' ELSE 'both' END AS status, count(*) AS n
      FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")  # fmt: skip
R.sql("j17_two_sources", """SELECT a.user_id, a.n AS early, b.n AS late FROM (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id) a
      JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id) b ON a.user_id = b.user_id""")  # fmt: skip
R.sql("j18_not_in_any_set", """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_partkey IS NOT NULL)
      AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 49 AND l_partkey IS NOT NULL)""")  # fmt: skip

# --- aggregation ---
#: Of equal values the one with the least id, as it comes first; Spark's own max_by takes whichever is merged last. Rows without a kind don't count.
_KIND_OF_BEST = "max_by(event_type, struct(value, -event_id)) FILTER (WHERE event_type IS NOT NULL AND value IS NOT NULL)"
R.sql("a1_count", "SELECT count(*) AS n FROM lineitem")
R.sql("a2_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
R.sql("a3_group_max_having", "SELECT l_partkey, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING max(l_quantity) >= 49 ORDER BY most DESC, l_partkey")
R.sql("a4_never_solved", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type = 'purchase' AND value > 250 THEN 1 ELSE 0 END) = 0")
R.sql("a5_most_attempted", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 5 ORDER BY n DESC, user_id LIMIT 25")
R.sql("a6_several_measures", "SELECT o_custkey, max(o_totalprice) AS most, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey")
R.sql("a7_row_of_the_extreme", f"SELECT user_id, max(value) AS best, {_KIND_OF_BEST} AS kind_of_best, min(event_id) AS first_id, min_by(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS first_kind FROM events GROUP BY user_id", "SELECT user_id, max(value) AS best, max_by(event_type, value) AS kind_of_best, min(event_id) AS first_id, min_by(event_type, event_id) AS first_kind FROM events GROUP BY user_id")
R.sql("a8_joined_names", "SELECT n_regionkey, concat_ws(',', sort_array(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
R.sql("a9_counts_by_category", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY l_suppkey")
R.sql("a10_tier_by_band_with_totals", """SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS tier, p_type AS band, count(*) AS n FROM part
      GROUP BY GROUPING SETS ((1, 2), (1), (2), ())""", """WITH x AS (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS tier, p_type AS band FROM part)
      SELECT tier, band, count(*) AS n FROM x GROUP BY GROUPING SETS ((tier, band), (tier), (band), ())""")  # fmt: skip
R.sql("a11_three_groupings", "WITH x AS (SELECT event_type, CAST(user_id % 3 AS INT) AS profile, value FROM events) SELECT event_type, profile, count(*) AS n, count(*) FILTER (WHERE value > 100) AS hits FROM x GROUP BY GROUPING SETS ((), (event_type), (profile))")
R.sql("a14_cluster_rollup", f"""WITH one AS (SELECT user_id, max(value) AS best, {_KIND_OF_BEST} AS kind, count(*) AS tries FROM events GROUP BY user_id)
      SELECT kind, CAST(floor(best / 50) AS INT) AS band, count(*) AS entities, min(user_id) AS member, CAST(sum(tries) AS BIGINT) AS tries FROM one GROUP BY 1, 2 ORDER BY entities DESC, kind, band""", """WITH one AS (SELECT user_id, max(value) AS best, max_by(event_type, value) AS kind, count(*) AS tries FROM events GROUP BY user_id)
      SELECT kind, CAST(floor(best / 50) AS INT) AS band, count(*) AS entities, min(user_id) AS member, CAST(sum(tries) AS BIGINT) AS tries FROM one GROUP BY 1, 2 ORDER BY entities DESC, kind, band""")  # fmt: skip
R.sql("a19_document_frequency", """SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, explode(split(lower(text), '[^a-z]+')) AS word FROM documents) a WHERE word <> '') b
      GROUP BY word HAVING count(*) >= 20""", """SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) a WHERE word <> '') b
      GROUP BY word HAVING count(*) >= 20""")  # fmt: skip
R.sql("a23_smoothed_rates", """SELECT event_type, (count(*) FILTER (WHERE value > 20) + 1) / CAST(count(*) + 2 AS DOUBLE) AS compile_rate, (count(*) FILTER (WHERE value > 100) + 0.1) / CAST(count(*) + 10 AS DOUBLE) AS exact_rate,
      (count(*) FILTER (WHERE value > 50) + 1) / CAST(count(*) + 3 AS DOUBLE) AS improve_rate FROM events GROUP BY event_type""")  # fmt: skip
R.sql("a26_balanced_weights", """SELECT user_id, event_type, event_id, CAST(1 AS DOUBLE) / (SELECT count(DISTINCT user_id) FROM events) / count(*) OVER (PARTITION BY user_id) AS weight FROM events""")
R.sql("a28_interval_lengths", """WITH x AS (SELECT l_returnflag AS kind, l_linenumber * 10 AS lo, l_linenumber * 10 + CAST(l_quantity AS INT) AS hi FROM lineitem)
      SELECT kind, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM x GROUP BY kind UNION ALL SELECT 'rest' AS kind, CAST(10000000 - sum(hi - lo) AS BIGINT) AS bytes FROM x""")  # fmt: skip
R.sql("a29_consensus_vote", """WITH v AS (SELECT l_partkey AS item, l_returnflag AS choice, count(DISTINCT l_linestatus) AS kinds, count(*) FILTER (WHERE l_discount = 0.1) AS against FROM lineitem GROUP BY 1, 2),
      s AS (SELECT item, choice, kinds - 3 * against AS votes, against, row_number() OVER (PARTITION BY item ORDER BY kinds - 3 * against DESC, choice) AS rn,
      count(*) OVER (PARTITION BY item, kinds - 3 * against) AS ties FROM v) SELECT item, CASE WHEN votes < 2 OR ties > 1 OR against > 0 THEN NULL ELSE choice END AS choice FROM s WHERE rn = 1""")  # fmt: skip
R.sql("a31_interpolated_median", "SELECT user_id, percentile(value, 0.5) AS median_value FROM events GROUP BY user_id", "SELECT user_id, median(value) AS median_value FROM events GROUP BY user_id")
R.sql("a33_avg_round", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean_quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
R.sql("a32_mechanism_report", """WITH steps AS (SELECT user_id, event_type AS mechanism, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
      once AS (SELECT DISTINCT user_id, mechanism, before, value FROM steps WHERE before IS NOT NULL)
      SELECT mechanism, count(*) FILTER (WHERE mechanism = 'error') AS broke, count(*) FILTER (WHERE mechanism <> 'error' AND value >= 200) AS exact,
      count(*) FILTER (WHERE mechanism <> 'error' AND value < 200 AND value = before) AS noop, count(*) FILTER (WHERE mechanism <> 'error' AND value < 200 AND value < before) AS shrank,
      count(*) FILTER (WHERE mechanism <> 'error' AND value < 200 AND value > before) AS grew FROM once GROUP BY mechanism""")  # fmt: skip

# --- windows ---
R.sql("w1_best_per_group", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) x WHERE rn = 1")
R.sql("w2_first_and_latest", "SELECT user_id, min_by(event_id, event_id) AS first_event, max_by(event_id, event_id) AS last_event, max_by(value, event_id) AS last_value FROM events GROUP BY user_id")
R.sql("w3_top_k_per_group", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) x WHERE rn <= 5")
R.sql("w9_previous_value", "SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
R.sql("w14_floor_first_best", """SELECT DISTINCT user_id, min(value) OVER (PARTITION BY user_id) AS lowest, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS first_score,
      max(value) OVER (PARTITION BY user_id) AS best FROM events""")  # fmt: skip
R.sql("w21_alternate_assignment", "SELECT p_partkey, p_brand, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) % 2 = 1 THEN 'dev' ELSE 'heldout' END AS split FROM part")
R.sql("w23_class_cap_in_hash_order", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha2(concat('7:', CAST(doc_id AS STRING)), 256), doc_id) AS rn FROM documents) x WHERE rn <= 15",
      "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents) x WHERE rn <= 15")

# --- order and limit ---
R.sql("o1_multi_key_order", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
R.sql("o2_order_by_correlated_aggregate", "WITH n AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY l_partkey) SELECT p.p_partkey, coalesce(n.uses, 0) AS uses FROM part p LEFT JOIN n ON p.p_partkey = n.l_partkey ORDER BY uses DESC, p.p_partkey LIMIT 30")
R.sql("o3_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
R.sql("o4_lexicographic_triage", """SELECT user_id, structural, other, best FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS structural, count(*) FILTER (WHERE event_type = 'view') AS other, max(value) AS best
      FROM events GROUP BY user_id) x ORDER BY structural > 0, structural, other > 0, other, best DESC, user_id LIMIT 50""")  # fmt: skip
R.sql("o10_seeded_shuffle", "SELECT p_partkey FROM part ORDER BY sha2(concat('seed1:', CAST(p_partkey AS STRING)), 256) LIMIT 50", "SELECT p_partkey FROM part ORDER BY sha256(concat('seed1:', CAST(p_partkey AS VARCHAR))) LIMIT 50")

# --- sets ---
R.sql("t1_union_of_records", "SELECT o_custkey AS id FROM orders UNION SELECT user_id AS id FROM events")
R.sql("t2_multi_way_exclusion", "SELECT c_custkey AS id FROM customer EXCEPT (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT user_id FROM events)")
R.sql("t5_gained_and_lost", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 60), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 60)
      SELECT user_id, 'lost' AS change FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'gained' AS change FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")  # fmt: skip
R.sql("t7_ledger_union", """WITH u AS (SELECT o_custkey AS id, o_totalprice AS score, o_orderkey AS row_id, o_orderstatus = 'F' AS exact FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT o_custkey, o_totalprice, o_orderkey, o_orderpriority = '1-URGENT' FROM orders WHERE o_orderkey % 2 = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, row_id) AS rn FROM u WHERE id NOT IN (SELECT id FROM u WHERE exact)) SELECT id, score, row_id FROM r WHERE rn = 1""")  # fmt: skip

# --- facts ---
R.sql("d4_location_description", """SELECT l_partkey AS place, count(*) FILTER (WHERE l_linestatus = 'O') AS reads, count(*) FILTER (WHERE l_linestatus = 'F') AS writes, min(l_returnflag) AS least_class,
      count(DISTINCT l_returnflag) AS classes FROM lineitem GROUP BY l_partkey""")  # fmt: skip
R.sql("d5_open_questions", """SELECT item, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS questions FROM (
      SELECT l_partkey AS item, 3 AS weight FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 2
      UNION ALL SELECT l_partkey, 2 FROM lineitem GROUP BY l_partkey HAVING count(*) < 20 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size > 45) q GROUP BY item""")  # fmt: skip
R.sql("d3_evidence_validation", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN d.n_chars < 200 AND l.quality = 0 THEN 'short_bad' WHEN d.n_chars < 200 THEN 'short_good'
      WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'agrees' ELSE 'conflict' END AS outcome FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x GROUP BY outcome""")  # fmt: skip

# --- evaluation ---
R.sql("x1_coverage_at_budget", """WITH panel AS (SELECT c_custkey AS id, c_mktsegment AS class FROM customer), run AS (SELECT user_id AS id, min(value) AS cost FROM events WHERE event_type = 'purchase' GROUP BY user_id)
      SELECT class, count(*) AS n, count(run.id) AS covered, count(*) FILTER (WHERE cost <= 1) AS at_1, count(*) FILTER (WHERE cost <= 2) AS at_2, count(*) FILTER (WHERE cost <= 5) AS at_5
      FROM panel LEFT JOIN run ON panel.id = run.id GROUP BY class""")  # fmt: skip
R.sql("x6_stratified_new", "SELECT p_brand, count(*) FILTER (WHERE p_size > 25 AND p_retailprice > 1000) AS fresh, count(*) AS n FROM part GROUP BY p_brand")
R.sql("x7_success_rate_by_tier", """SELECT CASE WHEN n < 60 THEN 'few' ELSE 'many' END AS tier, count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE) AS rate, count(*) AS entities FROM
      (SELECT user_id, count(*) AS n, max(value) > 150 AS hit FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300) GROUP BY user_id) x GROUP BY 1""")  # fmt: skip
R.sql("x11_majority_baseline", "SELECT quality, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality) x ORDER BY n DESC, quality LIMIT 1")
R.sql("x18_rates_per_hour", "SELECT user_id, count(*) FILTER (WHERE value > 50) / greatest((unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP))) / 3600e6, 1) AS per_hour FROM events GROUP BY user_id",
      "SELECT user_id, count(*) FILTER (WHERE value > 50) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6, 1) AS per_hour FROM events GROUP BY user_id")

# --- splits, leakage, plans ---
R.sql("c1_stratified_sample", "SELECT p_partkey, p_type, rn FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type, p_size > 25 ORDER BY md5(concat('c1', CAST(p_partkey AS STRING))), p_partkey) AS rn FROM part) x WHERE rn <= 4",
      "SELECT p_partkey, p_type, rn FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type, p_size > 25 ORDER BY md5(concat('c1', CAST(p_partkey AS VARCHAR))), p_partkey) AS rn FROM part) x WHERE rn <= 4")
R.sql("c12_cross_split_collisions", """WITH h AS (SELECT md5(text) AS digest, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, doc_id FROM documents)
      SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY digest HAVING count(DISTINCT split) > 1""")  # fmt: skip
R.sql("c14_near_ties", "SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM events) x WHERE best - value > 0 AND best - value <= 1")
R.sql("c16_development_plan", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'sealed' WHEN quality = 1 AND toxic = 1 THEN 'exact' WHEN n_chars < 100 THEN 'not_compiled' WHEN lang <> 'en' THEN 'frontend' ELSE 'selected' END AS decision
      FROM documents JOIN (SELECT doc_id AS label_id, quality, toxic FROM labels) l ON doc_id = label_id""")  # fmt: skip
R.sql("g7_edges_without_loops", "SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity > 45")
R.sql("g16_lineage_integrity", "SELECT c.conv_id, c.turn FROM conversations c WHERE c.turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.turn % 3 <> 1)")
R.sql("g22_shared_issue_groups", "SELECT md5(concat(event_type, ':', CAST(CAST(floor(value / 25) AS INT) AS STRING))) AS fingerprint, count(DISTINCT user_id) AS entities, min(user_id) AS one FROM events GROUP BY 1",
      "SELECT md5(concat(event_type, ':', CAST(CAST(floor(value / 25) AS INT) AS VARCHAR))) AS fingerprint, count(DISTINCT user_id) AS entities, min(user_id) AS one FROM events GROUP BY 1")
R.sql("m5_exact_lookup", "SELECT a.doc_id, b.doc_id AS other_id, b.source FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id AND a.source <> b.source")
R.sql("m8_point_in_time", """SELECT event_id, latest_earlier FROM (SELECT event_id, event_type, max(event_id) OVER (PARTITION BY user_id ORDER BY unix_micros(CAST(ts AS TIMESTAMP)) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_earlier FROM events) x
      WHERE event_type = 'purchase' AND latest_earlier IS NOT NULL""", oracle="""SELECT t.event_id, max(c.event_id) AS latest_earlier FROM (SELECT * FROM events WHERE event_type = 'purchase') t
      JOIN events c ON c.user_id = t.user_id AND c.ts < t.ts GROUP BY t.event_id""")  # fmt: skip
R.sql("m13_precision_recall", """SELECT count(*) FILTER (WHERE fired AND good) / CAST(greatest(count(*) FILTER (WHERE fired), 1) AS DOUBLE) AS precision, count(*) FILTER (WHERE fired AND good) / CAST(greatest(count(*) FILTER (WHERE good), 1) AS DOUBLE) AS recall
      FROM (SELECT d.n_chars > 500 AS fired, l.quality = 1 AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 = 0) x""")  # fmt: skip
R.sql("m19_never_exact_frontier", """SELECT c.c_custkey, max(e.value) AS best, count(*) AS tries FROM customer c JOIN events e ON e.user_id = c.c_custkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
      WHERE o.o_orderkey IS NULL AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = c.c_custkey AND x.value > 280) GROUP BY c.c_custkey ORDER BY best DESC, tries DESC, c.c_custkey""")  # fmt: skip
R.sql("l14_budget_ledger", """WITH e AS (SELECT user_id AS stage, CAST(event_id % 7 AS INT) AS op, event_type AS kind, floor(value) AS amount FROM events),
      r AS (SELECT stage, op, sum(CASE WHEN kind = 'view' THEN amount ELSE 0 END) AS reserved, max(CASE WHEN kind = 'purchase' THEN amount END) AS charged FROM e GROUP BY stage, op)
      SELECT stage, CAST(sum(coalesce(charged, 0)) AS BIGINT) AS spent, CAST(sum(greatest(reserved - coalesce(charged, 0), 0)) AS BIGINT) AS outstanding,
      CAST(100000 - sum(coalesce(charged, 0)) - sum(greatest(reserved - coalesce(charged, 0), 0)) AS BIGINT) AS available FROM r GROUP BY stage""")  # fmt: skip
R.sql("r4_changed_only", """WITH old AS (SELECT user_id, md5(CAST(count(*) AS STRING)) AS h FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00' GROUP BY user_id), new AS (SELECT user_id, md5(CAST(count(*) AS STRING)) AS h FROM events GROUP BY user_id)
      SELECT n.user_id, n.h FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.h = n.h)""".replace("STRING", "VARCHAR(20)"))  # fmt: skip
