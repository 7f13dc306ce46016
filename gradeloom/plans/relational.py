"""Scans, filters, joins, aggregates, windows, sorts and set operations over the domain views, in SQL."""

SQL: dict[str, str | tuple[str, str]] = {
    # scans and sinks
    "src1_concept_scan": "SELECT concept, week, outcome FROM concepts WHERE outcome IN ('CO1', 'CO2')",
    "src2_observation_log": "SELECT student_id, CAST(count(*) AS BIGINT) AS n, @JOINED(@SORTED(obs_id)) AS log FROM obs GROUP BY student_id",
    "src3_point_lookup": "SELECT * FROM run WHERE run_id = 7",
    "src4_bundle_ingest": "SELECT doc_id, source || '/' || lang || '.txt' AS path, n_chars, n_chars > 4096 AS too_large FROM documents WHERE lang IN ('en', 'de')",
    "src7_model_prior_merge": "SELECT p.k, coalesce(l.w, p.w) AS w FROM (VALUES ('bias', 0.10e0), ('agreement', 0.42e0), ('coverage', 0.14e0)) AS p(k, w) LEFT JOIN (VALUES ('coverage', 0.5e0)) AS l(k, w) ON p.k = l.k",
    "snk4_sticky_flag": "WITH old AS (SELECT student_id, min(observed_at) AS first_at FROM obs WHERE score < 0.1e0 GROUP BY student_id), now_ AS (SELECT student_id, avg(score) < 0.22e0 AS flagged, max(observed_at) AS at FROM obs GROUP BY student_id) SELECT n.student_id, n.flagged, CASE WHEN n.flagged THEN coalesce(o.first_at, n.at) END AS first_flagged_at FROM now_ n LEFT JOIN old o ON n.student_id = o.student_id",
    "snk5_reemit_run": "SELECT run_id, item_key, score FROM item WHERE run_id <> 7 UNION ALL SELECT run_id, item_key, 1e0 AS score FROM item WHERE run_id = 7",
    "snk10_gradebook_payload": "WITH r AS (SELECT student_id, assignment_id, run_id, total, state, row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY started_at DESC, run_id) AS rn FROM verdict WHERE state IN ('released', 'overridden')) SELECT student_id, assignment_id, run_id, round(total * 1e2, 4) AS marks, state FROM r WHERE rn = 1",
    # projections and filters
    "pf1_visible_released": "SELECT run_id, total FROM verdict WHERE state = 'released' AND (price > 1e5) IS FALSE",
    "pf2_in_list": "SELECT run_id, state FROM run WHERE state IN ('released', 'overridden')",
    "pf3_either_side": "SELECT vec_id, label FROM embeddings WHERE vec_id = 3 OR label = 3",
    "pf4_rounded_iso": "SELECT run_id, round(total + 1e-7, 4) AS total, @ISO(started_at) AS started FROM verdict",
    "pf5_run_struct": "SELECT run_id, CAST(count(*) AS BIGINT) AS items, @JOINED(@SORTED(item_key)) AS keys, round(sum(score * weight), 4) AS points FROM item GROUP BY run_id",
    "pf6_failed_items": "SELECT run_id, CAST(count_if(score < 0.2e0) AS BIGINT) AS failed FROM item GROUP BY run_id",
    "pf7_redact_hidden": "SELECT run_id, item_key, score FROM item WHERE NOT (submitted_at < TIMESTAMP '1995-01-01 00:00:00' AND flag = 'N')",
    "pf8_ownership": "SELECT run_id, started_at FROM run WHERE student_id = 11",
    "pf9_mastery_state": "SELECT student_id, concept_key, CASE WHEN n = 0 THEN 'no_evidence' WHEN u >= 0.22e0 AND n < 3 THEN 'uncertain' WHEN m >= 0.7e0 THEN 'mastered' WHEN m >= 0.45e0 THEN 'developing' ELSE 'gap' END AS state FROM mastery",
    "pf11_attainment_level": "SELECT concept_key, round(avg(m), 6) AS f, CASE WHEN avg(m) >= 0.8e0 THEN 3 WHEN avg(m) >= 0.7e0 THEN 2 WHEN avg(m) >= 0.6e0 THEN 1 ELSE 0 END AS level FROM mastery GROUP BY concept_key",
    "pf12_effort": "SELECT student_id, concept_key, CASE WHEN n = 0 THEN 'unknown' WHEN m < 0.25e0 THEN 'substantial' WHEN m < 0.5e0 THEN 'moderate' ELSE 'light' END AS effort FROM mastery",
    "pf13_band": "SELECT run_id, CAST(least(4, greatest(0, floor(total * 5))) AS BIGINT) AS band FROM verdict",
    "pf14_why_first": "SELECT run_id, concat('Run ', CAST(run_id AS STRING), ' is ', state, CASE WHEN total < 0.5e0 THEN ' with a low mark' ELSE '' END) AS why FROM verdict",
    "pf15_admitted_tests": "SELECT run_id, item_key FROM item WHERE flag = 'A'",
    "pf16_visibility_default": "SELECT run_id, coalesce(CASE WHEN flag = 'A' THEN TRUE WHEN flag = 'R' THEN FALSE END, submitted_at > TIMESTAMP '1996-01-01 00:00:00') AS visible_only, item_key FROM item",
    "pf17_payload_defaults": "SELECT doc_id, coalesce(nullif(trim(text), ''), 'untitled') AS title FROM documents",
    "pf18_enum_coercion": "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'basic' END AS category, substr(props, 1, 6) AS note FROM events",
    # joins
    "j1_roster": "SELECT s.student_id, s.name, CAST(count(*) AS BIGINT) AS runs FROM student s JOIN run r ON s.student_id = r.student_id GROUP BY s.student_id, s.name",
    "j2_released_runs": "SELECT r.run_id, r.student_id, i.item_key, v.total FROM run r JOIN item i ON r.run_id = i.run_id JOIN verdict v ON v.run_id = r.run_id JOIN student s ON s.student_id = r.student_id WHERE r.state = 'released'",
    "j3_run_chain": "SELECT r.run_id, s.name, i.item_key FROM run r JOIN item i ON i.run_id = r.run_id JOIN student s ON s.student_id = r.student_id",
    "j4_review_queue_join": "SELECT v.run_id, s.name, v.assignment_id, round(v.total, 6) AS total, CAST(count(*) AS BIGINT) AS items FROM verdict v JOIN student s ON s.student_id = v.student_id JOIN item i ON i.run_id = v.run_id WHERE v.state = 'escalated' GROUP BY v.run_id, s.name, v.assignment_id, v.total",
    "j5_gradebook_join": "SELECT v.run_id, v.student_id, s.segment, v.state FROM verdict v JOIN student s ON s.student_id = v.student_id WHERE v.state IN ('released', 'overridden')",
    "j6_metrics_join": "SELECT v.state, CAST(count(*) AS BIGINT) AS n FROM verdict v JOIN student s ON s.student_id = v.student_id WHERE s.region IN ('ASIA', 'EUROPE') GROUP BY v.state",
    "j7_cache_probe": "WITH h AS (SELECT doc_id, source, md5(text) AS content FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id DESC) AS rn FROM h) SELECT content, doc_id, source FROM r WHERE rn = 1",
    "j8_roster_left_latest": "WITH l AS (SELECT student_id, max(started_at) AS latest FROM run GROUP BY student_id) SELECT s.student_id, coalesce(@ISO(l.latest), 'not_submitted') AS status FROM student s LEFT JOIN l ON s.student_id = l.student_id",
    "j9_marks_matrix": "WITH a AS (SELECT DISTINCT assignment_id FROM run), m AS (SELECT student_id, assignment_id, max(total) AS best FROM verdict GROUP BY student_id, assignment_id) SELECT s.student_id, a.assignment_id, round(m.best, 6) AS best FROM student s CROSS JOIN a LEFT JOIN m ON m.student_id = s.student_id AND m.assignment_id = a.assignment_id",
    "j10_heatmap": "WITH s AS (SELECT DISTINCT student_id FROM obs) SELECT s.student_id, c.concept, round(m.m, 6) AS estimate FROM s CROSS JOIN concepts c LEFT JOIN mastery m ON m.student_id = s.student_id AND m.concept_key = c.concept",
    "j11_semi_overrides": "SELECT CAST(count(DISTINCT run_id) AS BIGINT) AS runs FROM item WHERE EXISTS (SELECT 1 FROM run r WHERE r.run_id = item.run_id AND r.state = 'overridden')",
    "j12_anti_missed": "SELECT s.student_id, s.name FROM student s WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.student_id = s.student_id AND r.assignment_id = '1-URGENT')",
    "j13_outcome_membership": "SELECT c.outcome, CAST(count(*) AS BIGINT) AS n, round(avg(m.m), 6) AS mean FROM mastery m JOIN concepts c ON c.concept = m.concept_key GROUP BY c.outcome",
    "j14_item_tests": "SELECT i.run_id, i.item_key, p_name FROM item i JOIN part ON p_partkey = i.concept + 1",
    "j15_response_mastery": "WITH c AS (SELECT student_id, concept, avg(score) AS m FROM item GROUP BY student_id, concept) SELECT i.item_key, round(avg(c.m), 6) AS aligned FROM item i JOIN c ON c.student_id = i.student_id AND c.concept = i.concept GROUP BY i.item_key",
    "j19_name_fallback": "SELECT r.run_id, coalesce(s.name, CAST(r.student_id AS STRING)) AS name FROM run r LEFT JOIN (SELECT * FROM student WHERE region = 'ASIA') s ON s.student_id = r.student_id",
    "j20_other_side": "WITH p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id), m AS (SELECT min(a) AS x FROM p) SELECT CASE WHEN p.a = m.x THEN p.b ELSE p.a END AS other FROM p JOIN m ON p.a = m.x OR p.b = m.x",
    "j22_edges_in_course": "SELECT p.concept, p.prereq FROM prereq p WHERE EXISTS (SELECT 1 FROM concepts c WHERE c.concept = p.prereq AND c.week IS NOT NULL)",
    "j23_staff_filter": "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name <> 'CHINA'",
    "j24_label_join": "WITH sig AS (SELECT concept_key, CAST(count(*) AS BIGINT) AS size FROM mastery WHERE m < 0.45e0 GROUP BY concept_key) SELECT concat(s.concept_key, ':', CAST(s.size AS STRING)) AS signature, c.outcome AS label FROM sig s LEFT JOIN concepts c ON c.concept = s.concept_key AND c.week > 1",
    "j25_training_set": "SELECT i.run_id, i.item_key, i.score AS predicted, v.total AS target FROM item i JOIN verdict v ON v.run_id = i.run_id WHERE v.state = 'overridden' AND i.flag = 'R'",
    # aggregates
    "a1_count": "SELECT CAST(count(*) AS BIGINT) AS n FROM run WHERE state <> 'escalated'",
    "a2_assignment_list": "SELECT assignment_id, CAST(count(*) AS BIGINT) AS runs, CAST(count_if(state = 'released') AS BIGINT) AS released, CAST(count_if(state = 'escalated') AS BIGINT) AS waiting, round(avg(total), 6) AS mean FROM verdict GROUP BY assignment_id",
    "a3_coverage": "SELECT CASE WHEN count(*) = 0 THEN NULL ELSE round(count_if(state = 'released') * 1e0 / count(*), 6) END AS coverage FROM verdict",
    "a4_override_rate": "SELECT round(count(DISTINCT CASE WHEN state = 'overridden' THEN run_id END) * 1e0 / nullif(count_if(state = 'released'), 0), 6) AS rate FROM verdict",
    "a5_appeal_rates": "SELECT round(count_if(event_type = 'error') * 1e0 / count(*), 6) AS appeal_rate, round(count_if(event_type = 'error' AND value > 20) * 1e0 / nullif(count_if(event_type = 'error'), 0), 6) AS upheld_rate FROM events",
    "a6_false_flag_rate": "SELECT round(count_if(lower(event_type) LIKE 'cl%') * 1e0 / count(*), 6) AS rate FROM events",
    "a7_nearest_rank": "WITH r AS (SELECT assignment_id, total, row_number() OVER (PARTITION BY assignment_id ORDER BY total, run_id) AS rn, count(*) OVER (PARTITION BY assignment_id) AS n FROM verdict) SELECT assignment_id, round(max(CASE WHEN rn = CAST(floor(n * 0.95e0) AS BIGINT) + 1 THEN total END), 6) AS p95, round(max(CASE WHEN rn = CAST(floor(n / 2e0) AS BIGINT) + 1 THEN total END), 6) AS median FROM r GROUP BY assignment_id",
    "a8_faculty_minutes": "SELECT round((2.5e0 * count_if(state = 'escalated') + 1.5e0 * count_if(state = 'overridden')) / count(DISTINCT assignment_id), 6) AS minutes FROM verdict",
    "a9_weighted_kappa": "WITH p AS (SELECT CAST(substr(assignment_id, 1, 1) AS BIGINT) - 1 AS a, CAST(least(4, greatest(0, floor(price / max(price) OVER () * 5))) AS BIGINT) AS h FROM run), n AS (SELECT count(*) AS n FROM p), o AS (SELECT sum((a - h) * (a - h) / 16e0) AS s FROM p), ma AS (SELECT a, count(*) AS c FROM p GROUP BY a), mh AS (SELECT h, count(*) AS c FROM p GROUP BY h), e AS (SELECT sum((ma.a - mh.h) * (ma.a - mh.h) / 16e0 * ma.c * mh.c) AS s FROM ma CROSS JOIN mh) SELECT CASE WHEN n.n < 4 OR e.s = 0 THEN NULL ELSE round(1e0 - o.s / (e.s / n.n), 6) END AS kappa FROM o CROSS JOIN e CROSS JOIN n",
    "a10_weighted_mean": "SELECT run_id, round(sum(score * weight) / sum(weight), 6) AS score FROM item GROUP BY run_id",
    "a11_agreement": "WITH c AS (SELECT run_id, sum(score * weight) / sum(weight) AS mean FROM item GROUP BY run_id) SELECT i.run_id, round(greatest(0e0, 1e0 - 2e0 * sum(i.weight * abs(i.score - c.mean)) / sum(i.weight)) + 1e-9, 6) AS agreement FROM item i JOIN c ON c.run_id = i.run_id GROUP BY i.run_id",
    "a12_run_total": "SELECT run_id, round(sum(score * weight) / sum(weight) * (1e0 - least(0.25e0, 0.05e0 * count_if(flag = 'R'))) + 1e-9, 6) AS total, round(sum(weight * (1e0 - abs(score - 0.5e0))) / sum(weight) + 1e-9, 6) AS confidence FROM item GROUP BY run_id",
    "a13_override_total": "SELECT run_id, round(sum(coalesce(CASE WHEN flag = 'A' THEN 1e0 END, score) * weight) / sum(weight) + 1e-9, 6) AS total FROM item GROUP BY run_id",
    "a14_difficulty": "SELECT item_key, round(avg(CASE WHEN score >= 0.999e0 THEN 1e0 ELSE 0e0 END), 6) AS difficulty FROM item GROUP BY item_key",
    "a15_point_biserial": "WITH x AS (SELECT i.item_key, CASE WHEN i.score >= 0.999e0 THEN 1e0 ELSE 0e0 END AS f, m.total AS t FROM item i JOIN mark m ON m.run_id = i.run_id) SELECT item_key, CASE WHEN count(*) < 3 OR min(f) = max(f) OR min(t) = max(t) THEN 0e0 ELSE round(corr(f, t) * sqrt((count(*) - 1e0) / count(*)), 6) END AS discrimination FROM x GROUP BY item_key",
    "a16_pearson": "WITH x AS (SELECT i.assignment_id, i.score AS a, m.total AS b FROM item i JOIN mark m ON m.run_id = i.run_id) SELECT assignment_id, CASE WHEN count(*) < 3 THEN 0e0 ELSE round(coalesce(corr(a, b), 0e0), 6) END AS r FROM x GROUP BY assignment_id",
    "a17_mean_std": "SELECT concept_key, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0e0), 6) AS std FROM obs GROUP BY concept_key",
    "a19_histogram": "WITH b AS (SELECT CAST(least(9, greatest(0, floor(total * 10))) AS BIGINT) AS bin, count(*) AS n FROM verdict GROUP BY 1), all_ AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(bin)) SELECT CAST(a.bin AS BIGINT) AS bin, CAST(coalesce(b.n, 0) AS BIGINT) AS n FROM all_ a LEFT JOIN b ON a.bin = b.bin",
    "a20_peaks": "WITH b AS (SELECT CAST(least(9, greatest(0, floor(total * 10))) AS BIGINT) AS bin, count(*) AS n FROM verdict GROUP BY 1), w AS (SELECT bin, n, lag(n, 1, 0) OVER (ORDER BY bin) AS a, lead(n, 1, 0) OVER (ORDER BY bin) AS z FROM b) SELECT bin, CAST(n AS BIGINT) AS n, n > a AND n >= z AS peak FROM w",
    "a21_course_outcome": "WITH s AS (SELECT c.outcome, m.student_id, avg(m.m) AS f FROM mastery m JOIN concepts c ON c.concept = m.concept_key GROUP BY c.outcome, m.student_id) SELECT outcome, CAST(count(*) AS BIGINT) AS students, round(count_if(f >= 0.2e0) * 1e0 / count(*), 6) AS attainment FROM s GROUP BY outcome",
    "a22_programme_outcome": "WITH co AS (SELECT c.outcome, avg(m.m) AS f FROM mastery m JOIN concepts c ON c.concept = m.concept_key GROUP BY c.outcome), w AS (SELECT * FROM (VALUES ('CO1', 'PO1', 3e0), ('CO2', 'PO1', 1e0), ('CO2', 'PO2', NULL), ('CO3', 'PO2', 2e0)) AS x(co, po, w)) SELECT w.po, round(sum(co.f * coalesce(w.w, 1e0)) / sum(coalesce(w.w, 1e0)), 6) AS attainment, @JOINED(@SORTED(w.co)) AS outcomes FROM w JOIN co ON co.outcome = w.co GROUP BY w.po",
    "a23_attainment_summary": "WITH co AS (SELECT c.outcome, avg(m.m) AS f FROM mastery m JOIN concepts c ON c.concept = m.concept_key GROUP BY c.outcome) SELECT CAST(count_if(f >= 0.25e0) AS BIGINT) AS attained, min_by(outcome, f) AS weakest, round(avg(f), 6) AS mean FROM co",
    "a24_cohort_mastery": "SELECT concept_key, round(avg(m), 6) AS mean, CAST(count_if(m < 0.55e0) AS BIGINT) AS below, CAST(count(*) AS BIGINT) AS n FROM mastery GROUP BY concept_key HAVING count(*) >= 3",
    "a25_flag_parity": "WITH f AS (SELECT s.segment AS grp, CASE WHEN avg(v.total) < 0.5e0 THEN 1e0 ELSE 0e0 END AS flagged FROM verdict v JOIN student s ON s.student_id = v.student_id GROUP BY s.segment, v.student_id), g AS (SELECT grp, count(*) AS n, avg(flagged) AS rate, sum(flagged) AS k FROM f GROUP BY grp HAVING count(*) >= 5) SELECT grp, CAST(n AS BIGINT) AS n, round(rate, 6) AS rate, round(rate - sum(k) OVER () / sum(n) OVER (), 6) AS delta FROM g",
    "a26_false_positive_rate": "WITH f AS (SELECT v.student_id, s.region AS grp, avg(v.total) < 0.5e0 AS flagged, max(v.total) >= 0.8e0 AS passed FROM verdict v JOIN student s ON s.student_id = v.student_id GROUP BY v.student_id, s.region) SELECT grp, round(count_if(flagged AND passed) * 1e0 / nullif(count_if(passed), 0), 6) AS fpr FROM f GROUP BY grp",
    "a27_slope": "WITH t AS (SELECT student_id, score, row_number() OVER (PARTITION BY student_id ORDER BY observed_at, obs_id) - 1 AS i FROM obs) SELECT student_id, CASE WHEN count(*) < 3 THEN 0e0 ELSE round(regr_slope(score, i), 9) END AS slope FROM t GROUP BY student_id",
    "a28_dashboard_counts": "SELECT student_id, CAST(count_if(m >= 0.7e0) AS BIGINT) AS mastered, CAST(count_if(m < 0.45e0) AS BIGINT) AS gaps, CAST(count_if(u > 0.22e0) AS BIGINT) AS uncertain FROM mastery GROUP BY student_id",
    # assignments are few: items dealt by them would meet in a few tasks
    "a30_common_failures": (
        "WITH s AS (SELECT assignment_id, count(DISTINCT run_id) AS n FROM item GROUP BY assignment_id) SELECT /*+ BROADCAST(s) */ i.assignment_id, i.item_key, CAST(count(DISTINCT i.run_id) AS BIGINT) AS hits FROM item i JOIN s ON s.assignment_id = i.assignment_id GROUP BY i.assignment_id, i.item_key, s.n HAVING count(DISTINCT i.run_id) >= s.n / 8e0",
        "WITH s AS (SELECT assignment_id, count(DISTINCT run_id) AS n FROM item GROUP BY assignment_id) SELECT i.assignment_id, i.item_key, CAST(count(DISTINCT i.run_id) AS BIGINT) AS hits FROM item i JOIN s ON s.assignment_id = i.assignment_id GROUP BY i.assignment_id, i.item_key, s.n HAVING count(DISTINCT i.run_id) >= s.n / 8e0",
    ),
    "a33_behaviour": "WITH w AS (SELECT student_id, started_at, row_number() OVER (PARTITION BY student_id ORDER BY started_at, run_id) AS i, count(*) OVER (PARTITION BY student_id) AS n, state FROM run) SELECT student_id, CAST(count_if(i <= n / 2) AS BIGINT) AS early, CAST(count_if(i > n / 2) AS BIGINT) AS late, CAST(count_if(state = 'escalated') AS BIGINT) AS abandoned FROM w GROUP BY student_id",
    "a34_queue_stats": "SELECT event_type AS job_key, CAST(count(*) AS BIGINT) AS depth, round(avg(value), 6) AS mean_wait FROM events GROUP BY event_type",
    "a35_claim_counts": "SELECT role, CAST(count(*) AS BIGINT) AS n, round(count_if(length(text) > 200) * 1e0 / count(*), 6) AS covered FROM conversations GROUP BY role",
    "a36_pass_rate": "SELECT run_id, round(count_if(score >= 0.5e0) * 1e0 / count(*), 6) AS rate, round(sum(CASE WHEN score >= 0.5e0 THEN weight ELSE 0e0 END) / sum(weight), 6) AS weighted FROM item GROUP BY run_id",
    "a37_static_rate": "SELECT CAST(assignment_id AS STRING) AS assignment_id, round(avg(score), 6) AS rate FROM obs WHERE source = 'static' GROUP BY assignment_id",
    "a38_mean_error": "WITH p AS (SELECT assignment_id, avg(total) AS m FROM verdict GROUP BY assignment_id) SELECT round(avg(abs(v.total - p.m)), 6) AS train_mae FROM verdict v JOIN p ON p.assignment_id = v.assignment_id",
    "a39_client_counts": "SELECT CAST(count_if(state = 'released') AS BIGINT) AS released, CAST(count_if(state = 'escalated') AS BIGINT) AS waiting, round(sum(total), 4) AS marks FROM verdict",
    # windows
    "w1_latest_run": "WITH r AS (SELECT student_id, assignment_id, run_id, row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY started_at DESC, run_id) AS rn FROM run) SELECT student_id, assignment_id, run_id FROM r WHERE rn = 1",
    "w2_last_write": "WITH r AS (SELECT student_id, assignment_id, run_id, row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY started_at DESC, run_id DESC) AS rn FROM run) SELECT student_id, assignment_id, run_id FROM r WHERE rn = 1",
    "w3_attempts": "SELECT student_id, CAST(count(*) AS BIGINT) AS attempts, max(started_at) AS latest FROM run GROUP BY student_id",
    "w4_score_delta": "SELECT run_id, round(total - lag(total) OVER (PARTITION BY student_id ORDER BY started_at, run_id) + 1e-9, 6) + 0e0 AS delta FROM verdict",
    "w5_recent_evidence": "WITH r AS (SELECT student_id, concept_key, obs_id, row_number() OVER (PARTITION BY student_id, concept_key ORDER BY observed_at DESC, obs_id DESC) AS rn FROM obs) SELECT student_id, concept_key, @JOINED(@SORTED(obs_id)) AS refs FROM r WHERE rn <= 8 GROUP BY student_id, concept_key",
    "w6_trajectories": "WITH r AS (SELECT student_id, concept_key, score, row_number() OVER (PARTITION BY student_id, concept_key ORDER BY observed_at DESC, obs_id DESC) AS rn FROM obs), s AS (SELECT student_id, concept_key, count(*) AS n, max(CASE WHEN rn = 1 THEN score END) AS last FROM r WHERE rn <= 20 GROUP BY student_id, concept_key HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY last, concept_key) AS i FROM s) SELECT student_id, concept_key, CAST(n AS BIGINT) AS n, last FROM k WHERE i <= 12",
    "w7_rate_limit": "WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id, CAST(n AS BIGINT) AS n, n >= 20 AS rejected FROM c",
    "w8_attempt_number": "SELECT run_id, CAST(row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY started_at, run_id) AS BIGINT) AS attempt_no FROM run",
    "w9_next_version": "SELECT assignment_id, CAST(max(item_key) + 1 AS BIGINT) AS next_version FROM item GROUP BY assignment_id",
    "w10_next_code": "SELECT concat('LAB', lpad(CAST(max(CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS STRING), 4, '0')) AS code FROM supplier",
    "w16_local_maximum": "WITH b AS (SELECT CAST(floor(l_extendedprice / 5e3) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n > lag(n, 1, 0) OVER (ORDER BY bin) AND n > lead(n, 1, 0) OVER (ORDER BY bin) AS is_peak FROM b",
    "w17_halves": "WITH w AS (SELECT student_id, score, row_number() OVER (PARTITION BY student_id ORDER BY observed_at, obs_id) AS i, count(*) OVER (PARTITION BY student_id) AS n FROM obs) SELECT student_id, round(avg(CASE WHEN i * 2 <= n THEN score END), 6) AS early, round(avg(CASE WHEN i * 2 > n THEN score END), 6) AS late FROM w GROUP BY student_id",
    "w18_queue_position": "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS BIGINT) AS pos FROM events",
    "w19_topic_chain": "SELECT concept, lag(concept) OVER (ORDER BY coalesce(week, 99), concept) AS chained_prerequisite FROM concepts",
    "w20_active_version": "SELECT assignment_id, coalesce(max(CASE WHEN flag = 'A' THEN item_key END), max(item_key)) AS active FROM item GROUP BY assignment_id",
    "w21_map_columns": "SELECT concept, CAST(dense_rank() OVER (ORDER BY coalesce(week, 99)) AS BIGINT) AS col, CAST(row_number() OVER (PARTITION BY coalesce(week, 99) ORDER BY concept) AS BIGINT) AS slot FROM concepts",
    # sorts and limits
    "o1_review_queue": "SELECT run_id, round(price, 2) AS priority FROM run WHERE state = 'escalated' ORDER BY price DESC, run_id LIMIT 50",
    "o2_contested": "WITH r AS (SELECT run_id, item_key, weight, score, row_number() OVER (PARTITION BY run_id ORDER BY score, item_key, weight) AS rn FROM item) SELECT run_id, item_key, score, weight FROM r WHERE rn <= 5",
    "o3_top_recommendations": "WITH r AS (SELECT student_id, concept_key, (1e0 - m) * (0.7e0 + 0.3e0 * (1e0 - u)) AS p, row_number() OVER (PARTITION BY student_id ORDER BY (1e0 - m) * (0.7e0 + 0.3e0 * (1e0 - u)) DESC, concept_key) AS rn FROM mastery) SELECT student_id, concept_key, round(p, 6) AS priority FROM r WHERE rn <= 5",
    "o5_pacing_sort": "SELECT concept_key, round(avg(m), 6) AS mean, coalesce(max(c.week), 99) AS week FROM mastery JOIN concepts c ON c.concept = concept_key GROUP BY concept_key ORDER BY mean, week DESC LIMIT 6",
    "o6_interventions": "SELECT student_id, round(max((1e0 - m) * (1.3e0 - m)), 6) AS priority FROM mastery GROUP BY student_id ORDER BY priority DESC, student_id LIMIT 12",
    "o7_severity_sort": "SELECT item_key, flag, CAST(row_number() OVER (ORDER BY CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, count(*) DESC, item_key) AS BIGINT) AS place FROM item GROUP BY item_key, flag",
    "o8_boolean_sort": "SELECT run_id, CAST(row_number() OVER (PARTITION BY assignment_id ORDER BY CASE WHEN state = 'escalated' THEN 0 ELSE 1 END, run_id) AS BIGINT) AS place FROM run",
    "o9_top_pairs": "SELECT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b, a.n_chars FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id ORDER BY a.n_chars DESC, a, b LIMIT 40",
    "o10_null_week_sort": "SELECT concept, CAST(row_number() OVER (ORDER BY coalesce(week, 99), concept) AS BIGINT) AS place FROM concepts",
    "o11_code_sort": "SELECT po, CAST(row_number() OVER (ORDER BY length(po), po) AS BIGINT) AS place FROM (VALUES ('PO10'), ('PO2'), ('PO1')) AS t(po)",
    "o14_argmin": "SELECT student_id, min_by(concept_key, m) AS weakest, max_by(concept_key, n) AS most_seen FROM (SELECT student_id, concept_key, m * 1e6 + ascii(concept_key) * 1e-3 AS m, n * 1000 + ascii(concept_key) AS n FROM mastery) AS t GROUP BY student_id",
    # sets
    "u2_difference": "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09e0",
    "u3_noise": "SELECT s.student_id FROM student s WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.state = 'released' AND r.student_id = s.student_id)",
    "u6_distinct_first": "WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY role, md5(text) ORDER BY conv_id, turn) AS rn FROM conversations) SELECT conv_id, role, turn FROM r WHERE rn = 1",
    "u7_union_sorted": "SELECT student_id, @JOINED(@DISTINCT(@LIST(state))) AS reasons FROM run GROUP BY student_id",
    "u8_rubric_diff": "WITH a AS (SELECT item_key, count(*) AS w FROM item WHERE flag = 'A' GROUP BY item_key), b AS (SELECT item_key, count(*) AS w FROM item WHERE flag = 'R' AND item_key > 2 GROUP BY item_key) SELECT coalesce(a.item_key, b.item_key) AS item_key, CASE WHEN a.item_key IS NULL THEN 'add' WHEN b.item_key IS NULL THEN 'delete' WHEN a.w <> b.w THEN 'reweight' ELSE 'same' END AS change FROM a FULL JOIN b ON a.item_key = b.item_key",
    "u9_hash_union": "SELECT md5(text) AS h FROM benchmark UNION SELECT md5(lang) FROM documents",
}
