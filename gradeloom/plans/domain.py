"""Knowledge tracing, graph walks, risk, similarity and scalar functions over the domain views.

An entry is one SQL text for both engines, or a pair (Spark, DuckDB) where their forms differ.
"""

from __future__ import annotations

_ADJ = """adj AS (SELECT o.*, least(0.45e0, 0.10e0 * a.s * (2e0 - least(1e0, greatest(0e0, confidence)))) AS slip, least(0.45e0, 0.20e0 * a.g * (2e0 - least(1e0, greatest(0e0, confidence)))) AS guess
  FROM obs o JOIN (VALUES ('test', 0.85e0, 0.80e0), ('repair', 1e0, 0.95e0), ('static', 0.95e0, 1.05e0), ('structural', 1.35e0, 1.45e0), ('report', 1.50e0, 1.60e0), ('manual', 0.60e0, 0.60e0)) AS a(source, s, g) ON a.source = o.source)"""


def _post(m: str, x: str) -> str:
    """Posterior of mastery m after the observation x, then the learning step."""
    p = f"({x}.score * ({m} * (1e0 - {x}.slip) / ({m} * (1e0 - {x}.slip) + (1e0 - {m}) * {x}.guess)) + (1e0 - {x}.score) * ({m} * {x}.slip / ({m} * {x}.slip + (1e0 - {m}) * (1e0 - {x}.guess))))"
    return f"({p} + (1e0 - {p}) * 0.18e0)"


_STATE = "round(m, 6) AS estimate, CAST(n AS BIGINT) AS n, round(least(1e0, 0.65e0 / sqrt(1e0 + n) + 0.35e0 * (1e0 - 2e0 * abs(m - 0.5e0))), 6) AS uncertainty"
_FOLD = f"traced AS (SELECT student_id, concept_key, r.m AS m, r.n AS n FROM (SELECT student_id, concept_key, aggregate(array_sort(collect_list(struct(observed_at, obs_id, score, slip, guess))), named_struct('m', 0.25e0, 'n', 0), (a, x) -> named_struct('m', {_post('a.m', 'x')}, 'n', a.n + 1)) AS r FROM adj GROUP BY student_id, concept_key) AS t)"
_STEPS = f"""seq AS (SELECT *, row_number() OVER (PARTITION BY student_id, concept_key ORDER BY observed_at, obs_id) AS rn, count(*) OVER (PARTITION BY student_id, concept_key) AS n FROM adj),
fold(student_id, concept_key, rn, n, m) AS (SELECT student_id, concept_key, rn, n, {_post('0.25e0', 'seq')} FROM seq WHERE rn = 1 UNION ALL SELECT seq.student_id, seq.concept_key, seq.rn, seq.n, {_post('fold.m', 'seq')} FROM fold JOIN seq ON seq.student_id = fold.student_id AND seq.concept_key = fold.concept_key AND seq.rn = fold.rn + 1),
traced AS (SELECT student_id, concept_key, m, n FROM fold WHERE rn = n)"""


def _traced(tail: str, more: str = "") -> tuple[str, str]:
    return f"WITH {_ADJ}, {_FOLD}{more} {tail}", f"WITH {_ADJ}, {_STEPS}{more} {tail}"


#: Word winnowing: hashes of 5 words, the least hash of each 4 in a row; of fewer than 4 hashes all.
_WORDS = (
    "words AS (SELECT doc_id, pos, w FROM (SELECT doc_id, posexplode(split(lower(text), '[^a-z0-9]+')) AS (pos, w) FROM documents) AS t)",
    "words AS (SELECT doc_id, i - 1 AS pos, l[i] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS l FROM documents) AS a) AS t)",
)
_WINNOW = """grams AS (SELECT doc_id, pos, md5(concat_ws(' ', w, lead(w, 1) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s, lead(w, 4) OVER s)) AS h, lead(w, 4) OVER s AS tail FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY pos)),
kept AS (SELECT doc_id, pos, h FROM grams WHERE tail IS NOT NULL),
least4 AS (SELECT doc_id, pos, least(h, coalesce(lead(h, 1) OVER s, h), coalesce(lead(h, 2) OVER s, h), coalesce(lead(h, 3) OVER s, h)) AS h, lead(h, 3) OVER s AS tail, h AS own, count(*) OVER (PARTITION BY doc_id) AS grams_ FROM kept WINDOW s AS (PARTITION BY doc_id ORDER BY pos)),
prints AS (SELECT DISTINCT doc_id, CASE WHEN grams_ < 4 THEN own ELSE h END AS h FROM least4 WHERE tail IS NOT NULL OR grams_ < 4),
common AS (SELECT h FROM prints GROUP BY h HAVING count(*) >= greatest(3, floor(0.4e0 * (SELECT count(*) FROM documents)))),
informative AS (SELECT p.doc_id, p.h FROM prints p WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.h = p.h)),
sized AS (SELECT doc_id, count(*) AS n FROM informative GROUP BY doc_id)"""


def _winnow(tail: str) -> tuple[str, str]:
    return tuple(f"WITH {w}, {_WINNOW} {tail}" for w in _WORDS)


_WALK = "walk(start_, node, depth) AS (SELECT concept, prereq, 1 FROM prereq UNION ALL SELECT w.start_, p.prereq, w.depth + 1 FROM walk w JOIN prereq p ON p.concept = w.node WHERE w.depth < 3)"
#: Walks carry their path and end where a concept would come again.
_UP = "up(base, node, depth, path) AS (SELECT prereq, concept, 1, concat('/', prereq, '/', concept, '/') FROM prereq UNION ALL SELECT u.base, p.concept, u.depth + 1, concat(u.path, p.concept, '/') FROM up u JOIN prereq p ON p.prereq = u.node WHERE NOT contains(u.path, concat('/', p.concept, '/')))"
_GAPS = """known AS (SELECT s.student_id, c.concept, coalesce(m.m, 0.25e0) AS m, coalesce(m.u, 1e0) AS u, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT student_id FROM obs) AS s CROSS JOIN concepts c LEFT JOIN mastery m ON m.student_id = s.student_id AND m.concept_key = c.concept),
edge AS (SELECT student_id, concept, prereq FROM (SELECT k.student_id, p.concept, p.prereq, row_number() OVER (PARTITION BY k.student_id, p.concept ORDER BY k.m, p.prereq) AS rn FROM prereq p JOIN known k ON k.concept = p.prereq WHERE k.m < 0.7e0) AS t WHERE rn = 1),
down(student_id, start_, node, depth, path) AS (SELECT student_id, concept, concept, 0, concat('/', concept, '/') FROM known WHERE m < 0.7e0 UNION ALL SELECT d.student_id, d.start_, e.prereq, d.depth + 1, concat(d.path, e.prereq, '/') FROM down d JOIN edge e ON e.student_id = d.student_id AND e.concept = d.node WHERE NOT contains(d.path, concat('/', e.prereq, '/'))),
goal AS (SELECT student_id, start_, node AS target, depth FROM (SELECT *, row_number() OVER (PARTITION BY student_id, start_ ORDER BY depth DESC) AS rn FROM down) AS t WHERE rn = 1)"""
_RECO = f"""{_GAPS}, reco AS (SELECT * FROM (SELECT g.student_id, g.target, g.start_, g.depth, k.m, k.u, k.n, (1e0 - k.m) * (1e0 + 0.4e0 * g.depth) * (0.7e0 + 0.3e0 * (1e0 - k.u)) AS priority, row_number() OVER (PARTITION BY g.student_id, g.target ORDER BY (1e0 + 0.4e0 * g.depth) DESC, g.start_) AS rn FROM goal g JOIN known k ON k.student_id = g.student_id AND k.concept = g.target) AS t WHERE rn = 1)"""

#: The weights of the seven risk factors, their thresholds, the squash and the support routes.
#: Behaviour is read from the events: a week is an assignment, begun late if its first event comes after its middle,
#: an event of type 'error' is an abandoned attempt, decay compares the later with the earlier half of the weeks.
_RISK = """weeks AS (SELECT assignment_id, row_number() OVER (ORDER BY assignment_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT assignment_id FROM obs) AS w),
levels AS (SELECT student_id, avg(m) AS mean, count(*) AS tracked FROM mastery GROUP BY student_id),
points AS (SELECT student_id, concept_key, score, row_number() OVER (PARTITION BY student_id, concept_key ORDER BY observed_at, obs_id) - 1 AS i FROM obs),
slopes AS (SELECT student_id, avg(slope) AS slope, count(*) AS trends FROM (SELECT student_id, concept_key, coalesce(regr_slope(score, i), 0e0) AS slope FROM points GROUP BY student_id, concept_key HAVING count(*) >= 3) AS x GROUP BY student_id),
weak AS (SELECT s.student_id, c.concept, m.m IS NOT NULL AS tracked FROM levels s CROSS JOIN concepts c LEFT JOIN mastery m ON m.student_id = s.student_id AND m.concept_key = c.concept WHERE coalesce(m.m, 0e0) < 0.7e0),
deep(student_id, node, depth, path) AS (SELECT student_id, concept, 1, concat('/', concept, '/') FROM weak WHERE tracked UNION ALL SELECT d.student_id, p.prereq, d.depth + 1, concat(d.path, p.prereq, '/') FROM deep d JOIN prereq p ON p.concept = d.node JOIN weak w ON w.student_id = d.student_id AND w.concept = p.prereq WHERE NOT contains(d.path, concat('/', p.prereq, '/'))),
gaps AS (SELECT student_id, max(depth) AS depth FROM deep GROUP BY student_id),
begun AS (SELECT student_id, assignment_id, min(observed_at) AS first_at, count(*) AS k, count_if(concept_key = 'error') AS dropped FROM obs GROUP BY student_id, assignment_id),
habits AS (SELECT b.student_id, avg(CASE WHEN @SEC(b.first_at) - @SEC(b.assignment_id) > 302400 THEN 1e0 ELSE 0e0 END) AS late, sum(b.dropped) * 1e0 / sum(b.k) AS dropped, max(w.n) - count(*) AS missed,
  CASE WHEN sum(CASE WHEN 2 * w.i <= w.n THEN b.k ELSE 0 END) = 0 THEN 0e0 ELSE greatest(0e0, 1e0 - sum(CASE WHEN 2 * w.i > w.n THEN b.k ELSE 0 END) * 1e0 / sum(CASE WHEN 2 * w.i <= w.n THEN b.k ELSE 0 END)) END AS decay FROM begun b JOIN weeks w ON w.assignment_id = b.assignment_id GROUP BY b.student_id),
features AS (SELECT l.student_id, l.mean, coalesce(s.slope, 0e0) AS slope, coalesce(g.depth, 0) AS depth, h.late, h.dropped, h.decay, h.missed FROM levels l JOIN habits h ON h.student_id = l.student_id LEFT JOIN slopes s ON s.student_id = l.student_id LEFT JOIN gaps g ON g.student_id = l.student_id),
factors AS (SELECT * FROM (SELECT f.student_id, f.depth, f.decay, k.factor, CASE k.i WHEN 1 THEN (1e0 - mean) * 0.30e0 WHEN 2 THEN CASE WHEN -slope * 6e0 * 0.22e0 > 0.005e0 THEN -slope * 6e0 * 0.22e0 END WHEN 3 THEN CASE WHEN depth >= 2 THEN least(1e0, depth / 4e0) * 0.16e0 END
  WHEN 4 THEN CASE WHEN late > 0.4e0 THEN late * 0.09e0 END WHEN 5 THEN CASE WHEN dropped > 0.25e0 THEN dropped * 0.09e0 END WHEN 6 THEN CASE WHEN decay > 0.3e0 THEN decay * 0.08e0 END WHEN 7 THEN CASE WHEN missed > 0 THEN least(1e0, missed / 3e0) * 0.06e0 END END AS c
  FROM features f CROSS JOIN (VALUES (1, 'Low mastery across the course'), (2, 'Declining mastery trajectory'), (3, 'Deep prerequisite gap'), (4, 'Consistently late starts'), (5, 'Attempts abandoned mid-way'), (6, 'Engagement falling over the term'), (7, 'Missed assignments')) AS k(i, factor)) AS x WHERE c IS NOT NULL),
scored AS (SELECT *, 1e0 / (1e0 + exp(-6e0 * (sum(c) OVER (PARTITION BY student_id) - 0.32e0))) AS risk, row_number() OVER (PARTITION BY student_id ORDER BY round(c, 9) DESC, factor) AS rn FROM factors)"""
_LISTED = ", ".join(f"max(CASE WHEN rn = {i} {'AND risk >= 0.55e0 ' if i > 3 else ''}THEN factor END)" for i in range(1, 8))
_RISK_ROWS = f"SELECT student_id, round(max(risk), 6) AS risk, max(risk) >= 0.55e0 AS flagged, CASE WHEN max(risk) >= 0.55e0 AND max(depth) >= 2 THEN 'tutoring' WHEN max(risk) >= 0.55e0 AND max(decay) > 0.4e0 THEN 'instructor_check_in' ELSE 'advising' END AS route, concat_ws('; ', {_LISTED}) AS factors FROM scored GROUP BY student_id"

SQL: dict[str, str | tuple[str, str]] = {
    # knowledge tracing
    "k1_adjusted_slip_guess": f"WITH {_ADJ} SELECT obs_id, round(slip, 6) AS slip, round(guess, 6) AS guess FROM adj",
    "k2_first_update": f"WITH {_ADJ} SELECT obs_id, round({_post('0.25e0', 'adj')}, 6) AS posterior FROM adj",
    "k3_trace_students": _traced(f"SELECT student_id, concept_key, {_STATE} FROM traced"),
    "w11_recursive_fold": _traced("SELECT concept_key, round(avg(m), 6) AS mean, CAST(count_if(m >= 0.7e0) AS BIGINT) AS mastered FROM traced GROUP BY concept_key"),
    "k5_prerequisite_walk": f"WITH {_WALK} SELECT start_, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY start_, node",
    "k7_auc": "WITH r AS (SELECT assignment_id, CASE WHEN state = 'released' THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY assignment_id ORDER BY total) + (count(*) OVER (PARTITION BY assignment_id, total) - 1) / 2e0 AS rk FROM verdict) SELECT assignment_id, round((sum(CASE WHEN y = 1 THEN rk ELSE 0e0 END) - sum(y) * (sum(y) + 1e0) / 2e0) / (sum(y) * 1e0 * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY assignment_id",
    "k4_propagate_once": f"WITH {_WALK}, f AS (SELECT student_id, concept_key, avg((1e0 - score) * confidence) AS strength FROM obs WHERE score < 0.5e0 GROUP BY student_id, concept_key HAVING count(*) >= 2), o AS (SELECT start_, node, row_number() OVER (PARTITION BY start_ ORDER BY min(depth), node) AS ord FROM walk GROUP BY start_, node), d AS (SELECT f.student_id, o.node, f.strength * power(0.45e0, o.ord) / (1e0 + coalesce(m.n, 0)) AS adj FROM f JOIN o ON o.start_ = f.concept_key LEFT JOIN mastery m ON m.student_id = f.student_id AND m.concept_key = o.node) SELECT student_id, node, round(sum(adj), 6) AS lowered_by FROM d WHERE adj >= 0.01e0 GROUP BY student_id, node",
    # graph walks and recommendations
    "g1_root_gap": f"WITH {_GAPS} SELECT student_id, start_, target, CAST(depth AS BIGINT) AS depth FROM goal",
    "g2_recommend": f"WITH {_RECO} SELECT student_id, target, CASE WHEN u >= 0.22e0 AND n < 3 THEN 'diagnose' ELSE 'remediate' END AS action, round(priority, 6) AS priority FROM reco",
    "g4_downstream": f"WITH {_UP} SELECT base AS concept, CAST(count(DISTINCT node) AS BIGINT) AS dependents FROM up GROUP BY base",
    "g5_reteach": f"WITH {_UP}, d AS (SELECT base, count(DISTINCT node) AS dep FROM up GROUP BY base), c AS (SELECT concept_key, avg(m) AS mean, count_if(m < 0.55e0) AS below, count(*) AS n FROM mastery GROUP BY concept_key HAVING count(*) >= 3) SELECT c.concept_key, round((1e0 - mean) * (1e0 + 0.35e0 * coalesce(dep, 0)) * below / n, 6) AS urgency FROM c LEFT JOIN d ON d.base = c.concept_key ORDER BY urgency DESC, concept_key LIMIT 8",
    "o4_reteach_order": "SELECT concept_key, round(1e0 - avg(m), 6) AS urgency FROM mastery GROUP BY concept_key ORDER BY urgency DESC, concept_key LIMIT 8",
    "g6_pacing": "SELECT c.concept, CAST(8 - c.week AS BIGINT) AS weeks_since, round(avg(m.m), 6) AS mean FROM concepts c JOIN mastery m ON m.concept_key = c.concept WHERE c.week <= 8 GROUP BY c.concept, c.week HAVING avg(m.m) < 0.55e0",
    "g7_interventions": f"WITH {_RECO}, s AS (SELECT student_id, avg(m) AS mean FROM mastery GROUP BY student_id), b AS (SELECT r.student_id, max(r.priority) AS p FROM reco r GROUP BY r.student_id) SELECT b.student_id, round(b.p * (1.3e0 - s.mean), 6) AS priority FROM b JOIN s ON s.student_id = b.student_id",
    "g8_gap_depth": f"WITH {_GAPS}, chain(student_id, node, depth, path) AS (SELECT student_id, concept, 1, concat('/', concept, '/') FROM known WHERE m < 0.7e0 UNION ALL SELECT c.student_id, p.prereq, c.depth + 1, concat(c.path, p.prereq, '/') FROM chain c JOIN prereq p ON p.concept = c.node JOIN known k ON k.student_id = c.student_id AND k.concept = p.prereq WHERE k.m < 0.7e0 AND NOT contains(c.path, concat('/', p.prereq, '/'))) SELECT student_id, CAST(max(depth) AS BIGINT) AS depth FROM chain GROUP BY student_id",
    "g9_gap_flag": "SELECT m.student_id, m.concept_key FROM mastery m WHERE m.m < 0.7e0 AND EXISTS (SELECT 1 FROM prereq p WHERE p.prereq = m.concept_key)",
    # risk, gate and review
    "r1_risk": f"WITH {_RISK} {_RISK_ROWS}",
    "r3_risk_invariant": f"WITH {_RISK}, a AS ({_RISK_ROWS}) SELECT count(*) AS students, CAST(count_if(flagged AND factors = '') AS BIGINT) AS flagged_without_factors, CAST(count_if(route NOT IN ('advising', 'tutoring', 'peer_mentoring', 'instructor_check_in')) AS BIGINT) AS off_route, CAST(count_if(risk < 0e0 OR risk > 1e0) AS BIGINT) AS off_scale FROM a",
    "e8_claim_labels": "SELECT conv_id, turn, CASE WHEN f.k IS NULL THEN 'unverifiable' WHEN length(c.text) > 200 THEN 'supported' ELSE 'contradicted' END AS label FROM conversations c LEFT JOIN (VALUES ('user'), ('assistant')) AS f(k) ON f.k = c.role",
    # scalar functions
    "f8_complexity_rank": "SELECT raw, CASE lower(replace(replace(raw, ' ', ''), '^', '')) WHEN 'o(1)' THEN 0 WHEN 'o(logn)' THEN 1 WHEN 'o(n)' THEN 2 WHEN 'o(nlogn)' THEN 3 WHEN 'o(n2)' THEN 4 ELSE 9 END AS rank_ FROM (VALUES ('O(n)'), ('O(n log n)'), ('O(N^2)'), ('O( 1 )'), ('fast')) AS t(raw)",
    "f7_lexicon_class": "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'en' WHEN contains(lower(text), 'der') THEN 'de' WHEN contains(lower(text), 'que') THEN 'fr' ELSE 'other' END AS kind FROM conversations",
    "f11_levenshtein": ("SELECT p_partkey, CAST(levenshtein(p_brand, 'Brand#12') AS BIGINT) AS d FROM part", "SELECT p_partkey, CAST(levenshtein(p_brand, 'Brand#12') AS BIGINT) AS d FROM part"),
    "f12_token_hits": ("SELECT doc_id, text RLIKE '\\\\b[Tt]he\\\\b' AS hit FROM documents", "SELECT doc_id, regexp_matches(text, '\\b[Tt]he\\b') AS hit FROM documents"),
    "f15_line_counts": ("SELECT doc_id, CAST(size(split(text, '\\n', -1)) AS BIGINT) AS lines FROM documents", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents"),
    "f16_language_votes": "SELECT doc_id, CASE WHEN contains(text, 'ñ') OR contains(text, 'ó') THEN 'es' WHEN contains(text, 'ü') OR contains(text, 'ß') THEN 'de' WHEN contains(text, 'è') OR contains(text, 'ê') THEN 'fr' ELSE 'en' END AS guess FROM documents",
    "f19_error_prefix": ("SELECT event_id, substr(substring_index(concat(event_type, ': ', props), ':', 1), 1, 40) AS error_type FROM events", "SELECT event_id, substr(split_part(concat(event_type, ': ', props), ':', 1), 1, 40) AS error_type FROM events"),
    "d1_late_seconds": "SELECT l_orderkey, l_linenumber, greatest(0, @SEC(l_shipdate) - @SEC(o_orderdate)) AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "d2_late_start": "SELECT run_id, item_key, (@SEC(submitted_at) - @SEC(TIMESTAMP '1994-01-01 00:00:00')) * 1e0 / 1e8 > 0.5e0 AS late_start FROM item",
    "d3_lead_weeks": "SELECT run_id, round((@SEC(TIMESTAMP '1999-01-01 00:00:00') - @SEC(started_at)) / 86400e0 / 7e0 + 1e-7, 4) AS weeks FROM run",
    "d6_latency": "SELECT user_id, round(avg(value), 6) AS ran, CAST(max(@SEC(ts)) - min(@SEC(ts)) AS BIGINT) AS span FROM events GROUP BY user_id",
    "d7_iso": "SELECT event_id, @ISO(ts) AS at FROM events",
    "ma1_logistic": "SELECT run_id, round(1e0 / (1e0 + exp(-6e0 * (total - 0.32e0))), 6) AS p FROM verdict",
    "ma2_linear_model": "SELECT run_id, round(1e0 / (1e0 + exp(-4e0 * (0.10e0 + 0.42e0 * least(1e0, total) + 0.14e0 - 0.5e0))), 6) AS confidence FROM verdict",
    "ma3_clamp": "SELECT obs_id, least(0.95e0, greatest(0.01e0, score)) AS clamped FROM obs",
    "ma5_boundary": "SELECT run_id, round(least(1e0, abs(total - 0.4e0) / 0.1e0) + 1e-9, 6) AS boundary FROM verdict",
    "ma6_uncertainty": "SELECT student_id, concept_key, round(u, 6) AS u FROM mastery",
    "ma7_penalty": "SELECT run_id, least(0.25e0, 0.05e0 * count(*)) AS penalty FROM item GROUP BY run_id",
    "ma11_tolerant_equal": "SELECT run_id, item_key, abs(score - 1e0) < 1e-9 AS equal_ FROM item",
    "aj1_explode_tags": "SELECT o.obs_id, c.outcome FROM obs o JOIN concepts c ON c.concept = o.concept_key",
    "aj2_flatten_distinct": "SELECT student_id, @JOINED(@DISTINCT(@LIST(concept_key))) AS weak FROM obs WHERE score < 0.2e0 GROUP BY student_id",
    "aj4_json_extract": "SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events",
    # similarity
    "a31_common_prints": _winnow("SELECT h FROM common"),
    "ma4_cosine": (
        "SELECT a.vec_id AS a, b.vec_id AS b, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0e0, (s, v) -> s + v) / sqrt(aggregate(a.embedding, 0e0, (s, v) -> s + CAST(v AS DOUBLE) * v) * aggregate(b.embedding, 0e0, (s, v) -> s + CAST(v AS DOUBLE) * v)), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id",
        "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(a.embedding, lambda v: v::DOUBLE * v)) * list_sum(list_transform(b.embedding, lambda v: v::DOUBLE * v))), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id",
    ),
    # composites
    "z3_course_health": "SELECT concept_key, round(avg(m), 6) AS mean, CAST(count_if(m < 0.25e0) AS BIGINT) AS struggling, round(max(u), 6) AS widest FROM mastery GROUP BY concept_key",
    "z4_trends": "SELECT assignment_id, CAST(count(*) AS BIGINT) AS runs, round(avg(total), 6) AS mean, round(coalesce(stddev_samp(total), 0e0), 6) AS std, CAST(count_if(state = 'escalated') AS BIGINT) AS escalated FROM verdict GROUP BY assignment_id",
    "z5_broken_items": "WITH s AS (SELECT item_key, flag, avg(CASE WHEN score >= 0.999e0 THEN 1e0 ELSE 0e0 END) AS d, count(*) AS n FROM item GROUP BY item_key, flag) SELECT item_key, flag, round(d, 6) AS difficulty, CASE WHEN d > 0.95e0 THEN 'too_easy' WHEN d < 0.2e0 THEN 'too_hard' ELSE 'ok' END AS verdict FROM s WHERE n >= 5",
    "z7_appeals": "WITH e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'signup')) SELECT user_id, CASE WHEN event_type = 'error' THEN 'open' ELSE 'resolved' END AS state FROM e WHERE rn = 1",
    "z9_regrade": "WITH r AS (SELECT v.*, row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY started_at DESC, run_id) AS rn FROM verdict v) SELECT run_id, CASE WHEN total >= 0.55e0 THEN 'released' ELSE 'escalated' END AS state FROM r WHERE rn = 1",
    "z10_listings": "SELECT n_name, CAST(count(*) AS BIGINT) AS students FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "z11_at_risk": "SELECT s.student_id, s.name, round(1e0 - avg(v.total), 6) AS risk FROM student s JOIN verdict v ON v.student_id = s.student_id GROUP BY s.student_id, s.name ORDER BY risk DESC, student_id LIMIT 20",
    "z12_isolation": "SELECT CAST(count_if(applied) AS BIGINT) AS applied, CAST(count(*) AS BIGINT) AS layers FROM (VALUES ('timeout', TRUE), ('memory', TRUE), ('network', FALSE)) AS t(layer, applied)",
    "z13_concept_graph": "SELECT c.concept, coalesce(c.week, 99) AS week, p.prereq FROM concepts c LEFT JOIN prereq p ON p.concept = c.concept",
    "t2_idempotent_submission": "SELECT source, lang, md5(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY source, lang, md5(text)",
    "l1_normal_equations": "SELECT round(sum(score * score), 4) AS xx, round(sum(score * weight), 4) AS xy, round(sum(weight * weight), 4) AS yy, CAST(count(*) AS BIGINT) AS n FROM item",
}
