"""Text of briefs and reports, authoring checks, code features and array predicates over the driver's tables.

An entry is one SQL text for both engines, or a pair (Spark, DuckDB) where their forms differ.
"""

from __future__ import annotations

from gradeloom.plans.domain import _RISK, _RISK_ROWS

from gradeloom.plans.domain import _winnow

# Line-scan needles by danger category.
_DANGER = """needles(category, needle) AS (SELECT * FROM (VALUES
  ('network', 'socket.socket'), ('network', 'urllib.request'), ('network', 'http.client'), ('network', 'requests.get'), ('network', 'ftplib'),
  ('process', 'subprocess.'), ('process', 'os.system'), ('process', 'os.popen'), ('process', 'os.fork'), ('process', 'multiprocessing.Process'),
  ('introspection', 'ctypes'), ('introspection', 'ptrace'), ('introspection', '/proc/'), ('introspection', 'sys._getframe'), ('introspection', 'gc.get_objects'),
  ('filesystem', 'shutil.rmtree'), ('filesystem', 'os.remove'), ('filesystem', 'os.unlink'), ('filesystem', 'open(''/etc'), ('filesystem', 'open("/etc'),
  ('dynamic', 'eval('), ('dynamic', 'exec('), ('dynamic', '__import__('), ('dynamic', 'compile(')) AS v(category, needle)),
code(path, line, src) AS (SELECT * FROM (VALUES ('a.py', 1, 'import os; os.system("ls")'), ('a.py', 2, 'x = eval(input())'), ('b.py', 1, 'print(1)'), ('b.py', 2, 'open("/etc/passwd")')) AS v(path, line, src))"""

_BRIEFS = """briefs(id, brief) AS (SELECT * FROM (VALUES
  (1, 'Implement a binary search over a sorted list. It runs in O(log n).'), (2, 'Sort the numbers with merge sort, recursively.'),
  (3, 'Count each word of a text in one pass; use a dictionary.'), (4, 'Return the depth of a nested list.'), (5, 'Fill a grid.'), (6, 'Say hello.')) AS v(id, brief))"""

#: Sentences of over eight characters; the two engines name groups and newlines differently.
_SENTENCES = (
    "sentences AS (SELECT conv_id, turn, s FROM (SELECT conv_id, turn, explode(split(regexp_replace(text, '([.!?])[ \\n]+', concat('$1', chr(10))), '\\n+')) AS s FROM conversations) AS t WHERE length(trim(s)) > 8)",
    "sentences AS (SELECT conv_id, turn, s FROM (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM conversations) AS t WHERE length(trim(s)) > 8)",
)
_LEXICON = """lexicon AS (SELECT * FROM (VALUES ('recursion', 'recursive'), ('recursion', 'depth'), ('loops', 'loop'), ('loops', 'time'), ('search', 'find'), ('search', 'that'), ('search', 'with'), ('tree', 'node'), ('tree', 'from')) AS v(concept, word)),
lexicon_size AS (SELECT concept, count(*) AS n FROM lexicon GROUP BY concept)"""

_DIST = tuple(
    f"""dist AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, greatest(0e0, 1e0 - {dot.format('a', 'b')} / sqrt({dot.format('a', 'a')} * {dot.format('b', 'b')})) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
core AS (SELECT a, d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM dist) AS t WHERE rn = 2)"""
    for dot in (
        "aggregate(zip_with({0}.embedding, {1}.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0e0, (s, v) -> s + v)",
        "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: z[1]::DOUBLE * z[2]))",
    )
)


def _pairs(heads: tuple[str, str], tail: str) -> tuple[str, str]:
    return tuple(f"WITH {h} {tail}" for h in heads)


_SCORES = """pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) * 1e0 / (max(x.n) + max(y.n) - count(*)) AS score FROM informative a JOIN informative b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY a.doc_id, b.doc_id),
ranked AS (SELECT a, score, row_number() OVER (PARTITION BY a ORDER BY score, b) - 1 AS i, count(*) OVER (PARTITION BY a) AS n FROM pairs),
screen AS (SELECT a, max(n) AS n, max(score) AS top, max(CASE WHEN i = floor(n / 2e0) THEN score END) AS median, max(CASE WHEN i = floor(n * 0.9e0) THEN score END) AS p90,
  CASE WHEN max(n) >= 4 AND stddev_samp(score) > 1e-6 THEN (max(score) - avg(score)) / stddev_samp(score) ELSE 0e0 END AS z FROM ranked GROUP BY a)"""


def _screen(tail: str) -> tuple[str, str]:
    return tuple(q + tail for q in _winnow(f", {_SCORES} "))


#: Item statistics: share of full marks, point-biserial with the total, correlation with the mastery of the tagged concept.
_ITEMS = """answers AS (SELECT i.item_key, i.assignment_id, i.score, CASE WHEN i.score >= 0.999e0 THEN 1e0 ELSE 0e0 END AS f, k.total, ms.m FROM item i JOIN mark k ON k.run_id = i.run_id
  JOIN (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'error'), (4, 'purchase')) AS t(concept, concept_key) ON t.concept = i.concept LEFT JOIN mastery ms ON ms.student_id = i.student_id AND ms.concept_key = t.concept_key),
items AS (SELECT item_key, assignment_id, count(*) AS n, avg(f) AS difficulty, CASE WHEN count(*) < 3 OR min(f) = max(f) OR min(total) = max(total) THEN 0e0 ELSE covar_samp(f, total) / nullif(stddev_samp(f) * stddev_samp(total), 0e0) * sqrt((count(*) - 1e0) / count(*)) END AS discrimination,
  CASE WHEN count(m) < 3 OR min(m) = max(m) OR min(CASE WHEN m IS NOT NULL THEN score END) = max(CASE WHEN m IS NOT NULL THEN score END) THEN 0e0 ELSE covar_samp(CASE WHEN m IS NOT NULL THEN score END, m) / nullif(stddev_samp(CASE WHEN m IS NOT NULL THEN score END) * stddev_samp(m), 0e0) END AS alignment FROM answers GROUP BY item_key, assignment_id)"""
#: Thresholds and names of the flags, the gravest first.
_ITEM_FLAG = "CASE WHEN n < 5 THEN 'insufficient_data' WHEN discrimination < -0.15e0 THEN 'anticorrelated' WHEN difficulty > 0.95e0 THEN 'too_easy' WHEN difficulty < 0.2e0 THEN 'too_hard' WHEN abs(discrimination) < 0.15e0 THEN 'non_discriminating' WHEN alignment < 0.2e0 THEN 'misaligned_concepts' ELSE 'ok' END"

SQL: dict[str, str | tuple[str, str]] = {
    # text of sources, briefs and reports
    "f1_normalise_source": "WITH lf AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents), ends AS (SELECT doc_id, @RALL(t, '[ ]+' || chr(10), chr(10)) AS t FROM lf) SELECT doc_id, md5(@RALL(t, '[ ' || chr(10) || ']+$', '') || chr(10)) AS h FROM ends",
    "f5_sentences": _pairs(_SENTENCES, "SELECT conv_id, turn, count(*) AS n, max(trim(s)) AS last_ FROM sentences GROUP BY conv_id, turn"),
    "f6_content_words": "SELECT conv_id, turn, count(DISTINCT w) AS n FROM (SELECT conv_id, turn, @EACH(@EXTALL(lower(text), '[a-z]{3,}')) AS w FROM conversations) AS t WHERE w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was') GROUP BY conv_id, turn",
    "f14_danger_scan": f"WITH {_DANGER} SELECT path, line, category, needle FROM code JOIN needles ON contains(src, needle)",
    "f20_last_line": "WITH e(id, err) AS (SELECT * FROM (VALUES (1, 'Traceback' || chr(10) || 'MemoryError' || chr(10) || chr(10)), (2, 'fine'), (3, 'x' || chr(10) || 'Cannot allocate memory  ')) AS v(id, err)) SELECT id, contains(lower(err), 'memoryerror') OR contains(lower(err), 'cannot allocate memory') AS oom, regexp_extract(@RALL(err, '[ ' || chr(10) || ']+$', ''), '[^' || chr(10) || ']*$', 0) AS last_ FROM e",
    "f22_expected_algorithm": f"WITH {_BRIEFS} SELECT id, CASE WHEN contains(lower(brief), 'binary search') THEN 'binary_search' WHEN contains(lower(brief), 'divide and conquer sort') THEN 'divide_and_conquer_sort' WHEN contains(lower(brief), 'quadratic sort') THEN 'quadratic_sort' WHEN contains(lower(brief), 'linear scan') THEN 'linear_scan' WHEN contains(lower(brief), 'hash lookup') THEN 'hash_lookup' WHEN contains(lower(brief), 'dynamic programming') THEN 'dynamic_programming' WHEN contains(lower(brief), 'recursive traversal') THEN 'recursive_traversal' WHEN contains(lower(brief), 'merge sort') OR contains(lower(brief), 'divide') THEN 'divide_and_conquer_sort' END AS algorithm FROM briefs",
    "f23_input_shape": f"WITH {_BRIEFS} SELECT id, CASE WHEN lower(brief) @RLIKE '.*(nested|tree|depth|hierarch).*' THEN 'nested_list' WHEN lower(brief) @RLIKE '.*(sorted list|sorted array|search for|target).*' THEN 'sorted_int_list' WHEN lower(brief) @RLIKE '.*(string|text|word|sentence|character).*' THEN 'string' WHEN lower(brief) @RLIKE '.*(matrix|grid|2d).*' THEN 'matrix' WHEN lower(brief) @RLIKE '.*(list|array|sequence|numbers|elements|items).*' THEN 'int_list' WHEN lower(brief) @RLIKE '.*(number|integer|value|count).*' THEN 'int' ELSE 'int_list' END AS kind FROM briefs",
    "f25_complexity_depth": f"WITH {_BRIEFS}, o AS (SELECT id, lower(regexp_extract(brief, 'O *[(]([^)]+)[)]', 1)) AS o FROM briefs), c AS (SELECT id, replace(replace(o, ' ', ''), '**', '^') AS raw FROM o) SELECT id, CASE WHEN raw = '1' THEN 0 WHEN raw IN ('logn', 'n', 'nlogn') THEN 1 WHEN raw IN ('n^2', 'n2') THEN 2 WHEN raw = 'n^3' THEN 3 END AS depth FROM c",
    "f24_signature_arity": "SELECT s, CASE WHEN args = '' THEN 0 ELSE length(args) - length(replace(args, ',', '')) + 1 END AS arity FROM (SELECT s, trim(regexp_extract(s, 'solve *[(]([a-z_, ]*)[)]', 1)) AS args FROM (VALUES ('Write solve(a, b).'), ('solve() takes nothing'), ('solve (items)')) AS v(s)) AS t",
    "f17_entry_point": "SELECT declared, coalesce(nullif(declared, ''), CASE WHEN has_main THEN 'main.py' END, largest) AS entry_point FROM (VALUES ('solve.py', TRUE, 'a.py'), ('', TRUE, 'a.py'), ('', FALSE, 'a.py')) AS v(declared, has_main, largest)",
    "f21_csv_quote": "SELECT c_custkey, concat_ws(',', '\"' || replace(c_name, '\"', '\"\"') || '\"', '\"' || replace(c_mktsegment, '\"', '\"\"') || '\"') AS line FROM customer",
    "u5_word_overlap": f"WITH {_LEXICON}, w AS (SELECT DISTINCT conv_id, turn, word FROM (SELECT conv_id, turn, @EACH(@EXTALL(lower(text), '[a-z]{{4,}}')) AS word FROM conversations) AS t) SELECT conv_id, turn, l.concept, round(count(*) * 1e0 / max(z.n), 6) AS overlap FROM w JOIN lexicon l ON l.word = w.word JOIN lexicon_size z ON z.concept = l.concept GROUP BY conv_id, turn, l.concept",
    "b2_propose_concepts": f"WITH {_LEXICON}, w AS (SELECT DISTINCT conv_id, turn, word FROM (SELECT conv_id, turn, @EACH(@EXTALL(lower(text), '[a-z]{{4,}}')) AS word FROM conversations) AS t), o AS (SELECT conv_id, turn, l.concept, count(*) * 1e0 / max(z.n) AS overlap FROM w JOIN lexicon l ON l.word = w.word JOIN lexicon_size z ON z.concept = l.concept GROUP BY conv_id, turn, l.concept) SELECT conv_id, turn, concept, rank_ FROM (SELECT o.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, concept DESC) AS rank_ FROM o) AS t WHERE rank_ <= 2",
    "e9_rubric_coverage": _pairs(
        tuple(f"{s}, {_LEXICON}" for s in _SENTENCES),
        ", sw AS (SELECT DISTINCT conv_id, turn, s, w FROM (SELECT conv_id, turn, s, @EACH(@EXTALL(lower(s), '[a-z]{3,}')) AS w FROM sentences) AS t), hit AS (SELECT conv_id, turn, s, l.concept, l.word FROM sw JOIN lexicon l ON l.word = sw.w), best AS (SELECT conv_id, turn, concept, max(n) AS n FROM (SELECT conv_id, turn, s, concept, count(*) AS n FROM hit GROUP BY conv_id, turn, s, concept) AS t GROUP BY conv_id, turn, concept), doc AS (SELECT conv_id, turn, concept, count(DISTINCT word) AS n FROM hit GROUP BY conv_id, turn, concept) SELECT b.conv_id, b.turn, b.concept, round(greatest(b.n * 1e0, 0.85e0 * d.n) / z.n, 6) AS score, greatest(b.n * 1e0, 0.85e0 * d.n) / z.n >= 0.4e0 AS covered FROM best b JOIN doc d ON d.conv_id = b.conv_id AND d.turn = b.turn AND d.concept = b.concept JOIN lexicon_size z ON z.concept = b.concept",
    ),
    # authoring
    "b3_draft_validation": "WITH draft(item, body, weight, concept, source) AS (SELECT * FROM (VALUES ('rb_01', 'a', 4e0, 'view', 'test'), ('rb_01', 'b', 4e0, 'click', 'test'), ('rb_02', ' ', 1e0, 'view', 'static'), ('rb_03', 'c', 0e0, 'view', 'test'), ('rb_04', 'd', 2e0, 'nowhere', 'guess'), ('rb_05', 'e', 2e0, 'click', 'report')) AS v(item, body, weight, concept, source)) SELECT item, body, count(*) OVER (PARTITION BY item) > 1 AS repeated, trim(body) = '' AS empty_, weight <= 0e0 AS weightless, c.concept IS NULL AS unknown_tag, source NOT IN ('test', 'static', 'structural', 'report', 'manual') AS unknown_check FROM draft LEFT JOIN concepts c ON c.concept = draft.concept",
    "b4_reference_validation": "SELECT assignment_id, count(*) AS tests, CAST(count_if(total < 0.5e0) AS BIGINT) AS discarded, count_if(total < 0.5e0) * 1e0 / count(*) > 0.2e0 AS halted FROM verdict GROUP BY assignment_id",
    "b6_latest_version": "SELECT user_id, event_type, event_id AS version_id, n AS version FROM (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) AS t WHERE rn = 1",
    "b7_uncheckable_items": "SELECT student_id, concept_key FROM (SELECT DISTINCT student_id, concept_key FROM obs) AS o WHERE NOT EXISTS (SELECT 1 FROM obs c WHERE c.student_id = o.student_id AND c.concept_key = o.concept_key AND c.source IN ('test', 'structural', 'report'))",
    # code features given as rows
    "a29_shape_over_functions": "SELECT id, max(loops) AS loop_depth, sum(branches) AS branches, max(CASE WHEN rec THEN 1 ELSE 0 END) = 1 AS recursive FROM (VALUES (1, 2, 3, FALSE), (1, 1, 1, TRUE), (2, 0, 0, FALSE)) AS v(id, loops, branches, rec) GROUP BY id",
    "e4_structural_credit": "SELECT id, CASE WHEN matched THEN 0.85e0 WHEN similarity IS NOT NULL THEN least(0.7e0, similarity * 1.1e0) WHEN top IS NOT NULL THEN least(0.8e0, 0.45e0 + 0.45e0 * top) WHEN parsed THEN 0.4e0 ELSE 0.15e0 END AS fraction FROM (VALUES (1, TRUE, 0.2e0, 0.9e0, TRUE), (2, FALSE, 0.5e0, NULL, TRUE), (3, FALSE, NULL, 0.7e0, TRUE), (4, FALSE, NULL, NULL, TRUE), (5, FALSE, NULL, NULL, FALSE)) AS v(id, matched, similarity, top, parsed)",
    "e13_outcome": "SELECT run_id, item_key, CASE WHEN abs(score - 1e0) < 1e-9 THEN CASE WHEN flag = 'R' THEN 'passed_repaired' ELSE 'passed' END WHEN score > 0e0 THEN 'failed' ELSE 'error' END AS outcome FROM item",
    "e7_code_facts": "SELECT id, kind, val FROM (SELECT id, 'loop_depth' AS kind, CAST(loops AS VARCHAR(9)) AS val FROM (VALUES (1, 2, TRUE), (2, 0, FALSE)) AS a(id, loops, rec) UNION ALL SELECT id, 'recursion' AS kind, CASE WHEN rec THEN 'yes' ELSE 'no' END AS val FROM (VALUES (1, 2, TRUE), (2, 0, FALSE)) AS b(id, loops, rec)) AS t",
    # similarity
    "w14_grams": _winnow("SELECT doc_id, count(*) AS grams FROM kept GROUP BY doc_id"),
    "w13_windows": _winnow("SELECT doc_id, count(DISTINCT h) AS selected FROM least4 WHERE tail IS NOT NULL GROUP BY doc_id"),
    "j18_one_vs_corpus": _screen("SELECT a, b, round(score, 6) AS score FROM pairs"),
    "a32_corpus_scores": _screen("SELECT a, n, round(top, 6) AS top, round(median, 6) AS median, round(p90, 6) AS p90, round(z, 5) AS z FROM screen"),
    "i4_outlier_screen": _screen("SELECT a, top >= 0.55e0 AND (z >= 2.5e0 OR n < 4) AS outlier, round(CASE WHEN top >= 0.55e0 AND (z >= 2.5e0 OR n < 4) THEN top ELSE least(top, 0.5e0) END, 6) AS flag_score FROM screen"),
    "j17_distances": _pairs(_DIST, "SELECT a, b, round(d, 5) AS d FROM dist"),
    "w12_core_distance": _pairs(_DIST, "SELECT a, round(d, 5) AS core FROM core"),
    "c1_mutual_reachability": _pairs(_DIST, "SELECT dist.a, dist.b, round(greatest(x.d, y.d, dist.d), 5) AS reach FROM dist JOIN core x ON x.a = dist.a JOIN core y ON y.a = dist.b"),
    "u1_jaccard": "WITH s AS (SELECT student_id, @LIST(concept_key) AS a FROM (SELECT DISTINCT student_id, concept_key FROM obs WHERE score < 0.5e0) AS x GROUP BY student_id), t AS (SELECT student_id, @LIST(concept_key) AS b FROM (SELECT DISTINCT student_id, concept_key FROM obs WHERE score >= 0.5e0) AS y GROUP BY student_id) SELECT s.student_id, round(@SIZE(@INTER(a, b)) * 1e0 / @SIZE(@UNITE(a, b)), 6) AS jaccard, round(@SIZE(@INTER(a, b)) * 1e0 / @SIZE(a), 6) AS containment FROM s JOIN t ON t.student_id = s.student_id",
    "u4_completeness": "SELECT student_id, concept_key, round(count(DISTINCT CASE WHEN k IN ('test', 'static', 'report') THEN k END) / 3e0, 6) AS completeness FROM (SELECT student_id, concept_key, CASE source WHEN 'repair' THEN 'test' ELSE source END AS k FROM obs) AS t GROUP BY student_id, concept_key",
    "ma8_combined_similarity": "SELECT run_id, item_key, round(score + (1e0 - score) * score * l, 6) AS combined FROM (SELECT run_id, item_key, score, weight / 50e0 AS l FROM item) AS t",
    # arrays, maps and JSON
    "ma10_seed": ("SELECT o_orderkey, conv(substr(sha2(concat(CAST(o_orderkey AS STRING), '::', o_orderpriority), 256), 1, 16), 16, 10) AS seed FROM orders", "SELECT o_orderkey, CAST(CAST('0x' || substr(sha256(concat(CAST(o_orderkey AS VARCHAR), '::', o_orderpriority)), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM orders"),
    "aj3_first_match": "SELECT student_id, round(min_by(score, obs_id) FILTER (WHERE source = 'test'), 6) AS test_score FROM obs GROUP BY student_id",
    "aj5_canonical_json": ("SELECT event_id, to_json(from_json(props, 'k INT')) AS j FROM events", "SELECT event_id, CAST(json(props) AS VARCHAR) AS j FROM events"),
    "aj6_predicates": ("SELECT vec_id, array_sort(embedding) = embedding AS ascending, size(array_distinct(embedding)) = size(embedding) AS no_duplicates, forall(embedding, x -> x >= -1) AS in_range FROM embeddings", "SELECT vec_id, list_sort(embedding) = embedding AS ascending, len(list_distinct(embedding)) = len(embedding) AS no_duplicates, list_min(embedding) >= -1 AS in_range FROM embeddings"),
    "aj7_nesting_depth": (
        "SELECT j, CAST(array_max(transform(sequence(1, length(j)), i -> length(regexp_replace(substr(j, 1, i), '[^\\\\[]', '')) - length(regexp_replace(substr(j, 1, i), '[^\\\\]]', '')))) AS BIGINT) AS depth FROM (VALUES ('[]'), ('[1,[2,[3]],4]'), ('7')) AS v(j)",
        "SELECT j, CAST(list_max(list_transform(range(1, length(j) + 1), lambda i: length(regexp_replace(j[1:i], '[^\\[]', '', 'g')) - length(regexp_replace(j[1:i], '[^\\]]', '', 'g')))) AS BIGINT) AS depth FROM (VALUES ('[]'), ('[1,[2,[3]],4]'), ('7')) AS v(j)",
    ),
    "aj8_search_index": ("SELECT vec_id, CAST(array_position(embedding, array_max(embedding)) - 1 AS BIGINT) AS at FROM embeddings", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at FROM embeddings"),
    "aj9_feature_vector": "SELECT student_id, feature, max(w) AS w FROM (SELECT student_id, 'fail:' || source AS feature, 1e0 AS w FROM obs WHERE score < 0.5e0 UNION ALL SELECT student_id, 'concept:' || concept_key AS feature, 0.6e0 AS w FROM obs WHERE score < 0.5e0) AS t GROUP BY student_id, feature",
    "aj10_merge": "SELECT coalesce(l.k, p.k) AS k, coalesce(l.w, p.w) AS w FROM (VALUES ('bias', 0.1e0), ('agreement', 0.4e0)) AS p(k, w) FULL OUTER JOIN (VALUES ('agreement', 0.5e0), ('late', 0.2e0)) AS l(k, w) ON l.k = p.k",
    "aj11_tail": ("SELECT vec_id, array_max(slice(embedding, -20, 20)) AS tail_max, array_max(slice(embedding, 1, 6)) AS head_max FROM embeddings", "SELECT vec_id, list_max(embedding[-20:]) AS tail_max, list_max(embedding[1:6]) AS head_max FROM embeddings"),
    "snk12_json_documents": ("SELECT to_json(named_struct('id', c_custkey, 'segment', c_mktsegment)) AS doc FROM customer", "SELECT CAST(json_object('id', c_custkey, 'segment', c_mktsegment) AS VARCHAR) AS doc FROM customer"),
    "c6_failure_signatures": "SELECT student_id, assignment_id, @JOINED(@DISTINCT(@LIST(source))) AS failed, @JOINED(@DISTINCT(@LIST(concept_key))) AS concepts, count(*) AS n FROM obs WHERE score < 0.5e0 GROUP BY student_id, assignment_id",
    # cohorts
    "a18_item_analysis": f"WITH {_ITEMS} SELECT item_key, assignment_id, n, round(difficulty, 6) AS difficulty, round(discrimination, 5) AS discrimination, round(alignment, 5) AS alignment, {_ITEM_FLAG} AS flag FROM items",
    "pf10_item_flag": f"WITH {_ITEMS} SELECT item_key, assignment_id, {_ITEM_FLAG} AS flag FROM items",
    "j16_auc": "WITH r AS (SELECT state = 'released' AS y, total, rank() OVER (ORDER BY total) AS lo, count(*) OVER (PARTITION BY total) AS ties FROM verdict) SELECT round((sum(CASE WHEN y THEN lo + (ties - 1) / 2e0 END) - count_if(y) * (count_if(y) + 1e0) / 2e0) / (count_if(y) * 1e0 * count_if(NOT y)), 6) AS auc FROM r",
    "j21_trailing_hour": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "w15_gap_merge": "WITH g AS (SELECT user_id, event_id, @SEC(ts) AS s, CASE WHEN @SEC(ts) - lag(@SEC(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200 THEN 0 ELSE 1 END AS new_ FROM events), i AS (SELECT user_id, s, sum(new_) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS start_, max(s) AS end_, count(*) AS n FROM i GROUP BY user_id, island",
    "o12_risk_factors": "WITH f AS (SELECT student_id, 'low_mastery' AS factor, (1e0 - @EVEN(m)) * 0.30e0 AS c FROM mastery GROUP BY student_id UNION ALL SELECT student_id, 'uncertain' AS factor, @EVEN(u) * 0.10e0 AS c FROM mastery GROUP BY student_id UNION ALL SELECT student_id, 'weak_concepts' AS factor, count_if(m < 0.4e0) * 0.05e0 AS c FROM mastery GROUP BY student_id) SELECT student_id, factor, round(c, 6) AS c, rank_ FROM (SELECT f.*, row_number() OVER (PARTITION BY student_id ORDER BY round(c, 9) DESC, factor) AS rank_ FROM f WHERE c > 0.005e0) AS t WHERE rank_ <= 3",
    "l3_contributions": "SELECT run_id, feature, round(w * v, 6) AS c, row_number() OVER (PARTITION BY run_id ORDER BY abs(round(w * v, 9)) DESC, feature) AS rank_ FROM (SELECT r.run_id, f.feature, f.w, CASE f.feature WHEN 'bias' THEN 1e0 WHEN 'total' THEN r.total ELSE least(1e0, r.price / 654321e0) END AS v FROM verdict r CROSS JOIN (VALUES ('bias', 0.1e0), ('total', 0.42e0), ('price', -0.2e0)) AS f(feature, w)) AS t",
    "o13_ranked_contributions": "SELECT feature, c FROM (SELECT feature, c, row_number() OVER (ORDER BY abs(c) DESC, feature) AS rn FROM (VALUES ('a', 0.2e0), ('b', -0.4e0), ('c', 0.1e0), ('d', 0.4e0)) AS v(feature, c)) AS t WHERE rn <= 3",
    "o15_queue_order": "SELECT event_id, user_id, slot FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS slot FROM events) AS t WHERE slot <= 2",
    "g3_actions": "SELECT c.concept, CASE WHEN r.kind IN ('practice', 'problem_set', 'exercise') THEN 'Work through: ' || r.title WHEN r.kind IS NOT NULL THEN 'Review: ' || r.title ELSE 'No practice resource is attached to ' || c.concept END AS action FROM concepts c LEFT JOIN (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY concept ORDER BY CASE WHEN kind IN ('practice', 'problem_set', 'exercise') THEN 0 ELSE 1 END, pos) AS rn FROM (VALUES ('view', 'reading', 'Notes', 0), ('view', 'practice', 'Set 1', 1), ('click', 'reading', 'Slides', 0)) AS v(concept, kind, title, pos)) AS t WHERE rn = 1) AS r ON r.concept = c.concept",
    "i5_cohort_corpus": "SELECT run_id, student_id, assignment_id FROM (SELECT v.*, row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY started_at DESC, run_id DESC) AS rn FROM verdict v) AS t WHERE rn = 1",
    "r2_course_risk": f"WITH {_RISK}, a AS ({_RISK_ROWS}) SELECT c.c_custkey AS student_id, round(coalesce(a.risk, 1e0 / (1e0 + exp(-6e0 * (0.75e0 * 0.30e0 - 0.32e0)))), 6) AS risk, coalesce(a.flagged, FALSE) AS flagged, coalesce(a.route, 'advising') AS route, coalesce(a.factors, 'Low mastery across the course') AS factors FROM customer c LEFT JOIN a ON a.student_id = c.c_custkey",
    "z2_student_dashboard": "WITH w AS (SELECT student_id, concept_key, m, u, row_number() OVER (PARTITION BY student_id ORDER BY round(m, 9), concept_key) AS rn FROM mastery) SELECT student_id, round(avg(m), 6) AS mean, CAST(count_if(m >= 0.7e0) AS BIGINT) AS mastered, max(CASE WHEN rn = 1 THEN concept_key END) AS weakest FROM w GROUP BY student_id",
    "z6_cluster_briefing": "SELECT label, vec_id, rn FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) AS t WHERE rn <= 3",
    "z8_integrity_review": "SELECT r.run_id, s.name, s.region, r.assignment_id FROM run r JOIN student s ON s.student_id = r.student_id WHERE r.state = 'overridden'",
    "d4_weeks_since": "SELECT concept, 8 - week AS weeks FROM concepts WHERE week IS NOT NULL",
    "d5_term_calendar": ("SELECT concept, date_format(date_add(DATE '2026-01-05', 7 * week), 'yyyy-MM-dd') AS taught FROM concepts", "SELECT concept, strftime(DATE '2026-01-05' + CAST(7 * week AS INTEGER), '%Y-%m-%d') AS taught FROM concepts"),
}
