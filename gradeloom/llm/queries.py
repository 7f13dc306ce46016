"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gradeloom.llm.decontaminate import op10_decontaminate
from gradeloom.llm.lines import op8_lines
from gradeloom.llm.lm import op6_lm
from gradeloom.llm.media import op1_media
from gradeloom.llm.mixing import op2_mix
from gradeloom.llm.pieces import op13_pieces
from gradeloom.llm.quality import op7_quality
from gradeloom.llm.sharding import op9_shard
from gradeloom.llm.simhash import op5_simhash
from gradeloom.llm.spelling import op12_spelling
from gradeloom.llm.tokenize import op3_tokens
from gradeloom.llm.warc import op4_warc
from gradeloom.llm.whitening import op11_whiten


def queries() -> dict:
    from corpus_pipeline import run

    own = [op1_media, op2_mix, op3_tokens, op4_warc, op5_simhash, op6_lm, op7_quality, op8_lines, op9_shard, op10_decontaminate, op11_whiten, op12_spelling, op13_pieces]
    return {f.__name__: f for f in own} | {"pipeline": run}


#: Windows of items and of documents as joined words, then hit words, their longest run, items by document, and runs of windows that go on in one item.
_OP10 = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0) AS s) AS t),
occ AS (SELECT DISTINCT x.doc_id, x.i, x.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) AS l) AS t) AS x JOIN win ON win.n = x.n AND win.g = x.g),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ),
runs AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM hit) AS t GROUP BY doc_id, island),
hits AS (SELECT doc_id, sum(k) AS n_hit, max(k) AS longest FROM runs GROUP BY doc_id),
src AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT r, item_id, n, j, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g FROM (SELECT r, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM (SELECT *, least(13, len(w)) AS n FROM src WHERE len(w) > 0) AS s) AS t),
pair AS (SELECT DISTINCT x.doc_id, x.i, x.n, iwin.r, iwin.item_id, iwin.j FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iwin) AS l) AS t) AS x JOIN iwin ON iwin.n = x.n AND iwin.g = x.g),
span AS (SELECT doc_id, item_id, min(i) - 1 AS first_at, min(j) - 1 AS item_at, count(*) + min(n) - 1 AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS island FROM pair) AS t GROUP BY doc_id, r, item_id, i - j, island),
verbatim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first_at, CAST(item_id AS VARCHAR), item_at) AS nth FROM span) AS t WHERE nth = 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match,
  CAST(coalesce(k, 0) AS BIGINT) AS longest_verbatim, CAST(verbatim.item_id AS VARCHAR) AS match_item, CAST(first_at AS BIGINT) AS match_start, CAST(item_at AS BIGINT) AS match_item_start
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN verbatim ON verbatim.doc_id = d.doc_id
"""

#: The checksum's table and the checksum of each run, counts, words with one code point cut out, near words, and the walk along forms.
_OP12 = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) AS s WHERE len(r) >= 6 GROUP BY ALL),
sums AS (SELECT r, k, xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) AS h FROM runs, tab),
words AS MATERIALIZED (SELECT w AS word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % len(r) AS BIGINT)) || substr(r, CAST(h % len(r) AS BIGINT) + 2) ELSE r END AS w FROM sums) AS s WHERE len(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words) AS s),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut AS a JOIN cut AS b ON a.v = b.v AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut AS a JOIN words AS b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM cut AS a JOIN words AS b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS f, max(near_n) AS f_n FROM near GROUP BY word),
found AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN f_n >= 5 * n THEN f END AS form, CASE WHEN f_n >= 5 * n THEN f_n END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
path AS (SELECT word, word AS at, form AS next FROM found UNION ALL SELECT path.word, found.word, found.form FROM path JOIN found ON found.word = path.next)
SELECT found.word, form, path.at AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM found JOIN path ON path.word = found.word AND path.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """Decontamination and spelling: hashes, learned models, file formats and hash orders of the others are beyond DuckDB's SQL."""
    return {"op10_decontaminate": _OP10, "op12_spelling": _OP12}
