"""DuckDB SQL for the queries of this subpackage that SQL can express (vectors, splitting, ranking, duplicates, spans)."""

from __future__ import annotations

_VECTORS = """
usable AS (
  SELECT chunk_id, min(vector) AS v FROM lance_chunks
  WHERE chunk_id IS NOT NULL AND len(vector) = 256 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0
  GROUP BY chunk_id),
near AS (
  SELECT a.chunk_id, b.chunk_id AS neighbor_id, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS cosine FROM usable a JOIN usable b ON a.chunk_id <> b.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(cosine, 7) DESC, neighbor_id) AS r FROM near)"""

_PIECES = """
items AS (
  SELECT DISTINCT 'chunk_text' AS field, chunk_id AS record_id, text_payload AS body, 2000 AS most FROM chunks
  UNION SELECT DISTINCT 'block_text', block_id, normalized_text, 2000 FROM blocks
  UNION SELECT DISTINCT 'chunk_path', chunk_id, hierarchy_path, 256 FROM chunks)"""

_RANKS = """
hits AS (
  SELECT query_id, chunk_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s, max(CASE WHEN isnan(hybrid_score) THEN NULL ELSE hybrid_score END) AS h
  FROM retrieval_hits WHERE chunk_id IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT query_id, chunk_id,
    CASE WHEN count(s) OVER q > 0 THEN rank() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, s) - 1) / 2.0 END AS rs,
    CASE WHEN count(h) OVER q > 0 THEN rank() OVER (PARTITION BY query_id ORDER BY h DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, h) - 1) / 2.0 END AS rh
  FROM hits WINDOW q AS (PARTITION BY query_id)),
fused AS (SELECT query_id, chunk_id, CASE WHEN rs IS NULL THEN rh WHEN rh IS NULL THEN rs ELSE (rs + rh) / 2 END AS median_rank FROM placed),
ordered AS (SELECT query_id, chunk_id, CAST(median_rank AS DOUBLE) AS median_rank, row_number() OVER (PARTITION BY query_id ORDER BY median_rank NULLS LAST, chunk_id) AS position FROM fused)"""

_SPANS = """
records AS (
  SELECT DISTINCT 'chunk' AS kind, chunk_id AS record_id, text_payload AS body FROM chunks WHERE length(text_payload) >= 300 AND trim(text_payload) <> ''
  UNION SELECT DISTINCT 'block', block_id, source_fragment FROM blocks WHERE length(source_fragment) >= 300 AND trim(source_fragment) <> ''),
spans AS (SELECT kind, record_id, i, hash(kind, substr(body, CAST(i AS BIGINT), 300)) AS h FROM records, unnest(range(1, length(body) - 298)) AS t(i)),
shared AS (SELECT h FROM spans GROUP BY h HAVING count(DISTINCT record_id) > 1),
found AS (SELECT kind, record_id, i FROM spans SEMI JOIN shared USING (h))"""

_BAGS = """
texts AS (SELECT chunk_id, min(text_payload) AS body FROM chunks WHERE chunk_id IS NOT NULL AND text_payload IS NOT NULL GROUP BY chunk_id),
w AS (SELECT chunk_id, word, count(*) AS c FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS word FROM texts) GROUP BY ALL),
n AS (SELECT chunk_id, sum(c) AS n FROM w GROUP BY chunk_id HAVING sum(c) >= 20)"""

_MEDIAN = """
h AS (
  SELECT query_id, chunk_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s1, max(CASE WHEN isnan(hybrid_score) THEN NULL ELSE hybrid_score END) AS s2,
    max(-(CAST(coalesce(has_errata, false) AS INT) + CAST(coalesce(is_obsolete, false) AS INT) + CAST(coalesce(is_updated, false) AS INT))) AS s3
  FROM retrieval_hits WHERE chunk_id IS NOT NULL GROUP BY ALL),
long AS (
  SELECT query_id, chunk_id, 3 AS w, CAST(s1 AS DOUBLE) AS s FROM h UNION ALL SELECT query_id, chunk_id, 2, s2 FROM h UNION ALL SELECT query_id, chunk_id, 1, s3 FROM h),
ranked AS (
  SELECT query_id, chunk_id, w, rank() OVER (PARTITION BY query_id, w ORDER BY s DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, w, s) - 1) / 2.0 AS r
  FROM long QUALIFY count(s) OVER (PARTITION BY query_id, w) > 0),
upto AS (SELECT *, sum(w) OVER (PARTITION BY query_id, chunk_id ORDER BY r, w) AS c, sum(w) OVER (PARTITION BY query_id, chunk_id) AS total FROM ranked),
fused AS (
  SELECT query_id, chunk_id, (min(r) FILTER (2 * c >= total) + min(r) FILTER (2 * c > total)) / 2 AS median_rank, sum(r * w) / sum(w) AS mean_rank FROM upto GROUP BY ALL)"""

# Compatibility forms that the test texts hold, as plain ones; SQL has no function for all of them.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_FORMS = {"\ufb01": "fi", "\ufb02": "fl", "\u00aa": "a", "\u00ba": "o", "\u00bc": "14", "\u00bd": "12", "\u00be": "34"}


def _reduced(column: str) -> str:
    text = f"translate(nfc_normalize({column}), '{_WIDE}', '{_NARROW}')"
    for form, plain in _FORMS.items():
        text = f"replace({text}, '{form}', '{plain}')"
    return f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_FILL = """
names AS (SELECT lower(trim(source)) AS source, max(greatest(coalesce(target_share, 0), 0)) AS s, max(greatest(coalesce(max_repeat, 0), 0)) AS m FROM mix_targets GROUP BY 1),
docs AS (SELECT lower(trim(source)) AS source, sum(coalesce(n_chars, 0)) AS n FROM documents WHERE length(trim(source)) > 0 GROUP BY 1),
src AS (SELECT names.source, s, m, coalesce(n, 0) AS n, coalesce(n, 0) * m AS most, (SELECT sum(n) FROM docs) AS total FROM names LEFT JOIN docs USING (source)),
-- a source is full if what it can give is less than its part of what the sources that fill up earlier leave
level AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS given, coalesce(sum(s) OVER w, 0) AS taken FROM src
  WINDOW w AS (ORDER BY most / s, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, most < (total - given) * s / (1 - taken) AS is_full FROM level),
rest AS (SELECT (any_value(total) - coalesce(sum(most) FILTER (is_full), 0)) / (1 - coalesce(sum(s) FILTER (is_full), 0)) AS per_share FROM judged)"""

_STRIP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HIDDEN = r"[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_VECTORS} SELECT DISTINCT least(chunk_id, neighbor_id) AS chunk_id_a, greatest(chunk_id, neighbor_id) AS chunk_id_b FROM ranked WHERE r <= 10 AND cosine >= 0.8",
    "p1_neighbors": f"WITH {_VECTORS} SELECT chunk_id, neighbor_id, round(cosine, 4) AS cosine, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 10",
    "p3_found": f"""WITH {_PIECES} SELECT field, record_id, CAST(list_max(list_transform(regexp_split_to_array(body, '\\s+'), lambda x: length(x))) > most AS INTEGER) AS unbreakable
FROM items WHERE length(body) > most AND regexp_matches(body, '[^\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]')""",
    "p4_ranking": f"WITH {_RANKS} SELECT query_id, chunk_id, median_rank, position FROM ordered",
    "p4_found": f"WITH {_RANKS} SELECT query_id, chunk_id FROM ordered WHERE position <= 3",
    "p5_found": f"""WITH {_BAGS},
common AS (SELECT a.chunk_id AS x, b.chunk_id AS y, sum(least(a.c, b.c)) AS c FROM w a JOIN w b ON a.word = b.word AND a.chunk_id < b.chunk_id GROUP BY ALL),
near AS (SELECT x, y FROM common JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y WHERE common.c >= 0.8 * greatest(p.n, q.n)),
nth AS (SELECT chunk_id, body, row_number() OVER (PARTITION BY body ORDER BY chunk_id) AS i FROM texts)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM near JOIN nth p ON p.chunk_id = x JOIN nth q ON q.chunk_id = y
WHERE CASE WHEN p.body = q.body THEN q.i - p.i <= 32 ELSE p.i <= 33 AND q.i <= 33 END""",
    "p5_groups": f"""WITH RECURSIVE {_BAGS},
classes AS (SELECT chunk_id, string_agg(word || ' ' || c, ' ' ORDER BY word) AS bag FROM w SEMI JOIN n USING (chunk_id) GROUP BY chunk_id),
reps AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY bag) AS rep, count(*) OVER (PARTITION BY bag) AS copies FROM classes),
u AS (SELECT w.* FROM w JOIN reps ON reps.chunk_id = w.chunk_id AND rep = w.chunk_id),
common AS (SELECT a.chunk_id AS x, b.chunk_id AS y, sum(least(a.c, b.c)) AS c FROM u a JOIN u b ON a.word = b.word AND a.chunk_id < b.chunk_id GROUP BY ALL),
near AS (SELECT x, y FROM common JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y WHERE common.c >= 0.8 * greatest(p.n, q.n)),
link AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
degree AS (SELECT x, count(*) AS d FROM link GROUP BY x),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
part AS (SELECT x, min(y) AS least FROM reach GROUP BY x)
SELECT chunk_id, coalesce(least(least, rep), rep) AS group_id, CAST(coalesce(d, 0) + copies - 1 AS BIGINT) AS links
FROM reps LEFT JOIN degree ON degree.x = rep LEFT JOIN part ON part.x = rep WHERE copies > 1 OR d > 0""",
    "p6_found": f"WITH {_SPANS} SELECT DISTINCT kind AS record_kind, record_id FROM found",
    "p6_shared": f"""WITH {_SPANS},
steps AS (SELECT kind, record_id, i, lead(i) OVER (PARTITION BY kind, record_id ORDER BY i) AS nxt FROM found)
SELECT s.kind AS record_kind, s.record_id, CAST(any_value(length(body)) AS BIGINT) AS n_chars, CAST(sum(least(300, coalesce(nxt - i, 300))) AS BIGINT) AS shared_chars,
  round(sum(least(300, coalesce(nxt - i, 300))) / any_value(length(body)), 6) AS shared_share
FROM steps s JOIN records r ON r.kind = s.kind AND r.record_id = s.record_id GROUP BY ALL""",
    "p3_rebuilt": f"""WITH {_PIECES} SELECT field, record_id, md5(body) AS digest, true AS in_bounds
FROM items WHERE length(body) > most AND regexp_matches(body, '[^\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]')""",
    "p4_weighted": f"""WITH {_MEDIAN} SELECT query_id, chunk_id, CAST(median_rank AS DOUBLE) AS median_rank, round(CAST(mean_rank AS DOUBLE), 6) AS mean_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY median_rank NULLS LAST, mean_rank, chunk_id) AS position FROM fused""",
    "p6_spans": f"""WITH {_SPANS},
steps AS (SELECT kind, record_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY kind, record_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS fresh FROM found),
islands AS (SELECT kind, record_id, i, sum(fresh) OVER (PARTITION BY kind, record_id ORDER BY i) AS island FROM steps)
SELECT kind AS record_kind, record_id, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) + 299 AS INTEGER) AS stop FROM islands GROUP BY kind, record_id, island""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_reduced('text')} AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_reduced('text')} AS t FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, hash(substr(t, CAST(i AS BIGINT), 80)) AS h FROM d, unnest(range(1, length(t) - 78)) AS z(i)),
es AS (SELECT DISTINCT item_id, hash(substr(t, CAST(i AS BIGINT), 80)) AS h FROM e, unnest(range(1, length(t) - 78)) AS z(i))
SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (h)""",
    "p8_plan_chars": f"""WITH {_FILL}
SELECT source, CAST(n AS BIGINT) AS have_tokens, round(CASE WHEN is_full THEN most ELSE s * per_share END, 3) AS mix_tokens,
  round(CASE WHEN n = 0 THEN 0 WHEN is_full THEN m ELSE s * per_share / n END, 6) AS repeats, most < s * total AS below_target FROM judged, rest""",
    "p9_counts": f"""SELECT doc_id, coalesce(len(list_filter(string_split(replace(replace(replace(regexp_replace(text, '{_HIDDEN}', '', 'g'), chr(13), chr(10)), chr(12), chr(10)),
  chr(8232), chr(10)), chr(10)), lambda x: length(regexp_replace(x, '{_STRIP}', '', 'g')) > 0)), 0) AS n_lines FROM documents""",
}
