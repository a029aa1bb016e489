"""The results of some corpus queries in SQL, by plain joins over whole tables.

Documents are told apart by doc_id here, as in the tables these are held against.
"""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{SPACE}'), lambda x: x <> '')"


def _window(word: str, size: int) -> str:
    """The run of words from a place on; null where the document ends first."""
    return " || ' ' || ".join([word, *(f"lead({word}, {k}) OVER o" for k in range(1, size))])


def _placed(text: str = "text") -> str:
    """docs: doc_id, ws, n; w: doc_id, i, word."""
    return f"""docs AS (SELECT doc_id, {_words(text)} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM docs)"""


def _covered(size: int) -> str:
    return f"max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


QUALITY_RULES = f"""WITH {_placed()},
v AS (SELECT doc_id, i, {_window("word", 8)} AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN run IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run) > 1 THEN 1 ELSE 0 END AS hit FROM v),
m AS (SELECT doc_id, {_covered(8)} AS gone FROM c),
repeats AS (SELECT doc_id, CAST(SUM(gone) AS BIGINT) AS n_repeat_words FROM m GROUP BY 1),
l AS (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
ll AS (SELECT doc_id, host, line, len({_words("line")}) AS n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{SPACE}', ' ', 'g')) AS norm FROM l),
dup AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM ll WHERE n > 0 GROUP BY 1),
hosts AS (SELECT coalesce(source, '') AS host, count(*) AS n_all FROM documents GROUP BY 1),
excess AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS k FROM ll WHERE norm <> '' GROUP BY 1, 2) JOIN hosts USING (host) WHERE k > 20 AND k > least(0.01::DOUBLE * n_all, 200)),
lost AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_excess_lines, CAST(SUM(n) AS BIGINT) AS n_lost_words FROM ll JOIN excess USING (host, norm) GROUP BY 1),
told AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(n_excess_lines, 0) AS n_excess_lines, coalesce(n_lost_words, 0) AS n_lost_words
 FROM documents d JOIN docs USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM told)
SELECT *, NOT base_failed AND n_words - n_lost_words >= 0.3::DOUBLE * n_words AS kept FROM judged"""

SUBSTRING_DEDUP = f"""WITH {_placed()},
v AS (SELECT doc_id, i, word, {_window("word", 20)} AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, word, CASE WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS hit FROM v),
m AS (SELECT doc_id, i, word, {_covered(20)} AS gone FROM c),
s AS (SELECT doc_id, CAST(SUM(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN s USING (doc_id)"""

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS l, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, l) AS pos FROM l),
sets AS (SELECT min(pos) AS pos, line, list_distinct({_words("line")}) AS ws FROM o GROUP BY line),
t AS (SELECT pos, unnest(ws) AS word, len(ws) AS k FROM sets),
f AS (SELECT word, count(*) AS f FROM t GROUP BY 1),
p AS (SELECT pos, word, k FROM t JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY f, word) <= k - ceil(0.8 * k) + 1),
pairs AS (SELECT DISTINCT a.pos AS x, b.pos AS y FROM p a JOIN p b ON a.word = b.word AND a.pos < b.pos AND 10 * least(a.k, b.k) >= 8 * greatest(a.k, b.k)),
later AS (SELECT DISTINCT y AS pos FROM (SELECT y, len(list_intersect(a.ws, b.ws)) AS s, len(a.ws) + len(b.ws) AS u FROM pairs JOIN sets a ON a.pos = x JOIN sets b ON b.pos = y) WHERE 100 * s >= 80 * (u - s)),
gone AS (SELECT doc_id, l FROM o JOIN sets ON sets.line = o.line WHERE len(ws) > 0 AND (o.pos > sets.pos OR o.pos IN (SELECT pos FROM later))),
r AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_removed, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) AS removed FROM gone GROUP BY 1)
SELECT doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM n LEFT JOIN r USING (doc_id)"""

JACCARD_JOIN = f"""WITH RECURSIVE {_placed(f"translate(text, '{UPPER}', '{UPPER.lower()}')")},
v AS (SELECT doc_id, {_window("word", 5)} AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, run FROM v WHERE run IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND 4),
k AS (SELECT doc_id, count(*) AS k, md5(string_agg(run, chr(10) ORDER BY run)) AS name FROM s GROUP BY 1),
reps AS (SELECT name, min(doc_id) AS rep, min(k) AS k FROM k GROUP BY 1),
rs AS (SELECT rep, k, run FROM reps JOIN s ON s.doc_id = rep),
links AS (SELECT a.rep AS u, b.rep AS v FROM rs a JOIN rs b ON a.run = b.run AND a.rep < b.rep AND 10 * least(a.k, b.k) >= 8 * greatest(a.k, b.k)
 GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (min(a.k) + min(b.k) - count(*))),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT rep AS u, rep AS v FROM reps UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
root AS (SELECT u, min(v) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM docs d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN reps ON reps.name = k.name LEFT JOIN root ON root.u = reps.rep"""

ORACLES = {"op1_quality_rules": QUALITY_RULES, "op3_substring_dedup": SUBSTRING_DEDUP, "op6_line_dedup": LINE_DEDUP, "op7_ngram_jaccard_join": JACCARD_JOIN}
