"""DuckDB SQL with the same results as the manifest, search and chat queries."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_CRC_TABLE = """b AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
 UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8)"""


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, first: str) -> str:
    """Levels of the trees by key, and every node's siblings."""
    return f"""{name} AS (SELECT 0 AS l, key, i, n, d FROM {first}
 UNION ALL SELECT l + 1, key, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY l, key, i // 3),
{name}_near AS (SELECT a.l, a.key, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lt, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rt
 FROM {name} a JOIN {name} b ON a.l = b.l AND a.key = b.key AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3)"""


def _walk(name: str, tree: str, first: str) -> str:
    return f"""{name} AS (SELECT doc_id, key, 0 AS l, i, n, c, proof FROM {first}
 UNION ALL SELECT w.doc_id, w.key, w.l + 1, w.i // 3, (w.n + 2) // 3, sha256(lt || c || rt), proof || lt || rt FROM {name} w JOIN {tree}_near s ON w.l = s.l AND w.key = s.key AND w.i = s.i WHERE w.n > 1)"""


MERKLE_MANIFEST = f"""WITH RECURSIVE {_CRC_TABLE},
told AS (SELECT doc_id, coalesce('=' || source, '') AS key, {_leaf("text")} AS leaf,
 CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda a, z: xor(a >> 8, t[(xor(a, z) & 255) + 1])), 4294967295) % 2 = 0
 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents, crc),
leaves AS (SELECT key, doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, leaf AS d, tampered AS c, '' AS proof FROM told),
{_tree("low", "leaves")},
subroots AS (SELECT key AS source, d FROM low WHERE n = 1),
tops AS (SELECT source, '' AS key, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n, d FROM subroots),
{_tree("high", "tops")},
{_walk("up", "low", "leaves")},
tips AS (SELECT up.doc_id, tops.key, tops.i, tops.n, up.c, up.proof FROM up JOIN tops ON tops.source = up.key WHERE up.n = 1),
{_walk("rise", "high", "tips")}
SELECT t.doc_id, t.leaf, s.d AS subroot, r.d AS root, sha256(w.proof) AS proof_sha256, w.c AS folded_root, w.c = r.d AS verified
FROM told t JOIN subroots s ON s.source = t.key JOIN (SELECT d FROM high WHERE n = 1) r ON true JOIN (SELECT doc_id, c, proof FROM rise WHERE n = 1) w ON w.doc_id = t.doc_id"""

_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
m AS (SELECT doc_id, 10 + 90 * len(ts) * s.n // s.l AS m FROM d, s),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), s),
scored AS (SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""

_SAYS = "'</s>[INST] ok [/INST]'"


def _control_strings(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\[\\*/?INST\]|<\\*/?s>'))"


CHAT_FORMAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', {_SAYS} UNION ALL SELECT -1, 1, 'assistant', {_SAYS})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(17 + length(role) + length(text) + {_control_strings("role")} + {_control_strings("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

ORACLES = {"op11_merkle_manifest": MERKLE_MANIFEST, "op12_lexical_search": LEXICAL_SEARCH, "op13_chat_format": CHAT_FORMAT}
