"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Exact similarity of all pairs that share a shingle, and the closure of the links.
NEAR_DUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sets AS (SELECT DISTINCT doc_id, s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

#: Windows of items joined to the windows of documents, and the words that they cover.
DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, widths WHERE len(w) >= k)),
found AS (SELECT doc_id, x.k, i, item_id FROM doc_windows x JOIN item_windows y ON x.k = y.k AND x.win = y.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

#: crc32 of short strings: the table of the reflected polynomial, then one step a byte.
_CRC = """
crc_bits AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR z IN range(8)]),
                        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
  FROM range(256) AS t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits)"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII string expression; ``t`` is the column of ``crc_table``."""
    return (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(ch) AS BIGINT) "
            f"FOR ch IN string_split({text}, '')]), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)))")


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_ROW = " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))

#: Trees a source and one of the subroots, level by level; paths and folded roots by joins on the levels.
MERKLE = f"""
WITH RECURSIVE {_CRC},
docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({_ROW} || {_field("text")}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(coalesce(doc_id, 0) AS VARCHAR)")} % 2 = 0
              THEN sha256({_ROW} || {_field("replace(text, chr(10), '')")}) END AS tampered
  FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs),
nodes AS (
  SELECT source, 0 AS lvl, i AS idx, leaf AS h FROM leaves
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) WHERE n > 1 GROUP BY source, lvl, idx // 3),
subroots AS (
  SELECT source, arg_max(h, lvl) AS subroot, max(lvl) AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
  FROM nodes GROUP BY source),
crown AS (
  SELECT 0 AS lvl, i AS idx, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY lvl, idx // 3),
top AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM crown),
runs AS (
  SELECT l.r, n.lvl AS step, n.idx, n.h, l.i // CAST(pow(3, n.lvl) AS BIGINT) AS own
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN nodes n ON n.source IS NOT DISTINCT FROM l.source AND n.lvl < s.height
       AND n.idx // 3 = l.i // CAST(pow(3, n.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT l.r, s.height + n.lvl, n.idx, n.h, s.i // CAST(pow(3, n.lvl) AS BIGINT)
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, top t
  JOIN crown n ON n.lvl < t.height AND n.idx // 3 = s.i // CAST(pow(3, n.lvl + 1) AS BIGINT)),
steps AS (
  SELECT r, step, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') AS lft,
         coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS rgt
  FROM runs GROUP BY r, step),
folds AS (
  SELECT r, 0 AS step, coalesce(tampered, leaf) AS h FROM docs
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.lft || f.h || s.rgt) FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step),
proofs AS (SELECT r, string_agg(lft || rgt, '' ORDER BY step) AS proof FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root,
       f.h = t.root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN top t
JOIN folds f ON f.r = l.r AND f.step = s.height + t.height LEFT JOIN proofs p ON p.r = l.r
"""


def _add(state: str, cost: str, letter: str, line: str = "''") -> str:
    """A state's (cost and audit as one sortable string, text so far) after an edit; `~` is no way to get there."""
    return (f"struct_pack(k := CASE WHEN {state}.k = '~' THEN '~' ELSE printf('%09d', CAST({state}.k[1:9] AS INTEGER) "
            f"+ {cost}) || {state}.k[10:] || '{letter}' END, t := {state}.t || {line})")


def _best(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _if(condition: str, state: str) -> str:
    return f"CASE WHEN {condition} THEN {state} ELSE struct_pack(k := '~', t := '') END"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_LINE = "chr(10) || m.role || ':' || m.text"
_STAYS = "m.fault NOT IN ('blank', 'duplicate')"

#: Damage by crc32, then the least (cost, audit) of each role state, row by row, inserts after every row.
CONVERSATIONS = rf"""
WITH RECURSIVE {_CRC},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN said <> '' AND right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
fold AS (
  SELECT conv_id, 0 AS i, struct_pack(k := '000000000', t := '') AS n, struct_pack(k := '~', t := '') AS s,
         struct_pack(k := '000000003I', t := {_USER}) AS u,
         struct_pack(k := '000000006II', t := {_USER} || {_ASSISTANT}) AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n, s, u, {_best("a", _add("u", "3", "I", _ASSISTANT))} AS a
  FROM (SELECT conv_id, i, n, s, a,
               {_best("u", _add("n", "3", "I", _USER), _add("s", "3", "I", _USER), _add("a", "3", "I", _USER))} AS u
        FROM (SELECT f.conv_id, m.i, {_add("f.n", "4", "D")} AS n,
                     {_best(_add("f.s", "4", "D"), _if(_STAYS + " AND left(m.role, 1) = 's'", _add("f.n", "m.cut", "K", _LINE)))} AS s,
                     {_best(_add("f.u", "4", "D"), _if(_STAYS + " AND left(m.role, 1) = 'u'", _add("f.o", "m.cut", "K", _LINE)),
                            _if(_STAYS, _add("f.o", "3 + m.cut", "R", _USER + " || m.text")))} AS u,
                     {_best(_add("f.a", "4", "D"), _if(_STAYS + " AND left(m.role, 1) = 'a'", _add("f.u", "m.cut", "K", _LINE)),
                            _if(_STAYS, _add("f.u", "3 + m.cut", "R", _ASSISTANT + " || m.text")))} AS a
              FROM (SELECT *, {_best("n", "s", "a")} AS o FROM fold) f
              JOIN marked m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i + 1))),
goal AS (
  SELECT conv_id, {_best("n", "a")} AS g FROM fold
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(g.g.k[1:9] AS BIGINT) AS cost,
       g.g.k[10:] AS audit, sha256(g.g.t[2:]) AS repaired_sha256
FROM goal g LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM g.conv_id
"""
