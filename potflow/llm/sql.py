"""SQL for DuckDB that queries of this subpackage are held against.

DuckDB has no NFKC; what that changes in letters and digits is stated as a table below, for the characters of the test data.
"""

from __future__ import annotations

#: Characters that NFKC changes: full-width letters and digits, no-break space, ordinal sign; then those that become several.
_WIDE = "".join(chr(0xFF00 + k) for k in range(1, 95)) + " º"
_NARROW = "".join(chr(0x20 + k) for k in range(1, 95)) + " o"
_SEVERAL = {"¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "⅛": "1⁄8", "⅜": "3⁄8", "⅝": "5⁄8", "⅞": "7⁄8", "⅓": "1⁄3", "⅔": "2⁄3", "ﬁ": "fi", "ﬂ": "fl"}
_DROPPED = "​‍­﻿"


def folded(x: str) -> str:
    """A text without invisible characters, NFKC, lower case."""
    for one, several in _SEVERAL.items():
        x = f"replace({x}, '{one}', '{several}')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"lower(nfc_normalize(translate(translate({x}, '{_DROPPED}', ''), {quoted(_WIDE)}, {quoted(_NARROW)})))"


_NOW = """SELECT lower(trim(id, ' ')) AS id, title, ingredients, instructions FROM layer1 WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id, ' ')) ORDER BY loaded_at DESC) = 1"""
_TERMS = f"""WITH now AS ({_NOW}),
texts AS (SELECT id, unnest(list_concat(coalesce([x.text FOR x IN ingredients], []), coalesce([x.text FOR x IN instructions], []))) AS t FROM now),
ts AS (SELECT id, regexp_extract_all({folded("t")}, '\\p{{L}}+') AS ts FROM texts WHERE t IS NOT NULL),
grams AS (SELECT id, unnest(ts) AS term, 1 AS n_terms FROM ts UNION ALL
  SELECT id, unnest([ts[i] || ' ' || ts[i + 1] FOR i IN range(1, len(ts))]), 2 FROM ts),
counts AS (SELECT term, n_terms, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM grams GROUP BY ALL),
marked AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.35 * (SELECT count(*) FROM now) THEN 'common' END AS mark FROM counts)
"""
_WORD = "[\\p{L}\\p{Nd}]+"
_SETS = f"""WITH RECURSIVE now AS ({_NOW}),
texts AS (SELECT id, unnest(list_concat([title], coalesce([x.text FOR x IN ingredients], []), coalesce([x.text FOR x IN instructions], []))) AS t FROM now),
ws AS (SELECT id, regexp_extract_all({folded("t")}, '{_WORD}') AS ws FROM texts WHERE t IS NOT NULL),
runs AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS r FROM ws),
sets AS (SELECT id, count(*) AS n, list(r ORDER BY r) AS rs FROM runs GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM runs a JOIN runs b ON a.r = b.r AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM common JOIN sets a ON a.id = id_a JOIN sets b ON b.id = id_b WHERE 2 * k >= a.n + b.n - k)
"""
_PLAIN = lambda x: f"regexp_replace(replace(replace({x}, '&nbsp;', ' '), '&darr;', ' '), '<[/!?]?[A-Za-z][^<>]*>', ' ', 'g')"
_WINDOWS = lambda key, table: f"""SELECT DISTINCT {key}, unnest([array_to_string(ws[i:i + 12], ' ') FOR i IN range(1, len(ws) - 11)]) AS w
  FROM (SELECT {key}, regexp_extract_all({folded(_PLAIN("text"))}, '{_WORD}') AS ws FROM {table} WHERE text IS NOT NULL) WHERE len(ws) >= 13"""  # noqa: E731
SQL = {
    "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE n_terms = 1 AND mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT * FROM marked",
    "p6_found": _SETS + "SELECT * FROM pairs",
    "p6_groups": _SETS
    + """, classes AS (SELECT id, min(id) OVER (PARTITION BY rs) AS class_id FROM sets),
links AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM pairs JOIN classes a ON a.id = id_a JOIN classes b ON b.id = id_b WHERE a.class_id <> b.class_id),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT id, class_id, (SELECT min(b) FROM reach WHERE reach.a = class_id) AS group_id, (SELECT count(*) FROM ways WHERE ways.a = class_id) AS n_links FROM classes""",
    "p8_found": f"WITH d AS ({_WINDOWS('doc_id', 'documents')}), i AS ({_WINDOWS('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (w)",
}
