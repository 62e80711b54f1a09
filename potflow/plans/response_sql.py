"""SQL for DuckDB that the queries on responses are held against: the responses parsed with SQL's own JSON functions."""

from __future__ import annotations

from potflow.operators import labelled
from potflow.operators.vocabulary import CATEGORIES, DISH_CATEGORIES, GROUP_DEFAULTS, NODE_TYPES
from potflow.plans.graph_sql import OPERATIONS, REST, values

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_TRUE = "CASE json_type({0}) WHEN 'BOOLEAN' THEN CAST({0} AS BOOLEAN) WHEN 'VARCHAR' THEN ({0} ->> '$') <> '' WHEN 'NULL' THEN false WHEN 'BIGINT' THEN CAST({0} AS BIGINT) <> 0 WHEN 'UBIGINT' THEN CAST({0} AS BIGINT) <> 0 WHEN 'DOUBLE' THEN CAST({0} AS DOUBLE) <> 0 ELSE {0} IS NOT NULL END"

RESPONSES = f"""WITH RECURSIVE
op AS (SELECT * FROM {OPERATIONS}),
fallback AS (SELECT * FROM {values(list(GROUP_DEFAULTS.items()), "g, op_type")}),
one AS (SELECT *, CAST(row_number() OVER () AS VARCHAR) AS rid FROM (SELECT DISTINCT lower(trim(recipe_id, ' ')) AS recipe_id, attempt, raw FROM responses)),
stripped AS (SELECT *, trim(raw, E' \\t\\n\\r') AS s FROM one),
lined AS (SELECT *, string_split(s, chr(10)) AS ls FROM stripped),
bare AS (SELECT rid, recipe_id, attempt, raw, CASE WHEN starts_with(s, '```') THEN
    array_to_string(CASE WHEN trim(ls[len(ls)], E' \\t\\n\\r') = '```' THEN ls[2:len(ls) - 1] ELSE ls[2:] END, chr(10)) ELSE s END AS t FROM lined),
doc AS (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM bare),
top AS (SELECT *, json_type(j) AS kind, json_type(j, '$.category') AS ckind, j ->> '$.category' AS cat FROM doc),
x AS (SELECT rid, generate_subscripts(list, 1) - 1 AS i, unnest(list) AS node FROM (SELECT rid, from_json(j -> '$.nodes', '["JSON"]') AS list FROM top WHERE kind = 'OBJECT' AND json_type(j, '$.nodes') = 'ARRAY')),
xn AS (SELECT x.*, node ->> '$.node_type' AS node_type, node ->> '$.node_id' AS node_id, json_type(node, '$.node_id') AS idkind,
    json_type(node, '$.ingredient') AS ikind, node -> '$.ingredient' AS ing, json_type(node, '$.operation') AS okind, node ->> '$.operation.op_type' AS o, json_type(node, '$.operation.op_type') AS otype FROM x),
xo AS (SELECT xn.*, coalesce(op.op_type, CASE WHEN xn.o IS NULL AND xn.otype IS NULL THEN NULL ELSE fallback.op_type END) AS op_type,
    d.vocab_key IS NOT NULL AS known, d.name AS dname, d.category AS dcat, d.is_protein AS dprot, d.is_liquid AS dliq
  FROM xn LEFT JOIN op ON op.op_type = xn.o LEFT JOIN fallback ON fallback.g = lower(xn.o)
  LEFT JOIN dim_ingredient d ON xn.ikind = 'OBJECT' AND d.vocab_key = lower(replace(xn.ing ->> '$.name', ' ', '_'))),
bad AS (SELECT rid, bool_or(node_type = 'operation' AND okind = 'OBJECT' AND coalesce(otype, 'VARCHAR') = 'VARCHAR' AND op_type IS NULL) AS unknown_op,
    bool_or(json_type(node) <> 'OBJECT' OR coalesce(node_type NOT IN {_IN(NODE_TYPES)}, true) OR idkind IS NULL
      OR node_type = 'ingredient' AND (coalesce(ikind, '') <> 'OBJECT' OR coalesce(json_type(ing, '$.name'), 'VARCHAR') <> 'VARCHAR' OR NOT known AND (json_type(ing, '$.name') IS NULL OR json_type(ing, '$.category') IS NULL))
      OR node_type = 'operation' AND (coalesce(okind, '') <> 'OBJECT' OR coalesce(otype, 'VARCHAR') <> 'VARCHAR')) AS unbuilt FROM xo GROUP BY rid),
y AS (SELECT rid, generate_subscripts(list, 1) - 1 AS edge_seq, unnest(list) AS edge FROM (SELECT rid, from_json(j -> '$.edges', '["JSON"]') AS list FROM top WHERE kind = 'OBJECT' AND json_type(j, '$.edges') = 'ARRAY')),
loose AS (SELECT DISTINCT rid FROM y WHERE CASE json_type(edge) WHEN 'ARRAY' THEN json_array_length(edge) <> 2 WHEN 'VARCHAR' THEN length(edge ->> '$') <> 2 WHEN 'OBJECT' THEN len(json_keys(edge)) <> 2 ELSE true END),
parsed AS (SELECT top.rid, recipe_id, attempt, j,
    CASE WHEN raw IS NULL THEN 'api_error' WHEN j IS NULL OR kind <> 'OBJECT' THEN 'json_parse_error'
         WHEN ckind IS NULL OR cat = 'out_of_scope' AND ckind = 'VARCHAR' THEN 'out_of_scope'
         WHEN coalesce(ckind <> 'VARCHAR' OR cat NOT IN {_IN(DISH_CATEGORIES)}, true) THEN 'unknown_category'
         WHEN coalesce(unknown_op, false) THEN 'unknown_op_type'
         WHEN json_type(j, '$.dish_name') IS NULL OR coalesce(json_type(j, '$.nodes'), '') <> 'ARRAY' OR coalesce(json_type(j, '$.edges'), '') <> 'ARRAY' OR coalesce(unbuilt, false) OR loose.rid IS NOT NULL THEN 'dag_construction_error'
         ELSE 'success' END AS code, ckind, cat
  FROM top LEFT JOIN bad USING (rid) LEFT JOIN loose USING (rid)),
outcome AS (SELECT rid, recipe_id, attempt, CASE WHEN code IN ('success', 'out_of_scope') THEN code ELSE 'failed' END AS status,
    CASE WHEN code IN ('api_error', 'json_parse_error') THEN NULL WHEN code = 'out_of_scope' THEN code WHEN ckind = 'NULL' THEN NULL ELSE cat END AS category,
    CASE WHEN code NOT IN ('success', 'out_of_scope') THEN code END AS failure_code FROM parsed),
r AS (SELECT rid AS recipe_id, j ->> '$.dish_name' AS dish_name, cat AS category FROM parsed WHERE code = 'success'),
built AS (SELECT xo.rid AS recipe_id, i, node_id, node_type,
    CASE WHEN node_type = 'ingredient' THEN CASE WHEN known THEN dname ELSE ing ->> '$.name' END END AS name,
    CASE WHEN node_type = 'ingredient' THEN CASE WHEN known THEN dcat WHEN json_type(ing, '$.category') = 'VARCHAR' AND ing ->> '$.category' IN {_IN(CATEGORIES)} THEN ing ->> '$.category' ELSE 'vegetable' END END AS category,
    CASE WHEN node_type <> 'ingredient' THEN false WHEN known THEN dprot ELSE coalesce({_TRUE.format("(ing -> '$.is_protein')")}, false) END AS is_protein,
    CASE WHEN node_type <> 'ingredient' THEN false WHEN known THEN dliq ELSE coalesce({_TRUE.format("(ing -> '$.is_liquid')")}, false) END AS is_liquid,
    CASE WHEN node_type = 'operation' THEN xo.op_type END AS op_type,
    CASE WHEN node_type = 'operation' THEN CASE json_type(node, '$.operation.params') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN node ->> '$.operation.params' ELSE coalesce(CAST(json(node -> '$.operation.params') AS VARCHAR), '{{}}') END END AS params
  FROM xo JOIN r ON r.recipe_id = xo.rid),
n AS (SELECT built.*, min(i) OVER (PARTITION BY recipe_id, node_id) AS pos, op.grp FROM built LEFT JOIN op ON op.op_type = built.op_type
  QUALIFY row_number() OVER (PARTITION BY recipe_id, node_id ORDER BY i DESC) = 1),
e AS (SELECT y.rid AS recipe_id, edge ->> '$[0]' AS src, edge ->> '$[1]' AS dst, edge_seq FROM y JOIN r ON r.recipe_id = y.rid),
"""
_REPORT = """, fired AS (SELECT outcome.*, verdict.failure_code IS NULL AND n_violations = 0 AS is_valid FROM outcome LEFT JOIN verdict ON verdict.recipe_id = outcome.rid AND outcome.status = 'success')
"""
_PLACED = "SELECT {0}, n, row_number() OVER (ORDER BY n DESC, {0}) AS place FROM ({1})"
_SHARE = lambda a, b: f"round(100 * CAST({a} AS DOUBLE) / nullif({b}, 0), 1)"
_CASES = f"""WITH RECURSIVE
op AS (SELECT * FROM {OPERATIONS}),
labelled AS (SELECT * FROM {values(labelled.CASES, "case_name, expected_rule, dish_name, category")}),
r AS (SELECT case_name AS recipe_id, dish_name, category FROM labelled),
n AS (SELECT * FROM {values(labelled.node_rows(), labelled.NODE_COLUMNS)}),
e AS (SELECT * FROM {values(labelled.edge_rows(), "recipe_id, src, dst, edge_seq")}),
"""
_RECALL = """, got AS (SELECT case_name, expected_rule, coalesce((SELECT string_agg(DISTINCT rule, ', ' ORDER BY rule) FROM kept WHERE recipe_id = case_name), '') AS fired,
    EXISTS (SELECT 1 FROM kept WHERE recipe_id = case_name AND rule = expected_rule) AS hit FROM labelled),
judged AS (SELECT *, CASE WHEN expected_rule = 'none' THEN CASE WHEN fired = '' THEN 'TN' ELSE 'FP' END WHEN hit THEN 'TP' ELSE 'FN' END AS outcome FROM got)
"""
SQL = {
    "recall_cases": _CASES + REST + _RECALL + """SELECT case_name, expected_rule, fired, outcome, CASE outcome WHEN 'TN' THEN '✓ no false positive' WHEN 'FP' THEN '✗ FALSE POSITIVE: ' || fired
  WHEN 'TP' THEN '✓ caught' ELSE '✗ MISSED (got: ' || coalesce(nullif(fired, ''), 'nothing') || ')' END AS status FROM judged""",
    "recall_by_rule": _CASES + REST + _RECALL + "SELECT expected_rule, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn FROM judged WHERE expected_rule <> 'none' GROUP BY ALL",
    "recall_summary": _CASES + REST + _RECALL + """SELECT *, coalesce(true_positives / nullif(n_violation_cases, 0), 0.0) AS recall FROM (SELECT count(*) AS n_total, count(*) FILTER (expected_rule <> 'none') AS n_violation_cases,
  count(*) FILTER (expected_rule = 'none') AS n_control_cases, count(*) FILTER (outcome = 'TP') AS true_positives, count(*) FILTER (outcome = 'FN') AS false_negatives, count(*) FILTER (outcome = 'FP') AS false_positives FROM judged)""",
    "parse_outcomes": RESPONSES + REST + "SELECT recipe_id, attempt, status, category, failure_code FROM outcome",
    "parsed_nodes": RESPONSES + REST + "SELECT o.recipe_id, o.attempt, n.node_id, n.node_type, n.name, n.category, n.is_protein, n.is_liquid, n.op_type, n.grp, n.params FROM n JOIN outcome o ON o.rid = n.recipe_id",
    "parsed_edges": RESPONSES + REST + "SELECT o.recipe_id, o.attempt, e.edge_seq, e.src, e.dst FROM e JOIN outcome o ON o.rid = e.recipe_id",
    "coverage_report": RESPONSES + REST + _REPORT + """SELECT recipe_id, attempt, status, category, failure_code, is_valid,
  CASE WHEN status = 'success' THEN coalesce((SELECT string_agg(rule, ',' ORDER BY rule_ord) FROM kept WHERE kept.recipe_id = fired.rid), '') END AS violations FROM fired""",
    "coverage_counters": RESPONSES + REST + _REPORT + f"""SELECT *, {_SHARE("n_out_of_scope", "n_attempted")} AS pct_out_of_scope, {_SHARE("n_parse_failed", "n_attempted")} AS pct_failed,
  {_SHARE("n_parse_success", "n_attempted")} AS pct_success, {_SHARE("n_valid", "n_parse_success")} AS pct_valid, {_SHARE("n_invalid", "n_parse_success")} AS pct_invalid FROM (
  SELECT count(*) AS n_attempted, count(*) FILTER (status = 'success') AS n_parse_success, count(*) FILTER (status = 'out_of_scope') AS n_out_of_scope, count(*) FILTER (status = 'failed') AS n_parse_failed,
    count(*) FILTER (is_valid) AS n_valid, count(*) FILTER (NOT is_valid) AS n_invalid FROM fired)""",
    "category_histogram": RESPONSES + REST + _PLACED.format("category", "SELECT category, count(*) AS n FROM outcome WHERE status = 'success' GROUP BY ALL"),
    "failure_histogram": RESPONSES + REST + _PLACED.format("failure_code", "SELECT failure_code, count(*) AS n FROM outcome WHERE failure_code IS NOT NULL GROUP BY ALL"),
    "rule_histogram": RESPONSES + REST + _PLACED.format("rule", "SELECT rule, count(*) AS n FROM kept GROUP BY ALL"),
}
