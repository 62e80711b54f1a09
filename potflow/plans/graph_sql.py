"""SQL for DuckDB that the graph queries are held against: another formulation, with recursive queries for reachability."""

from __future__ import annotations

from potflow.operators.vocabulary import ingredient_rows, operation_rows
from potflow.plans import derived


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


OPERATION_COLUMNS = "op_type, grp, requires_heat, requires_liquid_input, min_inputs, max_inputs, template"
INGREDIENT_COLUMNS = "vocab_key, name, category, is_protein, is_liquid, in_published_top16"
OPERATIONS = values(operation_rows(), OPERATION_COLUMNS)
INGREDIENTS = values(ingredient_rows(), INGREDIENT_COLUMNS)

TABLES = f"""WITH RECURSIVE
op AS (SELECT * FROM {OPERATIONS}),
r AS (SELECT lower(trim(recipe_id, ' ')) AS recipe_id, dish_name, category FROM recipes WHERE recipe_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(recipe_id, ' ')) ORDER BY loaded_at DESC NULLS LAST, dish_name DESC NULLS LAST, category DESC NULLS LAST) = 1),
n0 AS (SELECT lower(trim(recipe_id, ' ')) AS recipe_id, lower(trim(node_id, ' ')) AS node_id, node_seq, loaded_at, node_type,
    ingredient.name AS name, ingredient.category AS category, coalesce(ingredient.is_protein, false) AS is_protein, coalesce(ingredient.is_liquid, false) AS is_liquid,
    operation.op_type AS op_type, operation.params AS params
  FROM nodes WHERE recipe_id IS NOT NULL AND node_id IS NOT NULL),
n AS (SELECT n0.* EXCLUDE (node_seq, loaded_at), min(node_seq) OVER (PARTITION BY recipe_id, node_id) AS pos, op.grp FROM n0 LEFT JOIN op ON op.op_type = n0.op_type
  QUALIFY row_number() OVER (PARTITION BY recipe_id, node_id ORDER BY node_seq DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
e AS (SELECT DISTINCT lower(trim(recipe_id, ' ')) AS recipe_id, lower(trim(src, ' ')) AS src, lower(trim(dst, ' ')) AS dst, edge_seq FROM edges WHERE recipe_id IS NOT NULL),
"""
REST = """ev AS (SELECT e.* FROM e JOIN n a ON a.recipe_id = e.recipe_id AND a.node_id = e.src JOIN n b ON b.recipe_id = e.recipe_id AND b.node_id = e.dst),
outs AS (SELECT recipe_id, arg_min(node_id, pos) AS node_id FROM n WHERE node_type = 'dish_output' GROUP BY recipe_id),
heat AS (SELECT recipe_id, node_id FROM n WHERE grp IN ('dry_heat', 'moist_heat')),
back AS (SELECT recipe_id, node_id FROM outs UNION
  SELECT ev.recipe_id, ev.src FROM back JOIN ev ON ev.recipe_id = back.recipe_id AND ev.dst = back.node_id
  WHERE NOT EXISTS (SELECT 1 FROM heat h WHERE h.recipe_id = ev.recipe_id AND h.node_id = ev.src)),
fwd AS (SELECT n.recipe_id, n.node_id AS plate, ev.dst AS node_id FROM n JOIN ev ON ev.recipe_id = n.recipe_id AND ev.src = n.node_id WHERE n.op_type = 'plate' AND n.node_type = 'operation' UNION
  SELECT fwd.recipe_id, fwd.plate, ev.dst FROM fwd JOIN ev ON ev.recipe_id = fwd.recipe_id AND ev.src = fwd.node_id),
reach AS (SELECT recipe_id, src AS a, dst AS b FROM ev UNION SELECT reach.recipe_id, reach.a, ev.dst FROM reach JOIN ev ON ev.recipe_id = reach.recipe_id AND ev.src = reach.b),
loops AS (SELECT DISTINCT recipe_id, a AS node_id FROM reach WHERE a = b),
stuck AS (SELECT recipe_id, node_id FROM loops UNION SELECT reach.recipe_id, reach.b FROM reach JOIN loops ON loops.recipe_id = reach.recipe_id AND loops.node_id = reach.a),
level AS (SELECT n.recipe_id, n.node_id, 0 AS depth FROM n WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.recipe_id = n.recipe_id AND ev.dst = n.node_id) UNION
  SELECT ev.recipe_id, ev.dst, depth + 1 FROM level JOIN ev ON ev.recipe_id = level.recipe_id AND ev.src = level.node_id
  WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.recipe_id = ev.recipe_id AND s.node_id = ev.dst)),
indeg AS (SELECT n.recipe_id, n.node_id, count(ev.src) AS k FROM n LEFT JOIN ev ON ev.recipe_id = n.recipe_id AND ev.dst = n.node_id GROUP BY ALL),
v AS (
  SELECT r.recipe_id, 0 AS rule_ord, 'dag_structure' AS rule, 'Expected 1 DISH_OUTPUT node, found ' || count(n.node_id) AS message, '' AS nodes, [0, 0] AS place
    FROM r LEFT JOIN n ON n.recipe_id = r.recipe_id AND n.node_type = 'dish_output' GROUP BY r.recipe_id HAVING count(n.node_id) <> 1
  UNION ALL SELECT r.recipe_id, 0, 'dag_structure', 'RecipeDAG ''' || coalesce(r.dish_name, 'None') || ''' contains a cycle — not a valid DAG.', '', [1, 0] FROM r WHERE EXISTS (SELECT 1 FROM loops WHERE loops.recipe_id = r.recipe_id)
  UNION ALL SELECT recipe_id, 0, 'dag_structure', 'DISH_OUTPUT node has outgoing edges', '', [2, pos] FROM n WHERE node_type = 'dish_output' AND EXISTS (SELECT 1 FROM ev WHERE ev.recipe_id = n.recipe_id AND ev.src = n.node_id)
  UNION ALL SELECT recipe_id, 0, 'dag_structure', 'Ingredient ''' || coalesce(name, 'None') || ''' (' || node_id || ') has no outgoing edges — unused', '', [3, pos] FROM n
    WHERE node_type = 'ingredient' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.recipe_id = n.recipe_id AND ev.src = n.node_id)
  UNION ALL SELECT recipe_id, 1, 'raw_protein_before_plate', '[FDA] Protein ''' || coalesce(name, 'None') || ''' reaches the dish without passing through any heat operation', node_id, [pos, 0]
    FROM n JOIN back USING (recipe_id, node_id) WHERE node_type = 'ingredient' AND is_protein
  UNION ALL SELECT ev.recipe_id, 2, 'solid_before_blend', '[DC] Solid ingredient ''' || coalesce(a.name, 'None') || ''' enters BLEND without any preparation', ev.src || ',' || ev.dst, [ev.edge_seq, 0]
    FROM ev JOIN n a ON a.recipe_id = ev.recipe_id AND a.node_id = ev.src JOIN n b ON b.recipe_id = ev.recipe_id AND b.node_id = ev.dst
    WHERE b.node_type = 'operation' AND b.op_type = 'blend' AND a.node_type = 'ingredient' AND NOT a.is_liquid
  UNION ALL SELECT fwd.recipe_id, 3, 'no_heat_after_plate', '[MILK/serve] Heat operation ''' || n.op_type || ''' appears after PLATE', fwd.plate || ',' || fwd.node_id, [(SELECT pos FROM n p WHERE p.recipe_id = fwd.recipe_id AND p.node_id = fwd.plate), n.pos]
    FROM fwd JOIN heat USING (recipe_id, node_id) JOIN n USING (recipe_id, node_id) WHERE n.node_type = 'operation'
  UNION ALL SELECT recipe_id, 4, 'moist_heat_needs_liquid', '[PHYS] ''' || op_type || ''' has no liquid input — moist heat requires a liquid medium', node_id, [pos, 0] FROM n
    WHERE node_type = 'operation' AND op_type IN ('boil', 'simmer', 'braise', 'poach') AND NOT EXISTS (SELECT 1 FROM ev JOIN n p ON p.recipe_id = ev.recipe_id AND p.node_id = ev.src
      WHERE ev.recipe_id = n.recipe_id AND ev.dst = n.node_id AND (p.node_type = 'operation' OR p.node_type = 'ingredient' AND p.is_liquid))
  UNION ALL SELECT recipe_id, 5, 'combine_needs_multiple_inputs', '[MILK/combine] ''' || op_type || ''' has ' || k || ' input(s); requires ≥2', node_id, [pos, 0] FROM n JOIN indeg USING (recipe_id, node_id)
    WHERE node_type = 'operation' AND op_type IN ('combine', 'mix', 'toss') AND k < 2
  UNION ALL SELECT recipe_id, 6, 'no_dangling_outputs', '[MILK/serve] Operation ''' || coalesce(op_type, 'None') || ''' (' || node_id || ') has no successors — output is never consumed', node_id, [pos, 0] FROM n
    WHERE node_type = 'operation' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.recipe_id = n.recipe_id AND ev.src = n.node_id)
  UNION ALL SELECT recipe_id, 7, 'season_needs_target', '[DC] SEASON has no non-seasoning input', node_id, [pos, 0] FROM n
    WHERE node_type = 'operation' AND op_type = 'season' AND NOT EXISTS (SELECT 1 FROM ev JOIN n p ON p.recipe_id = ev.recipe_id AND p.node_id = ev.src
      WHERE ev.recipe_id = n.recipe_id AND ev.dst = n.node_id AND (p.node_type = 'operation' OR p.node_type = 'ingredient' AND coalesce(p.category <> 'seasoning', true)))),
kept AS (SELECT v.* EXCLUDE (place) FROM v JOIN r USING (recipe_id)),
verdict AS (
  SELECT r.recipe_id, r.dish_name, r.category,
    CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.recipe_id = r.recipe_id AND (node_type IS NULL OR node_type = 'ingredient' AND name IS NULL OR node_type = 'operation' AND op_type IS NULL)) THEN 'dag_construction_error'
         WHEN (SELECT count(*) FROM e WHERE e.recipe_id = r.recipe_id) > (SELECT count(*) FROM ev WHERE ev.recipe_id = r.recipe_id) THEN 'edge_reference_error' END AS failure_code,
    (SELECT count(*) FROM kept WHERE kept.recipe_id = r.recipe_id) AS n_violations
  FROM r)
"""
#: The order of a queue: by level, then by the way along the last predecessors; a way is the first node's place, then the
#: place of the edge and of the node at each step. Ways of one level are equally long, so lists compare as wanted.
RANKED = """, depths AS (SELECT recipe_id, node_id, max(depth) AS depth FROM level GROUP BY ALL),
spot AS (SELECT recipe_id, node_id, row_number() OVER (PARTITION BY recipe_id ORDER BY pos, node_id) AS i FROM n),
way AS (SELECT recipe_id, node_id, depth, [i] AS way FROM depths JOIN spot USING (recipe_id, node_id) WHERE depth = 0 UNION
  SELECT ev.recipe_id, ev.dst, t.depth, way.way || [ev.edge_seq, spot.i] FROM way JOIN ev ON ev.recipe_id = way.recipe_id AND ev.src = way.node_id
  JOIN depths t ON t.recipe_id = ev.recipe_id AND t.node_id = ev.dst AND t.depth = way.depth + 1 JOIN spot ON spot.recipe_id = ev.recipe_id AND spot.node_id = ev.dst),
ranked AS (SELECT recipe_id, node_id, row_number() OVER (PARTITION BY recipe_id ORDER BY depth, way) - 1 AS rank FROM (SELECT recipe_id, node_id, depth, max(way) AS way FROM way GROUP BY ALL))
"""
_TOLD = """string_agg('  · [' || rule || '] ' || message || ' (nodes: ' || coalesce(nullif(replace(nodes, ',', ', '), ''), '—') || ')', chr(10) ORDER BY rule_ord, place, nodes)"""
_NAMED = "CASE {0}.node_type WHEN 'ingredient' THEN coalesce({0}.name, 'None') WHEN 'operation' THEN {0}.op_type ELSE 'DISH' END"
GRAPHS, DERIVED = TABLES + REST, derived.SQL.format(operations=OPERATIONS, ingredients=INGREDIENTS) + REST
_LABEL = "CASE {0}.node_type WHEN 'ingredient' THEN {0}.name WHEN 'operation' THEN {0}.op_type ELSE 'DISH' END"

SQL = {
    "violations": GRAPHS + "SELECT * FROM kept",
    "violations_by_joins": GRAPHS + "SELECT * FROM kept",
    "verify_verdicts": GRAPHS + "SELECT recipe_id, dish_name, category, failure_code, failure_code IS NULL AND n_violations = 0 AS is_valid, n_violations FROM verdict",
    "topological_levels": GRAPHS + "SELECT recipe_id, node_id, max(depth) AS level FROM level JOIN r USING (recipe_id) GROUP BY ALL",
    "topological_order": GRAPHS + RANKED + "SELECT recipe_id, node_id, rank FROM ranked JOIN r USING (recipe_id)",
    "graph_texts": GRAPHS + RANKED + f""", step AS (SELECT n.recipe_id, rank, n.op_type || ' ' || coalesce((SELECT string_agg({_NAMED.format("p")}, ' and ' ORDER BY edge_seq, ev.src, ev.dst) FROM ev JOIN n p ON p.recipe_id = ev.recipe_id AND p.node_id = ev.src
    WHERE ev.recipe_id = n.recipe_id AND ev.dst = n.node_id), 'ingredients') AS t FROM n JOIN ranked USING (recipe_id, node_id) WHERE n.node_type = 'operation')
SELECT r.recipe_id, CASE WHEN NOT EXISTS (SELECT 1 FROM stuck WHERE stuck.recipe_id = r.recipe_id) AND NOT EXISTS (SELECT 1 FROM n WHERE n.recipe_id = r.recipe_id AND node_type = 'operation' AND grp IS NULL) THEN
  'A dish of ' || coalesce(dish_name, 'None') || '. Ingredients: ' || coalesce((SELECT string_agg(coalesce(name, 'None'), ', ' ORDER BY pos) FROM n WHERE n.recipe_id = r.recipe_id AND node_type = 'ingredient'), '') ||
  '. Preparation: ' || coalesce((SELECT string_agg(t, '; ' ORDER BY rank) FROM step WHERE step.recipe_id = r.recipe_id), 'combine all ingredients') || '.' END AS text FROM r""",
    "verdict_texts": GRAPHS
    + f"""SELECT recipe_id, CASE WHEN n_violations = 0 THEN '✓ Recipe is valid (no constraint violations)' ELSE '✗ Recipe has ' || n_violations || ' violation(s):' || chr(10) ||
  (SELECT {_TOLD} FROM v WHERE v.recipe_id = verdict.recipe_id) END AS text FROM verdict""",
    "cycles": GRAPHS + "SELECT recipe_id, count(*) AS n_stuck FROM stuck JOIN r USING (recipe_id) GROUP BY ALL",
    "degrees": GRAPHS + "SELECT n.recipe_id, n.node_id, (SELECT count(*) FROM e WHERE e.recipe_id = n.recipe_id AND e.dst = n.node_id) AS n_in, (SELECT count(*) FROM e WHERE e.recipe_id = n.recipe_id AND e.src = n.node_id) AS n_out FROM n",
    "unheated_paths": GRAPHS + "SELECT recipe_id, node_id FROM back JOIN r USING (recipe_id)",
    "after_plate": GRAPHS + "SELECT recipe_id, plate, node_id FROM fwd JOIN r USING (recipe_id)",
    "successors": GRAPHS + "SELECT recipe_id, src AS node_id, edge_seq, dst AS neighbour FROM ev",
    "predecessors": GRAPHS + "SELECT recipe_id, dst AS node_id, edge_seq, src AS neighbour FROM ev",
    "broken_edges": GRAPHS + "SELECT recipe_id, edge_seq, src, dst FROM e EXCEPT SELECT recipe_id, edge_seq, src, dst FROM ev",
    "all_nodes": GRAPHS + "SELECT recipe_id, node_id, pos, node_type, name, category, is_protein, is_liquid, op_type, grp, params FROM n",
    "ingredient_nodes": GRAPHS + "SELECT recipe_id, node_id, pos, name, category FROM n WHERE node_type = 'ingredient'",
    "operation_nodes": GRAPHS + "SELECT recipe_id, node_id, pos, op_type FROM n WHERE node_type = 'operation'",
    "first_outputs": GRAPHS + "SELECT recipe_id, node_id FROM outs",
    "names_and_operations": GRAPHS
    + """SELECT recipe_id, coalesce(string_agg(CASE WHEN node_type = 'ingredient' THEN name END, ',' ORDER BY pos), '') AS ingredient_names,
  coalesce(string_agg(CASE WHEN node_type = 'operation' THEN op_type END, ',' ORDER BY pos), '') AS operation_types FROM n GROUP BY recipe_id""",
    "labels": GRAPHS + f"SELECT recipe_id, node_id, {_LABEL.format('n')} AS label FROM n",
    "operation_meta": GRAPHS + "SELECT recipe_id, node_id, op_type, op.grp, requires_heat, requires_liquid_input, min_inputs, max_inputs, template FROM n JOIN op USING (op_type) WHERE node_type = 'operation'",
    "graph_summaries": GRAPHS
    + """SELECT r.recipe_id, 'RecipeDAG(dish=''' || coalesce(dish_name, 'None') || ''', category=' || coalesce(r.category, 'None') || ', ingredients=' || count(CASE WHEN node_type = 'ingredient' THEN 1 END) ||
  ', operations=' || count(CASE WHEN node_type = 'operation' THEN 1 END) || ')' AS summary FROM r LEFT JOIN n ON n.recipe_id = r.recipe_id GROUP BY r.recipe_id, dish_name, r.category""",
    "violation_texts": GRAPHS + "SELECT recipe_id, rule, '[' || rule || '] ' || message || ' (nodes: ' || coalesce(nullif(replace(nodes, ',', ', '), ''), '—') || ')' AS text FROM kept",
    "verdict_headers": GRAPHS
    + "SELECT recipe_id, CASE WHEN n_violations = 0 THEN '✓ Recipe is valid (no constraint violations)' ELSE '✗ Recipe has ' || n_violations || ' violation(s):' END AS header FROM verdict",
    "violation_histogram": GRAPHS + "SELECT rule, count(*) AS n FROM kept GROUP BY rule",
    "recipe_report": GRAPHS
    + """SELECT recipe_id, dish_name, category, failure_code, failure_code IS NULL AND n_violations = 0 AS is_valid,
  coalesce((SELECT string_agg(rule, ',' ORDER BY rule_ord) FROM kept WHERE kept.recipe_id = verdict.recipe_id), '') AS violations FROM verdict""",
    "operation_transitions": GRAPHS
    + """SELECT a.op_type AS op_src, b.op_type AS op_dst, count(*) AS n FROM e JOIN n a ON a.recipe_id = e.recipe_id AND a.node_id = e.src JOIN n b ON b.recipe_id = e.recipe_id AND b.node_id = e.dst
  WHERE a.node_type = 'operation' AND b.node_type = 'operation' GROUP BY ALL""",
    "arity_violations": GRAPHS
    + "SELECT recipe_id, node_id, op_type, k AS n_inputs FROM n JOIN indeg USING (recipe_id, node_id) JOIN op USING (op_type) WHERE node_type = 'operation' AND (k < min_inputs OR max_inputs > 0 AND k > max_inputs)",
    "edges_as_written": GRAPHS
    + "SELECT recipe_id, src, dst, row_number() OVER (PARTITION BY recipe_id ORDER BY f, edge_seq) - 1 AS place FROM (SELECT *, min(edge_seq) OVER (PARTITION BY recipe_id, src) AS f FROM e)",
    "unknown_ingredients": GRAPHS
    + "SELECT name, category, count(*) AS n FROM n WHERE node_type = 'ingredient' AND NOT EXISTS (SELECT 1 FROM dim_ingredient d WHERE d.vocab_key = lower(replace(n.name, ' ', '_'))) GROUP BY ALL",
    "derived_verdicts": DERIVED + "SELECT recipe_id, dish_name, category, failure_code, failure_code IS NULL AND n_violations = 0 AS is_valid, n_violations FROM verdict",
    "derived_violations": DERIVED + "SELECT * FROM kept",
    "derived_cycles": DERIVED + "SELECT recipe_id, count(*) AS n_stuck FROM stuck GROUP BY ALL",
    "derived_levels": DERIVED + "SELECT recipe_id, node_id, max(depth) AS level FROM level GROUP BY ALL",
    "derived_summary": DERIVED
    + "SELECT rule, count(*) AS n FROM kept GROUP BY rule UNION ALL SELECT 'recipes', count(*) FROM r UNION ALL SELECT 'valid', count(*) FROM verdict WHERE failure_code IS NULL AND n_violations = 0",
    "rewrite_groups": f"SELECT grp, string_agg(op_type, ',' ORDER BY op_type) AS operations FROM {OPERATIONS} GROUP BY grp",
    "dim_operations": f"SELECT * FROM {OPERATIONS}",
    "dim_ingredients": f"SELECT * FROM {INGREDIENTS}",
}
for _name in ("dag_structure", "raw_protein_before_plate", "solid_before_blend", "no_heat_after_plate", "moist_heat_needs_liquid", "combine_needs_multiple_inputs", "no_dangling_outputs", "season_needs_target"):
    SQL[f"rule_{_name}"] = GRAPHS + f"SELECT recipe_id, message, nodes FROM kept WHERE rule = '{_name}'"
