"""References to records that don't exist, were removed or came later.

Parents and children are put into one long form, tagged, and grouped by parent table and key. Children are first added
up by key, column and month, keeping the earliest and the latest time of reference: that decides which kinds occur in
the month, so a key that a third of all rows refer to makes no large group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potflow.sources.tables import key, table

#: Referring table, column, key parts, time of reference, parent table.
REFERENCES = [
    ("det_ingrs", "id", ["id"], "loaded_at", "layer1"),
    ("responses", "recipe_id", ["recipe_id"], "received_at", "layer1"),
    ("recipes", "recipe_id", ["recipe_id"], "loaded_at", "layer1"),
    ("nodes", "recipe_id", ["recipe_id"], "loaded_at", "recipes"),
    ("edges", "src", ["recipe_id", "src"], "loaded_at", "nodes"),
    ("edges", "dst", ["recipe_id", "dst"], "loaded_at", "nodes"),
]
#: Parent table, key parts.
PARENTS = [("layer1", ["id"]), ("recipes", ["recipe_id"]), ("nodes", ["recipe_id", "node_id"])]


def whole_key(parts: list[Column]) -> Column:
    """The parts of a key as they are compared; null if a part is null or blank."""
    parts = [key(p) for p in parts]
    return F.when(reduce(lambda a, b: a & b, (p.isNotNull() & (p != "") for p in parts)), F.array(*parts))


def long_form(spark, sf_dir: str) -> DataFrame:
    """(parent, k array<string>, and of children: src_table, ref_column, period, earliest, latest, n_rows; of parents:
    first_at, removed_at, exists), one row per parent key and per child key, column and month. k has the parts of the key.
    A table whose columns refer to one parent is read once for all of them."""
    children = []
    for name in dict.fromkeys(r[0] for r in REFERENCES):
        own = [r for r in REFERENCES if r[0] == name]
        each = F.explode(F.array(*(F.struct(F.lit(column).alias("ref_column"), whole_key([F.col(p) for p in parts]).alias("k")) for _, column, parts, _, _ in own))).alias("r")
        rows = table(spark, sf_dir, name).select(F.col(own[0][3]).alias("t"), each).select("t", "r.*").where("k IS NOT NULL")
        rows = rows.withColumn("period", F.coalesce(F.date_format("t", "yyyy-MM"), F.lit("none"))).groupBy("k", "ref_column", "period")
        sums = rows.agg(F.min("t").alias("earliest"), F.max("t").alias("latest"), F.count("*").alias("n_rows"))
        children.append(sums.withColumns({"parent": F.lit(own[0][4]), "src_table": F.lit(name)}))
    parents = []
    for name, parts in PARENTS:
        rows = table(spark, sf_dir, name)
        removed = F.max_by("removed_at", F.struct("loaded_at", "removed_at")) if name == "layer1" else F.lit(None).cast("timestamp_ntz")
        rows = rows.withColumn("k", whole_key([F.col(p) for p in parts])).where("k IS NOT NULL").groupBy("k")
        parents.append(rows.agg(F.min("loaded_at").alias("first_at"), removed.alias("removed_at"), F.lit(True).alias("exists")).withColumn("parent", F.lit(name)))
    union = lambda a, b: a.unionByName(b)
    return reduce(union, children).unionByName(reduce(union, parents), allowMissingColumns=True)


def broken_references(spark, sf_dir: str) -> DataFrame:
    """(src_table, ref_column, ref_key, period, kind, n_rows): kinds missing, deleted and late of each key and month.

    n_rows counts the referring rows of the key and month. A group holds at most one row per column and month and one
    parent row. Undated references can only be missing.
    """
    group = Window.partitionBy("parent", "k")
    parent = {c: F.max(c).over(group).alias(c) for c in ("first_at", "removed_at", "exists")}
    rows = long_form(spark, sf_dir).select("src_table", "ref_column", F.concat_ws("/", "k").alias("ref_key"), "period", "earliest", "latest", "n_rows", *parent.values()).where("src_table IS NOT NULL")
    deleted = F.col("removed_at") <= F.col("latest")
    late = (F.col("earliest") < F.col("first_at")) & (F.col("removed_at").isNull() | (F.col("earliest") < F.col("removed_at")))
    kinds = F.when(F.col("exists").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(F.when(deleted, "deleted"), F.when(late, "late"))))
    return rows.select("src_table", "ref_column", "ref_key", "period", F.explode(kinds).alias("kind"), "n_rows")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Each broken reference with its month and kind. Keys with slashes in their parts may read alike; they give one row."""
    return broken_references(spark, sf_dir).select("src_table", "ref_column", "ref_key", "period", "kind").distinct()


def p4_report(spark, sf_dir: str) -> DataFrame:
    """Broken keys per table, column, month and kind; n_rows counts the rows that refer to these keys in the month."""
    return broken_references(spark, sf_dir).groupBy("src_table", "ref_column", "period", "kind").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))


def _child_sql(name: str, column: str, parts: list[str], time: str, parent: str) -> str:
    whole = "[" + ", ".join(f"lower(trim({p}, ' '))" for p in parts) + "]"
    there = " AND ".join(f"trim({p}, ' ') <> ''" for p in parts)
    return f"SELECT '{parent}' AS parent, '{name}' AS src_table, '{column}' AS ref_column, {whole} AS ref_key, {time} AS t FROM {name} WHERE {there}"


_CASES = f"""
WITH child AS ({" UNION ALL ".join(_child_sql(*r) for r in REFERENCES)}),
owner AS (
  SELECT 'layer1' AS parent, [lower(trim(id, ' '))] AS ref_key, min(loaded_at) AS first_at, NULL AS removed_at FROM layer1 WHERE trim(id, ' ') <> '' GROUP BY ALL
  UNION ALL SELECT 'recipes', [lower(trim(recipe_id, ' '))], min(loaded_at), NULL FROM recipes WHERE trim(recipe_id, ' ') <> '' GROUP BY ALL
  UNION ALL SELECT 'nodes', [lower(trim(recipe_id, ' ')), lower(trim(node_id, ' '))], min(loaded_at), NULL FROM nodes
    WHERE trim(recipe_id, ' ') <> '' AND trim(node_id, ' ') <> '' GROUP BY ALL),
now AS (
  SELECT [lower(trim(id, ' '))] AS ref_key, removed_at FROM layer1 WHERE trim(id, ' ') <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id, ' ')) ORDER BY loaded_at DESC, removed_at DESC NULLS LAST) = 1),
judged AS (
  SELECT c.src_table, c.ref_column, c.ref_key, coalesce(strftime(c.t, '%Y-%m'), 'none') AS period,
    CASE WHEN o.ref_key IS NULL THEN 'missing'
         WHEN c.parent = 'layer1' AND n.removed_at <= c.t THEN 'deleted'
         WHEN o.first_at > c.t THEN 'late' END AS kind
  FROM child c LEFT JOIN owner o ON o.parent = c.parent AND o.ref_key = c.ref_key
  LEFT JOIN now n ON c.parent = 'layer1' AND n.ref_key = c.ref_key)
"""
SQL = {
    "p4_found": _CASES + "SELECT DISTINCT src_table, ref_column, array_to_string(ref_key, '/') AS ref_key, period, kind FROM judged WHERE kind IS NOT NULL",
    "p4_report": _CASES
    + """, rows_of AS (SELECT src_table, ref_column, ref_key, coalesce(strftime(t, '%Y-%m'), 'none') AS period, count(*) AS n FROM child GROUP BY ALL)
SELECT k.src_table, k.ref_column, k.period, k.kind, count(*) AS n_keys, CAST(sum(r.n) AS BIGINT) AS n_rows
FROM (SELECT DISTINCT * FROM judged WHERE kind IS NOT NULL) k JOIN rows_of r USING (src_table, ref_column, ref_key, period) GROUP BY ALL""",
}
