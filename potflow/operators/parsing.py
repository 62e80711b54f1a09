"""Model responses as process graphs, with a taxonomy of failures.

Each response is parsed on its own, so the operator needs no shuffle and runs on streams as well. Outcomes, the first
that applies: api_error (no text), json_parse_error, out_of_scope, unknown_category, unknown_op_type,
dag_construction_error, success.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.operators.graphs import indexed
from potflow.operators.vocabulary import CATEGORIES, DISH_CATEGORIES, GROUP_DEFAULTS, GROUP_OF, NODE_TYPES
from potflow.sources.tables import key, table

NODE_FIELDS = [
    ("pos", pa.int32()), ("node_id", pa.string()), ("node_type", pa.string()), ("name", pa.string()), ("category", pa.string()), ("is_protein", pa.bool_()),
    ("is_liquid", pa.bool_()), ("op_type", pa.string()), ("grp", pa.string()), ("params", pa.string()),
]
NODES_DDL = "array<struct<pos: int, node_id: string, node_type: string, name: string, category: string, is_protein: boolean, is_liquid: boolean, op_type: string, grp: string, params: string>>"
PAIRS_DDL = "array<struct<edge_seq: int, src: string, dst: string>>"
PARSED_DDL = f"response_id string, recipe_id string, attempt int, status string, category string, failure_code string, failure_detail string, dish_name string, nodes {NODES_DDL}, pairs {PAIRS_DDL}"
#: Names a vocabulary may have to be broadcast.
VOCABULARY = 100_000


class Unusable(Exception):
    """A response that gives no graph: (code, detail)."""


@dataclass
class Parsed:
    status: str
    category: str | None = None
    code: str | None = None
    detail: str | None = None
    dish_name: str | None = None
    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)


def unfenced(raw: str) -> str:
    """The text without a code fence: the first line goes, and the last if it is just a fence."""
    text = raw.strip()
    if not text.startswith("```"):
        return text
    lines = text.split("\n")
    closed = lines[-1].strip() == "```"
    return "\n".join(lines[1 : len(lines) - closed])


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _operation(operation) -> str:
    """The operation that a payload names, directly or by its group's name."""
    if not isinstance(operation, dict):
        raise Unusable("dag_construction_error", "operation is no object")
    name = operation.get("op_type", "")
    if not isinstance(name, str):
        raise Unusable("dag_construction_error", "op_type is no text")
    found = name if name in GROUP_OF else GROUP_DEFAULTS.get(name.lower())
    if found is None:
        raise Unusable("unknown_op_type", name)
    return found


def _ingredient(ingredient, vocabulary: dict) -> dict:
    """An ingredient as the vocabulary has it, else as given: an unknown category becomes vegetable, absent flags false."""
    if not isinstance(ingredient, dict) or not isinstance(ingredient.get("name", ""), str):
        raise Unusable("dag_construction_error", "ingredient is no object with a name")
    if known := vocabulary.get(ingredient.get("name", "").lower().replace(" ", "_")):
        return dict(zip(("name", "category", "is_protein", "is_liquid"), known))
    for needed in ("name", "category"):
        if needed not in ingredient:
            raise Unusable("dag_construction_error", repr(needed))
    category = ingredient["category"] if isinstance(ingredient["category"], str) and ingredient["category"] in CATEGORIES else "vegetable"
    return {"name": ingredient["name"], "category": category} | {f: bool(ingredient.get(f, False)) for f in ("is_protein", "is_liquid")}


def _node(node: dict, vocabulary: dict) -> dict:
    """A node row. Payloads of another type than the node's are checked as well but not needed."""
    for needed in ("node_type", "node_id"):
        if needed not in node:
            raise Unusable("dag_construction_error", repr(needed))
    kind = node["node_type"]
    if kind not in NODE_TYPES:
        raise Unusable("dag_construction_error", f"{kind!r} is not a valid node type")
    row = dict.fromkeys((f for f, _ in NODE_FIELDS)) | {"node_id": _text(node["node_id"]), "node_type": kind, "is_protein": False, "is_liquid": False}
    if kind != "dish_output" and kind not in node:
        raise Unusable("dag_construction_error", f"{kind} nodes require an {kind}")
    if kind == "ingredient":
        row |= _ingredient(node["ingredient"], vocabulary)
    if kind == "operation":
        row["op_type"] = _operation(node["operation"])
        row["grp"] = GROUP_OF[row["op_type"]]
        row["params"] = json.dumps(node["operation"].get("params", {}), ensure_ascii=False)
    return row


def _pair(edge) -> tuple[str, str]:
    """The two ends of an edge: any two items that unpack."""
    ends = list(edge) if isinstance(edge, (list, str, dict)) else []
    if len(ends) != 2:
        raise Unusable("dag_construction_error", "an edge hasn't two ends")
    return _text(ends[0]), _text(ends[1])


def parsed(raw: str | None, vocabulary: dict) -> Parsed:
    """One response. Later nodes of one id replace the payload of the first and keep its place."""
    if raw is None:
        return Parsed("failed", None, "api_error")
    try:
        data = json.loads(unfenced(raw))
    except (ValueError, RecursionError) as e:
        return Parsed("failed", None, "json_parse_error", str(e))
    if not isinstance(data, dict):
        return Parsed("failed", None, "json_parse_error", "the JSON is no object")
    category = data.get("category", "out_of_scope")
    if category == "out_of_scope":
        return Parsed("out_of_scope", category)
    if not isinstance(category, str) or category not in DISH_CATEGORIES:
        return Parsed("failed", _text(category), "unknown_category", _text(category))
    nodes = data.get("nodes", [])
    try:
        nodes = nodes if isinstance(nodes, list) else []
        for node in nodes:
            if isinstance(node, dict) and node.get("node_type") == "operation" and isinstance(node.get("operation"), dict) and isinstance(node["operation"].get("op_type", ""), str):
                _operation(node["operation"])
        for needed in ("dish_name", "nodes", "edges"):
            if needed not in data:
                raise Unusable("dag_construction_error", repr(needed))
        if not isinstance(data["nodes"], list) or not isinstance(data["edges"], list) or not all(isinstance(x, dict) for x in nodes):
            raise Unusable("dag_construction_error", "nodes or edges are no list of objects")
        places: dict[str, dict] = {}
        for node in nodes:
            row = _node(node, vocabulary)
            row["pos"] = places[row["node_id"]]["pos"] if row["node_id"] in places else len(places)
            places[row["node_id"]] = row
        edges = [_pair(e) for e in data["edges"]]
    except Unusable as e:
        return Parsed("failed", category, *e.args)
    return Parsed("success", category, None, None, _text(data["dish_name"]), list(places.values()), edges)


def ingredient_keys(raw: str | None) -> list[str]:
    """The vocabulary keys that a response's ingredients ask for."""
    try:
        data = json.loads(unfenced(raw or ""))
    except (ValueError, RecursionError):
        return []
    nodes = data.get("nodes") if isinstance(data, dict) else None
    found = (node.get("ingredient") for node in nodes if isinstance(node, dict)) if isinstance(nodes, list) else ()
    return sorted({i["name"].lower().replace(" ", "_") for i in found if isinstance(i, dict) and isinstance(i.get("name"), str)})


def with_entries(responses: DataFrame, ingredients: DataFrame) -> DataFrame:
    """responses with ``entries``, the vocabulary's entries that each asks for, by a join: for a vocabulary of any size."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, k) for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in ingredient_keys(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 2)], names=["response_id", "vocab_key"])

    asked = responses.select("response_id", "raw").mapInArrow(keys, "response_id string, vocab_key string").distinct()
    found = asked.join(ingredients, "vocab_key").groupBy("response_id").agg(F.collect_list(F.struct("vocab_key", "name", "category", "is_protein", "is_liquid")).alias("entries"))
    return responses.join(found, "response_id", "left")


def parse(responses: DataFrame, ingredients: DataFrame, broadcast: int = VOCABULARY) -> DataFrame:
    """responses(response_id, recipe_id, attempt, raw), ingredients(vocab_key, name, category, is_protein, is_liquid) -> PARSED_DDL.

    One row per response row. A vocabulary of up to ``broadcast`` names is broadcast; of a larger one each response gets the
    entries it asks for by a join.
    """
    columns = ("vocab_key", "name", "category", "is_protein", "is_liquid")
    rows = ingredients.select(*columns).limit(broadcast + 1).collect()
    small = len(rows) <= broadcast
    shared = responses.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in rows} if small else {})
    responses = responses.select("response_id", "recipe_id", F.col("attempt").cast("int"), "raw")
    if not small:
        responses = with_entries(responses, ingredients.select(*columns)).select("response_id", "recipe_id", "attempt", "raw", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes_type, pairs_type = pa.list_(pa.struct(NODE_FIELDS)), pa.list_(pa.struct([("edge_seq", pa.int32()), ("src", pa.string()), ("dst", pa.string())]))
        for batch in batches:
            raws = batch.column(3).to_pylist()
            own = [{e["vocab_key"]: tuple(e[c] for c in columns[1:]) for e in es or ()} for es in batch.column(4).to_pylist()] if batch.num_columns > 4 else [shared.value] * len(raws)
            found = [parsed(raw, vocabulary) for raw, vocabulary in zip(raws, own)]
            pairs = [[{"edge_seq": k, "src": s, "dst": d} for k, (s, d) in enumerate(p.edges)] if p.status == "success" else None for p in found]
            text = [pa.array([getattr(p, c) for p in found], pa.string()) for c in ("status", "category", "code", "detail", "dish_name")]
            nodes = pa.array([p.nodes if p.status == "success" else None for p in found], nodes_type)
            names = [c for c in ("response_id", "recipe_id", "attempt", "status", "category", "failure_code", "failure_detail", "dish_name", "nodes", "pairs")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *text, nodes, pa.array(pairs, pairs_type)], names=names)

    return responses.mapInArrow(run, PARSED_DDL)


def distinct_responses(raw: DataFrame) -> DataFrame:
    """(response_id, recipe_id, attempt, raw): copies once; recipe_id as it is compared, null ones kept. response_id is
    a hash of the row."""
    rows = raw.select(key("recipe_id").alias("recipe_id"), "attempt", "raw")
    rows = rows.withColumn("response_id", F.md5(F.to_json(F.struct("recipe_id", "attempt", "raw"))))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "response_id").dropDuplicates(["response_id"])


def response_graphs(parsed_rows: DataFrame) -> DataFrame:
    """The successes as nested graphs, their recipe_id being the response_id."""
    rows = parsed_rows.where("status = 'success'").select(F.col("response_id").alias("recipe_id"), "dish_name", "category", "nodes", "pairs")
    return indexed(rows)


def parsed_table(spark, sf_dir: str) -> DataFrame:
    return parse(distinct_responses(table(spark, sf_dir, "responses")), table(spark, sf_dir, "dim_ingredient"))
