"""Nested records as flat tables with Merkle identities.

Objects and arrays are canonicalised and hashed bottom-up: an object's identity is the hash of its keys in order with
the identities of its members, so equal objects have one identity wherever they stand. Each is stored once. Bridge
rows hold which object holds which under which key or position; occurrence rows keep every place of a record. Where the
leaves of the occurrences are wanted, they are found by walking the bridge rows down from the distinct objects that occur.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.sources.tables import current, key, spread, table, written

_START = re.compile(r'\{\s*["}]')
#: Identities a task remembers as told before it starts afresh; repeats are dropped again later.
REMEMBERED = 200_000
#: Objects up to this height are walked a level at a time. A higher one that occurs, or whose height is a multiple of LEAP,
#: has leaps too: bridge rows to the leaves, low objects and multiples below it, so a very deep record needs few rounds.
LOW, LEAP = 24, 256
#: Rounds of a walk after which what was reached is written.
ROUNDS = 8


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def decoded(text: str, start: int | None = None):
    """The JSON value that the whole text holds, or with ``start`` the value there and its end; ValueError if none."""
    decoder = json.JSONDecoder(parse_constant=_constant)
    try:
        return decoder.decode(text) if start is None else decoder.raw_decode(text, start)
    except RecursionError:
        value, end = decoded_deep(text, start or 0)
    if start is None and text[end:].strip(" \t\n\r"):
        raise ValueError("more than one value")
    return value if start is None else (value, end)


_SPACE, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


def decoded_deep(text: str, at: int = 0) -> tuple[object, int]:
    """The JSON value at a place and its end, nested to any depth: what is open stands on a stack."""
    open_: list[tuple[object, str | None]] = []  # containers with the key that the next member gets
    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c in ("{", "["):
            value, at = ({} if c == "{" else []), _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = _name(text, at)
                open_.append((value, name))
                continue
            at += 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            value, at = json.loads(m[0]), m.end()
        while open_:
            parent, name = open_[-1]
            if name is None:
                parent.append(value)
            else:
                parent[name] = value
            at = _SPACE.match(text, at).end()
            c = text[at : at + 1]
            at += 1
            if c == ",":
                if name is not None:
                    name, at = _name(text, _SPACE.match(text, at).end())
                    open_[-1] = parent, name
                break
            if c != ("]" if name is None else "}"):
                raise ValueError(f"no end at {at}")
            value, _ = open_.pop()
        else:
            return value, at


def _name(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = json.decoder.scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return name, at + 1


def usable(raw: str | None) -> dict | None:
    """The one complete JSON object that raw holds: alone, amid other text or fences, or written as a JSON string.

    Text cut off inside the object, other JSON values and texts with two different objects give None.
    """
    for _ in range(8):
        if raw is None:
            return None
        try:
            value = decoded(raw.strip())
        except ValueError:
            break
        if isinstance(value, dict):
            return value
        if not isinstance(value, str):
            return None
        raw = value
    else:
        return None
    found, at = None, 0
    while start := _START.search(raw, at):
        try:
            value, at = decoded(raw, start.start())
        except ValueError:
            return found
        if found is not None and Merkle().identity(value)[0] != Merkle().identity(found)[0]:
            return None
        found = value
    if found is None and (start := raw.find('"{')) >= 0:
        try:
            return usable(decoded(raw, start)[0])
        except ValueError:
            return None
    return found


def opened(value):
    """The object or array that a string holds, else the value itself."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            inner = decoded(value.strip())
        except ValueError:
            return value
        value = inner
    return value


class Merkle:
    """Identities of values. ``new`` takes each identity once, with its row and bridge rows.

    What is being hashed stands on a stack, so values may be nested to any depth.
    """

    def __init__(self):
        self.known: dict[str, int] = {}
        self.new: list[tuple[str, str, int, list[tuple[str, str | None, str | None]]]] = []
        self.leapt: set[str] = set()
        self.leaps: list[tuple[str, str, str | None]] = []

    def identity(self, value, occurs: bool = False) -> tuple[str | None, str | None, int]:
        """(identity of a container or None, text of a scalar or None, height). ``occurs``: the value is one whose leaves
        may be wanted."""
        value = opened(value)
        if not isinstance(value, (dict, list)):
            return None, None if value is None else json.dumps(value, ensure_ascii=False), 0
        stack = [self._frame(value)]
        while True:
            kind, members, below, height, deep = stack[-1]
            if len(below) < len(members):
                name, inner = members[len(below)]
                inner = opened(inner)
                if isinstance(inner, (dict, list)):
                    stack.append(self._frame(inner))
                    continue
                below.append((name, None, None if inner is None else json.dumps(inner, ensure_ascii=False)))
                continue
            form = json.dumps([kind == "object", below], ensure_ascii=False)
            own = hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            height += 1
            if own not in self.known:
                self.known[own] = height
                self.new.append((own, kind, height, below))
            stack.pop()
            leaps = self._leaps(own, height, below, deep, occurs and not stack)
            if not stack:
                return own, None, height
            above = stack[-1]
            name = above[1][len(above[2])][0]
            above[2].append((name, own, None))
            above[3] = max(above[3], height)
            if height > LOW:
                above[4][name] = leaps

    @staticmethod
    def _frame(value) -> list:
        """[kind, members, what is known of them, greatest height of a member, leaps of high members]"""
        members = sorted(value.items()) if isinstance(value, dict) else [(str(i), x) for i, x in enumerate(value)]
        return ["object" if isinstance(value, dict) else "array", members, [], 0, {}]

    def _leaps(self, own: str, height: int, below: list, deep: dict, occurs: bool) -> list[tuple[list, str | None]]:
        """What a high object leads to without passing another multiple of LEAP: (names from the innermost on, identity or
        None for a leaf). A multiple of LEAP leads its holder just to itself."""
        if height <= LOW:
            return []
        own_leaps = []
        for name, child, scalar in below:
            if name in deep:
                own_leaps += [([*names, name], end) for names, end in deep[name]] if len(deep[name]) > 1 else [(names.append(name) or names, end) for names, end in deep[name]]
            elif child is not None or scalar is not None:
                own_leaps.append(([name], child))
        if (occurs or height % LEAP == 0) and own not in self.leapt:
            self.leapt.add(own)
            self.leaps += [(own, "/".join(names[::-1]), end) for names, end in own_leaps]
        return [([], own)] if height % LEAP == 0 else own_leaps


STORED = "tag string, object_id string, kind string, height int, ordinal int, member string, child_id string, scalar string, recipe_id string, attempt int, child_seq int, status string"


def flatten_responses(responses: DataFrame) -> dict[str, DataFrame]:
    """responses(recipe_id, attempt, raw) -> objects, bridges, leaps, occurrences, records.

    objects(object_id, kind, height, n_occurrences), bridges(object_id, ordinal, member, child_id, scalar): a member that is
    null has neither child_id nor scalar; leaps(object_id, path, child_id), see LEAP, child_id being null for a leaf;
    occurrences(recipe_id, attempt, child_seq, member, object_id, scalar): one for each ``ingredient`` and operation
    ``params`` of the elements of ``nodes``; records(recipe_id, attempt, status): usable, unusable (no whole object in raw),
    no_nodes (no array of nodes in it) or no_text. Rows without recipe_id give nothing; copies count once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merkle = Merkle()
        columns = [c.split(" ")[0] for c in STORED.split(", ")]
        types = [{"int": pa.int32()}.get(c.split(" ")[1], pa.string()) for c in STORED.split(", ")]
        for batch in batches:
            rows = []
            for rid, attempt, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                whole = usable(raw)
                nodes = opened((whole or {}).get("nodes"))
                status = "no_text" if raw is None else "unusable" if whole is None else "usable" if isinstance(nodes, list) else "no_nodes"
                rows.append(("record", None, None, None, None, None, None, None, rid, attempt, None, status))
                for seq, node in enumerate(nodes if isinstance(nodes, list) else ()):
                    node = opened(node)
                    if not isinstance(node, dict):
                        continue
                    operation = opened(node.get("operation"))
                    for member, value in (("ingredient", node.get("ingredient")), ("params", operation.get("params") if isinstance(operation, dict) else None)):
                        own, scalar, _ = merkle.identity(value, True)
                        if own is not None or scalar is not None:
                            rows.append(("occurrence", own, None, None, None, member, None, scalar, rid, attempt, seq, None))
                for own, kind, height, below in merkle.new:
                    rows.append(("object", own, kind, height, *[None] * 8))
                    rows += [("bridge", own, None, height, i, k, child, scalar, *[None] * 4) for i, (k, child, scalar) in enumerate(below)]
                rows += [("leap", own, None, LOW + 1, None, path, child, None if child else "", *[None] * 4) for own, path, child in merkle.leaps]
                merkle.new.clear()
                merkle.leaps.clear()
                if len(merkle.known) > REMEMBERED:
                    merkle.known.clear()
                    merkle.leapt.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=columns)

    unique = spread(responses.where("recipe_id IS NOT NULL").select(key("recipe_id").alias("recipe_id"), F.col("attempt").cast("int"), "raw"))
    stored = written(unique.mapInArrow(parse, STORED), "merkle")
    occurrences = stored.where("tag = 'occurrence'").select("recipe_id", "attempt", "child_seq", "member", "object_id", "scalar").distinct()
    counts = occurrences.where("object_id IS NOT NULL").groupBy("object_id").agg(F.count("*").alias("n_occurrences"))
    objects = stored.where("tag = 'object'").groupBy("object_id").agg(*(F.first(c).alias(c) for c in ("kind", "height")))
    return {
        "objects": objects.join(counts, "object_id", "left").fillna(0, ["n_occurrences"]),
        "bridges": stored.where("tag = 'bridge'").select("object_id", "ordinal", "member", "child_id", "scalar").distinct(),
        "leaps": stored.where("tag = 'leap'").select("object_id", F.col("member").alias("path"), "child_id").distinct(),
        "occurrences": occurrences,
        "records": stored.where("tag = 'record'").select("recipe_id", "attempt", "status").distinct(),
        "stored": stored,
    }


def flatten_layer1(layer1: DataFrame) -> dict[str, DataFrame]:
    """Current rows -> objects, bridges, texts, occurrences, as for responses, by built-in functions: the arrays are flat.

    objects(object_id, kind, height, n_occurrences): each distinct array of texts once; bridges(object_id, ordinal, member,
    child_id): its elements, child_id being the identity of the text and null for a null; texts(child_id, scalar): each
    distinct text once, blank ones too; occurrences(id, member, object_id): one for each array that isn't null.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("member"), F.col(f"{c}.text").alias("texts")) for c in ("ingredients", "instructions")))).alias("m")
    now = current(layer1.select("id", "ingredients", "instructions", "loaded_at"))
    arrays = now.select("id", each).select("id", "m.member", "m.texts").where("texts IS NOT NULL")
    hashed = arrays.withColumn("below", F.transform("texts", lambda x: F.unhex(F.md5(x))))
    own = F.md5(F.array_join(F.transform("below", lambda h: F.coalesce(F.hex(h), F.lit("-"))), ","))
    stored = written(hashed.select("id", "member", own.alias("object_id"), "below"), "layer1")
    once = stored.groupBy("object_id").agg(F.first("below").alias("below"), F.count("*").alias("n_occurrences"))
    return {
        "objects": once.select("object_id", F.lit("array").alias("kind"), F.lit(1).alias("height"), "n_occurrences"),
        "bridges": once.select("object_id", F.posexplode("below").alias("ordinal", "child_id")).select("object_id", "ordinal", F.col("ordinal").cast("string").alias("member"), "child_id"),
        "texts": arrays.select(F.explode("texts").alias("scalar")).where("scalar IS NOT NULL").distinct().select(F.unhex(F.md5("scalar")).alias("child_id"), "scalar"),
        "occurrences": stored.select("id", "member", "object_id"),
    }


def walked_down(stored: DataFrame) -> DataFrame:
    """(object_id, path): the scalar leaves below each distinct object that occurs, found over the bridge rows.

    The front holds (occurring object, object reached, path to it). Each round joins it with the bridges; members that are
    scalars are leaves, the others the next front. There are as many rounds as the objects are high, above LOW one for LEAP.
    """
    hops = stored.where(f"tag = 'bridge' AND height <= {LOW} AND (child_id IS NOT NULL OR scalar IS NOT NULL) OR tag = 'leap'")
    n = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hops = hops.select(F.col("object_id").alias("at"), F.col("member").alias("step"), "child_id").repartition(n, "at").distinct()  # one shuffle, for all rounds
    front = stored.where("tag = 'occurrence' AND object_id IS NOT NULL").select(F.col("object_id").alias("at")).distinct().select(F.col("at").alias("object_id"), "at", F.lit(None).cast("string").alias("path"))
    height = stored.where("tag = 'object'").agg(F.max("height")).first()[0] or 0
    rounds = min(height, LOW) + (-(-(height - LOW) // LEAP) + 1 if height > LOW else 0)
    leaves = []
    for k in range(rounds):
        reached = front.join(hops, "at").select("object_id", F.concat_ws("/", "path", "step").alias("path"), "child_id")
        if k and k % ROUNDS == 0:
            reached = written(reached, "front")
        leaves.append(reached.where("child_id IS NULL").select("object_id", "path"))
        front = reached.where("child_id IS NOT NULL").select("object_id", F.col("child_id").alias("at"), "path")
    return reduce(DataFrame.unionByName, leaves) if leaves else front.select("object_id", "path")


def leaves(responses: DataFrame) -> DataFrame:
    """(recipe_id, attempt, child_seq, path): the scalar leaves of every occurrence. They are found once for each distinct
    object and joined to the places where it occurs; an object that very many nodes share is a skewed join key, which
    adaptive execution splits."""
    stored = flatten_responses(responses)["stored"]
    below = walked_down(stored).groupBy("object_id").agg(F.collect_list("path").alias("paths"))
    places = stored.where("tag = 'occurrence'").select("recipe_id", "attempt", "child_seq", "member", "object_id")
    scalars = places.where("object_id IS NULL").select("recipe_id", "attempt", "child_seq", F.col("member").alias("path"))
    deep = places.join(below, "object_id").select("recipe_id", "attempt", "child_seq", "member", F.explode("paths").alias("p"))
    return scalars.unionByName(deep.select("recipe_id", "attempt", "child_seq", F.concat_ws("/", "member", "p").alias("path"))).distinct()


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Texts of current layer1 rows and scalar leaves of the responses, each with its record and place."""
    flat = flatten_layer1(table(spark, sf_dir, "layer1"))
    texts = flat["occurrences"].join(flat["bridges"].where("child_id IS NOT NULL").select("object_id", "ordinal"), "object_id")
    texts = texts.select(F.lit("layer1").alias("src_table"), F.col("id").alias("record_key"), F.lit(0).alias("attempt"), F.col("ordinal").alias("child_seq"), F.col("member").alias("path"))
    deep = leaves(table(spark, sf_dir, "responses"))
    return texts.unionByName(deep.select(F.lit("responses").alias("src_table"), F.col("recipe_id").alias("record_key"), "attempt", "child_seq", "path"))


def p2_objects(spark, sf_dir: str) -> DataFrame:
    """Each distinct object or array of the responses once, with its height, members and occurrences."""
    flat = flatten_responses(table(spark, sf_dir, "responses"))
    members = flat["bridges"].groupBy("object_id").agg(F.count("*").alias("n_members"))
    return flat["objects"].join(members, "object_id", "left").select("object_id", "kind", "height", F.coalesce("n_members", F.lit(0)).alias("n_members"), "n_occurrences")


def p2_records(spark, sf_dir: str) -> DataFrame:
    """Each response with whether it could be taken apart."""
    return flatten_responses(table(spark, sf_dir, "responses"))["records"]


_READ = r"""WITH RECURSIVE asked AS (SELECT *, row_number() OVER () AS n FROM (SELECT DISTINCT lower(trim(recipe_id, ' ')) AS rid, attempt, trim(raw, E' \t\r\n') AS t FROM responses WHERE recipe_id IS NOT NULL)),
unwrapped AS (SELECT n, t, 0 AS k FROM asked UNION ALL
  SELECT n, trim(TRY_CAST(t AS JSON) ->> '$', E' \t\r\n'), k + 1 FROM unwrapped WHERE k < 8 AND json_type(TRY_CAST(t AS JSON)) = 'VARCHAR'),
bare AS (SELECT n, arg_max(t, k) AS t FROM unwrapped GROUP BY n),
found AS (SELECT n, t, regexp_extract(t, '(?s)\{\s*["}].*\}') AS o, regexp_extract(t, '(?s)"\{.*\}"') AS s FROM bare),
whole AS (SELECT n, CASE WHEN TRY_CAST(t AS JSON) IS NOT NULL THEN CASE json_type(TRY_CAST(t AS JSON)) WHEN 'OBJECT' THEN TRY_CAST(t AS JSON) END
  WHEN o <> '' THEN TRY_CAST(o AS JSON) ELSE TRY_CAST((TRY_CAST(s AS JSON) ->> '$') AS JSON) END AS j FROM found),
listed AS (SELECT n, CASE WHEN json_type(j, '$.nodes') = 'VARCHAR' THEN TRY_CAST((j ->> '$.nodes') AS JSON) ELSE j -> '$.nodes' END AS nodes FROM whole WHERE j IS NOT NULL)
"""
_WALK = r""", elements AS (SELECT n, unnest(range(len(l))) AS seq, unnest(l) AS node FROM (SELECT n, from_json(nodes, '["JSON"]') AS l FROM listed WHERE json_type(nodes) = 'ARRAY')),
opened AS (SELECT n, seq, CASE WHEN json_type(node) = 'VARCHAR' THEN TRY_CAST((node ->> '$') AS JSON) ELSE node END AS node FROM elements),
parts AS (SELECT n, seq, node, CASE WHEN json_type(node, '$.operation') = 'VARCHAR' THEN TRY_CAST((node ->> '$.operation') AS JSON) ELSE node -> '$.operation' END AS op FROM opened WHERE json_type(node) = 'OBJECT'),
walk AS (
  SELECT n, seq, 'ingredient' AS path, node -> '$.ingredient' AS v FROM parts UNION ALL
  SELECT n, seq, 'params', op -> '$.params' FROM parts UNION ALL
  SELECT n, seq, path || e.step, e.v FROM (SELECT n, seq, path, unnest(CASE json_type(v)
      WHEN 'OBJECT' THEN [{'step': '/' || x.key, 'v': x.value} FOR x IN map_entries(CAST(v AS MAP(VARCHAR, JSON)))]
      WHEN 'ARRAY' THEN [{'step': '/' || (i - 1), 'v': x} FOR x, i IN from_json(v, '["JSON"]')]
      WHEN 'VARCHAR' THEN CASE WHEN json_type(TRY_CAST((v ->> '$') AS JSON)) IN ('OBJECT', 'ARRAY') THEN [{'step': '', 'v': TRY_CAST((v ->> '$') AS JSON)}] END END) AS e FROM walk)),
leaf AS (SELECT DISTINCT n, seq, path FROM walk WHERE json_type(v) NOT IN ('NULL', 'OBJECT', 'ARRAY') AND NOT (json_type(v) = 'VARCHAR' AND coalesce(json_type(TRY_CAST((v ->> '$') AS JSON)) IN ('OBJECT', 'ARRAY'), false)))
"""
SQL = {
    "p2_found": _READ + _WALK + r"""SELECT 'layer1' AS src_table, id AS record_key, 0 AS attempt, i - 1 AS child_seq, path FROM (
  SELECT id, path, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT id, unnest(['ingredients', 'instructions']) AS path, unnest([ingredients, instructions]) AS l FROM (
    SELECT lower(trim(id, ' ')) AS id, ingredients, instructions FROM layer1 WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(id, ' ')) ORDER BY loaded_at DESC) = 1))) WHERE x.text IS NOT NULL
UNION ALL SELECT DISTINCT 'responses', rid, attempt, seq, path FROM leaf JOIN asked USING (n)""",
    "p2_records": _READ + """SELECT DISTINCT rid AS recipe_id, attempt,
  CASE WHEN asked.t IS NULL THEN 'no_text' WHEN j IS NULL THEN 'unusable' WHEN json_type(nodes) = 'ARRAY' THEN 'usable' ELSE 'no_nodes' END AS status
FROM asked LEFT JOIN whole USING (n) LEFT JOIN listed USING (n)""",
}
