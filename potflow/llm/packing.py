"""Texts in containers of fixed capacity with little unused room.

Sizes are whole numbers up to the capacity, so the whole instance is the number of texts of each size, however many
texts there are. The Martello-Toth reduction fixes containers on these numbers, many equal ones at a time; best fit,
largest first, places what is left. The result says, for each size, which of its texts by rank go to which container;
the texts find their rank without one task seeing all texts of a size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potflow.sources.tables import spread, table, written

CAPACITY = 2048
#: Texts of one size and bucket that are ranked in one task, about.
RANKED = 2_000_000


def token_sizes(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, part, n_tokens): non-blank texts, those longer than the capacity cut.

    tokenizer is the path of a ranks file of a byte-level BPE; by default the 50k one of public_tokenizers. Part k of a
    cut text holds its tokens from k * capacity on.
    """
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lines = f.read()  # goes with the tasks, so executors need no such file
    pattern = public_tokenizers.PATTERN

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text.strip():
                    n = len(encoding.encode_ordinary(text))
                    rows += [(doc, k, min(capacity, n - at)) for k, at in enumerate(range(0, n, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "part", "n_tokens"])

    return spread(documents.where("text IS NOT NULL").select("doc_id", "text")).mapInArrow(measure, "doc_id long, part int, n_tokens int")


class Sizes:
    """How many items there are of each size; largest and smallest at hand."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def without(self, size: int) -> list[tuple[int, int]]:
        return [(s, self.n[s] - (s == size)) for s in self.order]


def dominated(items: Sizes, size: int, capacity: int) -> list[int] | None:
    """The companions that some best packing gives an item of this size, or None if the reduction can't tell.

    With no other that fits: none. With one at most, or one that fills the container: the largest that fits. With two
    at most: the largest that fits if it is no smaller than any two that fit; or the fullest two, if the larger of them
    is the largest that fits and no two others that fit have a smaller one above the smaller of them.
    """
    rest = [(s, c) for s, c in items.without(size) if c and s <= capacity - size]
    if not rest:
        return []
    largest, room, fit = rest[-1][0], capacity - size, 0
    for s, c in rest:
        k = min(c, room // s)
        fit, room = fit + k, room - k * s
        if k < c or fit > 2:
            break
    if fit <= 1 or size + largest == capacity:
        return [largest]
    if fit > 2:
        return None
    room, best = capacity - size, None
    i, j = 0, len(rest) - 1
    while i <= j:
        a, b = rest[j][0], rest[i][0]
        if a + b > room or (i == j and rest[i][1] < 2):
            j -= 1
            continue
        if best is None or a + b >= best[0] + best[1]:
            best = (a, b)
        i += 1
    if best is None or largest >= best[0] + best[1]:
        return [largest]
    above = [s for s, c in items.without(size) for _ in range(min(2, c)) if s > best[1]][:2]
    if best[0] == largest and (len(above) < 2 or size + above[0] + above[1] > capacity):
        return list(best)
    return None


def reduce_sizes(items: Sizes, capacity: int) -> list[tuple[int, list[int]]]:
    """Containers that the reduction fixes, as (how many, sizes in each); the items are taken out."""
    fixed, changed = [], True
    while changed:
        changed = False
        for size in sorted(items.n, reverse=True):
            while items.n.get(size):
                companions = dominated(items, size, capacity)
                if companions is None:
                    break
                use = defaultdict(int)
                for s in (size, *companions):
                    use[s] += 1
                times = min(items.n[s] // k for s, k in use.items())
                fixed.append((times, [size, *companions]))
                for s, k in use.items():
                    items.take(s, k * times)
                changed = True
    return fixed


def best_fit(items: Sizes, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, largest first, all items of a size at once."""
    open_by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, sizes: list[int]) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((count, sizes))

    for size in sorted(items.n, reverse=True):
        left = items.n[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, left)
                bins = left // each
                put(capacity - each * size, bins, [size] * each)
                left -= bins * each
                continue
            room = rooms[at]
            count, sizes = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            each = min(room // size, left)
            bins = min(count, left // each)
            put(room - each * size, bins, sizes + [size] * each)
            if bins < count:
                put(room, count - bins, sizes)
            left -= bins * each
    return [x for group in open_by_room.values() for x in group]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, list[int]]], int]:
    """(containers as (how many, sizes in each), how many of them the reduction fixed)."""
    items = Sizes(counts)
    fixed = reduce_sizes(items, capacity)
    return fixed + best_fit(items, capacity), sum(n for n, _ in fixed)


def counts_of(sizes: DataFrame) -> dict[int, int]:
    """Items by size: at most one row per size up to the capacity, so it is small however many texts there are."""
    return {r["n_tokens"]: r["count"] for r in sizes.groupBy("n_tokens").count().collect()}


def containers(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sizes(doc_id, part, n_tokens) -> the same with container_id. No rows give no rows; equal rows stay apart."""
    sizes = written(sizes, "sizes")
    counts = counts_of(sizes)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for times, inside in pack(counts, capacity)[0]:
        for s in set(inside):
            each = inside.count(s)
            runs[s].append((used[s], first, each))
            used[s] += each * times
        first += times
    shared = sizes.sparkSession.sparkContext.broadcast({s: np.array(r, np.int64) for s, r in runs.items()})

    buckets = max(16, -(-max(counts.values(), default=0) // RANKED))
    keyed = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("n_tokens", "bucket").count().withColumn("skipped", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "part")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["n_tokens", "bucket"])
    ranked = ranked.select("doc_id", "part", "n_tokens", (F.col("own") + F.col("skipped")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own, run = size == s, runs[int(s)]
                k = np.searchsorted(run[:, 0], rank[own], "right") - 1
                out[own] = run[k, 1] + (rank[own] - run[k, 0]) // run[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["doc_id", "part", "n_tokens", "container_id"])

    return ranked.mapInArrow(place, "doc_id long, part int, n_tokens int, container_id long")


def p7_containers(spark, sf_dir: str) -> DataFrame:
    """Every non-blank text, or part of one longer than a container, with the container it goes to."""
    return containers(token_sizes(table(spark, sf_dir, "documents")))


def p7_report(spark, sf_dir: str) -> DataFrame:
    """Texts, tokens, containers, those that one full part fills, the others fixed by the reduction, the least number of
    containers that the tokens fill, unused share."""
    counts = counts_of(token_sizes(table(spark, sf_dir, "documents")))
    packed, fixed = pack(counts)
    tokens, n = sum(s * c for s, c in counts.items()), sum(k for k, _ in packed)
    full = counts.get(CAPACITY, 0)
    row = (sum(counts.values()), tokens, n, full, fixed - full, -(-tokens // CAPACITY), round(1 - tokens / (n * CAPACITY), 6) if n else 0.0)
    return spark.createDataFrame([row], "n_items long, n_tokens long, n_containers long, n_full long, n_reduced long, lower_bound long, unused_share double")
