"""Walks over process graphs: order, levels and reachability of all graphs of an Arrow batch at once.

Built-in array functions can state these fixpoints, but each step copies and rescans the whole graph. Here the graphs of a
batch are one large graph in NumPy arrays, and a step touches only the edges at its front, so the work grows with nodes
and edges. No shuffle, no state, and rows stay independent, so the functions run on streams as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

_LEAST = np.iinfo(np.int64).min


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same for the next."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Batch:
    """The graphs of a batch: count[g] nodes each, numbered from first[g]; edges s -> d with their place q."""

    def __init__(self, n: pa.Array, edges: pa.Array):
        self.count = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.total = int(self.first[-1])
        self.graph = np.repeat(np.arange(len(self.count)), self.count)
        lengths = np.where(self.count > 0, edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        rows = edges.filter(pa.array(self.count > 0)).flatten()
        column = lambda name, none: pc.struct_field(rows, name).cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False)
        shift = np.repeat(self.first[:-1], lengths)
        self.s, self.d, self.q = column("s", -1) + shift, column("d", -1) + shift, column("q", _LEAST)

    def by(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges sorted by that end, where those of each node start)."""
        order = np.argsort(end, kind="stable")
        return order, np.searchsorted(end[order], np.arange(self.total + 1))

    def lists(self, graph: np.ndarray, values: np.ndarray) -> pa.ListArray:
        """One list of int per graph; graph is ascending."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(graph, np.arange(len(self.count) + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def ordered(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(rank, level) of each node in FIFO topological order, -1 on or behind a cycle: level by level the nodes whose
    predecessors all stand, by the last of these to stand and the place of the edge from it."""
    out, start = batch.by(batch.s)
    waiting = np.bincount(batch.d, minlength=batch.total)
    rank, level = np.full(batch.total, -1), np.full(batch.total, -1)
    placed, depth = np.zeros(len(batch.count), np.int64), 0
    front = np.flatnonzero(waiting == 0)
    while len(front):
        g = batch.graph[front]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(begin, len(g)))
        rank[front] = placed[g] + np.arange(len(g)) - np.repeat(begin, sizes)
        placed[g[begin]] += sizes
        level[front] = depth
        depth += 1
        e = out[spans(start[front], start[front + 1] - start[front])]
        np.subtract.at(waiting, batch.d[e], 1)
        e = e[waiting[batch.d[e]] == 0]
        e = e[np.lexsort((batch.q[e], rank[batch.s[e]], batch.d[e]))]
        e = e[np.append(batch.d[e][1:] != batch.d[e][:-1], True)[: len(e)]]
        front = batch.d[e[np.lexsort((batch.d[e], batch.q[e], rank[batch.s[e]], batch.graph[batch.d[e]]))]]
    return rank, level


def unheated(batch: Batch, heats: np.ndarray, output: np.ndarray) -> np.ndarray:
    """Which nodes lead to their graph's output (a position, -1 for none) through nodes that don't heat."""
    into, start = batch.by(batch.d)
    seen = np.zeros(batch.total, bool)
    front = (batch.first[:-1] + output)[output >= 0]
    seen[front] = True
    while len(front):
        front = batch.s[into[spans(start[front], start[front + 1] - start[front])]]
        front = np.unique(front[~seen[front] & ~heats[front]])
        seen[front] = True
    return seen


def following(batch: Batch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which start, node) for every node that a way leads to from a start; a start itself only if it is on a cycle."""
    out, start = batch.by(batch.s)
    own = batch.graph[starts]
    base = np.concatenate([[0], np.cumsum(batch.count[own])])
    seen = np.zeros(int(base[-1]), bool)
    who, at = np.arange(len(starts)), starts
    while len(at):
        lengths = start[at + 1] - start[at]
        at, who = batch.d[out[spans(start[at], lengths)]], np.repeat(who, lengths)
        places = base[who] + at - batch.first[own[who]]
        places = np.unique(places[~seen[places]])
        seen[places] = True
        who = np.searchsorted(base, places, "right") - 1
        at = places - base[who] + batch.first[own[who]]
    places = np.flatnonzero(seen)
    who = np.searchsorted(base, places, "right") - 1
    return who, places - base[who] + batch.first[own[who]]


@F.arrow_udf(StructType([StructField("topo", ArrayType(IntegerType())), StructField("levels", ArrayType(IntegerType()))]))
def order_of(n: pa.Array, edges: pa.Array) -> pa.Array:
    """Positions in topological order with their levels; nodes on or behind a cycle are missing. n null or 0: none."""
    batch = Batch(n, edges)
    rank, level = ordered(batch)
    there = np.flatnonzero(rank >= 0)
    there = there[np.lexsort((rank[there], batch.graph[there]))]
    g = batch.graph[there]
    return pa.StructArray.from_arrays([batch.lists(g, there - batch.first[g]), batch.lists(g, level[there])], names=["topo", "levels"])


_AFTER = StructType([StructField("plate", IntegerType()), StructField("after", ArrayType(IntegerType()))])


@F.arrow_udf(StructType([StructField("cyclic", BooleanType()), StructField("unheated", ArrayType(IntegerType())), StructField("after_plates", ArrayType(_AFTER))]))
def walked(n: pa.Array, edges: pa.Array, forward: pa.Array, heats: pa.Array, output: pa.Array, plates: pa.Array) -> pa.Array:
    """Whether there is a cycle (no graph with ``forward`` is looked at for that), the nodes that lead to the output without
    heat (output -1: none), and each plate with the nodes after it."""
    batch = Batch(n, edges)
    stuck = np.zeros(len(n), bool)
    ahead = forward.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    if not ahead.all():
        keep = pa.array(~ahead)
        part = Batch(n.filter(keep), edges.filter(keep))
        rank, _ = ordered(part)
        stuck[~ahead] = np.bincount(part.graph, rank < 0, len(part.count)) > 0
    hot = np.zeros(batch.total, bool)
    hot[:] = heats.flatten().fill_null(False).to_numpy(zero_copy_only=False)
    seen = np.flatnonzero(unheated(batch, hot, output.to_numpy(zero_copy_only=False).astype(np.int64)))
    sizes = plates.value_lengths().to_numpy(zero_copy_only=False)
    at = plates.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = at + np.repeat(batch.first[:-1], sizes)
    who, node = following(batch, starts)
    after = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(starts) + 1)).astype(np.int32)), pa.array((node - batch.first[batch.graph[node]]).astype(np.int32)))
    pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), after], names=["plate", "after"])
    by_graph = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)
    g = batch.graph[seen]
    return pa.StructArray.from_arrays([pa.array(stuck), batch.lists(g, seen - batch.first[g]), by_graph], names=["cyclic", "unheated", "after_plates"])
