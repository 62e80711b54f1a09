"""Passages of held-out items inside a collection of documents.

A passage is a window of ``window`` consecutive words of an item; it leaks into a document that holds it with at most
``errors`` word edits. Items are cut into pieces so short that a leaked window, whatever its place, holds errors + 1
whole pieces; by the pigeonhole principle one of them is untouched, so every leak shows as an exact piece hit. Hits are
verified with Myers' bit-parallel edit distance over words. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.functions.text import plain
from potflow.llm.hashing import WordHashes
from potflow.llm.shipping import Shipped
from potflow.sources.tables import spread, table

#: Items, and characters of items, that are looked for in one pass over the documents; more make more passes.
ITEMS, CHARACTERS = 20_000, 16_000_000
#: Windows that are verified at once.
TOGETHER = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def piece_length(window: int, errors: int) -> int:
    """Greatest p such that any window of an item contains errors + 1 whole pieces of its cut into p words."""
    return max(1, (window + 1) // (errors + 2))


def myers(masks: dict[int, int], length: int, text: list[int]) -> int:
    """Least number of edits with which a pattern of ``length`` symbols occurs in text. masks: symbol -> its places."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = full, 0, length, length
    for symbol in text:
        eq = masks.get(symbol, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(across | up) & full), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        eq |= down
        up, down = minus | (~(eq | plus) & full), plus & eq
        if score < best:
            best = score
    return best


def piece_keys(words: np.ndarray, p: int) -> np.ndarray:
    """A key for each run of p words."""
    key = np.zeros(max(0, len(words) - p + 1), np.uint64)
    for k in range(p):
        key = (key ^ words[k : k + len(key)]) * _FACTOR
        key ^= key >> np.uint64(32)
    return key


def myers_all(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """myers for each row of patterns (at most 63 symbols) in the same row of texts, all rows at once."""
    n, length = patterns.shape
    full, top, one = np.uint64((1 << length) - 1), np.uint64(length - 1), np.uint64(1)
    up, down = np.full(n, full), np.zeros(n, np.uint64)
    score = np.full(n, length, np.int64)
    best = score.copy()
    for symbol in texts.T:
        eq = np.zeros(n, np.uint64)
        for i in range(length):
            eq |= (patterns[:, i] == symbol).astype(np.uint64) << np.uint64(i)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(across | up) & full), up & across
        score += ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
        plus, minus = (plus << one) & full, (minus << one) & full
        eq |= down
        up, down = minus | (~(eq | plus) & full), plus & eq
        np.minimum(best, score, out=best)
    return best


def stretched(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number in it) for all numbers of ranges."""
    n = np.maximum(ends - starts, 0)
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - (np.cumsum(n) - n)[who] + starts[who]


class Pieces:
    """The pieces of items under their keys. Equal windows of different items are one window."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int, hashes: WordHashes | None = None):
        self.window, self.errors, self.p = window, errors, piece_length(window, errors)
        self.hashes = hashes or WordHashes()
        words, starts = self.hashes.of([plain(text or "") for _, text in items])
        lengths = np.diff(starts)
        long = np.flatnonzero(lengths >= window)
        self.ids = np.array([items[k][0] for k in long], np.int64)
        #: Where the windows of each item begin among all, and the number of each: equal ones have the same.
        self.first = np.concatenate([[0], np.cumsum(lengths[long] - window + 1)])
        who, at = stretched(starts[long], starts[long] + lengths[long] - window + 1)
        every = words[at[:, None] + np.arange(window)] if len(at) else np.zeros((0, window), np.uint64)
        self.windows, self.number = np.unique(every, axis=0, return_inverse=True)
        self.number = self.number.ravel()
        who, at = stretched(starts[long], starts[long] + lengths[long] - self.p + 1)
        inside = at - starts[long][who]
        own = inside % self.p == 0
        keys = piece_keys(words, self.p)[at[own]] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], who[own][order], inside[own][order]
        self.bits = max(16, int(32 * len(keys)).bit_length())
        self.sieve = np.zeros(1 << self.bits, bool)
        self.sieve[(self.keys >> np.uint64(64 - self.bits)).astype(np.intp)] = True

    def hits(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts with a piece, in order; places in words where they are). starts: where each text's words start. Most keys
        fall through a sieve with a bit for each piece; the others are looked up."""
        found = piece_keys(words, self.p)
        at = np.flatnonzero(self.sieve[(found >> np.uint64(64 - self.bits)).astype(np.intp)])
        low = np.searchsorted(self.keys, found[at])
        at = at[(low < len(self.keys)) & (self.keys[np.minimum(low, max(0, len(self.keys) - 1))] == found[at])] if len(self.keys) else at[:0]
        owner = np.searchsorted(starts, at, "right") - 1
        whole = at + self.p <= starts[owner + 1]
        return owner[whole], at[whole]

    def leaks(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item_id, least distance, number of windows with at most ``errors`` edits) of the texts that leak."""
        owner, at = self.hits(words, starts)
        keys = piece_keys(words, self.p)[at] if len(at) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        work = np.cumsum((high - low) * self.window)
        texts = np.flatnonzero(np.diff(owner, prepend=-1))  # whole texts are taken together, of about TOGETHER windows
        cuts = [0, *(int(texts[k]) for k in np.flatnonzero(np.diff(work[texts] // TOGETHER, prepend=-1)) if texts[k]), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield self._verified(words, starts, owner[a:b], at[a:b], low[a:b], high[a:b])

    def _verified(self, words, starts, owner, at, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hit, k = stretched(low, high)
        item, place = self.item[k], self.place[k]
        last = self.first[item + 1] - self.first[item] - 1
        which, start = stretched(np.maximum(0, place + self.p - self.window), np.minimum(place, last) + 1)
        text, item = owner[hit][which], item[which]
        where = at[hit][which] - place[which] + start  # where the window would stand if nothing were inserted before
        number = self.number[self.first[item] + start]
        # a window is verified once at a place, however many pieces and items lead to it
        once, back = np.unique(np.column_stack([where, number, text]), axis=0, return_inverse=True)
        distance = self._distances(words, starts, once)[back.ravel()]
        near = distance <= self.errors
        rows = np.column_stack([text[near], item[near], start[near], distance[near]])
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))[: len(rows)]]  # the least distance of each window
        ends = np.flatnonzero(np.append((rows[1:, :2] != rows[:-1, :2]).any(1), True)[: len(rows)])
        begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
        least = np.minimum.reduceat(rows[:, 3], begins) if len(begins) else rows[:, 3]
        return rows[begins, 0], self.ids[rows[begins, 1]], least, ends - begins + 1

    def _distances(self, words: np.ndarray, starts: np.ndarray, once: np.ndarray) -> np.ndarray:
        """The distances of windows at places: rows of once are (place, number of the window, text)."""
        out = np.zeros(len(once), np.int64)
        reach = np.arange(-self.errors, self.window + self.errors)
        for a in range(0, len(once), TOGETHER):
            where, number, text = once[a : a + TOGETHER].T
            at = where[:, None] + reach
            inside = (at >= starts[text][:, None]) & (at < starts[text + 1][:, None])
            around, own = words[np.clip(at, 0, len(words) - 1)], self.windows[number]
            if self.window < 64:
                out[a : a + TOGETHER] = myers_all(own, np.where(inside, around, _absent(own)[:, None]))
                continue
            for i, (pattern, symbols, there) in enumerate(zip(own.tolist(), around.tolist(), inside.tolist())):
                masks: dict[int, int] = {}
                for k, w in enumerate(pattern):
                    masks[w] = masks.get(w, 0) | 1 << k
                out[a + i] = myers(masks, self.window, [w for w, ok in zip(symbols, there) if ok])
        return out


def _absent(patterns: np.ndarray) -> np.ndarray:
    """For each row a symbol that isn't in it."""
    return patterns.max(1, initial=0) + np.uint64(1)


LEAKS = "doc_id long, item_id long, distance int, n_windows int"


def leaks(documents: DataFrame, items: DataFrame, window: int = 13, errors: int = 1) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> (doc_id, item_id, distance, n_windows).

    One row for each document row and item with a leaked window; distance is its least number of edits, 0 if the
    window stands there word for word; n_windows counts the item's windows that leak. Null and empty texts and items
    shorter than a window give nothing. Items are broadcast in blocks of ITEMS items and CHARACTERS characters, about.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "text").where("text IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(-(-n // ITEMS), -(-size // CHARACTERS))
    docs = spread(documents.where("text IS NOT NULL").select("doc_id", "text"))
    hashes = WordHashes()

    def one(block: DataFrame) -> DataFrame:
        shared = Shipped(spark, Pieces([tuple(r) for r in block.toLocalIterator()], window, errors, hashes))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = shared.load()
            for batch in batches:
                words, starts = pieces.hashes.of([plain(text) for text in batch.column(1).to_pylist()])
                for text, item, distance, n in pieces.leaks(words, starts):
                    columns = [batch.column(0).take(pa.array(text)), pa.array(item), pa.array(distance.astype(np.int32)), pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "n_windows"])

        return docs.mapInArrow(search, LEAKS)

    if not passes:
        return spark.createDataFrame([], LEAKS)
    blocks = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) for k in range(passes)]
    return reduce(DataFrame.unionByName, map(one, blocks))


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents with 13 consecutive words of an item: the leaks whose least distance is 0."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("distance = 0").select("doc_id", "item_id").distinct()


def p8_items(spark, sf_dir: str) -> DataFrame:
    """Each item with the number of documents that hold a window of it word for word, and with one word changed."""
    items = table(spark, sf_dir, "eval_items")
    found = leaks(table(spark, sf_dir, "documents"), items).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
    counts = found.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("n_docs_exact"), F.count_if(F.col("distance") > 0).alias("n_docs_near"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.select("item_id", "task").distinct().join(counts, "item_id", "left").select("item_id", "task", zero("n_docs_exact"), zero("n_docs_near"))
