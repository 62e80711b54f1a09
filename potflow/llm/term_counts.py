"""Frequencies of terms and n-grams over a collection by sorted suffixes.

Every position of a text gives the suffix that starts there, cut to ``length`` terms. Suffixes go to tasks by their
first term, are sorted in reverse lexicographic order there, and one pass with a stack adds up all prefixes: when a
prefix leaves the stack, all suffixes below it have been seen, so its counts are final.

Sets of records are kept as sums: while a record is read, each suffix carries, for each prefix length, 1 if the record
shows this prefix for the first time. These marks add up to the number of records, so suffixes can be combined before
the shuffle and no list of records travels. A first term with very many suffixes is spread by its second term, into parts
by their number; the one-term prefixes of its parts are added in a last small aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.functions.text import terms
from potflow.sources.tables import current, table, written

#: Combined suffixes of a first term that one task gets, about, and distinct suffixes a task combines before it hands them on.
SPREAD, COMBINED = 50_000, 300_000


def suffixes(records: DataFrame, length: int) -> DataFrame:
    """records(texts array<string>), one row per record -> (suffix, first, second, seen array<long>), combined.

    seen[0] counts occurrences, seen[k] records whose first occurrence of the k-term prefix is here. Null records and
    null texts count as empty.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([" ".join(s) for s in counts], pa.string()),
                    pa.array([s[0] for s in counts], pa.string()),
                    pa.array([s[1] if len(s) > 1 else "" for s in counts], pa.string()),
                    pa.array(list(counts.values()), pa.list_(pa.int64())),
                ],
                names=["suffix", "first", "second", "seen"],
            )
            counts.clear()
            return batch

        for batch in batches:
            for texts in batch.column(0).to_pylist():
                shown: set[tuple] = set()
                for text in texts or ():
                    ts = terms(text) if text else ()
                    for i in range(len(ts)):
                        suffix = tuple(ts[i : i + length])
                        seen = counts.get(suffix)
                        if seen is None:
                            seen = counts[suffix] = [0] * (length + 1)
                        seen[0] += 1
                        for k in range(len(suffix), 0, -1):
                            prefix = suffix[:k]
                            if prefix not in shown:
                                shown.add(prefix)
                                seen[k] += 1
                if len(counts) >= COMBINED:
                    yield flush()
        if counts:
            yield flush()

    return records.select("texts").mapInArrow(combine, "suffix string, first string, second string, seen array<long>")


def stacked(rows: Iterator[tuple[str, list[int]]]) -> Iterator[tuple[str, int, int, int]]:
    """(suffix, seen) in descending order -> (prefix, its length, occurrences, records), each prefix once."""
    path: list[str] = []
    sums: list[list[int]] = []

    def pop() -> tuple[str, int, int, int]:
        depth, own = len(path), sums.pop()
        gram = " ".join(path)
        path.pop()
        if sums:
            sums[-1] = [a + b for a, b in zip(sums[-1], own)]
        return gram, depth, own[0], own[depth]

    for suffix, seen in rows:
        ts = suffix.split(" ")
        same = 0
        while same < len(path) and same < len(ts) and path[same] == ts[same]:
            same += 1
        while len(path) > same:
            yield pop()
        for term in ts[same:]:
            path.append(term)
            sums.append([0] * len(seen))
        sums[-1] = [a + b for a, b in zip(sums[-1], seen)]
    while path:
        yield pop()


def ngram_counts(records: DataFrame, length: int) -> DataFrame:
    """records(texts array<string>) -> (term, n_terms, n_occurrences, n_records) of all n-grams of up to ``length``
    terms. N-grams don't cross texts. An empty collection gives no rows. Repeated records count each time."""

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, list[int]]]:
            for batch in batches:
                yield from zip(batch.column("suffix").to_pylist(), batch.column("seen").to_pylist())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                names=["term", "n_terms", "n_occurrences", "n_records"],
            )

        ready = []
        for row in stacked(rows()):
            ready.append(row)
            if len(ready) == 50_000:
                yield out(ready)
                ready = []
        if ready:
            yield out(ready)

    routed = suffixes(records, length).withColumn("_part", F.lit(0))
    if length > 1:  # a term alone is one suffix a task; what follows it can be anything
        routed = written(routed.drop("_part"), "suffixes")
        spread = routed.groupBy("first").count().where(F.col("count") > SPREAD).select("first", F.ceil(F.col("count") / SPREAD).alias("parts"))
        routed = routed.join(spread, "first", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("second"), "parts"), F.lit(0)))
    routed = routed.select("suffix", "first", "seen", "_part").repartition("first", "_part").sortWithinPartitions(F.desc("suffix"))
    parts = routed.select("suffix", "seen").mapInArrow(aggregate, "term string, n_terms int, n_occurrences long, n_records long")
    return parts.groupBy("term", "n_terms").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def recipe_texts(layer1: DataFrame) -> DataFrame:
    """Current recipes as records: all texts of ingredients and instructions."""
    none = F.array().cast("array<string>")
    texts = F.concat(F.coalesce(F.col("ingredients.text"), none), F.coalesce(F.col("instructions.text"), none))
    return current(layer1.select("id", "ingredients", "instructions", "loaded_at")).select("id", texts.alias("texts"))


def marked(counts: DataFrame, n_records, rare: int = 2, common: float = 0.35) -> DataFrame:
    """counts with mark: rare (in at most ``rare`` records), common (in more than the share ``common`` of all), else null."""
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * n_records, "common")
    return counts.withColumn("mark", mark)


def recipe_terms(spark, sf_dir: str, length: int = 2) -> DataFrame:
    """Marked n-gram counts of the current recipes. A recipe without texts counts among all recipes."""
    layer1 = table(spark, sf_dir, "layer1")
    total = layer1.where(F.col("id").isNotNull()).agg(F.count_distinct(F.lower(F.trim("id")))).scalar()
    return marked(ngram_counts(recipe_texts(layer1), length), total)


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common, from suffixes cut to one term."""
    return recipe_terms(spark, sf_dir, 1).where("mark IS NOT NULL").select("term", "mark")


def p1_terms(spark, sf_dir: str) -> DataFrame:
    """All n-grams of one or two terms with occurrences, records and mark."""
    return recipe_terms(spark, sf_dir)
