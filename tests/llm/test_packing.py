import random
from collections import Counter
from functools import lru_cache

import pytest

from potflow.llm import packing


def check(counts, capacity, packed):
    used = Counter()
    for times, sizes in packed:
        assert times > 0 and sum(sizes) <= capacity
        for s in sizes:
            used[s] += times
    assert used == Counter({s: c for s, c in counts.items() if c})


@pytest.mark.parametrize("seed", range(30))
def test_packs_each_item_once_and_well(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 100, 2048])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 60, 400])))
    packed, fixed = packing.pack(dict(counts), capacity)
    check(counts, capacity, packed)
    n, least = sum(k for k, _ in packed), -(-sum(s * c for s, c in counts.items()) // capacity)
    assert fixed <= n and n <= max(least, 11 * least / 9 + 2)


def optimum(sizes, capacity):
    @lru_cache(None)
    def best(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        found = 99
        for mask in range(1 << len(others)):
            inside = [others[i] for i in range(len(others)) if mask >> i & 1]
            if first + sum(inside) <= capacity:
                found = min(found, 1 + best(tuple(others[i] for i in range(len(others)) if not mask >> i & 1)))
        return found

    return best(tuple(sorted(sizes, reverse=True)))


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 13, 20])
    sizes = [rng.randint(2, capacity) for _ in range(9)]
    items = packing.Sizes(Counter(sizes))
    fixed = packing.reduce_sizes(items, capacity)
    rest = [s for s, c in items.n.items() for _ in range(c)]
    assert sum(n for n, _ in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)


def test_many_equal_items_stay_few_patterns():
    counts = {700: 3_000_000_000, 650: 10**9, 3: 7, 1: 10**10}
    packed, _ = packing.pack(counts, 2048)
    check(counts, 2048, packed)
    assert len(packed) < 50


def test_containers(spark, save):
    texts = [(i, " ".join(["soup"] * (1 + i * 37 % 900)), "x") for i in range(150)] + [(1000, "stir " * 5000, "x"), (1001, None, "x"), (1002, "", "x"), (1003, " \n", "x"), (5, "copy", "x"), (5, "copy", "x"), (None, "x", "x")]
    folder = save(documents=spark.createDataFrame(texts, "doc_id long, text string, rank string"))
    rows = packing.p7_containers(spark, folder).collect()
    load = Counter()
    for r in rows:
        load[r.container_id] += r.n_tokens
    assert max(load.values()) <= 2048 and set(load) == set(range(len(load)))
    parts = sorted((r.part, r.n_tokens) for r in rows if r.doc_id == 1000)
    assert [n for _, n in parts[:-1]] == [2048] * (len(parts) - 1) and len(parts) > 2
    assert len(rows) == 150 + len(parts) + 3 and not {1001, 1002, 1003} & {r.doc_id for r in rows}
    report = packing.p7_report(spark, folder).first()
    assert report.n_containers == len(load) and report.n_items == len(rows) and report.lower_bound <= len(load)
    empty = save(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert packing.p7_containers(spark, empty).count() == 0 and packing.p7_report(spark, empty).first().n_containers == 0


def test_ranks_of_one_size_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    sizes = spark.range(1000).selectExpr("id AS doc_id", "0 AS part", "1000 AS n_tokens")
    load = Counter(r.container_id for r in packing.containers(sizes).collect())
    assert len(load) == 500 and set(load.values()) == {2}
