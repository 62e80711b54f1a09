import random

import numpy as np
import pytest

from potflow.llm import leakage


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        pattern, text = ([rng.randint(1, 4) for _ in range(rng.randint(1, n))] for n in (20, 30))
        masks = {}
        for i, p in enumerate(pattern):
            masks[p] = masks.get(p, 0) | 1 << i
        assert leakage.myers(masks, len(pattern), text) == edit_distance_in(pattern, text)
    for length, room in ((1, 3), (13, 15), (63, 70)):
        patterns, texts = ([[rng.randint(1, 4) for _ in range(k)] for _ in range(60)] for k in (length, room))
        got = leakage.myers_all(np.array(patterns, np.uint64), np.array(texts, np.uint64)).tolist()
        assert got == [edit_distance_in(p, t) for p, t in zip(patterns, texts)]


@pytest.mark.parametrize("window", [5, 13, 20])
@pytest.mark.parametrize("errors", [0, 1, 2])
def test_every_window_holds_enough_pieces(window, errors):
    p = leakage.piece_length(window, errors)
    for start in range(p):
        first = (p - start) % p
        assert (window - first) // p >= errors + 1 or p == 1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, distance string")


@pytest.mark.parametrize("together", [200_000, 7])
def test_leaks_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(leakage, "TOGETHER", together)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([9, 13, 14, 40])))) for i in range(25)]
    items.append((99, items[4][1]))
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=20)
        if d % 2:
            source = rng.choice(items)[1].split()
            at = rng.randint(0, max(0, len(source) - 13))
            part = source[at : at + rng.choice([11, 12, 13, 15])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["new"], [part[k], "more"]])
            words[10:10] = part
        docs.append((d, " ".join(words), "x"))
    for errors in (0, 1):
        got = {(r.doc_id, r.item_id): (r.distance, r.n_windows) for r in leakage.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 13, errors).collect()}
        want = {}
        for d, text, _ in docs:
            for i, item in items:
                w = item.split()
                best = [edit_distance_in(w[k : k + 13], text.split()) for k in range(len(w) - 12)]
                if best and min(best) <= errors:
                    want[d, i] = (min(best), sum(x <= errors for x in best))
        assert got == want and want


def test_found(spark, save):
    item = "Answer this: how many grams of tamari must Brudra weigh if one tin holds only 18 portions of it"
    body = "how many grams of <b>tamari</b> must&nbsp;Brudra​ weigh, IF one\ntin holds"
    docs = [(1, body + " only", "x"), (1, body + " only", "x"), (2, body, "x"), (3, body + " but only", "x"), (4, None, "x"), (5, "", "x"), (6, "word " * 200_000 + body + " only", "x")]
    items = spark.createDataFrame([(7, "t", item, "a"), (8, "t", "too short", "a"), (9, "t", None, "a")], "item_id long, task string, text string, answer string")
    folder = save(documents=documents(spark, docs), eval_items=items)
    assert [tuple(r) for r in leakage.p8_found(spark, folder).orderBy("doc_id").collect()] == [(1, 7), (6, 7)]
    assert {r.item_id: (r.n_docs_exact, r.n_docs_near) for r in leakage.p8_items(spark, folder).collect()} == {7: (2, 2), 8: (0, 0), 9: (0, 0)}
    folder = save(documents=documents(spark, docs), eval_items=items.limit(0))
    assert leakage.p8_found(spark, folder).count() == 0 and leakage.p8_items(spark, folder).count() == 0
    assert leakage.p8_found(spark, save(documents=documents(spark, []), eval_items=items)).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS", 2)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(15))) for i in range(7)]
    docs = documents(spark, [(i, text, "x") for i, text in items])
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(7)}


def test_windows_longer_than_a_word_of_bits(spark):
    item = " ".join(f"w{i}" for i in range(100))
    changed = item.replace("w50 ", "other ")
    docs = documents(spark, [(1, "x " + item, "x"), (2, changed + " y", "x"), (3, item[:200], "x")])
    got = {(r.doc_id, r.distance) for r in leakage.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), 90, 1).collect()}
    assert got == {(1, 0), (2, 1)}


def test_an_opening_that_all_items_and_documents_share(spark):
    """Every document holds a piece of every item: equal windows are verified once, and the work stays small."""
    import time

    opening = "answer this question with care and give all of the steps that lead"
    items = [(i, f"{opening} to number {i} at once") for i in range(300)]
    docs = documents(spark, [(d, f"{opening} {'to number 7 at' if d % 100 == 0 else 'away'} x{d}", "x") for d in range(2_000)])
    began = time.time()
    found = leakage.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), errors=0)
    assert found.count() == 2_000 * 300 and found.where("item_id = 7 AND doc_id = 100 AND n_windows = 5").count() == 1 and time.time() - began < 60
