from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from potflow.functions.text import plain, terms, words
from potflow.llm import term_counts


def brute(records, length):
    n, df = Counter(), Counter()
    for texts in records:
        seen = set()
        for text in texts or ():
            ts = terms(text) if text else []
            for k in range(1, length + 1):
                for i in range(len(ts) - k + 1):
                    gram = " ".join(ts[i : i + k])
                    n[gram] += 1
                    seen.add(gram)
        df.update(seen)
    return {(g, len(g.split()), n[g], df[g]) for g in n}


def test_terms_and_words():
    assert terms("Avoca​do's ½ﬁg JALAPEÑO_x2 10g") == ["avocado", "s", "fig", "jalapeño", "x", "g"]
    assert words("Avoca​do ½ x2") == ["avocado", "1", "2", "x2"] and words("") == terms("12 . ") == []
    assert plain("a&amp;b<br/>c <p class='x'>d</p> 1 < 2 > 0 <!-- gone -->") == "a&b c  d  1 < 2 > 0  "


TEXT = st.lists(st.sampled_from(["the", "a", "b", "c", "ab", "é", "1"]), max_size=8).map(" ".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), TEXT), max_size=3)), min_size=1, max_size=30), st.integers(1, 3))
def test_counts_equal_brute_force(spark, records, length):
    df = spark.createDataFrame([(r,) for r in records], "texts array<string>").repartition(3)
    assert {tuple(r) for r in term_counts.ngram_counts(df, length).collect()} == brute(records, length)


def test_stack_emits_each_prefix_once():
    suffixes = [("b", [1, 1, 0]), ("a c", [2, 1, 1]), ("a b", [3, 2, 2]), ("a b", [1, 1, 1]), ("a", [1, 0, 0])]
    assert list(term_counts.stacked(iter(suffixes))) == [("b", 1, 1, 1), ("a c", 2, 2, 1), ("a b", 2, 4, 3), ("a", 1, 7, 4)]


def test_found(spark, layer1, save):
    rows = [(f"r{i}", "t", ["salt", None], ["Stir it" if i < 4 else "rest"], 1) for i in range(10)] + [("R0 ", "t", ["old only"], [], 0 + 1), ("x", None, None, None, 1), ("y", "t", ["­", "  "], [], 1)]
    rows[-3] = ("R0 ", "t", ["salt"], ["Stir it"], 2)
    folder = save(layer1=layer1(rows, extra=("term", "mark", "texts")))
    assert {tuple(r) for r in term_counts.p1_found(spark, folder).collect()} == {("salt", "common"), ("rest", "common")}
    folder = save(layer1=layer1(rows[:2]))
    assert {tuple(r) for r in term_counts.p1_found(spark, folder).collect()} == {("salt", "rare"), ("stir", "rare"), ("it", "rare")}
    assert {(r.term, r.n_occurrences, r.n_records) for r in term_counts.p1_terms(spark, folder).collect()} == {("salt", 2, 2), ("stir", 2, 2), ("it", 2, 2), ("stir it", 2, 2)}
    assert term_counts.p1_found(spark, save(layer1=layer1([]))).count() == 0


def test_one_frequent_first_term_and_a_long_text(spark):
    long = "the cat sat on the mat " * 20_000
    df = spark.createDataFrame([([long],), (["the end"],)], "texts array<string>")
    got = {r.term: (r.n_occurrences, r.n_records) for r in term_counts.ngram_counts(df, 2).collect()}
    assert got["the"] == (40_001, 2) and got["the mat"] == (20_000, 1) and got["mat the"] == (19_999, 1)
