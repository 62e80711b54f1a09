import random

import duckdb
import pytest

from potflow.llm import abuse


def distance(a, b):
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_trie_equals_comparison_with_every_term():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choices("abcde", k=rng.randint(3, 8))) for _ in range(150)})
    trie = abuse.Trie(terms)
    for _ in range(200):
        word = "".join(rng.choices("abcdef", k=rng.randint(3, 9)))
        for most in (0, 1, 2):
            best = min(((distance(word, t), t) for t in terms), default=None)
            assert trie.near(word, most) == ((best[1], best[0]) if best[0] <= most else None), word


def test_tokens_see_through_disguises():
    assert abuse.tokens("you are so s-t-u-p-i-d, m.o.r.o.n and p o r n") == ["you", "are", "so", "stupid", "moron", "and", "porn"]
    assert abuse.tokens("looooser 1d1ot p@thetic f**cked 2024") == ["loser", "idiot", "pathetic", "f??cked"]
    assert abuse.tokens("d_ad s#bhuman 12% f*ck!") == ["d?ad", "s?bhuman", "f?ck"]
    assert abuse.Trie(["dead", "duck"]).near("d?ad", 0) == ("dead", 0)
    assert abuse.windows("A first one. Second!\n\nthird <b>x</b>") == ["a first one.", "second!", "third  x "]
    assert all(len(w.split(" ")) <= abuse.SPAN for w in abuse.windows("word " * 10_000)) and abuse.windows("") == []


HARMLESS = ["beat the egg whites until stiff", "this naked cake needs no icing", "kill the heat before the butter burns", "the stew was bland", "serve it with rice and lime", "my neighbour likes the soup a lot", "rub the chicken thighs with salt"]
ABUSIVE = ["you are a pathetic moron", "shut up you stupid idiot", "i hope you choke on it and die", "free porn videos of amateur sluts", "people like you should disappear for good"]


def corpus(n, rng):
    docs = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        lines = rng.choices(HARMLESS, k=4) + ([rng.choice(ABUSIVE)] if toxic else [])
        rng.shuffle(lines)
        docs.append((". ".join(lines), int(toxic)))
    return docs


def test_model_learns_and_sees_slips():
    model = abuse.learned(corpus(300, random.Random(1)))
    bad = lambda text: model.document(text)[0] >= model.threshold
    held_out = corpus(200, random.Random(2))
    assert sum(bad(t) == bool(y) for t, y in held_out) >= 198
    assert bad("the stew was bland. you are such p a t h e t i c m o r o n!") and bad("You are a pahtetic mmmoron") and bad("ho hum. you are a pathetic mo­ron")
    assert not bad("") and not bad("kill the heat before the butter burns")
    text = 'the comment said "you are a pathetic moron" and was removed'
    assert model.score(text) < model.score("you are a pathetic moron")


def test_without_labels_the_list_stands_alone():
    model = abuse.learned([])
    assert model.document("what an asshole")[0] >= model.threshold > model.document("a calm soup")[0]


def test_accuracy_on_held_out_labels():
    """About a tenth of the labels are wrong, which bounds what can be reached; so a share of agreement is asked for."""
    rows = duckdb.sql("SELECT any_value(text), max(toxic) FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/doc_labels.parquet' USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id ORDER BY hash(doc_id)").fetchall()
    model = abuse.learned(rows[:1300])
    held_out = rows[1300:]
    hits = [(model.document(t)[0] >= model.threshold, bool(y)) for t, y in held_out]
    right = sum(a and b for a, b in hits)
    assert right / sum(b for _, b in hits) > 0.8 and right / sum(a for a, _ in hits) > 0.8


@pytest.fixture
def folder(spark, save):
    rng = random.Random(5)
    docs = [(i, text, f"s{i % 3}", "x") for i, (text, _) in enumerate(corpus(120, rng))] + [(500, None, "s0", "x"), (501, "", None, "x"), (502, "the stew was bland " * 20_000, "s0", "x"), (0, "copy", "s0", "x")]
    labels = [(i, int(any(a in text for a in ABUSIVE)), "k", "r") for i, text, *_ in docs[:100] if text] + [(1, None, "k", "r"), (9999, 1, "k", "r"), (2, 0, "k", "r")]
    return save(documents=spark.createDataFrame(docs, "doc_id long, text string, source string, score string"), doc_labels=spark.createDataFrame(labels, "doc_id long, toxic int, kind string, rater string")), docs


def test_found(spark, folder):
    path, docs = folder
    got = {r.doc_id for r in abuse.p9_found(spark, path).collect()}
    assert got == {i for i, text, *_ in docs if text and any(a in text for a in ABUSIVE)}
    rates = {r.source: r for r in abuse.p9_rates(spark, path).collect()}
    assert sum(r.n_docs for r in rates.values()) == len(docs) and rates[None].n_flagged == 0 and rates["s0"].rate == round(rates["s0"].n_flagged / rates["s0"].n_docs, 6)


def test_empty(spark, save):
    path = save(documents=spark.createDataFrame([], "doc_id long, text string, source string"), doc_labels=spark.createDataFrame([], "doc_id long, toxic int"))
    assert abuse.p9_found(spark, path).count() == 0 and abuse.p9_rates(spark, path).count() == 0


def test_frequent_disguises_are_still_looked_up(spark, save):
    docs = corpus(300, random.Random(1))
    model = abuse.learned(docs, frozenset(["mroon", "imbecil", "f?ck", "luck", "whale"]))
    bad = lambda text: model.document(text)[0] >= model.threshold
    assert bad("you are a mroon") and bad("what an imbecil you are") and bad("oh f*ck you") and not {"mroon", "imbecil", "f?ck"} & model.common
    assert {"luck", "whale"} <= model.common and "imbecil" not in abuse.learned([], frozenset(["imbecil"])).common
    held = abuse.learned([*docs, ("a mroon is a cake", 0)], frozenset(["mroon"]))
    assert "mroon" in held.common and "mroon" not in abuse.learned([*docs, ("a mroon", 0), ("a mroon", 1), ("a mroon", 1)], frozenset(["mroon"])).common
    heavy = abuse.Model({"griggin": 1.4, "lemons": 0.6}, {"griggin", "lemons"})
    assert heavy.term("grigin") == "griggin" and heavy.term("lemonss") == "lemonss"
    rows = [(i, text, "s", None) for i, (text, _) in enumerate(docs)] + [(1000 + i, "the stew was bland. you absolute imbecil", "s", None) for i in range(150)]
    path = save(documents=spark.createDataFrame(rows, "doc_id long, text string, source string, score string"), doc_labels=spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)], "doc_id long, toxic int"))
    assert {r.doc_id for r in abuse.p9_found(spark, path).collect()} >= {1000 + i for i in range(150)}
    assert not {"imbecil", "absolute"} & abuse.usual_words(spark.read.parquet(f"{path}/documents.parquet"))
