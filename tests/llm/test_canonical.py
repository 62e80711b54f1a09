import random

import pytest

from potflow.llm import canonical

NAMES = [(1, "turkey thigh"), (2, "jalapeño"), (3, "sour cream"), (4, "cilantro"), (4, "coriander leaves"), (5, "coriander seed"), (6, "leek"), (7, "ramps"), (7, "wild leek"), (8, "anchovy"), (9, "bay leaf"), (10, "feta cheese"), (11, "ripe mango"), (12, "udon noodles"), (13, "red lentils"), (14, "crème fraîche"), (15, "okra")]
DICTIONARY = canonical.Dictionary(NAMES)


KEPT = frozenset(w for _, n in NAMES for w in canonical.tokens(n) if w in canonical.NOISE)


def meant(text, dictionary=DICTIONARY, kept=KEPT):
    rest = canonical.reduced(text, kept)
    found = dictionary.best(rest.split(" ")) if rest else None
    return found[0] if found else 0


@pytest.mark.parametrize(
    "text,canon",
    [
        ("2 turkey thighs, peeled and diced", 1), ("5 tur key thigh", 1), ("turkeythigh", 1), ("turkey_thigh", 1), ("4 tuurkey thigh (~ 6 ounces)", 1), ("turky tihgh", 1),
        ("2 jalapcño", 2), ("sour crearn", 3), ("some cream - sour", 3), ("coriander seeds", 5), ("coriander leaves", 4), ("2 wild leeks", 7), ("3 leek", 6), ("2 small anchovies", 8),
        ("6 laurel", 0), ("bay leaves", 9), ("Brannock's feta c heese (optional)", 10), ("ripe mangoes", 11), ("noodles,udon", 12), ("lentils, red, sliced", 13), ("rinsed creme fra îche", 14),
        ("custard creams, 1/2 cup", 0), ("for the glaze", 0), ("Dressing:", 0), ("modem leek", 6), ("3 pound cake", 0), ("nori", 0), ("", 0), ("* * *", 0), ("ok ra", 15), ("0kra", 15),
    ],
)
def test_meaning(text, canon):
    assert meant(text) == canon


def plain_distance(a, b):
    """The weighted distance over all cells."""
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [] if i or j else [0.0]
            if i:
                ways.append(rows[i - 1][j] + (0.8 if i > 1 and a[i - 1] == a[i - 2] else 1.0))
            if j:
                ways.append(rows[i][j - 1] + (0.8 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
            if i and j:
                ways.append(rows[i - 1][j - 1] + (0.0 if a[i - 1] == b[j - 1] else canonical.NEAR.get(frozenset((a[i - 1], b[j - 1])), 1.0)))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and b[j - 1] == a[i - 2] != a[i - 1]:
                    ways.append(rows[i - 2][j - 2] + 0.8)
                if i > 1:
                    ways.append(rows[i - 2][j - 1] + canonical.PAIRS.get((a[i - 2 : i], b[j - 1]), 9))
                if j > 1:
                    ways.append(rows[i - 1][j - 2] + canonical.PAIRS.get((a[i - 1], b[j - 2 : j]), 9))
            rows[i][j] = min(ways)
    return rows[-1][-1]


def slipped(word, rng, times):
    """The word with random slips, like characters and pairs among them."""
    for _ in range(times):
        k, kind = rng.randrange(len(word)), rng.randrange(6)
        if kind == 0:
            word = word[:k] + rng.choice("abcdehilmnorsuvw013589") + word[k:]
        elif kind == 1 and len(word) > 2:
            word = word[:k] + word[k + 1 :]
        elif kind == 2:
            word = word[:k] + word[k : k + 2][::-1] + word[k + 2 :]
        elif kind == 3:
            like = [c for p in canonical.NEAR if word[k] in p for c in p if c != word[k]]
            word = word[:k] + (rng.choice(like) if like else "q") + word[k + 1 :]
        elif kind == 4:
            word = word[:k] + word[k] + word[k:]
        else:
            for x, y in rng.sample(sorted(canonical.PAIRS), 6):
                if x in word:
                    word = word.replace(x, y, 1)
                    break
    return word


def test_lookup_equals_comparison_with_every_name():
    rng = random.Random(4)
    names = [*DICTIONARY.exact, "cornmeal", "clamclover", "wwwclrn", "modernmermaid", "1inguini", "herbes"]
    dictionary = canonical.Dictionary(list(enumerate(names, 1)))
    for _ in range(700):
        word = slipped(rng.choice(names), rng, rng.randint(0, 5))
        want = {}
        for name, canon in dictionary.entries:
            d = plain_distance(word, name) if abs(len(word) - len(name)) < 5 else 9
            assert abs(canonical.distance(word, name) - d) < 1e-9 if d <= 2 else canonical.distance(word, name) > 2
            if d <= canonical.allowed(len(name)):
                want[canon] = min(d, want.get(canon, 9))
        got = {c: d for c, (d, n) in dictionary.near(word).items()}
        assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want), word


def test_names_of_noise_and_long_names():
    names = [(1, "half and half"), (2, "beef stock from the bone broth"), (3, "extra virgin cold pressed olive oil from crete"), (4, "and"), (5, "***"), (6, "a b c d e f g h")]
    d, kept = canonical.Dictionary(names), frozenset(w for _, n in names for w in canonical.tokens(n) if w in canonical.NOISE)
    say = lambda t: meant(t, d, kept)
    assert say("half and half") == 1 and say("2 cups Half-and-Half, warm") == 1 and say("ha1f and half") == 1
    assert say("beef stock from the") == 0 and say("beef stock from the bone broth") == 2 and say("beef st0ck from the bone brolh") == 2
    assert say("extra virgin cold pressed") == 0 and say("3 tbsp extra virgin cold pressed olive oil from crete") == 3 and say("olive oil from crete, extra virgin cold pressed") == 3
    assert say("a b c d e f g h") == 6 and say("***") == 0


def test_lists_of_any_size(spark):
    """The join by keys gives what the broadcast dictionary gives."""
    rng = random.Random(9)
    reference = spark.createDataFrame([(i, n, ["alias " + n] if i % 5 == 0 else None) for i, n in NAMES], "canon_id int, name string, aliases array<string>")
    texts = [f"{rng.choice(['2 cups ', '', 'red ', 'some '])}{' '.join(slipped(w, rng, rng.choice([0, 0, 1, 2])) for w in n.split())}{rng.choice([', chopped', '', ' x'])}" for _, n in NAMES for _ in range(12)]
    values = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "For the glaze", "", None, "leek leek okra"])], "i int, text string")
    own = {r.i: (r.canon_id, r.distance) for r in canonical.mapped(values, reference).collect()}
    joined = {r.i: (r.canon_id, r.distance) for r in canonical.mapped(values, reference, broadcast=3).collect()}
    assert own == joined and len(own) == len(texts) + 2 and sum(c > 0 for c, _ in own.values()) > len(texts) / 2
    assert canonical.mapped(values, reference.limit(0)).where("canon_id != 0").count() == 0 and canonical.mapped(values, reference.limit(0), broadcast=-1).count() == len(own)


def test_distance():
    assert canonical.distance("abc", "abc") == 0 and canonical.distance("modern", "modem") == 0.6 and canonical.distance("b0wl", "bowl") == 0.4
    assert canonical.distance("tihgh", "thigh") == 0.8 and canonical.distance("leeek", "leek") == 0.8 and canonical.distance("leak", "leek") == 1 and canonical.distance("a", "abcdef") > 2


def test_found(spark, layer1, save):
    reference = spark.createDataFrame([(1, "turkey thigh", None), (2, "okra", ["ladies fingers", None]), (3, "leek", [])], "canon_id int, name string, aliases array<string>")
    det = spark.createDataFrame(
        [(" A", [("ladies finger",), None, (None,), ("  ",), ("mystery",)], None, None), ("a", [("ladies finger",)], None, None), (None, [("okra",)], None, None), ("b", None, None, None)],
        "id string, ingredients array<struct<text: string>>, valid array<boolean>, loaded_at timestamp_ntz",
    )
    rows = layer1([("A", "t", ["2 turkey thigh", None, "x" * 50_000, ""], [], 2), ("a ", "t", ["leek"], [], 1)], extra=("canon_id", "distance", "src_table"))
    folder = save(layer1=rows, det_ingrs=det, dim_ingredient=reference)
    want = {("layer1", "a", 0, 1), ("layer1", "a", 2, 0), ("det_ingrs", "a", 0, 2), ("det_ingrs", "a", 4, 0)}
    got = [tuple(r) for r in canonical.p3_found(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r.src_table, r.canon_id, r.n_values) for r in canonical.p3_misses(spark, folder).collect()} == {("layer1", 1, 1), ("layer1", 0, 1), ("det_ingrs", 2, 2), ("det_ingrs", 0, 1)}
    assert canonical.p3_found(spark, save(layer1=layer1([]), det_ingrs=det.limit(0), dim_ingredient=reference)).count() == 0
    clash = spark.createDataFrame([("okra", 9, 9.0)], "text string, canon_id int, distance double")
    assert tuple(canonical.mapped(clash, reference).first()) == (2, 0.0)


def test_two_cheap_edits_in_short_names():
    names = ["lemon", "clams", "olives", "honey", "walnut", "cornmeal", "endive", "thyme", "chives", "corns"]
    d = canonical.Dictionary(list(enumerate(names, 1)))
    assert d.best(["lernon"]) == (1, 0.6) and d.best(["1ernon"]) == (1, 1.0) and d.best(["o1lves"]) == (3, 0.8) and d.best(["hohey"]) == (4, 0.4)
    slips = [(*p, c) for p, c in canonical.PAIRS.items()] + [(*order, c) for pair, c in canonical.NEAR.items() for order in (sorted(pair), sorted(pair)[::-1])]
    changed = lambda w: {w[:i] + b + w[i + len(a) :] for a, b, _ in slips for i in range(len(w)) if w.startswith(a, i)}
    for name, canon in d.entries:
        for word in set().union(*map(changed, changed(name))):
            if (far := canonical.distance(word, name)) <= canonical.allowed(len(name)):
                assert d.near(word).get(canon, (9,))[0] <= far, (name, word)
