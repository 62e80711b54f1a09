import random

import pytest

from potflow.operators import units

MACHINE = units.automaton()
FACTORS = dict(cup=240, tbsp=15, tsp=5, floz=30, pint=480, quart=960, ml=1, cl=10, dl=100, l=1000, g=1, kg=1000, oz=28.4, lb=454)


def base(text, field="ingredients"):
    parts = units.amount(text, field, MACHINE)
    if not parts:
        return None
    n, u = parts[0]
    if u in "CF":
        return round(n if u == "C" else (n - 32) * 5 / 9, 3)
    return round(sum(n * FACTORS[u] for n, u in parts), 3)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2 cups flour", 480), ("1 c. rye", 240), ("0,5dl x", 50), ("1,200 g x", 1200), ("1,5 pint x", 720), ("2¼ lbs. x", 1021.5), ("2 1⁄2 teaspoons x", 12.5),
        ("1-1/2 cups x", 360), ("⅓ cup x", 80), ("５ kg x", 5000), ("a half pint x", 240), ("half a cup x", 120), ("a quarter of a tablespoon x", 3.75), ("two thirds lbs. x", 302.667),
        ("one and a half kilos x", 1500), ("a teaspoon x", 5), ("3 T x", 45), ("3 t x", 15), ("2½ heaped Tbsp. x", 37.5), ("x [4–5 teaspoon]", 20), ("1/8 to 1-1/8 t x", 0.625),
        ("2 to 2-1/2 cups x", 480), ("750–800gr x", 750), ("3 × 400g cartons x", 1200), ("2 15-oz packs x", 852), ("3 (400 g) jars x", 1200), ("x, 3 (200 g) jars", 600),
        ("4 lamb shoulders (approx. 9 oz)", 255.6), ("2 cups plus 3 tbsp x", 525), ("2 lb 6 oz. x", 1078.4), ("2 lbs and 6 ounces x", 1078.4), ("75 gm/2.6 oz x", 75),
        ("1 l (about 4.2 cups) x", 1000), ("16.0 oz (about 454 g) x", 454.4), ("12 fl. oz. x", 360), ("75 or 125gramme x", 75), ("3 15-oz. cartons x", 1278), ("80 g­r x", 80),
        ("1 can x", None), ("a pinch of x", None), ("3 pound cake", None), ("2 cup noodles", None), ("50 g pound cake", 50), ("x, cut into 1/2-inch pieces", None), ("see note 2 below", None),
        ("two-thirds cup milk", 160), ("one-half cup", 120), ("twenty five grams", 25), ("twenty-five grams", 25), ("fifteen ounces x", 426), ("thirteen cups", 3120), ("one hundred grams", 100),
        ("a hundred and five ml", 105), ("two thousand five hundred grams", 2500), ("two five-ounce cans x", 284), ("half a dozen ounces", 170.4), ("1 and a half cups", 360), ("1 and 1/2 cups", 360),
        ("one and three-quarters cups", 420), ("3 quarters cup", 180), ("two-three cups", 480), ("2 " + "heaped " * 40 + "cups x", 480), ("two hundred and fifty to three hundred g", 250), ("three-eighths tsp", 1.875),
        ("2 cup noodles, dried", None), ("twelve", None), ("a hundred", None), ("4 leek", None), ("", None), ("a 1/0 cup x", 0), ("200 f x", None), ("1 c x", 240),
    ],
)
def test_ingredients(text, expected):
    assert base(text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Bake at 180°C for 9 minutes.", 180), ("at 63–73C for", 63), ("at 175 to 185ºC until", 175), ("to 400 degrees F and", 204.444), ("340 degrees Fahrenheit (171°C)", 171.111),
        ("190-200 deg. C for 30 to 35 minutes.", 190), ("at 450 °F [232°C]", 232.222), ("for 43 minutes.", None), ("Set the oven at 300F, rack", 148.889), ("165 degrees centigrade", 165),
        ("with 2 c. of hot water", 480), ("Add 2 (6 fl oz) cartons more x", 360), ("using 33 to 38 cl x for no longer", 330), ("about 10 min per side", None), ("Add 2 1/4 CUP x", 540),
    ],
)
def test_instructions(text, expected):
    assert base(text, "instructions") == expected


def spoken(n, rng):
    """A whole number in words, with and without "and" and hyphens."""
    ones, tens = [*units.ONES, *units.TEENS], list(units.TENS)
    if n < 20:
        return ones[n - 1]
    if n < 100:
        return tens[n // 10 - 2] + (rng.choice("- ") + ones[n % 10 - 1] if n % 10 else "")
    if n < 1000:
        return ones[n // 100 - 1] + " hundred" + (rng.choice([" and ", " "]) + spoken(n % 100, rng) if n % 100 else "")
    return spoken(n // 1000, rng) + " thousand" + (rng.choice([" ", " and ", ", "]) + spoken(n % 1000, rng) if n % 1000 else "")


def test_numbers_in_words():
    rng = random.Random(3)
    for n in [*range(1, 200), *(rng.randint(200, 99_999) for _ in range(300))]:
        text = spoken(n, rng)
        assert base(f"{text} grams x") == n, text
        for part, k in (("half", 2), ("third", 3), ("quarter", 4)):
            assert base(f"{text} and a {part} g") == round(n + 1 / k, 3), text
        assert base(f"x, {text} to {spoken(n + 1, rng)} ml") == n, text


def test_units_of_the_table_are_found_by_their_code(spark):
    measures = spark.createDataFrame([("g", "mass", "g", 1.0), ("Stone", "mass", "g", 6350.0), ("mug", "volume", "ml", 300.0), (None, "mass", "g", 1.0)], "unit_code string, kind string, base_unit string, to_base double")
    rows = [("a", "ingredients", 0, "two stone of x"), ("a", "ingredients", 1, "3 mug x"), ("a", "ingredients", 2, "1 stone and 50 g"), ("a", "ingredients", 3, "2 cups"), ("a", "ingredients", 4, "stones, 5")]
    found = units.converted(units.mentions(spark.createDataFrame(rows, "id string, field string, pos int, text string"), measures), measures)
    assert {(r.pos, r.kind, r.base_milli) for r in found.collect()} == {(0, "mass", 12_700_000), (1, "volume", 900_000), (2, "mass", 6_400_000), (3, None, None)}


def test_very_long_text():
    assert base("one " * 50_000 + "cups") == 240 and base("x" * 50_000 + " 2 cups") == 480 and base("2" + " " * 300 + "cups") == 480
    assert base("x " * 200_000 + "2 cups") == 480 and base("1" * 100_000) is None


def test_found(spark, layer1, save):
    measures = spark.createDataFrame([(u, "volume" if f in (240, 15, 5, 30, 480, 960, 10, 100) or u in ("ml", "l") else "mass", "ml", float(f)) for u, f in FACTORS.items()], "unit_code string, kind string, base_unit string, to_base double")
    folder = save(layer1=layer1([("A", "t", ["1/3 cup x", None, "salt", ""], ["Bake at 350 F."], 1), ("b", "t", None, None, 1)], extra=("kind", "units", "parts")), measure_units=measures)
    assert {tuple(r) for r in units.p5_found(spark, folder).collect()} == {("a", "ingredients", 0, "volume", 80000), ("a", "instructions", 0, "temperature", 176667)}
    assert units.p5_found(spark, save(layer1=layer1([]), measure_units=measures)).count() == 0
