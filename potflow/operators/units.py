"""Amounts and temperatures in text, in common units.

A multi-pattern automaton finds all spellings of units in one pass over a text; of overlapping finds the longest
stands. A find counts if a quantity stands before it. The field settles spellings with two readings: a bare C is
degrees Celsius in an instruction and a cup in an ingredient. The factors are those of a reference table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.functions.text import DROPPED
from potflow.sources.tables import current, table

#: Spellings of the units; those marked with a case are read so only.
SPELLINGS = {
    "cup": "c. cup cups cupful cupfuls",
    "tbsp": "T T. tbsp tbsp. tbsps tbsps. tbs tbs. tblsp tblsp. tblsps tablespoon tablespoons tablespoonful tablespoonfuls",
    "tsp": "t t. tsp tsp. tsps tsps. teaspoon teaspoons teaspoonful teaspoonfuls",
    "floz": "fl_oz fl_oz. fl._oz fl._oz. fl.oz fl.oz. floz fluid_ounce fluid_ounces fluid_oz fluid_oz. fl_ounce fl_ounces",
    "pint": "pt pt. pts pts. pint pints",
    "quart": "qt qt. qts qts. quart quarts",
    "ml": "ml ml. mls cc cc. millilitre millilitres milliliter milliliters",
    "cl": "cl cl. centilitre centilitres centiliter centiliters",
    "dl": "dl dl. decilitre decilitres deciliter deciliters",
    "l": "l l. ltr ltr. ltrs litre litres liter liters",
    "g": "g g. gr gr. grs gm gm. gms gram grams gramme grammes",
    "kg": "kg kg. kgs kgs. kilo kilos kilogram kilograms kilogramme kilogrammes",
    "oz": "oz oz. ozs ounce ounces",
    "lb": "lb lb. lbs lbs. pound pounds",
    "C": "°c °_c deg_c deg._c degree_c degrees_c °_celsius degree_celsius degrees_celsius deg_celsius deg._celsius celsius degree_centigrade degrees_centigrade deg_centigrade deg._centigrade centigrade",
    "F": "f °f °_f deg_f deg._f degree_f degrees_f °_fahrenheit degree_fahrenheit degrees_fahrenheit deg_fahrenheit deg._fahrenheit fahrenheit",
    "C or cup": "c",
}
#: Words that may stand between a quantity and its unit; containers whose size is stated.
BETWEEN = "level|levelled|heaped|heaping|good|scant|full|generous|packed|rounded|large|small|big|brimming|overflowing"
CONTAINERS = "jars?|cans?|cartons?|tins?|packs?|packets?|packages?|pkgs?|bottles?|boxe?s?|bags?|tubs?|pots?|tubes?|pouche?s?|containers?|sachets?|blocks?|sticks?|trays?|punnets?"
#: Number words and what they stand for, and parts of a whole.
ONES = dict(one=1, two=2, three=3, four=4, five=5, six=6, seven=7, eight=8, nine=9)
TEENS = dict(ten=10, eleven=11, twelve=12, thirteen=13, fourteen=14, fifteen=15, sixteen=16, seventeen=17, eighteen=18, nineteen=19)
TENS = dict(twenty=20, thirty=30, forty=40, fifty=50, sixty=60, seventy=70, eighty=80, ninety=90)
SCALES = dict(hundred=100, thousand=1000, dozen=12)
PARTS = dict(half=2, halves=2, third=3, thirds=3, quarter=4, quarters=4, fourth=4, fourths=4, fifth=5, fifths=5, sixth=6, sixths=6, eighth=8, eighths=8, tenth=10, tenths=10, sixteenth=16, sixteenths=16)

_any = lambda *words: "(?:" + "|".join(w for ws in words for w in sorted(ws, key=len, reverse=True)) + ")"
_BELOW_100 = rf"(?:{_any(TENS)}(?:[\s-]+{_any(ONES)})?|{_any(TEENS, ONES)})"
_BELOW_1000 = rf"(?:(?:(?:{_any(TEENS, ONES)}|an?)\s+)?hundred(?:\s+(?:and\s+)?{_BELOW_100})?|{_BELOW_100})"
_WHOLE = rf"(?:(?:(?:{_BELOW_1000}|an?)\s+)?thousand(?:,?\s+(?:and\s+)?{_BELOW_1000})?|(?:(?:{_BELOW_100}|half\s+an?|an?)\s+)?dozen|{_BELOW_1000})"
_PART = rf"(?:(?:(?:{_WHOLE}|\d+)\s+and\s+)?(?:(?:{_WHOLE}|\d+|an?)[\s-]+)?{_any(PARTS)}(?:\s+of)?(?:\s+an?)?)"
_DECIMAL = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.,]\d+|\d+"
_NUMBER = (
    rf"(?:(?<![\d.,/])\d+(?:\s+(?:and\s+)?|\s?-\s?)\d+\s?/\s?\d+|(?<![\d.,/])\d+\s?/\s?\d+|(?<![\d.,/\w]){_PART}\b|(?<![\d.,/])(?:{_DECIMAL})|(?<![\d.,/])\.\d+"
    rf"|\b{_WHOLE}\b|\ban?\b)"
)
_BEFORE = re.compile(rf"(?P<n>{_NUMBER})(?P<range>\s?(?:°\s?[cf]?)?\s?(?:\bto\b|\bor\b|-|–|—|‑|−|~)\s?(?:{_NUMBER}))?(?:\s|-|‑)*(?:(?:{BETWEEN})\s+)*(?:of\s+an?\s+)?$")
_TIMES = re.compile(rf"(?P<n>{_NUMBER})\s*(?:x|×|\*)\s*[(\[]?\s*$")
_COUNT_BRACKET = re.compile(rf"(?P<n>{_NUMBER})\s*[(\[]\s*$")
_COUNT = re.compile(rf"(?P<n>{_NUMBER})\s+$")
_CONTAINER = re.compile(rf"\.?\s*[)\]]?\s*-?\s*(?:{CONTAINERS})\b")
#: Foods whose name begins with the name of a unit: "3 pound cake" is a count.
_FOOD = re.compile(r"(?:pound\s*cakes?|cup\s*cakes?|cup\s+noodles?)\b")
_ADDED = re.compile(r"\s*(?:plus|and|\+|&|,)?\s*$")
#: What a quantity and what stands between it and its unit are made of; a quantity is looked for in a run of these, however long.
_TOKEN = re.compile(r"[^\W\d_]+|\S")
_OF_QUANTITY = frozenset(BETWEEN.split("|")) | {*ONES, *TEENS, *TENS, *SCALES, *PARTS, "a", "an", "and", "of", "to", "or", "x", "c", "f"}
_SIGNS = frozenset("0123456789.,/-–—‑−~°×*()[]+")
_VALUES = ONES | TEENS | TENS


def run_before(text: str, end: int) -> int:
    """Where the run of quantity tokens that ends before ``end`` starts; ``end`` if there is none. What is looked at doubles
    until the run lies within it, so a run may be of any length."""
    reach = 32
    while True:
        low, begin, first = max(0, end - reach), -1, -1
        for m in _TOKEN.finditer(text, low, end):
            t = m[0]
            if first < 0 and low or t in _SIGNS or t in _OF_QUANTITY or t.isdigit():  # the first may be the end of a longer one
                begin = m.start() if begin < 0 else begin
            else:
                begin = -1
            first = m.start() if first < 0 else first
        if begin > first or begin < 0 < first or not low:
            return begin if begin >= 0 else end
        reach *= 4


def prepared(text: str) -> str:
    """Fractions in one character as " n/d", degree signs as one, then NFKC; case kept."""
    if text.isascii():
        return text
    out = []
    for ch in text.translate(DROPPED).replace("º", "°").replace("˚", "°"):
        if unicodedata.category(ch) == "No" and "fraction" in unicodedata.decomposition(ch):
            out.append(" " + unicodedata.normalize("NFKC", ch).replace("⁄", "/"))
        else:
            out.append(ch)
    return unicodedata.normalize("NFKC", "".join(out)).replace("⁄", "/").replace("∕", "/")


def whole(words: list[str]) -> int:
    """The whole number that words state: "one hundred and five", "two thousand", "half a dozen"."""
    total = part = 0
    for w in words:
        if w in ("a", "an"):
            part = part or 1
        elif w == "half":
            part = Fraction(1, 2)
        elif w == "thousand":
            total, part = total + (part or 1) * 1000, 0
        elif w in SCALES:
            part = (part or 1) * SCALES[w]
        elif w.isdigit():
            part += int(w)
        else:
            part += _VALUES.get(w, 0)
    return total + part


def value(number: str) -> Fraction:
    """The number that digits or words state."""
    number = " ".join(number.split())
    if m := re.fullmatch(r"(\d+)(?: and | | ?- ?)(\d+) ?/ ?(\d+)", number):
        return int(m[1]) + (Fraction(int(m[2]), int(m[3])) if int(m[3]) else 0)
    if m := re.fullmatch(r"(\d+) ?/ ?(\d+)", number):
        return Fraction(int(m[1]), int(m[2])) if int(m[2]) else Fraction(0)
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", number):
        return Fraction(number.replace(",", ""))
    if not re.search("[a-z]", number):
        return Fraction(number.replace(",", "."))
    words = re.findall("[a-z]+|\\d+", number)
    at = next((i for i, w in enumerate(words) if w in PARTS), None)
    if at is None or "dozen" in words[at:]:
        return Fraction(whole(words) or 1)
    above = words[:at]
    cut = len(above) - above[::-1].index("and") - 1 if "and" in above else None
    times = above if cut is None else above[cut + 1 :]
    return (Fraction(whole(above[:cut])) if cut else 0) + Fraction(whole(times) if times else 1) / PARTS[words[at]]


def automaton(codes: tuple[str, ...] = ()):
    """The spellings with their unit; underscores stand for white space of any width, which is narrowed before. ``codes``
    are units that have no spellings here: they are found as they are written, in any case."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for unit, spellings in (SPELLINGS | {c: c.replace(" ", "_") for c in codes if c and c not in SPELLINGS}).items():
        for s in spellings.split():
            s = s.replace("_", " ")
            low = s.lower()
            exact = s if unit not in codes and (s != low or low in ("t", "t.")) else None
            machine.add_word(low, (len(low), machine.get(low, (0, ()))[1] + ((unit, exact),)))
    machine.make_automaton()
    return machine


def finds(text: str, machine) -> list[tuple[int, int, str]]:
    """(start, end, unit) of the longest spelling at each place, in order, none overlapping."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    best: list[tuple[int, int, str]] = []
    for last, (n, units) in machine.iter(low):
        start, end = last - n + 1, last + 1
        if start and (low[start - 1].isalpha() and low[start].isalpha()) or end < len(low) and low[end - 1] != "." and (low[end].isalpha() or low[end].isdigit()):
            continue
        if end < len(low) and low[end - 1] == "." and low[end].isdigit():
            continue
        unit = next((u for u, exact in units if exact is None or exact == text[start:end]), units[0][0])
        while best and best[-1][0] >= start:
            best.pop()
        if best and best[-1][1] > start:
            continue
        best.append((start, end, unit))
    return best


def remembered(number: str, known: dict[str, Fraction]) -> Fraction:
    """value, looked up in ``known`` first; that is emptied when it grows large."""
    if number not in known:
        if len(known) > 100_000:
            known.clear()
        known[number] = value(number)
    return known[number]


def amount(text: str, field: str, machine, kinds: dict[str, str] | None = None, known: dict[str, Fraction] | None = None) -> list[tuple[float, str]]:
    """The parts (quantity, unit) of the amount or temperature a text states; none if it states none. kinds: what units
    besides those of KIND measure; known: numbers that were read before."""
    known = {} if known is None else known
    kinds = KIND if kinds is None else KIND | kinds
    text = " ".join(prepared(text).split())
    found = finds(text, machine)
    if not found:
        return []
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    parts: list[tuple[Fraction, str]] = []
    ended = 0
    for start, end, unit in found:
        begin = run_before(low, start)
        m = _BEFORE.search(low, begin, start) if begin < start else None
        if not m or _FOOD.match(low, start):
            continue
        n, at = remembered(m["n"], known), m.start()
        if unit == "C or cup":
            unit = "C" if field == "instructions" and (n >= 30 or text[start] == "C") else "cup"
        elif unit == "cup" and field == "instructions" and text[start] == "C" and text[end - 1] == "." and n >= 30:
            unit = "C"
        elif unit == "F" and field != "instructions" and low[start:end] == "f":
            continue
        heat = unit in ("C", "F")
        if heat and (low[max(0, at - 6) : at].endswith("minus ") or low[at - 1 : at] in ("-", "−") and (at == 1 or low[at - 2] in " (")):
            n = -n
        if parts:
            between = low[ended:at]
            if heat or not _ADDED.match(between) or kinds.get(unit) != kinds.get(parts[0][1]) or between.strip() == "" and unit == parts[-1][1]:
                break
            parts.append((n, unit))
            ended = end
            continue
        if not heat:
            container = _CONTAINER.match(low, end)
            if t := _TIMES.search(low, begin, at):
                n *= remembered(t["n"], known)
            elif container and (t := _COUNT_BRACKET.search(low, begin, at) or _COUNT.search(low, begin, at)):
                n *= remembered(t["n"], known)
        parts.append((n, unit))
        ended = end
    return [(float(n), u) for n, u in parts]


#: What the units measure.
KIND = {"cup": "volume", "tbsp": "volume", "tsp": "volume", "floz": "volume", "pint": "volume", "quart": "volume", "ml": "volume", "cl": "volume", "dl": "volume", "l": "volume", "g": "mass", "kg": "mass", "oz": "mass", "lb": "mass", "C": "temperature", "F": "temperature"}
#: Units of the reference table that are looked for by their code; a table of units has some dozens, and more than these are an error.
CODES = 10_000


def mentions(elements: DataFrame, measure_units: DataFrame | None = None) -> DataFrame:
    """elements(id, field, pos, text) -> (id, field, pos, part, quantity, unit), a row per part of the amount.

    Only elements that state an amount or temperature give rows; null, empty and other texts give none. Units of the
    reference table without spellings here are found by their code.
    """
    own: dict[str, str] = {}
    if measure_units is not None:
        rows = measure_units.where(~F.col("unit_code").isin(*KIND)).select("unit_code", "kind").limit(CODES + 1).collect()
        if len(rows) > CODES:
            raise ValueError(f"the table of units has over {CODES} codes")
        own = {r["unit_code"]: r["kind"] for r in rows}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(tuple(own)), {}
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
        for batch in batches:
            rows = []
            for rid, field, pos, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(rid, field, pos, k, q, u) for k, (q, u) in enumerate(amount(text, field, machine, own, known))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=["id", "field", "pos", "part", "quantity", "unit"])

    texts = elements.where("text IS NOT NULL").select("id", "field", F.col("pos").cast("int"), "text")
    return texts.mapInArrow(search, "id string, field string, pos int, part int, quantity double, unit string")


def elements(layer1: DataFrame) -> DataFrame:
    """The array elements of current layer1 rows: (id, field, pos, text)."""
    fields = ("ingredients", "instructions")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}.text").alias("texts")) for c in fields))).alias("f")
    rows = current(layer1.select("id", *fields, "loaded_at")).select("id", each).select("id", "f.field", F.posexplode("f.texts").alias("pos", "text"))
    return rows.where("text IS NOT NULL")


def converted(found: DataFrame, measure_units: DataFrame) -> DataFrame:
    """mentions -> (id, field, pos, kind, base_milli): thousandths of ml, g or degrees Celsius, the parts of an amount summed.

    The factors are joined to the parts; Spark broadcasts the reference table if it is small enough. The parts of an
    element stand together, so they are summed before the shuffle. A unit the table lacks leaves base_milli null.
    """
    factors = measure_units.select(F.col("unit_code").alias("unit"), "to_base", "kind")
    rows = found.join(factors, "unit", "left")
    degrees = F.when(F.col("unit") == "C", F.col("quantity")).when(F.col("unit") == "F", (F.col("quantity") - 32) * 5 / 9)
    rows = rows.withColumn("base", F.coalesce(degrees, F.col("quantity") * F.col("to_base"))).withColumn("kind", F.when(degrees.isNotNull(), "temperature").otherwise(F.col("kind")))
    total = F.when(F.count("base") == F.count("*"), F.sum("base"))
    sums = rows.groupBy("id", "field", "pos").agg(F.min_by("kind", "part").alias("kind"), total.alias("base"))
    return sums.select("id", "field", "pos", "kind", F.round(F.col("base") * 1000).cast("long").alias("base_milli"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Each element of current layer1 rows that states a volume, mass or temperature, in thousandths of the common unit."""
    measure_units = table(spark, sf_dir, "measure_units")
    return converted(mentions(elements(table(spark, sf_dir, "layer1")), measure_units), measure_units)
