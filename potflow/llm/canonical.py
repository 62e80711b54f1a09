"""Typed values mapped to the closest entry of a reference list.

Every name and alias of the list, in singular and plural and with its words in any order, is written without spaces and
stored under all strings that arise from its beginning by leaving out characters. A typed value is cut into words; each
window of words that is no longer than a name, written together, meets the names within its reach in this dictionary.
Characters that are taken for one another (0 and o, 1 and l) are one there, and rn and m, cl and d, vv and w are tried both
ways, so that every name within the allowed weighted distance is met. Candidates are ranked by that Damerau-Levenshtein
distance against the characters they explain, ties by how often the entry stands exactly in the data, and a value without
a candidate close enough means none.

Values are first reduced to what can bear on the meaning; each different rest is looked up once and joined back.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.functions.text import fold
from potflow.llm.shipping import Shipped
from potflow.sources.tables import current, key, table, written

#: Greatest number of edits besides slips between like characters, and characters of the beginning they are looked for in.
EDITS, PREFIX = 2, 7
#: Names whose dictionary is broadcast (below 100 MB); a longer list is joined by its keys instead. Words of a name that are tried in all orders.
NAMES, ORDERS = 20_000, 4
#: What a slip between these costs instead of 1.
NEAR = {frozenset(p): 0.4 for p in ("0o", "1l", "1i", "5s", "il", "ce", "uv", "3e", "8b", "9g", "hn")}
PAIRS = {("rn", "m"): 0.6, ("m", "rn"): 0.6, ("cl", "d"): 0.6, ("d", "cl"): 0.6, ("vv", "w"): 0.6, ("w", "vv"): 0.6}
#: Words of measure; words of quality, preparation and remark. Alone they are no slip of a name.
MEASURES = frozenset(
    "cup cups c cupful cupfuls tbsp tbsps tbs tblsp tablespoon tablespoons tsp tsps teaspoon teaspoons t oz ounce ounces lb lbs pound pounds g gr gm gram "
    "grams gramme grammes kg kgs kilo kilos kilogram kilograms ml mls milliliter milliliters millilitre millilitres cl centilitre centilitres centiliter "
    "centiliters dl deciliter deciliters decilitre decilitres l ltr litre litres liter liters cc fl floz fluid pint pints pt quart quarts qt qts x jar jars "
    "carton cartons pack packs tin tins can cans pinch knob handful bunch slice slices inch".split()
)
NOISE = MEASURES | frozenset(
    "a an and or of the for to in at with into from on plus about approx roughly see tip note optional taste serve serving dusting extra room temperature "
    "more some half third thirds quarter quarters one two three four five six level heaped good scant full generous packed fresh frozen warm cold ripe large "
    "small organic homemade leftover quality rinsed peeled diced sliced chopped trimmed drained divided finely thinly roughly torn crushed lightly cut pieces "
    "well dried ground whole red white black green yellow sweet smoked brown dry fine raw hot big medium young old your own left over".split()
)
#: Headings and remarks that name no ingredient: "For the glaze", "See note 2", "Dressing:".
REMARK = re.compile(r"^\s*(?:for the\b|see note\b)|:\s*$", re.I)
_WORD, _APOSTROPHE = re.compile(r"[^\W_]+"), re.compile(r"['’]s\b|['’`]")
_CLASSES = str.maketrans({c: g[0] for g in ("o0", "l1i", "s5", "ec3", "uv", "b8", "g9", "hn") for c in g})
_SLIP = re.compile(r"(?=(rn|cl|vv))")
_SHORT = {long: short for long, short in PAIRS if len(long) > 1}


def bare(text: str) -> str:
    """Folded, without accents, underscores as spaces."""
    text = fold(text).replace("_", " ")
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Words of letters and digits; numbers and the digits before a letter ("80gr") are left out."""
    text = bare(text)
    if "'" in text or "’" in text or "`" in text:
        text = _APOSTROPHE.sub("", text)
    found = []
    for w in _WORD.findall(text):
        if not w.isalpha():
            if w.isdigit():
                continue
            rest = w.lstrip("0123456789")
            if rest.isalpha() and (len(w) - len(rest) > 1 or rest in NOISE):
                w = rest
        found.append(w)
    return found


def reduced(text: str, kept: frozenset[str]) -> str | None:
    """The words of a value that can bear on its meaning, None for headings and remarks. kept: words of NOISE that names have."""
    if REMARK.search(text):
        return None
    return " ".join(w for w in tokens(text) if w not in NOISE or w in kept)


def forms(word: str) -> set[str]:
    """A word with its likely singular and plural."""
    out = {word, word + "s"}
    if word.endswith("y"):
        out.add(word[:-1] + "ies")
    if word.endswith(("o", "s", "x", "ch", "sh")):
        out.add(word + "es")
    if word.endswith("f"):
        out.add(word[:-1] + "ves")
    if word.endswith("ies"):
        out.add(word[:-3] + "y")
    if word.endswith("ves"):
        out |= {word[:-3] + "f"}
    if word.endswith(("oes", "shes", "ches")):
        out.add(word[:-2])
    if word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        out.add(word[:-1])
    return out


def written_as(name: str) -> Iterator[tuple[str, int]]:
    """(string without spaces, 0 for the name as it is or 1): the name in singular and plural, its words in any order; names
    of more than ORDERS words begin with any word but keep their order."""
    words = tokens(name)
    if not words:
        return
    yield "".join(words), 0
    for last in forms(words[-1]):
        ws = [*words[:-1], last]
        for order in permutations(ws) if len(ws) <= ORDERS else (ws[k:] + ws[:k] for k in range(len(ws))):
            yield "".join(order), 1


def shortened(word: str, edits: int) -> set[str]:
    """The word and all that arise by leaving out up to ``edits`` characters."""
    n = len(word)
    out = {word}
    if edits and n > 1:
        out.update([word[:i] + word[i + 1 :] for i in range(n)])
    for k in range(2, min(edits, n - 1) + 1):
        for gone in combinations(range(n), k):
            parts, at = [], 0
            for g in gone:
                parts.append(word[at:g])
                at = g + 1
            out.add("".join(parts) + word[at:])
    return out


def allowed(length: int) -> float:
    """The greatest weighted distance at which a name of this length is still meant."""
    return 0.0 if length < 4 else 1.0 if length < 8 else 2.0


def variants(word: str) -> set[str]:
    """The word with like characters made one, and with any up to three of its rn, cl and vv written m, d and w: as many
    slips of that kind as a name allows."""
    places = [m.start() for m in _SLIP.finditer(word)]
    out = {word.translate(_CLASSES)}
    for k in range(1, min(3, len(places)) + 1):
        for chosen in combinations(places, k):
            if all(b - a > 1 for a, b in zip(chosen, chosen[1:])):
                parts, at = [], 0
                for c in chosen:
                    parts += [word[at:c], _SHORT[word[c : c + 2]]]
                    at = c + 2
                out.add("".join([*parts, word[at:]]).translate(_CLASSES))
    return out


def keys_of(word: str, edits: int) -> set[str]:
    """The strings a word is stored or looked up under. Two words within ``edits`` edits have beginnings that become equal
    when up to ``edits`` characters are left out of each."""
    return set().union(*(shortened(v[:PREFIX], edits) for v in variants(word)))


def name_keys(name: str) -> set[str]:
    most = allowed(len(name))
    return keys_of(name, int(most)) if most else set()


def word_keys(word: str) -> set[str]:
    """A name of 8 letters or more, which allows two edits, may be typed in 5."""
    return keys_of(word, 1 if len(word) < 5 else EDITS)


def distance(a: str, b: str, most: float = 2.0) -> float:
    """Weighted Damerau-Levenshtein distance: NEAR and PAIRS cost less, swapped neighbours and doubled letters 0.8. Any number
    above ``most`` if it is larger than that. Only cells near the diagonal are looked at, as each step off it costs 0.6."""
    if a == b:
        return 0.0
    band = int(most / 0.6 + 1e-9)
    if abs(len(a) - len(b)) > band:
        return most + 1
    n, far = len(b), 1e9
    before2, before = None, [j * 1.0 for j in range(n + 1)]
    for j in range(2, n + 1):
        before[j] = before[j - 1] + (0.8 if b[j - 1] == b[j - 2] else 1.0)
    low_before = 0.0
    for i in range(1, len(a) + 1):
        x, row = a[i - 1], [far] * (n + 1)
        gone = 0.8 if i > 1 and x == a[i - 2] else 1.0
        lo, hi = max(0, i - band), min(n, i + band)
        low = far
        for j in range(lo, hi + 1):
            best = before[j] + gone
            if j:
                y = b[j - 1]
                if (c := row[j - 1] + (0.8 if j > 1 and y == b[j - 2] else 1.0)) < best:
                    best = c
                if (c := before[j - 1] + (0.0 if x == y else NEAR.get(frozenset((x, y)), 1.0))) < best:
                    best = c
                if i > 1:
                    if j > 1 and x == b[j - 2] and y == a[i - 2] and x != y and (c := before2[j - 2] + 0.8) < best:
                        best = c
                    if (x == "n" or x == "l" or x == "v") and (w := PAIRS.get((a[i - 2 : i], y))) and (c := before2[j - 1] + w) < best:
                        best = c
                if j > 1 and (y == "n" or y == "l" or y == "v") and (w := PAIRS.get((x, b[j - 2 : j]))) and (c := before[j - 2] + w) < best:
                    best = c
            row[j] = best
            if best < low:
                low = best
        if low > most and low_before > most:
            return most + 1  # two rows beyond it: no step leads back
        before2, before, low_before = before, row, low
    return before[-1]


def windows(words: list[str], longest: int) -> list[tuple[int, int, str]]:
    """(first, end, written together) of the rows of words that are no longer than the longest name with EDITS more."""
    out = []
    for i in range(len(words)):
        together = ""
        for j in range(i, len(words)):
            together += words[j]
            if len(together) > longest + EDITS + 1:
                break
            out.append((i, j + 1, together))
    return out


def looked_for(words: list[str], window: tuple[int, int, str]) -> bool:
    """Whether a window may be a slip of a name."""
    i, j, w = window
    return len(w) > 3 and not all(x in NOISE for x in words[i:j]) and not any(x in MEASURES for x in words[i:j])


def chosen(words: list[str], spans: list[tuple[int, int, str]], exact: dict[str, int], near, frequency: dict[int, int]) -> tuple[int, float] | None:
    """(canon_id, distance) that a row of words means, or None. near(window) -> canon_id -> (distance, length) of names."""
    found = [(len(w), 0.0, exact[w], i, j) for i, j, w in spans if w in exact]
    covered = max(found, default=None)
    rest = [w for k, w in enumerate(words) if w not in NOISE and not (covered and covered[3] <= k < covered[4])]
    if rest:
        for span in spans:
            i, j, w = span
            if w not in exact and looked_for(words, span):
                found += [(n, d, canon, i, j) for canon, (d, n) in near(w).items()]
    if not found:
        return None
    n, d, canon, _, _ = max(found, key=lambda x: (x[0] - 3 * x[1], -x[1], frequency.get(x[2], 0), -x[2]))
    return canon, d


class Dictionary:
    """Names under the strings they leave when characters are left out. names: (canon_id, name or alias)."""

    def __init__(self, names: list[tuple[int, str]]):
        first: dict[str, tuple[int, int]] = {}
        for canon, name in names:
            for string, order in written_as(name):
                first[string] = min(first.get(string, (order, canon)), (order, canon))
        self.exact = {string: canon for string, (_, canon) in first.items()}
        self.entries = sorted(self.exact.items())
        self.frequency: dict[int, int] = {}
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, (name, _) in enumerate(self.entries):
            for s in name_keys(name):
                self.index[s].append(i)
        self.index = dict(self.index)
        self.longest = max(map(len, self.exact), default=0)
        self.seen: dict[str, dict[int, tuple[float, int]]] = {}

    def near(self, word: str) -> dict[int, tuple[float, int]]:
        """canon_id -> (distance, length) of the closest name within the allowed distance."""
        out = self.seen.get(word)
        if out is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            out, get = {}, self.index.get
            for i in {i for s in word_keys(word) for i in get(s, ())}:
                name, canon = self.entries[i]
                most = allowed(len(name))
                d = distance(word, name, most)
                if d <= most and (canon not in out or (d, -len(name)) < (out[canon][0], -out[canon][1])):
                    out[canon] = d, len(name)
            self.seen[word] = out
        return out

    def best(self, words: list[str]) -> tuple[int, float] | None:
        """(canon_id, distance) that a row of words means, or None."""
        return chosen(words, windows(words, self.longest), self.exact, self.near, self.frequency)


def reference_names(reference: DataFrame) -> DataFrame:
    """(canon_id, name): the names and aliases of a reference list with canon_id, name and aliases."""
    own = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return reference.select("canon_id", F.explode(own).alias("name")).where("name IS NOT NULL")


def mapped(values: DataFrame, reference: DataFrame, broadcast: int = NAMES) -> DataFrame:
    """values(..., text) -> the same columns without text, with canon_id (0: none) and distance (null: none).

    Null and blank texts give no row. Columns of values named canon_id or distance are replaced. A reference list of up to
    ``broadcast`` names is broadcast as a dictionary; a longer one is joined with the windows of the values.
    """
    spark = values.sparkSession
    names = reference_names(reference)
    few = [tuple(r) for r in names.limit(broadcast + 1).toLocalIterator()]
    small = len(few) <= broadcast
    kept = frozenset(w for _, n in few for w in tokens(n) if w in NOISE) if small else noise_in(names)
    others = [c for c in values.columns if c not in ("text", "canon_id", "distance")]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = pa.array([reduced(t, kept) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), rest], names=[*others, "_rest"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in values.dtypes if c in others), "_rest string"])
    rests = written(values.where("trim(text) <> ''").select(*others, "text").mapInArrow(reduce, schema), "typed")
    different = written(rests.where("_rest <> ''").groupBy("_rest").agg(F.count("*").alias("n")), "rests")
    found = by_dictionary(different, Dictionary(few)) if small else by_keys(different, names)
    return rests.join(found, "_rest", "left").select(*others, F.coalesce("canon_id", F.lit(0)).alias("canon_id"), "distance")


def noise_in(names: DataFrame) -> frozenset[str]:
    """The words of NOISE that names have: no more than there are such words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {w for batch in batches for n in batch.column(0).to_pylist() for w in tokens(n) if w in NOISE}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return frozenset(r["word"] for r in names.select("name").mapInArrow(search, "word string").distinct().collect())


def by_dictionary(rests: DataFrame, dictionary: Dictionary) -> DataFrame:
    """rests(_rest, n) -> (_rest, canon_id, distance) of those that mean an entry, by a broadcast dictionary."""
    spark = rests.sparkSession
    exact = spark.sparkContext.broadcast(dictionary.exact)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = defaultdict(int)
        for batch in batches:
            for rest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if canon := exact.value.get(rest.replace(" ", "")):
                    counts[canon] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["canon_id", "n"])

    counted = rests.select("_rest", "n").mapInArrow(count, "canon_id int, n long").groupBy("canon_id").agg(F.sum("n").alias("n"))
    dictionary.frequency = {r["canon_id"]: r["n"] for r in counted.collect()}  # one row per entry of the list
    shared = Shipped(spark, dictionary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.load()
        for batch in batches:
            rows = [(r, *hit) for r in batch.column(0).to_pylist() if (hit := dictionary.best(r.split(" ")))]
            yield _found(rows)

    wide = 2 * spark.sparkContext.defaultParallelism
    return rests.select("_rest").repartition(max(wide, rests.rdd.getNumPartitions())).mapInArrow(search, FOUND)


FOUND = "_rest string, canon_id int, distance double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.int32(), pa.float64()))], names=["_rest", "canon_id", "distance"])


def _exploded(df: DataFrame, f, schema: str) -> DataFrame:
    """f(row) -> rows, over the columns of df."""
    columns, types = [c.split(" ")[0] for c in schema.split(", ")], [{"int": pa.int32(), "double": pa.float64()}.get(c.split(" ")[1], pa.string()) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in f(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=columns)

    return df.mapInArrow(run, schema)


def by_keys(rests: DataFrame, names: DataFrame) -> DataFrame:
    """by_dictionary for lists of any length: the dictionary is a table, joined with the windows of the rests by its keys.

    Each different window is looked up once, however many values have it.
    """
    own = _exploded(names.select("canon_id", "name"), lambda canon, name: [(s, o, canon) for s, o in written_as(name)], "name string, place int, canon_id int")
    entries = written(own.groupBy("name").agg(F.min_by("canon_id", F.struct("place", "canon_id")).alias("canon_id")), "names")
    longest = entries.agg(F.max(F.length("name"))).first()[0] or 0
    asked = _exploded(rests.select("_rest"), lambda r: [(r, s[2], int(looked_for(r.split(" "), s))) for s in windows(r.split(" "), longest)], "_rest string, window string, near int").distinct()
    asked = written(asked, "windows")
    each = asked.groupBy("window").agg(F.max("near").alias("near"))
    hits = each.join(entries.withColumnRenamed("name", "window"), "window").select("window", "canon_id", F.lit(0.0).alias("distance"), F.length("window").alias("length"), F.lit(True).alias("exact"))
    open_ = each.where("near = 1").join(entries.select(F.col("name").alias("window")), "window", "left_anti")
    stored = _exploded(entries, lambda name, canon: [(k, name, canon) for k in name_keys(name)], "k string, name string, canon_id int")
    wanted = _exploded(open_.select("window"), lambda w: [(k, w) for k in word_keys(w)], "k string, window string")
    pairs = wanted.join(stored, "k").select("window", "name", "canon_id").distinct()
    judged = _exploded(pairs, lambda w, n, canon: [(w, canon, d, len(n))] if (d := distance(w, n, allowed(len(n)))) <= allowed(len(n)) else [], "window string, canon_id int, distance double, length int")
    closest = judged.groupBy("window", "canon_id").agg(F.min(F.struct("distance", (-F.col("length")).alias("length"))).alias("m"))
    closest = closest.select("window", "canon_id", "m.distance", (-F.col("m.length")).alias("length"), F.lit(False).alias("exact"))
    counts = rests.withColumn("name", F.replace("_rest", F.lit(" "))).join(entries, "name").groupBy("canon_id").agg(F.sum("n").alias("n"))
    all_hits = hits.unionByName(closest).join(counts, "canon_id", "left")
    together = asked.join(all_hits, "window").groupBy("_rest").agg(F.collect_list(F.struct("window", "canon_id", "distance", "length", "exact", "n")).alias("hits"))

    def choose(rest: str, hits: list[dict]) -> list[tuple]:
        near: dict[str, dict[int, tuple[float, int]]] = defaultdict(dict)
        for h in hits:
            if not h["exact"]:
                near[h["window"]][h["canon_id"]] = h["distance"], h["length"]
        words = rest.split(" ")
        best = chosen(words, windows(words, longest), {h["window"]: h["canon_id"] for h in hits if h["exact"]}, lambda w: near.get(w, {}), {h["canon_id"]: h["n"] or 0 for h in hits})
        return [(rest, *best)] if best else []

    return _exploded(together, choose, FOUND)


def typed_ingredients(spark, sf_dir: str) -> DataFrame:
    """(src_table, id, pos, text): ingredients elements of current layer1 rows and of det_ingrs rows with id."""
    one = lambda df, name: df.select(F.lit(name).alias("src_table"), "id", F.posexplode("ingredients.text").alias("pos", "text"))
    det = table(spark, sf_dir, "det_ingrs").where("id IS NOT NULL").withColumn("id", key("id"))
    return one(current(table(spark, sf_dir, "layer1").select("id", "ingredients", "loaded_at")), "layer1").unionByName(one(det, "det_ingrs"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Each typed ingredient with the entry it means, 0 for none."""
    found = mapped(typed_ingredients(spark, sf_dir), table(spark, sf_dir, "dim_ingredient"))
    return found.select("src_table", "id", "pos", "canon_id").distinct()


def p3_misses(spark, sf_dir: str) -> DataFrame:
    """Per table and entry (0: none) the typed values, those matched only by similarity, and their mean distance."""
    found = mapped(typed_ingredients(spark, sf_dir), table(spark, sf_dir, "dim_ingredient"))
    sums = found.groupBy("src_table", "canon_id").agg(F.count("*").alias("n_values"), F.count_if(F.col("distance") > 0).alias("n_similar"), F.avg("distance").alias("d"))
    return sums.select("src_table", "canon_id", "n_values", "n_similar", F.round("d", 6).alias("mean_distance"))
