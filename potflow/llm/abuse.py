"""Abusive, hateful and sexually explicit passages.

A document is read window by window (sentences and lines). The words of a window, also when they are spelled apart,
stretched, masked or mistyped, are looked up in a lexicon: a trie that a Levenshtein automaton is intersected with, so a
word one or two edits away is found without trying all terms. The window's score adds the weights of the terms, word
pairs and harmless words it holds; terms inside quotation marks next to a word of reporting count little. The document's
score is that of its worst window. A text without any word that could be a term has the least score and isn't cut up.

Terms, pairs and weights are learned from a bounded sample of labelled documents, with a fixed list of terms in five
languages as prior knowledge, which also stands alone if there are too few labels. The threshold is chosen on documents
that the weights weren't learned from.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.functions.text import fold, plain
from potflow.llm.shipping import Shipped
from potflow.sources.tables import spread, table

#: Labelled documents, and characters of them, that the weights are learned from, at most; chosen by a hash of doc_id.
SAMPLE, CHARACTERS = 8_000, 40_000_000
#: Parts of the labelled documents of which each is scored by the others to choose the threshold; toxic ones needed to learn.
FOLDS, ENOUGH = 5, 5
#: A word or pair that isn't in the list may count as bad if this many toxic documents have it, and so many times the share
#: that harmless ones have.
HELD, TIMES = 3, 6.0
#: Words of a window.
SPAN = 30
#: Terms of abuse, hate and explicit sexual content in English, German, French, Spanish and Italian that
#: suffice alone; terms that need company; word pairs of threats and hate.
STRONG = (
    "moron morons imbecile dimwit numbskull jackass dumbass dickhead asshole bitch whore slut sluts scumbag braindead subhuman motherfucker fuck fucked "
    "fucking cunt twat wanker retard porn porno pornos xxx nudes panties boobs pussy orgasm blowjob masturbate nigger faggot kike "
    "drecksau arschloch schwachkopf vollidiot wichser hurensohn schlampe fotze verpiss verprügeln nacktfotos missgeburt untermenschen "
    "connard connasse salope enculé débile abruti gilipollas cabrón puta desnuda cachondo coño pendejo maricón subnormal "
    "stronzo coglione cazzo puttana vaffanculo fottere crepi arrapato"
).split()
WEAK = (
    "idiot idiots pathetic loser worthless spineless cockroach vermin parasite filth swine cripples crap shitty shit bastard pig freak nude naked horny kinky "
    "naughty cock dick tits ass moaned undressed thighs cum stupid ugly disgusting disgusts fresse geil geile dreck widerlich ungeziefer scheiße "
    "pute putain merde vermine nue chatte mierda imbécil escoria zorra polla asqueroso schifo merda idiota cretino nuda feccia parassiti eccitato zitto"
).split()
PAIRS = [
    tuple(p.split("_"))
    for p in "hope_you you_die should_die drop_dead kill_you kill_yourself hurt_you beat_you break_your choke_on spit_on wiped_out shut_up piece_of waste_of fuck_you suck_my halt_die ferme_ta stai_zitto".split()
]
PRIOR = {t: 5.0 for t in STRONG} | {t: 2.0 for t in WEAK} | {p: 1.5 for p in PAIRS}
LEXICON = frozenset(STRONG) | frozenset(WEAK)
#: Ordinary words within the edits of a term, which need no harmless labelled document to be none.
ORDINARY = frozenset(
    "like bike hike luck duck buck puck suck tuck lick kick pick sick tick wick nick deck rock lock sock dock cook cork cocky corn born torn porn pork count aunt "
    "ditch pitch stitch witch where whole shore break bread freaky that what shut shot spit shirt slit slot wine swing thigh twine filth fresh rude dude nuke "
    "dich dicke hatte hätte pita pata puts pate merge olla bolla pollo marcha minute viver vivid".split()
) - LEXICON
#: Scores from which a threshold is chosen.
LOWEST = -0.8
#: Weight from which a learned word is looked for in disguise too, however frequent it is.
HEAVY = 1.0
#: Words of reporting; characters written for letters.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes reads heard word words term comment moderator deleted removed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó detto scritto chiamato".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_WINDOW = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|[\r\n]+")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·]{1,2}){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"[@$]?[^\W_](?:[^\W_]|[@$*!|€#_%]{1,3}(?=[^\W_]))*")
_MASK = re.compile(r"[*#_%]")
_QUOTED = re.compile(r"[\"“„«]([^\"“”„«»]{2,}?)[\"”“»]")
_NUMBERED = re.compile(r"(?<=[^\W\d_])\d{2,}$")
_SINGLE = re.compile(r"(?<!\w)['‘‚‹]([^'‘’‚‹›]{2,}?)['’›](?!\w)")
_LONG = re.compile(r"([^\W\d_])\1{2,}")


def prepared(text: str) -> str:
    """Folded, mark-up removed."""
    return fold(plain(text))


def joined(text: str) -> str:
    """Prepared text with letters spelled apart put together."""
    return _APART.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), text)


def word(raw: str) -> str | None:
    """A token as a word: characters written for letters as these, masked ones "?", stretched letters plain; None for numbers."""
    if not raw.isalpha():
        if raw.isdigit():
            return None
        raw = _NUMBERED.sub("", raw)
        raw = _MASK.sub("?", raw.translate(LEET)) if any(c.isalpha() for c in raw) else raw
    return _LONG.sub(r"\1", raw)


def tokens(window: str) -> list[str]:
    """The words of a window: letters spelled apart are joined, stretched ones made plain, masked ones "?"."""
    return [w for raw in _TOKEN.findall(joined(window)) if (w := word(raw)) is not None]


def windows(text: str, ready: bool = False) -> list[str]:
    """Sentences and lines of a text, prepared if it isn't ready; those of over SPAN words in overlapping parts."""
    out = []
    for w in _WINDOW.split(text if ready else prepared(text)):
        words = w.split(" ") if len(w) > 5 * SPAN else ()
        if len(words) > SPAN:
            out += [" ".join(words[i : i + SPAN]) for i in range(0, len(words) - SPAN // 3, 2 * SPAN // 3)]
        elif w and not w.isspace():
            out.append(w)
    return out


class Automaton:
    """Levenshtein automata with swapped neighbours for up to ``most`` edits, for words of any length and letters.

    A state holds what matters of a row of distances: the cells within ``most`` of the diagonal, and those a swap begun at the
    last letter would lead to. Which state follows depends only on which of the word's next letters are the one read, so
    the states are few. They are compiled when first met and kept.
    """

    def __init__(self, most: int):
        self.most, self.width, far = most, 2 * most + 1, most + 1
        first = tuple(abs(k - most) if k >= most else far for k in range(self.width))
        self.states = [(first, (far,) * self.width)]
        self.number = {self.states[0]: 0}
        self.steps: dict[tuple[int, int], int] = {}

    def step(self, state: int, like: int) -> int:
        """The state after a letter, -1 if no way leads on; bit k of like: the word's letter k - most places on is that letter."""
        after = self.steps.get((state, like))
        if after is None:
            (row, swap), far, cells = self.states[state], self.most + 1, []
            for k in range(self.width):
                best = row[k] + (0 if like >> k & 1 else 1)
                if k + 1 < self.width:
                    best = min(best, row[k + 1] + 1)
                if k:
                    best = min(best, cells[k - 1] + 1)
                    if like >> (k - 1) & 1:
                        best = min(best, swap[k])
                cells.append(min(best, far))
            begun = tuple(min(row[k] + 1, far) if like >> (k + 1) & 1 else far for k in range(self.width))
            after = -1
            if min(cells) < far or min(begun) < far:
                new = tuple(cells), begun
                after = self.number.setdefault(new, len(self.states))
                if after == len(self.states):
                    self.states.append(new)
            self.steps[state, like] = after
        return after


class Trie:
    """A lexicon that Levenshtein automata are intersected with."""

    def __init__(self, terms):
        self.root: dict = {}
        self.longest = 0
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            self.longest = max(self.longest, len(term))
        self.automata: dict[int, Automaton] = {}

    def near(self, word: str, most: int) -> tuple[str, int] | None:
        """The closest term within ``most`` edits, swapped neighbours being one; ties by the term. A "?" is any letter."""
        n, best = len(word), None
        if n > self.longest + most:
            return None
        automaton = self.automata.get(most) or self.automata.setdefault(most, Automaton(most))
        masks: dict[str, int] = {}
        any_ = 0
        for i, c in enumerate(word):
            if c == "?":
                any_ |= 1 << i
            else:
                masks[c] = masks.get(c, 0) | 1 << i
        window, states = (1 << (automaton.width + 1)) - 1, automaton.states
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, state = stack.pop()
            if "" in node and abs(n - depth) <= most:
                far = states[state][0][n - depth + most]
                if far <= most and (best is None or (far, node[""]) < (best[1], best[0])):
                    best = node[""], far
            if depth == n + most:
                continue
            shift = depth - most
            for c, child in node.items():
                if c:
                    mask = masks.get(c, 0) | any_
                    after = automaton.step(state, (mask >> shift if shift >= 0 else mask << -shift) & window)
                    if after >= 0:
                        stack.append((child, depth + 1, after))
        return best


def edits(word: str) -> int:
    """Edits in which a disguised word may differ from its term."""
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


class Model:
    """Weights of words and word pairs, a constant, the lexicon trie, the words that are no slips, and the threshold."""

    def __init__(self, weights: dict, common: set[str], constant: float = 0.0, threshold: float = 0.0):
        self.weights, self.common, self.constant, self.threshold = weights, common, constant, threshold
        self.terms = {f for f, w in weights.items() if isinstance(f, str) and w > 0.5 and (w >= HEAVY or f not in common)}
        self.bad = {f for f, w in weights.items() if w > 0}
        self.heads = {f[0] for f in self.bad if isinstance(f, tuple)}
        self.trie = Trie(t for t in self.terms if len(t) > 3)
        self.twice = 2 * max(map(len, self.terms), default=0)
        self.known: dict[str, str] = {}
        self.read: dict[str, tuple[tuple[str, str, bool, float, bool], ...]] = {}

    def term(self, word: str) -> str:
        """The term that a word stands for, or the word."""
        if word in self.terms or word in self.common:
            return word
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            hit = self.trie.near(word, edits(word)) if len(word) > 3 else None
            found = self.known[word] = hit[0] if hit else word
        return found

    def cut(self, word: str) -> int:
        """Where a word that is two terms is cut, else 0."""
        if not 7 < len(word) <= self.twice or word in self.weights or word in self.common:
            return 0
        return next((k for k in range(3, len(word) - 2) if word[:k] in self.terms and word[k:] in self.terms), 0)

    def merged(self, first: str, second: str) -> str | None:
        """The term that two neighbours only together are."""
        if first in self.common and second in self.common or first in self.terms or second in self.terms:
            return None
        both = first + second
        return t if len(both) > 4 and both not in self.common and (t := self.term(both)) in self.terms else None

    def resolved(self, words: list[str]) -> list[str]:
        """Words as terms; two neighbours that only together are a term become one, one that is two terms becomes two."""
        out, i = [], 0
        while i < len(words):
            w = words[i]
            if i + 1 < len(words) and (t := self.merged(w, words[i + 1])):
                out.append(t)
                i += 2
                continue
            t = self.term(w)
            cut = self.cut(w) if t == w else 0
            out += [w[:cut], w[cut:]] if cut else [t]
            i += 1
        return out

    def _read(self, chunk: str) -> tuple[tuple[str, str, bool, float, bool], ...]:
        """The words of a run of characters: (word, its term, whether it is usual, its weight if bad, whether it begins a bad pair)."""
        if len(self.read) > 200_000:
            self.read.clear()
        found = []
        for raw in _TOKEN.findall(chunk):
            if (w := word(raw)) is not None:
                t = self.term(w)
                bad = 1e9 if t == w and self.cut(w) else max(0.0, self.weights.get(t, 0.0))
                found.append((w, t, w in self.common, bad, t in self.heads))
        self.read[chunk] = tuple(found)
        return self.read[chunk]

    def suspicious(self, text: str) -> bool:
        """Whether a window of a prepared text could reach the threshold: what its different words and pairs weigh that count
        as bad, together with the constant. Two words that only together are a term decide it."""
        get, needed, total, terms = self.read.get, self.threshold - self.constant, 0.0, set()
        last, term, shielded, head = None, None, True, False
        for chunk in joined(text).split():
            found = get(chunk)
            for w, t, usual, bad, first in self._read(chunk) if found is None else found:
                if bad and t not in terms:
                    terms.add(t)
                    total += bad
                if head and (pair := (term, t)) in self.bad and pair not in terms:
                    terms.add(pair)
                    total += self.weights[pair]
                if not (usual and shielded) and last is not None and self.merged(last, w):
                    return True
                last, term, shielded, head = w, t, usual, first
            if total >= needed:
                return True
        return False

    def score(self, window: str, before: str = "") -> float:
        """The score of a window; ``before`` is the window that it follows, which may report what this one quotes."""
        words = self.resolved(tokens(window))
        get = self.weights.get
        total = sum(get(f, 0.0) for f in features(words))
        if total > 0 and (REPORTING.intersection(words) or before.endswith(":") and REPORTING.intersection(tokens(before))):
            for quoted in [*_QUOTED.findall(window), *_SINGLE.findall(window)]:
                total -= 0.8 * max(0.0, sum(get(f, 0.0) for f in features(self.resolved(tokens(quoted)))))
        return total + self.constant

    def document(self, text: str) -> tuple[float, int, int]:
        """(score of the worst window, its number, windows at or above the threshold); the constant and -1 if no window can
        reach the threshold. Windows that can't are not scored."""
        ready = prepared(text)
        if not self.suspicious(ready):
            return self.constant, -1, 0
        parts, worst, at, n = windows(ready, True), self.constant, -1, 0
        for i, w in enumerate(parts):
            if self.suspicious(w):
                s = self.score(w, parts[i - 1] if i else "")
                n += s >= self.threshold
                if at < 0 or s > worst:
                    worst, at = s, i
        return worst, at, n


def features(words: list[str]) -> set:
    """Words and neighbours of a window."""
    return {*words, *zip(words, words[1:])}


def fitted(flat: np.ndarray, owner: np.ndarray, bad: np.ndarray, prior: np.ndarray, free: np.ndarray, empty: int, start: np.ndarray | None = None, rounds: int = 80, penalty: float = 4.0) -> np.ndarray:
    """Weights of a logistic model, the last one its constant, drawn towards the prior ones; only those of ``free`` features
    may be above 0. flat, owner: feature numbers and the rows that have them; empty: how many harmless rows without features
    there are besides."""
    n = len(bad)
    goal, weight = bad.astype(np.float64), np.where(bad, 2.0, 1.0)
    w = np.append(prior, -2.0) if start is None else start.copy()
    top = np.where(np.append(free, True), np.inf, 0.0)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], n) + w[-1], -30, 30)))
        error = (p - goal) * weight
        rest = empty / (1 + np.exp(-np.clip(w[-1], -30, 30)))
        slope = np.append(np.bincount(flat, error[owner], len(prior)) + penalty / 4 * (w[:-1] - prior), error.sum() + rest)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = np.minimum(w - 0.15 * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6), top)
    return w


def no_slips(weights: dict, usual: frozenset[str], harmless: Counter) -> set[str]:
    """Words to be read as they stand. harmless: in how many harmless labelled documents a word is. Two of these suffice.
    A usual word needs one if it is masked or within the edits of a term, as disguises can be frequent too."""
    trie = Trie(t for t in LEXICON.union(f for f, w in weights.items() if isinstance(f, str) and w >= HEAVY) if len(t) > 3)

    def suspect(word: str) -> bool:
        return "?" in word or len(word) > 3 and word not in ORDINARY and trie.near(word, edits(word)) not in (None, (word, 0))

    held = {w for w, n in harmless.items() if n > 1}
    return {w for w in held.union(w for w in usual if harmless[w] or not suspect(w)) if w not in LEXICON}


class Sample:
    """Labelled documents cut into windows of numbered features. A document is toxic if it has a bad window, not known which."""

    def __init__(self, documents: list[tuple[str, int]]):
        self.toxic = np.array([bool(t) for _, t in documents], bool)
        votes: Counter = Counter()
        for text, toxic in documents:
            votes[text] += 1 if toxic else -1
        self.mostly = np.array([votes[text] > 0 for text, _ in documents], bool)
        seen: set[str] = set()
        self.first = np.array([not (text in seen or seen.add(text)) for text, _ in documents], bool)  # copies count once
        number: dict = {f: i for i, f in enumerate(PRIOR)}
        docs, sizes, flat = [], [], []
        for d, (text, _) in enumerate(documents):
            for w in windows(text):
                own = features(tokens(w))
                docs.append(d)
                sizes.append(len(own))
                flat += [number.setdefault(f, len(number)) for f in own]
        self.names = list(number)
        self.doc, self.flat = np.array(docs, np.int64), np.array(flat, np.int64)
        self.owner = np.repeat(np.arange(len(docs)), sizes)
        pairs = np.unique(self.doc[self.owner] * len(number) + self.flat) if docs else np.zeros(0, np.int64)
        self.of_doc, self.of_feature = np.divmod(pairs, max(1, len(number)))

    def held(self, of: np.ndarray) -> np.ndarray:
        """In how many of the documents each feature is."""
        return np.bincount(self.of_feature[of[self.of_doc]], minlength=len(self.names))

    def weights(self, use: np.ndarray) -> tuple[dict, float]:
        """(weights of features, constant) learned from the documents ``use``. In turns the worst windows of toxic documents are
        taken as bad and the weights fitted to that; documents without a window that looks bad, as wrong labels have, are left
        out from the second turn on. Windows without a feature that may count as bad teach nothing and are left out.

        Besides those of the list, features may count as bad that HELD toxic documents have and TIMES the share of harmless
        ones; a pair only with such a word or one of the list, or if twice as many have it."""
        toxic, harmless = self.held(use & self.toxic & self.first), self.held(use & ~self.toxic & self.first)
        often = (toxic >= HELD) & (toxic >= TIMES * (use & self.toxic).sum() / max(1, (use & ~self.toxic).sum()) * (harmless + 0.5))
        prior = np.zeros(len(self.names))
        prior[: len(PRIOR)] = list(PRIOR.values())
        words = {self.names[i] for i in np.flatnonzero(often) if isinstance(self.names[i], str)} | LEXICON
        free = prior > 0
        for i in np.flatnonzero(often):
            f = self.names[i]
            free[i] |= isinstance(f, str) or not words.isdisjoint(f) or toxic[i] >= 2 * HELD
        own = use[self.doc] & (np.bincount(self.owner, free[self.flat], len(self.doc)) > 0)
        counts = np.bincount(self.flat[own[self.owner]], minlength=len(self.names))
        kept = np.flatnonzero((counts > 2) | free)
        place = np.full(len(self.names), -1)
        place[kept] = np.arange(len(kept))
        row = np.cumsum(own) - 1
        inside = own[self.owner] & (place[self.flat] >= 0)
        flat, owner, doc = place[self.flat[inside]], row[self.owner[inside]], self.doc[own]
        bad, used, w = self.toxic[doc], np.ones(len(doc), bool), None
        for _ in range(4):
            among = used[owner]
            w = fitted(flat[among], (np.cumsum(used) - 1)[owner[among]], bad[used], prior[kept], free[kept], max(len(doc), 20), w)
            score = np.bincount(owner, w[flat], len(doc)) + w[-1]
            top = np.full(len(self.toxic), -1e9)
            np.maximum.at(top, doc, score)
            bad = self.toxic[doc] & (score >= np.maximum(-1.0, np.minimum(top[doc], 0.5)))
            used = ~self.toxic[doc] | (top[doc] >= -1.0)
        return {self.names[i]: round(float(x), 4) for i, x in zip(kept, w) if abs(x) > 0.02}, round(float(w[-1]), 4)


def learned(documents: list[tuple[str, int]], usual: frozenset[str] = frozenset()) -> Model:
    """A model from (text, toxic) pairs; with fewer than ENOUGH toxic ones, or none harmless, the list alone. usual: words
    frequent in the collection, see no_slips. Copies of a text that are mostly labelled toxic are no harmless documents.

    The threshold is that of the greatest F1 over all documents, each scored by a model of the other folds."""
    sample = Sample(documents)
    held = sample.held(~sample.toxic & ~sample.mostly)
    harmless = Counter({sample.names[i]: int(held[i]) for i in np.flatnonzero(held) if isinstance(sample.names[i], str)})
    if sample.toxic.sum() < ENOUGH or sample.toxic.all():
        return Model(dict(PRIOR), no_slips(PRIOR, usual, harmless), -4.5, 0.0)
    fold_of = np.array([hash_of(text) % FOLDS for text, _ in documents])  # copies stay together
    scored = []
    for k in range(FOLDS):
        own = fold_of == k
        if own.any() and (sample.toxic & ~own).sum() >= ENOUGH:
            weights, constant = sample.weights(~own)
            model = Model(weights, no_slips(weights, usual, harmless), constant, LOWEST)
            scored += [(model.document(documents[d][0])[0], bool(sample.toxic[d])) for d in np.flatnonzero(own)]
    weights, constant = sample.weights(np.ones(len(documents), bool))
    model = Model(weights, no_slips(weights, usual, harmless), constant)
    scored.sort(reverse=True)
    total, right, best = sum(t for _, t in scored), 0, (-1.0, 0.0)
    for i, (s, t) in enumerate(scored):
        right += t
        after = scored[i + 1][0] if i + 1 < len(scored) else s - 1
        if after < s and LOWEST < (s + after) / 2 < 1.0 and (f1 := 2 * right / (i + 1 + total)) > best[0] + 1e-9:
            best = f1, (s + after) / 2
    model.threshold = best[1]
    return model


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def usual_words(documents: DataFrame, share: float = 0.001, least: int = 3) -> frozenset[str]:
    """Words in at least ``share`` of all distinct texts, so that copies of one text make none of its words usual. As a
    text adds each of its words once, there are at most 1 / share times as many as a text has on average, however large
    the collection."""
    texts = documents.where("text IS NOT NULL").select("text").distinct()
    enough = texts.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share))).scalar()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r["word"] for r in counts.where(F.col("n") >= enough).select("word").toLocalIterator())


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    """A model from at most ``sample`` labelled documents of ``characters`` characters together, chosen by hash. Null labels
    and texts are left out; of several labels of a document the more frequent one counts, of equally many the harmless one.
    It is learned in a task; the driver gets the model."""
    votes = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= characters)
    usual = usual_words(documents)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        kept, size = [], 0
        for _, text, toxic in sorted(rows, key=lambda r: (hash_of(str(r[0])), r)):
            size += len(text)
            if size > characters:
                break
            kept.append((text, toxic))
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(learned(sorted(kept), usual))], pa.binary())], names=["model"])

    model = rows.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(model["model"]) if model else learned([], usual)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text, source) -> (doc_id, source, score, worst_window, n_bad_windows, flagged), a row per
    document row. Null and blank texts have the least score and aren't flagged."""
    shared = Shipped(documents.sparkSession, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.load()
        types = (pa.float64(), pa.int32(), pa.int32(), pa.bool_())
        for batch in batches:
            rows = [(round(s, 6), at, n, s >= model.threshold) for s, at, n in (model.document(t) if t else (model.constant, -1, 0) for t in batch.column(2).to_pylist())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "source", "score", "worst_window", "n_bad_windows", "flagged"])

    rows = spread(documents.select("doc_id", F.col("source").cast("string"), "text"))
    return rows.mapInArrow(judge, "doc_id long, source string, score double, worst_window int, n_bad_windows int, flagged boolean")


def judged(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scores(documents, trained(documents, table(spark, sf_dir, "doc_labels")))


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents with a passage that insults, threatens, degrades or is sexually explicit."""
    return judged(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p9_rates(spark, sf_dir: str) -> DataFrame:
    """Documents, flagged ones and their share per source."""
    sums = judged(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"))
    return sums.select("source", "n_docs", "n_flagged", F.round(F.col("n_flagged") / F.col("n_docs"), 6).alias("rate"))
