import pickle
import random

import numpy as np

from potflow.functions.text import words
from potflow.llm.hashing import WordHashes


def test_words_and_hashes_are_those_of_the_text_functions():
    rng, hashes, known = random.Random(1), pickle.loads(pickle.dumps(WordHashes())), {}
    letters = "abcXYZ 0129 éÉßİΣσςﬁ½Å​­.,-'\n\0あ中٣ⅷ’K"
    texts = ["", "\0", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)), "a" * 1_500_000, "é b " * 300_000, "x"]
    for part in (texts, texts[:1], []):
        got, starts = hashes.of(part)
        assert len(starts) == len(part) + 1 and starts[-1] == len(got)
        for i, text in enumerate(part):
            ws = words(text)
            assert len(ws) == starts[i + 1] - starts[i], repr(text[:40])
            for w, h in zip(ws, got[starts[i] : starts[i + 1]].tolist()):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_many_different_words_have_different_hashes():
    got, _ = WordHashes().of([" ".join(f"w{i} {i}x" for i in range(200_000))])
    assert len(np.unique(got)) == 400_000
