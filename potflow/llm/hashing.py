"""Words of many texts as numbers, without a Python object per word.

The texts of a batch are folded as one string, its characters become an array, and all words are hashed by one cumulative
sum: the hash of a word is the polynomial of its characters, taken out of the sum and moved to the word's place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

from potflow.functions.text import DROPPED

_BASE = 0x9E3779B97F4A7C15
#: Characters that are taken at once, about.
CHUNK = 1 << 20


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


class WordHashes:
    """Hashes of the words of texts, the words being those of functions.text.words."""

    def __init__(self):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.word = np.zeros(0x110000, bool)
        for m in regex.finditer(r"[\p{L}\p{Nd}]+", every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            self.word[first : last + 1] = True
        self.word[0xD800:0xE000] = False
        self._powers(CHUNK + 1)

    def __getstate__(self) -> np.ndarray:
        return np.packbits(self.word)  # 139 kB for each task; the rest is made again

    def __setstate__(self, bits: np.ndarray) -> None:
        self.word = np.unpackbits(bits).astype(bool)
        self._powers(CHUNK + 1)

    def _powers(self, n: int) -> None:
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        self.up = np.cumprod(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        self.down = np.cumprod(steps)

    def chunks(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(first, end) of texts that are taken together: CHUNK characters or one text."""
        first = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > CHUNK // 2:
                yield first, i
                first, size = i, 0
            size += len(text) + 1
        if first < len(texts):
            yield first, len(texts)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, where the words of each text start and the last end). Neither has a limit of length."""
        parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for first, end in self.chunks(texts):
            hashes, n = self._joined(texts[first:end])
            parts.append(hashes)
            counts.append(n)
        return np.concatenate(parts), np.cumsum(np.concatenate(counts))

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
        if whole.isascii():
            codes = np.frombuffer(whole.lower().encode("ascii"), np.uint8)
        else:
            for c in DROPPED:
                whole = whole.replace(chr(c), "")
            codes = np.frombuffer(unicodedata.normalize("NFKC", whole).lower().encode("utf-32-le"), np.uint32)
        if len(codes) + 1 > len(self.up):
            self._powers(len(codes) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.word[codes]])))  # the string ends with no word
        starts, ends = edges[::2], edges[1::2]
        sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)])
        before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
        hashes = (sums[ends - 1] - before) * self.down[starts]
        limits = np.flatnonzero(codes == 0)
        return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.diff(np.searchsorted(starts, limits), prepend=0)
