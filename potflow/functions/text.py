"""Text as terms and words. Used inside Arrow batches; plain Python."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Characters that are dropped before anything else (zero width space and joiner, soft hyphen, byte order mark).
DROPPED = dict.fromkeys(map(ord, "\u200b\u200d\u00ad\ufeff"))
_DROPPED = "".join(map(chr, DROPPED))
_ASCII_TERM, _TERM = re.compile(r"[a-z]+"), regex.compile(r"\p{L}+")
_ASCII_WORD, _WORD = re.compile(r"[a-z0-9]+"), regex.compile(r"[\p{L}\p{Nd}]+")
_TAG = re.compile(r"<!--.*?-->|<[/!?]?[A-Za-z][^<>]*>", re.S)


def fold(text: str) -> str:
    """Without invisible characters, NFKC, lower case."""
    if text.isascii():
        return text.lower()
    for c in _DROPPED:
        if c in text:
            text = text.replace(c, "")
    return unicodedata.normalize("NFKC", text).lower()


def terms(text: str) -> list[str]:
    """Maximal runs of letters of the folded text."""
    text = fold(text)
    return _ASCII_TERM.findall(text) if text.isascii() else _TERM.findall(text)


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits of the folded text."""
    text = fold(text)
    return _ASCII_WORD.findall(text) if text.isascii() else _WORD.findall(text)


def plain(text: str) -> str:
    """Entity codes decoded, mark-up tags as spaces."""
    if "&" in text:
        text = html.unescape(text)
    return _TAG.sub(" ", text) if "<" in text else text
