"""Words of marked-up text: what a reader sees, without case, accents and punctuation."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

_COMMENT = re.compile(r"<!--|-->")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_QUOTES = re.compile(r"'{2,}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_WEB = re.compile(r"\[(?:[a-z][a-z0-9+.-]*:)?//[^\s\[\]]+\s*([^\[\]]*)\]", re.I)
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]+")


def visible(text: str) -> str:
    """Markup taken away: tags and comment marks are blanks, bold and italics nothing, links the words they show, entities their characters."""
    t = text
    if "<" in t or "-->" in t:
        t = _TAG.sub(" ", _COMMENT.sub(" ", t))
    if "''" in t:
        t = _QUOTES.sub("", t)
    if "[" in t:
        while True:  # links inside a link's caption come first
            new = _LINK.sub(r"\1", t)
            if new == t:
                break
            t = new
        if "//" in t:
            t = _WEB.sub(r"\1", t)
    if "&" in t:
        t = html.unescape(t)
    return t


def tokens(text: str) -> list[str]:
    """Runs of letters and digits in lower case, accents still on."""
    t = visible(text).lower()
    if not unicodedata.is_normalized("NFC", t):
        t = _MARKS.sub("", unicodedata.normalize("NFC", t))
    return _WORD.findall(t)


def plain(token: str) -> list[str]:
    """The words of one token without accents: one, or several where a character stands for more."""
    if token.isascii():
        return [token]
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", token)).casefold())


def words(text: str | None) -> list[str]:
    """All words of a text, normalised; none for null."""
    if not text:
        return []
    out: list[str] = []
    for t in tokens(text):
        if t.isascii():
            out.append(t)
        else:
            out.extend(plain(t))
    return out


class WordHashes(dict):
    """Token to the 64-bit hashes of its words, filled on demand.

    With ``vocabulary`` (word hashes), words outside it become 0.
    """

    LIMIT = 500_000

    def __init__(self, vocabulary: frozenset[int] | None = None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        got = tuple(h if self.vocabulary is None or h in self.vocabulary else 0 for h in (word_hash(w) for w in plain(token)))
        self[token] = got
        return got

    def of(self, text: str) -> list[int]:
        out: list[int] = []
        for t in map(self.__getitem__, tokens(text)):
            out += t
        return out


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) | 1


BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Karp-Rabin hashes of all windows of any length over one sequence of word hashes (mod 2**64)."""

    def __init__(self, v: np.ndarray):
        n = len(v)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE, np.uint64))), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INVERSE, np.uint64))), dtype=np.uint64)
            self.prefix = np.concatenate(([np.uint64(0)], np.cumsum(v * power[:n], dtype=np.uint64)))
        self.n = n

    def windows(self, k: int) -> np.ndarray:
        """Hash of the window of ``k`` words starting at each place."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.prefix[k:] - self.prefix[: self.n - k + 1]) * self.inverse[: self.n - k + 1]
