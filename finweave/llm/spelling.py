"""Folding of spellings, bounded edit distance and the symmetric-delete neighbourhood."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash

# Letters and pairs that are often written for one another.
ALIKE = {"y": "i", "w": "v", "c": "k", "q": "k", "z": "s"}
PREFIX = 7


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ł", "l").replace("ø", "o"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


@lru_cache(200_000)
def fold(token: str) -> str:
    """Letters that sound alike become one, doubled letters single."""
    token = token.replace("ou", "u").replace("ph", "f")
    return re.sub(r"(.)\1+", r"\1", "".join(ALIKE.get(c, c) for c in token))


@lru_cache(500_000)
def distance(a: str, b: str, most: int) -> int:
    """Edits with neighbouring swaps between two strings, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            x = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, older[j - 2] + 1)
            row.append(x)
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """Edits that two folded tokens of this length may differ by and still be one word."""
    n = max(len(a), len(b))
    return 0 if n <= 3 else 1 if n <= 7 else 2 if n <= 12 else 3


@lru_cache(200_000)
def neighbourhood(token: str) -> tuple[str, ...]:
    """The token's prefix with up to two letters deleted: tokens of three letters or more that are at most two edits apart share a member."""
    head = token[:PREFIX]
    once = {head[:i] + head[i + 1 :] for i in range(len(head))}
    twice = {t[:i] + t[i + 1 :] for t in once for i in range(len(t))} if len(token) >= 3 else set()
    return tuple(sorted({head} | once | twice))


def meet(a: str, b: str) -> bool:
    """Whether two folded tokens share a member of their neighbourhoods, so that an index of these brings them together."""
    return not set(neighbourhood(a)).isdisjoint(neighbourhood(b))


def key(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode()), "big", signed=True)
