"""Small per-value helpers for spelled values: folding, deletes, weighted edit distance."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

#: Letters that do not decompose (fixed values).
LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "ð": "d"})
#: Keys of a typewriter by row, for neighbouring keys (fixed values).
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_REST = "[\u0080-\u00bfŒœŠšŸŽžƒˆ˜–-…‰‹›€™\ufffd]"
_GARBLED = re.compile(f"[Ã-ïâ]{_REST}{{2}}|[Â-ßâ-å]{_REST}")


def _bytes(text: str) -> bytes:
    raw = bytearray()
    for ch in text:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            raw += b"\x81" if ch == "\ufffd" else ch.encode("latin-1")
    return bytes(raw)


def _reread(found: re.Match) -> str:
    text = found.group()
    for form in (text, text[:1].upper() + text[1:]):
        for end in (len(form), 2):
            try:
                return _bytes(form[:end]).decode("utf-8") + form[end:]
            except UnicodeDecodeError:
                continue
    return text


def repair(text: str) -> str:
    """UTF-8 that was once read as Windows-1252 is read again; other text comes back as it is."""
    return _GARBLED.sub(_reread, text)


def hidden(text: str) -> str:
    """The text without invisible characters."""
    return _HIDDEN.sub("", text)


def fold(text: str) -> str:
    """Lower case without accents, invisible characters and compatibility forms."""
    plain = unicodedata.normalize("NFKD", hidden(text).translate(LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold().translate(LETTERS)


def squeeze(text: str) -> str:
    """Only the letters and digits."""
    return "".join(c for c in text if c.isalnum())


def deletes(word: str, distance: int, prefix: int = 10) -> list[str]:
    """The prefix of ``word`` with up to ``distance`` characters left out."""
    head = word[:prefix]
    found = {head}
    for n in range(1, min(distance, len(head)) + 1):
        for gone in combinations(range(len(head)), n):
            drop = set(gone)
            found.add("".join(c for i, c in enumerate(head) if i not in drop))
    return sorted(found)


@lru_cache(maxsize=1)
def _near() -> frozenset[tuple[str, str]]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return frozenset((a, b) for a in at for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1.01 and abs(at[a][1] - at[b][1]) <= 1)


def typo_cost(a: str, b: str, limit: float = 1e9) -> float:
    """Damerau-Levenshtein distance (adjacent transpositions) with cheap likely slips.

    A neighbouring key costs 0.7, a doubled or missing second letter 0.6, swapped letters
    0.7, anything else 1. Values beyond ``limit`` may come back as any value beyond it.
    """
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) * 0.6 > limit:
        return limit + 1
    near = _near()
    before: list[float] = []
    last = [0.0]
    for j, c in enumerate(b):
        last.append(last[-1] + (0.6 if j and b[j - 1] == c else 1.0))
    for i, x in enumerate(a):
        now = [last[0] + (0.6 if i and a[i - 1] == x else 1.0)]
        for j, y in enumerate(b):
            best = last[j] + (0.0 if x == y else 0.7 if (x, y) in near else 1.0)
            best = min(best, last[j + 1] + (0.6 if i and a[i - 1] == x else 1.0), now[j] + (0.6 if j and b[j - 1] == y else 1.0))
            if i and j and x != y and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 0.7)
            now.append(best)
        if min(now) > limit:
            return limit + 1
        before, last = last, now
    return last[-1]
