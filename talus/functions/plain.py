"""The text functions for code that runs on Python strings, over all of Unicode."""

from __future__ import annotations

import re
import unicodedata

from talus.functions import fixed as X


def normalize(text: str) -> str:
    bare = (c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return " ".join("".join(bare).split())


def tokens(text: str) -> set[str]:
    return {w for w in ("".join(c for c in part if c.isalnum()) for part in normalize(text).split()) if w}


def distinctive(catalogue: list[str]) -> set[str]:
    seen = [tokens(n) for n in catalogue]
    words = set().union(*seen)
    return {w for w in words if len(w) >= 4 and 2 * sum(w in s for s in seen) < len(catalogue)}


def named_in_full(text: str, catalogue: list[str]) -> list[str]:
    """Names that stand in the text other than inside a longer name that does."""
    said = normalize(text)
    keys = {n: normalize(n) for n in catalogue}
    here = [n for n in catalogue if keys[n] in said]
    inside = lambda n: sum(said.count(keys[o]) * keys[o].count(keys[n]) for o in here if o != n and keys[n] in keys[o])
    return [n for n in here if said.count(keys[n]) > inside(n)]


_ADVICE_QUOTES = re.compile(X.QUOTED)


def fixed_reply(text: str) -> bool:
    """Whether a message is answered without a search: courtesy, a farewell, another centre."""
    said = tokens(text)
    if said and said <= set(X.COURTESY) and (said & set(X.FAREWELL) or said & set(X.GREETING) or any(set(p) <= said for p in X.GREETING_PAIRS)):
        return True
    if said & set(X.FAREWELL) and "?" not in text and not said & set(X.INTERROGATIVES):
        return True
    return any(p not in X.OWN_PLACES for p in re.findall(X.CENTRE, normalize(text)))
