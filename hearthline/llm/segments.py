"""Cutting texts where no token of the public byte-level vocabularies can reach across."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space next to other white space may belong to either side's token; any other space starts a new one.
_BESIDE = tuple(x for w in " \n\t\r" for x in (w + " ", " " + w))
_RARE = re.compile("[" + "".join(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n\t\r") + "]")
#: A space between visible characters.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> tuple[str, list[str]]:
    """The text up to its first safe space, and the parts that follow one each (without that space).

    Pre-tokens take at most one leading space, and runs of white space only end before a space that precedes a
    visible character; so a space between visible characters always starts a pre-token, whatever surrounds it.
    """
    plain = text[:1] != " " and text[-1:] != " " and not any(x in text for x in _BESIDE) and not _RARE.search(text)
    parts = text.split(" ") if plain else SAFE.split(text)
    return parts[0], parts[1:]


class Memory(dict):
    """Results of ``compute`` by argument; when there are too many, those not asked for since the last time go."""

    def __init__(self, compute: Callable[[str], bytes], limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
