"""Per-task caches over pre-tokens, the pieces that byte-level BPE merges within."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

#: Entries kept for each task; beyond them the cache starts anew, so that memory stays bounded.
CACHE_ENTRIES = 250_000


class PieceCache:
    """Maps pieces to values; the pieces that it lacks are computed together, many in one call."""

    def __init__(self, compute: Callable[[list[str]], Iterable], pattern: str, entries: int = CACHE_ENTRIES) -> None:
        self.compute, self.findall, self.entries, self.known = compute, regex.compile(pattern).findall, entries, {}

    def values(self, texts: list[str]) -> list[list]:
        """The values of each text's pieces, in order."""
        pieces = [self.findall(t) for t in texts]
        new = list(set().union(*pieces).difference(self.known))
        if len(self.known) + len(new) > self.entries:
            self.known = {}
            new = list(set().union(*pieces))
        self.known.update(zip(new, self.compute(new), strict=True))
        get = self.known.__getitem__
        return [list(map(get, p)) for p in pieces]
