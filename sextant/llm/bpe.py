"""Merge lists of byte-pair tokenizers: reading them, applying them, and how far ahead they look."""

from __future__ import annotations

import json
from collections.abc import Callable, Hashable
from heapq import heapify, heappop, heappush


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes take the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Merges:
    """A merge list over token numbers. pairs: (left, right) -> rank; made: rank -> the token."""

    def __init__(self, text: str) -> None:
        """text: a tokenizer's JSON."""
        whole = json.loads(text)
        model = whole["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in whole["added_tokens"]}
        listed = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocabulary
        self.pairs = {(v[a], v[b]): rank for rank, (a, b) in reversed(list(enumerate(listed)))}
        self.made = [v[a + b] for a, b in listed]
        self.listed = listed
        self.letters = byte_letters()
        self.first = [v[c] for c in self.letters]

    def apply(self, ids: list[int]) -> list[int]:
        """The lowest-ranked pair is merged, the leftmost first, until none is left."""
        if len(ids) > 64:
            return self._apply_long(ids)
        get, made, none = self.pairs.get, self.made, 1 << 30
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _apply_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links to neighbours, for n log n steps."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rank := get((ids[k], ids[k + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, k, a, b = heappop(heap)
            m = after[k]
            if m >= n or ids[k] != a or ids[m] != b:
                continue
            ids[k], ids[m] = self.made[rank], -1
            after[k] = after[m]
            if after[m] < n:
                before[after[m]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q < n and (r := get((ids[p], ids[q]))) is not None:
                    heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def is_proper(self) -> bool:
        """Whether each merge's parts are single letters or made by merges before it, so ranks never fall in a chain."""
        known = set(self.letters) | {c + self.suffix for c in self.letters}
        for a, b in self.listed:
            if a not in known or b not in known:
                return False
            known.add(a + b)
        return True

    def lookahead(self) -> int:
        """Letters (bytes) that must follow a token's end before nothing that comes later can change it.

        Take a text and the same text carried on. The two differ first where a merge crosses the end of the shorter one:
        as far back as all but one of the merged letters. From then on a difference moves back only by a merge, in one
        of the two, whose right part stands first in what differs; it then reaches back by its left part's length, and
        what may stand first is that merge's token (in one) or its left part (in the other). What stands first may grow
        to the right by merges without reaching further back. As ranks only rise in such a chain, one pass over the
        merges in order of rank gives, for each token, how far back a difference that begins with it can reach; the
        largest is enough for every text. The merge list must be proper.
        """
        reach: dict[str, int] = {}
        for a, b in self.listed:
            ab = a + b
            most = len(ab.removesuffix(self.suffix) if self.suffix else ab) - 1
            if b in reach:
                most = max(most, reach[b] + len(a))
            for x, far in ((ab, max(most, reach.get(a, 0))), (a, most)):
                if far > reach.get(x, 0):
                    reach[x] = far
        return max(reach.values(), default=0) + 1


class Memory(dict):
    """key -> make(key), remembered in two generations of at most `most` keys: when the younger is full it becomes the
    older, whose keys come back when asked for and are else forgotten. Frequent keys stay, memory is bounded."""

    def __init__(self, make: Callable[[str], object], most: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.older: dict[Hashable, object] = {}

    def __missing__(self, key: str) -> object:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) < self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found
