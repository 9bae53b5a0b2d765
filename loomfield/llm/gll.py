"""A generalised LL parser with a graph-structured stack, for short inputs of one-character token classes.

Grammars may be ambiguous and left-recursive. The parser keeps call-return nodes (nonterminal, position) shared between all
alternatives that reach them, and gives the parses as binary subtrees (slot, start, split, end), after Scott and Johnstone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

Grammar = Mapping[str, Sequence[tuple[str, ...]]]
Slot = tuple[str, int, int]


def terminal(symbol: str) -> bool:
    """Terminals stand in quotes: '"abc"' matches one token of class a, b or c, '"^abc"' one of any other class."""
    return symbol[0] == '"'


def matches(symbol: str, token: str) -> bool:
    wanted = symbol[1:-1]
    return token not in wanted[1:] if wanted[0] == "^" and len(wanted) > 1 else token in wanted


class Parse:
    """All parses of the longest prefix of ``text`` that ``start`` derives from ``at``."""

    def __init__(self, grammar: Grammar, start: str, text: str, at: int = 0):
        self.grammar, self.text = grammar, text
        self.subtrees: set[tuple[Slot, int, int, int]] = set()
        self.splits: dict[tuple[Slot, int, int], int] = {}
        self._calls: dict[tuple[str, int], set[tuple[Slot, int]]] = {}
        self._ends: dict[tuple[str, int], set[int]] = defaultdict(set)
        self._seen: set[tuple[Slot, int, int]] = set()
        self._todo: list[tuple[Slot, int, int]] = []
        self._calls[start, at] = set()
        self._open(start, at)
        while self._todo:
            self._run(*self._todo.pop())
        self.start, self.at = start, at
        self.ends = sorted(self._ends.get((start, at), ()))

    def _add(self, slot: Slot, k: int, i: int) -> None:
        if (slot, k, i) not in self._seen:
            self._seen.add((slot, k, i))
            self._todo.append((slot, k, i))

    def _open(self, name: str, i: int) -> None:
        for n in range(len(self.grammar[name])):
            self._add((name, n, 0), i, i)

    def _subtree(self, slot: Slot, k: int, i: int, j: int) -> None:
        self.subtrees.add((slot, k, i, j))
        old = self.splits.get((slot, k, j))
        if old is None or i > old:
            self.splits[slot, k, j] = i

    def _run(self, slot: Slot, k: int, i: int) -> None:
        name, n, dot = slot
        body = self.grammar[name][n]
        while dot < len(body):
            symbol = body[dot]
            dot += 1
            if terminal(symbol):
                if i >= len(self.text) or not matches(symbol, self.text[i]):
                    return
                self._subtree((name, n, dot), k, i, i + 1)
                i += 1
                continue
            back, node = ((name, n, dot), k), (symbol, i)
            if node not in self._calls:
                self._calls[node] = {back}
                self._open(symbol, i)
            elif back not in self._calls[node]:
                self._calls[node].add(back)
                for h in list(self._ends[node]):
                    self._subtree(back[0], k, i, h)
                    self._add(back[0], k, h)
            return
        if i not in self._ends[name, k]:
            self._ends[name, k].add(i)
            for back, j in list(self._calls[name, k]):
                self._subtree(back, j, k, i)
                self._add(back, j, i)

    def find(self, wanted: str, end: int | None = None) -> tuple[int, int] | None:
        """(start, end) of the first ``wanted`` nonterminal in one derivation that ends at ``end`` (the longest)."""
        if not self.ends:
            return None
        stack = [(self.start, self.at, self.ends[-1] if end is None else end)]
        seen = set()
        while stack:
            name, i, j = stack.pop()
            if name == wanted:
                return i, j
            if (name, i, j) in seen:
                continue
            seen.add((name, i, j))
            for n, body in enumerate(self.grammar[name]):
                parts, right, dot = [], j, len(body)
                while dot:
                    left = self.splits.get(((name, n, dot), i, right))
                    if left is None:
                        break
                    if not terminal(body[dot - 1]):
                        parts.append((body[dot - 1], left, right))
                    right, dot = left, dot - 1
                if not dot and right == i:
                    stack.extend(parts)
                    break
        return None
