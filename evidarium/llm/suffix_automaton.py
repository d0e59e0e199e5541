"""Squares of a sequence from its suffix automaton, whose suffix links are kept as a link-cut tree."""

from __future__ import annotations

from array import array
from collections.abc import Sequence


class SuffixAutomaton:
    """Grows by one symbol at a time. Its states form a tree by their suffix links; each path from a state to the root is
    made of segments, and all states of a segment ended last at the same place. A segment is a splay tree by depth, and the
    place stands at that tree's root, so a whole path is recoloured by joining its segments into one.

    States are numbered from 1 (the root); 0 is none. A state keeps one transition in arrays and further ones in a dict, as
    most states have one.
    """

    def __init__(self, n: int):
        room = 2 * n + 2
        none = lambda x=0: array("i", [x]) * room
        self.length, self.link, self.symbol, self.target = none(), none(), none(-1), none()
        self.up, self.left, self.right, self.ended = none(), none(), none(), none(-1)
        self.more: dict[int, dict[int, int]] = {}
        self.states = self.last = 1
        self.at = 0

    def step(self, state: int, symbol: int) -> int:
        if self.symbol[state] == symbol:
            return self.target[state]
        more = self.more.get(state)
        return more.get(symbol, 0) if more else 0

    def set_step(self, state: int, symbol: int, target: int) -> None:
        if self.symbol[state] in (-1, symbol):
            self.symbol[state], self.target[state] = symbol, target
        else:
            self.more.setdefault(state, {})[symbol] = target

    def splay(self, x: int) -> None:
        """Bring x to the root of its segment's tree, with the segment's colour."""
        up, left, right, ended = self.up, self.left, self.right, self.ended

        def rotate(x: int, y: int) -> None:
            z = up[y]
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
            else:
                ended[x] = ended[y]
            if left[y] == x:
                inner = left[y] = right[x]
                right[x] = y
            else:
                inner = right[y] = left[x]
                left[x] = y
            if inner:
                up[inner] = y
            up[x], up[y] = z, x

        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                rotate(y, z) if (left[z] == y) == (left[y] == x) else rotate(x, y)
                rotate(x, up[x])
            else:
                rotate(x, y)

    def append(self, symbol: int) -> list[tuple[int, int]]:
        """Append a symbol. Returns (length, period) of suffixes that are squares or longer powers, primitive ones only and
        each as long as that period reaches."""
        length, link, step = self.length, self.link, self.step
        self.states += 1
        new, p = self.states, self.last
        length[new] = length[p] + 1
        while p and not step(p, symbol):
            self.set_step(p, symbol, new)
            p = link[p]
        parent = 1
        if p:
            parent = step(p, symbol)
            if length[p] + 1 != length[parent]:
                parent = self.split(p, symbol, parent)
        link[new] = self.up[new] = parent
        self.last = new
        found = self.recolour(new)
        self.at += 1
        return found

    def split(self, p: int, symbol: int, long: int) -> int:
        """A state for the shorter strings of `long`, between it and its link; it ended last where `long` did, so it joins
        the same segment, just above."""
        self.states += 1
        short = self.states
        self.length[short] = self.length[p] + 1
        self.symbol[short], self.target[short] = self.symbol[long], self.target[long]
        if long in self.more:
            self.more[short] = dict(self.more[long])
        self.link[short], self.link[long] = self.link[long], short
        while p and self.step(p, symbol) == long:
            self.set_step(p, symbol, short)
            p = self.link[p]
        self.splay(long)
        above = self.left[short] = self.left[long]
        if above:
            self.up[above] = short
        self.left[long], self.up[short] = short, long
        return short

    def recolour(self, x: int) -> list[tuple[int, int]]:
        """The access operation: all states from x to the root end last at the present place now."""
        ended, right, at, found, below = self.ended, self.right, self.at, [], 0
        while x:
            self.splay(x)
            before = ended[x]
            # The longest string of the segment that is a suffix now ended `before`; where both places are no further
            # apart than it is long, the two occurrences overlap or touch.
            if 0 <= before and at - before <= self.length[x]:
                found.append((self.length[x] + at - before, at - before))
            if right[x]:
                ended[right[x]] = before
            right[x], below, x = below, x, self.up[x]
        ended[below] = at
        return found


def repetitions(symbols: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal repetition with at least two periods, by its smallest period.

    At each place from its second period on, a repetition is a suffix found with that period and its own start, so the last
    one found for a start and a period reaches its end.
    """
    automaton, ends = SuffixAutomaton(len(symbols)), {}
    for at, symbol in enumerate(symbols):
        for length, period in automaton.append(symbol):
            ends[at + 1 - length, period] = at + 1
    return sorted((start, end - start, period) for (start, period), end in ends.items())
