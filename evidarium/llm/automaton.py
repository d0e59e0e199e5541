"""Byte regexes of several rules as one minimal deterministic automaton in arrays, run over many lanes of text at once.

Each rule becomes an automaton whose states are threads: sets of places in its regex, one for each byte where a match that
is still possible began, the earliest first. The earliest thread wins, as in a leftmost search; as soon as it has matched,
the later ones, which began inside it, are dropped. The automaton of all rules is the product of these. It tells at each
byte which rules have a match that has just become as long as it can be. Where it began and ended is read off the states
that the one pass over the bytes has left behind, by following each thread's number backwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Texts are scanned side by side in so many lanes.
LANES = 4096
#: Bytes that are looked at together, at most, on the way back from a long match, and steps after which a match is long.
BLOCK, STEPS = 1 << 16, 2048
EVERY = frozenset(range(256))
NAMED = {"n": {10}, "t": {9}, "r": {13}, "d": set(range(48, 58)), "s": {9, 10, 11, 12, 13, 32}, "w": {*range(48, 58), *range(65, 91), 95, *range(97, 123)}}


class Nfa:
    """States with empty moves and moves on sets of bytes, grown from a regex: literals, escapes, sets, groups, |, ?, *, +
    and counts. No back references, anchors or lazy repeats."""

    def __init__(self, pattern: bytes):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.text, self.at = pattern.decode("latin-1"), 0
        self.begin = self.state()
        self.end = self.grow(self.options(), self.begin)
        if self.at < len(self.text):
            raise ValueError(f"not supported: {self.text[self.at :]}")

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1 : self.at]

    def options(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return ("any", found)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                part = ("repeat", part, *self.count())
                if self.peek() == "?":
                    raise ValueError("lazy repeats are not supported")
            parts.append(part)
        return ("all", parts)

    def count(self) -> tuple[int, int | None]:
        c = self.take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        low, comma, high = self.text[self.at : self.text.index("}", self.at)].partition(",")
        self.at = self.text.index("}", self.at) + 1
        return int(low or 0), (int(high) if high else None) if comma else int(low)

    def escaped(self) -> frozenset[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        if c.lower() in NAMED:
            return frozenset(NAMED[c]) if c in NAMED else EVERY - NAMED[c.lower()]
        if c.isalnum() or not c:
            raise ValueError(f"not supported: \\{c}")
        return frozenset([ord(c)])

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            body = self.options()
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return body
        if c == "[":
            return ("set", self.members())
        if c in "^$?*+{":
            raise ValueError(f"not supported: {c}")
        return ("set", self.escaped() if c == "\\" else EVERY - {10} if c == "." else frozenset([ord(c)]))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.at += negated
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            if not c:
                raise ValueError("a set is not closed")
            low = self.escaped() if c == "\\" else frozenset([ord(c)])
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else frozenset([ord(c)])
                found.update(range(min(low), max(high) + 1))
            else:
                found |= low
        self.take()
        return EVERY - found if negated else frozenset(found)

    def grow(self, node, at: int) -> int:
        """Append the regex after state `at`; the state in which it ends."""
        if node[0] == "set":
            end = self.state()
            hop = self.state()
            self.empty[at].append(hop)
            self.moves[hop] = (node[1], end)
            return end
        if node[0] == "all":
            for part in node[1]:
                at = self.grow(part, at)
            return at
        if node[0] == "any":
            end = self.state()
            for option in node[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.grow(option, begin)].append(end)
            return end
        _, body, low, high = node
        for _ in range(low):
            at = self.grow(body, at)
        if high is None:
            begin, end = self.state(), self.state()
            self.empty[at] += [begin, end]
            self.empty[self.grow(body, begin)] += [begin, end]
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[at].append(end)
            begin = self.state()
            self.empty[at].append(begin)
            at = self.grow(body, begin)
        self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.moves[s] or s == self.end)


class Rule(NamedTuple):
    """The automaton of one rule. A state is (whether the first thread has matched yet, threads)."""

    #: By state and byte class: next state, and whether the first thread's match ended before this byte.
    table: list[list[int]]
    over: list[list[bool]]
    #: By state and class: the number that each thread of the next state had before; -1 for one that begins here.
    came: list[list[tuple[int, ...]]]
    #: Whether the first thread has a match that ends here.
    accepts: list[bool]


def rule_of(nfa: Nfa, sample: list[int]) -> Rule:
    fresh = nfa.closure([nfa.begin])
    if nfa.end in fresh:
        raise ValueError("a rule matches nothing at all")
    start = (False, ())
    number, queue = {start: 0}, [start]
    table, over, came = [], [], []
    for matched, threads in queue:
        row, ended, from_ = [], [], []
        for b in sample:
            taken: set[int] = set()
            moved, origin = [], []
            for i, places in enumerate([*threads, fresh]):
                target = nfa.closure([m[1] for s in places if (m := nfa.moves[s]) and b in m[0]]) - taken
                if target:
                    taken |= target
                    moved.append(target)
                    origin.append(i if i < len(threads) else -1)
            lost = matched and (not origin or origin[0] != 0)
            still = matched and not lost
            if moved and nfa.end in moved[0]:
                moved, origin, still = moved[:1], origin[:1], True
            elif any(nfa.end in t for t in moved):
                raise ValueError("a match may end while an earlier one is still open")
            state = (still, tuple(moved))
            if state not in number:
                number[state] = len(queue)
                queue.append(state)
            row.append(number[state])
            ended.append(lost)
            from_.append(tuple(origin))
        table.append(row)
        over.append(ended)
        came.append(from_)
    return Rule(table, over, came, [bool(t) and nfa.end in t[0] for _, t in queue])


class Automaton:
    """classes: the class of each byte; table: next state by state and class, states premultiplied by the number of classes;
    over: by the same, bits of the rules with a match that ended before this byte. For each rule, came: by the same and a
    thread's number, which it had before, and accepts by state. resets: bytes after which nothing earlier matters."""

    def __init__(self, patterns: list[bytes]):
        nfas = [Nfa(p) for p in patterns]
        sets = list({m[0] for n in nfas for m in n.moves if m})
        kinds: dict[tuple, int] = {}  # bytes that every set treats alike form a class
        self.classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
        width = len(kinds)
        rules = [rule_of(n, [int(np.flatnonzero(self.classes == k)[0]) for k in range(width)]) for n in nfas]
        # Product of the rules' automata, as far as it can be reached.
        number, queue, table = {(0,) * len(rules): 0}, [(0,) * len(rules)], []
        for states in queue:
            row = []
            for k in range(width):
                target = tuple(r.table[s][k] for r, s in zip(rules, states))
                if target not in number:
                    number[target] = len(queue)
                    queue.append(target)
                row.append(number[target])
            table.append(row)
        table, each = np.array(table, np.int64), np.array(queue, np.int64)
        threads = max(len(c) for r in rules for row in r.came for c in row)
        came = np.full((len(rules), len(queue), width, threads), -2, np.int8)
        over = np.zeros((len(queue), width), np.int64)
        accepts = np.zeros((len(queue), len(rules)), bool)
        for bit, r in enumerate(rules):
            own = np.full((len(r.table), width, threads), -2, np.int8)
            for s, row in enumerate(r.came):
                for k, c in enumerate(row):
                    own[s, k, : len(c)] = c
            came[bit] = own[each[:, bit]]
            over |= np.array(r.over, np.int64)[each[:, bit]] << bit
            accepts[:, bit] = np.array(r.accepts)[each[:, bit]]
        # Minimisation: split blocks of states until all of a block do the same and go to the same blocks.
        does = np.hstack([over, accepts, *(came[bit].reshape(len(queue), -1) for bit in range(len(rules)))])
        block, count = np.unique(does, axis=0, return_inverse=True)[1].reshape(-1), 0
        while block.max() + 1 != count:
            count = block.max() + 1
            block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        first = np.unique(block, return_index=True)[1]
        table = block[table[first]]
        self.begin, self.width, self.states = int(block[0]) * width, width, len(first)
        self.table = (table * width).astype(np.int32).reshape(-1)
        self.over = over[first].astype(np.int32).reshape(-1)
        self.accepts = accepts[first]
        self.came = came[:, first].reshape(len(rules), -1, threads)
        quiet = np.array([(table[:, k] * width == self.begin).all() for k in range(width)])
        self.resets = quiet[self.classes]
        if not self.resets[10]:
            raise ValueError("a rule spans lines")

    def cuts(self, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where lanes begin, about every size bytes, and whether that is behind a reset byte; where none is for long, a lane
        begins anywhere."""
        stops = np.flatnonzero(self.resets[text]) + 1
        at = np.searchsorted(stops, np.arange(size, len(text), size))
        clean = np.unique(np.append(0, stops[at[at < len(stops)]]))
        clean = clean[clean < len(text)]
        gaps = np.diff(np.append(clean, len(text)))
        more = np.maximum(gaps // size - 1, 0)  # lanes within a gap of two sizes or more
        within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        begins = np.sort(np.append(clean, np.repeat(clean, more) + within * size))
        return begins, np.isin(begins, clean)

    def again(self, kinds: np.ndarray, begins: np.ndarray, size: np.ndarray, state: np.ndarray, trace: np.ndarray, write: bool) -> np.ndarray:
        """Run lanes from the given states until they are in the state that the trace has there, as they go on alike then. The
        states in which those end that never are; -1 for the others. write: correct the trace."""
        order = np.argsort(-size, kind="stable")
        at, state, left, lane = begins[order], state[order].astype(np.int32), size[order], order
        end = np.full(len(begins), -1, np.int32)
        while len(at):
            step = state + kinds[at]
            apart = trace[at] != step
            at, left, lane, step = at[apart], left[apart] - 1, lane[apart], step[apart]
            if write:
                trace[at] = step
            state, at = self.table[step], at + 1
            live = len(left) - np.searchsorted(left[::-1], 1)  # left falls
            end[lane[live:]] = state[live:]
            at, state, left, lane = at[:live], state[:live], left[:live], lane[:live]
        return end

    def passed(self, text: np.ndarray) -> np.ndarray:
        """The state before each byte and its class, as an index of the arrays. All lanes run side by side from the first
        state. A lane that begins within a line is corrected then: it runs again from the state in which the lane before it
        has ended, until both ways meet. A state that comes up so is tried on all such lanes at once, and few do."""
        begins, clean = self.cuts(text, max(64, len(text) // LANES))
        size = np.diff(np.append(begins, len(text)))
        order = np.argsort(-size, kind="stable")
        kinds = self.classes[text]
        trace = np.zeros(len(text), np.int32)
        state = np.full(len(begins), self.begin, np.int32)
        live = np.searchsorted(-size[order], -np.arange(size.max()), "left") if len(size) else ()  # lanes longer than t
        at = begins[order]
        for k in live:
            place = at[:k]
            step = state[:k] + kinds[place]
            trace[place] = step
            state[:k] = self.table[step]
            place += 1
        if clean.all():
            return trace
        ends = np.empty(len(begins), np.int32)
        ends[order] = state
        known, own = {self.begin: ends.tolist()}, np.flatnonzero(~clean)
        start, now = np.full(len(begins), self.begin, np.int32), self.begin
        for lane, fresh in enumerate(clean.tolist()):
            now = self.begin if fresh else now
            if now not in known:
                found, whole = self.again(kinds, begins[own], size[own], np.full(len(own), now), trace, False), ends.copy()
                whole[own] = np.where(found < 0, whole[own], found)
                known[now] = whole.tolist()
            start[lane] = now
            now = known[now][lane]
        wrong = np.flatnonzero(start != self.begin)
        self.again(kinds, begins[wrong], size[wrong], start[wrong], trace, True)
        return trace

    def steady(self, trace: np.ndarray, came: np.ndarray, at: int, thread: int) -> int:
        """The first place from which on, up to `at`, the thread has been this one."""
        block = 64
        while at > 0:
            low = max(0, at - block)
            other = np.flatnonzero(came[trace[low:at], thread] != thread)
            if len(other):
                return low + int(other[-1]) + 1
            at, block = low, min(2 * block, BLOCK)
        return 0

    def accepted(self, trace: np.ndarray, accepts: np.ndarray, low: int, at: int) -> tuple[int, int]:
        """The first and the last place from low to at where a match could have ended; -1 if there is none."""
        first = last = -1
        for block in range(low, at + 1, BLOCK):
            hits = np.flatnonzero(accepts[trace[block : min(block + BLOCK, at + 1)] // self.width])
            if len(hits):
                first, last = block + int(hits[0]) if first < 0 else first, block + int(hits[-1])
        return first, last

    def matches(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each rule its number and, of all its matches, where they begin, where they could first have ended, and where
        they end. Matches of a rule are leftmost, as long as can be and do not overlap. text ends in a reset byte."""
        trace = self.passed(text)
        ended = self.over[trace]
        for rule in range(len(self.came)):
            place = np.flatnonzero(ended >> rule & 1)
            came, accepts = self.came[rule], self.accepts[:, rule]
            thread = np.zeros(len(place), np.int64)
            begin, early, end = (np.full(len(place), -1) for _ in range(3))
            open_ = np.arange(len(place))
            at, steps = place.copy(), 0
            while len(open_):  # one byte back for all that have not come to their beginning
                steps += 1
                for m in open_.tolist() if steps > STEPS else ():  # the few long ones jump to where their thread changes
                    low = self.steady(trace, came, int(at[m]), int(thread[m]))
                    if thread[m] == 0:
                        first, last = self.accepted(trace, accepts, low, int(at[m]))
                        early[m] = early[m] if first < 0 else first
                        end[m] = last if end[m] < 0 else end[m]
                    at[m] = low
                here = (thread[open_] == 0) & accepts[trace[at[open_]] // self.width]
                early[open_[here]] = at[open_[here]]
                late = open_[here & (end[open_] < 0)]
                end[late] = at[late]
                at[open_] -= 1
                before = came[trace[at[open_]], thread[open_]]
                thread[open_] = before
                born = before < 0
                begin[open_[born]] = at[open_[born]]
                open_ = open_[~born]
            yield rule, begin, early, end
