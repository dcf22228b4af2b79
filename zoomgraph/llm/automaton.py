"""Regular expressions over bytes to one minimal automaton: parsing, subset construction, minimisation.

Understood: literals, escapes, [classes] with ranges, (groups), |, ?, *, +, {m}, {m,} and {m,n}."""

from __future__ import annotations

import numpy as np


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern.encode(), 0

    def peek(self) -> int:
        return self.p[self.i] if self.i < len(self.p) else -1

    def either(self):
        options = [self.sequence()]
        while self.peek() == ord("|"):
            self.i += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in (-1, ord("|"), ord(")")):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        x = self.atom()
        while (c := self.peek()) in (63, 42, 43, 123):  # ? * + {
            self.i += 1
            if c == ord("{"):
                end = self.p.index(b"}", self.i)
                low, _, high = self.p[self.i : end].decode().partition(",")
                least, most = int(low), (int(high) if high else None) if "," in self.p[self.i : end].decode() else int(low)
                self.i = end + 1
            else:
                least, most = {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}[c]
            tail = [("star", x)] if most is None else [("or", [x, ("seq", [])])] * (most - least)
            x = ("seq", [x] * least + tail)
        return x

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != ord("\\"):
            return c
        c = self.p[self.i]
        self.i += 1
        if c == ord("x"):
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(c, c)

    def atom(self):
        c = self.peek()
        if c == ord("("):
            self.i += 3 if self.p[self.i + 1 : self.i + 3] == b"?:" else 1
            x = self.either()
            self.i += 1
            return x
        if c != ord("["):
            return ("set", frozenset([self.char()]))
        self.i += 1
        found: set[int] = set()
        while self.peek() != ord("]"):
            a = self.char()
            if self.peek() == ord("-") and self.p[self.i + 1] != ord("]"):
                self.i += 1
                found |= set(range(a, self.char() + 1))
            else:
                found.add(a)
        self.i += 1
        return ("set", frozenset(found))


def _turned(x):
    """The expression of the reversed matches."""
    kind, arg = x
    if kind == "seq":
        return kind, [_turned(y) for y in reversed(arg)]
    return (kind, [_turned(y) for y in arg]) if kind == "or" else (kind, _turned(arg)) if kind == "star" else x


class Automaton:
    """One minimal deterministic automaton of several patterns.

    step[state * classes + kind[byte]] is the next state; state 0 is the start; states from ``accepting``
    on end a match of the patterns in the bit mask ends[state]. ``anywhere``: matches may begin at any byte, else
    at the first only. ``backward``: bytes are read from the last to the first, so a match ends where, read
    forward, it begins."""

    def __init__(self, patterns: list[str], anywhere: bool = True, backward: bool = False):
        edges: list[list[tuple[frozenset[int], int]]] = []
        free: list[list[int]] = []

        def new() -> int:
            edges.append([])
            free.append([])
            return len(edges) - 1

        def add(x, a: int, b: int) -> None:
            kind, arg = x
            if kind == "set":
                edges[a].append((arg, b))
            elif kind == "or":
                for y in arg:
                    add(y, a, b)
            elif kind == "star":
                m = new()
                free[a].append(m)
                add(arg, m, m)
                free[m].append(b)
            else:
                for y in arg[:-1]:
                    add(y, a, a := new())
                add(arg[-1], a, b) if arg else free[a].append(b)

        start = new()
        ends = {}
        for bit, p in enumerate(patterns):
            final = new()
            ends[final] = 1 << bit
            x = _Parser(p).either()
            add(_turned(x) if backward else x, start, final)
        # bytes that no set tells apart form a class
        marks = [0] * 256
        for k, s in enumerate({s for es in edges for s, _ in es}):
            for c in s:
                marks[c] |= 1 << k
        names = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        kind = np.array([names[m] for m in marks], np.uint8)
        sample = [int(np.argmax(kind == i)) for i in range(len(names))]

        def close(states: set[int]) -> frozenset[int]:
            todo = list(states)
            while todo:
                for y in free[todo.pop()]:
                    if y not in states:
                        states.add(y)
                        todo.append(y)
            return frozenset(states)

        first = close({start})
        number, table, todo = {first: 0}, [], [first]
        for s in todo:
            row = []
            for c in sample:
                t = close({b for a in s for symbols, b in edges[a] if c in symbols} | ({start} if anywhere else set()))
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                row.append(number[t])
            table.append(row)
        step = np.array(table)
        ended = np.array([sum({ends.get(a, 0) for a in s}) for s in todo])
        # minimisation: split groups of states until all of a group go to the same groups
        _, group = np.unique(ended, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
            if finer.max() == group.max():
                break
            group = finer.ravel()
        group = group.ravel()
        _, one = np.unique(group, return_index=True)
        order = sorted(range(len(one)), key=lambda g: (ended[one[g]] > 0, g != group[0]))
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        self.classes = len(names)
        self.kind = kind
        self.step = place[group[step[one[order]]]].astype(np.int32).ravel()
        self.ends = ended[one[order]]
        self.accepting = int((self.ends == 0).sum())
        rows = self.step.reshape(-1, self.classes)
        stuck = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(1) & (self.ends == 0))
        self.dead = int(stuck[0]) if len(stuck) else -1

    def longest(self, data: bytes, start: int, end: int) -> int:
        """Where the longest match that begins at ``start`` ends; -1 without one. For automata that begin at the first byte."""
        step, kind, ends, width = self.step, self.kind, self.ends, self.classes
        state, last = 0, -1
        for i in range(start, end):
            state = step[state * width + kind[data[i]]]
            if state == self.dead:
                break
            if ends[state]:
                last = i + 1
        return last

    def hits(self, data: np.ndarray, offs: np.ndarray, lane: int = 512, warm: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(position, mask) of every byte of a piece of documents at which patterns end a match.

        The documents are cut into lanes, which advance together, byte by byte. A lane that does not begin a
        document starts from the state that the ``warm`` bytes before it lead to; if the lane before ends in another
        one, it runs again from there, until all agree: the states are exact whatever the text."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = self.kind[data].astype(np.int32)
        size = np.diff(offs)
        lanes = -(-size // lane)
        head = np.cumsum(lanes) - lanes
        nth = np.arange(lanes.sum()) - np.repeat(head, lanes)
        start = np.repeat(offs[:-1], lanes) + nth * lane
        length = np.minimum(lane, np.repeat(offs[1:], lanes) - start)
        inner = np.flatnonzero(nth > 0)
        entry = np.zeros(len(start), np.int32)
        for t in range(-min(warm, lane), 0):
            entry[inner] = self.step[entry[inner] * self.classes + k[start[inner] + t]]
        final, version, found, todo, turn = entry.copy(), np.zeros(len(start), np.int32), [], np.arange(len(start)), 0
        while len(todo):
            todo = todo[np.argsort(-length[todo], kind="stable")]
            version[todo] = turn
            s, active = start[todo], np.searchsorted(-length[todo], -np.arange(1, length[todo[0]] + 1), "right")
            state = entry[todo]
            for t in range(length[todo[0]]):
                m = active[t]
                now = self.step[state[:m] * self.classes + k[s[:m] + t]]
                state[:m] = now
                if now.max() >= self.accepting:
                    hit = np.flatnonzero(now >= self.accepting)
                    found.append((todo[hit], np.full(len(hit), turn, np.int32), s[hit] + t, self.ends[now[hit]]))
            final[todo] = state
            todo = inner[final[inner - 1] != entry[inner]]
            entry[todo] = final[todo - 1]
            turn += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, when, at, mask = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = version[of] == when
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], mask[ok][order]
