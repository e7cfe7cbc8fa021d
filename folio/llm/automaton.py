"""A deterministic automaton over bytes, scanned over many overlapping chunks at once.

Patterns in a small regular grammar (literals, classes, groups, ``? * + {m,n}``) become one
NFA and by subset construction one DFA.  The scan cuts a buffer into chunks that overlap by
the longest possible match and advances all chunks together, one byte position a step, so the
work a byte costs is one table lookup in a numpy kernel.  Hits of the overlaps are reported by
absolute offset, once.
"""

from __future__ import annotations

import numpy as np

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_SETS = {"s": " \t\r\n\f\v", "d": "0123456789", "w": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []
        self.accept: dict[int, int] = {}

    def node(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1


class _Parser:
    """Recursive descent from pattern text to NFA fragments (start, end)."""

    def __init__(self, nfa: _Nfa, pattern: str, fold: bool) -> None:
        self.nfa, self.p, self.i, self.fold = nfa, pattern, 0, fold

    def alternatives(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.node(), self.nfa.node()
        for x, y in parts:
            self.nfa.eps[a].append(x)
            self.nfa.eps[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = end = self.nfa.node()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self.repeated()
            self.nfa.eps[end].append(x)
            end = y
        return a, end

    def repeated(self) -> tuple[int, int]:
        at = self.i
        frag = self.atom()
        if self.i < len(self.p) and self.p[self.i] in "?*+{":
            q = self.p[self.i]
            if q == "{":
                close = self.p.index("}", self.i)
                lo, _, hi = self.p[self.i + 1 : close].partition(",")
                low, high = int(lo), int(hi or lo)
                self.i = close + 1
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[q]
                self.i += 1
            after = self.i
            frags = [frag]
            for _ in range((high if high is not None else max(low, 1)) - 1):
                self.i = at
                frags.append(self.atom())
            self.i = after
            a = end = self.nfa.node()
            out = self.nfa.node()
            for k, (x, y) in enumerate(frags):
                if k >= low:
                    self.nfa.eps[end].append(out)
                self.nfa.eps[end].append(x)
                end = y
            self.nfa.eps[end].append(out)
            if high is None:
                self.nfa.eps[frags[-1][1]].append(frags[-1][0])
            return a, out
        return frag

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            frag = self.alternatives()
            self.i += 1
            return frag
        if c == "[":
            return self.edge(self.char_class())
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            return self.edge(frozenset(map(ord, _SETS[c])) if c in _SETS else self.literal(_ESCAPES.get(c, c)))
        if c == ".":
            return self.edge(frozenset(range(1, 256)) - {10})
        return self.edge(self.literal(c))

    def literal(self, c: str) -> frozenset[int]:
        return frozenset({ord(c.lower()), ord(c.upper())} if self.fold else {ord(c)})

    def char_class(self) -> frozenset[int]:
        negated = self.p[self.i] == "^"
        self.i += negated
        chars: set[int] = set()
        while self.p[self.i] != "]":
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                c = self.p[self.i]
                self.i += 1
                if c in _SETS:
                    chars |= set(map(ord, _SETS[c]))
                    continue
                c = _ESCAPES.get(c, c)
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                hi = self.p[self.i + 1]
                self.i += 2
                chars |= set(range(ord(c), ord(hi) + 1))
            else:
                chars.add(ord(c))
        self.i += 1
        if self.fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
        return frozenset(set(range(1, 256)) - chars) if negated else frozenset(chars)

    def edge(self, chars: frozenset[int]) -> tuple[int, int]:
        a, b = self.nfa.node(), self.nfa.node()
        self.nfa.step[a] = (chars, b)
        return a, b


class Automaton:
    """DFA of named patterns. ``patterns``: (name, pattern, ignore case); byte 0 resets it."""

    def __init__(self, patterns: list[tuple[str, str, bool]], longest: int = 256) -> None:
        self.names = [p[0] for p in patterns]
        self.longest = longest
        nfa = _Nfa()
        root = nfa.node()
        for k, (_, text, fold) in enumerate(patterns):
            a, b = _Parser(nfa, text, fold).alternatives()
            nfa.eps[root].append(a)
            nfa.accept[b] = k
        closure: dict[int, int] = {}

        def close(n: int) -> int:
            """Bit set of the consuming and accepting nodes reachable without a byte."""
            if n not in closure:
                seen, todo = {n}, [n]
                while todo:
                    for m in nfa.eps[todo.pop()]:
                        if m not in seen:
                            seen.add(m)
                            todo.append(m)
                closure[n] = sum(1 << m for m in seen if nfa.step[m] or m in nfa.accept)
            return closure[n]

        # bytes that no pattern tells apart share a class
        sets = {s[0] for s in nfa.step if s}
        marks: dict[int, list[int]] = {b: [] for b in range(256)}
        for k, s in enumerate(sorted(sets, key=sorted)):
            for b in s:
                marks[b].append(k)
        classes: dict[tuple[int, ...], int] = {}
        self.byte_class = np.array([classes.setdefault(tuple(marks[b]), len(classes)) for b in range(256)], np.int32)
        n = len(classes)
        moves = [(sorted({int(self.byte_class[b]) for b in s[0]}), close(s[1])) if s else ([], 0) for s in nfa.step]
        start = close(root)
        number, table, accepts, todo = {start: 0}, [], [], [start]
        for here in todo:
            row, accept, rest = [start] * n, 0, here
            while rest:
                low = rest & -rest
                rest ^= low
                m = low.bit_length() - 1
                if m in nfa.accept:
                    accept |= 1 << nfa.accept[m]
                on, there = moves[m]
                for c in on:
                    row[c] |= there
            accepts.append(accept)
            for key in row:
                if key not in number:
                    number[key] = len(number)
                    todo.append(key)
            table.append([number[key] for key in row])
        # accepting states get the highest numbers: a hit is one comparison
        order = sorted(range(len(table)), key=lambda k: accepts[k] > 0)
        place = {old: new for new, old in enumerate(order)}
        self.n_states = len(table)
        self._n = n
        self._start = place[0] * n
        self._hot = sum(a == 0 for a in accepts) * n
        self.table = np.array([[place[t] * n for t in table[old]] for old in order], np.intp).ravel()
        self.accepts = np.array([accepts[old] for old in order], np.int64)
        self.byte_class = self.byte_class.astype(np.uint8)

    def scan(self, data: bytes, chunk: int = 1024, block: int = 1 << 21) -> list[tuple[int, int]]:
        """(absolute end offset, bit mask of the patterns that end there), each offset once.

        Chunks run in parallel, each from ``longest`` bytes before it.  Where that is not the state
        in which the chunk before ended, a match is open for longer than this lead, and the chunk
        is run again from the right state until both ways meet.
        """
        raw = self.byte_class[np.frombuffer(data, np.uint8)]
        found: list[tuple[int, int]] = []
        lead, carried = self.longest, self._start
        for at in range(0, len(raw), block):
            before = min(at, lead)
            part = raw[at - before : at + block]
            rows = -(-(len(part) - before) // chunk)
            padded = np.full(lead + rows * chunk, self.byte_class[0], np.uint8)
            padded[lead - before : lead - before + len(part)] = part
            wide = np.lib.stride_tricks.as_strided(padded, (rows, lead + chunk), (chunk, 1)).T.copy()
            state = np.full(rows, self._start, np.intp)
            index = np.empty(rows, np.intp)
            trace = np.empty((chunk, rows), np.intp)
            for j in range(lead + chunk):
                np.add(state, wide[j], out=index)
                if j == lead:
                    begin = state
                if j >= lead:
                    state = trace[j - lead]
                np.take(self.table, index, out=state, mode="clip")
            differs = begin != np.concatenate([[carried], trace[-1, :-1]])
            for row in map(int, np.flatnonzero(differs)):
                self._again(trace, wide, lead, row, carried if row == 0 else int(trace[-1, row - 1]))
            carried = int(trace[(len(part) - before - 1) % chunk, -1])
            j, i = np.nonzero(trace >= self._hot)
            ends = at + i * chunk + j + 1
            order = np.argsort(ends, kind="stable")
            masks = self.accepts[trace[j, i] // self._n]
            found += [(int(e), int(m)) for e, m in zip(ends[order], masks[order]) if e <= len(raw)]
        return found

    def _again(self, trace: np.ndarray, wide: np.ndarray, lead: int, row: int, state: int) -> None:
        """Replaces the states from ``row`` on by those that follow from ``state``, up to where they agree."""
        while row < trace.shape[1]:
            for j in range(len(trace)):
                state = int(self.table[state + int(wide[lead + j, row])])
                if trace[j, row] == state:
                    return
                trace[j, row] = state
            row += 1
