"""Regular expressions to one minimal deterministic automaton, as transition arrays over byte classes.

Syntax: literals, ``\\xHH`` and ``\\`` escapes, ``[...]`` classes, ``(...)``, ``|``, ``?``, ``*``, ``+``, ``{m}``,
``{m,}``, ``{m,n}``. A rule may fold ASCII case. Thompson's construction gives a nondeterministic automaton, subset
construction a deterministic one, and partition refinement the minimal one that keeps which rules each state accepts.
"""

import numpy as np


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern.encode(), 0, fold

    def peek(self) -> int:
        return self.s[self.i] if self.i < len(self.s) else -1

    def take(self) -> int:
        self.i += 1
        return self.s[self.i - 1]

    def either(self):
        parts = [self.chain()]
        while self.peek() == 0x7C:
            self.take()
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def chain(self):
        parts = []
        while self.peek() not in (-1, 0x7C, 0x29):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        x = self.one()
        while (c := self.peek()) != -1 and c in b"?*+{":
            self.take()
            if c == 0x7B:
                end = self.s.index(b"}", self.i)
                low, comma, high = self.s[self.i : end].partition(b",")
                self.i = end + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {0x3F: (0, 1), 0x2A: (0, None), 0x2B: (1, None)}[c]
            x = ("rep", x, least, most)
        return x

    def escaped(self) -> int:
        c = self.take()
        if c == 0x78:
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {0x6E: 10, 0x74: 9, 0x72: 13}.get(c, c)

    def one(self):
        c = self.take()
        if c == 0x28:
            x = self.either()
            self.take()
            return x
        if c == 0x5B:
            return ("set", self.bracket())
        return ("set", self.folded({self.escaped() if c == 0x5C else c}))

    def bracket(self) -> frozenset:
        negated = self.peek() == 0x5E and bool(self.take())
        out = set()
        while (c := self.take()) != 0x5D:
            low = self.escaped() if c == 0x5C else c
            high = low
            if self.peek() == 0x2D and self.s[self.i + 1] != 0x5D:
                self.take()
                c = self.take()
                high = self.escaped() if c == 0x5C else c
            out.update(range(low, high + 1))
        out = self.folded(out)
        return frozenset(range(256)) - out if negated else out

    def folded(self, values: set) -> frozenset:
        if self.fold:
            values = values | {b ^ 32 for b in values if 65 <= b & ~32 <= 90 and b < 128}
        return frozenset(values)


class Nfa:
    """States with edges on byte sets and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node, start: int) -> int:
        """The state that is reached from start over what node stands for."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((node[1], end))
            return end
        if kind == "seq":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "or":
            for x in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, x, least, most = node
        for _ in range(least):
            start = self.add(x, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(most - least):
                self.empty[start].append(end)
                start = self.add(x, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """table[state, class] is the next state; classes[byte] the class; accepts[state] a mask of rules; 0 is the start.

    search: the rules may start anywhere, and a state that accepts any rule stays for good.
    """

    def __init__(self, rules: list[tuple[str, bool]], search: bool = False):
        nfa = Nfa()
        start = nfa.state()
        finals = {}
        for i, (pattern, fold) in enumerate(rules):
            first = nfa.state()
            nfa.empty[start].append(first)
            finals[nfa.add(_Parser(pattern, fold).either(), first)] = i
        if search:
            nfa.edges[start].append((frozenset(range(256)), start))
        sets = {s for edges in nfa.edges for s, _ in edges}
        marks = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        self.classes = np.array([kinds[m] for m in marks], np.int64)
        sample = [marks.index(m) for m in kinds]

        def closed(states) -> frozenset:
            out, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(out)

        known, rows, masks = {closed([start]): 0}, [], []
        queue = list(known)
        for states in queue:
            mask = sum(1 << finals[s] for s in states if s in finals)
            masks.append(mask)
            if search and mask:
                rows.append([known[states]] * len(sample))
                continue
            row = []
            for b in sample:
                to = closed({t for s in states for values, t in nfa.edges[s] if b in values})
                if to not in known:
                    known[to] = len(known)
                    queue.append(to)
                row.append(known[to])
            rows.append(row)
        self.table, self.accepts = self._minimal(np.array(rows), np.array([bool(m) for m in masks], np.int64) if search else np.array(masks, np.int64))
        self.live = self.accepts.copy()  # the rules that can still be met from each state
        while not np.array_equal(further := self.live | np.bitwise_or.reduce(self.live[self.table], axis=1), self.live):
            self.live = further
        dead = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
        self.dead = dead[0] if dead else -1

    @staticmethod
    def _minimal(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, group = np.unique(masks, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == group.max():
                break
            group = finer
        order = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}  # the start's group comes first
        group = np.array([order[g] for g in group.tolist()])
        first = np.array([group.tolist().index(g) for g in range(len(order))])
        return group[table[first]], masks[first]
