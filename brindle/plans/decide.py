"""Which operator states to keep between refreshes under a memory budget; all of it on the driver, on a handful of operators.

Costs of an operator, in rows handled: ``batch`` to read its inputs' old rows,
``delta`` to work on new ones, and for each keepable input the ``memory`` (KB)
of holding it. Emitting only the new rows of a join needs the old rows of a side
whose partner has new ones: from the kept state, or made again from below. An
aggregate, sort or buffer with its state needs only the new rows of its input.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import cache


@dataclass(eq=False)
class Op:
    name: str
    kind: str  # scan | select | join | agg | sort | material
    rows: float = 0.0  # old rows that it emits
    new: float = 0.0  # new rows that it emits
    children: list[Op] = field(default_factory=list)
    memory: tuple[int, ...] = ()  # KB for each keepable input

    def all(self) -> list[Op]:
        return [x for c in self.children for x in c.all()] + [self]

    def states(self) -> list[tuple[Op, int]]:
        return [(x, i) for x in self.all() for i in range(len(x.memory))]


Kept = frozenset  # of (operator, input) pairs


def delta_cost(op: Op, kept: frozenset) -> float:
    """Rows handled to produce only the new rows."""
    if op.kind == "scan":
        return op.new
    if op.kind == "select":
        return op.children[0].new + delta_cost(op.children[0], kept)
    if op.kind == "join":
        left, right = op.children
        total = delta_cost(left, kept) + delta_cost(right, kept) + left.new + right.new
        for mine, other, i in ((left, right, 0), (right, left, 1)):
            if other.new > 0 and (op, i) not in kept:
                total += whole_cost(mine, kept) - delta_cost(mine, kept) + mine.rows
        return total
    child = op.children[0]
    if (op, 0) in kept:
        return delta_cost(child, kept) + child.new
    return whole_cost(child, kept) + child.rows + child.new


def whole_cost(op: Op, kept: frozenset) -> float:
    """Rows handled to produce old and new rows."""
    if op.kind == "scan":
        return op.rows + op.new
    if op.kind == "select":
        return whole_cost(op.children[0], kept) + op.children[0].rows + op.children[0].new
    if op.kind == "join":
        return sum((c.rows if (op, i) in kept else whole_cost(c, kept) - delta_cost(c, kept) + c.rows) + delta_cost(c, kept) + c.new for i, c in enumerate(op.children))
    child = op.children[0]
    if (op, 0) in kept:
        return delta_cost(child, kept) + child.new + op.rows
    return whole_cost(child, kept) + child.rows + child.new


def used(kept: frozenset) -> int:
    return sum(op.memory[i] for op, i in kept)


def brute_force(root: Op, budget: int) -> frozenset:
    """Every choice; for up to some twenty states."""
    states = root.states()
    best = min((delta_cost(root, frozenset(s)), used(frozenset(s)), n, frozenset(s)) for n, s in enumerate(s for k in range(len(states) + 1) for s in itertools.combinations(states, k)) if used(frozenset(s)) <= budget)
    return best[3]


def dynamic(root: Op, budget: int) -> frozenset:
    """Best choice by operator and memory: the cheapest way to emit new rows only, and old and new, at each memory.

    Both values of a subtree depend on the same kept states, so a subtree's
    table holds its undominated (memory, delta cost, whole cost) triples.
    """

    @cache
    def table(op: Op) -> list[tuple[int, float, float, frozenset]]:
        below = [(0, frozenset())]
        for c in op.children:
            below = [(m + n, k | s) for m, k in below for n, _, _, s in table(c) if m + n <= budget]
        out = []
        own = [(op, i) for i in range(len(op.memory))]
        for m, k in below:
            for size in range(len(own) + 1):
                for pick in itertools.combinations(own, size):
                    kept = k | frozenset(pick)
                    total = m + sum(op.memory[i] for _, i in pick)
                    if total <= budget:
                        out.append((total, delta_cost(op, kept), whole_cost(op, kept), kept))
        out.sort(key=lambda x: x[:3])
        front: list[tuple[int, float, float, frozenset]] = []
        for x in out:
            if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in front):
                front.append(x)
        return front

    return min(table(root), key=lambda x: (x[1], x[0]))[3]


def greedy(root: Op, budget: int, how: str) -> frozenset:
    """States in order of their place or size, each kept if it still fits."""
    states = root.states()  # from the bottom up
    order = {
        "bottom-up": states, "top-down": states[::-1],
        "small-first": sorted(states, key=lambda s: s[0].memory[s[1]]), "big-first": sorted(states, key=lambda s: -s[0].memory[s[1]]),
    }[how]
    kept: frozenset = frozenset()
    for s in order:
        if used(kept) + s[0].memory[s[1]] <= budget:
            kept |= {s}
    return kept


class Recycler:
    """Keeps what is worth most for its size; worth grows each time a state could have been used again.

    A state whose input gets rows is let go and starts over; it may be chosen
    again at once. The others could be used again from the top down to the first
    kept state on each way: below that nothing is asked for. What a state saves
    is the work to make it again, given what else is kept.
    """

    def __init__(self, root: Op, budget: int) -> None:
        self.root, self.budget = root, budget
        self.kept: frozenset = frozenset()
        self.reuse = {s: 1.0 for s in root.states()}

    def _work(self, op: Op) -> float:
        """Rows handled to make an operator's output, with kept states at hand."""
        if op.kind == "scan":
            return op.rows
        below = sum(0.0 if (op, i) in self.kept else self._work(c) for i, c in enumerate(op.children))
        return below + sum(c.rows for c in op.children)

    def benefit(self, state: tuple[Op, int]) -> float:
        op, i = state
        saved = op.children[i].rows + self._work(op.children[i])
        return saved * self.reuse[state] / max(op.memory[i], 1)

    def _used_again(self, op: Op, updated: set[str]) -> None:
        for i, c in enumerate(op.children):
            if {x.name for x in c.all() if x.kind == "scan"} & updated:
                continue
            if i < len(op.memory):
                self.reuse[op, i] += 1
            if (op, i) not in self.kept:
                self._used_again(c, updated)

    def decide(self, updated: set[str] | None = None) -> frozenset:
        """One round: ``updated`` are the names of scans with new rows."""
        if updated is not None:
            for op, i in self.root.states():
                if {x.name for x in op.children[i].all() if x.kind == "scan"} & updated:
                    self.reuse[op, i] = 1.0
                    self.kept -= {(op, i)}
            self._used_again(self.root, updated)
        worth = {s: self.benefit(s) for s in self.reuse}
        for s in sorted((s for s in self.reuse if s not in self.kept), key=worth.get, reverse=True):
            need = s[0].memory[s[1]]
            left = self.budget - used(self.kept)
            if need <= left:
                self.kept |= {s}
                continue
            out, freed = [], 0
            for k in sorted(self.kept, key=worth.get):
                if freed + left >= need:
                    break
                out.append(k)
                freed += k[0].memory[k[1]]
            if freed + left >= need and out and sum(map(worth.get, out)) / len(out) < worth[s]:
                self.kept = self.kept - set(out) | {s}
        return self.kept


METHODS = ("dp", "brute-force", "top-down", "bottom-up", "small-first", "big-first", "recycler")


def decide(root: Op, budget: int, method: str) -> frozenset:
    if method == "dp":
        return dynamic(root, budget)
    if method == "brute-force":
        return brute_force(root, budget)
    if method == "recycler":
        return Recycler(root, budget).decide()
    return greedy(root, budget, method)
