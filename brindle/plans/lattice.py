"""Higher-order delta maintenance: every connected join of the base tables is kept as a view.

New rows of a base table move through the views that contain it, smallest first:
the view's new rows are those of one part joined with the stored rest. Deltas of
several tables are applied one table after the other, so no pair of new rows is
joined twice or missed. Views are only added to.

Edges that close a circle (two tables that are joined already, by a column that
is no key of either) only narrow a join. A set of tables held together by such
an edge alone would be a view of many rows to many: its size grows with the
square of the tables. Such a view is kept as its factors, the views of its parts;
what is joined with it is joined with one factor after the other, under all conditions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.tree import Aggregate
from brindle.storage import Parts, Stored, store_all

Edge = tuple[str, str, str, str]  # table, column, table, column


#: Bytes of files from which both sides of a join are sorted: files are far smaller than the rows a broadcast holds, and several views are made at once.
LARGE = 1 << 20


def connected(tables: list[str], edges: list[Edge]) -> list[frozenset[str]]:
    """All sets of tables that the edges connect, by size."""
    near = {t: set() for t in tables}
    for a, _, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    out = []
    for k in range(1, len(tables) + 1):
        for some in combinations(tables, k):
            seen, todo = {some[0]}, [some[0]]
            while todo:
                for t in near[todo.pop()] & set(some):
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            if len(seen) == k:
                out.append(frozenset(some))
    return out


def folded(tables: list[str], edges: list[Edge], fixed: set[str]) -> tuple[dict[str, list[str]], list[Edge]]:
    """Tables that never get rows, put beside a table that does: (base -> its fixed tables, in join order; edges between bases)."""
    with_, home = {t: [] for t in tables if t not in fixed}, {t: t for t in tables if t not in fixed}
    while grown := next(((a, b) if a in home else (b, a) for a, _, b, _ in edges if (a in home) != (b in home)), None):
        home[grown[1]] = home[grown[0]]
        with_[home[grown[0]]].append(grown[1])
    between = [(home[a], c, home[b], d) for a, c, b, d in edges if a in home and b in home and home[a] != home[b]]
    return with_, between


def spanning(tables: list[str], edges: list[Edge]) -> list[Edge]:
    """The edges that close no circle with those before them."""
    home, out = {t: {t} for t in tables}, []
    for a, c, b, d in edges:
        if home[a] is not home[b]:
            home[a] |= home[b]
            for t in home[b]:
                home[t] = home[a]
            out.append((a, c, b, d))
    return out


class LatticeQuery:
    """A view for each connected set of base tables; the answer is a query over the join of all.

    The top view itself is not stored: its rows become partial groups at once,
    and only these are kept, merged when the answer is read.
    """

    def __init__(self, tables: dict[str, DataFrame], edges: list[Edge], groups: Aggregate, prepare=None, fixed: set[str] = frozenset()) -> None:
        """edges: a spanning tree by keys, then the rest. prepare: row-wise work on the join of all, before the groups. fixed: tables that never get rows; they are joined to a neighbour."""
        self.tables, self.groups, self.prepare, self.fixed = dict(tables), groups, prepare or (lambda df: df), set(fixed)
        self.all_edges = edges
        self.beside, self.edges = folded(list(tables), edges, self.fixed)
        self.sets = connected(list(self.beside), self.edges)
        self.stored = connected(list(self.beside), spanning(list(self.beside), self.edges))  # the others are kept as factors
        self.top = frozenset(self.beside)
        self.views: dict[frozenset[str], Parts] = {}
        self.preloaded: dict[str, Stored] = {}
        self._spent: list[Stored] = []
        if self.top not in self.sets:
            raise ValueError("the tables are not connected")

    def count(self) -> tuple[int, int, int]:
        """(views, bases, views of fixed tables alone)"""
        alone = sum(bool(x) for x in self.beside.values())
        return len(self.sets) + alone, len(self.beside), alone

    def _split(self, view: frozenset[str], base: str) -> list[frozenset[str]]:
        """Stored parts of a view without a base table."""
        rest, out = set(view) - {base}, []
        while rest:
            part = max((s for s in self.stored if s <= rest), key=lambda s: (len(s), sorted(s)))
            out.append(part)
            rest -= part
        return out

    @staticmethod
    def _joined(left: DataFrame, mine: set[str], right: DataFrame, other: set[str], edges: list[Edge]) -> DataFrame:
        on = [F.col(c) == F.col(d) for a, c, b, d in edges if a in mine and b in other] + [F.col(d) == F.col(c) for a, c, b, d in edges if b in mine and a in other]
        return left.join(right, on)

    def _with_fixed(self, base: str, rows: DataFrame) -> DataFrame:
        """Rows of a base table, joined with the fixed tables beside it."""
        mine = {base}
        for t in self.beside[base]:
            rows = self._joined(rows, mine, self.preloaded[t].df, {t}, self.all_edges)
            mine.add(t)
        return rows

    def _grown(self, rows: Stored | Parts, base: str, view: frozenset[str]) -> DataFrame:
        mine, out = {base}, rows.df
        for part in self._split(view, base):
            kept = self.views[part]
            out = self._joined(out, mine, kept.df.hint("merge") if min(rows.bytes, kept.bytes) > LARGE else kept.df, part, self.edges)
            mine |= part
        return out

    def _made(self, view: frozenset[str], rows: DataFrame) -> DataFrame:
        return self.groups.partial(self.prepare(rows)) if view == self.top else rows

    def answer(self) -> DataFrame:
        top = self.views[self.top]
        return self.groups.finish(self.groups.merge(top.df) if len(top.parts) > 1 else top.df)

    def start(self) -> DataFrame:
        self.preloaded = store_all({t: self.tables[t] for b in self.beside for t in self.beside[b]}, lambda _: "fixed")
        for size in range(1, len(self.top) + 1):  # views of a size are made from smaller ones
            made = {}
            for s in (s for s in self.stored if len(s) == size):
                base = min(s)
                rows = self._with_fixed(base, self.tables[base]) if size == 1 else self._grown(self.views[frozenset({base})], base, s)
                made[s] = self._made(s, rows)
            self.views |= {s: Parts(x, "view") for s, x in store_all(made, lambda _: "view").items()}
        return self.answer()

    def refresh(self, deltas: dict[str, DataFrame | None]) -> DataFrame:
        """One table after the other: the views that hold it get what its new rows make with the stored rest."""
        for base, rows in deltas.items():
            if rows is None:
                continue
            if base in self.fixed:
                raise ValueError(f"{base} was said never to change")
            new = Stored(self._with_fixed(base, rows), "delta")
            own = [s for s in self.stored if base in s]
            grown = store_all({s: self._made(s, self._grown(new, base, s)) for s in own if len(s) > 1 or s == self.top}, lambda _: "view")
            grown |= {s: new for s in own if s not in grown}
            for s, d in grown.items():
                self._spent += self.views[s].append(d, self.groups.merge if s == self.top else None)
            if new not in grown.values():
                self._spent.append(new)
        return self.answer()

    def finish(self) -> None:
        """Delete all views; answers that read them have to be used before."""
        for x in [*self._spent, *self.preloaded.values(), *self.views.values()]:
            x.drop()
        self.views, self.preloaded, self._spent = {}, {}, []
