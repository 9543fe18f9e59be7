"""Queries that are answered once and then refreshed as rows arrive.

start() answers on the batch and stores the states chosen under the memory
budget; refresh() takes new rows by table and brings the answer up to date.
Rows are only ever added. A join's new rows are

    new L x (old R + new R)  +  old L x new R

where old rows come from a kept state, or are made again from the tables so
far. An aggregate with a state merges the new rows' partial groups into it.
States are written to the shared folder, so a refresh reads no lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans import decide as choice
from brindle.plans.tree import Aggregate, Join, Material, Node, Scan, Select, Sort
from brindle.storage import Parts, Stored, store_all


class IncrementalQuery:
    def __init__(self, root: Node, tables: dict[str, DataFrame], budget_kb: int = 1 << 30, method: str = "dp", updates: set[str] | None = None, rows: dict[str, float] | None = None, share: float = 0.01) -> None:
        """updates: tables that are expected to get rows (all by default). rows: their sizes, for the decision (counted if left out)."""
        self.root, self.budget, self.method = root, budget_kb, method
        self.tables = dict(tables)
        self.updates = set(tables) if updates is None else updates
        self.rows, self.share = rows, share
        self.states: dict[tuple[Node, int], Parts] = {}
        self._facts: dict[str, dict[str, float]] = {}
        self.kept: set[tuple[Node, int]] = set()
        self.log: list[dict] = []
        self._spent: list[Stored] = []

    # Decision

    def _keys(self) -> set[str]:
        """Names of columns that joins and groups go by."""
        out = set()
        for node in self.root.walk():
            if isinstance(node, Join):
                out |= {c for pair in node.on for c in pair}
            elif isinstance(node, Aggregate):
                out |= set(node.keys)
        return out

    def _fact(self, name: str) -> dict[str, float]:
        """Rows of a table ("") and how many values each of its key columns has."""
        if name not in self._facts:
            df = self.tables[name]
            keys = sorted(self._keys() & set(df.columns))
            if self.rows and name in self.rows:
                self._facts[name] = {"": float(self.rows[name])} | {k: float(self.rows[name]) for k in keys}
            else:
                row = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(k) for k in keys]).first()
                self._facts[name] = {"": float(row[0])} | {k: float(max(n, 1)) for k, n in zip(keys, row[1:])}
        return self._facts[name]

    def _operators(self) -> tuple[choice.Op, dict[choice.Op, Node]]:
        back: dict[choice.Op, Node] = {}
        kinds = {Scan: "scan", Select: "select", Join: "join", Aggregate: "agg", Sort: "sort", Material: "material"}

        def build(node: Node) -> tuple[choice.Op, dict[str, float], int]:
            """(operator, values of each key column, bytes of a row)"""
            below = [build(c) for c in node.children]
            ops = [b[0] for b in below]
            values = {k: v for b in below for k, v in b[1].items()}
            wide = sum(b[2] for b in below)
            if isinstance(node, Scan):
                fact = self._fact(node.name)
                rows = fact[""]
                new = rows * self.share if node.name in self.updates else 0.0
                values = {k: v for k, v in fact.items() if k}
                wide = self.tables[node.name]._jdf.schema().defaultSize()
            elif isinstance(node, Join):
                fit = 1.0
                for a, b in node.on:
                    fit /= max(below[0][1].get(a, 1.0), below[1][1].get(b, 1.0), 1.0)
                rows = ops[0].rows * ops[1].rows * fit
                new = (ops[0].new * (ops[1].rows + ops[1].new) + ops[0].rows * ops[1].new) * fit
            elif isinstance(node, Aggregate):
                rows, groups = ops[0].rows, 1.0
                for k in node.keys:
                    groups *= values.get(k, rows)
                rows = min(rows, groups)
                new = min(ops[0].new, rows)
                wide = 24 * (len(node.keys) + len(node.parts))
            else:
                rows, new = ops[0].rows, ops[0].new
            held = []
            for i in node.keepable:
                n, w = (rows, wide) if isinstance(node, Aggregate) else (ops[i].rows, below[i][2])
                if (node, i) in self.states:
                    n = float(sum(p.rows for p in self.states[node, i].parts))
                held.append(int(n * w / 1024) + 1)
            op = choice.Op(node.name if isinstance(node, Scan) else kinds[type(node)], kinds[type(node)], rows, new, ops, tuple(held))
            back[op] = node
            return op, {k: min(v, max(rows, 1.0)) for k, v in values.items()}, wide

        return build(self.root)[0], back

    def decide(self) -> set[tuple[Node, int]]:
        op, back = self._operators()
        if self.method == "recycler":
            first = not hasattr(self, "_recycler")
            if first:
                self._recycler = (choice.Recycler(op, self.budget), back)
            recycler, old = self._recycler
            now = {back[x]: x for x in op.all()}
            for x in recycler.root.all():  # the same operators, with the sizes of now
                x.rows, x.new, x.memory = now[old[x]].rows, now[old[x]].new, now[old[x]].memory
            kept, back = recycler.decide(None if first else self.updates), old
        else:
            kept = choice.decide(op, self.budget, self.method)
        return {(back[o], i) for o, i in kept}

    def explain_state(self) -> list[tuple[str, int, bool, int]]:
        """(operator, input, kept, KB) of every state, from the bottom up."""
        op, back = self._operators()
        return [(o.kind, i, (back[o], i) in self.kept, o.memory[i]) for o, i in op.states()]

    # Running

    def start(self) -> DataFrame:
        self.kept = self.decide()
        leaves = {(n, i): self._state(n, i) for n in self.root.walk() for i in n.keepable if (n, i) in self.kept and isinstance(n.children[i], Scan) and not isinstance(n, Aggregate)}
        for k, v in store_all(leaves, lambda k: type(k[0]).__name__.lower()).items():
            self.states[k] = Parts(v, v.name)
        for node in self.root.walk():
            for i in node.keepable:
                if (node, i) in self.kept and (node, i) not in self.states:
                    self._store(node, i, self._state(node, i))
        return self._whole(self.root)

    def _state(self, node: Node, i: int) -> DataFrame:
        rows = self._whole(node.children[i])
        return node.partial(rows) if isinstance(node, Aggregate) else rows

    def _store(self, node: Node, i: int, df: DataFrame) -> None:
        name = type(node).__name__.lower()
        if (old := self.states.get((node, i))) is not None:
            self._spent += old.parts
        self.states[node, i] = Parts(Stored(df, name), name)

    def refresh(self, deltas: dict[str, DataFrame | None]) -> DataFrame:
        """The answer on all rows so far; one refresh sees exactly the deltas given."""
        deltas = {t: d for t, d in deltas.items() if d is not None}
        made: dict[Node, DataFrame | None] = {}

        def new(node: Node) -> DataFrame | None:
            """Rows that the deltas add to this node's output; None if there can be none. Not asked of aggregates."""
            if node not in made:
                made[node] = fresh(node)
            return made[node]

        def fresh(node: Node) -> DataFrame | None:
            if isinstance(node, Scan):
                return deltas.get(node.name)
            if isinstance(node, (Select, Material)):
                d = new(node.children[0])
                return d if d is None or isinstance(node, Material) else node.apply(d)
            if isinstance(node, Join):
                l, r = new(node.left), new(node.right)
                parts = []
                if l is not None:
                    right = self._old(node, 1)
                    parts.append(node.apply(l, right if r is None else right.unionByName(r)))
                if r is not None:
                    parts.append(node.apply(self._old(node, 0), r))
                return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            raise TypeError("aggregates and sorts change rows rather than add them")

        # states move forward bottom-up, from what they were before this refresh
        moved, again = {}, []
        for node in self.root.walk():
            for i in node.keepable:
                if (node, i) not in self.states or not (node.children[i].tables() & set(deltas)):
                    continue
                if not self._adds(node.children[i]):
                    again.append((node, i))  # rows change below: made from the states below, once those are current
                    continue
                d = new(node.children[i])
                if d is None:
                    continue
                moved[node, i] = node.partial(d) if isinstance(node, Aggregate) else d
        stored = store_all(moved, lambda k: type(k[0]).__name__.lower())  # all from the states of before
        for k, v in stored.items():
            self._spent += self.states[k].append(v, k[0].merge if isinstance(k[0], Aggregate) else None)
        for t, d in deltas.items():
            self.tables[t] = self.tables[t].unionByName(d)
        for node, i in again:
            self._spent += self.states.pop((node, i)).parts
            self._store(node, i, self._state(node, i))
        for t in deltas:
            self._facts.pop(t, None) if self.method == "recycler" else None
        self.log.append({"deltas": sorted(deltas), "kept": len(self.states)})
        out = self._whole(self.root)
        if self.method == "recycler":
            self.updates = set(deltas)
            wanted = self.decide()
            for k in [k for k in self.states if k not in wanted]:
                self._spent += self.states.pop(k).parts
            for node, i in wanted - set(self.states):
                self._store(node, i, self._state(node, i))
            self.kept = wanted
        return out

    def answer(self) -> DataFrame:
        """The answer on all rows so far, from the states."""
        return self._whole(self.root)

    def finish(self) -> None:
        """Delete all states; results that read them have to be used before."""
        for s in [*self._spent, *self.states.values()]:
            s.drop()
        self._spent, self.states = [], {}

    @staticmethod
    def _adds(node: Node) -> bool:
        """Whether new input rows only ever add rows to this output."""
        return all(not isinstance(x, (Aggregate, Sort)) for x in node.walk())

    def _old(self, node: Node, i: int) -> DataFrame:
        return self.states[node, i].df if (node, i) in self.states else self._whole(node.children[i])

    def _whole(self, node: Node) -> DataFrame:
        """The node's output on the tables as they are, from its state if there is one."""
        if isinstance(node, Scan):
            return self.tables[node.name]
        if isinstance(node, Join):
            return node.apply(*(self._old(node, i) for i in (0, 1)))
        held = (node, 0) in self.states
        if isinstance(node, Aggregate):
            if not held:
                return node.finish(node.partial(self._whole(node.child)))
            state = self.states[node, 0]
            return node.finish(node.merge(state.df) if len(state.parts) > 1 else state.df)
        rows = self.states[node, 0].df if held else self._whole(node.child)
        return rows if isinstance(node, Material) else node.apply(rows)
