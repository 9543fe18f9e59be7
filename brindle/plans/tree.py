"""A small logical tree; each node turns its inputs into a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(eq=False)
class Node:
    children: list[Node] = field(default_factory=list, init=False)

    #: Which inputs the operator can hold on to: indexes into ``children``.
    keepable = ()

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            yield from c.walk()
        yield self

    def tables(self) -> set[str]:
        return set().union(*(c.tables() for c in self.children))


@dataclass(eq=False)
class Scan(Node):
    """A base table, by name; the caller has filtered and projected it."""

    name: str

    def tables(self) -> set[str]:
        return {self.name}


@dataclass(eq=False)
class Select(Node):
    """Row-wise work: an optional condition, then SQL expressions."""

    child: Node
    columns: tuple[str, ...] = ("*",)
    where: str | None = None

    def __post_init__(self) -> None:
        self.children = [self.child]

    def apply(self, df: DataFrame) -> DataFrame:
        return (df.where(self.where) if self.where else df).selectExpr(*self.columns)


@dataclass(eq=False)
class Join(Node):
    """Inner join on equal columns, given as pairs (left name, right name); names of both sides are distinct."""

    left: Node
    right: Node
    on: tuple[tuple[str, str], ...]
    keepable = (0, 1)

    def __post_init__(self) -> None:
        self.children = [self.left, self.right]

    def apply(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, [F.col(a) == F.col(b) for a, b in self.on])


@dataclass(eq=False)
class Aggregate(Node):
    """Groups and mergeable parts: name -> (sum | count | min | max, SQL expression); then expressions over keys and parts."""

    child: Node
    keys: tuple[str, ...]
    parts: dict[str, tuple[str, str]]
    columns: tuple[str, ...] = ("*",)
    keepable = (0,)

    def __post_init__(self) -> None:
        self.children = [self.child]

    def partial(self, df: DataFrame) -> DataFrame:
        aggs = [F.expr(f"{'sum' if f == 'sum' else f}({e})").alias(n) for n, (f, e) in self.parts.items()]
        return df.groupBy(*self.keys).agg(*aggs)

    def merge(self, df: DataFrame) -> DataFrame:
        """Partial rows of the same keys into one."""
        kinds = {f.name: f.dataType for f in df.schema}
        aggs = [F.expr(f"{'sum' if f in ('sum', 'count') else f}({n})").cast(kinds[n]).alias(n) for n, (f, _) in self.parts.items()]
        return df.groupBy(*self.keys).agg(*aggs)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(*self.columns)


@dataclass(eq=False)
class Sort(Node):
    """Order of the result; (column, descending) pairs, nulls last ascending and first descending."""

    child: Node
    by: tuple[tuple[str, bool], ...]
    keepable = (0,)

    def __post_init__(self) -> None:
        self.children = [self.child]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*[F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in self.by])


@dataclass(eq=False)
class Material(Node):
    """A buffer that may be kept, put where a subtree is worth holding on to."""

    child: Node
    keepable = (0,)

    def __post_init__(self) -> None:
        self.children = [self.child]
