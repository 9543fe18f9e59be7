"""Relational operators that SQL of the reference has and Spark lacks, or has with other rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import Stored


def order(column: str, descending: bool = False) -> Column:
    """Default order of nulls: after everything ascending, before everything descending."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def distinct_on(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row, in the order given, of each combination of keys."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """GROUPING SETS, duplicates kept; each () gives its one row on empty input too.

    The non-empty sets are one Expand and aggregate; every () is a global
    aggregate of its own, which yields a row even without input.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    if full := [s for s in sets if s]:
        parts.append(df.groupingSets([[F.col(k) for k in s] for s in full], *keys).agg(*aggregates))
    for _ in range(sum(not s for s in sets)):
        total = df.agg(*aggregates)
        parts.append(total.select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], *total.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_all(df: DataFrame, column: Column, op: str, other: DataFrame, value: str, how: str) -> DataFrame:
    """Rows where ``column op ANY|ALL (other.value)`` is true, by three-valued logic.

    The list is boiled down to its count, nulls, least and greatest value first;
    equality with ANY and its negation with ALL become semi and anti joins. All
    values equal one only if that is the least and the greatest.
    """
    name = "__v"
    if (op, how) == ("=", "any"):
        return df.withColumn(name, column).join(other.select(F.col(value).alias("__o")), F.col(name) == F.col("__o"), "left_semi").drop(name)
    facts = other.agg(F.count("*").alias("__n"), F.count(value).alias("__k"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.withColumn(name, column).crossJoin(F.broadcast(facts))  # one row
    if (op, how) == ("<>", "all"):
        hit = other.where(F.col(value).isNotNull()).select(F.col(value).alias("__o")).distinct()
        kept = joined.where("__n = 0 or (__n = __k and __v is not null)").join(hit, F.col(name) == F.col("__o"), "left_anti")
        return kept.drop(name, "__n", "__k", "__lo", "__hi")
    if (op, how) in (("=", "all"), ("<>", "any")):
        same = F.expr("__lo = __v AND __hi = __v")
        cond = F.expr("__n = 0") | (F.expr("__n = __k") & same) if op == "=" else F.expr("__k > 0") & ~same
        return joined.where(F.coalesce(cond, F.lit(False))).drop(name, "__n", "__k", "__lo", "__hi")
    bound = {("<", "any"): "__hi", ("<=", "any"): "__hi", (">", "any"): "__lo", (">=", "any"): "__lo", ("<", "all"): "__lo", ("<=", "all"): "__lo", (">", "all"): "__hi", (">=", "all"): "__hi"}[op, how]
    test = F.expr(f"{name} {op} {bound}")
    cond = test if how == "any" else F.expr("__n = 0") | (F.expr("__n = __k") & test)
    return joined.where(F.coalesce(cond, F.lit(False))).drop(name, "__n", "__k", "__lo", "__hi")


def shifted(df: DataFrame, keys: list[str], by: list[Column], value: str, offset: Column, out: str, default: Column | None = None) -> DataFrame:
    """lag by an offset that is a column (negative: lead): a self-join on the row's number."""
    w = Window.partitionBy(*keys).orderBy(*by)
    numbered = df.withColumn("__n", F.row_number().over(w)).withColumn("__to", F.col("__n") - offset)
    right = numbered.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__n").alias("__at"), F.col(value).alias("__value"), F.lit(True).alias("__has"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__to") == F.col("__at")]
    joined = numbered.join(right, on, "left")
    got = F.when(F.col("__has"), F.col("__value")).otherwise(default if default is not None else F.lit(None))
    return joined.withColumn(out, got).select(*df.columns, out)


def nth_value(df: DataFrame, keys: list[str], by: list[Column], value: str, n: Column, out: str) -> DataFrame:
    """nth_value with a column for n, over the rows of the keys up to the current one (in an order without ties); nulls count."""
    placed = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    got = shifted(placed, keys, by, value, F.col("__rn") - n, out)
    return got.withColumn(out, F.when(n <= F.col("__rn"), F.col(out))).drop("__rn")


def recursive_union(start: DataFrame, step, distinct: bool = True, most: int = 1000) -> DataFrame:
    """WITH RECURSIVE. ``step(working)`` gives the next rows; UNION also drops rows seen before. Rounds are written out."""
    now = start.distinct() if distinct else start
    seen = [Stored(now, "recursion")]
    work = seen[0].df
    for _ in range(most):
        if work.isEmpty():
            break
        new = step(work)
        if distinct:
            whole = seen[0].df
            for s in seen[1:]:
                whole = whole.union(s.df)
            new = new.distinct().subtract(whole)
        seen.append(Stored(new, "recursion"))
        work = seen[-1].df
    else:
        raise RuntimeError(f"no end after {most} rounds")
    out = seen[0].df
    for s in seen[1:]:
        out = out.union(s.df)
    return out


def connect_by(df: DataFrame, key: str, parent: str, root, depth: int = 0, separator: str = "~") -> DataFrame:
    """Hierarchy below ``root``: key, parent, level, branch. A key that comes back in its own branch is an error."""
    start = df.where(F.col(key) == F.lit(root)).select(F.col(key).alias("key"), F.lit(None).cast(df.schema[parent].dataType).alias("parent"), F.lit(0).alias("level"), F.col(key).cast("string").alias("branch"))
    edges = df.select(F.col(key).alias("k"), F.col(parent).alias("p"))

    def step(work: DataFrame) -> DataFrame:
        here = work if not depth else work.where(F.col("level") < depth)
        out = here.join(edges, here["key"] == edges["p"]).select(F.col("k").alias("key"), F.col("p").alias("parent"), (F.col("level") + 1).alias("level"), "branch", F.col("k").cast("string").alias("__k"))
        loop = F.array_contains(F.split("branch", separator), F.col("__k"))
        return out.withColumn("branch", F.when(loop, F.raise_error(F.lit("infinite recursion detected"))).otherwise(F.concat_ws(separator, "branch", "__k"))).drop("__k")

    return recursive_union(start, step, distinct=False)


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: list) -> DataFrame:
    """Rows to columns; of several values for a cell the smallest."""
    return df.groupBy(row).pivot(category, categories).agg(F.min(value))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def zipped_rows(df: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """Set-returning functions in a select list: in step, short ones padded with null."""
    names = list(arrays)
    zipped = F.arrays_zip(*[v.alias(n) for n, v in arrays.items()])
    return df.select("*", F.explode(zipped).alias("__z")).select(*df.columns, *[F.col("__z").getField(n).alias(n) for n in names])


def overlap_join(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], width: float, levels: int = 24) -> DataFrame:
    """Pairs whose half-open intervals overlap, each once, however long the intervals.

    Each interval lies in at most two bins of the level that its length asks for
    (bins of level k are ``width`` * 2^k wide). Sides meet at the higher of their
    two levels: each is entered at its own, and its bins' parents at the levels
    above that the other side has. A pair is kept in the bin that holds the
    later of the two starts. Intervals of more than ``width`` * 2^levels are of the
    highest level.
    """
    number = lambda c: F.col(c).cast("double")

    def leveled(df: DataFrame, a: str, b: str) -> DataFrame:
        size = F.greatest((number(b) - number(a)) / width, F.lit(1.0))
        return df.where(F.col(a) < F.col(b)).withColumn("__level", F.least(F.ceil(F.log2(size)).cast("int"), F.lit(levels)))

    x, y = leveled(left, lo[0], hi[0]), leveled(right, lo[1], hi[1])
    used = sorted({r[0] for side in (x, y) for r in side.select("__level").distinct().collect()})  # at most levels + 1 numbers

    def entered(df: DataFrame, a: str, b: str) -> DataFrame:
        at = F.explode(F.filter(F.array(*[F.lit(k) for k in used]), lambda k: k >= F.col("__level"))) if used else F.explode(F.array().cast("array<int>"))
        df = df.withColumn("__at", at).withColumn("__wide", F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__at")))
        return df.withColumn("__bin", F.explode(F.sequence(F.floor(number(a) / F.col("__wide")), F.floor(number(b) / F.col("__wide")))))

    p = entered(x, *(c[0] for c in (lo, hi))).withColumnRenamed("__level", "__mine")
    q = entered(y, *(c[1] for c in (lo, hi))).withColumnRenamed("__level", "__other").drop("__wide")
    hit = (F.col(lo[0]) < F.col(hi[1])) & (F.col(lo[1]) < F.col(hi[0])) & (F.greatest("__mine", "__other") == F.col("__at"))
    own = F.col("__bin") == F.floor(F.greatest(number(lo[0]), number(lo[1])) / F.col("__wide"))
    return p.join(q, ["__at", "__bin"]).where(hit & own).drop("__at", "__bin", "__wide", "__mine", "__other")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the last right row of its keys at or before its time: one sort of both sides together."""
    kinds = {f.name: f.dataType for f in right.schema}
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), *[F.lit(None).cast(kinds[c]).alias(f"__{c}") for c in columns], F.lit(None).cast("boolean").alias("__has"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__has"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__has"), F.struct(*[F.col(f"__{c}").alias(c) for c in columns])), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__last", last).where("__side = 1").select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in columns])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join for hot keys on the left: left rows are dealt over ``salts``, right rows repeated for each."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def running_sum(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows up to each, in an order without ties: by ranges of the order, each summed alone, and sums over the ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = Stored(df.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "ranges").df
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy("__part").agg(F.sum(value).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.withColumn(out, within).join(F.broadcast(starts), "__part").withColumn(out, F.col(out) + F.col("__start")).drop("__part", "__start")


def numbered(df: DataFrame, by: list[str], out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in an order without ties, for any number of rows."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("bigint")), by, "__one", out).withColumn(out, F.col(out) + start - 1).drop("__one")


def user_aggregate(df: DataFrame, keys: list[str], value: Column, zero: Column, step, merge, out: str, salts: int = 64) -> DataFrame:
    """An aggregate given by a state: ``step(state, value)`` within a part of a group, ``merge(state, state)`` between its parts.

    A group is dealt over ``salts`` parts by a hash of its rows.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    parts = df.groupBy(*keys, part.alias("__salt")).agg(F.aggregate(F.collect_list(value), zero, step).alias("__state"))
    return parts.groupBy(*keys).agg(F.aggregate(F.collect_list("__state"), zero, merge).alias(out))
