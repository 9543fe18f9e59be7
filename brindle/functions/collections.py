"""Arrays, key/value maps, JSON and ranges."""

from __future__ import annotations

import decimal
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arrays


def array_agg(value: Column) -> Column:
    """Keeps nulls; the order is that of arrival (see array_agg_by)."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])


def array_agg_by(value: Column, *by: Column) -> Column:
    keys = [k.alias(f"k{i}") for i, k in enumerate(by)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"])


def array_position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0).cast("bigint"))


def array_positions(a: Column, x: Column) -> Column:
    return F.filter(F.transform(a, lambda v, i: F.when(v.eqNullSafe(x), i + 1)), lambda i: i.isNotNull())


def array_contains_all(a: Column, b: Column) -> Column:
    """a @> b"""
    return F.size(F.array_except(b, a)) == 0


def uniq(a: Column) -> Column:
    """Drops elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    return F.slice(a, F.lit(start), F.lit(length) if length is not None else F.greatest(F.size(a) - start + 1, F.lit(0)))


def array_dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def array_to_string(a: Column, sep: str, null: str | None = None) -> Column:
    return F.array_join(a, sep) if null is None else F.array_join(a, sep, null)


# Maps


def defined(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)).isNotNull(), F.lit(False))


def delete_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def slice_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def merge(a: Column, b: Column) -> Column:
    """Entries of both; b's where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def map_contains(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def to_array(m: Column) -> Column:
    return F.flatten(F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"])))


def to_matrix(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"]))


# JSON


def json_has(j: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(j), key)


def json_has_any(j: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.json_object_keys(j), F.array(*map(F.lit, keys)))


def json_has_all(j: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(j))) == 0


def _contains(a, b, top: bool = True) -> bool:
    """Whether a holds b; only at the top may an array stand against a bare scalar."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _contains(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_contains(x, y, False) for x in a) for y in b)
    if isinstance(a, list):
        return top and any(_same(x, b) for x in a)
    return _same(a, b)


def _same(a, b) -> bool:
    if isinstance(a, (dict, list)) or isinstance(b, (dict, list)):
        return False
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return type(a) is type(b) and a == b
    return a == b


def _order(x) -> tuple:
    """Sort key: null, text, number, boolean, array, object; longer arrays and objects after shorter ones."""
    if x is None:
        return (0,)
    if isinstance(x, str):
        return (1, x.encode())
    if isinstance(x, bool):
        return (3, x)
    if isinstance(x, list):
        return (4, len(x), [_order(v) for v in x])
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: (len(k.encode()), k.encode()))
        return (5, len(x), [v for k in keys for v in ((1, k.encode()), _order(x[k]))])
    return (2, x)


def _parsed(column) -> list:
    """Values of a column of JSON texts; equal ones, as in a constant column, are parsed once."""
    known: dict = {None: None}
    out = []
    for t in column:
        if t not in known:
            if len(known) > 10_000:
                known = {None: None}
            known[t] = json.loads(t, parse_float=decimal.Decimal)
        out.append(known[t])
    return out


def _json_pairs(kind, make):
    """A function of two JSON columns, in Arrow batches: Column expressions have no recursion."""

    @F.pandas_udf(kind)
    def run(a, b):
        import pandas as pd

        return pd.Series([None if t is None or u is None else make(x, y) for t, u, x, y in zip(a, b, _parsed(a), _parsed(b))], dtype="object")

    return run


#: a @> b, a = b, and the sign of comparing a with b.
json_contains = _json_pairs(T.BooleanType(), _contains)
json_eq = _json_pairs(T.BooleanType(), lambda a, b: _order(a) == _order(b))
json_cmp = _json_pairs(T.IntegerType(), lambda a, b: (_order(a) > _order(b)) - (_order(a) < _order(b)))


def json_contained(a: Column, b: Column) -> Column:
    return json_contains(b, a)


@F.pandas_udf(T.StringType())
def json_canonical(a):
    """One text for all JSON texts that are equal: keys in order, numbers without trailing zeros."""
    import pandas as pd

    def plain(x):
        if isinstance(x, decimal.Decimal):
            x = x.normalize()
            return int(x) if x == x.to_integral_value() else float(x)
        return [plain(v) for v in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    return pd.Series([None if t is None else json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t, x in zip(a, _parsed(a))], dtype="object")


def json_hash(j: Column) -> Column:
    """Equal for equal values, whatever the order of keys."""
    return F.xxhash64(json_canonical(j))


# Ranges: struct<lo, hi, lo_inc, hi_inc, empty>; a null bound is unbounded


def make_range(lo: Column, hi: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """Discrete ranges are put into the form [lo, hi)."""
    low, high = bounds[0] == "[", bounds[1] == "]"
    if discrete:
        lo, hi = (lo if low else lo + 1), (hi + 1 if high else hi)
        low, high = True, False
    empty = F.coalesce((lo > hi) | ((lo == hi) & F.lit(not (low and high))), F.lit(False))
    return F.struct(F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (F.lit(low) & lo.isNotNull() & ~empty).alias("lo_inc"), (F.lit(high) & hi.isNotNull() & ~empty).alias("hi_inc"), empty.alias("empty"))


def range_has(r: Column, x: Column) -> Column:
    after = r["lo"].isNull() | (x > r["lo"]) | (r["lo_inc"] & (x == r["lo"]))
    before = r["hi"].isNull() | (x < r["hi"]) | (r["hi_inc"] & (x == r["hi"]))
    return ~r["empty"] & after & before


def _left_of(a: Column, b: Column) -> Column:
    """a ends before b begins."""
    return F.coalesce((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])), F.lit(False))


def range_overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~_left_of(a, b) & ~_left_of(b, a)


def range_left_of(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _left_of(a, b)


def range_adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def _lower(a: Column, b: Column, want_first: bool) -> Column:
    """Lower bound of a or b: (value, inclusive); the first or the last of the two."""
    a_first = a["lo"].isNull() | F.coalesce((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & a["lo_inc"]), F.lit(False))
    pick = a_first if want_first else ~a_first
    return F.when(pick, F.struct(a["lo"].alias("v"), a["lo_inc"].alias("i"))).otherwise(F.struct(b["lo"].alias("v"), b["lo_inc"].alias("i")))


def _upper(a: Column, b: Column, want_last: bool) -> Column:
    a_last = a["hi"].isNull() | F.coalesce((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & a["hi_inc"]), F.lit(False))
    pick = a_last if want_last else ~a_last
    return F.when(pick, F.struct(a["hi"].alias("v"), a["hi_inc"].alias("i"))).otherwise(F.struct(b["hi"].alias("v"), b["hi_inc"].alias("i")))


def _range(lo: Column, hi: Column, empty: Column) -> Column:
    pick = lambda v, e: F.when(~empty, v).otherwise(e)
    return F.struct(pick(lo["v"], F.lit(None)).alias("lo"), pick(hi["v"], F.lit(None)).alias("hi"), pick(lo["i"], F.lit(False)).alias("lo_inc"), pick(hi["i"], F.lit(False)).alias("hi_inc"), empty.alias("empty"))


def range_intersection(a: Column, b: Column) -> Column:
    return _range(_lower(a, b, False), _upper(a, b, False), ~range_overlaps(a, b))


def range_merge(a: Column, b: Column) -> Column:
    """The smallest range that holds both."""
    both = _range(_lower(a, b, True), _upper(a, b, True), F.lit(False))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def range_contains(a: Column, b: Column) -> Column:
    low = a["lo"].isNull() | F.coalesce((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"])), F.lit(False))
    high = a["hi"].isNull() | F.coalesce((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"])), F.lit(False))
    return b["empty"] | (~a["empty"] & low & high)


def range_contained_by(a: Column, b: Column) -> Column:
    return range_contains(b, a)


def range_minus(a: Column, b: Column) -> Column:
    """What is left of a; an error where b would cut it in two."""
    meet = range_overlaps(a, b)
    same_low = (a["lo"].eqNullSafe(b["lo"]) & ((a["lo_inc"] == b["lo_inc"]) | a["lo"].isNull()))
    same_high = (a["hi"].eqNullSafe(b["hi"]) & ((a["hi_inc"] == b["hi_inc"]) | a["hi"].isNull()))
    b_first = b["lo"].isNull() | same_low | F.coalesce((b["lo"] < a["lo"]) | ((b["lo"] == a["lo"]) & b["lo_inc"]), F.lit(False))
    b_last = b["hi"].isNull() | same_high | F.coalesce((b["hi"] > a["hi"]) | ((b["hi"] == a["hi"]) & b["hi_inc"]), F.lit(False))
    made = lambda lo, hi, li, hi_inc: F.struct(lo.alias("lo"), hi.alias("hi"), li.alias("lo_inc"), hi_inc.alias("hi_inc"), F.lit(False).alias("empty"))
    nothing = F.struct(F.lit(None).cast("void").alias("lo"), F.lit(None).cast("void").alias("hi"), F.lit(False).alias("lo_inc"), F.lit(False).alias("hi_inc"), F.lit(True).alias("empty"))
    head = made(a["lo"], b["lo"], a["lo_inc"], ~b["lo_inc"])
    tail = made(b["hi"], a["hi"], ~b["hi_inc"], a["hi_inc"])
    cut = F.raise_error(F.lit("result of range difference would not be contiguous"))
    return F.when(~meet, a).when(b_first & b_last, nothing).when(b_first, tail).when(b_last, head).otherwise(F.when(cut.isNull(), a))


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lo"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["hi"].isNull()


# Integer arrays


def int_sort(a: Column, how: str = "asc") -> Column:
    return F.sort_array(a, how == "asc")


def int_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def int_inter(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def int_subtract(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def idx(a: Column, x: Column) -> Column:
    """Place of the first x from 1, 0 if there is none."""
    return F.coalesce(F.array_position(a, x), F.lit(0)).cast("int")


# Enums: an ordered list of labels


def enum_first(labels: list[str]) -> Column:
    return F.lit(labels[0])


def enum_last(labels: list[str]) -> Column:
    return F.lit(labels[-1])


def enum_place(value: Column, labels: list[str]) -> Column:
    """The value's place in the order, for comparing and sorting."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), value), F.lit(0))


def enum_range(low: Column, high: Column, labels: list[str]) -> Column:
    """The labels from low to high; null is open."""
    a, b = F.coalesce(enum_place(low, labels), F.lit(1)), F.coalesce(enum_place(high, labels), F.lit(len(labels)))
    return F.slice(F.array(*map(F.lit, labels)), a, F.greatest(b - a + 1, F.lit(0)))
