"""Queries that read the whole of their tables."""

import pytest

from brindle import queries
from tests.conftest import DATA, same

NAMES = ["lateral_top_all", "join_full_all", "nulls_order_all"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA).persist()
    same(df, duck.sql(queries.ORACLE[name]))
    n = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").count()
    if name == "lateral_top_all":
        assert df.count() == n("customer")
    elif name == "join_full_all":
        assert df.select("o_orderkey").distinct().where("o_orderkey is not null").count() == n("orders")
        assert df.select("c_custkey").distinct().where("c_custkey is not null").count() == n("customer")
        assert df.where("o_orderkey is null").count() and df.where("c_custkey is null").count() and df.where("o_orderkey + c_custkey > 0").count()
    else:
        rows = df.orderBy("place").collect()
        nulls = sum(r.k is None for r in rows)
        assert [r.place for r in rows] == list(range(1, n("orders") + 1))
        assert 0 < nulls < len(rows) and all(r.k is None for r in rows[:nulls])
