"""The mode with the lowest value of a tie, and a hierarchy to its end."""

from brindle import queries
from tests.conftest import DATA, same


def test_mode(spark, duck):
    same(queries.QUERIES["mode_lowest"](spark, DATA), duck.sql(queries.ORACLE["mode_lowest"]))


def test_ties_take_the_lowest(spark, tmp_path):
    rows = [("F", "b"), ("F", "a"), ("F", "b"), ("F", "a"), ("F", "c"), ("O", "z"), ("O", None), ("O", None)]
    spark.createDataFrame(rows, "o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert {tuple(r) for r in queries.QUERIES["mode_lowest"](spark, str(tmp_path)).collect()} == {("F", "a"), ("O", "z")}


def test_tree_to_its_end(spark, duck):
    df = queries.QUERIES["connect_by_all"](spark, DATA)
    same(df, duck.sql(queries.ORACLE["connect_by_all"]))
    assert df.agg({"level": "max"}).first()[0] > 3
