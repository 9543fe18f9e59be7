from brindle.streaming import refresh_stream, windowed_counts
from tests.conftest import DATA


def test_micro_batches_reach_the_query(spark, tmp_path):
    from brindle.plans.incremental import IncrementalQuery
    from brindle.plans.tree import Aggregate, Scan

    spark.range(0, 10).selectExpr("id", "id % 2 AS k").write.parquet(str(tmp_path / "in/a"))
    base = spark.range(100, 104).selectExpr("id", "id % 2 AS k")
    q = IncrementalQuery(Aggregate(Scan("t"), ("k",), {"n": ("count", "1"), "s": ("sum", "id")}, ("k", "n", "s")), {"t": base})
    q.start()
    out = []
    refresh_stream(spark, str(tmp_path / "in/*"), "id BIGINT, k BIGINT", "t", q, str(tmp_path / "ck"), lambda df, _: out.append(sorted(map(tuple, df.collect()))))
    assert out[-1] == [(0, 7, 20 + 202), (1, 7, 25 + 204)]


def _counted(base):
    from brindle.plans.incremental import IncrementalQuery
    from brindle.plans.tree import Aggregate, Scan

    q = IncrementalQuery(Aggregate(Scan("t"), ("k",), {"n": ("count", "1")}, ("k", "n")), {"t": base})
    q.start()
    return q


def test_two_batches_a_restart_and_a_batch_that_comes_again(spark, tmp_path):
    base = spark.range(4).selectExpr("id", "id % 2 AS k")
    rows = lambda a, b, at: spark.range(a, b).selectExpr("id", "id % 2 AS k").write.parquet(str(tmp_path / f"in/{at}"))
    args = str(tmp_path / "in/*"), "id BIGINT, k BIGINT", "t"
    out = []
    take = lambda df, _: out.append(sorted(map(tuple, df.collect())))
    q = _counted(base)
    rows(0, 10, "a")
    refresh_stream(spark, *args, q, str(tmp_path / "ck"), take)
    rows(0, 6, "b")
    refresh_stream(spark, *args, q, str(tmp_path / "ck"), take)
    assert out == [[(0, 7), (1, 7)], [(0, 10), (1, 10)]]
    out.clear()
    rows(0, 2, "c")
    refresh_stream(spark, *args, _counted(base), str(tmp_path / "ck"), take)  # a new process: the rows come back, then the new ones
    assert out[-1] == [(0, 11), (1, 11)]
    for name in ("commits/2", "commits/.2.crc"):
        (tmp_path / "ck" / name).unlink(missing_ok=True)  # as if the last commit had not been reached
    out.clear()
    refresh_stream(spark, *args, _counted(base), str(tmp_path / "ck"), take)
    assert out[-1] == [(0, 11), (1, 11)]


def test_windowed_counts(spark):
    got = windowed_counts(spark, DATA, "1 day").toPandas()
    assert got["n"].sum() == 1000
