"""Registered queries against DuckDB on the same tables."""

import pytest

from brindle import form_queries, function_queries, queries  # noqa: F401
from tests.conftest import DATA, same

SLOW = ("incremental_q", "lattice_", "recycler_", "binomial_")
NAMES = [n for n in queries.ORACLE if not n.startswith(SLOW)]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE[name]))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_pushes_filters_and_prunes_columns(spark):
    plan = queries.QUERIES["scan_filter_project"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_returnflag" not in plan


def test_conditions_on_partition_keys_pass_below_windows(spark):
    plan = queries.QUERIES["window_filter_pushed"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_custkey,40)" in plan


def test_remote_tables(spark):
    """A table of another database (Derby, in memory) by JDBC, its filter pushed."""
    from pyspark.sql import functions as F

    from brindle import sources as src

    url = "jdbc:derby:memory:brindle;create=true"
    nation = src.table(spark, DATA, "nation")
    nation.select("n_nationkey", "n_name").write.format("jdbc").options(url=url, dbtable="nation_copy", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    got = src.read_remote(spark, url, "SELECT * FROM nation_copy", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").where(F.col("n_nationkey") > 20)
    assert sorted(r[0] for r in got.collect()) == [21, 22, 23, 24]


def test_overlaps_of_long_and_short_intervals(spark):
    from brindle import operators as ops

    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate([(0, 1), (0.5, 1e9), (3, 4), (-1e6, 2), (4, 4), (1e8, 1e8 + 1), (2, 3.5)])]
    x = spark.createDataFrame(rows, "a int, lo double, hi double")
    y = spark.createDataFrame(rows, "b int, lo2 double, hi2 double")
    want = {(i, j) for i, a, b in rows for j, c, d in rows if a < b and c < d and a < d and c < b}
    for width in (1.0, 64.0):
        got = [tuple(r) for r in ops.overlap_join(x, y, ("lo", "lo2"), ("hi", "hi2"), width).select("a", "b").collect()]
        assert len(got) == len(want) and set(got) == want


def test_containment_allows_bare_scalars_at_the_top_only(spark):
    from pyspark.sql import functions as F

    from brindle.functions import collections as col

    cases = [('{"a":[1]}', '{"a":1}', False), ("[1,2]", "1", True), ("[[1]]", "1", False), ('{"a":{"b":[1,{"c":2}]}}', '{"a":{"b":[{"c":2}]}}', True), ("[1,2]", "[2,1,1]", True), ('{"a":1}', "{}", True), ("1", "1.0", True), ("true", "1", False), ("null", "null", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.where(col.json_contains(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_whole_division_beyond_doubles(spark):
    from pyspark.sql import functions as F

    from brindle.functions import numbers as num

    rows = [(9007199254740993, 1), (-9007199254740993, 2), (7, -2), (-7, 2), (5, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a bigint, b bigint").select(num.div(F.col("a"), F.col("b"))).collect()]
    assert got == [9007199254740993, -4503599627370496, -3, -3, None]


def test_word_similarity_is_the_best_run_and_makes_trigrams_once(spark):
    import random

    from pyspark.sql import functions as F

    from brindle.functions import text as tx

    def trigrams(s):
        return [w[k : k + 3] for w in (f"  {x} " for x in s.split()) for k in range(len(w) - 2)]

    def best(a, b):
        mine, run = set(trigrams(a)), trigrams(b)
        return max((len(mine & set(run[i:j])) / len(mine | set(run[i:j])) for i in range(len(run)) for j in range(i + 1, len(run) + 1)), default=0.0) if mine else 0.0

    some = random.Random(5)
    rows = [("".join(some.choices("ab é1", k=some.randrange(8))), "".join(some.choices("ab é1", k=some.randrange(16)))) for _ in range(150)]
    rows += [("word", "two words"), ("", "a"), ("a", ""), ("a", "b")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", tx.word_similarity(F.col("a"), F.col("b")).alias("got"))
    assert all(abs(r.got - best(r.a, r.b)) < 1e-9 for r in df.collect())
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in nulls.select(tx.word_similarity(F.col("a"), F.col("b"))).collect()] == [None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
