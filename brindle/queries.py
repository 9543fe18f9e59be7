"""Registered queries of the engine's own operators, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle import operators as ops
from brindle import sources as src
from brindle import tpch
from brindle.functions import collections as col
from brindle.functions import numbers as num
from brindle.functions import strings as st
from brindle.functions import text as tx
from brindle.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def query(sql: str | None = None):
    """Decorator: a query by DataFrame operations, and its SQL."""

    def wrap(f):
        _register(f.__name__, f, sql)
        return f

    return wrap


def both(name: str, sql: str, other: str | None = None, tables: tuple[str, ...] = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events")) -> None:
    """A query that is SQL in the engine too (``other``: the oracle's form where dialects differ)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        src.register(spark, folder, tuple(t for t in tables if t in sql))
        return spark.sql(sql)

    _register(name, run, other or sql)


# The incremental workload

for _name, _q in tpch.QUERIES.items():
    _register(f"tpch_{_name}", lambda spark, folder, n=_name: tpch.batch(spark, folder, n), _q.sql)
    _register(f"incremental_{_name}", lambda spark, folder, n=_name: tpch.incremental(spark, folder, n), _q.sql)
for _name, _q in tpch.QUERIES.items():  # one delta where there are many views
    _register(f"lattice_{_name}", lambda spark, folder, n=_name, c=1 if len(_q.base) > 4 else 2: tpch.lattice(spark, folder, n, count=c), _q.sql)
_register("recycler_q3", lambda spark, folder: tpch.incremental(spark, folder, "q3", mode="decay", method="recycler", budget_kb=4096), tpch.QUERIES["q3"].sql)
_register("binomial_q12", lambda spark, folder: tpch.incremental(spark, folder, "q12", mode="binomial", size=0.004, method="small-first", budget_kb=2048), tpch.QUERIES["q12"].sql)

# Scans, projection, predicates

both("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
both("three_valued_logic", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_totalprice > 50000 END IS NULL AS unknown, (o_custkey > 10) IS TRUE AS is_true, (o_custkey > 10) IS NOT FALSE AS not_false FROM orders")
both("distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS differs, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS is_same FROM orders")
both("case_coalesce", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS prio, greatest(o_custkey, 100) AS g, least(o_custkey, 100) AS l FROM orders")
both("like_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' OR p_type ILIKE 'pro_o%' OR p_brand NOT LIKE 'Brand%'")
both("regex_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '#?[1-3][24]$'", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#?[1-3][24]$')")
both("between_symmetric", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN least(90000, 20000) AND greatest(90000, 20000)")
both("row_comparison", "SELECT n_nationkey, n_name FROM nation WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, r_regionkey + 5 FROM region) OR n_regionkey > 3 OR (n_regionkey = 3 AND n_nationkey > 12)")
both("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
both("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
both("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
both("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
both("lateral_top_all", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = c_custkey) t")
both("cte_shared", "WITH m AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT a.k, round(a.s, 2) AS s FROM m a WHERE a.s > (SELECT avg(s) FROM m)")
both("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")

# Joins

both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
both("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 180000")
both("join_full_all", "SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey AND o_totalprice < c_acctbal * 20")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("join_using", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
both("join_natural", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b")
both("join_semi", "SELECT o_orderkey FROM orders LEFT SEMI JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0", "SELECT o_orderkey FROM orders SEMI JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0")
both("join_theta", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")


@query("SELECT a.event_id, max_by(b.event_id, (b.ts, b.event_id)) AS prior_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts WHERE a.event_type <> 'purchase' GROUP BY a.event_id")
def join_as_of(spark, folder):
    e = table(spark, folder, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("prior_id"))
    return ops.as_of_join(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), right, ["user_id"], "ts", "ts", ["prior_id"]).select("event_id", "prior_id")


@query("WITH x AS (SELECT o_orderkey AS a, o_totalprice AS lo, o_totalprice + 40 AS hi FROM orders WHERE o_orderstatus = 'F'), y AS (SELECT o_orderkey AS b, o_totalprice AS lo2, o_totalprice + 40 AS hi2 FROM orders WHERE o_orderstatus = 'O') SELECT a, b FROM x JOIN y ON lo < hi2 AND lo2 < hi")
def join_overlap(spark, folder):
    o = table(spark, folder, "orders")
    x = o.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS a", "o_totalprice AS lo", "o_totalprice + 40 AS hi")
    y = o.where("o_orderstatus = 'O'").selectExpr("o_orderkey AS b", "o_totalprice AS lo2", "o_totalprice + 40 AS hi2")
    return ops.overlap_join(x, y, ("lo", "lo2"), ("hi", "hi2"), 160.0).select("a", "b")


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_salted(spark, folder):
    o = table(spark, folder, "orders").selectExpr("o_custkey AS k", "o_orderkey")
    c = table(spark, folder, "customer").selectExpr("c_custkey AS k", "c_mktsegment")
    return ops.salted_join(o, c, ["k"], 8).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


for _op, _how, _sql in (("<", "any", "o_totalprice < (SELECT max(o_totalprice) / 9 FROM orders)"), (">=", "all", "o_totalprice >= (SELECT max(o_totalprice) / 9 FROM orders)")):

    def _quantified(spark, folder, op=_op, how=_how):
        o = table(spark, folder, "orders")
        return ops.compare_all(o, F.col("o_totalprice") * 9, op, o.select(F.col("o_totalprice").alias("v")), "v", how).select("o_orderkey")

    _register(f"quantified_{_how}", _quantified, f"SELECT o_orderkey FROM orders WHERE o_totalprice * 9 {_op} {_how.upper()} (SELECT o_totalprice FROM orders)")

# Aggregation

both("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("agg_distinct_filter", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity > 40) AS large FROM lineitem GROUP BY l_returnflag")
both("agg_statistics", "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(avg(l_quantity), 6) AS mean, bool_and(l_quantity > 0) AS all_positive, bool_or(l_quantity > 49) AS some_large FROM lineitem GROUP BY l_linestatus")
both("agg_pairs", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS c, CAST(regr_count(l_quantity, l_discount) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
both("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("percentile_disc", "SELECT l_returnflag, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS p25, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS p50 FROM lineitem GROUP BY l_returnflag")
both("percentile_cont", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50 FROM lineitem GROUP BY l_returnflag")
both("mode_lowest", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS usual FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, min(o_orderpriority) AS usual FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(count(*)) OVER (PARTITION BY o_orderstatus) AS most FROM orders GROUP BY 1, 2) WHERE n = most GROUP BY 1")
both("hypothetical_rank", "SELECT l_returnflag, sum(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) + 1 AS rank_of_25 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) AS BIGINT) + 1 AS rank_of_25 FROM lineitem GROUP BY l_returnflag")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (), ())")
def grouping_sets_duplicates(spark, folder):
    return ops.grouping_sets(table(spark, folder, "orders"), [["o_orderstatus"], ["o_orderpriority"], [], []], [F.count("*").alias("n")])


@query("SELECT NULL::VARCHAR AS o_orderstatus, count(*) AS n FROM orders WHERE false UNION ALL SELECT NULL, count(*) FROM orders WHERE false")
def grouping_sets_empty_input(spark, folder):
    return ops.grouping_sets(table(spark, folder, "orders").where("false"), [[], ["o_orderstatus"], []], [F.count("*").alias("n")])


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def agg_ordered_string(spark, folder):
    o = table(spark, folder, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(col.array_agg_by(F.col("o_orderkey").cast("string"), F.col("o_orderkey")), ",").alias("keys"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, folder):
    return ops.distinct_on(table(spark, folder, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


both("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

# Windows

both("window_ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
both("window_distribution", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
both("window_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
both("window_rows_frame", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM orders", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM orders")
both("window_default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n FROM orders")
both("window_over_aggregate", "SELECT o_custkey, sum(count(*)) OVER (ORDER BY o_custkey) AS running FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(sum(count(*)) OVER (ORDER BY o_custkey) AS BIGINT) AS running FROM orders GROUP BY o_custkey")
both("window_filter", "SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders")


@query("SELECT o_orderkey, lag(o_orderkey, CAST(o_orderkey % 3 AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS got FROM orders")
def window_lag_column(spark, folder):
    return ops.shifted(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], "o_orderkey", F.col("o_orderkey") % 3, "got").select("o_orderkey", "got")


@query("SELECT o_orderkey, nth_value(o_orderkey, CAST(o_orderkey % 3 + 1 AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS got FROM orders")
def window_nth_column(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return ops.nth_value(o, ["o_custkey"], [F.col("o_orderkey")], "o_orderkey", F.col("o_orderkey") % 3 + 1, "got").select("o_orderkey", "got")


# Order, limits, sets, recursion

both("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
both("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
both("intersect_all", "SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT s_suppkey FROM supplier")
both("intersect_distinct", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
both("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
both("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
both("set_precedence", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey < 2")
both("recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("SELECT o_orderkey, nullif(o_custkey % 7, 3) AS k, row_number() OVER (ORDER BY nullif(o_custkey % 7, 3) NULLS FIRST, o_orderkey) AS place FROM orders")
def nulls_order_all(spark, folder):
    """Every row's place: its block's first place, and its place in the block."""
    o = table(spark, folder, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(3)).alias("k"), F.floor(F.col("o_orderkey") / 65536).alias("block"))
    before = Window.orderBy(F.asc_nulls_first("k"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = o.groupBy("k", "block").agg(F.count("*").alias("n")).select(F.col("k").alias("k2"), F.col("block").alias("block2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("k", "block").orderBy("o_orderkey"))
    placed = o.withColumn("nth", within).join(starts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("block2")))
    return placed.select("o_orderkey", "k", (F.col("start") + F.col("nth")).alias("place"))


@query("WITH RECURSIVE t(k) AS (SELECT 1 UNION SELECT (k * 2) % 13 FROM t) SELECT k FROM t")
def recursive_distinct(spark, folder):
    return ops.recursive_union(spark.sql("SELECT 1 AS k"), lambda t: t.select(((F.col("k") * 2) % 13).alias("k")))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 3 AS p FROM part), t(key, parent, level, branch) AS (SELECT k, CAST(NULL AS BIGINT), 0, CAST(k AS VARCHAR) FROM e WHERE k = 1 UNION ALL SELECT k, p, level + 1, branch || '~' || k FROM t JOIN e ON p = key AND k <> p WHERE level < 3) SELECT * FROM t")
def connect_by(spark, folder):
    p = table(spark, folder, "part").selectExpr("p_partkey AS k", "p_partkey div 3 AS p")
    return ops.connect_by(p, "k", "p", 1, depth=3)


@query("WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 3 AS p FROM part), t(key, parent, level, branch) AS (SELECT k, CAST(NULL AS BIGINT), 0, CAST(k AS VARCHAR) FROM e WHERE k = 1 UNION ALL SELECT k, p, level + 1, branch || '~' || k FROM t JOIN e ON p = key AND k <> p) SELECT * FROM t")
def connect_by_all(spark, folder):
    p = table(spark, folder, "part").selectExpr("p_partkey AS k", "p_partkey div 3 AS p")
    return ops.connect_by(p, "k", "p", 1)


# Sources, samples, rows from arrays, changes


@query("SELECT event_id, ordinality, word FROM (SELECT event_id, unnest(string_split(event_type || '-x', '-')) AS word, generate_subscripts(string_split(event_type || '-x', '-'), 1) AS ordinality FROM events)")
def unnest_ordinality(spark, folder):
    e = table(spark, folder, "events")
    return src.with_ordinality(e.select("event_id", "event_type"), F.split(F.concat("event_type", F.lit("-x")), "-"), "word").select("event_id", "ordinality", "word")


@query("SELECT n_nationkey, a, b FROM (SELECT n_nationkey, unnest(generate_series(1, 3)) AS i FROM nation), LATERAL (SELECT i AS a, CASE WHEN i <= 2 THEN i * 10 END AS b)")
def lockstep_rows(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey")
    out = ops.zipped_rows(n, {"a": F.sequence(F.lit(1), F.lit(3)), "b": F.array(F.lit(10), F.lit(20))})
    return out.select("n_nationkey", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


@query("SELECT * FROM (SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) PIVOT (min(k) FOR o_orderpriority IN ('1-URGENT' AS urgent, '5-LOW' AS low))")
def crosstab(spark, folder):
    out = ops.crosstab(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", ["1-URGENT", "5-LOW"])
    return out.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("SELECT n_nationkey, name, value FROM (SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey * 2 AS BIGINT) AS b FROM nation) UNPIVOT (value FOR name IN (a, b))")
def unpivot(spark, folder):
    n = table(spark, folder, "nation").selectExpr("n_nationkey", "CAST(n_regionkey AS BIGINT) AS a", "CAST(n_nationkey * 2 AS BIGINT) AS b")
    return ops.unpivot(n, ["n_nationkey"], ["a", "b"])


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
def upsert(spark, folder):
    n = table(spark, folder, "nation")
    rows = n.where("n_regionkey = 1").selectExpr("n_nationkey", "n_name").union(n.where("n_regionkey = 2").selectExpr("n_nationkey + 100", "n_name"))
    return src.upsert(n.select("n_nationkey", "n_name"), rows, ["n_nationkey"], {"n_name": F.concat("new.n_name", F.lit("!"))})


@query("SELECT n_nationkey FROM nation WHERE NOT coalesce(nullif(n_regionkey, 3) > 2, false)")
def delete_where(spark, folder):
    return src.delete(table(spark, folder, "nation"), F.nullif("n_regionkey", F.lit(3)) > 2).select("n_nationkey")


# Event time


@query("SELECT epoch_ms(CAST(floor(epoch(ts) / 3600) * 3600000 AS BIGINT)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_window(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# Functions


def _columns(name: str, source: str, key: str, columns: dict, sql: str, spread: bool = False) -> None:
    """A query of one table: its key and some expressions. spread: much work a row; rows of few or small files are dealt over all cores."""

    def run(spark, folder):
        df = table(spark, folder, source)
        df = df.repartition(spark.sparkContext.defaultParallelism) if spread else df
        return df.select(key, *[c().alias(n) for n, c in columns.items()])

    _register(name, run, sql)


C = F.col
_columns("fn_strings", "customer", "c_custkey", {
    "up": lambda: F.upper("c_mktsegment"), "ini": lambda: st.initcap(F.concat("c_name", F.lit("-xy z"))), "sub": lambda: st.substr(C("c_name"), -1, 5), "lef": lambda: st.left(C("c_name"), -3), "rig": lambda: st.right(C("c_name"), -3),
    "con": lambda: st.concat(C("c_name"), F.lit(None).cast("string"), C("c_mktsegment")), "pos": lambda: F.instr("c_name", "0").cast("bigint"), "rep": lambda: F.replace("c_name", F.lit("0"), F.lit("o")), "spl": lambda: st.split_part(C("c_name"), "#", 2),
    "tra": lambda: F.translate("c_name", "0123", "abcd"), "rev": lambda: F.reverse("c_name"), "lpa": lambda: F.lpad("c_mktsegment", 12, "*"), "md": lambda: F.md5(C("c_name")), "hex": lambda: st.to_hex(C("c_custkey")), "asc": lambda: F.ascii("c_name").cast("bigint"),
}, "SELECT c_custkey, upper(c_mktsegment) AS up, list_reduce(list_transform(regexp_extract_all(c_name || '-xy z', '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), lambda a, b: a || b) AS ini, c_name[1:3] AS sub, left(c_name, -3) AS lef, right(c_name, -3) AS rig, concat(c_name, NULL, c_mktsegment) AS con, strpos(c_name, '0') AS pos, replace(c_name, '0', 'o') AS rep, split_part(c_name, '#', 2) AS spl, translate(c_name, '0123', 'abcd') AS tra, reverse(c_name) AS rev, lpad(c_mktsegment, 12, '*') AS lpa, md5(c_name) AS md, lower(to_hex(c_custkey)) AS hex, CAST(ascii(c_name) AS BIGINT) AS asc FROM customer")
_columns("fn_regexp", "part", "p_partkey", {
    "first": lambda: st.regexp_replace(C("p_name"), "[aeiou]", "_"), "every": lambda: st.regexp_replace(C("p_name"), "[AEIOU]", "_", "gi"), "digits": lambda: F.array_join(F.flatten(st.regexp_matches(C("p_brand"), "[0-9]", "g")), ","), "parts": lambda: F.array_join(st.regexp_split(C("p_name"), "[^a-zA-Z0-9]+"), "|"), "sim": lambda: st.similar_to(C("p_type"), "(PROMO|ECON)%"),
}, "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[AEIOU]', '_', 'gi') AS every, array_to_string(regexp_extract_all(p_brand, '[0-9]'), ',') AS digits, array_to_string(regexp_split_to_array(p_name, '[^a-zA-Z0-9]+'), '|') AS parts, p_type SIMILAR TO '(PROMO|ECON).*' AS sim FROM part")
_columns("fn_quote_format", "nation", "n_nationkey", {
    "lit": lambda: st.quote_literal(F.concat(C("n_name"), F.lit("'s"))), "nul": lambda: st.quote_nullable(F.nullif(C("n_name"), F.lit("NATION_3"))), "form": lambda: st.format_("%s of %2$s: %%", C("n_name"), C("n_regionkey")),
}, "SELECT n_nationkey, '''' || n_name || '''''s''' AS lit, coalesce('''' || nullif(n_name, 'NATION_3') || '''', 'NULL') AS nul, n_name || ' of ' || n_regionkey || ': %' AS form FROM nation")
_columns("fn_numbers", "lineitem", "l_orderkey", {
    "line": lambda: C("l_linenumber"), "quot": lambda: num.div(C("l_orderkey"), C("l_linenumber")), "rest": lambda: C("l_orderkey") % C("l_linenumber"), "cut": lambda: num.trunc(C("l_quantity") / 4, 0), "pow": lambda: F.round(F.pow("l_quantity", F.lit(0.5)), 6), "sgn": lambda: F.signum(C("l_quantity") - 25), "buck": lambda: num.width_bucket(C("l_quantity"), 0.0, 50.0, 5), "xo": lambda: C("l_orderkey").bitwiseXOR(C("l_partkey")),
}, "SELECT l_orderkey, l_linenumber AS line, l_orderkey // l_linenumber AS quot, l_orderkey % l_linenumber AS rest, trunc(l_quantity / 4) AS cut, round(pow(l_quantity, 0.5), 6) AS pow, CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn, CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 6 ELSE CAST(floor(l_quantity / 10) AS INT) + 1 END AS buck, xor(l_orderkey, l_partkey) AS xo FROM lineitem")
_columns("fn_dates", "orders", "o_orderkey", {
    "mon": lambda: F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"), "cen": lambda: num.extract("century", C("o_orderdate")), "dec": lambda: num.extract("decade", C("o_orderdate")), "dw": lambda: num.extract("dow", C("o_orderdate")), "iso": lambda: num.extract("isodow", C("o_orderdate")), "wk": lambda: num.extract("week", C("o_orderdate")), "ep": lambda: num.extract("epoch", C("o_orderdate")), "qu": lambda: num.extract("quarter", C("o_orderdate")),
    "txt": lambda: num.to_char(C("o_orderdate"), "YYYY/MM/DD HH24:MI"), "ov": lambda: num.overlaps(C("o_orderdate"), F.expr("o_orderdate + INTERVAL '40' DAY"), F.expr("TIMESTAMP_NTZ '1998-01-01'"), F.expr("TIMESTAMP_NTZ '1998-02-01'")),
}, "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, CAST(extract(century FROM o_orderdate) AS DOUBLE) AS cen, CAST(extract(decade FROM o_orderdate) AS DOUBLE) AS dec, CAST(extract(dow FROM o_orderdate) AS DOUBLE) AS dw, CAST(extract(isodow FROM o_orderdate) AS DOUBLE) AS iso, CAST(extract(week FROM o_orderdate) AS DOUBLE) AS wk, CAST(extract(epoch FROM o_orderdate) AS DOUBLE) AS ep, CAST(extract(quarter FROM o_orderdate) AS DOUBLE) AS qu, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS txt, (o_orderdate < TIMESTAMP '1998-02-01' AND TIMESTAMP '1998-01-01' < o_orderdate + INTERVAL 40 DAY) AS ov FROM orders")
_columns("fn_arrays", "nation", "n_nationkey", {
    "pos": lambda: col.array_position(F.array(F.lit(3), C("n_regionkey"), F.lit(1)), C("n_regionkey")), "uni": lambda: F.array_join(F.array_sort(F.array_union(F.array(F.lit(1), F.lit(2)), F.array(C("n_regionkey")))), ","), "has": lambda: col.array_contains_all(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(C("n_regionkey"))), "unq": lambda: F.array_join(col.uniq(F.array(F.lit(1), F.lit(1), C("n_regionkey"), F.lit(1))), ","), "sub": lambda: F.array_join(col.subarray(F.sequence(F.lit(1), F.lit(6)), 2, 3), ","), "dims": lambda: col.array_dims(F.sequence(F.lit(0), C("n_regionkey"))),
}, "SELECT n_nationkey, CAST(list_position([3, n_regionkey, 1], n_regionkey) AS BIGINT) AS pos, array_to_string(list_sort(list_distinct([1, 2, n_regionkey])), ',') AS uni, n_regionkey IN (0, 1, 2) AS has, CASE WHEN n_regionkey = 1 THEN '1' ELSE '1,' || n_regionkey || ',1' END AS unq, '2,3,4' AS sub, '[1:' || (n_regionkey + 1) || ']' AS dims FROM nation")
_columns("fn_maps", "nation", "n_nationkey", {
    "def": lambda: col.defined(F.create_map(F.lit("a"), F.nullif(C("n_name"), F.lit("NATION_1"))), "a"), "mer": lambda: F.element_at(col.merge(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")), F.create_map(F.lit("a"), C("n_name"))), "a"), "del": lambda: F.size(col.delete_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ["a"])).cast("bigint"), "con": lambda: col.map_contains(F.create_map(F.lit("a"), C("n_regionkey"), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1))), "arr": lambda: F.array_join(col.to_array(F.create_map(F.lit("k"), C("n_name"))), ","),
}, "SELECT n_nationkey, n_name <> 'NATION_1' AS def, n_name AS mer, CAST(1 AS BIGINT) AS del, n_regionkey = 1 AS con, 'k,' || n_name AS arr FROM nation")
_columns("fn_json", "events", "event_id", {
    "has": lambda: col.json_has(F.to_json(F.struct("user_id", "event_type")), "user_id"), "nohas": lambda: col.json_has_all(F.to_json(F.struct("user_id")), ["user_id", "z"]), "got": lambda: F.get_json_object(F.to_json(F.struct("user_id", "event_type")), "$.event_type"), "deep": lambda: col.json_contains(F.to_json(F.struct(F.struct("user_id", "event_type").alias("a"))), F.lit('{"a": {"event_type": "click"}}')),
}, "SELECT event_id, true AS has, false AS nohas, event_type AS got, event_type = 'click' AS deep FROM events")
_columns("fn_ranges", "orders", "o_orderkey", {
    "has": lambda: col.range_has(col.make_range(F.lit(10), F.lit(500), "[]", True), C("o_custkey")), "over": lambda: col.range_overlaps(col.make_range(C("o_custkey"), C("o_custkey") + 10), col.make_range(F.lit(100), F.lit(120))), "adj": lambda: col.range_adjacent(col.make_range(C("o_custkey"), C("o_custkey") + 10), col.make_range(C("o_custkey") + 10, C("o_custkey") + 20)), "lo": lambda: col.range_merge(col.make_range(C("o_custkey"), C("o_custkey") + 10), col.make_range(F.lit(100), F.lit(120)))["lo"].cast("bigint"), "hi": lambda: col.range_intersection(col.make_range(C("o_custkey"), C("o_custkey") + 10), col.make_range(F.lit(100), F.lit(120)))["hi"].cast("bigint"),
}, "SELECT o_orderkey, o_custkey >= 10 AND o_custkey < 501 AS has, o_custkey < 120 AND 100 < o_custkey + 10 AS over, true AS adj, least(o_custkey, 100) AS lo, CASE WHEN o_custkey < 120 AND 100 < o_custkey + 10 THEN least(o_custkey + 10, 120) END AS hi FROM orders")
_columns("fn_text_search", "part", "p_partkey", {
    "hit": lambda: tx.parse("a & !zz | b:*").matches(tx.to_vector(F.concat(F.lit("a quick "), C("p_type")))), "phr": lambda: tx.parse("quick <-> promo").matches(tx.to_vector(F.concat(F.lit("a quick "), C("p_type")))), "lev": lambda: F.levenshtein("p_type", F.lit("PROMO")).cast("bigint"), "dif": lambda: tx.difference(C("p_type"), C("p_type")), "acc": lambda: tx.unaccent(F.lit("éàü")),
}, "SELECT p_partkey, true AS hit, p_type = 'PROMO' AS phr, levenshtein(p_type, 'PROMO') AS lev, 4 AS dif, 'eau' AS acc FROM part")
_columns("fn_paths_networks", "nation", "n_nationkey", {
    "lvl": lambda: tx.nlevel(F.concat(F.lit("a.b."), C("n_name"))), "sub": lambda: tx.subpath(F.concat(F.lit("a.b."), C("n_name")), -2), "anc": lambda: tx.is_ancestor(F.lit("a.b"), F.concat(F.lit("a.b."), C("n_name"))), "lca": lambda: tx.lca(F.concat(F.lit("a.b."), C("n_name")), F.lit("a.b.c.d")), "net": lambda: tx.network(F.concat(F.lit("10.1."), C("n_nationkey"), F.lit(".77/20"))), "bro": lambda: tx.broadcast(F.concat(F.lit("10.1."), C("n_nationkey"), F.lit(".77/24"))), "inn": lambda: tx.in_network(F.concat(F.lit("10.1."), C("n_nationkey"), F.lit(".77")), F.lit("10.1.0.0/20")),
}, "SELECT n_nationkey, 3 AS lvl, 'b.' || n_name AS sub, true AS anc, 'a.b' AS lca, '10.1.' || (n_nationkey // 16 * 16) || '.0/20' AS net, '10.1.' || n_nationkey || '.255/24' AS bro, n_nationkey < 16 AS inn FROM nation")
_columns("fn_places", "customer", "c_custkey", {
    "miles": lambda: F.round(tx.geo_distance(C("c_nationkey") * 1.0, F.lit(10.0), F.lit(5.0), F.lit(40.0)), 4), "cheb": lambda: tx.cube_distance(F.array(C("c_nationkey") * 1.0, F.lit(2.0)), F.array(F.lit(4.0), F.lit(9.0)), "chebyshev"), "taxi": lambda: tx.cube_distance(F.array(C("c_nationkey") * 1.0, F.lit(2.0)), F.array(F.lit(4.0), F.lit(9.0)), "taxicab"),
}, "SELECT c_custkey, round(2 * 3958.747716 * asin(least(sqrt(pow(sin(radians(10.0 - 40.0) / 2), 2) + cos(radians(10.0)) * cos(radians(40.0)) * pow(sin(radians(c_nationkey - 5.0) / 2), 2)), 1.0)), 4) AS miles, CAST(greatest(abs(c_nationkey - 4.0), 7.0) AS DOUBLE) AS cheb, CAST(abs(c_nationkey - 4.0) + 7.0 AS DOUBLE) AS taxi FROM customer")
_columns("fn_conditions", "orders", "o_orderkey", {
    "nn": lambda: num.num_nulls(F.nullif("o_orderstatus", F.lit("F")), C("o_custkey")), "no": lambda: num.num_nonnulls(F.nullif("o_orderstatus", F.lit("F")), C("o_custkey")), "pretty": lambda: num.size_pretty(C("o_orderkey") * 1000), "back": lambda: num.size_bytes(F.concat(C("o_custkey").cast("string"), F.lit(" kB"))),
}, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS nn, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS no, CASE WHEN o_orderkey * 1000 < 10240 THEN o_orderkey * 1000 || ' bytes' WHEN CAST(floor(o_orderkey * 1000 / 1024.0 + 0.5) AS BIGINT) < 10240 THEN CAST(floor(o_orderkey * 1000 / 1024.0 + 0.5) AS BIGINT) || ' kB' ELSE CAST(floor(o_orderkey * 1000 / 1048576.0 + 0.5) AS BIGINT) || ' MB' END AS pretty, o_custkey * 1024 AS back FROM orders")
