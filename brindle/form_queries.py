"""Registered queries of sources, changes, user-defined functions, and of the incremental engine's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle import operators as ops
from brindle import sources as src
from brindle import tpch
from brindle.plans.incremental import IncrementalQuery
from brindle.plans.tree import Material, Sort
from brindle.queries import C, _register, both, query
from brindle.sources import table
from brindle.storage import Stored, shared_dir

# Sources and sinks


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority || chr(9) || '\"' || o_orderstatus || '\\' END AS note FROM orders")
def copy_out_and_in(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.when(C("o_custkey") % 5 != 0, F.concat("o_orderpriority", F.lit('\t"'), "o_orderstatus", F.lit("\\"))).alias("note"))
    path = _folder(spark, "copy")
    src.copy_to(o, path)
    return src.copy_from(spark, path, "o_orderkey BIGINT, note STRING")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def create_table_as_and_refresh(spark, folder):
    o, path = table(spark, folder, "orders"), _folder(spark, "ctas")
    src.create_table_as(o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")), path)
    return src.refresh(o.groupBy("o_custkey").agg(F.count("*").alias("n")), path)


@query("SELECT n_nationkey, row_number() OVER () - 1 AS row_index FROM nation")
def row_positions(spark, folder):
    return src.row_positions(spark, folder, "nation").select("n_nationkey", "row_index")


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || md5('7:' || o_orderkey)[1:7] AS BIGINT) < 26843545")
def sample_bernoulli(spark, folder):
    return src.bernoulli(table(spark, folder, "orders"), 10, "o_orderkey", seed=7).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100")
def sample_system_rows(spark, folder):
    return src.system_rows(table(spark, folder, "orders"), 100, "o_orderkey", seed=3).select("o_orderkey")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def xml_table(spark, folder):
    xml = F.concat(F.lit('<rows><row key="'), C("n_nationkey"), F.lit('"><name>'), C("n_name"), F.lit("</name><region>"), C("n_regionkey"), F.lit("</region></row></rows>"))
    rows = table(spark, folder, "nation").select(xml.alias("x"))
    return src.xml_rows(rows, "x", "/rows/row", {"n_nationkey": ("@key", "int"), "n_name": ("name", "string"), "region": ("region", "bigint")})


@query("SELECT n_nationkey, place, item FROM (SELECT n_nationkey, unnest([1, 2]) AS place, unnest([n_name, 'x' || n_regionkey]) AS item FROM nation)")
def json_table(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey", F.to_json(F.struct(F.array("n_name", F.concat(F.lit("x"), "n_regionkey")).alias("items"))).alias("j"))
    return n.select("n_nationkey", F.posexplode(F.from_json("j", "items array<string>")["items"]).alias("p", "item")).select("n_nationkey", (C("p") + 1).alias("place"), "item")


# Changes of tables


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def update_where(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return src.update(n, C("n_regionkey") == 2, {"n_name": F.concat(F.upper("n_name"), F.lit("!"))}).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def delete_returning(spark, folder):
    return src.deleted(table(spark, folder, "nation"), C("n_regionkey") == 2).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 20, n_name FROM nation WHERE n_nationkey >= 5")
def insert_do_nothing(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return src.upsert(n, n.select((C("n_nationkey") + 20).alias("n_nationkey"), "n_name"), ["n_nationkey"])


@query("SELECT k, CASE WHEN k < 5 THEN 'delete' WHEN k >= 25 THEN 'insert' ELSE 'update' END AS op FROM (SELECT n_nationkey AS k FROM nation UNION SELECT n_nationkey + 5 FROM nation) WHERE k < 5 OR k >= 25 OR k % 2 = 0")
def change_feed(spark, folder):
    n = table(spark, folder, "nation")
    old = n.select(C("n_nationkey").alias("k"), C("n_nationkey").cast("string").alias("v"))
    new = n.select((C("n_nationkey") + 5).alias("k"), F.when((C("n_nationkey") + 5) % 2 == 0, F.lit("new")).otherwise((C("n_nationkey") + 5).cast("string")).alias("v"))
    return src.changes(old, new, ["k"]).select("k", "op")


# Numbers in order, over all rows


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 99 AS v FROM orders")
def sequence_values(spark, folder):
    """nextval() in a given order, from 100."""
    return ops.numbered(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "v", start=100).select("o_orderkey", "v")


@query("SELECT o_custkey, CAST(sum(count(*)) OVER (ORDER BY o_custkey) AS BIGINT) AS running FROM orders GROUP BY o_custkey")
def running_total(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return ops.running_sum(counts, ["o_custkey"], "n", "running").select("o_custkey", "running")


both("merge_append", "SELECT k, s FROM (SELECT n_nationkey AS k, 'n' AS s FROM nation UNION ALL SELECT r_regionkey, 'r' FROM region) t ORDER BY k, s")

# User-defined functions, parameters


@query("SELECT n_nationkey, n_nationkey * 2 + n_regionkey AS v, n_name || '?' AS w FROM nation")
def function_of_sql(spark, folder):
    """Scalar functions whose bodies are SQL; the optimizer sees through them."""
    src.register(spark, folder, ("nation",))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice_and(a INT, b INT) RETURNS INT RETURN a * 2 + b")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION asked(s STRING) RETURNS STRING RETURN s || '?'")
    return spark.sql("SELECT n_nationkey, twice_and(n_nationkey, n_regionkey) AS v, asked(n_name) AS w FROM nation")


@query("SELECT n_nationkey, unnest([n_regionkey, n_regionkey + 10]) AS v FROM nation")
def function_of_rows(spark, folder):
    """A function that returns a table, one call for each row."""
    src.register(spark, folder, ("nation",))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION both_of(a INT) RETURNS TABLE (v INT) RETURN SELECT a AS v UNION ALL SELECT a + 10")
    return spark.sql("SELECT n_nationkey, t.v FROM nation, LATERAL both_of(n_regionkey) t")


@query("SELECT o_custkey, CAST(sum(CAST(o_orderkey AS BIGINT) * o_orderkey) AS BIGINT) AS squares, max(o_orderkey) - min(o_orderkey) AS width FROM orders GROUP BY 1")
def aggregate_of_ones_own(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
    step = lambda a, x: F.struct((a["s"] + x * x).alias("s"), F.least(a["lo"], x).alias("lo"), F.greatest(a["hi"], x).alias("hi"))
    join = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))
    out = ops.user_aggregate(o, ["o_custkey"], C("o_orderkey"), zero, step, join, "got")
    return out.select("o_custkey", C("got.s").alias("squares"), (C("got.hi") - C("got.lo")).alias("width"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT'")
def prepared_parameters(spark, folder):
    src.register(spark, folder, ("orders",))
    return src.prepare(spark, "SELECT o_orderkey FROM orders WHERE o_custkey = :customer OR o_orderpriority = :priority")(customer=7, priority="1-URGENT")


# Incremental operators


def _sorted(spark, folder):
    """Top orders by revenue: a sort over an aggregate over a kept buffer."""
    q = tpch.QUERIES["q3"]
    agg = q.plan()
    agg.child = Material(agg.child)
    agg.children = [agg.child]
    start, deltas = tpch._deltas(q, q.tables(spark, folder), "decay", 3, 0.1)
    inc = IncrementalQuery(Sort(agg, (("revenue", True), ("l_orderkey", False))), start, updates=set(q.updates), share=0.1)
    out = inc.start()
    for d in deltas:
        out = inc.refresh(d)
    return out


_register("incremental_sort_material", _sorted, tpch.QUERIES["q3"].sql)


def _mispredicted(spark, folder):
    """States chosen for rows of one table, while rows of all come."""
    q = tpch.QUERIES["q10"]
    start, deltas = tpch._deltas(q, q.tables(spark, folder), "uniform", 2, 0.1)
    inc = IncrementalQuery(q.plan(), start, updates={"c"}, share=0.1)
    out = inc.start()
    for d in deltas:
        out = inc.refresh(d)
    return out


_register("wrong_prediction_q10", _mispredicted, tpch.QUERIES["q10"].sql)


def _external(spark, folder):
    """Deltas that come from files."""
    q = tpch.QUERIES["q14"]
    start, deltas = tpch._deltas(q, q.tables(spark, folder), "uniform", 1, 0.3)
    inc = IncrementalQuery(q.plan(), start, updates=set(q.updates), share=0.3)
    inc.start()
    return inc.refresh({t: Stored(d, "external").df for t, d in deltas[0].items() if d is not None})


_register("external_delta_q14", _external, tpch.QUERIES["q14"].sql)


@query()
def state_report(spark, folder):
    """Which states are kept for the eleven queries, and their KB."""
    rows = []
    for name, q in tpch.QUERIES.items():
        inc = IncrementalQuery(q.plan(), q.tables(spark, folder), 4096, "dp", updates=set(q.updates))
        inc.kept = inc.decide()
        rows += [(name, n, kind, i, kept, kb) for n, (kind, i, kept, kb) in enumerate(inc.explain_state())]
    return spark.createDataFrame(rows, "query string, nth int, operator string, input int, kept boolean, kb int")


@query("SELECT 'orders' AS t, count(*) * 0.002 * 0.25 >= 1 AS some FROM orders UNION ALL SELECT 'lineitem', count(*) * 0.002 >= 1 FROM lineitem UNION ALL SELECT 'customer', count(*) * 0.002 >= 1 FROM customer")
def delta_presence(spark, folder):
    """Which tables a delta of 0.2 % brings a row of, by their rows and amplification."""
    from brindle.plans.deltas import has_delta

    rows = [(t, has_delta(table(spark, folder, t).count(), t, 0.002)) for t in ("orders", "lineitem", "customer")]
    return spark.createDataFrame(rows, "t string, some boolean")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_once(spark, folder):
    """One event of each kind for each user; on a stream, within the watermark."""
    from brindle.streaming import first_of_each

    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return first_of_each(e, ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT o_orderkey, nullif(o_custkey % 5, 2) AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 40")
def default_null_order(spark, folder):
    """Top rows in the default order of nulls: they count as larger than everything."""
    o = table(spark, folder, "orders").select("o_orderkey", F.nullif(C("o_custkey") % 5, F.lit(2)).alias("k"))
    return o.orderBy(ops.order("k", descending=True), ops.order("o_orderkey")).limit(40)
