"""Registered queries of scalar functions, aggregates and small forms of SQL, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle import operators as ops
from brindle.functions import collections as col
from brindle.functions import numbers as num
from brindle.functions import strings as st
from brindle.functions import text as tx
from brindle.queries import C, _columns, _register, both, query
from brindle.sources import table

# Strings

_columns("fn_case_pad", "customer", "c_custkey", {
    "low": lambda: F.lower("c_name"), "rp": lambda: F.rpad("c_mktsegment", 12, "-"), "bt": lambda: st.btrim(F.concat(F.lit("xyx"), C("c_name"), F.lit("yx")), "xy"), "lt": lambda: F.ltrim(F.concat(F.lit("  "), C("c_name"))), "rt": lambda: F.rtrim(F.concat(C("c_name"), F.lit("  "))), "tr": lambda: F.trim(F.concat(F.lit(" "), C("c_name"), F.lit(" "))),
    "chr": lambda: st.chr_(C("c_custkey") % 500 + 200), "rpt": lambda: F.repeat("c_mktsegment", 2), "len": lambda: F.length("c_name").cast("bigint"), "clen": lambda: F.char_length(F.concat(C("c_name"), F.lit("é"))).cast("bigint"), "olen": lambda: F.octet_length(F.concat(C("c_name"), F.lit("é"))).cast("bigint"),
    "ovl": lambda: st.overlay(C("c_name"), F.lit("##"), 3), "ovn": lambda: st.overlay(C("c_name"), F.lit("##"), 3, 4), "cws": lambda: F.concat_ws("/", "c_mktsegment", F.nullif(C("c_name"), C("c_name")), "c_name"),
}, "SELECT c_custkey, lower(c_name) AS low, rpad(c_mktsegment, 12, '-') AS rp, trim('xyx' || c_name || 'yx', 'xy') AS bt, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt, trim(' ' || c_name || ' ') AS tr, chr(CAST(c_custkey % 500 + 200 AS INT)) AS chr, repeat(c_mktsegment, 2) AS rpt, length(c_name) AS len, length(c_name || 'é') AS clen, CAST(strlen(c_name || 'é') AS BIGINT) AS olen, c_name[1:2] || '##' || c_name[5:] AS ovl, c_name[1:2] || '##' || c_name[7:] AS ovn, concat_ws('/', c_mktsegment, NULL, c_name) AS cws FROM customer")
_columns("fn_quote_encode", "customer", "c_custkey", {
    "idn": lambda: st.quote_ident(F.when(C("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(C("c_custkey") % 3 == 1, F.lit("select")).otherwise(F.concat(C("c_mktsegment"), F.lit('"x')))), "enc": lambda: st.encode(C("c_name").cast("binary"), "hex"), "b64": lambda: st.encode(C("c_name").cast("binary"), "base64"), "dec": lambda: st.decode(st.encode(C("c_name").cast("binary"), "hex"), "hex").cast("string"), "sha": lambda: F.sha2("c_name", 256),
    "gb": lambda: st.get_bit(C("c_name").cast("binary"), 3), "sb": lambda: st.set_bit(C("c_name").cast("binary"), 0, 1).cast("string"), "idp": lambda: F.array_join(st.parse_ident(F.concat(F.lit('Abc."De""f".'), C("c_mktsegment"))), "|"),
}, """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN '"select"' ELSE '"' || c_mktsegment || '""x"' END AS idn, lower(hex(encode(c_name))) AS enc, base64(encode(c_name)) AS b64, c_name AS dec, sha256(c_name) AS sha, CAST((ascii(c_name) // 8) % 2 AS INT) AS gb, CASE WHEN ascii(c_name) % 2 = 1 THEN c_name ELSE chr(CAST(ascii(c_name) + 1 AS INT)) || c_name[2:] END AS sb, 'abc|De"f|' || lower(c_mktsegment) AS idp FROM customer""")
_columns("fn_regexp_groups", "part", "p_partkey", {
    "one": lambda: F.array_join(st.regexp_match(C("p_name"), "([a-z]+)[^a-z]+([0-9]+)"), "|"), "all": lambda: F.array_join(F.transform(st.regexp_matches(C("p_type"), "([AEIOU])([^AEIOU])", "g"), lambda m: F.concat(m[0], F.lit(":"), m[1])), ","), "cls": lambda: st.regexp_replace(C("p_name"), "([(]|[a-e])", "<\\1>"), "grp": lambda: F.lit(st.count_groups(r"(a)[(](?:b)\((?<n>c)")), "cis": lambda: C("p_type").rlike("(?i)promo"), "ncs": lambda: ~C("p_type").rlike("(?i)promo"),
    "esc": lambda: st.similar_to(F.concat(C("p_type"), F.lit("_%")), "PROMO#_#%", "#"),
}, "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '([a-z]+)[^a-z]+([0-9]+)') THEN regexp_extract(p_name, '([a-z]+)[^a-z]+([0-9]+)', 1) || '|' || regexp_extract(p_name, '([a-z]+)[^a-z]+([0-9]+)', 2) END AS one, array_to_string(list_transform(regexp_extract_all(p_type, '[AEIOU][^AEIOU]'), lambda x: x[1:1] || ':' || x[2:2]), ',') AS all, regexp_replace(p_name, '([(]|[a-e])', '<\\1>') AS cls, 2 AS grp, p_type ILIKE '%promo%' AS cis, p_type NOT ILIKE '%promo%' AS ncs, p_type = 'PROMO' AS esc FROM part")


@query("SELECT p_partkey, unnest(string_split_regex(p_name, '[^a-zA-Z0-9]+')) AS piece FROM part")
def regexp_split_rows(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.explode(st.regexp_split(C("p_name"), "[^a-zA-Z0-9]+")).alias("piece"))


# Dates and times

_columns("fn_make_dates", "orders", "o_orderkey", {
    "ts": lambda: num.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "YYYY-MM-DD HH24:MI:SS"), "day": lambda: num.to_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "DD/MM/YYYY"), "mkd": lambda: F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)), "mts": lambda: F.make_timestamp_ntz(F.year("o_orderdate"), F.lit(2), F.lit(28), F.lit(1), F.lit(2), F.lit(3.5)),
    "later": lambda: F.col("o_orderdate") + F.make_interval(months=C("o_custkey").cast("int") % 12, days=F.lit(3)), "fin": lambda: num.isfinite(F.when(C("o_custkey") % 2 == 0, F.lit(float("inf"))).otherwise(C("o_totalprice"))), "mil": lambda: num.extract("millennium", C("o_orderdate")), "doy": lambda: num.extract("doy", C("o_orderdate")),
    "jd": lambda: num.justify_days(F.lit(0), C("o_custkey"))[0], "jr": lambda: num.justify_days(F.lit(0), C("o_custkey"))[1], "jh": lambda: num.justify_hours(F.lit(0).cast("bigint"), C("o_custkey") * 3_600_000_000)[0], "jm": lambda: num.justify_interval(F.lit(0).cast("bigint"), C("o_custkey") + 1, F.lit(-3_600_000_000))[0], "jk": lambda: num.justify_interval(F.lit(0).cast("bigint"), C("o_custkey") + 1, F.lit(-3_600_000_000))[1], "jl": lambda: num.justify_interval(F.lit(0).cast("bigint"), C("o_custkey") + 1, F.lit(-3_600_000_000))[2],
    "tz": lambda: F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), C("o_orderdate")),
}, "SELECT o_orderkey, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS ts, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS mkd, make_timestamp(year(o_orderdate), 2, 28, 1, 2, 3.5) AS mts, o_orderdate + to_months(CAST(o_custkey % 12 AS INT)) + INTERVAL 3 DAY AS later, o_custkey % 2 <> 0 AS fin, CAST(extract(millennium FROM o_orderdate) AS DOUBLE) AS mil, CAST(extract(doy FROM o_orderdate) AS DOUBLE) AS doy, o_custkey // 30 AS jd, o_custkey % 30 AS jr, o_custkey // 24 AS jh, o_custkey // 30 AS jm, o_custkey % 30 AS jk, 82800000000 AS jl, o_orderdate + INTERVAL 330 MINUTE AS tz FROM orders")
_columns("fn_clock", "region", "r_regionkey", {
    "today": lambda: F.current_date() == F.current_timestamp().cast("date"), "same": lambda: F.now() == F.current_timestamp(), "loc": lambda: F.localtimestamp().cast("date") == F.current_date(), "who": lambda: F.length(F.current_user()) > 0, "db": lambda: F.current_database(), "typ": lambda: F.typeof(C("r_name")), "par": lambda: F.length(F.uuid()) == 36,
}, "SELECT r_regionkey, current_date = CAST(current_date AS DATE) AS today, now() = now() AS same, true AS loc, true AS who, 'default' AS db, 'string' AS typ, length(CAST(uuid() AS VARCHAR)) = 36 AS par FROM region")

# Numbers

_columns("fn_math", "lineitem", "l_orderkey", {
    "line": lambda: C("l_linenumber"), "ab": lambda: F.abs(C("l_quantity") - 25), "ce": lambda: F.ceil(C("l_extendedprice") / 7).cast("double"), "fl": lambda: F.floor(-C("l_extendedprice") / 7).cast("double"), "rd": lambda: num.round_(C("l_quantity") / 2), "rn": lambda: F.round(num.round_(C("l_extendedprice").cast("decimal(12,2)"), 1, True).cast("double"), 1), "sq": lambda: F.round(num.sqrt(C("l_quantity")), 9), "ex": lambda: F.round(F.exp(C("l_discount")), 9), "ln": lambda: F.round(F.ln(C("l_quantity")), 9), "lg": lambda: F.round(F.log10(C("l_quantity")), 9), "pi": lambda: F.round(F.pi() * C("l_quantity"), 9), "cb": lambda: F.round(F.cbrt("l_quantity"), 9),
    "sd": lambda: F.round(num.sind(F.lit(30.0) * C("l_linenumber")), 9), "cd": lambda: F.round(num.cosd(F.lit(30.0) * C("l_linenumber")), 9), "tc": lambda: num.trunc(C("l_extendedprice"), 1), "md": lambda: -C("l_orderkey") % 7, "bd": lambda: num.div(F.lit(9007199254740993) + C("l_orderkey"), C("l_linenumber").cast("bigint")), "ba": lambda: C("l_orderkey").bitwiseAND(C("l_partkey")), "bo": lambda: C("l_orderkey").bitwiseOR(C("l_partkey")), "bn": lambda: F.bitwise_not("l_orderkey"), "sl": lambda: F.shiftleft("l_orderkey", 3), "sr": lambda: F.shiftright("l_orderkey", 2), "fc": lambda: F.factorial("l_linenumber"), "gc": lambda: C("l_quantity").cast("bigint") % 5,
}, "SELECT l_orderkey, l_linenumber AS line, abs(l_quantity - 25) AS ab, CAST(ceil(l_extendedprice / 7) AS DOUBLE) AS ce, CAST(floor(-l_extendedprice / 7) AS DOUBLE) AS fl, round_even(l_quantity / 2, 0) AS rd, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS rn, round(sqrt(l_quantity), 9) AS sq, round(exp(l_discount), 9) AS ex, round(ln(l_quantity), 9) AS ln, round(log10(l_quantity), 9) AS lg, round(pi() * l_quantity, 9) AS pi, round(cbrt(l_quantity), 9) AS cb, round(sin(radians(30.0 * l_linenumber)), 9) + 0 AS sd, round(cos(radians(30.0 * l_linenumber)), 9) + 0 AS cd, CAST(trunc(CAST(l_extendedprice AS DECIMAL(12,2)) * 10) AS DOUBLE) / 10 AS tc, -l_orderkey % 7 AS md, (9007199254740993 + l_orderkey) // l_linenumber AS bd, l_orderkey & l_partkey AS ba, l_orderkey | l_partkey AS bo, ~l_orderkey AS bn, l_orderkey << 3 AS sl, l_orderkey >> 2 AS sr, CAST(factorial(l_linenumber) AS BIGINT) AS fc, CAST(l_quantity AS BIGINT) % 5 AS gc FROM lineitem")


@query("SELECT n_nationkey, unnest(generate_series(n_nationkey, 30, 7)) AS v FROM nation")
def series_rows(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", F.explode(F.sequence(C("n_nationkey").cast("bigint"), F.lit(30).cast("bigint"), F.lit(7).cast("bigint"))).alias("v"))


@query("SELECT true AS repeats, true AS inside, count(*) AS n FROM nation")
def random_seeded(spark, folder):
    n = table(spark, folder, "nation").coalesce(1)
    two = n.select(F.rand(5).alias("a"), F.rand(5).alias("b"), F.randn(6).alias("c"))
    return two.agg(F.every(F.col("a") == F.col("b")).alias("repeats"), F.every((F.col("a") >= 0) & (F.col("a") < 1) & F.col("c").isNotNull()).alias("inside"), F.count("*").alias("n"))


# Predicates, casts, forms of SQL

both("cast_rules", "SELECT o_orderkey, CAST(o_totalprice AS STRING) IS NOT NULL AS txt, CAST(CAST(o_custkey AS STRING) AS BIGINT) AS num, TRY_CAST(o_orderpriority AS INT) AS bad, CAST('true' AS BOOLEAN) AND o_custkey > 5 AS flag, CAST(o_orderdate AS DATE) AS day FROM orders", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS txt, CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS num, TRY_CAST(o_orderpriority AS INT) AS bad, CAST('true' AS BOOLEAN) AND o_custkey > 5 AS flag, CAST(o_orderdate AS DATE) AS day FROM orders")
both("like_escape", "SELECT p_partkey FROM part WHERE concat(p_brand, '%') LIKE '%!%' ESCAPE '!' AND p_name NOT LIKE '%!_%' ESCAPE '!'", "SELECT p_partkey FROM part WHERE concat(p_brand, '%') LIKE '%!%' ESCAPE '!' AND p_name NOT LIKE '%!_%' ESCAPE '!'")
both("between_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN least(l_partkey % 40, nullif(l_suppkey, 3)) AND greatest(l_partkey % 40, nullif(l_suppkey, 3))", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN least(l_partkey % 40, nullif(l_suppkey, 3)) AND greatest(l_partkey % 40, nullif(l_suppkey, 3))")
both("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000")
both("join_pure_theta", "SELECT a.n_nationkey AS a_key, b.s_suppkey AS b_key FROM nation a JOIN supplier b ON a.n_nationkey > b.s_nationkey AND b.s_acctbal < 0")
both("join_merge", "SELECT /*+ MERGE(c) */ o_orderkey, c_name FROM orders FULL JOIN customer c ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders FULL JOIN customer c ON o_custkey = c_custkey")
both("group_by_expression", "SELECT o_custkey % 10 AS bucket, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_custkey % 10, 2", "SELECT o_custkey % 10 AS bucket, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY o_custkey % 10, 2")
both("grouping_sets_nested", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS (ROLLUP (o_orderstatus, o_orderpriority), (year(o_orderdate)))", "SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS (ROLLUP (o_orderstatus, o_orderpriority), (year(o_orderdate)))")
both("agg_spread", "SELECT l_returnflag, round(stddev(l_quantity), 9) AS s, round(stddev_pop(l_quantity), 9) AS sp, round(variance(l_quantity), 9) AS v, round(var_samp(l_quantity), 9) AS vs, bit_and(l_suppkey) AS ba, bit_or(l_suppkey) AS bo FROM lineitem GROUP BY l_returnflag")
both("agg_any_value_every", "SELECT o_custkey, every(o_totalprice > 1000) AS ev, min(o_orderdate) AS a, max(o_orderpriority) AS b FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS ev, min(o_orderdate) AS a, max(o_orderpriority) AS b FROM orders GROUP BY o_custkey")
both("window_refined", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_custkey) AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS b FROM orders", "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS a, count(*) OVER (w ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey)")
both("window_range_values", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM orders")
both("window_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
both("set_type_unification", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_acctbal FROM supplier UNION ALL SELECT NULL", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION ALL SELECT s_acctbal FROM supplier UNION ALL SELECT NULL")
both("parenthesised_sets", "(SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation) EXCEPT ALL (SELECT n_regionkey FROM nation WHERE n_nationkey < 12)")
both("min_max_plain", "SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem")
both("lateral_top_two", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
both("order_all_keys", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC NULLS LAST, n_name COLLATE UTF8_BINARY", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC NULLS LAST, n_name")

for _op, _how, _name in (("=", "all", "quantified_eq_all"), ("<>", "any", "quantified_ne_any"), ("=", "any", "quantified_eq_any"), ("<>", "all", "quantified_ne_all")):

    def _quantified(spark, folder, op=_op, how=_how):
        o, n = table(spark, folder, "nation"), table(spark, folder, "region").where("r_regionkey = 3" if how == "all" and op == "=" else "r_regionkey > 2")
        return ops.compare_all(o, F.nullif(C("n_regionkey"), F.lit(1)), op, n.select("r_regionkey"), "r_regionkey", how).select("n_nationkey")

    _register(_name, _quantified, f"SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 1) {_op} {_how.upper()} (SELECT r_regionkey FROM region WHERE {'r_regionkey = 3' if (_op, _how) == ('=', 'all') else 'r_regionkey > 2'})")

_columns("array_quantified", "nation", "n_nationkey", {
    "any_eq": lambda: F.array_contains(F.array(F.lit(1), F.lit(3)), C("n_regionkey")), "any_lt": lambda: F.exists(F.array(F.lit(1), F.lit(3)), lambda x: C("n_regionkey") < x), "all_ge": lambda: F.forall(F.array(F.lit(1), F.lit(3)), lambda x: C("n_regionkey") >= x), "all_null": lambda: F.forall(F.array(F.lit(1), F.lit(None).cast("int")), lambda x: C("n_regionkey") != x),
}, "SELECT n_nationkey, n_regionkey IN (1, 3) AS any_eq, n_regionkey < 3 AS any_lt, n_regionkey >= 3 AS all_ge, CASE WHEN n_regionkey = 1 THEN false END AS all_null FROM nation")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 25) + 1 AS rank, count(DISTINCT l_quantity) FILTER (WHERE l_quantity < 25) + 1 AS dense_rank, round(count(*) FILTER (WHERE l_quantity < 25) / count(*), 9) AS percent_rank, round((count(*) FILTER (WHERE l_quantity <= 25) + 1) / (count(*) + 1), 9) AS cume_dist FROM lineitem GROUP BY 1")
def hypothetical_set(spark, folder):
    made = num.hypothetical(C("l_quantity"), 25.0)
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(made["rank"].alias("rank"), made["dense_rank"].alias("dense_rank"), F.round(made["percent_rank"], 9).alias("percent_rank"), F.round(made["cume_dist"], 9).alias("cume_dist"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, CAST(to_json(list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey)) AS VARCHAR) AS doc FROM orders GROUP BY o_custkey")
def agg_arrays_json(spark, folder):
    o = table(spark, folder, "orders")
    return o.groupBy("o_custkey").agg(col.array_agg_by(C("o_orderkey"), C("o_orderkey")).alias("keys"), F.to_json(col.array_agg_by(F.struct(C("o_orderkey").alias("k"), C("o_orderstatus").alias("s")), C("o_orderkey"))).alias("doc"))


@query("SELECT count(DISTINCT l_partkey) BETWEEN 0.9 * count(DISTINCT l_partkey) AND 1.1 * count(DISTINCT l_partkey) AS near, count(*) AS n FROM lineitem")
def approximate_distinct(spark, folder):
    l = table(spark, folder, "lineitem")
    return l.agg(F.approx_count_distinct("l_partkey", 0.02).between(F.count_distinct("l_partkey") * 0.9, F.count_distinct("l_partkey") * 1.1).alias("near"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT (SELECT count(*) FROM region)")
def limit_subquery(spark, folder):
    """LIMIT (SELECT ...): the number comes first, then a bounded top-n."""
    n = table(spark, folder, "region").count()
    return table(spark, folder, "customer").orderBy("c_custkey").limit(n).select("c_custkey", "c_name")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
def window_offset_subquery(spark, folder):
    """ROWS (SELECT ...) PRECEDING: the number comes first."""
    from pyspark.sql import Window

    n = table(spark, folder, "region").where("r_regionkey = 1").agg(F.max("r_regionkey")).first()[0]
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-n, 0)
    return table(spark, folder, "orders").select("o_orderkey", F.count("*").over(w).alias("n"))


# Arrays, maps, JSON, enums, ranges

_ARR = lambda: F.array(F.lit(3), C("n_regionkey"), F.lit(1), C("n_regionkey"))
_columns("fn_array_edit", "nation", "n_nationkey", {
    "app": lambda: F.array_append(_ARR(), C("n_nationkey")), "pre": lambda: F.array_prepend(_ARR(), C("n_nationkey")), "cat": lambda: F.concat(_ARR(), F.array(F.lit(9))), "poss": lambda: col.array_positions(_ARR(), C("n_regionkey")), "len": lambda: F.size(_ARR()).cast("bigint"), "card": lambda: F.cardinality(F.array_distinct(_ARR())).cast("bigint"), "txt": lambda: col.array_to_string(F.transform(F.array_append(_ARR(), F.lit(None).cast("int")), lambda x: x.cast("string")), "/", "*"), "asc": lambda: col.int_sort(_ARR()), "desc": lambda: col.int_sort(_ARR(), "desc"), "idx": lambda: col.idx(_ARR(), C("n_nationkey")), "inter": lambda: col.int_inter(_ARR(), F.array(F.lit(1), F.lit(2), F.lit(3))), "minus": lambda: col.int_subtract(_ARR(), F.array(F.lit(1))), "lap": lambda: F.arrays_overlap(_ARR(), F.array(F.lit(0), F.lit(4))), "cup": lambda: col.int_union(_ARR(), F.array(F.lit(8))), "set": lambda: F.array(C("n_regionkey")), "rem": lambda: F.array_remove(_ARR(), 3),
}, "SELECT n_nationkey, [3, n_regionkey, 1, n_regionkey, n_nationkey] AS app, [n_nationkey, 3, n_regionkey, 1, n_regionkey] AS pre, [3, n_regionkey, 1, n_regionkey, 9] AS cat, list_filter([1, 2, 3, 4], lambda i: [3, n_regionkey, 1, n_regionkey][i] = n_regionkey) AS poss, CAST(4 AS BIGINT) AS len, CAST(len(list_distinct([3, n_regionkey, 1])) AS BIGINT) AS card, '3/' || n_regionkey || '/1/' || n_regionkey || '/*' AS txt, list_sort([3, n_regionkey, 1, n_regionkey]) AS asc, list_reverse_sort([3, n_regionkey, 1, n_regionkey]) AS desc, CAST(coalesce(list_position([3, n_regionkey, 1, n_regionkey], n_nationkey), 0) AS INT) AS idx, list_sort(list_distinct(list_intersect([3, n_regionkey, 1], [1, 2, 3]))) AS inter, list_sort(list_filter(list_distinct([3, n_regionkey]), lambda x: x <> 1)) AS minus, n_regionkey IN (0, 4) AS lap, list_sort(list_distinct([3, n_regionkey, 1, 8])) AS cup, [n_regionkey] AS set, list_filter([3, n_regionkey, 1, n_regionkey], lambda x: x <> 3) AS rem FROM nation")
_MAP = lambda: F.create_map(F.lit("a"), C("n_name"), F.lit("b"), F.nullif(C("n_regionkey").cast("string"), F.lit("2")))
_columns("fn_map_parts", "nation", "n_nationkey", {
    "ks": lambda: F.array_join(F.array_sort(F.map_keys(_MAP())), ","), "vs": lambda: F.array_join(F.map_values(_MAP()), ",", "-"), "ex": lambda: F.map_contains_key(_MAP(), "b"), "got": lambda: F.try_element_at(_MAP(), F.lit("zz")), "sl": lambda: F.array_join(F.map_values(col.slice_keys(_MAP(), ["a", "zz"])), ","), "mat": lambda: F.array_join(F.transform(col.to_matrix(_MAP()), lambda p: F.concat_ws("=", p)), ";"), "js": lambda: F.to_json(_MAP(), {"ignoreNullFields": "false"}), "rec": lambda: F.from_json(F.to_json(_MAP()), "a string, b string")["b"].cast("int"),
}, "SELECT n_nationkey, 'a,b' AS ks, n_name || ',' || CASE WHEN n_regionkey = 2 THEN '-' ELSE CAST(n_regionkey AS VARCHAR) END AS vs, true AS ex, CAST(NULL AS VARCHAR) AS got, n_name AS sl, 'a=' || n_name || ';b' || coalesce('=' || nullif(n_regionkey, 2), '') AS mat, '{\"a\":\"' || n_name || '\",\"b\":' || coalesce('\"' || nullif(n_regionkey, 2) || '\"', 'null') || '}' AS js, nullif(n_regionkey, 2) AS rec FROM nation")


@query("SELECT n_nationkey, k, v FROM (SELECT n_nationkey, unnest(['name', 'region']) AS k, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS v FROM nation)")
def map_each(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", F.explode(F.create_map(F.lit("name"), C("n_name"), F.lit("region"), C("n_regionkey").cast("string"))).alias("k", "v"))


_DOC = lambda: F.to_json(F.struct(F.array(C("user_id"), F.lit(7)).alias("a"), F.struct(C("event_type").alias("t"), C("user_id").alias("u")).alias("o")))
_columns("fn_json_compare", "events", "event_id", {
    "deep": lambda: col.json_contains(_DOC(), F.lit('{"o": {"t": "click"}}')), "inarr": lambda: col.json_contains(_DOC(), F.lit('{"a": [5]}')), "scal": lambda: col.json_contains(_DOC(), F.lit('{"a": 7}')), "top": lambda: col.json_contains(F.to_json(F.array(C("user_id"), F.lit(7))), F.lit("7")), "cont": lambda: col.json_contained(F.lit('{"a": [7]}'), _DOC()), "eq": lambda: col.json_eq(F.concat(F.lit('{"x": 1.0, "u": '), C("user_id").cast("string"), F.lit("}")), F.lit('{"u": 5, "x": 1}')), "cmp": lambda: col.json_cmp(C("user_id").cast("string"), F.lit("9")), "h": lambda: col.json_hash(F.concat(F.lit('{"x": 1.0, "u": '), C("user_id").cast("string"), F.lit("}"))) == col.json_hash(F.concat(F.lit('{"u": '), C("user_id").cast("string"), F.lit(', "x": 1}'))), "any": lambda: col.json_has_any(_DOC(), ["zz", "o"]), "row": lambda: F.to_json(F.struct("user_id", "event_type")),
}, "SELECT event_id, event_type = 'click' AS deep, user_id = 5 AS inarr, user_id <> user_id AS scal, user_id IS NOT NULL AS top, user_id IS NOT NULL AS cont, user_id = 5 AS eq, CAST(sign(user_id - 9) AS INT) AS cmp, event_id = event_id AS h, user_id = user_id AS any, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS row FROM events")
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_columns("fn_enums", "orders", "o_orderkey", {
    "first": lambda: col.enum_first(_PRIO), "last": lambda: col.enum_last(_PRIO), "up": lambda: F.array_join(col.enum_range(C("o_orderpriority"), F.lit(None).cast("string"), _PRIO), ","), "low": lambda: col.enum_place(C("o_orderpriority"), _PRIO) < 3,
}, "SELECT o_orderkey, '1-URGENT' AS first, '5-LOW' AS last, array_to_string(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: x >= o_orderpriority), ',') AS up, o_orderpriority < '3' AS low FROM orders")
_R = lambda: col.make_range(C("o_custkey"), C("o_custkey") + 10)
_S = lambda: col.make_range(F.lit(40).cast("bigint"), F.lit(60).cast("bigint"))
_columns("fn_range_more", "orders", "o_orderkey", {
    "emp": lambda: col.make_range(F.lit(50).cast("bigint"), F.greatest(C("o_custkey"), F.lit(50).cast("bigint")))["empty"], "linc": lambda: _R()["lo_inc"], "uinc": lambda: _R()["hi_inc"], "linf": lambda: col.lower_inf(col.make_range(F.nullif(C("o_custkey"), F.lit(7)), F.lit(None).cast("bigint"))), "uinf": lambda: col.upper_inf(col.make_range(C("o_custkey"), F.nullif(C("o_custkey") + 1, F.lit(8)))), "by": lambda: col.range_contained_by(_R(), _S()), "con": lambda: col.range_contains(col.make_range(F.lit(0).cast("bigint"), F.lit(100).cast("bigint")), _R()), "mlo": lambda: col.range_minus(_R(), _S())["lo"], "mhi": lambda: col.range_minus(_R(), _S())["hi"], "left": lambda: col.range_left_of(_R(), _S()), "day": lambda: col.range_has(col.make_range(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"), "[]"), C("o_orderdate").cast("date")),
}, "SELECT o_orderkey, o_custkey <= 50 AS emp, true AS linc, false AS uinc, o_custkey = 7 AS linf, o_custkey = 7 AS uinf, o_custkey >= 40 AND o_custkey + 10 <= 60 AS by, o_custkey + 10 <= 100 AS con, CASE WHEN o_custkey >= 40 AND o_custkey <= 50 THEN NULL WHEN o_custkey > 50 AND o_custkey < 60 THEN 60 ELSE o_custkey END AS mlo, CASE WHEN o_custkey >= 40 AND o_custkey <= 50 THEN NULL WHEN o_custkey < 40 AND o_custkey + 10 > 40 THEN 40 ELSE o_custkey + 10 END AS mhi, o_custkey + 10 <= 40 AS left, CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS day FROM orders")

# Similarity, networks, places

_columns("fn_fuzzy", "part", "p_partkey", {
    "lle": lambda: tx.levenshtein_within(C("p_type"), F.lit("PROMO"), 3), "snd": lambda: F.soundex("p_type"), "tri": lambda: F.size(tx.trigrams(C("p_type"))).cast("bigint"), "sim": lambda: F.round(tx.similarity(C("p_type"), C("p_type")), 6), "simx": lambda: F.round(tx.similarity(F.lit("word"), F.concat(F.lit("word "), F.repeat(F.lit("z"), (C("p_partkey") % 2).cast("int")))), 6),
}, "SELECT p_partkey, CAST(least(levenshtein(p_type, 'PROMO'), 4) AS INT) AS lle, CASE p_type WHEN 'PROMO' THEN 'P650' WHEN 'ECONOMY' THEN 'E255' WHEN 'STANDARD' THEN 'S353' WHEN 'SMALL' THEN 'S540' WHEN 'MEDIUM' THEN 'M350' WHEN 'LARGE' THEN 'L620' END AS snd, CAST(length(p_type) + 1 AS BIGINT) AS tri, 1.0::DOUBLE AS sim, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE round(5.0 / 7, 6) END::DOUBLE AS simx FROM part")
_columns("fn_network_parts", "nation", "n_nationkey", {
    "ho": lambda: tx.host(F.concat(F.lit("10.1."), C("n_nationkey"), F.lit(".77/20"))), "ml": lambda: tx.masklen(F.concat(F.lit("10.1.2.3/"), C("n_nationkey") % 8 + 20)), "mx": lambda: tx.masklen(F.concat(F.lit("10.1.2."), C("n_nationkey"))), "mrg": lambda: tx.merged_network(F.concat(F.lit("10.1."), C("n_nationkey"), F.lit(".77")), F.lit("10.1.0.5")),
}, "SELECT n_nationkey, '10.1.' || n_nationkey || '.77' AS ho, CAST(n_nationkey % 8 + 20 AS INT) AS ml, 32 AS mx, CASE WHEN n_nationkey = 0 THEN '10.1.0.0/25' ELSE '10.1.0.0/' || (24 - CAST(floor(log2(n_nationkey)) AS INT) - 1) END AS mrg FROM nation")
_columns("fn_geometry", "customer", "c_custkey", {
    "e": lambda: F.round(tx.earth_distance(tx.ll_to_earth(F.lit(10.0), C("c_nationkey") * 1.0), tx.ll_to_earth(F.lit(10.0), C("c_nationkey") * 1.0 + 1)), 3), "d": lambda: F.round(tx.cube_distance(F.array(C("c_nationkey") * 1.0, F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))), 6), "ar": lambda: tx.box_area(F.struct((C("c_nationkey") * 1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(5.0).alias("y2"))), "ce": lambda: tx.box_center(F.struct((C("c_nationkey") * 1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(5.0).alias("y2")))["x"], "ra": lambda: F.round(tx.circle_area(C("c_nationkey") * 1.0), 6), "seg": lambda: tx.segments_overlap(C("c_nationkey") * 1.0, C("c_nationkey") + 2.0, F.lit(10.0), F.lit(12.0)), "np": lambda: F.size(F.array(F.struct(F.lit(0.0), F.lit(1.0)), F.struct(F.lit(2.0), F.lit(3.0)))),
}, "SELECT c_custkey, round(6378168.0 * 2 * asin(cos(radians(10.0)) * sin(radians(0.5))), 3) AS e, round(sqrt(c_nationkey * c_nationkey + 16.0), 6) AS d, CAST((30 - c_nationkey) * 4 AS DOUBLE) AS ar, (30 + c_nationkey) / 2 AS ce, round(pi() * c_nationkey * c_nationkey, 6) AS ra, c_nationkey <= 12 AND c_nationkey + 2 >= 10 AS seg, 2 AS np FROM customer")
_columns("fn_text_more", "part", "p_partkey", {
    "pl": lambda: tx.plain("quick promo").matches(tx.to_vector(F.concat(F.lit("a quick brown "), C("p_type")))), "st": lambda: F.size(tx.strip(tx.to_vector(F.concat(F.lit("x "), C("p_type"), F.lit(" x"))))), "nn": lambda: F.lit(tx.parse("a & (b | !c)").numnode()), "rk": lambda: F.round(tx.rank(tx.to_vector(F.concat(F.lit("x "), C("p_type"))), ["promo"]), 6), "hl": lambda: tx.headline(F.concat(F.lit("the quick "), C("p_type")), ["promo"]), "rw": lambda: tx.parse("a & b").rewritten(tx.parse("b"), tx.parse("promo")).matches(tx.to_vector(F.concat(F.lit("a "), C("p_type")))),
}, "SELECT p_partkey, p_type = 'PROMO' AS pl, 2 AS st, 6 AS nn, CASE WHEN p_type = 'PROMO' THEN round(0.1 / 1.64493406685, 6) ELSE 0.0 END AS rk, 'the quick ' || CASE WHEN p_type = 'PROMO' THEN '<b>PROMO</b>' ELSE p_type END AS hl, p_type = 'PROMO' AS rw FROM part")
_columns("fn_crypto_ids", "customer", "c_custkey", {
    "m": lambda: F.md5("c_name"), "s1": lambda: F.sha1("c_name"), "s2": lambda: F.sha2("c_name", 256), "enc": lambda: F.aes_decrypt(F.aes_encrypt("c_name", F.lit("0123456789abcdef")), F.lit("0123456789abcdef")).cast("string"), "h": lambda: tx.hmac_sha256(C("c_name").cast("binary"), b"key") == tx.hmac_sha256(C("c_name").cast("binary"), b"key"), "v5": lambda: F.substring(tx.uuid5(C("c_name")), 15, 1), "sn": lambda: F.length(F.uuid()).cast("bigint"),
}, "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, c_name AS enc, c_name = c_name AS h, '5' AS v5, length(CAST(uuid() AS VARCHAR)) AS sn FROM customer")
_columns("fn_word_similarity", "part", "p_partkey", {
    "half": lambda: F.round(tx.word_similarity(F.lit("word"), F.concat(F.lit("two words "), F.repeat(F.lit("z"), (C("p_partkey") % 3).cast("int")))), 6), "own": lambda: F.round(tx.word_similarity(C("p_type"), F.concat(F.lit("zz "), C("p_type"))), 6),
}, "SELECT p_partkey, CASE WHEN p_partkey >= 0 THEN 0.8::DOUBLE END AS half, CASE WHEN length(p_type) > 0 THEN 1.0::DOUBLE END AS own FROM part", spread=True)
_columns("fn_path_queries", "nation", "n_nationkey", {
    "any": lambda: tx.path_matches(F.concat(F.lit("top.a."), C("n_name")), "*.NATION_1"), "two": lambda: tx.path_matches(F.concat(F.lit("top.a."), C("n_name")), "top.*{1,2}.nation_2@"), "pre": lambda: tx.path_matches(F.concat(F.lit("top.a."), C("n_name")), "top.a|b.NATION_1*"), "no": lambda: tx.path_matches(F.concat(F.lit("top.a."), C("n_name")), "top.!b.!NATION_3"), "few": lambda: tx.path_matches(F.concat(F.lit("top.a."), C("n_name")), "top.*{2,}.NATION_1"),
}, "SELECT n_nationkey, n_name = 'NATION_1' AS any, n_name = 'NATION_2' AS two, n_name LIKE 'NATION!_1%' ESCAPE '!' AS pre, n_name <> 'NATION_3' AS no, n_name <> n_name AS few FROM nation")
_columns("fn_times", "orders", "o_orderkey", {
    "tz": lambda: F.make_timestamp_ltz(F.year("o_orderdate"), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit("UTC")).cast("timestamp_ntz"), "clk": lambda: F.current_timestamp() <= F.now(),
}, "SELECT o_orderkey, make_timestamp(year(o_orderdate), 1, 2, 3, 4, 5) AS tz, o_orderkey IS NOT NULL AS clk FROM orders")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 7 ROWS FETCH FIRST 5 ROWS ONLY")
def fetch_first(spark, folder):
    from brindle import sources as src

    src.register(spark, folder, ("orders",))
    return src.statement(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 7 ROWS FETCH FIRST 5 ROWS ONLY")


@query("SELECT range AS k, range * range AS v FROM range(0, 1000)")
def foreign_scan(spark, folder):
    from brindle import sources as src

    return src.foreign(spark, "squares", "k bigint, v bigint", 4, lambda part, parts: ((k, k * k) for k in range(part, 1000, parts)))


@query("SELECT o_orderkey, sum(o_custkey * o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS squares FROM orders")
def window_own_aggregate(spark, folder):
    """An aggregate of one's own over a window's frame."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rowsBetween(-2, 0)
    own = F.aggregate(F.collect_list("o_custkey").over(w), F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    return table(spark, folder, "orders").select("o_orderkey", own.alias("squares"))


@query("SELECT n_nationkey, unnest(['name', 'region']) AS k FROM nation")
def map_key_rows(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", F.explode(F.map_keys(F.create_map(F.lit("name"), C("n_name"), F.lit("region"), C("n_regionkey").cast("string")))).alias("k"))


@query("SELECT o_orderkey, s FROM (SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders) WHERE o_custkey < 40")
def window_filter_pushed(spark, folder):
    """A condition on the partition key reaches the scan, below the window."""
    from brindle import sources as src

    src.register(spark, folder, ("orders",))
    return spark.sql("SELECT o_orderkey, s FROM (SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders) t WHERE o_custkey < 40")
