"""Scans, filters, joins, aggregation, windows, sorting, set operations, subqueries and CTEs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, math
from ..operators import distinct, joins, ordering, recursion, setops
from ..operators.ordering import order
from ..sources import tables as src
from .registry import Tables, query


def _net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


# --- flagship --------------------------------------------------------------------


@query("""
SELECT n_name, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       count(*) AS items, round(avg(l_quantity), 4) AS avg_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY 1, 2 HAVING count(*) > 5""")
def revenue_by_nation_month(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    orders = t.orders.where((F.col("o_orderdate") >= F.lit(dt.datetime(1995, 1, 1))) & (F.col("o_orderdate") < F.lit(dt.datetime(1997, 1, 1))))
    rows = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(joins.broadcast_if_small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    grouped = rows.groupBy("n_name", month).agg(F.round(F.sum(_net()), 2).alias("revenue"), F.count("*").alias("items"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"))
    return grouped.where("items > 5")


# --- scans and predicates -----------------------------------------------------------


@query("SELECT * FROM nation")
def full_scan(spark, sf):
    return Tables(spark, sf).nation


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_read(spark, sf):
    return Tables(spark, sf).orders.where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 9, 33, 1000000000)")
def multi_point_read(spark, sf):
    return Tables(spark, sf).orders.where(F.col("o_orderkey").isin(1, 5, 9, 33, 1_000_000_000)).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 10 AND 60 AND l_linenumber >= 2")
def prefix_range_scan(spark, sf):
    return Tables(spark, sf).lineitem.where(F.col("l_orderkey").between(10, 60) & (F.col("l_linenumber") >= 2)).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 OR NOT (c_nationkey < 20 OR c_acctbal < 5000)")
def where_boolean(spark, sf):
    seg, bal, nat = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    return Tables(spark, sf).customer.where((seg == "BUILDING") & (bal > 0) | ~((nat < 20) | (bal < 5000))).select("c_custkey")


_NULLED = "(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nat FROM customer)"


def _nulled(spark, sf):
    key = F.col("c_custkey")
    return Tables(spark, sf).customer.select(key, F.when(key % 3 != 0, F.col("c_acctbal")).alias("bal"), F.when(key % 5 != 0, F.col("c_nationkey")).alias("nat"))


@query(f"SELECT c_custkey, bal IS NULL AS no_bal, (bal > 0) IS TRUE AS pos, (bal > 0) IS NOT FALSE AS maybe, nat IS DISTINCT FROM 3 AS other FROM {_NULLED}")
def is_predicates(spark, sf):
    pos = F.col("bal") > 0
    return _nulled(spark, sf).select("c_custkey", F.col("bal").isNull().alias("no_bal"), pos.eqNullSafe(True).alias("pos"), (~pos.eqNullSafe(False)).alias("maybe"), (~F.col("nat").eqNullSafe(3)).alias("other"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN least(30, 10) AND greatest(30, 10)")
def between_symmetric(spark, sf):
    a, b = F.lit(30), F.lit(10)
    return Tables(spark, sf).part.where(F.col("p_size").between(F.least(a, b), F.greatest(a, b))).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def not_in_subquery(spark, sf):
    src.register(spark, sf, "customer", "supplier")
    return spark.sql("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def exists_subquery(spark, sf):
    t = Tables(spark, sf)
    return joins.exists(t.customer, t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def not_exists_subquery(spark, sf):
    t = Tables(spark, sf)
    return joins.not_exists(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT p_partkey, p_size = ANY ([1, 7, 14]) AS some_, p_size <> ALL ([1, 7, 14]) AS none_ FROM part")
def quantified_arrays(spark, sf):
    a = F.array(*map(F.lit, (1, 7, 14)))
    return Tables(spark, sf).part.select("p_partkey", arrays.any_of(F.col("p_size"), lambda x, e: x == e, a).alias("some_"), arrays.all_of(F.col("p_size"), lambda x, e: x != e, a).alias("none_"))


@query("SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_type ILIKE 'st%' AS st, p_name SIMILAR TO '.*(e|o).*' AS sim, regexp_matches(p_brand, '(?s)#[0-9]+') AS rx FROM part")
def pattern_matching(spark, sf):
    from ..functions.strings import java_pattern, similar_to

    return Tables(spark, sf).part.select("p_partkey", F.col("p_name").like("%a%").alias("has_a"), F.col("p_type").ilike("st%").alias("st"), similar_to(F.col("p_name"), "%(e|o)%").alias("sim"), F.col("p_brand").rlike(java_pattern("#[0-9]+")).alias("rx"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS flag,
CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' END AS size_ FROM lineitem""")
def case_expressions(spark, sf):
    flag = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("none")
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", flag.alias("flag"), F.when(F.col("l_quantity") > 40, "big").when(F.col("l_quantity") > 20, "mid").alias("size_"))


@query("""SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS s,
CAST(round_even(o_totalprice, 0) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) || '-' || o_orderstatus AS t FROM orders""")
def integer_and_text_operators(spark, sf):
    k = F.col("o_orderkey")
    return Tables(spark, sf).orders.select("o_orderkey", math.int_div(k, 7).alias("q"), (k % 7).alias("r"), k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(3)).alias("o"), k.bitwiseXOR(F.lit(5)).alias("x"), F.shiftleft(k, 2).alias("l"), F.shiftright(k, 1).alias("s"), math.to_int(F.col("o_totalprice")).alias("i"), F.concat(k.cast("string"), F.lit("-"), "o_orderstatus").alias("t"))


@query("""SELECT c_custkey, round(CAST(c_acctbal AS DOUBLE) / 7, 6) AS d FROM customer""")
def float_division(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", F.round(F.col("c_acctbal") / 7, 6).alias("d"))


@query("SELECT * FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.0), (NULL, 'c', NULL)) v(n, s, d)")
def values_list(spark, sf):
    return src.values(spark, [(1, "a", 1.5), (2, None, 2.0), (None, "c", None)], ["n", "s", "d"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5 AND o_totalprice > 1000.0")
def prepared_parameters(spark, sf):
    from .engine import Engine

    engine = Engine(spark).register(sf, "orders")
    engine.sql("PREPARE dear AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_totalprice > $2")
    return engine.sql("EXECUTE dear(5, 1000.0)")


# --- joins ---------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def inner_join(spark, sf):
    t = Tables(spark, sf)
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def left_join(spark, sf):
    t = Tables(spark, sf)
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark, sf):
    t = Tables(spark, sf)
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s.s_nationkey = c.c_nationkey")
def full_join(spark, sf):
    t = Tables(spark, sf)
    sides = t.supplier.select("s_suppkey", "s_nationkey"), t.customer.where("c_acctbal > 9000").select("c_custkey", "c_nationkey")
    return joins.full_in_cells(*sides, "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark, sf):
    t = Tables(spark, sf)
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey <> 1")
def theta_join(spark, sf):
    t = Tables(spark, sf)
    return t.supplier.join(t.nation, (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("n_regionkey") != 1)).select("s_suppkey", "n_nationkey")


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x FULL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)")
def using_join(spark, sf):
    t = Tables(spark, sf)
    x = t.nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    return joins.using(x, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("b")), ["k"], "full")


@query("SELECT k, a, r FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS r FROM region) y")
def natural_join(spark, sf):
    t = Tables(spark, sf)
    return joins.natural(t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("a")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("r")))


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, sf):
    n = Tables(spark, sf).nation
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("""SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey GROUP BY r_name""")
def four_way_grouped_join(spark, sf):
    t = Tables(spark, sf)
    places = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    who = t.customer.join(joins.broadcast_if_small(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x""")
def lateral_top_two(spark, sf):
    t = Tables(spark, sf)
    return joins.lateral_top(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"], [order("o_totalprice", True), order("o_orderkey")], 2).select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, x.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) x ON true""")
def left_lateral(spark, sf):
    t = Tables(spark, sf)
    return joins.lateral_top(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"], [order("o_orderdate"), order("o_orderkey")], 1, outer=True).select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount = 0.05")
def salted_join(spark, sf):
    t = Tables(spark, sf)
    right = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return joins.salted(t.lineitem.where("l_discount = 0.05"), right, ["l_orderkey"], 4).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT c_custkey, k AS band FROM customer JOIN (SELECT unnest(range(10)) AS k) b ON c_acctbal >= k * 1000 AND c_acctbal < k * 1000 + 1500")
def range_join(spark, sf):
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 1000).cast("double").alias("lo"), (F.col("id") * 1000 + 1500).cast("double").alias("hi"))
    return joins.range_join(Tables(spark, sf).customer, bands, "c_acctbal", "lo", "hi", 1500).select("c_custkey", "band")


# --- aggregation -------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    return Tables(spark, sf).lineitem.where(F.col("l_shipdate") <= F.lit(dt.datetime(1998, 9, 2))).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_net()), 2).alias("sum_disc"), F.round(F.sum(_net() * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT l_suppkey) AS supps, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem WHERE l_quantity > 1000")
def global_aggregate_empty(spark, sf):
    return Tables(spark, sf).lineitem.where("l_quantity > 1000").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("supps"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query(f"SELECT nat, count(*) AS n, count(bal) AS with_bal, round(sum(bal), 2) AS total FROM {_NULLED} GROUP BY nat HAVING count(*) > 1")
def group_by_null_keys_having(spark, sf):
    return _nulled(spark, sf).groupBy("nat").agg(F.count("*").alias("n"), F.count("bal").alias("with_bal"), F.round(F.sum("bal"), 2).alias("total")).where("n > 1")


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n, CAST(grouping(n_regionkey, c_mktsegment) AS BIGINT) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def rollup_(spark, sf):
    t = Tables(spark, sf)
    rows = t.customer.join(joins.broadcast_if_small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_(spark, sf):
    return Tables(spark, sf).orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    src.register(spark, sf, "orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("""SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, count(*) FILTER (WHERE o_totalprice > 150000) AS big,
any_value(o_orderstatus) AS any_, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_totalprice > 400000) AS some_big FROM orders GROUP BY 1""")
def distinct_filter_bool(spark, sf):
    p = F.col("o_totalprice")
    return Tables(spark, sf).orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("custs"), F.sum_distinct("o_custkey").alias("s"), F.count(F.when(p > 150000, 1)).alias("big"), F.any_value("o_orderstatus").alias("any_"), F.bool_and(p > 0).alias("all_pos"), F.bool_or(p > 400000).alias("some_big"))


@query("SELECT l_returnflag, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x FROM lineitem GROUP BY 1")
def bit_aggregates(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(F.bit_and("l_partkey").alias("a"), F.bit_or("l_partkey").alias("o"), F.bit_xor("l_partkey").alias("x"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, array_agg(n_nationkey ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY 1")
def ordered_aggregates(spark, sf):
    names = F.array_join(arrays.ordered_agg(F.col("n_name"), F.col("n_name")), ", ")
    return Tables(spark, sf).nation.groupBy("n_regionkey").agg(names.alias("names"), arrays.ordered_agg(F.col("n_nationkey"), -F.col("n_nationkey")).alias("keys"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_extendedprice) / 1e6, 4) AS v, round(var_pop(l_discount), 8) AS vp,
round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY 1""")
def statistics(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.stddev_pop("l_quantity"), 6).alias("sdp"), F.round(F.var_samp("l_extendedprice") / 1e6, 4).alias("v"), F.round(F.var_pop("l_discount"), 8).alias("vp"), F.round(math.pg_corr(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("c"), F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("cp"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cs"))


@query("""SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx,
round(regr_syy(l_extendedprice, l_quantity) / 1e9, 4) AS syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e3, 2) AS sxy FROM lineitem GROUP BY 1""")
def regressions(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    f = lambda g, d, s=1: F.round(g(y, x) / s, d)
    return Tables(spark, sf).lineitem.groupBy("l_linestatus").agg(f(F.regr_slope, 4).alias("slope"), f(F.regr_intercept, 2).alias("icept"), f(F.regr_r2, 6).alias("r2"), F.regr_count(y, x).alias("n"), f(F.regr_avgx, 6).alias("ax"), f(F.regr_avgy, 2).alias("ay"), f(F.regr_sxx, 2).alias("sxx"), f(F.regr_syy, 4, 1e9).alias("syy"), f(F.regr_sxy, 2, 1e3).alias("sxy"))


@query("""SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med,
mode() WITHIN GROUP (ORDER BY l_linenumber) AS mode_ FROM lineitem GROUP BY 1""")
def ordered_set_aggregates(spark, sf):
    src.register(spark, sf, "lineitem")
    return spark.sql("""SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med,
        mode() WITHIN GROUP (ORDER BY l_linenumber) AS mode_ FROM lineitem GROUP BY 1""")


# --- windows ----------------------------------------------------------------------------


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS nt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w2 AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)""")
def ranking_windows(spark, sf):
    w, w2 = Window.partitionBy("o_custkey").orderBy(order("o_orderdate"), order("o_orderkey")), Window.partitionBy("o_orderstatus").orderBy(order("o_orderpriority"))
    return Tables(spark, sf).orders.select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w2).alias("rk"), F.dense_rank().over(w2).alias("dr"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.ntile(4).over(w).alias("nt"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS next2, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l,
nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def offset_windows(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(order("o_orderkey"))
    after = w.rowsBetween(0, Window.unboundedFollowing)
    return Tables(spark, sf).orders.select("o_orderkey", F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice", 2, -1.0).over(w).alias("next2"), F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(after).alias("l"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
count(*) OVER (PARTITION BY l_orderkey) AS n, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM lineitem""")
def aggregate_windows(spark, sf):
    part = Window.partitionBy("l_orderkey")
    w = part.orderBy(order("l_linenumber"))
    rows = part.orderBy(*map(order, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    q = F.col("l_quantity")
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", F.sum(q).over(w).alias("run"), F.sum(q).over(rows.rowsBetween(-1, 1)).alias("near"), F.count("*").over(part).alias("n"), F.round(q / F.sum(q).over(part), 6).alias("share"), F.max(q).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("m"))


# --- sort, limit, distinct -----------------------------------------------------------------


@query(f"SELECT c_custkey, bal FROM {_NULLED} ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 40 OFFSET 3")
def order_limit_offset(spark, sf):
    return ordering.top_k(_nulled(spark, sf), 40, "-bal", "c_custkey", offset=3).select("c_custkey", "bal")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def top_k(spark, sf):
    return ordering.top_k(Tables(spark, sf).lineitem, 25, "-l_extendedprice", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def select_distinct(spark, sf):
    return Tables(spark, sf).customer.select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf):
    return distinct.distinct_on(Tables(spark, sf).orders, ["o_custkey"], [order("o_totalprice", True), order("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# --- set operations -----------------------------------------------------------------------


def _sides(spark, sf):
    t = Tables(spark, sf)
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


@query(f"{_A} UNION {_B}")
def union_distinct(spark, sf):
    return setops.union(*_sides(spark, sf))


@query(f"{_A} UNION ALL {_B}")
def union_all(spark, sf):
    return setops.union(*_sides(spark, sf), all=True)


@query(f"{_A} INTERSECT {_B}")
def intersect_distinct(spark, sf):
    return setops.intersect(*_sides(spark, sf))


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(spark, sf):
    return setops.intersect(*_sides(spark, sf), all=True)


@query(f"{_A} EXCEPT {_B}")
def except_distinct(spark, sf):
    return setops.except_(*_sides(spark, sf))


@query(f"{_A} EXCEPT ALL {_B}")
def except_all(spark, sf):
    return setops.except_(*_sides(spark, sf), all=True)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS x FROM nation UNION SELECT s_acctbal FROM supplier")
def union_numeric_lift(spark, sf):
    t = Tables(spark, sf)
    return setops.union(t.nation.select(F.col("n_nationkey").alias("x")), t.supplier.select("s_acctbal"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION SELECT r_name FROM region")
def union_meets_as_text(spark, sf):
    t = Tables(spark, sf)
    return setops.union(t.nation.select(F.col("n_nationkey").alias("x")), t.region.select("r_name"))


# --- subqueries and CTEs --------------------------------------------------------------------


def _same(name: str, sql: str, *tables: str) -> None:
    """A query whose text both engines take."""

    def run(spark, sf):
        src.register(spark, sf, *tables)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


_same("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", "orders")
_same("correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", "customer", "orders")
_same("correlated_aggregate_filter", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.5 * avg(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)", "orders")
_same("derived_table", "SELECT flag, n FROM (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag) d WHERE n > 10", "lineitem")
_same("with_chain", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS custs FROM a GROUP BY n) SELECT n, custs FROM b WHERE n > 2", "orders")
_same("recursive_union_all", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT n, f FROM r")
_same("exists_under_or", "SELECT n_nationkey FROM nation n WHERE n_regionkey = 2 OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "nation", "supplier")
_same("grouped_expressions", "SELECT o_custkey % 10 AS d, count(*) * 2 + 1 AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey % 10", "orders")
_same("window_over_groups", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM orders GROUP BY o_custkey", "orders")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), r(b) AS (SELECT b FROM e WHERE a = 1 UNION SELECT e.b FROM r JOIN e ON e.a = r.b) SELECT b FROM r""")
def recursive_union_distinct(spark, sf):
    e = Tables(spark, sf).lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return recursion.recursive_union(e.where("a = 1").select("b"), lambda r: r.withColumnRenamed("b", "at").join(e, F.col("a") == F.col("at")).select("b"))


@query("SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')")
def view_and_in(spark, sf):
    t = Tables(spark, sf)
    t.region.where("r_name < 'B'").createOrReplaceTempView("ms_some_regions")
    src.register(spark, sf, "nation", "region")
    return spark.sql("SELECT n_name, (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM ms_some_regions)")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1 AND n_nationkey > 5")
def row_level_security(spark, sf):
    """Policies stand before every read of a declared table."""
    from ..sources.tables import Catalog

    catalog = Catalog(spark, f"{recursion._folder(spark)}/policies")
    catalog.create_as("ms_guarded", Tables(spark, sf).nation).policies.append(F.col("n_regionkey") == 1)
    return catalog.read("ms_guarded").where("n_nationkey > 5").select("n_nationkey", "n_regionkey")
