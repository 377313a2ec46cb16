"""Scalar functions, in groups, over columns of the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import conditionals as c
from ..functions import dates as d
from ..functions import jsonb as j
from ..functions import math as m
from ..functions import strings as s
from ..functions import vectors as v
from ..functions.registry import FUNCTIONS
from .registry import Tables, query


@query("""SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_custkey, c_nationkey * 10) AS g, least(c_acctbal, 100.0) AS l FROM customer""")
def functions_conditionals(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", c.coalesce(c.nullif(F.col("c_mktsegment"), "BUILDING"), "none").alias("seg"), c.greatest(F.col("c_custkey"), F.col("c_nationkey") * 10).alias("g"), c.least(F.col("c_acctbal"), 100.0).alias("l"))


@query("""SELECT p_partkey, CAST(ascii(p_name) AS BIGINT) AS asc_, CAST(bit_length(p_name) AS BIGINT) AS bits, CAST(strlen(p_name) AS BIGINT) AS octets, length(p_name) AS len, lower(p_brand) AS low, upper(p_name) AS up,
chr(65 + p_size % 26) AS ch, concat(p_name, NULL, p_brand) AS cc, concat_ws('/', p_brand, NULL, p_type) AS cw, left(p_name, 3) AS l3, left(p_name, -2) AS lm, right(p_name, 3) AS r3, right(p_name, -2) AS rm,
lpad(p_brand, 14, '*') AS lp, rpad(p_brand, 14, '*') AS rp FROM part""")
def functions_strings_basic(spark, sf):
    n, b = F.col("p_name"), F.col("p_brand")
    return Tables(spark, sf).part.select("p_partkey", s.ascii_(n).alias("asc_"), s.bit_length(n).alias("bits"), s.octet_length(n).alias("octets"), s.length(n).alias("len"), s.lower(b).alias("low"), s.upper(n).alias("up"), s.chr_(65 + F.col("p_size") % 26).alias("ch"),
        s.concat(n, F.lit(None), b).alias("cc"), s.concat_ws("/", b, F.lit(None), F.col("p_type")).alias("cw"), s.left(n, 3).alias("l3"), s.left(n, -2).alias("lm"), s.right(n, 3).alias("r3"), s.right(n, -2).alias("rm"), s.lpad(b, 14, "*").alias("lp"), s.rpad(b, 14, "*").alias("rp"))


@query("""SELECT p_partkey, ltrim(p_brand, 'BrZ') AS lt, rtrim(p_brand, '0123456789') AS rt, trim('  ' || p_name || ' ') AS tr, repeat(p_brand, 2) AS rep, replace(p_name, 'a', 'AA') AS repl, reverse(p_name) AS rev,
split_part(p_type, ' ', 1) AS sp, split_part(p_type, ' ', -1) AS spl, starts_with(p_type, 'S') AS sw, substring(p_name, 2, 3) AS sub, translate(p_name, 'abc', 'xyz') AS tra, CAST(instr(p_name, 'e') AS BIGINT) AS pos,
md5(p_name) AS m5, sha256(p_name) AS sh, lower(to_hex(p_partkey)) AS hx, p_name[1:1] || '##' || p_name[4:] AS ov FROM part""")
def functions_strings_more(spark, sf):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return Tables(spark, sf).part.select("p_partkey", s.ltrim(b, "BrZ").alias("lt"), s.rtrim(b, "0123456789").alias("rt"), s.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), s.repeat(b, 2).alias("rep"), s.replace(n, "a", "AA").alias("repl"), s.reverse(n).alias("rev"),
        s.split_part(t, " ", 1).alias("sp"), s.split_part(t, " ", -1).alias("spl"), s.starts_with(t, "S").alias("sw"), s.substring(n, 2, 3).alias("sub"), s.translate(n, "abc", "xyz").alias("tra"), s.position("e", n).alias("pos"),
        s.md5(n).alias("m5"), F.lower(F.hex(FUNCTIONS["sha256"](n))).alias("sh"), s.to_hex(F.col("p_partkey")).alias("hx"), s.overlay(n, "##", 2, 2).alias("ov"))


@query("""SELECT p_partkey, regexp_matches(p_type, '[A-Z]+') AS li, len(regexp_extract_all(p_name, '[aeiou]')) AS cnt, regexp_replace(p_name, '[aeiou]', '_') AS r1, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rg,
regexp_replace(p_brand, '([A-Z])([a-z]+)', '\\2-\\1') AS rb, string_split_regex(p_type, '\\s+') AS sp, nullif(regexp_extract(p_name, '[a-m]+', 0), '') AS sb, lower(hex(encode(p_name))) AS hx, to_base64(encode(p_name)) AS b64 FROM part""")
def functions_regex_and_bytes(spark, sf):
    n, t = F.col("p_name"), F.col("p_type")
    return Tables(spark, sf).part.select("p_partkey", s.regexp_like(t, "[A-Z]+").alias("li"), s.regexp_count(n, "[aeiou]").alias("cnt"), s.regexp_replace(n, "[aeiou]", "_").alias("r1"), s.regexp_replace(n, "[aeiou]", "_", "g").alias("rg"),
        s.regexp_replace(F.col("p_brand"), "([A-Z])([a-z]+)", r"\2-\1").alias("rb"), s.regexp_split_to_array(t, r"\s+").alias("sp"), s.regexp_substr(n, "[a-m]+").alias("sb"), s.encode(n, "hex").alias("hx"), s.encode(n, "base64").alias("b64"))


@query("""SELECT c_custkey, abs(c_acctbal) AS ab, CAST(sign(c_acctbal) AS BIGINT) AS sg, ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, round(c_acctbal, 1) AS ro, trunc(c_acctbal) AS tr, round(sqrt(abs(c_acctbal)), 8) AS sq, round(cbrt(c_acctbal), 8) AS cb,
round(exp(c_nationkey / 10), 8) AS ex, round(ln(c_custkey + 1), 10) AS l, round(log10(c_custkey + 1), 10) AS l10, round(power(c_nationkey, 1.5), 6) AS pw, gcd(c_custkey, 84) AS gc, lcm(c_custkey, 6) AS lc, c_custkey % 7 AS mo, c_custkey // 7 AS di FROM customer""")
def functions_math(spark, sf):
    b, k, n = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    return Tables(spark, sf).customer.select("c_custkey", m.abs_(b).alias("ab"), m.sign(b).alias("sg"), m.ceil(b).alias("ce"), m.floor(b).alias("fl"), m.round_(b, 1).alias("ro"), m.trunc(b).alias("tr"), F.round(m.sqrt(F.abs(b)), 8).alias("sq"), F.round(FUNCTIONS["cbrt"](b), 8).alias("cb"),
        F.round(FUNCTIONS["exp"](n / 10), 8).alias("ex"), F.round(m.ln(k + 1), 10).alias("l"), F.round(m.log(k + 1), 10).alias("l10"), F.round(m.power(n, 1.5), 6).alias("pw"), m.gcd(k, 84).alias("gc"), m.lcm(k, 6).alias("lc"), m.mod(k, 7).alias("mo"), m.div(k, 7).alias("di"))


@query("""SELECT n_nationkey, round(sin(n_nationkey), 10) AS si, round(cos(n_nationkey), 10) AS co, round(tan(n_nationkey), 8) AS ta, round(asin(n_nationkey / 25), 10) AS asi, round(acos(n_nationkey / 25), 10) AS aco, round(atan(n_nationkey), 10) AS ata,
round(atan2(n_nationkey, 3), 10) AS at2, round(degrees(n_nationkey), 8) AS de, round(radians(n_nationkey), 10) AS ra, round(sinh(n_nationkey / 10), 9) AS sh, round(cosh(n_nationkey / 10), 9) AS ch, round(tanh(n_nationkey / 10), 10) AS th, round(pi(), 12) AS p,
factorial(n_nationkey % 15) AS fa FROM nation""")
def functions_trigonometry(spark, sf):
    x = F.col("n_nationkey")
    g = lambda f, y, n=10: F.round(FUNCTIONS[f](y), n)
    return Tables(spark, sf).nation.select("n_nationkey", g("sin", x).alias("si"), g("cos", x).alias("co"), g("tan", x, 8).alias("ta"), g("asin", x / 25).alias("asi"), g("acos", x / 25).alias("aco"), g("atan", x).alias("ata"), F.round(m.atan2(x, 3), 10).alias("at2"),
        g("degrees", x, 8).alias("de"), g("radians", x).alias("ra"), g("sinh", x / 10, 9).alias("sh"), g("cosh", x / 10, 9).alias("ch"), g("tanh", x / 10).alias("th"), F.round(m.pi(), 12).alias("p"), m.factorial(x % 15).alias("fa"))


@query("""SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS de, CAST(extract(dow FROM o_orderdate) AS DOUBLE) AS dow, CAST(extract(isodow FROM o_orderdate) AS DOUBLE) AS iso,
CAST(extract(doy FROM o_orderdate) AS DOUBLE) AS doy, CAST(extract(week FROM o_orderdate) AS DOUBLE) AS wk, CAST(extract(epoch FROM o_orderdate) AS DOUBLE) AS ep, CAST(extract(century FROM o_orderdate) AS DOUBLE) AS ce, CAST(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
make_date(year(o_orderdate), 1, 1) AS ny, o_orderdate + INTERVAL '1 month 3 days 2 hours' AS later, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS txt FROM orders""")
def functions_dates(spark, sf):
    t = F.col("o_orderdate")
    x = lambda f: d.extract(f, t)
    return Tables(spark, sf).orders.select("o_orderkey", d.date_trunc("quarter", t).cast("timestamp_ntz").alias("q"), d.date_trunc("decade", t).cast("timestamp_ntz").alias("de"), x("dow").alias("dow"), x("isodow").alias("iso"), x("doy").alias("doy"), x("week").alias("wk"), x("epoch").alias("ep"), x("century").alias("ce"),
        d.date_minus(t.cast("date"), F.lit(dt.date(1995, 6, 17))).alias("days"), d.make_date(F.year(t), 1, 1).alias("ny"), d.add_interval(t, d.make_interval(months=1, days=3, hours=2)).cast("timestamp_ntz").alias("later"), d.to_char(t, "YYYY-MM-DD HH24:MI:SS").alias("txt"))


_ARRAYS = "(SELECT n_regionkey AS r, list(n_nationkey ORDER BY n_nationkey) AS x FROM nation GROUP BY 1)"


@query(f"""SELECT r, len(x) AS n, CAST(list_position(x, 7) AS BIGINT) AS pos, list_append(x, 99) AS ap, list_prepend(0, x) AS pr, x || [1, 2] AS cat, list_reverse(x) AS rev, list_filter(x, lambda e: e <> 7) AS rem, list_transform(x, lambda e: CASE WHEN e = 7 THEN 70 ELSE e END) AS repl,
array_to_string(x, '-') AS txt, x[2] AS second, list_has_all(x, [7]) AS has, list_has_any(x, [1, 2, 3]) AS ov, list_reverse_sort(x) AS de, x[1:len(x)-2] AS tr, string_split('a,b,,c', ',') AS sp FROM {_ARRAYS}""")
def functions_arrays(spark, sf):
    x = F.col("x")
    rows = Tables(spark, sf).nation.groupBy(F.col("n_regionkey").alias("r")).agg(a.ordered_agg(F.col("n_nationkey"), F.col("n_nationkey")).alias("x"))
    return rows.select("r", a.array_length(x).alias("n"), a.array_position(x, 7).alias("pos"), a.array_append(x, 99).alias("ap"), a.array_prepend(0, x).alias("pr"), a.array_cat(x, F.array(F.lit(1), F.lit(2))).alias("cat"), a.array_reverse(x).alias("rev"), a.array_remove(x, 7).alias("rem"), a.array_replace(x, 7, 70).alias("repl"),
        a.array_to_string(x, "-").alias("txt"), a.subscript(x, 2).alias("second"), a.contains(x, F.array(F.lit(7))).alias("has"), a.overlaps(x, F.array(*map(F.lit, (1, 2, 3)))).alias("ov"), a.array_sort(x, True).alias("de"), a.trim_array(x, 2).alias("tr"), a.string_to_array(F.lit("a,b,,c"), ",").alias("sp"))


@query(f"SELECT r, i, e FROM (SELECT r, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM {_ARRAYS})")
def unnest_with_ordinality(spark, sf):
    rows = Tables(spark, sf).nation.groupBy(F.col("n_regionkey").alias("r")).agg(a.ordered_agg(F.col("n_nationkey"), F.col("n_nationkey")).alias("x"))
    return rows.select("r", F.posexplode("x").alias("i", "e")).select("r", (F.col("i") + 1).cast("bigint").alias("i"), "e")


@query("SELECT g AS n, CAST(h AS TIMESTAMP) AS h FROM generate_series(1, 10, 3) a(g), generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-02', INTERVAL '8 hours') b(h)")
def generate_series_(spark, sf):
    n = spark.range(1).select(a.generate_series(1, 10, 3).alias("n"))
    h = n.select("n", a.generate_series(F.lit(dt.datetime(2020, 1, 1)), F.lit(dt.datetime(2020, 1, 2)), F.expr("INTERVAL '8' HOUR")).alias("h"))
    return h.select(F.col("n").cast("bigint").alias("n"), F.col("h").cast("timestamp_ntz").alias("h"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) = 'OBJECT' AS is_obj, len(json_keys(props)) AS n, json_extract_string(props, '$.nope') AS no FROM events""")
def functions_json(spark, sf):
    p = F.col("props")
    return Tables(spark, sf).events.select("event_id", j.flat_text(p, "k").alias("k"), (j.jsonb_typeof(p) == "object").alias("is_obj"), F.size(F.json_object_keys(p)).cast("bigint").alias("n"), j.get_text(p, "nope").alias("no"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), 6) AS l2,
round(list_sum(list_transform(list_zip(embedding, q), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))), 6) AS l1, round(list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS ip,
len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * e))), 6) AS norm FROM embeddings, q""")
def functions_vectors(spark, sf):
    e = Tables(spark, sf).embeddings
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    x = F.col("embedding")
    return e.select("vec_id", F.round(v.l2_distance(x, q), 6).alias("l2"), F.round(v.l1_distance(x, q), 6).alias("l1"), F.round(v.inner_product(x, q), 6).alias("ip"), v.vector_dims(x).alias("dims"), F.round(v.vector_norm(x), 6).alias("norm"))


@query("SELECT l_returnflag, round_even(CAST(sum(CAST(l_partkey AS BIGINT)) AS DECIMAL(38, 12)) / count(*), 6) AS a FROM lineitem GROUP BY 1")
def decimal_average(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(m.pg_avg(F.col("l_partkey")).alias("a"))
