"""Text search, vectors, JSON filters, time series, data changes, streams and statistics as queries."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from ..functions import jsonb as j
from ..functions import text_search as ts
from ..operators import constraints, dml, recursion, timeseries, vector_search  # noqa: F401
from ..operators.ordering import order
from ..sources import copy as cp
from ..sources import inverted
from ..sources import tables as src
from ..streaming import windows as st
from .registry import Tables, query


# --- text search ------------------------------------------------------------------------


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])apache([^\\p{L}\\p{N}]|$)')""")
def text_filter(spark, sf):
    return Tables(spark, sf).documents.where(ts.text_matches(F.col("text"), "'apache' & 'license'", "words")).select("doc_id")


@query()
def text_rank_top(spark, sf):
    q = "'apach' & 'licens'"
    docs = Tables(spark, sf).documents.where(ts.text_matches(F.col("text"), q))
    return docs.select("doc_id", ts.ts_rank(ts.to_tsvector(F.col("text")), q).alias("rank")).orderBy(order("rank", True), order("doc_id")).limit(20)


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of([^\\p{L}\\p{N}]|$)')")
def text_index_search(spark, sf):
    """Over stored postings."""
    index = inverted.TextIndex(Tables(spark, sf).documents, "doc_id", "text", "words")
    return index.store(f"{recursion._folder(spark)}/postings").search("'the' & 'of'").select("doc_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_index_search(spark, sf):
    """Over stored postings."""
    index = inverted.JsonIndex(Tables(spark, sf).events, "event_id", "props")
    return index.store(f"{recursion._folder(spark)}/json-postings").search({"k": "7"}, j.jsonb_contains(F.col("props"), '{"k": 7}')).select("event_id")


@query()
def text_headline(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", ts.ts_headline(F.col("text"), "'the'", "MaxWords=12, MinWords=5", "simple").alias("h"))


# --- vectors ------------------------------------------------------------------------------


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 3)), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), 6) AS distance FROM embeddings
ORDER BY sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 3)), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), vec_id LIMIT 10""")
def exact_knn(spark, sf):
    e = Tables(spark, sf).embeddings
    q = list(e.where("vec_id = 3").first()["embedding"])
    return vector_search.knn(e, q, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def ivf_knn(spark, sf):
    e = Tables(spark, sf).embeddings
    q = list(e.where("vec_id = 3").first()["embedding"])
    return vector_search.IvfIndex(e, lists=16).search(q, 10, probes=8).select("vec_id", "distance")


# --- JSON ------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 3")
def json_containment_filter(spark, sf):
    return Tables(spark, sf).events.where(j.jsonb_contains(F.col("props"), '{"k": 3}')).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def json_flat_filter(spark, sf):
    """The same without Python, as a constant flat pattern allows."""
    return Tables(spark, sf).events.where(j.flat_text(F.col("props"), "k") == "3").select("event_id")


# --- time series --------------------------------------------------------------------------------


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY 1, 2""")
def time_buckets(spark, sf):
    rolled = timeseries.buckets(Tables(spark, sf).events, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top")])
    return rolled.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT event_id, ts FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-10'")
def time_window_read(spark, sf):
    rows = Tables(spark, sf).events.withColumn("series", F.col("user_id").cast("string"))
    return timeseries.window(rows, "series", "ts", "7", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10)).select("event_id", "ts")


@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark, sf):
    rows = st.sessions(Tables(spark, sf).events, "ts", "30 minutes", ["user_id"], [F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")])
    return rows.select("user_id", "first", "last", "n")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '5 days'")
def retention(spark, sf):
    e = Tables(spark, sf).events
    return timeseries.retained(e, "ts", dt.timedelta(days=5), e.agg(F.max("ts")).first()[0]).select("event_id")


@query("SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w, event_type FROM events) GROUP BY 1, 2")
def sliding_windows(spark, sf):
    rows = st.sliding(Tables(spark, sf).events, "ts", "1 hour", "30 minutes", ["event_type"], [F.count("*").alias("n")])
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT event_id FROM events WHERE CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL '1 day' END IS NULL OR ts + INTERVAL '1 day' > (SELECT max(ts) FROM events)")
def row_ttl(spark, sf):
    """What the expiry job leaves; rows without an expiry stay."""
    e = Tables(spark, sf).events
    rows = e.withColumn("expires", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL '1' DAY")))
    return timeseries.swept(rows, "expires", e.agg(F.max("ts")).first()[0]).select("event_id")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events) + INTERVAL '1 day' AND ts < (SELECT min(ts) FROM events) + INTERVAL '3 days'")
def sharded_window_read(spark, sf):
    """A window of one series of a table that is laid out by day and shard."""
    e = Tables(spark, sf).events
    path = f"{recursion._folder(spark)}/series"
    timeseries.write(e, path, "event_type", "ts", shards=4)
    first = e.agg(F.min("ts")).first()[0]
    rows = timeseries.window(spark.read.parquet(path), "event_type", "ts", "click", first + dt.timedelta(days=1), first + dt.timedelta(days=3), shards=4)
    return rows.select("event_id", "value")


@query("SELECT event_type, count(*) AS n, sum(event_id) AS s FROM events GROUP BY 1")
def sharded_scan(spark, sf):
    """All shards of a table, fanned out and gathered."""
    path = f"{recursion._folder(spark)}/shards"
    timeseries.write(Tables(spark, sf).events, path, "user_id", "ts", shards=4)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@query("SELECT * FROM (VALUES ('ms_nation', 'n_nationkey', 1, 'int'), ('ms_nation', 'n_name', 2, 'string'), ('ms_nation', 'n_regionkey', 3, 'int')) t(table_name, column_name, ordinal_position, data_type)")
def catalog_columns(spark, sf):
    catalog = src.Catalog(spark, f"{recursion._folder(spark)}/catalog")
    catalog.create_as("ms_nation", Tables(spark, sf).nation)
    return catalog.information_schema_columns().select("table_name", "column_name", "ordinal_position", "data_type")


@query("SELECT s_suppkey, s_name FROM supplier")
def as_of_system_time(spark, sf):
    """The state before a table was emptied."""
    catalog = src.Catalog(spark, f"{recursion._folder(spark)}/history")
    catalog.create_as("ms_supplier", Tables(spark, sf).supplier.select("s_suppkey", "s_name"))
    full = dt.datetime.now(dt.UTC)
    catalog.replace("ms_supplier", dml.truncate(catalog.read("ms_supplier")).table)
    return catalog.read("ms_supplier", full)


# --- data changes ------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_(spark, sf):
    return dml.update(Tables(spark, sf).supplier, {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0).table.select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN s_name || '-' || n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def update_from(spark, sf):
    t = Tables(spark, sf)
    source = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return dml.update_from(t.supplier, source, ["s_nationkey"], {"s_name": F.concat(F.col("t.s_name"), F.lit("-"), F.col("s.n_name"))}).table.select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_using(spark, sf):
    t = Tables(spark, sf)
    return dml.delete_using(t.orders, t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey")).table.select("o_orderkey")


@query("SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 2) THEN 'NEW' || r_regionkey ELSE r_name END AS r_name FROM region UNION ALL SELECT 100, 'NEW100'")
def upsert_(spark, sf):
    rows = spark.createDataFrame([(1, "NEW1"), (2, "NEW2"), (100, "NEW100")], "r_regionkey int, r_name string")
    return dml.upsert(Tables(spark, sf).region, rows, ["r_regionkey"]).table


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'X'")
def insert_ignore(spark, sf):
    rows = spark.createDataFrame([(1, "ignored"), (100, "X")], "r_regionkey int, r_name string")
    return dml.insert_ignore(Tables(spark, sf).region, rows, ["r_regionkey"]).table


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def foreign_key_check(spark, sf):
    t = Tables(spark, sf)
    return constraints.foreign_key(t.orders, ["o_custkey"], t.customer.where("c_acctbal >= 0"), ["c_custkey"]).select("o_orderkey")


# --- copies and statistics ------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def copy_round_trip(spark, sf):
    """COPY TO and COPY FROM CSV of the whole table; the files lie in the shared folder where the session names one."""
    rows = Tables(spark, sf).customer.select("c_custkey", "c_name", "c_acctbal")
    path = recursion._folder(spark) + "/copy"
    cp.copy_to(rows, path, header=True)
    return cp.copy_from(spark, path, rows.schema, header=True)


@query("""SELECT 'c_nationkey' AS column_name, count(*) AS row_count, count(*) - count(c_nationkey) AS null_count FROM customer UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name) FROM customer""")
def analyze(spark, sf):
    return src.statistics(Tables(spark, sf).customer.select("c_nationkey", "c_name")).select("column_name", "row_count", "null_count")


# --- streams -----------------------------------------------------------------------------------------------


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    """The same aggregation as a stream, run to the end of what is there."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = st.read(spark, f"{sf}/events.parquet*", schema)
    rolled = st.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
    name = "ms_stream_" + tempfile.mktemp(prefix="", dir="").strip("/").replace("-", "_")
    return st.run_to_end(rolled, name, mode="complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


# --- the SQL front end -----------------------------------------------------------------------------------


def _dialect(name: str, text: str, oracle: str, *tables: str) -> None:
    def run(spark, sf):
        from .engine import Engine

        return Engine(spark).register(sf, *tables).sql(text)

    run.__name__ = name
    query(oracle)(run)


_dialect("dialect_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "orders")
_dialect("dialect_casts_and_regex", "SELECT p_partkey, p_size::text AS t, (p_retailprice * 2)::int8 AS i, p_name ~ '^[a-m]' AS r, p_name !~* 'X' AS n FROM part WHERE p_size BETWEEN SYMMETRIC 30 AND 10", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, CAST(trunc(p_retailprice * 2) AS BIGINT) AS i, regexp_matches(p_name, '^[a-m]') AS r, NOT regexp_matches(p_name, 'X', 'i') AS n FROM part WHERE p_size BETWEEN 10 AND 30", "part")
_dialect("dialect_any_fetch_similar", "SELECT p_partkey FROM part WHERE p_size = ANY(ARRAY[1, 5, 9]) AND p_name SIMILAR TO '%(a|e)%' ORDER BY p_partkey FETCH FIRST 20 ROWS ONLY", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND regexp_matches(p_name, 'a|e') ORDER BY p_partkey LIMIT 20", "part")
_dialect("dialect_null_order", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY nullif(c_nationkey, 3) DESC, c_custkey LIMIT 30", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, c_custkey LIMIT 30", "customer")
_dialect("dialect_json_arrow", "SELECT event_id, props ->> 'k' AS k FROM events WHERE (props ->> 'k')::int8 > 50", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50", "events")
