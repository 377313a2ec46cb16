"""The SQL front end: operators over the tables, and functions against documented values."""

from __future__ import annotations

import hashlib
import uuid

from .registry import query


def dialect(name: str, text: str, oracle: str, *tables: str) -> None:
    def run(spark, sf):
        from .engine import Engine

        return Engine(spark).register(sf, *tables).sql(text)

    run.__name__ = name
    query(oracle)(run)


def documented(name: str, *items: tuple[str, str, str | None]) -> None:
    """One row; items: column, expression, its value as text."""
    value = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    dialect(name, "SELECT " + ", ".join(f"({e})::text AS {n}" for n, e, _ in items), "SELECT " + ", ".join(f"{value(x)} AS {n}" for n, _, x in items))


# --- operators over tables -----------------------------------------------------------

dialect("sql_integer_division", "SELECT o_orderkey, o_custkey / 7 AS q, (o_custkey + 3) / 2 * 2 AS h, o_totalprice / 2 AS f, 7 / 2 AS c FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, (o_custkey + 3) // 2 * 2 AS h, o_totalprice / 2 AS f, 7 // 2 AS c FROM orders", "orders")
dialect("sql_power_and_roots", "SELECT c_custkey, c_nationkey ^ 2 AS p, round((|/ c_custkey)::numeric(20, 8), 6)::double precision AS r, @ c_acctbal AS a, c_custkey # 5 AS x FROM customer", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) ** 2 AS p, CAST(round(CAST(sqrt(c_custkey) AS DECIMAL(20, 8)), 6) AS DOUBLE) AS r, abs(c_acctbal) AS a, xor(c_custkey, 5) AS x FROM customer", "customer")
dialect("sql_subscripts", "SELECT p_partkey, (string_to_array(p_type, ' '))[1] AS first, (ARRAY[p_size, 10, 20])[3] AS third, (ARRAY[1, 2])[5] AS none FROM part", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, 20 AS third, CAST(NULL AS INT) AS none FROM part", "part")
dialect("sql_array_operators", "SELECT p_partkey FROM part WHERE ARRAY[1, 2, 3, 5] @> ARRAY[p_size % 7] AND ARRAY[p_size] && ARRAY[1, 8, 9, 10, 15, 22, 29]", "SELECT p_partkey FROM part WHERE p_size % 7 IN (1, 2, 3, 5) AND p_size IN (1, 8, 9, 10, 15, 22, 29)", "part")
dialect("sql_json_operators", "SELECT event_id, props -> 'k' AS j, props ->> 'k' AS t, props #>> '{k}' AS p, props ? 'k' AS e, props ?| ARRAY['x', 'k'] AS any_, props ?& ARRAY['x', 'k'] AS all_, jsonb_typeof(props) AS ty, props['k'] AS s FROM events", "SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS j, props ->> '$.k' AS t, props ->> '$.k' AS p, json_exists(props, '$.k') AS e, json_exists(props, '$.k') AS any_, false AS all_, lower(json_type(props)) AS ty, CAST(props -> '$.k' AS VARCHAR) AS s FROM events", "events")
dialect("sql_json_containment", """SELECT event_id FROM events WHERE props @> '{"k": 7}' OR '{"k": 9, "z": 1}'::jsonb @> props""", "SELECT event_id FROM events WHERE props ->> '$.k' IN ('7', '9')", "events")
dialect("sql_json_edits", "SELECT n_nationkey, jsonb_set('{\"a\":{\"b\":1}}', '{a,b}', (n_nationkey::text)::jsonb) AS s, '{\"a\":{\"b\":1,\"c\":2}}' #- '{a,b}' AS d FROM nation", "SELECT n_nationkey, '{\"a\":{\"b\":' || n_nationkey || '}}' AS s, '{\"a\":{\"c\":2}}' AS d FROM nation", "nation")
dialect("sql_ordered_array_agg", "SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_nationkey DESC) AS d, array_agg(nullif(n_nationkey, 3) ORDER BY n_nationkey) AS n, array_agg(n_nationkey ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 10) AS f, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey DESC) AS d, list(nullif(n_nationkey, 3) ORDER BY n_nationkey) AS n, list(n_nationkey ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 10) AS f, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey", "nation")
dialect("sql_json_aggregates", "SELECT x, jsonb_agg(y) AS a, jsonb_agg_strict(y) AS s, jsonb_object_agg(k, y) AS o, jsonb_object_agg_strict(k, y) AS os FROM (SELECT n_regionkey AS x, n_name AS k, nullif(n_regionkey, 2) AS y FROM nation WHERE n_nationkey = n_regionkey) t GROUP BY x", "SELECT n_regionkey AS x, '[' || coalesce(CAST(y AS VARCHAR), 'null') || ']' AS a, CASE WHEN y IS NULL THEN '[]' ELSE '[' || y || ']' END AS s, '{\"' || n_name || '\":' || coalesce(CAST(y AS VARCHAR), 'null') || '}' AS o, CASE WHEN y IS NULL THEN '{}' ELSE '{\"' || n_name || '\":' || y || '}' END AS os FROM (SELECT *, nullif(n_regionkey, 2) AS y FROM nation WHERE n_nationkey = n_regionkey)", "nation")
dialect("sql_text_match", "SELECT doc_id FROM documents WHERE to_tsvector('english', text) @@ to_tsquery('english', 'license & (apache | copyright)')", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}])licens(e|es|ed|ing)([^\\p{L}\\p{N}]|$)', 'i') AND regexp_matches(text, '(^|[^\\p{L}\\p{N}])(apaches?|copyright(s|ed|ing)?)([^\\p{L}\\p{N}]|$)', 'i')", "documents")
dialect("sql_vector_distance", "SELECT vec_id, round((embedding <-> ARRAY[" + ", ".join(["0.5"] * 64) + "])::numeric(20, 10), 5)::double precision AS d FROM embeddings", "SELECT vec_id, CAST(round(CAST(sqrt(list_sum(list_transform(embedding, lambda e: (CAST(e AS DOUBLE) - 0.5) * (CAST(e AS DOUBLE) - 0.5)))) AS DECIMAL(20, 10)), 5) AS DOUBLE) AS d FROM embeddings", "embeddings")
dialect("sql_library_strings", "SELECT p_partkey, initcap(p_type) AS i, left(p_name, -2) AS l, split_part(p_type, ' ', 2) AS s, position('a' IN p_name) AS p, substring(p_name FROM 2 FOR 3) AS u, format('%s-%s', p_brand, p_size) AS f, quote_literal(p_name) AS q, starts_with(p_type, 'S') AS w FROM part", "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS i, left(p_name, -2) AS l, split_part(p_type, ' ', 2) AS s, CAST(instr(p_name, 'a') AS BIGINT) AS p, substring(p_name, 2, 3) AS u, p_brand || '-' || p_size AS f, '''' || p_name || '''' AS q, starts_with(p_type, 'S') AS w FROM part", "part")
dialect("sql_library_dates", "SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD') AS c, extract(doy FROM o_orderdate) AS d, date_trunc('month', o_orderdate)::timestamp_ntz AS m, to_date(to_char(o_orderdate, 'DD Mon YYYY'), 'DD Mon YYYY') AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS c, CAST(extract(doy FROM o_orderdate) AS DOUBLE) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(o_orderdate AS DATE) AS t FROM orders", "orders")
dialect("sql_hyperbolic", "SELECT n_nationkey, round(asinh(n_nationkey)::numeric(20, 12), 9)::double precision AS s, round(acosh(n_nationkey + 1)::numeric(20, 12), 9)::double precision AS c, round(atanh(n_nationkey::float8 / 26)::numeric(20, 12), 9)::double precision AS t, round(cot(n_nationkey + 1)::numeric(20, 12), 9)::double precision AS o, round(asind(n_nationkey::float8 / 25)::numeric(20, 12), 9)::double precision AS sd, round(atan2d(n_nationkey, 3)::numeric(20, 12), 9)::double precision AS ad, round(sind(n_nationkey)::numeric(20, 12), 9)::double precision AS si FROM nation",
        "SELECT n_nationkey, CAST(round(CAST(asinh(n_nationkey) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS s, CAST(round(CAST(acosh(n_nationkey + 1) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS c, CAST(round(CAST(atanh(n_nationkey / 26.0) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS t, CAST(round(CAST(cot(n_nationkey + 1) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS o, CAST(round(CAST(degrees(asin(n_nationkey / 25.0)) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS sd, CAST(round(CAST(degrees(atan2(n_nationkey, 3)) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS ad, CAST(round(CAST(sin(radians(n_nationkey)) AS DECIMAL(20, 12)), 9) AS DOUBLE) AS si FROM nation", "nation")



dialect("sql_named_windows", "SELECT o_orderkey, rank() OVER w AS r, count(*) OVER p AS n FROM orders WINDOW p AS (PARTITION BY o_custkey), w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", "SELECT o_orderkey, rank() OVER w AS r, count(*) OVER p AS n FROM orders WINDOW p AS (PARTITION BY o_custkey), w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", "orders")
dialect("sql_correlated_having", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT count(*) FROM region WHERE r_regionkey <= 4) ORDER BY (SELECT max(r_name) FROM region)", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT count(*) FROM region WHERE r_regionkey <= 4)", "nation", "region")
dialect("sql_any_subquery", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 2)", "nation", "region")

# --- statements that change tables ----------------------------------------------------------


def changes(name: str, oracle: str, *texts: str, tables: tuple[str, ...]) -> None:
    """Statements one after another over declared copies of tables; the last one's rows are the result."""

    def run(spark, sf):
        from ..operators import recursion
        from .engine import Engine

        engine = Engine(spark, f"{recursion._folder(spark)}/statements-{uuid.uuid4().hex[:12]}").register(sf, *tables)
        for text in texts[:-1]:
            engine.sql(text)
        return engine.sql(texts[-1])

    run.__name__ = name
    query(oracle)(run)


_SUPPLIERS = "CREATE TABLE ms_s (s_suppkey bigint PRIMARY KEY, s_name text, s_nationkey int, s_acctbal double precision DEFAULT 0.0 CHECK (s_acctbal > -100000))"
_FILL = "INSERT INTO ms_s SELECT * FROM supplier"
changes("sql_insert_defaults", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT -1, 'new', NULL, 0.0", _SUPPLIERS, _FILL, "INSERT INTO ms_s (s_suppkey, s_name) VALUES (-1, 'new')", "SELECT * FROM ms_s", tables=("supplier",))
changes("sql_insert_returning", "SELECT s_suppkey * 2 AS k, s_name AS n FROM supplier", _SUPPLIERS, "INSERT INTO ms_s SELECT * FROM supplier RETURNING s_suppkey * 2 AS k, s_name AS n", tables=("supplier",))
changes("sql_update_returning", "SELECT s_suppkey, s_acctbal + 1 AS b FROM supplier WHERE s_nationkey < 10", _SUPPLIERS, _FILL, "UPDATE ms_s SET s_acctbal = s_acctbal + 1 WHERE s_nationkey < 10 RETURNING s_suppkey, s_acctbal AS b", tables=("supplier",))
changes("sql_update_from", "SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN s_name || '-' || n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", _SUPPLIERS, _FILL, "UPDATE ms_s SET s_name = s_name || '-' || n_name FROM nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2", "SELECT s_suppkey, s_name FROM ms_s", tables=("supplier", "nation"))
changes("sql_delete_using", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1", _SUPPLIERS, _FILL, "DELETE FROM ms_s USING nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1", "SELECT s_suppkey FROM ms_s", tables=("supplier", "nation"))
changes("sql_on_conflict", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_acctbal + 10 ELSE s_acctbal END AS b FROM supplier", _SUPPLIERS, _FILL, "INSERT INTO ms_s SELECT s_suppkey, 'x', 1, 10.0 FROM supplier WHERE s_nationkey < 5 ON CONFLICT (s_suppkey) DO UPDATE SET s_acctbal = s_acctbal + excluded.s_acctbal", "INSERT INTO ms_s SELECT * FROM supplier ON CONFLICT DO NOTHING", "SELECT s_suppkey, s_acctbal AS b FROM ms_s", tables=("supplier",))
changes("sql_upsert", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'x' ELSE s_name END AS s_name, s_acctbal FROM supplier", _SUPPLIERS, _FILL, "UPSERT INTO ms_s (s_suppkey, s_name) SELECT s_suppkey, 'x' FROM supplier WHERE s_nationkey < 5", "SELECT s_suppkey, s_name, s_acctbal FROM ms_s", tables=("supplier",))
changes("sql_truncate", "SELECT CAST(0 AS BIGINT) AS n", _SUPPLIERS, _FILL, "TRUNCATE ms_s", "SELECT count(*) AS n FROM ms_s", tables=("supplier",))
changes("sql_create_table_as", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1", "CREATE TABLE ms_c AS SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey", "CREATE TABLE ms_none AS SELECT * FROM ms_c WITH NO DATA", "SELECT * FROM ms_c UNION ALL SELECT * FROM ms_none", tables=("supplier",))

# --- documented values -------------------------------------------------------------------

_sha = {n: hashlib.new(n, b"abc").hexdigest() for n in ("sha224", "sha384", "sha512")}
documented("sql_strings",
    ("convert_", "encode(convert('é'::bytea, 'UTF8', 'LATIN1'), 'hex')", "e9"), ("convert_from_", "convert_from('abc'::bytea, 'UTF8')", "abc"), ("convert_to_", "encode(convert_to('é', 'LATIN1'), 'hex')", "e9"),
    ("crc32_", "crc32('The quick brown fox jumps over the lazy dog'::bytea)", "1095738169"), ("crc32c_", "crc32c('123456789'::bytea)", "3808858755"), ("decode_", "encode(decode('616263', 'hex'), 'escape')", "abc"),
    ("format_", "format('Hello %s, %1$s', 'World')", "Hello World, World"), ("get_bit_", "get_bit(decode('1234567890', 'hex'), 30)", "1"), ("get_byte_", "get_byte(decode('1234567890', 'hex'), 4)", "144"),
    ("set_bit_", "encode(set_bit(decode('1234567890', 'hex'), 30, 0), 'hex')", "1234563890"), ("set_byte_", "encode(set_byte(decode('1234567890', 'hex'), 4, 64), 'hex')", "1234567840"), ("initcap_", "initcap('hi THOMAS')", "Hi Thomas"),
    ("is_normalized_", "is_normalized('abc')", "true"), ("normalize_", "length(normalize('a' || chr(776)))", "1"), ("parse_ident_", "array_to_string(parse_ident('\"SomeSchema\".someTable'), '|')", "SomeSchema|sometable"),
    ("quote_literal_", "quote_literal('O''Reilly')", "'O''Reilly'"), ("quote_nullable_", "quote_nullable(NULL)", "NULL"), ("regexp_instr_", "regexp_instr('ABCDEF', 'c(.)(..)', 1, 1, 0, 'i')", "3"),
    ("regexp_match_", "array_to_string(regexp_match('foobarbequebaz', '(bar)(beque)'), '|')", "bar|beque"), ("regexp_matches_", "array_to_string(flatten(regexp_matches('foobarbequebazilbarfbonk', '(b[^b]+)(b[^b]+)', 'g')), '|')", "bar|beque|bazil|barf"),
    ("sha224_", "encode(sha224('abc'), 'hex')", _sha["sha224"]), ("sha384_", "encode(sha384('abc'), 'hex')", _sha["sha384"]), ("sha512_", "encode(sha512('abc'), 'hex')", _sha["sha512"]),
    ("to_ascii_", "to_ascii('Karél')", "Karel"), ("unistr_", "unistr('d\\0061t\\+000061')", "data"))
documented("sql_math",
    ("acosd_", "acosd(0.5)", "60.0"), ("asind_", "asind(0.5)", "30.0"), ("atand_", "atand(1)", "45.0"), ("atan2d_", "atan2d(1, 0)", "90.0"), ("cosd_", "cosd(60)", "0.5"), ("cotd_", "cotd(45)", "1.0"), ("sind_", "sind(30)", "0.5"), ("tand_", "tand(45)", "1.0"),
    ("acosh_", "acosh(1)", "0.0"), ("asinh_", "asinh(0)", "0.0"), ("atanh_", "atanh(0)", "0.0"), ("erf_", "round(erf(1.0)::numeric(20, 10), 7)", "0.8427008"), ("erfc_", "round(erfc(1.0)::numeric(20, 10), 7)", "0.1572992"),
    ("min_scale_", "min_scale('8.4100')", "2"), ("scale_", "scale('8.4100')", "4"), ("trim_scale_", "trim_scale('8.4100')", "8.41"), ("width_bucket_", "width_bucket(5.35, 0.024, 10.06, 5)", "3"), ("random_", "random() >= 0 AND random() < 1", "true"), ("random_normal_", "random_normal() IS NOT NULL", "true"))
documented("sql_dates",
    ("age_", "age(TIMESTAMP '2001-04-10', TIMESTAMP '1957-06-13')", "{525, 28, 0}"), ("clock_timestamp_", "clock_timestamp() IS NOT NULL", "true"), ("isfinite_", "isfinite(DATE '2001-02-16')", "true"), ("justify_days_", "justify_days(make_interval(0, 0, 0, 35))", "{1, 5, 0}"),
    ("justify_hours_", "justify_hours(make_interval(0, 0, 0, 0, 27))", "{0, 1, 10800000000}"), ("justify_interval_", "justify_interval(make_interval(0, 1, 0, 0, -1))", "{0, 29, 82800000000}"), ("make_time_", "make_time(8, 15, 23.5)", "29723500000"),
    ("make_timestamp_", "make_timestamp(2013, 7, 15, 8, 15, 23.5)", "2013-07-15 08:15:23.5"), ("timezone_", "timezone('America/Denver', TIMESTAMP '2001-02-16 20:38:40')", "2001-02-17 03:38:40"), ("to_date_", "to_date('05 Dec 2000', 'DD Mon YYYY')", "2000-12-05"),
    ("to_timestamp_", "to_timestamp(1284352323)", "2010-09-13 04:32:03"))
documented("sql_json",
    ("jsonb_array_length_", "jsonb_array_length('[1,2,3,{\"f1\":1},4]')", "5"), ("jsonb_build_array_", "jsonb_build_array(1, 2, 'foo')", '[1,2,"foo"]'), ("jsonb_build_object_", "jsonb_build_object('foo', 1, 'bar', 'x')", '{"bar":"x","foo":1}'),
    ("jsonb_extract_path_", "jsonb_extract_path('{\"f2\":{\"f3\":1},\"f4\":{\"f5\":99,\"f6\":\"foo\"}}', 'f4', 'f6')", '"foo"'), ("jsonb_extract_path_text_", "jsonb_extract_path_text('{\"f4\":{\"f6\":\"foo\"}}', 'f4', 'f6')", "foo"),
    ("jsonb_insert_", "jsonb_insert('{\"a\":[0,1,2]}', '{a,1}', '\"new_value\"')", '{"a":[0,"new_value",1,2]}'), ("jsonb_set_", "jsonb_set('{\"a\":[1,2]}', '{a,0}', '9')", '{"a":[9,2]}'), ("jsonb_strip_nulls_", "jsonb_strip_nulls('[{\"f1\":1,\"f2\":null},2,null,3]')", '[{"f1":1},2,null,3]'),
    ("jsonb_pretty_", "jsonb_pretty('{\"a\":1}')", '{\n    "a": 1\n}'), ("to_jsonb_", "to_jsonb('Fred said \"Hi.\"')", '"Fred said \\"Hi.\\""'), ("jsonb_typeof_", "jsonb_typeof('-123.4')", "number"))
documented("sql_text_search",
    ("get_current_ts_config_", "get_current_ts_config()", "english"), ("numnode_", "numnode('(''fat'' & ''rat'') | ''cat''')", "5"), ("plainto_", "plainto_tsquery('english', 'The Fat Rats')", "'fat' & 'rat'"), ("phraseto_", "phraseto_tsquery('english', 'The Fat Rats')", "'fat' <-> 'rat'"),
    ("websearch_", "websearch_to_tsquery('english', '\"fat rat\" or cat dog')", "'fat' <-> 'rat' | 'cat' & 'dog'"), ("to_tsquery_", "to_tsquery('english', 'The & Fat & Rats')", "'fat' & 'rat'"), ("to_tsvector_", "to_tsvector('english', 'The Fat Rats')", "'fat':2 'rat':3"),
    ("setweight_", "setweight('''fat'':2,4 ''cat'':3', 'A')", "'cat':3A 'fat':2A,4A"), ("strip_", "strip('''fat'':2,4 ''cat'':3 ''rat'':5A')", "'cat' 'fat' 'rat'"), ("ts_headline_", "ts_headline('The fat cat ate the rat.', '''cat''')", "The fat <b>cat</b> ate the rat."),
    ("ts_rank_", "round(ts_rank(to_tsvector('english', 'a fat cat'), '''cat''')::numeric(20, 10), 6)", "0.060793"), ("ts_rank_and_", "ts_rank(to_tsvector('english', 'cat sat'), '''cat'' & ''dog''') < 1e-10", "true"), ("ts_rank_cd_", "round(ts_rank_cd(to_tsvector('english', 'a fat cat'), '''cat''')::numeric(20, 10), 6)", "0.100000"),
    ("tsvector_to_array_", "array_to_string(tsvector_to_array('''fat'':2,4 ''cat'':3'), ',')", "cat,fat"), ("y_to_i_", "to_tsvector('english', 'a fly skies dying try') @@ to_tsquery('english', 'flies & sky & die & tries')", "true"))
documented("sql_arrays",
    ("array_dims_", "array_dims(ARRAY[1, 2])", "[1:2]"), ("array_fill_", "array_to_string(array_fill(7, ARRAY[3]), ',')", "7,7,7"), ("array_lower_", "array_lower(ARRAY[1, 2], 1)", "1"), ("array_upper_", "array_upper(ARRAY[1, 8, 3, 7], 1)", "4"), ("array_ndims_", "array_ndims(ARRAY[1, 2])", "1"),
    ("array_positions_", "array_to_string(array_positions(ARRAY['A', 'A', 'B', 'A'], 'A'), ',')", "1,2,4"), ("array_sample_", "cardinality(array_sample(ARRAY[1, 2, 3, 4], 2))", "2"), ("array_shuffle_", "cardinality(array_shuffle(ARRAY[1, 2, 3]))", "3"), ("cardinality_", "cardinality(ARRAY[1, 2])", "2"),
    ("cosine_distance_", "cosine_distance(ARRAY[1.0, 0.0], ARRAY[0.0, 1.0])", "1.0"), ("l2_normalize_", "array_to_string(l2_normalize(ARRAY[3.0, 0.0]), ',')", "1.0,0.0"), ("inner_product_", "inner_product(ARRAY[1.0, 2.0], ARRAY[3.0, 4.0])", "11.0"))
documented("sql_session",
    ("current_schema_", "current_schema()", "public"), ("current_user_", "current_user() = session_user()", "true"), ("version_", "length(version()) > 0", "true"), ("set_config_", "set_config('ms.note', 'kept', false)", "kept"), ("current_setting_", "current_setting('ms.unset', true) IS NULL", "true"),
    ("gen_random_uuid_", "length(gen_random_uuid())", "36"), ("current_database_", "length(current_database()) > 0", "true"), ("current_schemas_", "array_to_string(current_schemas(false), ',')", "public"), ("pg_is_in_recovery_", "pg_is_in_recovery()", "false"), ("current_date_", "current_date() IS NOT NULL", "true"),
    ("current_time_", "current_time() IS NOT NULL", "true"), ("pg_get_serial_sequence_", "pg_get_serial_sequence('ms_none', 'k') IS NULL", "true"), ("to_regclass_", "to_regclass('ms_no_such_table') IS NULL", "true"), ("to_regproc_", "to_regproc('age') IS NOT NULL", "true"), ("at_time_zone_", "TIMESTAMP '2001-02-16 20:38:40' AT TIME ZONE 'America/Denver'", "2001-02-17 03:38:40"),
    ("at_zone_aware_", "TIMESTAMPTZ '2001-02-16 20:38:40' AT TIME ZONE 'America/Denver'", "2001-02-16 13:38:40"))
dialect("sql_regexp_split_to_table", r"SELECT regexp_split_to_table('hello big world', '\s+') AS w", "SELECT * FROM (VALUES ('hello'), ('big'), ('world')) t(w)")
dialect("sql_json_elements", "SELECT jsonb_array_elements('[1,\"a\",null]') AS j", "SELECT * FROM (VALUES ('1'), ('\"a\"'), ('null')) t(j)")
dialect("sql_json_elements_text", "SELECT jsonb_array_elements_text('[1,\"a\",null]') AS j", "SELECT * FROM (VALUES ('1'), ('a'), (NULL)) t(j)")
dialect("sql_json_keys", "SELECT jsonb_object_keys('{\"b\":1,\"a\":{\"c\":2}}') AS k", "SELECT * FROM (VALUES ('a'), ('b')) t(k)")
dialect("sql_generate_subscripts", "SELECT generate_subscripts(ARRAY[7, 8, 9], 1) AS i", "SELECT CAST(i AS INT) AS i FROM (VALUES (1), (2), (3)) t(i)")
