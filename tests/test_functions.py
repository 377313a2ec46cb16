"""Functions one by one, against the values PostgreSQL gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import arrays, dates, jsonb, math, session, strings, text_search, vectors
from marlstone.functions.registry import FUNCTIONS, call


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: strings.initcap(F.lit("hi THOMAS o'neil-smith")), "Hi Thomas O'Neil-Smith"),
        (lambda: strings.left(F.lit("hello"), -2), "hel"),
        (lambda: strings.right(F.lit("hello"), -2), "llo"),
        (lambda: strings.right(F.lit("hello"), 0), ""),
        (lambda: strings.substring(F.lit("hello"), -2, 3), ""),
        (lambda: strings.substring(F.lit("hello"), 0, 3), "he"),
        (lambda: strings.substring(F.lit("foobar"), "o(.)b"), "o"),
        (lambda: strings.concat(F.lit("a"), F.lit(None), 1), "a1"),
        (lambda: strings.chr_(8364), "€"),
        (lambda: strings.to_hex(255), "ff"),
        (lambda: strings.quote_literal(F.lit("O'Re\\y")), "E'O''Re\\\\y'"),
        (lambda: strings.quote_nullable(F.lit(None).cast("string")), "NULL"),
        (lambda: strings.format_("%s has %2$L and %%, %1$5s|%1$-5s|", F.lit("x"), F.lit("it's")), "x has 'it''s' and %,     x|x    |"),
        (lambda: strings.regexp_replace(F.lit("foobarbaz"), "b..", "X"), "fooXbaz"),
        (lambda: strings.regexp_replace(F.lit("foobarbaz"), "b(..)", r"X\1Y", "g"), "fooXarYXazY"),
        (lambda: strings.regexp_match(F.lit("foobarbequebaz"), "(bar)(beque)"), ["bar", "beque"]),
        (lambda: strings.regexp_matches(F.lit("foobarbequebazilbarfbonk"), "(b[^b]+)(b[^b]+)", "g"), [["bar", "beque"], ["bazil", "barf"]]),
        (lambda: strings.regexp_instr(F.lit("ABCDEF"), "c(.)(..)", 1, 1, 0, "i", 2), 5),
        (lambda: strings.unistr(F.lit(r"d\0061t\+000061")), "data"),
        (lambda: strings.parse_ident(F.lit('"SomeSchema".someTable')), ["SomeSchema", "sometable"]),
        (lambda: strings.crc32c(F.lit("123456789")), 0xE3069283),
        (lambda: strings.normalize(F.lit("é")), "é"),
        (lambda: strings.to_ascii(F.lit("Karél")), "Karel"),
        (lambda: strings.get_bit(F.lit(b"\x12\x34"), 10), 1),
        (lambda: strings.get_byte(F.lit(b"\x12\x34"), 1), 0x34),
        (lambda: strings.set_byte(F.lit(b"\x12\x34\x56"), 1, 64), bytearray(b"\x12\x40\x56")),
        (lambda: strings.set_bit(F.lit(b"\x12\x34"), 10, 0), bytearray(b"\x12\x30")),
        (lambda: strings.encode(F.lit(b"a\x00\\"), "escape"), "a\\000\\\\"),
        (lambda: strings.similar_to(F.lit("abc"), "%(b|d)%"), True),
        (lambda: math.trunc(F.lit(-42.4382), 2), -42.43),
        (lambda: math.sind(30), 0.5),
        (lambda: math.cosd(60), 0.5),
        (lambda: math.tand(45), 1.0),
        (lambda: math.acosd(0.5), 60.0),
        (lambda: math.gcd(1071, 462), 21),
        (lambda: math.lcm(1071, 462), 23562),
        (lambda: math.min_scale(F.lit("8.4100")), 2),
        (lambda: math.trim_scale(F.lit("8.4100")), "8.41"),
        (lambda: math.int_div(-7, 2), -3),
        (lambda: math.to_int(F.lit(2.5)), 2),
        (lambda: math.erf(1.0), pytest.approx(0.8427007929497149)),
        (lambda: math.width_bucket(5.35, 0.024, 10.06, 5), 3),
        (lambda: arrays.array_positions(F.array(*map(F.lit, "ABAA")), "A"), [1, 3, 4]),
        (lambda: arrays.array_dims(F.array(F.lit(1), F.lit(2))), "[1:2]"),
        (lambda: arrays.subscript(F.array(F.lit(1)), -1), None),
        (lambda: arrays.array_to_string(F.array(F.lit("1"), F.lit(None), F.lit("3")), ",", "*"), "1,*,3"),
        (lambda: arrays.string_to_array(F.lit("xx~~yy~~zz"), "~~", "yy"), ["xx", None, "zz"]),
        (lambda: vectors.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), 1.0),
        (lambda: dates.to_char(F.lit(dt.datetime(2002, 4, 20, 17, 31, 12)), "HH12:MI:SS Day, DDth Mon FMMM"), "05:31:12 Saturday , 20th Apr 4"),
        (lambda: dates.to_char(125, "999", number=True), " 125"),
        (lambda: dates.to_char(-485, "999", number=True), "-485"),
        (lambda: dates.to_char(1485, "9,999", number=True), " 1,485"),
        (lambda: dates.to_char(12.0, "99D9", number=True), " 12.0"),
        (lambda: dates.date_minus(F.lit(dt.date(2001, 10, 1)), F.lit(dt.date(2001, 9, 28))), 3),
        (lambda: dates.extract("isodow", F.lit(dt.datetime(2001, 2, 18))), 7.0),
        (lambda: dates.to_date(F.lit("05 Dec 2000"), "DD Mon YYYY"), dt.date(2000, 12, 5)),
        (lambda: dates.make_time(8, 15, 23.5), (8 * 3600 + 15 * 60) * 10**6 + 23_500_000),
        (lambda: jsonb.canonical(F.lit('{"b": 1.0, "a": {"x": null}, "b": 1.50}')), '{"a":{"x":null},"b":1.50}'),
        (lambda: jsonb.get_text(F.lit('{"a":[1,{"b":"c"}]}'), "a", 1, "b"), "c"),
        (lambda: jsonb.get(F.lit('{"a":null}'), "a"), "null"),
        (lambda: jsonb.get_text(F.lit('{"a":null}'), "a"), None),
        (lambda: jsonb.jsonb_contains(F.lit('{"a":[1,2,3],"b":1.0}'), '{"a":[3],"b":1}'), True),
        (lambda: jsonb.jsonb_contains(F.lit("[1,2]"), "1"), True),
        (lambda: jsonb.jsonb_contains(F.lit("[[1,2]]"), "1"), False),
        (lambda: jsonb.jsonb_exists(F.lit('["foo","bar"]'), "bar"), True),
        (lambda: jsonb.jsonb_set(F.lit('{"a":[1,2]}'), "{a,0}", F.lit("9")), '{"a":[9,2]}'),
        (lambda: jsonb.jsonb_insert(F.lit('{"a":[0,1,2]}'), "{a,1}", F.lit('"n"'), True), '{"a":[0,1,"n",2]}'),
        (lambda: jsonb.jsonb_strip_nulls(F.lit('{"a":null,"b":[null]}')), '{"b":[null]}'),
        (lambda: jsonb.concat(F.lit('{"a":1}'), F.lit('{"a":2,"b":3}')), '{"a":2,"b":3}'),
        (lambda: jsonb.delete(F.lit('["a","b"]'), 1), '["a"]'),
        (lambda: jsonb.delete_path(F.lit('{"a":{"b":1,"c":2}}'), "{a,b}"), '{"a":{"c":2}}'),
        (lambda: jsonb.jsonb_typeof(F.lit("-123.4")), "number"),
        (lambda: jsonb.jsonb_build_object(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None)), '{"a":1,"b":null}'),
        (lambda: text_search.to_tsvector(F.lit("The Fat Rats")), "'fat':2 'rat':3"),
        (lambda: text_search.plainto_tsquery("The Fat Rats"), "'fat' & 'rat'"),
        (lambda: text_search.phraseto_tsquery("The Fat Rats"), "'fat' <-> 'rat'"),
        (lambda: text_search.websearch_to_tsquery('"sad cat" or "fat rat"'), "'sad' <-> 'cat' | 'fat' <-> 'rat'"),
        (lambda: text_search.matches(text_search.to_tsvector(F.lit("a fat cat sat")), "'fat' <-> 'cat'"), True),
        (lambda: text_search.setweight(F.lit("'fat':2 'rat':3"), "A"), "'fat':2A 'rat':3A"),
        (lambda: text_search.strip(F.lit("'fat':2,4 'rat':3A")), "'fat' 'rat'"),
        (lambda: text_search.concat(F.lit("'a':1 'b':2"), F.lit("'c':1 'b':3")), "'a':1 'b':2,5 'c':3"),
        (lambda: text_search.numnode(F.lit("'fat' & 'rat' | 'cat'")), 5),
        (lambda: text_search.ts_headline(F.lit("the fox jumps"), "'fox'"), "the <b>fox</b> jumps"),
    ],
)
def test_value(spark, make, want):
    assert one(spark, make()) == want


@pytest.mark.parametrize("make", [lambda: math.ln(0.0), lambda: math.sqrt(-1.0), lambda: math.acos(2.0), lambda: math.power(0.0, -1), lambda: strings.get_byte(F.lit(b"a"), 3), lambda: math.int_div(1, 0), lambda: vectors.l2_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))])
def test_errors(spark, make):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, make())


def test_aggregates_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, x string")
    assert df.agg(arrays.ordered_agg(F.col("x"), F.col("k"))).first()[0] == [None, "b"]
    assert df.where("false").agg(arrays.array_agg(F.col("x"))).first()[0] is None
    assert df.agg(jsonb.jsonb_object_agg(F.col("k"), F.col("x").isNull().cast("string"))).first()[0] == '{"1":true,"2":false}'
    assert spark.range(5).agg(math.pg_corr(F.col("id"), F.lit(1))).first()[0] is None


def test_age_and_intervals(spark):
    got = one(spark, dates.age(F.lit(dt.datetime(2001, 4, 10)), F.lit(dt.datetime(1957, 6, 13))))
    assert (got.months, got.days, got.micros) == (43 * 12 + 9, 28, 0)
    assert one(spark, dates.interval_key(dates.make_interval(months=1)) == dates.interval_key(dates.make_interval(days=30)))
    assert one(spark, dates.justify_days(dates.make_interval(days=35))).months == 1


def test_sequences():
    session.SETTINGS.create_sequence("s", 10, 5)
    session.nextval("s")
    assert session.SETTINGS.nextval("s") == 15
    assert list(session.SETTINGS.reserve("s", 3)) == [20, 25, 30]


def test_registry_is_complete():
    call("pi")
    for name in ("coalesce", "regexp_substr", "erfc", "age", "jsonb_pretty", "generate_subscripts", "websearch_to_tsquery", "l2_normalize", "has_table_privilege", "to_regclass", "array_sample", "crc32c"):
        assert name in FUNCTIONS
    assert len(FUNCTIONS) >= 250


def test_needed_starts_stand_in_every_form(spark):
    """The words that text_matches looks for first are part of each word with that stem."""
    from marlstone.text import query, stem, vector

    words = {*stem._SPECIAL, *stem._AFTER_1A, "fly", "flies", "try", "tries", "die", "dying", "happy", "happiness", "possible", "possibility", "hopping", "hoping", "relational", "agreed", "sized", "conflated", "falling", "generously", "national", "nationality", "communism", "arsenal"}
    words |= {w.lower() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100).collect() for w in r.text.split() if w.isascii() and w.isalpha()}
    for w in words:
        for stub in text_search._needed(("lexeme", stem.stem(w), False, ""), "english"):
            assert stub in w
    pairs = [("a fly in a sky", "'fli'"), ("they try", "'tri' & !'cat'"), ("the skies", "'sky'"), ("dying", "'die'"), ("only early", "'onli' & 'earli'"), ("no match", "'fli'")]
    rows = spark.createDataFrame(pairs, "x string, q string")
    for x, q in pairs:
        want = query.matches(query.parse(q), vector.to_vector(x, "english"))
        assert rows.where((F.col("x") == x) & text_search.text_matches(F.col("x"), q)).count() == int(want)


def test_rank_of_joined_operands():
    from marlstone.text import query, rank, vector

    of = lambda text, q: rank.rank(vector.to_vector(text, "english"), query.parse(q))
    assert of("cat sat", "'cat' & 'dog'") == pytest.approx(1e-20)
    assert of("cat dog", "'cat' & 'dog'") == pytest.approx(0.1 * 1 / (1.005 + 0.05 * 2.718281828459045 ** (1 / 1.5 - 2)) ** 0.5)
    # The lexemes that a prefix finds are not paired with each other.
    assert of("cat cattle", "'cat':* & 'dog'") == pytest.approx(1e-20)


def test_contained_scalars_without_python(spark):
    """The quick way and the full one agree, also on numbers of other forms, repeated keys and other shapes."""
    texts = ['{"k":7}', '{"k":7.0}', '{"k":"7"}', '{"k":7.5}', '{"k":7e0}', '{"k":1,"k":7}', '{"k":7,"k":1}', '[{"k":7}]', "7", '{"k":[7]}', '{"k":null}', '{"a":"x","k":7}', '{"a":"x"}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in ('{"k":7}', '{"k":"7"}', '{"a":"x","k":7}', '{"k":7.0}', '{"a":"x"}'):
        got = {r.i: r.c for r in rows.select("i", jsonb.jsonb_contains(F.col("t"), pattern).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (None if t is None else jsonb.contains(jsonb.parse(t), jsonb.parse(pattern))), (pattern, t)


def test_text_is_matched_without_a_vector(spark):
    """to_tsvector(text) @@ constant: one Python function, the query parsed once, and the same answers as by vectors."""
    from marlstone.plans.engine import Engine
    from marlstone.text import query, vector

    texts = ["An Apache license", "licensed, copyrighted", "see license.txt apache", "mail a.b@license.org apache", "LICENSE copyright", "public map", "the license apache", "", None]
    spark.createDataFrame(list(enumerate(texts)), "i int, x string").createOrReplaceTempView("ms_texts")
    for q in ("license & (apache | copyright)", "!license & map", "license | map", "license <-> apache", "lic:* & !apache"):
        df = Engine(spark).sql(f"SELECT i FROM ms_texts WHERE to_tsvector('english', x) @@ to_tsquery('english', '{q}')")
        node = query.to_query(q)
        assert sorted(r.i for r in df.collect()) == [i for i, x in enumerate(texts) if x is not None and query.matches(node, vector.to_vector(x))], q
        assert df._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
