from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakepipe.functions import generators, nested, scalars
from lakepipe.functions.naming import clean_dummy_names, normalize_columns, snake_case


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def single(spark):
    return spark.range(1)


def test_pseudonym(single):
    assert one(single, scalars.pseudonym(F.lit("a@b.c"))) == hashlib.sha1(b"a@b.c").hexdigest()
    assert one(single, scalars.pseudonym(F.lit(None))) is None


@pytest.mark.parametrize(
    "text,pattern,expected",
    [
        ("12-31-2023 08:00:00", scalars.FEED_TIMESTAMP, dt.datetime(2023, 12, 31, 8)),
        ("12-31-2023 8:00:00", scalars.FEED_TIMESTAMP, None),
        ("12-31-2023 8:00:00", scalars.ORDER_TIMESTAMP, dt.datetime(2023, 12, 31, 8)),
        ("31-12-2023 08:00:00", scalars.FEED_TIMESTAMP, None),
        ("", scalars.FEED_TIMESTAMP, None),
        (None, scalars.FEED_TIMESTAMP, None),
    ],
)
def test_parse_timestamp(single, text, pattern, expected):
    parsed = scalars.parse_timestamp(F.lit(text).cast("string"), pattern).cast("timestamp_ntz")
    assert one(single, parsed) == expected


def test_scalars(single):
    assert one(single, scalars.to_whole(F.lit("12"))) == 12
    assert one(single, scalars.to_whole(F.lit("x"))) is None
    assert one(single, scalars.days_between("2024-02-01", F.lit("2024-01-01").cast("timestamp"))) == 31
    assert one(single, scalars.padded_id("DEV", F.lit(42))) == "DEV000000000042"
    assert one(single, scalars.map_values(F.lit("No"), {"Yes": 1, "No": 0})) == 0
    assert one(single, scalars.map_values(F.lit("?"), {"Yes": 1, "No": 0})) is None
    assert one(single, scalars.matches(F.lit(1), F.lit(None))) == 0
    assert one(single, scalars.epoch_to_timestamp(F.lit(3600)).cast("timestamp_ntz")) == dt.datetime(1970, 1, 1, 1)


@pytest.mark.parametrize(
    "quoted,expected",
    [
        (r'"{\"a\": \"x\", \"b\": {\"c\": 1}}"', '{"a": "x", "b": {"c": 1}}'),
        (r'{"payload":"{\"a\":\"\",\"b\":1}"}', '{"payload":{"a":"","b":1}}'),
        (r'{"note":"line\nbreak","q":"say \"hi\""}', r'{"note":"line\nbreak","q":"say \"hi\""}'),
        ('{"n":1,"t":"1","z":null}', '{"n":1,"t":"1","z":null}'),
        ("[1,2]", "[1,2]"),
        ("no json", None),
        (None, None),
    ],
)
def test_unescape_json(single, quoted, expected):
    assert one(single, scalars.unescape_json(F.lit(quoted).cast("string"))) == expected


@pytest.mark.parametrize(
    "text,passes",
    [("1", True), ('1, "b": 2', False), ("1, 2", False), ("1], [2", False), ('1}, {"data": 2', False),
     ('{"a": 1}', True), ("[1, 2]", True), ("null", True), ("", False), (None, False)],
)
def test_one_document(single, text, passes):
    found = one(single, nested.one_document(F.lit(text).cast("string")))
    assert found == (text if passes else None)


@pytest.mark.parametrize(
    "name,expected",
    [
        ("customerID", "customer_i_d"),
        ("StreamingTV", "streaming_t_v"),
        ("MonthlyCharges", "monthly_charges"),
        ("Bank transfer (automatic)", "bank_transfer_automatic"),
        ("Part Type", "part__type"),
        ("user_ID", "user_i_d"),
        ("_hidden-part", "_hidden_part"),
    ],
)
def test_snake_case(name, expected):
    assert snake_case(name) == expected


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["customerID", "StreamingTV"])
    fixes = {"customer_i_d": "customer_id", "streaming_t_v": "streaming_tv"}
    assert normalize_columns(df, fixes).columns == ["customer_id", "streaming_tv"]
    with pytest.raises(ValueError, match="collide"):
        normalize_columns(spark.createDataFrame([(1, 2)], ["aB", "a_b"]))
    dummies = spark.createDataFrame([(1,)], ["payment_method_Bank transfer (automatic)"])
    assert clean_dummy_names(dummies).columns == ["payment_method_bank_transfer__automatic_"]


def test_weighted_choice_shares(spark):
    weights = {"a": 0.5, "b": 0.4, None: 0.1}
    df = spark.range(1000).select(
        generators.weighted_choice(generators.key_position("id", 1000), weights).alias("v")
    )
    assert {r["v"]: r["count"] for r in df.groupBy("v").count().collect()} == {"a": 500, "b": 400, None: 100}


def test_generators(spark):
    df = spark.range(100)
    nulls = df.select(generators.inject_nulls(F.col("id"), generators.key_position("id"), 0.02).alias("v"))
    assert nulls.filter("v IS NULL").count() == 2
    copies = generators.replicate(spark.createDataFrame([(0,), (2,), (None,)], "n int"), "n")
    assert rows(copies) == [(2, 1), (2, 2)]
    assert generators.with_ids(df).select("uuid").distinct().count() == 100


DOCS = [
    ('{"a": 1, "b": {"c": [1, 2]}}', "[1, 2]", '"word"'),
    ('{"a": 2, "d": "x"}', "[3]", '"other"'),
    ("not json", None, None),
]


def test_parse_json_columns(spark):
    df = spark.createDataFrame(DOCS, "o string, l string, w string")
    parsed = nested.parse_json_columns(df, "o", "l", "w")
    assert dict(parsed.dtypes)["l"] == "array<bigint>" and dict(parsed.dtypes)["w"] == "string"
    found = parsed.select("o.a", "o.b.c", "o.d", "l", "w").collect()
    assert [tuple(r) for r in found] == [
        (1, [1, 2], None, [1, 2], "word"),
        (2, None, "x", [3], "other"),
        (None, None, None, None, None),
    ]


def test_parse_json_keeps_conflicting_parts_as_text(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 1}',), ('{"a": {"x": 1}, "b": 2}',)], "o string")
    found = nested.parse_json_columns(df, "o").select("o.a", "o.b").collect()
    assert [tuple(r) for r in found] == [("1", 1), ('{"x":1}', 2)]


def test_parse_json_of_mixed_kinds_and_of_nothing(spark):
    mixed = nested.parse_json_columns(spark.createDataFrame([('{"a": 1}',), ("[1]",)], "o string"), "o")
    assert rows(mixed) == [("[1]",), ('{"a": 1}',)] or rows(mixed) == [("[1]",), ('{"a":1}',)]
    nothing = nested.parse_json_columns(spark.createDataFrame([(None,), ("{bad",)], "o string"), "o")
    assert rows(nothing) == [(None,), (None,)]


def test_json_names_with_blanks_and_type_words(spark):
    df = spark.createDataFrame([('{"a b": 1, "OBJECT": {"VOID": null, "x`y": true}}',)], "o string")
    parsed = nested.parse_json_columns(df, "o").first()["o"]
    assert parsed["a b"] == 1 and parsed["OBJECT"]["x`y"] is True and parsed["OBJECT"]["VOID"] is None


def test_numbers_are_typed_like_spark_types_json(spark):
    docs = ['{"a": 1, "b": 1.5, "c": 23.0, "d": 12345678901234567890123, "e": {}}', '{"a": 2.25, "b": 7}']
    df = spark.createDataFrame([(d,) for d in docs], "o string")
    parsed = nested.parse_json_columns(df, "o").select("o.*")
    assert dict(parsed.dtypes) == {"a": "double", "b": "double", "c": "double", "d": "decimal(23,0)", "e": "string"}
    assert [(r["a"], r["b"], r["c"]) for r in parsed.collect()] == [(1.0, 1.5, 23.0), (2.25, 7.0, None)]


def test_documents_are_parsed_once_and_cast(spark):
    docs = ['{"a": -0.0, "b": [1, null], "s": "x\\u00e9", "n": 12345678901234567890}', ' {"b": [], "a": 9007199254740993}', "{bad", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, o string")
    parsed = nested.parse_json_columns(df, "o")
    kind = dict(parsed.dtypes)["o"]
    known = df.select("i", F.from_json("o", kind).alias("o")).where("i < 2")
    assert rows(parsed.where("i < 2").select("i", F.col("o").cast("string"))) == rows(known.select("i", F.col("o").cast("string")))
    assert [r["o"] for r in parsed.where("i > 1").collect()] == [None, None]
    whole = spark.createDataFrame([(1, '{"k": "a", "inner": "{\\"x\\": 5}"}')], "id int, o string")
    plan = nested.parse_two_levels(whole, "o", "inner")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and plan.count("try_parse_json") + plan.count("parseJson") <= 2
    assert nested.parse_two_levels(whole, "o", "inner").first() == (1, "a", 5)


def test_infer_json_type(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"b": [1.5]}',)], "o string")
    assert nested.infer_json_type(df, "o") == "STRUCT<`a`: BIGINT, `b`: ARRAY<DOUBLE>>"
    assert nested.infer_json_type(df.limit(0), "o") is None


def test_flatten_and_explode(spark):
    schema = "id int, p struct<q: struct<r: int, s: string>, steps: array<struct<n: int>>>"
    data = [(1, ((5, "x"), [(1,), (2,)])), (2, ((6, "y"), [])), (3, (None, None))]
    df = spark.createDataFrame(data, schema)
    flat = nested.flatten(df)
    assert flat.columns == ["id", "p_q_r", "p_q_s", "p_steps"]
    assert rows(flat, "id", "p_q_r") == [(1, 5), (2, 6), (3, None)]
    exploded = nested.flatten(nested.explode_rows(flat, "p_steps", "step"))
    assert rows(exploded, "id", "step_n") == [(1, 1), (1, 2)]
    assert nested.explode_rows(flat, "p_steps", "step", keep_empty=True).count() == 4


def test_two_levels_and_sample_schema(spark):
    df = spark.createDataFrame([(1, '{"kind": "a", "inner": "{\\"x\\": 1.5}"}')], "id int, doc string")
    found = nested.parse_two_levels(df, "doc", "inner").first()
    assert found["kind"] == "a" and float(found["x"]) == 1.5
    like = spark.createDataFrame([('[{"n": 1}]',)], "j string").select(nested.parse_like("j", '[{"n": 42}]').alias("v"))
    assert like.first()["v"][0]["n"] == 1
    typed = spark.createDataFrame([('{"n": 1}',)], "j string").select(nested.parse_with("j", "n int").alias("v"))
    assert typed.first()["v"]["n"] == 1


def test_join_arrays(spark):
    df = spark.createDataFrame([([1, 2], [3], None)], "a array<int>, b array<int>, c array<int>")
    assert df.select(nested.join_arrays(["a", "b"]).alias("v")).first()["v"] == [1, 2, 3]
