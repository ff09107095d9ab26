"""Golden values of the loose-value rules."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelens.functions import json_values as jv

NUMBERS = [
    ("12.5", 12.5, 12),
    ("-5", -5.0, -5),
    ('"-5"', 5.0, 5),
    ('"$1,234.50"', 1234.5, 1234),
    ('"4.5 out of 5"', 4.55, 4),
    ('"$10 - $20"', 1020.0, 1020),
    ('"49.99 - $59.99"', None, None),
    ('"2.3K"', 2.3, 2),
    ('"."', None, None),
    ('"N/A"', None, None),
    ("true", None, None),
    ("null", None, None),
    ("0", 0.0, 0),
    ("-4.6", -4.6, -4),
    ('"5."', 5.0, 5),
    ('".5"', 0.5, 0),
    ("1e3", 1000.0, 1000),
    ('"1e3"', 13.0, 13),
    ("1e30", 1e30, None),
    ('""', None, None),
    ("[]", None, None),
    ("[12]", 12.0, 12),
    ("3000000000", 3e9, None),
]

BOOLEANS = [
    ("true", True),
    ("false", False),
    ('"Yes "', True),
    ('"\\tTRUE\\n"', True),
    ("1", True),
    ("1.0", False),
    ('"1"', True),
    ('"Sponsored"', False),
    ("0", False),
    ("[]", False),
    ("null", None),
]

TRUTHY = [
    ("null", False),
    ('""', False),
    ("[]", False),
    ("{}", False),
    ("0", False),
    ("0.0", False),
    ("-0", False),
    ("false", False),
    ('"0"', True),
    ('"[]"', True),
    ('"{}"', True),
    ('"false"', True),
    ('"x"', True),
    ("1", True),
    ("[0]", True),
]

RESEARCH = [
    ("12.5", 12.5, 12),
    ("4.6", 4.6, 4),
    ('"4.0"', 4.0, None),
    ('" 12 "', 12.0, 12),
    ('"+3"', 3.0, 3),
    ("4.0", 4.0, 4),
    ("-7", -7.0, -7),
    ('"-7.5e1"', -75.0, None),
    ("true", 1.0, 1),
    ('"true"', None, None),
    ('"n/a"', None, None),
    ('"$5"', None, None),
    ('"12d"', None, None),
    ("null", None, None),
    ("[]", None, None),
]


def values(spark, cases, *functions):
    """Applies functions to the loose values of ``[(json, ...)]`` in order."""
    rows = [(i, f'{{"v":{case[0]}}}') for i, case in enumerate(cases)]
    value = jv.field(F.col("raw"), "v")
    return (
        spark.createDataFrame(rows, "i INT, item STRING")
        .withColumn("raw", jv.read_fields("item", ["v"]))
        .select("i", *[f(value).alias(f"f{n}") for n, f in enumerate(functions)])
        .orderBy("i")
        .collect()
    )


def test_to_number_and_integer(spark):
    got = values(spark, NUMBERS, jv.to_number, jv.to_integer)
    assert [(r.f0, r.f1) for r in got] == [case[1:] for case in NUMBERS]


def test_to_boolean(spark):
    got = values(spark, BOOLEANS, jv.to_boolean)
    assert [r.f0 for r in got] == [case[1] for case in BOOLEANS]


def test_is_truthy(spark):
    got = values(spark, TRUTHY, jv.is_truthy)
    assert [r.f0 for r in got] == [case[1] for case in TRUTHY]


def test_research_casts_strip_nothing(spark):
    got = values(spark, RESEARCH, jv.research_number, jv.research_integer)
    assert [(r.f0, r.f1) for r in got] == [case[1:] for case in RESEARCH]


@pytest.mark.parametrize(
    ("item", "expected"),
    [
        ('{"a":"","b":[],"c":0}', "0"),
        ('{"a":false,"b":1}', "false"),
        ('{"a":{},"b":1}', "{}"),
        ('{"a":"[]","b":1}', "[]"),
        ('{"a":null,"b":" "}', " "),
        ("{}", None),
        ('{"a":1,"a":2}', "2"),
        ("not json", None),
        ("[1]", None),
        ('{"a":123.0}', "123.0"),
    ],
)
def test_first_present(spark, item, expected):
    fields = [jv.field(F.col("raw"), key) for key in "abc"]
    row = (
        spark.createDataFrame([(item,)], "item STRING")
        .withColumn("raw", jv.read_fields("item", "abc"))
        .select(jv.text(jv.first_present(*fields)).alias("v"))
        .first()
    )
    assert row.v == expected


def test_strip_removes_all_white_space(spark):
    df = spark.createDataFrame([("\t a b  \n",)], "s STRING")
    assert df.select(jv.strip(F.col("s")).alias("s")).first().s == "a b"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=40))
def test_a_formatted_price_reads_back(spark, cents):
    cases = [(json.dumps(f"${value / 100:,.2f}"), value / 100) for value in cents]
    got = values(spark, cases, jv.to_number)
    assert [r.f0 for r in got] == [price for _, price in cases]
