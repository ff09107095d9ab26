"""Dictionaries as tables and specifications as text."""

import json
import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from pricelens.functions import brands
from pricelens.functions.urls import is_blocked
from pricelens.operators import dictionaries, research, spec_rules
from pricelens.operators.lookup import hot_lookup, lookup
from pricelens.schemas import EARNINGS_SPEC, REVIEWS_SPEC

NAMES = [
    "Nike Air", "nikelab", "Air Jordan 1 Nike", "new  balance 9", "new balance 9", "New-Balance", "the new-balance", "On Cloudmonster",
    "on cloud", "on-cloud 5", "on", "on ", "on\n", "Gone running", "on running", "On Runningshoe", "Under_Armour", "under armour", "UNDER-ARMOUR x",
    "hoka/adidas", "ünike", "nikeé", "puma2", "puma.2", "", None, "-", "salomon" * 3, "mizuno mizuno", "x" * 500 + " asics",
]
GIVEN = [None, "", "  ", "Nike", "men's", " Kids ", "Altra", "on", "new balance", "On Cloud"]
URLS = [None, "https://www.amazon.com/Under-Armour-Charged/dp/B0", "https://www.amazon.com/on-x/dp/1", "https://shop.example.com/nike"]


def all_rows(spark):
    rows = [(n, g, u) for n in NAMES for g in GIVEN for u in URLS]
    return spark.createDataFrame(rows, "name STRING, given STRING, url STRING")


def test_dictionary_equals_the_patterns(spark):
    columns = [F.col(c) for c in ("name", "given", "url")]
    rows = all_rows(spark)
    want = rows.withColumn("brand", brands.brand_of(*columns))
    got = dictionaries.with_brand(rows, *columns, dictionaries.brand_dictionary(spark))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.filter("brand = 'On'").count() > 5


@pytest.mark.parametrize("seed", range(2))
def test_random_dictionaries_equal_regular_expressions(spark, seed):
    rng = random.Random(seed)
    text = lambda most: "".join(rng.choice("ab -é") for _ in range(rng.randint(1, most)))
    entries = []
    while len(entries) < 25:
        kind, phrase = rng.choice(["words", "begin", "start", "whole"]), text(4)
        if kind in ("start", "whole") or (re.match(r"\w(.*\w)?$", phrase)):
            entries.append((len(entries), f"B{len(entries)}", kind, phrase))
    pattern = {"words": r"\b{}\b", "begin": r"\b{}", "start": "^{}", "whole": r"\A{}\Z"}
    names = sorted({text(9) for _ in range(150)})

    def brand(name):
        for _, found, kind, phrase in entries:
            if re.search(pattern[kind].format(re.escape(phrase)), name.lower()):
                return found
        return None

    rows = spark.createDataFrame([(n,) for n in names], "name STRING")
    none = F.lit(None).cast("string")
    table = spark.createDataFrame(entries, dictionaries.ENTRIES)
    got = dictionaries.with_brand(rows, F.col("name"), none, none, table)
    assert {r.name: r.brand for r in got.collect()} == {n: brand(n) for n in names}


def test_joins_are_equi_joins_whatever_the_sizes(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = [F.col(c) for c in ("name", "given", "url")]
        rows = all_rows(spark)
        got = dictionaries.with_brand(rows, *columns, dictionaries.brand_dictionary(spark))
        blocked = dictionaries.with_blocked(rows, "url", spark.createDataFrame([("example.com",)], "domain STRING"))
        for df in (got, blocked):
            assert not re.search("NestedLoop|Cartesian", plan_of(df))
        want = rows.withColumn("brand", brands.brand_of(*columns))
        assert got.exceptAll(want).isEmpty() and got.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_dictionary_leaves_the_given_brand(spark):
    rows = spark.createDataFrame([("nike", " Altra ", None), ("nike", "Kids", None), ("nike", None, None)], "name STRING, given STRING, url STRING")
    empty = spark.createDataFrame([], dictionaries.ENTRIES)
    got = dictionaries.with_brand(rows, F.col("name"), F.col("given"), F.col("url"), empty)
    assert [r.brand for r in got.orderBy(F.desc_nulls_last("given")).collect()] in ([None, "Altra", None], ["Altra", None, None], [None, None, "Altra"])
    assert sorted(str(r.brand) for r in got.collect()) == ["Altra", "None", "None"]


def test_blocked_domains_from_a_table(spark):
    urls = [
        None, "", "no url", "https://example.com/x", "http://a.b.EXAMPLE.com:8080/y?z", "https://notexample.com", "ftp://example.com.org/",
        "https://com/", "https://quora.com", "https://www.quora.com/a", "https://x.co.uk",
    ]
    domains = ["example.com", "Quora.com", "co.uk", "", "quora.com"]
    rows = spark.createDataFrame([(u,) for u in urls], "url STRING")
    table = spark.createDataFrame([(d,) for d in [*domains, None]], "domain STRING")
    got = {r.url: r.blocked for r in dictionaries.with_blocked(rows, "url", table).collect()}
    want = {r.url: r.b for r in rows.select("url", is_blocked(F.col("url"), [d for d in domains if d]).alias("b")).collect()}
    assert got == want and sum(got.values()) == 5


def test_a_hot_key_is_dealt_out(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1), ("7", 2), ("unused", 3)], "k STRING, v INT")
    got = {r.id: r.v for r in lookup(rows, table, ["k"]).collect()}
    assert got == {k: 1 if k % 3 == 0 else 2 if k == 7 else None for k in range(1000)}


@pytest.mark.parametrize("rows_to_be_hot", [1000, 100, 1])
def test_hot_keys_are_looked_up_apart(spark, monkeypatch, rows_to_be_hot):
    monkeypatch.setattr("pricelens.operators.lookup.HOT_ROWS", rows_to_be_hot)
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 40).when(F.col("id") % 7 == 0, None).otherwise(F.col("id"))
    rows = spark.range(2000).select("id", key.alias("k"))
    table = spark.range(1, 1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = hot_lookup(rows, table, "k")
    want = rows.join(table, "k", "left").select("id", "k", "v")
    assert got.columns == ["id", "k", "v"] and got.count() == 2000
    assert got.exceptAll(want).isEmpty() and not got.filter("v IS NULL").isEmpty()


# Specifications

SPEC = {
    "type": "object",
    "required": ["name", "price", "tags"],
    "properties": {
        "name": {"type": "string"},
        "kind": {"type": ["string", "null"], "enum": ["shoe", "sock", None]},
        "price": {
            "type": "object",
            "required": ["amount"],
            "properties": {"amount": {"type": "number"}, "currency": {"enum": ["EUR", "USD"]}, "old": {"type": ["number", "null"]}},
        },
        "tags": {"type": "array", "items": {"type": "string"}},
        "offers": {
            "type": "array",
            "items": {"type": "object", "required": ["shop"], "properties": {"shop": {"type": "string"}, "sizes": {"type": "array", "items": {"type": "integer", "enum": [40, 41]}}}},
        },
        "it's": {"type": "boolean"},
    },
}


def type_of(value):
    names = {str: "string", bool: "boolean", dict: "object", list: "array", type(None): "null"}
    return {names.get(type(value), "number")} | ({"integer"} if isinstance(value, int) and not isinstance(value, bool) else set())


def plain(spec, value, path=""):
    out = []
    types = [spec["type"]] if isinstance(spec.get("type"), str) else spec.get("type", [])
    if types and not type_of(value) & set(types):
        out.append(f"type of {path}")
    if "enum" in spec and not any(value == c and type(value) is type(c) for c in spec["enum"]):
        out.append(f"value of {path}")
    for name, below in spec.get("properties", {}).items():
        where = f"{path}.{name}" if path else name
        if isinstance(value, dict) and name in value:
            out += plain(below, value[name], where)
        elif isinstance(value, dict) and name in spec.get("required", []):
            out.append(f"missing {where}")
    if isinstance(value, list) and "items" in spec:
        for n, item in enumerate(value):
            out += plain(spec["items"], item, f"{path}[{n}]")
    return out


def checked(spark, spec, values):
    rows = spark.createDataFrame([(n, v if isinstance(v, str) or v is None else json.dumps(v)) for n, v in enumerate(values)], "n INT, item_json STRING")
    specs = spark.createDataFrame([("s", json.dumps({"output_schema": {"type": "array", "items": spec}})), ("t", "{}")], "name STRING, spec STRING")
    return [r.violations for r in spec_rules.validate_by_spec(rows, specs, "s").orderBy("n").collect()]


def test_violations_name_their_path(spark):
    good = {"name": "a", "price": {"amount": 1.5, "currency": "EUR"}, "tags": []}
    values = [
        good,
        {**good, "kind": None, "tags": ["x", "y"], "it's": True},
        {**good, "kind": "hat", "tags": ["x", 3, None], "it's": "yes"},
        {"price": {"amount": "1.5", "currency": 3, "old": None}},
        {**good, "price": 3},
        {**good, "offers": [{"shop": "s", "sizes": [40, 42, "41", 41.5]}, {}, 7, {"shop": None, "sizes": None}]},
        {**good, "offers": {"shop": "s"}},
        {},
        [],
        3,
    ]
    assert checked(spark, SPEC, values) == [plain(SPEC, v) for v in values]
    assert checked(spark, SPEC, values)[5][:3] == ["value of offers[0].sizes[1]", "type of offers[0].sizes[2]", "value of offers[0].sizes[2]"]


def test_a_member_is_asked_for_its_kind_once(spark):
    """However many types it may have; and the row itself once."""
    names = [f"f{n}" for n in range(9)]
    spec = {"type": "object", "required": names, "properties": {n: {"type": ["string", "number", "null"]} for n in names}}
    row = spark.createDataFrame([('{"f0":1,"f1":true}',)], "row STRING").select(F.try_parse_json("row").alias("row"))
    checked = row.select(spec_rules.violations(spec, F.col("row")).alias("found"))
    assert checked._jdf.queryExecution().analyzed().toString().count("schema_of_variant") == 10
    assert checked.first().found == ["type of f1", *[f"missing {n}" for n in names[2:]]]


def test_specifications_from_files(spark, tmp_path):
    (tmp_path / "shop+rows %.json").write_text(json.dumps({"output_schema": {"type": "array", "items": SPEC}}, indent=1))
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / "notes.txt").write_text("no specification")
    specs = spec_rules.specs_from_files(spark, str(tmp_path))
    assert sorted(r.name for r in specs.collect()) == ["other", "shop+rows %"]
    rows = spark.createDataFrame([('{"name":1,"price":{},"tags":[]}',)], "item_json STRING")
    assert spec_rules.validate_by_spec(rows, specs, "shop+rows %").first().violations == ["type of name", "missing price.amount"]


def test_texts_that_are_no_json(spark):
    assert checked(spark, SPEC, ["{", None]) == [["not JSON"]] * 2
    assert checked(spark, {}, ["{}"]) == [[]]


@pytest.mark.parametrize("spec", [EARNINGS_SPEC, REVIEWS_SPEC])
def test_flat_specifications_equal_the_fixed_ones(spark, spec):
    rng = random.Random(5)
    values = ["text", 3, 3.5, None, True, [], ["x"], {}]
    items = [{k: rng.choice(values) for k in spec["types"] if rng.random() < 0.8} for _ in range(60)]
    nested = {"type": "object", "required": spec["required"], "properties": {k: {"type": t} for k, t in spec["types"].items()}}
    rows = spark.createDataFrame([(n, json.dumps(v)) for n, v in enumerate(items)], "n INT, item_json STRING")
    want = [r.violations for r in research.validate_rows(rows, spec).orderBy("n").collect()]
    assert checked(spark, nested, items) == want and any(want)


def test_specifications_that_say_nothing(spark):
    specs = spark.createDataFrame([("a", "{}"), ("a", "{}")], "name STRING, spec STRING")
    rows = spark.createDataFrame([("{}",)], "item_json STRING")
    for name in ("a", "b"):
        with pytest.raises(ValueError, match="specifications are named"):
            spec_rules.validate_by_spec(rows, specs, name)
    with pytest.raises(ValueError, match="unknown JSON types: money"):
        spec_rules.violations({"type": "money"}, F.lit(1))
