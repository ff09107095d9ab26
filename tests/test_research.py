"""Envelopes, claims, typed rows, specs, sources and the run ledger."""

import datetime
import json
import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from pricelens.functions.claims import claim_row
from pricelens.operators import ledger, research
from pricelens.schemas import EARNINGS_BLOCKED_DOMAINS, EARNINGS_DDL, EARNINGS_SPEC, REVIEWS_DDL, REVIEWS_SPEC


def run(spark, content, claims=(), status="completed", confidence="high"):
    output = {"trust": {"confidence": confidence, "claims": list(claims)}}
    if content is not None:
        output["content"] = content
    df = spark.createDataFrame([("r", status, json.dumps({"output": output}))], "run_id STRING, status STRING, envelope STRING")
    return research.run_result(df)


def claim(path, confidence=None, *urls):
    return {"path": path, "confidence": confidence, "citations": [{"url": url} for url in urls]}


@pytest.mark.parametrize(
    ("content", "rows"),
    [
        ({"meta": 1, "rows": [{"r": 1}]}, [{"r": 1}]),
        ({"z": [{"r": 1}], "a": [{"s": 1}]}, [{"r": 1}]),
        ({"z": "[x", "a": [{"s": 1}]}, [{"s": 1}]),
        ({"a": 1}, [{"a": 1}]),
        ([{"a": 1}, {"b": 4.0}], [{"a": 1}, {"b": 4.0}]),
        ([], []),
        ("text", []),
        (None, []),
    ],
)
def test_envelope_rows(spark, content, rows):
    got = run(spark, content).orderBy("item_index").collect()
    assert [json.loads(row.item_json) for row in got] == rows
    assert [row.item_index for row in got] == list(range(len(rows)))


def test_unfinished_run_is_one_row(spark):
    (row,) = run(spark, [{"a": 1}], status="running").collect()
    assert (row.run_id, row.status) == ("r", "running")
    assert row.item_index is None and row.item_json is None and row.source_urls is None and row.confidence is None


def test_row_roll_up(spark):
    claims = [
        claim("$[0].x", "high", "a", "b"),
        claim("$[0]", "high", "a", ""),
        claim("$[0].y", "low"),
        claim("$[0].z"),
        claim("$[1][0]", "high", "no"),
        claim("$", "high", "no"),
        claim("$[10].x", "high", "ten"),
    ]
    first, second = run(spark, [{}, {}], claims).orderBy("item_index").collect()
    assert (first.source_urls, first.high_confidence_share) == (["a", "b"], 0.67)
    assert [c["path"] for c in json.loads(first.claims_json)] == ["$[0].x", "$[0]", "$[0].y", "$[0].z"]
    assert (second.source_urls, second.high_confidence_share, second.claims_json) == ([], None, "[]")


def test_claim_row(spark):
    cases = {"$[1]": 1, "$[1].price": 1, "$[10].price": 10, "$[0].": 0, "$[1][0]": None, "$": None, "$[01]": None, "$.a": None, "$[1]\n": None, "": None, "x$[1]": None}
    df = spark.createDataFrame([(path,) for path in cases], "path STRING")
    got = {row.path: row.i for row in df.select("path", claim_row(F.col("path")).alias("i")).collect()}
    assert got == cases


def test_claims_meet_their_rows_as_in_a_plain_loop(spark):
    """The sorted slices against the rule stated directly, on random envelopes."""
    rng = random.Random(7)
    rows, expected = [], {}
    for number in range(40):
        items = rng.randint(0, 13)
        claims = [
            claim(rng.choice(["$[{}]", "$[{}].a", "$[{}][0]", "$.b{}"]).format(rng.randint(0, 15)), rng.choice(["high", "low", None, ""]), *rng.choices(["u", "v", "w", ""], k=rng.randint(0, 3)))
            for _ in range(rng.randint(0, 30))
        ]
        envelope = {"output": {"content": [{"n": n} for n in range(items)], "trust": {"claims": claims}}}
        rows.append((f"r{number}", "completed", json.dumps(envelope)))
        for i in range(items):
            mine = [c for c in claims if c["path"] == f"$[{i}]" or c["path"].startswith(f"$[{i}].")]
            cited = [c["url"] for m in mine for c in m["citations"] if c["url"]]
            expected[f"r{number}", i] = (mine, list(dict.fromkeys(cited)))
    df = spark.createDataFrame(rows, "run_id STRING, status STRING, envelope STRING")
    result = research.run_result(df)
    got = {(r.run_id, r.item_index): (json.loads(r.claims_json), r.source_urls) for r in result.collect()}
    plain = {key: ([{k: v for k, v in c.items() if v is not None} for c in mine], urls) for key, (mine, urls) in expected.items()}
    got = {key: ([{k: v for k, v in c.items() if v is not None} for c in mine], urls) for key, (mine, urls) in got.items()}
    assert got == plain
    assert "Exchange" not in plan_of(result) and "Python" not in plan_of(result)


def test_rows_alone_parse_no_claims(spark):
    result = run(spark, [{}], [claim("$[0]", "high", "a")])
    assert "citations" in plan_of(result)
    rows = result.select("run_id", "item_index", "item_json")
    assert "claims" not in plan_of(rows) and tuple(rows.first()) == ("r", 0, "{}")


def test_claims_that_are_no_objects_are_passed_over(spark):
    high, low = claim("$[0].a", "high", "u", "v"), claim("$[1]", "low", "u")
    for claims in ([high, "junk", 3, None, low], [None, high, low], [["x"], high, low, True]):
        first, second = run(spark, [{}, {}], claims).orderBy("item_index").collect()
        assert (first.source_urls, first.high_confidence_share, len(json.loads(first.claims_json))) == (["u", "v"], 1.0, 1)
        assert (second.source_urls, second.high_confidence_share, len(json.loads(second.claims_json))) == (["u"], 0.0, 1)


def test_claims_are_looked_at_only_where_they_can_tell_of_a_row(spark):
    plan = plan_of(run(spark, [{}], [claim("$[0]", "high", "a")]).select("run_id", "source_urls", "high_confidence_share"))
    assert re.search(r"size\(items#\d+, false\) > 0\)+ THEN \S*from_json", plan)  # not in envelopes without rows
    assert not re.search(r"lambda x_\d+#\d+\.url", plan)  # citations are not opened one by one
    assert not re.search(r"WHEN \(*Contains\(envelope", plan)  # whole envelopes are searched only behind a look at the content


def test_odd_claims_and_citations(spark):
    odd = [
        {"confidence": "high", "citations": [{"url": "no"}]},
        {"path": "$[0]", "confidence": None, "citations": None},
        {"path": "$[0]", "confidence": "", "citations": [None, {}, {"url": None}, {"url": "b"}]},
        {"path": "$[0]", "confidence": "low"},
        {"path": "$[1]", "confidence": "high", "citations": [{"url": "a"}, {"url": "b"}, {"url": "a"}]},
        {"path": "$[99999999999]", "confidence": "high", "citations": [{"url": "no"}]},
        {"path": "$[0]", "confidence": "high", "citations": [{"url": "a"}, {"url": "b"}]},
    ]
    first, second = run(spark, [{}, {}], odd).orderBy("item_index").collect()
    assert (first.source_urls, first.high_confidence_share, len(json.loads(first.claims_json))) == (["b", "a"], 0.5, 4)
    assert (second.source_urls, second.high_confidence_share, len(json.loads(second.claims_json))) == (["a", "b"], 1.0, 1)
    assert run(spark, None, odd).isEmpty() and run(spark, [], odd).isEmpty()


def test_strings_are_told_from_lists_with_and_without_quotes_and_escapes(spark):
    frame = '{"output":{"content":%s,"trust":{"claims":[{"path":"$[0]","note":%s}]}}}'
    contents = {
        '"[1,2]"': [], '"{}"': [], '"[\\"a\\"]"': [], '"\\u005b1]"': [], '"\\u007B}"': [], '"{\\u0022a\\u0022:1}"': [],
        "[1,2]": ["1", "2"], '["a"]': ["a"], "{}": ["{}"], '{"a":"[1]","b":[3]}': ["3"], '{"a":"\\u005b1]","b":[3]}': ["3"],
    }
    cases = [(content, note, rows) for content, rows in contents.items() for note in ('"plain"', '"a \\"quote\\""', '"[x"')]
    runs = [(str(k), "completed", frame % (content, note)) for k, (content, note, _) in enumerate(cases)]
    got = research.run_result(spark.createDataFrame(runs, "run_id STRING, status STRING, envelope STRING")).collect()
    found = {k: [r.item_json for r in sorted(got, key=lambda r: r.item_index) if r.run_id == str(k)] for k in range(len(cases))}
    assert found == {k: rows for k, (_, _, rows) in enumerate(cases)}


def test_a_field_is_asked_for_its_kind_once(spark):
    df = spark.createDataFrame([("{}",)], "item_json STRING")
    checked = research.validate_rows(df, EARNINGS_SPEC)
    assert checked._jdf.queryExecution().analyzed().toString().count("schema_of_variant") == len(EARNINGS_SPEC["types"])


def test_type_earnings(spark):
    rows = [
        {"company": "A", "revenue_millions": 4.5, "quarter_end_date": "2025-03-31"},
        {"company": "B", "revenue_millions": "n/a", "quarter_end_date": "soon"},
        {"company": "", "revenue_millions": 1},
        {"company": "C", "revenue_millions": None},
        {"company": "D"},
    ]
    typed = research.type_earnings(run(spark, rows), F.lit("2025-01-01").cast("timestamp"))
    assert typed.columns == [part.split()[0] for part in EARNINGS_DDL.split(", ")]
    got = {(r.company, r.revenue_millions, r.quarter_end_date) for r in typed.collect()}
    assert got == {("A", 4.5, datetime.date(2025, 3, 31)), ("B", None, None)}


def test_type_reviews(spark):
    rows = [
        {"brand": "A", "model": "m", "review_count": 4.6, "rating": "4.5", "top_praise": ["x", "y"]},
        {"brand": "B", "model": "m", "review_count": "4.0", "top_praise": None, "top_complaints": []},
    ]
    typed = research.type_reviews(run(spark, rows), F.lit("2025-01-01").cast("timestamp"))
    assert typed.columns == [part.split()[0] for part in REVIEWS_DDL.split(", ")]
    first, second = typed.orderBy("brand").collect()
    assert (first.review_count, first.rating, first.top_praise, first.top_complaints) == (4, 4.5, ["x", "y"], [])
    assert (second.review_count, second.top_praise, second.top_complaints) == (None, [], [])


def test_validate_rows(spark):
    rows = [
        json.dumps({"brand": "a", "model": "b", "review_count": 4, "top_praise": ["x"], "rating": None}),
        json.dumps({"brand": None, "review_count": 4.5, "top_praise": "x"}),
    ]
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "i INT, item_json STRING")
    good, bad = research.validate_rows(df, REVIEWS_SPEC).orderBy("i").collect()
    assert good.violations == []
    assert bad.violations == ["type of brand", "missing model", "type of review_count", "type of top_praise"]
    assert set(EARNINGS_SPEC["required"]) <= set(EARNINGS_SPEC["types"])


def test_blocked_sources(spark):
    urls = {
        "https://www.wsj.com/a": True,
        "https://WSJ.com": True,
        "https://notwsj.com": False,
        "https://finance.yahoo.com/q": True,
        "https://yahoo.com": False,
        "not a url": False,
        "http://[bad": False,
        None: False,
    }
    df = spark.createDataFrame([(url,) for url in urls], "url STRING")
    got = {r.url: r.blocked for r in research.flag_blocked_sources(df, "url", EARNINGS_BLOCKED_DOMAINS).collect()}
    assert got == urls


T0 = datetime.datetime(2025, 1, 1)
LOG = [
    # label, run, status, minute
    ("done", "d1", "running", 0), ("done", "d1", "completed", 5), ("done", "d1", "failed", 6),
    ("retried", "r1", "running", 0), ("retried", "r1", "failed", 3), ("retried", "r2", "running", 4), ("retried", "r2", "completed", 44),
    ("twice", "t1", "failed", 1), ("twice", "t2", "running", 2), ("twice", "t2", "failed", 9), ("twice", "t3", "completed", 10),
    ("slow", "s1", "running", 0), ("slow", "s1", "completed", 46),
    ("late", "l1", "failed", 0), ("late", "l2", "running", 1), ("late", "l2", "completed", 50),
    ("alone", "a1", "failed", 0),
    ("stopped", "x1", "running", 0), ("stopped", "x1", "cancelled", 45),
]
LEDGER = {
    ("done", "d1", "completed", 1),
    ("retried", "r2", "completed", 2),
    ("twice", "t2", "failed", 2),
    ("slow", "s1", "still running", 1),
    ("late", "l2", "still running", 2),
    ("alone", "a1", "failed", 1),
    ("stopped", "x1", "cancelled", 1),
}


def status_events(spark):
    rows = [(label, run_id, status, T0 + datetime.timedelta(minutes=m)) for label, run_id, status, m in LOG]
    return spark.createDataFrame(rows, "label STRING, run_id STRING, status STRING, event_time TIMESTAMP")


def test_run_ledger(spark):
    result = ledger.run_ledger(status_events(spark))
    assert {tuple(row) for row in result.collect()} == LEDGER
    assert ledger.completed(result).count() == 2
    assert ledger.not_completed(result).count() == 5


def test_strings_that_look_like_lists_or_objects(spark):
    def envelope(content):
        return json.dumps({"output": {"content": content, "trust": {"confidence": "high", "claims": []}}})

    contents = {
        "a": {"note": "[]", "rows": [{"x": 1}, {"x": 2}]},
        "b": {"note": "[7]", "rows": [{"x": 1}]},
        "c": '[{"x":1}]',
        "d": '{"x":1}',
        "e": {"x": 1, "n": "{"},
        "f": {"b": " [q", "a": [{"z": 1}]},
    }
    runs = spark.createDataFrame([(k, "completed", envelope(c)) for k, c in contents.items()], "run_id STRING, status STRING, envelope STRING")
    rows = [(r.run_id, r.item_json) for r in research.run_result(runs).orderBy("run_id", "item_index").collect()]
    assert rows == [("a", '{"x":1}'), ("a", '{"x":2}'), ("b", '{"x":1}'), ("e", '{"x":1,"n":"{"}'), ("f", '{"z":1}')]


def test_items_that_are_strings_are_no_objects(spark):
    from pricelens.sources import payloads

    parsing = {
        "a": '[{"title":"x"}]',
        "b": '{"title":"x"}',
        "c": {"entities": ['{"t":1}', {"t": 2}, 3]},
        "d": ["[1]", '{"a":1}', {"b": 2}],
        "e": {"products": "[1]", "items": [{"k": "{"}]},
        "f": {"title": "x"},
    }
    rows = [(k, json.dumps({"data": {"parsing": p}})) for k, p in parsing.items()]
    found = payloads.unwrap_items(spark.createDataFrame(rows, "id STRING, payload STRING"))
    assert sorted(tuple(r) for r in found.collect()) == [("c", 1, '{"t":2}'), ("d", 2, '{"b":2}'), ("e", 0, '{"k":"{"}'), ("f", 0, '{"title":"x"}')]


def test_praise_given_as_text_is_no_list(spark):
    items = ['{"brand":"b","top_praise":"[\\"light\\"]"}', '{"brand":"b","top_praise":["light"]}']
    base = "CAST(NULL AS {}) AS {}"
    rows = spark.createDataFrame([(i,) for i in items], "item_json STRING").selectExpr(
        "item_json", base.format("STRING", "run_id"), base.format("STRING", "confidence"), base.format("ARRAY<STRING>", "source_urls"),
        base.format("DOUBLE", "high_confidence_share"), base.format("STRING", "claims_json"),
    )
    typed = research.type_reviews(rows, F.current_timestamp())
    assert [r.top_praise for r in typed.collect()] == [[], ["light"]]


def test_earnings_are_parsed_as_variant_only_where_a_text_is_unclear(spark):
    items = [
        '{"company":"A","revenue_millions":true,"gross_margin_pct":"true"}',
        '{"company":"[]","revenue_millions":"5"}',
        '{"company":[],"revenue_millions":"5"}',
        '{"company":[1],"revenue_millions":false,"gross_margin_pct":-1.5e1}',
        '{"revenue_millions":true}',
        '{"company":"B","revenue_millions":"n/a","gross_margin_pct":null,"operating_income_millions":false}',
    ]
    rows = spark.createDataFrame([(i,) for i in items], "item_json string").select(
        "item_json", *[F.lit(None).cast(t).alias(c) for c, t in (("source_urls", "array<string>"), ("high_confidence_share", "double"))],
        *[F.lit(None).cast("string").alias(c) for c in ("claims_json", "confidence", "run_id")],
    )
    typed = research.type_earnings(rows, F.current_timestamp())
    assert "THEN from_json(" in plan_of(typed)
    got = [tuple(r) for r in typed.select("company", "revenue_millions", "gross_margin_pct", "operating_income_millions").collect()]
    assert got == [("A", 1.0, None, None), ("[]", 5.0, None, None), ("[1]", 0.0, -15.0, None), ("B", None, None, 0.0)]
