"""Live sources: what is asked, how often, and what comes back."""

import datetime
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pricelens.sources import live, table_functions
from pricelens.streaming import polling, run_state
from workload import services

SCHEMA = "retailer STRING, keyword STRING, template STRING, params_json STRING"


def notes(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as file:
            out.append(json.load(file))
    return sorted(out)


@pytest.fixture
def journal(tmp_path):
    (tmp_path / "journal").mkdir()
    return str(tmp_path / "journal")


def requests(spark, path, rows=60):
    asked = [
        (("asia", "europe", None, "a/b=c d")[n % 4], f"k{n}" if n % 7 else None, "t" if n % 5 else None, f'{{"n":{n}}}')
        for n in range(rows)
    ]
    spark.createDataFrame(asked, SCHEMA).repartition(2).write.partitionBy("retailer").parquet(path)
    return asked


def payloads_of(spark, folder, journal, **options):
    def fetcher(template, params):
        services.note(journal, params["n"])
        if params["n"] % 3 == 0:
            raise TimeoutError(f"{params['n']} timed out")
        return {"n": params["n"]}

    live.register(spark, live.payload_source(fetcher, retries=1, pause=0, **options))
    return spark.read.format("shelf_payloads").load(f"{folder}/requests")


def expected(row):
    retailer, keyword, template, params = row
    n = json.loads(params)["n"]
    if template is None:
        return (*row, None, f"unknown retailer: {retailer or 'NULL'}")
    return (*row, None, f"{n} timed out") if n % 3 == 0 else (*row, json.dumps({"n": n}), None)


def key(row):
    return [(x is None, str(x)) for x in row]


def test_every_request_is_answered(spark, folder, journal, monkeypatch):
    monkeypatch.setattr(live, "ROWS_PER_PARTITION", 4)
    asked = requests(spark, f"{folder}/requests")
    got = [tuple(row) for row in payloads_of(spark, folder, journal).collect()]
    assert sorted(got, key=key) == sorted(map(expected, asked), key=key)
    sent = [json.loads(r[3])["n"] for r in asked if r[2]]
    assert notes(journal) == sorted([n] for n in sent for _ in range(1 + (n % 3 == 0)))  # failures are tried twice


@pytest.mark.parametrize(
    ("condition", "keep"),
    [
        ("retailer = 'asia'", lambda r: r[0] == "asia"),
        ("retailer IN ('asia', 'a/b=c d', 'nowhere')", lambda r: r[0] in ("asia", "a/b=c d")),
        ("retailer <=> NULL", lambda r: r[0] is None),
        ("retailer = 'europe' AND keyword = 'k9'", lambda r: r[:2] == ("europe", "k9")),
        ("keyword IS NOT NULL AND retailer = 'europe'", lambda r: r[0] == "europe" and r[1] is not None),
        ("retailer = 'asia' AND length(payload) > 7", lambda r: r[0] == "asia" and len(expected(r)[4] or "") > 7),
        ("retailer = 'nowhere'", lambda r: False),
    ],
)
def test_filters_reach_the_reader(spark, folder, journal, condition, keep):
    asked = requests(spark, f"{folder}/requests")
    df = payloads_of(spark, folder, journal).filter(condition)
    assert sorted(map(tuple, df.collect()), key=key) == sorted((expected(r) for r in asked if keep(r)), key=key)
    about_requests = condition.split(" AND length")[0]
    wanted = keep if about_requests == condition else (lambda r: r[0] == "asia")
    assert {n for (n,) in notes(journal)} == {json.loads(r[3])["n"] for r in asked if r[2] and wanted(r)}


def test_partitions_are_stretches_of_matching_row_groups(spark, folder):
    requests(spark, f"{folder}/requests")
    reader = live.RequestReader(f"{folder}/requests", SCHEMA.replace(" STRING", "").split(", "), ["payload"], None, 4)
    assert sum(p.stop - p.first for p in reader.partitions()) == 60
    assert all(p.stop - p.first <= 4 for p in reader.partitions())
    assert not list(reader.pushFilters([live.EqualTo(("retailer",), "asia")]))
    assert sum(p.stop - p.first for p in reader.partitions()) == 15


def test_run_results(spark, folder):
    rows = [("agent_1", f"run_{n}") for n in range(25)]
    spark.createDataFrame(rows, "agent_id STRING, run_id STRING").write.parquet(f"{folder}/runs")
    live.register(spark, live.run_source(services.read_run))
    got = {row.run_id: row for row in spark.read.format("run_results").load(f"{folder}/runs").collect()}
    assert len(got) == 25 and got["run_9"].status == "running" and got["run_9"].envelope is None
    assert (got["run_14"].status, got["run_14"].error) == ("error", "no answer on run_14")
    assert json.loads(got["run_2"].envelope)["output"]["content"] == [{"n": 0}, {"n": 1}]


# Status logs as a stream

T0 = datetime.datetime(2025, 1, 1)


def log_of(spark, folder, log, rows):
    schema = "label STRING, run_id STRING, status STRING, event_time TIMESTAMP"
    events = [(label, run, status, T0 + datetime.timedelta(minutes=m)) for label, run, status, m in rows]
    name = f"{folder}/logs/log={log}"
    at = len(os.listdir(name)) if os.path.isdir(name) else 0
    os.makedirs(name, exist_ok=True)
    spark.createDataFrame(events, schema).toPandas().to_parquet(f"{name}/part-{at:05d}.parquet")


def test_a_restart_asks_from_the_last_place_only(spark, folder, journal):
    polling.register(spark, polling.status_source(services.FileLogs(f"{folder}/logs", journal), events_per_partition=2))

    def start():
        for name in os.listdir(journal):
            os.rename(f"{journal}/{name}", f"{folder}/{name}")
        rows = run_state.ledger_stream(spark.readStream.format("run_status").load(), "10 minutes", max_minutes=45)
        polled = polling.follow(rows, f"{folder}/rows", f"{folder}/checkpoint", every="0 seconds")
        polled.processAllAvailable()
        polled.stop()
        return [n for n in notes(journal) if n[0] == "events"]

    log_of(spark, folder, "a", [("x", "x1", "running", 0), ("x", "x1", "failed", 2), ("x", "x2", "running", 3)])
    log_of(spark, folder, "b", [("y", "y1", "running", 1)])
    assert start() == [["events", "a", 0, 2], ["events", "a", 2, 3], ["events", "b", 0, 1]]
    assert start() == []
    log_of(spark, folder, "a", [("x", "x2", "completed", 30)])
    log_of(spark, folder, "c", [(None, None, None, 900)])
    assert start() == [["events", "a", 3, 4], ["events", "c", 0, 1]]
    assert ["confirm", "a", 3] in [json.load(open(f"{folder}/{n}")) for n in os.listdir(folder) if len(n) == 32] + notes(journal)
    got = sorted(tuple(row) for row in spark.read.schema(run_state.LEDGER).parquet(f"{folder}/rows").collect())
    assert got == [("x", "x2", "completed", 2), ("y", "y1", "still running", 1)]


# Table functions


def test_equal_requests_are_sent_once(spark, journal):
    def fetcher(template, params):
        services.note(journal, params["n"])
        if params["n"] == 2:
            raise TimeoutError("no answer")
        return f"answer {params['n']}"

    table_functions.register_fetch_payload(spark, fetcher)
    rows = [(k, "t", f'{{"n":{k % 4}}}', "mine") for k in range(40)] + [(99, "t", None, None)] * 2
    asked = spark.createDataFrame(rows, "k LONG, template STRING, params_json STRING, payload STRING").repartition(7)
    asked = asked.withColumn("params_json", F.coalesce("params_json", F.lit('{"n":7}')))
    got = spark.sql("SELECT * FROM fetch_payload(TABLE({asked}))", asked=asked)
    assert got.columns == ["k", "template", "params_json", "payload", "error"]
    answers = sorted((r.k, r.payload, r.error) for r in got.collect())
    want = [(k, None if k % 4 == 2 else f"answer {k % 4}", "no answer" if k % 4 == 2 else None) for k in range(40)]
    assert answers == sorted([*want, (99, "answer 7", None), (99, "answer 7", None)])
    assert notes(journal) == [[0], [1], [2], [3], [7]]


def test_null_requests_and_empty_tables(spark):
    table_functions.register_fetch_run(spark, lambda agent, run: (f"{agent} {run}", None))
    rows = [("a", None), (None, None), (None, None), ("a", "r")]
    asked = spark.createDataFrame(rows, "agent_id STRING, run_id STRING")
    got = spark.sql("SELECT status FROM fetch_run(TABLE({asked}))", asked=asked).collect()
    assert sorted(r.status for r in got) == ["None None", "None None", "a None", "a r"]
    assert spark.sql("SELECT * FROM fetch_run(TABLE({asked}))", asked=asked.limit(0)).collect() == []


def test_arguments_that_do_not_fit(spark):
    table_functions.register_fetch_run(spark, lambda agent, run: ("ok", None))
    with pytest.raises(AnalysisException, match="lacks run_id"):
        spark.sql("SELECT * FROM fetch_run(TABLE(SELECT 'a' AS agent_id))").collect()
    with pytest.raises(AnalysisException, match="must be a table"):
        spark.sql("SELECT * FROM fetch_run('a')").collect()
