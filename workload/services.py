"""Stand-ins for the remote services, over files that Spark wrote or by a rule on the request."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs


_EVENT = pa.schema([("label", pa.string()), ("run_id", pa.string()), ("status", pa.string()), ("event_time", pa.timestamp("us", "UTC"))])


def note(journal: str | None, *words) -> None:
    """Notes a question in a folder, one file each."""
    if journal:
        with open(f"{journal}/{uuid.uuid4().hex}", "w") as file:
            json.dump(words, file)


class FileLogs:
    """Status logs in a folder ``log=<name>`` each, whose files hold the events in order of file name. Questions are
    noted in ``journal``."""

    def __init__(self, folder: str, journal: str | None = None):
        self.folder, self.journal = folder, journal

    def _dataset(self, log: str) -> ds.Dataset:
        filesystem, path = fs.FileSystem.from_uri(self.folder)
        return ds.dataset(f"{path}/log={log}", format="parquet", filesystem=filesystem)

    def logs(self) -> list[str]:
        filesystem, path = fs.FileSystem.from_uri(self.folder)
        folders = filesystem.get_file_info(fs.FileSelector(path))
        return [f.base_name.removeprefix("log=") for f in folders if f.base_name.startswith("log=")]

    def length(self, log: str) -> int:
        return self._dataset(log).count_rows()

    def events(self, log: str, start: int, stop: int) -> Iterator[tuple]:
        note(self.journal, "events", log, start, stop)
        at = 0
        for fragment in sorted(self._dataset(log).get_fragments(), key=lambda f: f.path):
            rows = fragment.count_rows()
            if at < stop and at + rows > start:
                wanted = fragment.to_table(columns=_EVENT.names).cast(_EVENT)
                for batch in wanted.slice(max(start - at, 0), stop - max(at, start)).to_batches(1000):
                    yield from (tuple(row.values()) for row in batch.to_pylist())
            at += rows

    def confirm(self, log: str, stop: int) -> None:
        note(self.journal, "confirm", log, stop)


def read_run(agent_id: str, run_id: str) -> tuple[str, str | None]:
    """Status and envelope of a run by the number in its id."""
    number = int(run_id.split("_")[1])
    if number % 11 == 3:
        raise ConnectionError(f"no answer on {run_id}")
    if number % 10 == 9:
        return "running", None
    rows = [{"n": n} for n in range(number % 4)]
    return "completed", json.dumps({"output": {"content": rows, "trust": {"confidence": agent_id, "claims": []}}})


def post_run(agent_id: str, body_json: str) -> tuple[int, str]:
    """Answer to starting a run, by the number that is its input."""
    number = int(json.loads(body_json)["input"])
    if number % 5 == 2:
        raise TimeoutError(f"timeout {number}")
    if number % 5 == 1:
        return 404, json.dumps({"detail": f"no agent {number}"})
    return 200, "<html>busy</html>" if number % 5 == 3 else json.dumps({"id": f"run_{number}", "status": "queued"})


def search_web(body_json: str) -> str:
    """One hit that repeats the query."""
    body = json.loads(body_json)
    hit = {"title": f"{body['max_results']} asked for", "description": body.get("query"), "url": body["search_depth"]}
    return json.dumps({"results": [hit]})
