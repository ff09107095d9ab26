"""Table functions whose handler runs in the query, over a TABLE argument.

``SELECT * FROM fetch_payload(TABLE(requests))`` gives every row of the argument back with the answer's
columns added. The argument must have the request's columns and may have others. The function asks Spark
to partition by the request's columns, so equal requests meet in one handler, which asks once and answers
all of them; rows pass through one by one and none are kept. Requests with a NULL are requests too.

Answers are raw: ``search_results``, ``unwrap_items``, ``run_start_rows`` and ``run_result`` read them. The typed
functions of ``sql_functions`` go over a table that the answers were written to, so that each is asked for once;
Spark refuses a function that may answer differently inside a LATERAL join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pricelens.sources.fetch import Fetcher, attempt
from pricelens.sources.live import Ask

_ANSWER_TYPES = {"http_code": IntegerType()}


def handler(requests: Sequence[str], answers: Sequence[str], ask: Ask) -> type:
    """The handler class of a function that adds ``answers`` to a table with the columns ``requests``."""
    added = [StructField(name, _ANSWER_TYPES.get(name, StringType())) for name in answers]

    class Handler:
        def __init__(self) -> None:
            self.request = self.answer = None

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the argument must be a table: TABLE(...)")
            missing = [name for name in requests if name not in table.dataType.names]
            if missing:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            kept = [field for field in table.dataType.fields if field.name not in answers]
            return AnalyzeResult(StructType([*kept, *added]), partitionBy=[PartitioningColumn(name) for name in requests])

        def eval(self, row: Row):
            request = tuple(row[name] for name in requests)
            if self.answer is None or request != self.request:
                self.request, self.answer = request, tuple(ask(*request))
            yield (*(value for name, value in row.asDict().items() if name not in answers), *self.answer)

    return Handler


def register(spark: SparkSession, name: str, requests: Sequence[str], answers: Sequence[str], ask: Ask) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(handler(requests, answers, ask)))


def register_fetch_payload(
    spark: SparkSession, fetcher: Fetcher, retries: int = 0, pause: float = 3.0, error_length: int = 300, name: str = "fetch_payload"
) -> None:
    """``fetch_payload(TABLE(template, params_json, ...))`` adds ``payload`` and ``error``."""

    def ask(template, params_json):
        return attempt(fetcher, template, params_json or "{}", retries, pause, error_length)

    register(spark, name, ["template", "params_json"], ["payload", "error"], ask)


def register_fetch_web(spark: SparkSession, search: Callable[[str], str], name: str = "fetch_web") -> None:
    """``fetch_web(TABLE(body_json, ...))`` sends the bodies of ``search_requests`` and adds ``payload``, which is NULL
    where the search raises."""

    def ask(body_json):
        try:
            return (search(body_json),)
        except Exception:
            return (None,)

    register(spark, name, ["body_json"], ["payload"], ask)


def register_post_run(spark: SparkSession, post: Callable[[str, str], tuple[int, str]], name: str = "post_run") -> None:
    """``post_run(TABLE(agent_id, body_json, ...))`` sends the bodies of ``run_requests`` and adds ``http_code``, ``body``
    and ``exception``."""

    def ask(agent_id, body_json):
        try:
            return (*post(agent_id, body_json), None)
        except Exception as failure:
            return None, None, str(failure)

    register(spark, name, ["agent_id", "body_json"], ["http_code", "body", "exception"], ask)


def register_fetch_run(
    spark: SparkSession, read_run: Callable[[str, str], tuple[str, str | None]], name: str = "fetch_run"
) -> None:
    """``fetch_run(TABLE(agent_id, run_id, ...))`` adds ``status`` and ``envelope``; the status is ``error`` where reading
    raises."""

    def ask(agent_id, run_id):
        try:
            return tuple(read_run(agent_id, run_id))
        except Exception:
            return "error", None

    register(spark, name, ["agent_id", "run_id"], ["status", "envelope"], ask)
