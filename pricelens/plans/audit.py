"""Who called which tool and who read the key, from the access log.

``as_of`` is the day the report is about. With the log partitioned by ``event_date`` the window
limits which folders are read.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 30
NEWEST_CALLS = 200

# How the log names tool calls and key reads.
TOOL_ACTIONS = ["mcpToolInvocation", "mcpCall"]
KEY_SERVICE = "secrets"
KEY_ACTION = "getSecret"


def _in_window(as_of: datetime.date, days: int) -> Column:
    return F.col("event_date") >= F.lit(as_of - datetime.timedelta(days=days))


def tool_calls(
    log: DataFrame,
    as_of: datetime.date,
    days: int = WINDOW_DAYS,
    actions: Sequence[str] = TOOL_ACTIONS,
    newest: int = NEWEST_CALLS,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """The newest tool calls in the window."""
    request = F.col("request_params")
    return (
        log.filter(_in_window(as_of, days) & F.col("action_name").isin(list(actions)))
        .orderBy(F.desc("event_time"), *tie_break)
        .limit(newest)
        .select(
            "event_time",
            F.col("user_identity.email").alias("user"),
            "service_name",
            request["tool_name"].alias("tool"),
            request["json_rpc_method"].alias("method"),
            F.coalesce(request["mcp_server_name"], request["connection_name"]).alias("server"),
            F.col("response.status_code").alias("status_code"),
        )
    )


def key_reads(
    log: DataFrame,
    as_of: datetime.date,
    scope: str,
    days: int = WINDOW_DAYS,
    service: str = KEY_SERVICE,
    action: str = KEY_ACTION,
) -> DataFrame:
    """Reads of the key per day and user, newest day and busiest user first."""
    return (
        log.filter(
            _in_window(as_of, days)
            & (F.col("service_name") == service)
            & (F.col("action_name") == action)
            & (F.col("request_params.scope") == scope)
        )
        .groupBy("event_date", F.col("user_identity.email").alias("user"))
        .agg(F.count(F.lit(1)).alias("key_reads"))
        .orderBy(F.desc("event_date"), F.desc("key_reads"))
    )
