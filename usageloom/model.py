"""Value objects and table schemas."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo


@dataclass(frozen=True)
class Window:
    """Inclusive range of local dates, optionally of one project."""

    start: dt.date
    end: dt.date
    project: str | None = None
    label: str = ""

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError("window ends before it starts")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def previous(self) -> "Window":
        """The period of equal length that ends the day before this one starts."""
        return Window(
            self.start - dt.timedelta(days=self.days),
            self.start - dt.timedelta(days=1),
            self.project,
        )

    def instants(self, tz: str) -> tuple[dt.datetime, dt.datetime]:
        """Half-open UTC bounds of the local dates."""
        return local_midnight(self.start, tz), local_midnight(self.end + dt.timedelta(days=1), tz)


@dataclass(frozen=True)
class Page:
    """One page of a ranked list; only the ranking by cost is offered."""

    limit: int = 40
    page: int = 1
    sort: str = "cost"
    order: str = "desc"

    def __post_init__(self):
        if self.limit not in range(1, 201):
            raise ValueError("limit must lie in 1..200")
        if self.page < 1:
            raise ValueError("pages are counted from 1")
        if self.order not in ("asc", "desc"):
            raise ValueError("order is asc or desc")
        if self.sort != "cost":
            raise ValueError("lists are ranked by cost only")

    @property
    def offset(self) -> int:
        return self.limit * (self.page - 1)


def local_midnight(day: dt.date, tz: str) -> dt.datetime:
    local = dt.datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz))
    return local.astimezone(dt.timezone.utc)


def utc(text: str) -> dt.datetime:
    """Aware UTC instant from ISO text (no offset means UTC)."""
    value = dt.datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


# Table schemas, as the DDL text that readers and ``createDataFrame`` take.
REQUEST = (
    "request_id string, message_id string, session_id string, agent_id string, lineage_id string, "
    "prompt_id string, ts timestamp, model string, input_tok bigint, output_tok bigint, "
    "cache_read_tok bigint, cache_w5m_tok bigint, cache_w1h_tok bigint, server_tool_use string, "
    "service_tier string, speed string, geo string, stop_reason string, is_synthetic int, "
    "is_interrupted int, source string, raw_path string, query_source string, effort string, "
    "cost_usd_sdk double, end_ts timestamp, api_duration_ms double"
)
PROMPT = (
    "prompt_id string, session_id string, ts timestamp, text string, "
    "interrupted_message_id string, task_label string"
)
TOOL_CALL = (
    "tool_use_id string, request_id string, session_id string, agent_id string, prompt_id string, "
    "name string, ts timestamp, is_error int, result_bytes bigint, file_path string, "
    "lines_changed bigint, result_ts timestamp, workflow_run_id string"
)
AGENT = (
    "agent_id string, session_id string, agent_type string, parent_tool_use_id string, "
    "spawn_depth bigint, resolved_model string, workflow_run_id string"
)
SESSION = (
    "session_id string, project string, slug string, git_branch string, cc_version string, "
    "first_ts timestamp, last_ts timestamp"
)
HOOK_EVENT = (
    "ts timestamp, kind string, session_id string, prompt_id string, payload_json string"
)
PRICE = (
    "model string, valid_from date, valid_to date, in_usd double, out_usd double, "
    "cache_read_x double, cache_w5m_x double, cache_w1h_x double, batch_x double, fast_x double, "
    "geo_us_x double, source_url string"
)
PRICE_TOOL = (
    "tool string, valid_from date, valid_to date, usd_per_unit double, source_url string"
)
NUDGE = (
    "rule string, fired_ts timestamp, session_id string, detail_json string, "
    "experiment_group string"
)
