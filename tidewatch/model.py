"""Schemas of events, alerts and diagnostics, and the driver-side objects around them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A normalized event. file_ord and line_no make the order total: (timestamp, file_ord, line_no).
EVENT = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("log_type", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("geo", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("raw_line", T.StringType()),
    T.StructField("file_ord", T.LongType(), False),
    T.StructField("line_no", T.LongType(), False),
])
EVENT_COLUMNS = EVENT.fieldNames()

#: An alert. evidence is JSON in the order of its keys; ord orders alerts as they are found.
ALERT = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("recommended_actions", T.ArrayType(T.StringType())),
    T.StructField("source_ips", T.ArrayType(T.StringType())),
    T.StructField("time_start", T.TimestampType()),
    T.StructField("time_end", T.TimestampType()),
    T.StructField("detector", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("ord", T.ArrayType(T.LongType())),
])
ALERT_COLUMNS = ALERT.fieldNames()

DIAGNOSTIC = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("file_ord", T.LongType()),
    T.StructField("line_no", T.LongType()),
])

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
LOG_TYPES = ("ssh", "firewall", "web", "windows")
#: Keys of evidence whose values are instants.
INSTANTS = frozenset({
    "window_start", "window_end", "time_start", "time_end", "success_time", "first_failure_time", "timestamp", "account_created_at", "group_membership_at",
    "activity_at", "login_at", "process_at", "assignment_at", "first_login_timestamp", "second_login_timestamp", "time_bucket_start", "time_bucket_end",
})


#: A file or folder: a path on this machine, or a URI in a store that Spark reads ("hdfs://…", "s3a://…").
Place = Path | str
_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")


def located(place: Place) -> Place:
    """URIs stay texts; everything else is a path."""
    return place if isinstance(place, str) and _URI.match(place) else Path(place)


@dataclass(frozen=True)
class Alert:
    """An alert on the driver, for rendering."""

    severity: str
    title: str
    summary: str
    evidence: dict[str, Any]
    recommended_actions: tuple[str, ...]
    source_ips: tuple[str, ...] = ()
    time_start: datetime | None = None
    time_end: datetime | None = None
    detector: str = ""
    confidence: str | None = None


@dataclass(frozen=True)
class Diagnostic:
    path: Place
    message: str
    format: str | None = None


@dataclass
class Analysis:
    """The frames of one run. events and alerts are lazy; alert_list() brings the ordered alerts to the driver."""

    events: DataFrame
    alerts: DataFrame
    diagnostics: DataFrame
    files_processed: tuple[Place, ...]
    files_skipped: tuple[Place, ...]
    shown: tuple[Alert, ...] | None = field(default=None, repr=False)

    def release(self) -> None:
        """Gives up the cached events. The frames stay usable; they are computed anew."""
        self.events.unpersist()

    @property
    def event_count(self) -> int:
        return self.events.count()

    def alert_list(self) -> tuple[Alert, ...]:
        from tidewatch.operators.alerts import to_driver

        return self.shown if self.shown is not None else to_driver(self.alerts)

    def diagnostic_list(self) -> tuple[Diagnostic, ...]:
        rows = self.diagnostics.orderBy("file_ord", "line_no").toLocalIterator()
        return tuple(Diagnostic(located(r["path"]), r["message"], r["format"]) for r in rows)
