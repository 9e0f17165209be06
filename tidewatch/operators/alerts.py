"""Alert frames: building, removing copies, ordering, filtering, and bringing them to the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.instants import iso_text
from tidewatch.model import ALERT, ALERT_COLUMNS, INSTANTS, SEVERITIES, Alert


def evidence(**columns: Column) -> Column:
    """JSON of the columns in their order, nulls kept, instants as ISO text."""
    own = [(iso_text(c) if k in INSTANTS else c).alias(k) for k, c in columns.items()]
    return F.to_json(F.struct(*own), {"ignoreNullFields": "false"})


def alerts(df: DataFrame, *, severity: Column, title: Column | str, summary: Column, evidence: Column, actions: Sequence[str], source_ips: Column, start: Column, end: Column, detector: str, confidence: str, ord: Column) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        severity.alias("severity"), text(title).alias("title"), summary.alias("summary"), evidence.alias("evidence"), F.array(*map(F.lit, actions)).alias("recommended_actions"),
        source_ips.alias("source_ips"), start.alias("time_start"), end.alias("time_end"), F.lit(detector).alias("detector"), F.lit(confidence).alias("confidence"), ord.alias("ord"),
    )


def union(spark: SparkSession, frames: Sequence[DataFrame]) -> DataFrame:
    """All alerts; each detector's own order comes after its place in the list."""
    placed = [f.withColumn("ord", F.concat(F.array(F.lit(i).cast("long")), "ord")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), placed) if placed else spark.createDataFrame([], ALERT)


def distinct(df: DataFrame) -> DataFrame:
    """Of alerts with equal detector, severity, title, set of sources and time range, the one found first. Copies are merged before they are moved."""
    identity = ("detector", "severity", "title", F.array_sort("source_ips").alias("ips"), "time_start", "time_end")
    return df.groupBy(*identity).agg(F.min_by(F.struct(*df.columns), "ord").alias("first")).select("first.*")


def rank(severity: str | Column = "severity") -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return reduce(lambda w, x: w.when(c == x[1], x[0]), list(enumerate(SEVERITIES))[1:], F.when(c == SEVERITIES[0], 0)).otherwise(len(SEVERITIES))


def in_order(df: DataFrame) -> DataFrame:
    """By severity, then start (or end, or none first), then as found."""
    return df.orderBy(rank(), F.coalesce("time_start", "time_end").asc_nulls_first(), "ord")


def at_least(df: DataFrame, minimum: str | None) -> DataFrame:
    return df if minimum is None else df.where(rank() <= SEVERITIES.index(minimum))


def to_driver(df: DataFrame) -> tuple[Alert, ...]:
    """The alerts in order; they are few beside events. Instants carry UTC."""
    columns = [F.unix_micros(c).alias(c) if c in ("time_start", "time_end") else F.col(c) for c in ALERT_COLUMNS]
    micro = lambda x: None if x is None else datetime.fromtimestamp(x // 1_000_000, timezone.utc).replace(microsecond=x % 1_000_000)
    out = []
    for r in in_order(df).select(columns).toLocalIterator():
        facts = {k: datetime.fromisoformat(v) if k in INSTANTS and v is not None else v for k, v in json.loads(r["evidence"] or "{}").items()}
        out.append(Alert(r["severity"], r["title"], r["summary"], facts, tuple(r["recommended_actions"] or ()), tuple(r["source_ips"] or ()), micro(r["time_start"]), micro(r["time_end"]), r["detector"], r["confidence"]))
    return tuple(out)
