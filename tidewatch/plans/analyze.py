"""The analysis of a collection of files: events, alerts and diagnostics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.model import ALERT, Alert, Analysis, Place, located
from tidewatch.operators import alerts as A
from tidewatch.operators.detectors import SYNTHETIC_LOCATIONS, BruteForce, Detector, ImpossibleTravel, PortScan, SuspiciousLogin, UnusualTraffic
from tidewatch.operators.privilege import PrivilegeEscalation
from tidewatch.sources import files, parsers
from tidewatch.sources.config import Config


def default_detectors(config: Config | None = None, locations: Mapping | DataFrame | None = None) -> list[Detector]:
    """All six, in the order in which their alerts count. An empty mapping of locations means the synthetic ones."""
    options = lambda name: config.detector_options.get(name, {}) if config else {}
    places = locations if isinstance(locations, DataFrame) or locations else SYNTHETIC_LOCATIONS
    return [
        BruteForce(**options("brute_force")), PortScan(**options("port_scan")), SuspiciousLogin(**options("suspicious_login")), PrivilegeEscalation(**options("privilege_escalation")),
        ImpossibleTravel(places, **options("impossible_travel")), UnusualTraffic(**options("unusual_traffic")),
    ]


def detect(events: DataFrame, detectors: Sequence[Detector] | None = None, config: Config | None = None, locations: Mapping | DataFrame | None = None) -> DataFrame:
    """The alerts of all detectors over an event frame, without copies. Their order is in `ord`; in_order() sorts them."""
    active = default_detectors(config, locations) if detectors is None else list(detectors)
    found = [d.detect(events) for d in active]
    return A.distinct(A.union(events.sparkSession, found)) if found else events.sparkSession.createDataFrame([], ALERT)


def prepare(spark: SparkSession) -> None:
    """Settings that the expressions rely on; they can be set on a running session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def analyze_paths(
    spark: SparkSession, paths: Iterable[Place], *, formats: Mapping[Place, str] | None = None, detectors: Sequence[Detector] | None = None,
    locations: Mapping | DataFrame | None = None, config: Config | None = None, own: Mapping[str, parsers.LogParser] | None = None,
) -> Analysis:
    """Each file is read on its own; one that cannot be read or told is a diagnostic and doesn't stop the others.
    `own` names parsers of further formats, or ones that stand in for built-in ones; `formats` gives files to them.
    release() of the result gives up the cached events."""
    prepare(spark)
    routed = files.route(spark, list(paths), formats, config.input_limits if config else None, own)
    events, bad = files.read(spark, routed, own)
    events = events.persist(StorageLevel.MEMORY_AND_DISK)  # six detectors read them
    found = detect(events, detectors, config, locations)
    return Analysis(events, found, bad, tuple(r.path for r in routed if r.format), tuple(r.path for r in routed if not r.format))


def analyze_directory(spark: SparkSession, directory: Place, **options) -> Analysis:
    return analyze_paths(spark, files.discover(directory), **options)


def analyze_ssh_file(spark: SparkSession, path: Place, parser: parsers.LogParser | None = None, **brute_force) -> tuple[Alert, ...]:
    """Brute-force alerts of one SSH log."""
    prepare(spark)
    events, _ = files.read(spark, [files.Routed(0, located(path), "ssh")], {"ssh": parser} if parser else None)
    return A.to_driver(BruteForce(**brute_force).detect(events))


def ordered_events(events: DataFrame) -> DataFrame:
    """By instant; equal ones in the order of files and lines."""
    return events.orderBy("timestamp", "file_ord", "line_no")


def parse_lines(spark: SparkSession, log_format: str, lines: Iterable[str], source: str = "<memory>", year: int = parsers.DEFAULT_YEAR) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of lines in memory."""
    prepare(spark)
    return parsers.parse_lines(spark, log_format, list(lines), source, year)


def write(analysis: Analysis, folder: str) -> None:
    """The scalable sink: events (by log type, so that detectors prune), alerts and diagnostics as Parquet."""
    analysis.events.write.mode("overwrite").partitionBy("log_type").parquet(f"{folder}/events")
    A.in_order(analysis.alerts).write.mode("overwrite").parquet(f"{folder}/alerts")
    analysis.diagnostics.write.mode("overwrite").parquet(f"{folder}/diagnostics")


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("detector", "severity").agg(F.count("*").alias("n"))
