"""The rule and statistics detectors; each turns an event frame into an alert frame.

Groups are emitted in the order in which they first appear among the events that a detector
reads, as `ord` records. The relational cores are in frames.py and here as functions of plain
columns, so that they run on any table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import network
from tidewatch.functions.instants import bucket, iso_text
from tidewatch.functions.text import truthy
from tidewatch.operators import frames
from tidewatch.operators.alerts import alerts, evidence, union

ORDER = ["us", "file_ord", "line_no"]


class Detector(Protocol):
    """Anything with detect(events) -> alerts can be given to the analysis."""

    def detect(self, events: DataFrame) -> DataFrame: ...


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("us", F.unix_micros("timestamp"))


def _seq(*parts: str | Column) -> Column:
    """An ord: longs that compare one after the other."""
    return F.array(*((F.col(p) if isinstance(p, str) else p).cast("long") for p in parts))


def _seen(c: str = "seen") -> list[Column]:
    return [F.col(f"{c}.{x}") for x in ORDER]


def _at(us: str) -> Column:
    return F.timestamp_micros(F.col(us))


@dataclass(frozen=True)
class BruteForce:
    """Repeated failed SSH logins of one user from one source in a rolling window."""

    threshold: int = 5
    window_minutes: float = 5

    def __post_init__(self) -> None:
        _check(self.threshold >= 1, "threshold must be at least 1")
        _check(self.window_minutes > 0, "window_minutes must be positive")

    def detect(self, events: DataFrame) -> DataFrame:
        keys = ["src_ip", "user"]
        tries = _timed(events).where((F.col("log_type") == "ssh") & (F.col("event_type") == "login_failure") & (F.col("status") == "failure") & truthy(F.col("src_ip"))).select(*keys, *ORDER)
        tries = frames.first_seen(frames.groups_with(tries, keys, self.threshold), keys, ORDER)
        hit = frames.first_crossing(tries, keys, ORDER, self.threshold, round(self.window_minutes * 60_000_000))
        n = F.lit(self.threshold)
        return alerts(
            hit, severity=F.lit("HIGH"), title="Potential brute-force attack detected",
            summary=F.concat(F.lit(f"{self.threshold} failed SSH login attempts were observed from "), "src_ip", F.lit(".")),
            evidence=evidence(observed_count=n, threshold=n, source_ip=F.col("src_ip"), username=F.col("user"), window_minutes=F.lit(float(self.window_minutes)), window_start=_at("first_us"), window_end=_at("us")),
            actions=("Review successful logins from this source", "Apply an appropriate network block or rate limit after review", "Prefer key-based authentication over passwords"),
            source_ips=F.array("src_ip"), start=_at("first_us"), end=_at("us"), detector="brute_force", confidence="high", ord=_seq(*_seen()),
        )


def port_frames(df: DataFrame, source: str, port: str, host: str, status: str, order: Sequence[str], window_us: int, least: int, extra: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """Rows whose frame holds at least `least` distinct ports, with ports, hosts, accepted, denied, n and first_us of the frame.

    pieces (here and below): into how many a window is cut; None: as many as the busiest source needs, counted first."""
    some = frames.groups_with(df.select(source, *order, *extra, port, host, status), [source], least, F.col(port))
    counts = {"accepted": F.col(status) == "accepted", "denied": F.col(status).isin("denied", "rejected", "dropped"), "n": F.lit(True)}
    framed = frames.rolling(some, [source], order, window_us, counts, {"ports": F.col(port), "hosts": F.nullif(host, F.lit(""))}, pieces=pieces or frames.pieces_for(df, [source], order[0], window_us))
    return framed.where(F.col("ports") >= least).select(source, *order, *extra, "ports", "hosts", "accepted", "denied", "n", "first_us")


@dataclass(frozen=True)
class PortScan:
    """Many destination ports from one source in a rolling window."""

    window_seconds: float = 60
    medium_ports: int = 10
    high_ports: int = 25
    critical_ports: int = 50
    critical_hosts: int = 2
    critical_denied_ratio: float = 0.8

    def __post_init__(self) -> None:
        _check(self.window_seconds > 0, "window_seconds must be positive")
        _check(1 <= self.medium_ports <= self.high_ports <= self.critical_ports, "port thresholds must be positive and ordered")
        _check(self.critical_hosts >= 1, "critical_hosts must be positive")
        _check(0 <= self.critical_denied_ratio <= 1, "critical_denied_ratio must be between 0 and 1")

    def level(self) -> Column:
        """3 critical, 2 high, 1 medium."""
        critical = (F.col("ports") >= self.critical_ports) & (F.col("hosts") >= self.critical_hosts) & (F.col("denied") / F.col("n") >= self.critical_denied_ratio)
        return F.when(critical, 3).when(F.col("ports") >= self.high_ports, 2).otherwise(1)

    def detect(self, events: DataFrame) -> DataFrame:
        seen = _timed(events).where((F.col("log_type") == "firewall") & (F.col("event_type") == "network_connection") & truthy(F.col("src_ip")) & F.col("dst_port").isNotNull())
        seen = frames.first_seen(seen.select("src_ip", "dst_port", "dst_ip", "status", *ORDER), ["src_ip"], ORDER)
        hits = port_frames(seen, "src_ip", "dst_port", "dst_ip", "status", ORDER, round(self.window_seconds * 1_000_000), self.medium_ports, ["seen"]).withColumn("level", self.level())
        best = frames.best_first(hits, ["src_ip"], [F.col("level").desc()], ORDER)
        name = F.element_at(F.array(F.lit("medium"), F.lit("high"), F.lit("critical")), F.col("level"))
        return alerts(
            best, severity=F.upper(name), title="Potential port scan detected",
            summary=F.concat(F.col("ports").cast("string"), F.lit(" distinct destination ports were contacted by "), "src_ip", F.lit(".")),
            evidence=evidence(source_ip=F.col("src_ip"), distinct_destination_ports=F.col("ports"), distinct_destination_hosts=F.col("hosts"), time_start=_at("first_us"), time_end=_at("us"), accepted_count=F.col("accepted"), denied_rejected_count=F.col("denied"), denied_ratio=F.col("denied") / F.col("n"), threshold_crossed=name, window_seconds=F.lit(self.window_seconds)),
            actions=("Review the source activity and affected destination hosts", "Apply an appropriate network block or rate limit after review"),
            source_ips=F.array("src_ip"), start=_at("first_us"), end=_at("us"), detector="port_scan", confidence="high", ord=_seq(*_seen()),
        )


def failures_before(df: DataFrame, source: str, user: str, failed: Column, order: Sequence[str], window_us: int, least: int, extra: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """Rows that are not failures and have at least `least` failures in their frame, with failures, first_us and last_user of those."""
    some = frames.groups_with(df.select(source, user, *order, *extra, failed.alias("__failed")), [source], least + 1)
    framed = frames.rolling(some, [source], order, window_us, {"failures": F.lit(True)}, latest={"last_user": F.col(user)}, of=F.col("__failed"), pieces=pieces or frames.pieces_for(df, [source], order[0], window_us))
    hit = framed.where(~F.col("__failed") & (F.col("failures") >= least))
    return hit.select(source, user, *order, *extra, "failures", "first_us", "last_user")


def many_users(df: DataFrame, source: str, user: str, order: Sequence[str], window_us: int, least: int, extra: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """Of each source the first row whose frame holds at least `least` distinct users (nulls are none), with users (sorted) and first_us.

    Their number grows by one a row at most, so it equals `least` there: only the users of that one frame are collected."""
    some = frames.groups_with(df.select(source, *order, *extra, user), [source], least, F.col(user))
    framed = frames.rolling(some, [source], order, window_us, distinct={"n_users": F.col(user)}, pieces=pieces or frames.pieces_for(df, [source], order[0], window_us)).where(F.col("n_users") >= least)
    first = frames.best_first(framed.drop(user), [source], [], order)
    ends = F.struct(*(F.col(f"h.{x}") for x in order))
    inside = (F.col("e.__source") == F.col(f"h.{source}")) & (F.col(f"e.{order[0]}") >= F.col("h.first_us")) & (F.struct(*(F.col(f"e.{x}") for x in order)) <= ends)
    theirs = some.withColumnRenamed(source, "__source").alias("e").join(first.alias("h"), inside).groupBy(F.col("e.__source")).agg(F.array_sort(F.collect_set(f"e.{user}")).alias("users"))
    return first.join(theirs, F.col(source) == F.col("__source")).select(source, *order, *extra, "users", "first_us")


def off_hours(t: Column, start: int, end: int) -> Column:
    """On a weekend, or before the hour `start`, or from the hour `end` on; in UTC."""
    return (F.weekday(t) >= 5) | (F.hour(t) < start) | (F.hour(t) >= end)


@dataclass(frozen=True)
class SuspiciousLogin:
    """Logins after bursts of failures, of many accounts from one source and, if asked for, off hours."""

    post_burst_window_minutes: float = 10
    failure_burst_threshold: int = 3
    multi_account_threshold: int = 3
    multi_account_window_minutes: float = 15
    enable_off_hours: bool = False
    normal_hours_start: int = 8
    normal_hours_end: int = 18

    def __post_init__(self) -> None:
        _check(self.post_burst_window_minutes > 0, "post_burst_window_minutes must be positive")
        _check(self.failure_burst_threshold >= 1, "failure_burst_threshold must be at least 1")
        _check(self.multi_account_threshold >= 1, "multi_account_threshold must be at least 1")
        _check(self.multi_account_window_minutes > 0, "multi_account_window_minutes must be positive")
        _check(0 <= self.normal_hours_start < self.normal_hours_end <= 24, "normal hours must satisfy 0 <= start < end <= 24")

    def detect(self, events: DataFrame) -> DataFrame:
        logins = _timed(events).where(F.col("event_type").isin("login_success", "login_failure") & truthy(F.col("src_ip"))).select("src_ip", "user", "event_type", *ORDER)
        found = [self.post_burst(logins), self.multi_account(logins)] + ([self.at_odd_hours(logins)] if self.enable_off_hours else [])
        return union(events.sparkSession, found)

    def post_burst(self, logins: DataFrame) -> DataFrame:
        seen = frames.first_seen(logins, ["src_ip"], ORDER)
        hit = failures_before(seen, "src_ip", "user", F.col("event_type") == "login_failure", ORDER, round(self.post_burst_window_minutes * 60_000_000), self.failure_burst_threshold, ["seen"])
        name = F.when(truthy(F.col("user")), F.col("user")).otherwise(F.col("last_user"))
        return alerts(
            hit, severity=F.when(F.col("failures") >= 2 * self.failure_burst_threshold, "CRITICAL").otherwise("HIGH"), title="Successful login after failure burst",
            summary=F.concat(F.lit("A successful login for user '"), F.coalesce(name, F.lit("None")), F.lit("' was observed from "), "src_ip", F.lit(" following "), F.col("failures").cast("string"), F.lit(" failed authentication attempts.")),
            evidence=evidence(signal=F.lit("post_burst_success"), source_ip=F.col("src_ip"), username=name, failed_attempts_count=F.col("failures"), threshold=F.lit(self.failure_burst_threshold), window_minutes=F.lit(self.post_burst_window_minutes), success_time=_at("us"), first_failure_time=_at("first_us")),
            actions=("Review recent activity for potential account compromise", "Verify whether the authentication was authorized by the user", "Rotate user credentials or access keys if compromised", "Apply rate limiting or temporary IP blocking on repeated failures"),
            source_ips=F.array("src_ip"), start=_at("first_us"), end=_at("us"), detector="suspicious_login", confidence="high", ord=_seq(*_seen(), *ORDER),
        )

    def multi_account(self, logins: DataFrame) -> DataFrame:
        good = frames.first_seen(logins.where((F.col("event_type") == "login_success") & truthy(F.col("user"))), ["src_ip"], ORDER)
        hit = many_users(good, "src_ip", "user", ORDER, round(self.multi_account_window_minutes * 60_000_000), self.multi_account_threshold, ["seen"])
        n = F.size("users")
        return alerts(
            hit, severity=F.lit("HIGH"), title="Multiple account logins from single source",
            summary=F.concat(F.lit("Source "), "src_ip", F.lit(" successfully logged into "), n.cast("string"), F.lit(f" distinct accounts within {self.multi_account_window_minutes} minutes.")),
            evidence=evidence(signal=F.lit("multi_account_login"), source_ip=F.col("src_ip"), distinct_users_count=n, users=F.col("users"), threshold=F.lit(self.multi_account_threshold), window_minutes=F.lit(self.multi_account_window_minutes)),
            actions=("Investigate source IP for potential credential stuffing or account takeover", "Review access logs for all targeted user accounts", "Enforce multi-factor authentication across all affected accounts"),
            source_ips=F.array("src_ip"), start=_at("first_us"), end=_at("us"), detector="suspicious_login", confidence="high", ord=_seq(*_seen()),
        )

    def at_odd_hours(self, logins: DataFrame) -> DataFrame:
        t = _at("us")
        hit = logins.where((F.col("event_type") == "login_success") & off_hours(t, self.normal_hours_start, self.normal_hours_end))
        return alerts(
            hit, severity=F.lit("MEDIUM"), title="Off-hours login detected",
            summary=F.concat(F.lit("User '"), F.coalesce("user", F.lit("None")), F.lit("' logged in outside normal business hours from "), "src_ip", F.lit(".")),
            evidence=evidence(signal=F.lit("off_hours_login"), source_ip=F.col("src_ip"), username=F.col("user"), timestamp=t, normal_hours=F.lit(f"{self.normal_hours_start:02d}:00-{self.normal_hours_end:02d}:00"), is_weekend=F.weekday(t) >= 5),
            actions=("Confirm with the user that the off-hours access was legitimate", "Check for any abnormal activity or commands executed during this session"),
            source_ips=F.array("src_ip"), start=t, end=t, detector="suspicious_login", confidence="medium", ord=_seq(*ORDER),
        )


@dataclass(frozen=True)
class Location:
    latitude: float
    longitude: float
    label: str


#: The places of the synthetic logs.
SYNTHETIC_LOCATIONS = {"192.0.2.201": (40.7128, -74.0060, "Synthetic North America"), "198.51.100.201": (51.5074, -0.1278, "Synthetic Europe")}


def location_rows(locations: Mapping[str, Location | Sequence]) -> list[tuple[str, float, float, str]]:
    """The valid entries of a mapping from IP to a location or (latitude, longitude, label)."""
    out = []
    for ip, value in locations.items():
        try:
            x = value if isinstance(value, Location) else Location(*value)
            ok = math.isfinite(x.latitude) and math.isfinite(x.longitude) and abs(x.latitude) <= 90 and abs(x.longitude) <= 180 and isinstance(x.label, str) and bool(x.label)
        except TypeError:
            continue
        if ok:
            out.append((ip, float(x.latitude), float(x.longitude), x.label))
    return out


def travel_pairs(logins: DataFrame, user: str, ip: str, order: Sequence[str], places: DataFrame) -> DataFrame:
    """Consecutive logins of a user, both at a known place: user, first_ip, second_ip, first_us, second_us, the two
    places' labels, elapsed seconds and distance. A login at an unknown place still stands between its
    neighbours: places are joined after pairing. places: ip, lat, lon, label; joins choose by its size."""
    w = frames.ordered([user], order)
    us = order[0]
    pairs = logins.withColumn("first_ip", F.lag(ip).over(w)).withColumn("first_us", F.lag(us).over(w)).where("first_us is not null").withColumnRenamed(ip, "second_ip").withColumn("second_us", F.col(us))
    for side in ("first", "second"):
        named = places.select(F.col("ip").alias(f"{side}_ip"), *(F.col(x).alias(f"{side}_{x}") for x in ("lat", "lon", "label")))
        pairs = pairs.join(named, f"{side}_ip")
    return pairs.withColumn("elapsed", (F.col("second_us") - F.col("first_us")) / 1_000_000).withColumn("km", network.distance_km(F.col("first_lat"), F.col("first_lon"), F.col("second_lat"), F.col("second_lon")))


@dataclass(frozen=True)
class ImpossibleTravel:
    """Consecutive logins of a user at places too far apart for the time between them."""

    locations: Mapping[str, Location | Sequence] | DataFrame = field(default_factory=lambda: dict(SYNTHETIC_LOCATIONS))
    max_speed_kmh: float = 900.0
    min_elapsed_minutes: float = 0.0
    min_distance_km: float = 100.0
    ignore_private_ips: bool = False

    def __post_init__(self) -> None:
        _check(self.max_speed_kmh > 0 and math.isfinite(self.max_speed_kmh), "max_speed_kmh must be a finite positive number")
        _check(self.min_elapsed_minutes >= 0 and math.isfinite(self.min_elapsed_minutes), "min_elapsed_minutes must be a finite non-negative number")
        _check(self.min_distance_km >= 0 and math.isfinite(self.min_distance_km), "min_distance_km must be a finite non-negative number")

    def places(self, spark) -> DataFrame:
        """A mapping, or a frame of ip, lat, lon and label for one that is too large for the driver."""
        if isinstance(self.locations, DataFrame):
            return self.locations.where("lat between -90 and 90 and lon between -180 and 180 and label <> ''").dropDuplicates(["ip"])
        return spark.createDataFrame(location_rows(self.locations), "ip string, lat double, lon double, label string")

    def detect(self, events: DataFrame) -> DataFrame:
        logins = _timed(events).where((F.col("event_type") == "login_success") & (F.col("status") == "success") & truthy(F.col("user")) & truthy(F.col("src_ip"))).select("user", "src_ip", *ORDER)
        if self.ignore_private_ips:
            logins = logins.join(network.public_ips(logins, "src_ip"), "src_ip", "left_semi")
        pairs = travel_pairs(frames.first_seen(logins, ["user"], ORDER), "user", "src_ip", ORDER, self.places(events.sparkSession))
        speed = F.col("km") / (F.col("elapsed") / 3600)
        hit = pairs.where((F.col("elapsed") > 0) & (F.col("elapsed") >= self.min_elapsed_minutes * 60) & (F.col("km") >= self.min_distance_km)).withColumn("kmh", speed).where(F.col("kmh") > self.max_speed_kmh)
        return alerts(
            hit, severity=F.lit("MEDIUM"), title="Potential impossible travel detected",
            summary=F.concat(F.lit("User '"), "user", F.lit("' logged in from approximate locations "), "first_label", F.lit(" and "), "second_label", F.format_string(" at an implied speed of %.1f km/h.", "kmh")),
            evidence=evidence(username=F.col("user"), first_source_ip=F.col("first_ip"), second_source_ip=F.col("second_ip"), first_login_timestamp=_at("first_us"), second_login_timestamp=_at("second_us"), first_location=F.col("first_label"), second_location=F.col("second_label"), distance_km=F.col("km"), elapsed_seconds=F.col("elapsed"), implied_speed_kmh=F.col("kmh"), maximum_plausible_speed_kmh=F.lit(self.max_speed_kmh), confidence=F.lit("low"), geolocation_note=F.lit("Locations are synthetic and approximate; IP geolocation does not establish physical location with certainty.")),
            actions=("Review both login events and verify whether the activity was authorized", "Check VPN, proxy, and corporate egress usage before taking action", "Review related authentication activity for the account"),
            source_ips=F.array("first_ip", "second_ip"), start=_at("first_us"), end=_at("second_us"), detector="impossible_travel", confidence="low", ord=_seq(*_seen(), *ORDER),
        )


LEAST_SPREAD = 1e-9  # a fixed value: what stands for a spread of zero


def deviations(counts: DataFrame, keys: Sequence[str], at: str, n: str, method: str, least: int) -> DataFrame:
    """Buckets with at least `least` earlier ones in their group: base_n, base (mean or median of those) and score.

    Mean and deviation come from exact integer sums, quartiles are interpolated between the inclusive ranks."""
    w = frames.expanding(counts, keys, [at])
    k = F.count("*").over(w)
    if method == "zscore":
        s1, s2 = F.sum(n).over(w), F.sum(F.col(n) * F.col(n)).over(w)
        based = counts.select("*", k.alias("base_n"), (s1 / k).alias("base"), (F.sqrt((k * s2 - s1 * s1).cast("double")) / k).alias("spread"))
    else:
        ranked = frames.prefix_quantiles(counts, keys, [at], n, (0.25, 0.5, 0.75)).withColumn("base_n", F.row_number().over(frames.ordered(keys, [at])) - 1)
        based = ranked.select("*", F.col("q")[1].alias("base"), (F.col("q")[2] - F.col("q")[0]).alias("spread")).drop("q")
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(LEAST_SPREAD)
    return based.where(F.col("base_n") >= least).withColumn("score", (F.col(n) - F.col("base")) / spread).drop("spread")


def bucket_metrics(events: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Of each group and bucket n events, their bytes, distinct paths, the order columns of its first event, and the
    counts of statuses as JSON text, statuses in the order in which they occur. Needs the order's columns."""
    at = [*keys, "bucket"]
    seen = events.withColumn("bucket", bucket(F.col("timestamp"), seconds))
    per_status = seen.groupBy(*at, "status").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.min(F.struct(*ORDER)).alias("first"))
    paths = seen.where(truthy(F.col("path"))).groupBy(*at).agg(F.count_distinct("path").alias("paths"))
    named = F.array_sort(F.collect_list(F.when(truthy(F.col("status")), F.struct("first", "status", "n"))))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    text = F.concat(F.lit("{"), F.array_join(F.transform(named, lambda x: F.concat(quoted(x["status"]), F.lit(":"), x["n"].cast("string"))), ","), F.lit("}"))
    counts = per_status.groupBy(*at).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), text.alias("statuses"), F.min("first").alias("first"))
    return counts.join(paths, at, "left").select(*at, "n", "bytes", F.coalesce("paths", F.lit(0)).alias("paths"), "statuses", *(F.col(f"first.{x}").alias(x) for x in ORDER))


@dataclass(frozen=True)
class UnusualTraffic:
    """Buckets of traffic far above what the group's earlier buckets show."""

    bucket_seconds: int = 300
    min_baseline_buckets: int = 5
    statistical_method: str = "zscore"
    zscore_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    grouping: str = "source_ip"
    min_observed_volume: int = 1
    event_types: Sequence[str] = ("http_request", "network_connection")
    high_multiplier: float = 1.5
    critical_multiplier: float = 2.5

    KEYS = {"source_ip": ["src_ip"], "service": ["log_type"], "source_ip_service": ["src_ip", "log_type"]}

    def __post_init__(self) -> None:
        _check(self.bucket_seconds > 0, "bucket_seconds must be positive")
        _check(self.min_baseline_buckets >= 2, "min_baseline_buckets must be at least 2")
        _check(self.statistical_method in ("zscore", "iqr"), "statistical_method must be one of ['iqr', 'zscore']")
        _check(self.zscore_threshold > 0, "zscore_threshold must be positive")
        _check(self.iqr_multiplier > 0, "iqr_multiplier must be positive")
        _check(self.grouping in self.KEYS, f"grouping must be one of {sorted(self.KEYS)}")
        _check(self.min_observed_volume >= 0, "min_observed_volume must be non-negative")
        _check(bool(self.event_types), "event_types must not be empty")
        _check(self.high_multiplier > 1, "high_multiplier must be greater than 1")
        _check(self.critical_multiplier > self.high_multiplier, "critical_multiplier must be greater than high_multiplier")

    def detect(self, events: DataFrame) -> DataFrame:
        keys = self.KEYS[self.grouping]
        seen = _timed(events).where(F.col("event_type").isin(*self.event_types))
        for k in keys:
            seen = seen.where(truthy(F.col(k)))
        counts = frames.first_seen(bucket_metrics(seen, keys, self.bucket_seconds), keys, ORDER)
        limit = self.zscore_threshold if self.statistical_method == "zscore" else self.iqr_multiplier
        hit = deviations(counts, keys, "bucket", "n", self.statistical_method, self.min_baseline_buckets).where((F.col("n") >= self.min_observed_volume) & (F.col("score") >= limit))
        hit = hit.withColumn("ends", F.timestamp_micros(F.unix_micros("bucket") + self.bucket_seconds * 1_000_000))
        ratio = F.col("score") / limit
        names = {"source_ip": F.col("src_ip")} if self.grouping == "source_ip" else {"service": F.col("log_type")} if self.grouping == "service" else {"source_ip": F.col("src_ip"), "service": F.col("log_type")}
        facts = evidence(
            **names, grouping=F.lit(self.grouping), time_bucket_start=F.col("bucket"), time_bucket_end=F.col("ends"), bucket_seconds=F.lit(self.bucket_seconds), observed_count=F.col("n"), baseline_statistic=F.col("base"), baseline_sample_count=F.col("base_n"),
            statistical_method=F.lit(self.statistical_method), score=F.col("score"), threshold=F.lit(limit), bytes_sent_total=F.col("bytes"), distinct_paths=F.col("paths"),
        )
        whole = F.concat(F.regexp_replace(facts, r"\}$", ""), F.lit(',"status_code_distribution":'), "statuses", F.lit("}"))
        return alerts(
            hit, severity=F.when(ratio >= self.critical_multiplier, "CRITICAL").when(ratio >= self.high_multiplier, "HIGH").otherwise("MEDIUM"), title="Unusual traffic pattern detected",
            summary=F.concat(F.lit("Traffic for "), F.concat_ws(" / ", *keys), F.lit(" in the bucket starting at "), iso_text(F.col("bucket")), F.lit(" was "), F.col("n").cast("string"), F.format_string(" events, compared with a baseline of %.2f over ", "base"), F.col("base_n").cast("string"), F.format_string(f" prior buckets ({self.statistical_method} score %.2f vs threshold {limit:.2f}).", "score")),
            evidence=whole,
            actions=("Compare the traffic change against known application or deployment changes", "Inspect the high-volume endpoints or hosts involved for a legitimate cause", "Apply rate limiting only after confirming the traffic is not authorized activity"),
            source_ips=F.array("src_ip") if "src_ip" in keys else F.array().cast("array<string>"), start=F.col("bucket"), end=F.col("ends"), detector="unusual_traffic", confidence="low", ord=_seq(*_seen(), F.unix_micros("bucket")),
        )
