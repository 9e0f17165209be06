"""Feature vectors of each source and time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.instants import bucket
from tidewatch.functions.text import truthy

#: The features in the order of a vector.
FEATURES = (
    "events_per_minute", "failed_login_ratio", "distinct_ports", "distinct_destination_hosts", "distinct_users", "bytes_sent_total",
    "status_1xx_ratio", "status_2xx_ratio", "status_3xx_ratio", "status_4xx_ratio", "status_5xx_ratio", "status_other_ratio",
)


def status_class(status: Column) -> Column:
    """1 to 5 for three digits from 100 to 599, else 6."""
    code = F.when(status.rlike(r"^[0-9]{3}$"), status.cast("int"))
    return F.when(code.between(100, 599), F.floor(code / 100)).otherwise(6).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def features(events: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """source_ip (null: grouped by log type instead), log_types (sorted), bucket_start and the features. One
    aggregation with partial sums; distinct counts are exact. Rows are in no order: see in_order."""
    if isinstance(bucket_seconds, bool) or not isinstance(bucket_seconds, int) or bucket_seconds <= 0:
        raise ValueError("bucket_seconds must be a positive integer")
    ip = F.when(truthy(F.col("src_ip")), F.col("src_ip"))
    own = events.select(
        ip.alias("source_ip"), F.when(ip.isNull(), F.col("log_type")).alias("apart"), bucket(F.col("timestamp"), bucket_seconds).alias("bucket_start"),
        "log_type", "event_type", "dst_port", F.nullif("dst_ip", F.lit("")).alias("host"), F.nullif("user", F.lit("")).alias("who"), "bytes_sent",
        F.when((F.col("log_type") == "web") & F.col("status").isNotNull(), status_class(F.col("status"))).alias("class"),
    )
    logins = F.count_if(F.col("event_type").isin("login_success", "login_failure"))
    web = F.count("class")
    double = lambda c: c.cast("double")
    values = [
        F.count("*") * F.lit(60.0) / bucket_seconds, ratio(F.count_if(F.col("event_type") == "login_failure"), logins), double(F.count_distinct("dst_port")), double(F.count_distinct("host")),
        double(F.count_distinct("who")), double(F.coalesce(F.sum("bytes_sent"), F.lit(0))), *(ratio(F.count_if(F.col("class") == i), web) for i in range(1, 7)),
    ]
    out = own.groupBy("source_ip", "apart", "bucket_start").agg(F.array_sort(F.collect_set("log_type")).alias("log_types"), *(v.alias(n) for v, n in zip(values, FEATURES)))
    return out.select("source_ip", "log_types", "bucket_start", *FEATURES)


def in_order(vectors: DataFrame) -> DataFrame:
    """Vectors by source, log type (of those without a source) and bucket; for what is shown or written."""
    return vectors.orderBy(F.coalesce("source_ip", F.lit("")), F.when(F.col("source_ip").isNull(), F.array_join("log_types", ",")).otherwise(""), "bucket_start")
