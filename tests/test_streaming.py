from tests.test_detectors import event, frame, requests
from tidewatch.model import EVENT
from tidewatch.streaming.buckets import bucket_counts


def test_stream_equals_batch(spark, tmp_path):
    events = requests([1, 4, 0, 3]) + [event(600, log_type="web", event_type="http_request", src_ip="9.9.9.9", bytes_sent=1), event(1, event_type="login_failure", src_ip="1.1.1.1")]
    df = frame(spark, events)
    df.write.parquet(f"{tmp_path}/in")
    stream = bucket_counts(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bucket_counts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda d: sorted(tuple(r) for r in d.where("src_ip <> '9.9.9.9'").collect())
    assert rows(spark.table("bucket_counts")) == rows(bucket_counts(df)) and len(rows(bucket_counts(df))) == 3
