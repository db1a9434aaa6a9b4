"""Streams run to the end of what is there: against batch aggregates of all rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemex.streaming import jobs as J

QUERIES = entry.queries()


def batch_sessions(events):
    g = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("w.start", "w.end", "user_id", "n")


@pytest.mark.parametrize(("name", "job"), [("stream_rate_windows", J.rate_windows), ("stream_sessions", batch_sessions), ("stream_temporal_hyperedges", lambda e: J.tumbling_hyperedges(e).where("n >= 2"))])
@pytest.mark.parametrize("small", [True, False])
def test_streams_return_their_newest_windows(spark, sf, tmp_path, name, job, small):
    folder = str(tmp_path) if small else sf
    if small:
        rows = [(i, i % 2, 1_704_067_200 + 40 * i) for i in range(60)]  # close to each other up to the end
        spark.createDataFrame(rows, "event_id long, user_id long, at long").select("event_id", "user_id", F.timestamp_seconds("at").alias("ts")).write.parquet(f"{folder}/events.parquet")
    wanted = job(spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    got = QUERIES[name](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 0
