"""Streams give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from chunklake.operators import policy
from chunklake.plans import policies
from chunklake.streaming import feeds
from tests.conftest import SF, rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield spark
    spark.conf.set(name, before)


def _run(df, tmp_path, schema):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(str(tmp_path / "out"))


def _folder(df, tmp_path, files=3):
    df.repartitionByRange(files, "ms", "event_id").write.parquet(str(tmp_path / "in"))
    return df.sparkSession.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_quota_stream(rocks, tmp_path):
    df = policies.requests(rocks, SF).withColumn("delta", F.floor("value").cast("bigint") * F.when(F.col("event_id") % 2 == 0, -1).otherwise(1))
    got = _run(feeds.fold(_folder(df, tmp_path), feeds.Quota(), "long"), tmp_path, "bucket_key bigint, event_id bigint, ms bigint, bytes bigint")
    want = policy.quota(df, "bucket_key", ["ms", "event_id"], "delta")
    assert rows(got.select("event_id", "bytes")) == rows(want.select("event_id", "bytes"))


def test_lease_stream(rocks, tmp_path):
    df = policies.requests(rocks, SF).withColumn("node", F.col("event_type"))
    got = _run(feeds.fold(_folder(df, tmp_path), feeds.Leases(policies.TTL), "string"), tmp_path, "bucket_key bigint, event_id bigint, ms bigint, outcome string")
    want = policy.leases(df.withColumn("scope", F.col("bucket_key")), policies.TTL)
    assert rows(got.select("event_id", "outcome")) == rows(want.select("event_id", "outcome"))


def test_change_feed_and_replay(spark, tmp_path):
    log = spark.createDataFrame([(i, 5, 7, None, f"2024-01-01 00:00:{i:02d}") for i in range(1, 6)], "lsn bigint, ino bigint, op int, payload string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.unionByName(log.where("lsn = 2")).write.parquet(str(tmp_path / "log"))
    seen = []
    q = feeds.publish(feeds.fan_out(feeds.tail(spark, str(tmp_path / "log"), log.schema, after=3)), lambda df, _: seen.extend(r["lsn"] for r in df.collect()), str(tmp_path / "cp1"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [4, 5]
    once = feeds.replayed_once(feeds.tail(spark, str(tmp_path / "log"), log.schema), ["lsn"], "ts", "1 minute")
    assert _run(once.select("lsn"), tmp_path, "lsn bigint").count() == 5
