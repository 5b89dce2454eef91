"""The streaming form gives what the batch form gives, for complete windows."""

from datetime import datetime, timedelta

from tidemark.streaming.clusters import active_windows

SCHEMA = "ticker string, member string, value double, ts timestamp"


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2021, 1, 1)
    rows = [(f"T{k % 2}", f"m{k % 5}", float(k), start + timedelta(hours=7 * k)) for k in range(120)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("Z", "z", 0.0, start + timedelta(days=400))], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = active_windows(stream, 3, 3).writeStream.outputMode("append").format("memory").queryName("clusters").start()
    query.processAllAvailable()
    query.stop()
    want = active_windows(spark.createDataFrame(rows, SCHEMA), 3, 3)
    key = lambda r: (r["ticker"], r["start"], r["n_actors"], r["window_value"])
    found = sorted(map(key, spark.table("clusters").collect()))
    assert found and found == sorted(map(key, want.collect()))
