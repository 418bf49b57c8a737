import datetime as dt

from pyspark.sql import functions as F

from aerocal.functions import clean_number
from aerocal.operators.timeaxis import resample
from aerocal.streaming.hourly import dedupe_stream, hourly_stream, with_watermark


def test_stream_means_equal_batch_for_closed_hours(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("s", base + dt.timedelta(minutes=7 * i), str(i % 5) if i % 6 else "nr") for i in range(120)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, text string")
    df.unionByName(df.limit(10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    clean = stream.withColumn("x", clean_number(F.col("text"))).drop("text")
    means = hourly_stream(dedupe_stream(with_watermark(clean), ["key"]), ["key"])
    query = (
        means.writeStream.outputMode("append").format("memory").queryName("hourly_means")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r.ts: r.x for r in spark.table("hourly_means").collect()}
    batch = resample(df.withColumn("x", clean_number(F.col("text"))).drop("text"), ["key"])
    want = {r.ts: r.x for r in batch.collect()}
    assert len(got) >= len(want) - 4
    assert all(want[t] == x for t, x in got.items())
