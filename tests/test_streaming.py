"""Streams in several batches, with late, invalid and repeated rows."""

import uuid

from pyspark.sql import functions as F

from quakelode.streaming import catalog

SCHEMA = "day int, latitude double, longitude double, depth_km double, magnitude double"


def stream(spark, tmp_path, batches):
    path = f"{tmp_path}/in-{uuid.uuid4().hex}"
    for rows in batches:
        df = spark.createDataFrame(rows, SCHEMA).select(F.timestamp_seconds(F.col("day") * 86400).alias("time"), "latitude", "longitude", "depth_km", "magnitude")
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_accounts_for_what_it_drops(spark, tmp_path):
    one = (5, 40.0, -80.0, 1.0, 2.0)
    batches = [
        [one, one, (10, 40.0, -80.0, 1.0, 2.0), (6, 95.0, -80.0, 1.0, 2.0), (7, 40.0, -80.0, 1.0, None)],  # a repeat, two invalid
        [(9, 40.0, -80.0, 1.0, 2.0), (3, 40.0, -80.0, 1.0, 2.0), (20, 40.0, -80.0, 1.0, 2.0), (10, 40.0, -80.0, 1.0, 2.0)],  # a repeat; no watermark yet
        # rows are held against the watermark of the batch before last, day 8: one late, one just on it; and a repeat
        [(19, 40.0, -80.0, 1.0, 2.0), (18, 40.0, -80.0, 1.0, 2.0), (7, 40.0, -80.0, 1.0, 2.0), (8, 40.0, -80.0, 1.0, 2.0), (9, 40.0, -80.0, 1.0, 2.0), (21, 40.0, -80.0, 1.0, 2.0)],
    ]
    query = catalog.to_table(catalog.ingest(stream(spark, tmp_path, batches)), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    kept = sorted(r.day for r in spark.read.parquet(f"{tmp_path}/out").select((F.unix_timestamp("time") / 86400).cast("int").alias("day")).collect())
    assert kept == [3, 5, 9, 10, 18, 19, 20, 21]
    assert catalog.account(query) == {"rows": 15, "invalid": 2, "late": 2, "kept": 8, "repeated": 3}
    assert max(s.numRowsTotal for s in query.recentProgress[-1].stateOperators) < 6  # old keys are gone


def test_rolling_counts_of_several_batches(spark, tmp_path):
    days = [[0, 0, 1, 3], [2, 5, 40], [39, 80]]
    batches = [[(d, 40.1, -80.1, 1.0, 2.0) for d in ds] for ds in days]
    query = catalog.to_table(catalog.rolling_counts(stream(spark, tmp_path, batches), late="45 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    got = {r.window_start // 86400: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    flat = [d for ds in days for d in ds]  # none is late, as the watermark trails by 45 days
    want = {s: n for s in range(-29, 81) if (n := sum(s <= d < s + 30 for d in flat)) and s + 30 <= 80 - 45}
    assert {s: n for s, n in got.items() if s in want} == want and all(n == sum(s <= d < s + 30 for d in flat) for s, n in got.items())


def test_each_year_of_the_stream_is_one_batch_of_several_files(spark, sf, monkeypatch):
    from quakelode.plans import measurements

    monkeypatch.setattr(measurements, "STREAM_ROWS", 20)
    seen = []
    events = measurements._stream(spark, sf).where("event_id % 35 <> 34")
    query = events.writeStream.foreachBatch(lambda df, k: seen.append((df.rdd.getNumPartitions(), sorted({r.y for r in df.where("depth_km < 1000").select(F.year("time").alias("y")).distinct().collect()})))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [y for _, y in seen] == [[1995 + k] for k in range(len(seen))]
    assert len(seen) == 7 and max(n for n, _ in seen) > 1
