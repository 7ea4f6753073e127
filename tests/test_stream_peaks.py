"""The stream of peaks against the batch rule, with rows out of order over several micro-batches."""

import datetime
import random

from fluvial.streaming import windows

START = datetime.datetime(2024, 3, 1)


def plain(rows, threshold, gap, end):
    """Clusters of (second, value) rows that have ended before ``end``."""
    out = []
    for t, x in sorted(r for r in rows if r[1] is not None and r[1] > threshold):
        if out and t - out[-1][2] <= gap:
            c = out[-1]
            out[-1] = [max(c[0], x), t if x >= c[0] else c[1], t, c[3] + 1]
        else:
            out.append([x, t, t, 1])
    return sorted(tuple(c) for c in out if c[2] + gap < end)


def test_shuffled_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = {k: [(t, None if t % 17 == 0 else float(rng.randint(0, 9))) for t in range(0, 3600, 5)] for k in "ab"}
    every = sorted(((t, k, x) for k, v in rows.items() for t, x in v), key=lambda r: r[0] + rng.uniform(0, 55))  # at most a minute late
    at = lambda t: START + datetime.timedelta(seconds=t)
    schema = "event_type string, ts timestamp, value double"
    for b in range(6):
        part = every[b * len(every) // 6 : (b + 1) * len(every) // 6]
        spark.createDataFrame([(k, at(t), x) for t, k, x in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    windows.use_rocks(spark)
    try:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
        out = windows.peaks(events, 7.0, "20 seconds", "60 seconds")
        run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        batches = run.lastProgress["batchId"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    second = lambda t: round((t - START).total_seconds())
    assert batches >= 5
    for k, v in rows.items():
        mine = sorted((r["peak"], second(r["at"]), second(r["last"]), r["n"]) for r in got if r["event_type"] == k)
        assert mine == plain(v, 7.0, 20, 3595 - 60) and len(mine) > 20
