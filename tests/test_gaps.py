from pyspark.sql import functions as F

from gridloom.operators import telemetry as tm


def test_pauses_are_of_whole_microseconds(spark):
    """Pauses of the limit itself, one microsecond more, and a half of a millisecond, from many starts."""
    start, limit = 1_704_067_200_000_000, 259_200_000_000
    pauses = [limit, limit + 1, limit + 500]
    rows, want = [], []
    for k in range(600):
        us = start + k * 7_919_000_003
        rows += [(k, 2 * k, us), (k, 2 * k + 1, us + pauses[k % 3])]
        want += [(k, pauses[k % 3] // 1000 + (pauses[k % 3] % 1000 >= 500))] if k % 3 else []
    df = spark.createDataFrame(rows, "user long, event long, us long")
    for time in (F.col("us") / 1e6, F.timestamp_micros("us")):
        got = tm.stale_gaps(df.withColumn("t", time), "user", "t", "event", 259_200.0)
        assert sorted(tuple(r) for r in got.select("user", F.round(F.col("seconds") * 1000).cast("bigint")).collect()) == want
