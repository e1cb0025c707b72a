from datetime import datetime

from pyspark.sql import functions as F

from driftline.functions.times import from_micros, micros


def test_round_trip_in_any_zone(spark):
    times = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(2023, 3, 26, 2, 30, 0, 123456), datetime(2023, 10, 29, 2, 30), None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz").select("i", "t", micros("t").alias("m")).withColumn("back", from_micros(F.col("m")))
            rows = sorted(df.collect())
            assert [r.back for r in rows] == times
            assert [r.m for r in rows][:-1] == [round((t - datetime(1970, 1, 1)).total_seconds() * 1e6) for t in times[:-1]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
