import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators.successor import with_successor


def test_equals_one_big_lead_even_for_a_hot_key(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        user = 1 if rng.random() < 0.4 else rng.randrange(2, 40)
        # whole minutes make timestamp ties common
        rows.append((i, user, start + dt.timedelta(minutes=rng.randrange(0, 3000))))
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz").repartition(5)
    plain = F.lead("ts").over(Window.partitionBy("user").orderBy("ts", "id"))
    want = sorted(tuple(r) for r in df.select("id", plain.alias("n")).fillna(0).collect())
    for seconds in (60, 3600, 86400):
        found = with_successor(df, "user", "ts", "id", "n", bucket_seconds=seconds)
        got = sorted(tuple(r) for r in found.select("id", "n").collect())
        assert got == want
    assert set(found.columns) == {"id", "user", "ts", "n"}


def test_times_before_1970_and_last_rows(spark):
    rows = [(1, 1, dt.datetime(1969, 12, 31, 23, 59)), (2, 1, dt.datetime(1970, 1, 1, 0, 1))]
    rows += [(3, 2, dt.datetime(1970, 1, 1))]
    rows += [(4, None, dt.datetime(1970, 1, 1)), (5, None, dt.datetime(1970, 1, 1, 0, 0, 9))]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz")
    found = with_successor(df, "user", "ts", "id", "n").orderBy("id").collect()
    assert [r["n"] for r in found] == [rows[1][2], None, None, None, None]
