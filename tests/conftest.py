"""One local session and a builder for hand-written trips."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wayfare.sources.schemas import TRIPS, conform  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("wayfare-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MONDAY_NOON = dt.datetime(2024, 1, 8, 12, 0)

# A trip that every cleaning rule keeps.
GOOD = {
    "tpep_pickup_datetime": MONDAY_NOON,
    "tpep_dropoff_datetime": MONDAY_NOON + dt.timedelta(minutes=10),
    "passenger_count": 1.0,
    "trip_distance": 2.0,
    "RatecodeID": 1.0,
    "PULocationID": 50,
    "DOLocationID": 60,
    "fare_amount": 10.0,
    "tip_amount": 2.0,
    "total_amount": 13.0,
}

_TYPES = {f.name: f.dataType.simpleString() for f in TRIPS}


@pytest.fixture(scope="session")
def trips(spark):
    """``trips(a=.., b=..)`` per row: the good trip with some columns replaced.

    ``minutes`` moves the drop-off, ``VendorID`` serves as a row id.
    """

    def build(*changes: dict):
        rows = []
        for number, change in enumerate(changes):
            row = GOOD | {"VendorID": number} | {k: v for k, v in change.items() if k != "minutes"}
            if "minutes" in change:
                row["tpep_dropoff_datetime"] = row["tpep_pickup_datetime"] + dt.timedelta(minutes=change["minutes"])
            elif "tpep_pickup_datetime" in change and "tpep_dropoff_datetime" not in change:
                row["tpep_dropoff_datetime"] = row["tpep_pickup_datetime"] + dt.timedelta(minutes=10)
            rows.append(row)
        names = [*GOOD, "VendorID"]
        ddl = ", ".join(f"{n} {_TYPES[n]}" for n in names)
        frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)
        return conform(frame, TRIPS)

    return build


def column(df, name):
    return [r[name] for r in df.collect()]
