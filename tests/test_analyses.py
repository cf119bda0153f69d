import datetime as dt

import pytest

from tests.conftest import column
from wayfare.plans.analyses import ANALYSES, FAMILIES, Analysis, register
from wayfare.roles import TLC


@pytest.fixture(scope="module")
def zones(spark):
    rows = [
        (1, "EWR", "Newark Airport", "EWR"),
        (132, "Queens", "JFK Airport", "Airports"),
        (50, "Manhattan", "Clinton West", "Yellow Zone"),
        (60, "Bronx", "Crotona Park", "Boro Zone"),
    ]
    return spark.createDataFrame(rows, "location_id int, borough string, zone string, service_zone string")


def frame(key, df, zones=None):
    return [tuple(r) for r in ANALYSES[key](df, TLC, zones).frame.collect()]


def metrics(key, df, zones=None):
    return ANALYSES[key](df, TLC, zones).metrics.first().asDict()


def at(*moments):
    return [{"tpep_pickup_datetime": m} for m in moments]


def test_registry():
    assert len(ANALYSES) == 25
    assert {a.family for a in ANALYSES.values()} == set(FAMILIES.values())
    assert all(a.needs for a in ANALYSES.values())
    with pytest.raises(ValueError, match="already registered"):
        register(Analysis("rev.total", "Revenue", "again", ("total",), lambda df, roles: None))


def test_demand(trips):
    sun, mon = dt.datetime(2024, 1, 7, 23), dt.datetime(2024, 1, 8, 9)
    df = trips(*at(sun, mon, sun, dt.datetime(2025, 2, 1, 9)))
    assert frame("demand.by_hour", df) == [(9, 2), (23, 2)]
    assert metrics("demand.by_hour", df) == {"total_trips": 4, "peak_hour": 9}  # tie: the earlier
    assert frame("demand.by_weekday", df) == [("Sun", 2), ("Mon", 1), ("Sat", 1)]
    assert metrics("demand.by_weekday", df)["busiest_day"] == "Sun"
    assert frame("demand.by_month", df) == [("Jan", 3), ("Feb", 1)]
    over = metrics("demand.over_time", df)
    assert over == {"total_trips": 4, "days_covered": 3, "busiest_day": dt.date(2024, 1, 7)}


def test_months_pool_years(trips):
    df = trips(*at(dt.datetime(2023, 3, 1), dt.datetime(2024, 3, 1)))
    assert frame("demand.by_month", df) == [("Mar", 2)]


def test_top_locations_break_ties_by_id_and_skip_unknown(trips, zones):
    df = trips(*[{"PULocationID": i} for i in (60, 60, 50, 50, 264, 264, 264, 777, None)])
    assert frame("geo.top_pickups", df, zones) == [
        ("Clinton West (Manhattan)", 2),
        ("Crotona Park (Bronx)", 2),
        ("Zone 777", 1),
    ]
    # distinct counts the sentinel and the missing id as well
    assert metrics("geo.top_pickups", df, zones) == {"distinct_zones": 5, "top_zone": "Clinton West (Manhattan)"}


def test_hotspots_keep_zones_without_dropoffs(trips, zones):
    ends = [(50, 60), (50, 60), (60, 132)]
    df = trips(*[{"PULocationID": o, "DOLocationID": d} for o, d in ends])
    assert frame("geo.hotspot_compare", df, zones) == [
        ("Clinton West (Manhattan)", 2, 0),
        ("Crotona Park (Bronx)", 1, 2),
    ]
    assert metrics("geo.hotspot_compare", df, zones) == {"zones_compared": 2}


def test_distributions(trips):
    by_distance = trips(*[{"trip_distance": d} for d in (0.5, 29.9, 30.0, 99.0, 0.0, 100.0, None)])
    assert frame("trip.distance_dist", by_distance) == [(0, 1), (29, 1), (30, 2)]
    mean = sum((0.5, 29.9, 30.0, 99.0, 0.0, 100.0)) / 6
    assert metrics("trip.distance_dist", by_distance)["avg_distance"] == pytest.approx(mean)
    by_minutes = trips(*[{"minutes": m} for m in (1.9, 2.0, 59.9, 60, 120, 121, -3)])
    assert frame("trip.duration_dist", by_minutes) == [(0, 1), (2, 1), (58, 1), (60, 2)]


def test_speed_ignores_trips_without_duration(trips):
    df = trips(*[{"trip_distance": 10.0, "minutes": m} for m in (60, 30, 0, -1)])
    assert metrics("trip.avg_speed", df) == {"avg_speed": 15.0}


def test_revenue(trips):
    df = trips({"total_amount": 5.0}, {"total_amount": None}, {"fare_amount": 0.0, "tip_amount": 4.0})
    assert metrics("rev.total", df) == {"total_revenue": 18.0, "revenue_per_trip": 6.0}
    tip = metrics("rev.avg_tip", df)
    assert tip["avg_tip"] == pytest.approx(8 / 3)
    assert tip["avg_tip_pct"] == pytest.approx(20.0)
    empty = df.limit(0)
    assert metrics("rev.total", empty) == {"total_revenue": 0.0, "revenue_per_trip": 0.0}


def test_passengers_show_zero_to_six(trips):
    df = trips(*[{"passenger_count": p} for p in (None, 0.0, 1.0, 6.0, 7.0)])
    assert frame("pax.distribution", df) == [(0, 1), (1, 1), (6, 1)]
    assert metrics("pax.distribution", df) == {"avg_passengers": 3.5}
    assert frame("pax.avg_fare", df) == [(0, 10.0), (1, 10.0), (6, 10.0)]
    assert ANALYSES["pax.avg_fare"](df, TLC).metrics is None


def test_airports_credit_the_origin(trips):
    df = trips(
        {"PULocationID": 1, "DOLocationID": 132, "total_amount": 100.0},
        {"PULocationID": 132, "DOLocationID": 50, "total_amount": 20.0},
        {"PULocationID": 50, "DOLocationID": 138, "total_amount": 3.0},
        {"PULocationID": 50, "DOLocationID": 60, "total_amount": 1000.0},
    )
    assert frame("air.revenue", df) == [("EWR", 100.0), ("JFK", 20.0), ("LGA", 3.0)]
    assert frame("air.pickups", df) == [("EWR", 1), ("JFK", 1)]
    assert frame("air.dropoffs", df) == [("JFK", 1), ("LGA", 1)]
    assert metrics("air.trends", df) == {"total_airport_trips": 3}


def test_hourly_revenue_adds_up(trips):
    df = trips(*at(*[dt.datetime(2024, 1, 1, h % 24, h % 60) for h in range(100)]))
    hours = column(ANALYSES["rev.by_hour"](df, TLC).frame, "revenue")
    assert sum(hours) == pytest.approx(metrics("rev.total", df)["total_revenue"])
