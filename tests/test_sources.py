import datetime as dt
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from wayfare.functions.labels import rate_code_label
from wayfare.functions.sampling import cap_rows, first_by_hash, hash_sample, key_digest, sampled_projection
from wayfare.operators.coverage import coverage_summary, period_gaps, periods_present
from wayfare.operators.locations import in_service_zones, outside_unknown, with_zone_label
from wayfare.sources import incremental
from wayfare.sources.footers import folder_coverage, footer_stats, footers
from wayfare.sources.incremental import sync_months, synced, write_months
from wayfare.sources.monthly import (
    file_stats,
    folder_files,
    load_folder,
    load_months,
    load_stats,
    monthly_files,
    month_range,
)
from wayfare.sources.schemas import (
    TRIPS,
    TRIPS_FOR_MODEL,
    TRIPS_MONEY,
    cast_present,
    conform,
    load_status,
    missing_columns,
    project,
    schema_drift,
)
from wayfare.sources.sinks import shared_folder, write_partitioned
from wayfare.sources.zones import read_zones


@pytest.fixture(scope="module")
def vintages(spark, trips, tmp_path_factory):
    """Four months: fee as int, as double, absent, and spelled differently with an extra column."""
    base = tmp_path_factory.mktemp("months")
    good = trips({}, {"fare_amount": 20.0})
    files = {
        "2023-01": good.withColumn("airport_fee", F.lit(1)).withColumn("passenger_count", F.lit(2).cast("bigint")),
        "2023-02": good.withColumn("airport_fee", F.lit(1.25)),
        "2023-03": good.drop("airport_fee"),
        "2025-01": good.withColumnRenamed("airport_fee", "Airport_fee")
        .withColumn("Airport_fee", F.lit(1.75))
        .withColumn("cbd_congestion_fee", F.lit(0.75)),
    }
    for month, df in files.items():
        df.coalesce(1).write.parquet(f"{base}/{month}")
    return {month: f"{base}/{month}" for month in [*files, "2099-01"]}


def test_trip_schema():
    assert len(TRIPS) == 19
    assert set(TRIPS_MONEY) <= set(TRIPS.names)
    assert set(TRIPS_FOR_MODEL.names) <= set(TRIPS.names)


def test_load_conforms_every_vintage(spark, vintages):
    loaded = load_months(spark, vintages, schema=TRIPS)
    assert loaded.missing == ["2099-01"]
    assert loaded.present == ["2023-01", "2023-02", "2023-03", "2025-01"]
    assert loaded.df.schema.simpleString() == TRIPS.simpleString()
    fees = sorted(column(loaded.df, "airport_fee"), key=str)
    assert fees == [1.0, 1.0, 1.25, 1.25, 1.75, 1.75, None, None]
    assert load_status(loaded.df, TRIPS) == "ok"


def test_load_merges_by_name_without_a_schema(spark, vintages):
    loaded = load_months(spark, vintages, money=TRIPS_MONEY)
    assert loaded.df.count() == 8
    assert dict(loaded.df.dtypes)["airport_fee"] == "double"
    assert "cbd_congestion_fee" in loaded.df.columns
    assert loaded.df.agg(F.sum("cbd_congestion_fee")).first()[0] == 1.5


def test_one_scan_per_vintage(spark, vintages, tmp_path):
    same = {f"m{i}": vintages["2023-02"] for i in range(5)}
    plan = load_months(spark, same, schema=TRIPS).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_nothing_to_load(spark, tmp_path):
    loaded = load_months(spark, {"2020-01": f"{tmp_path}/none"})
    assert (loaded.df, loaded.present, loaded.missing) == (None, [], ["2020-01"])
    assert load_status(None, TRIPS) == "empty"


def test_folder_of_monthly_files(spark, vintages, tmp_path):
    for month in ("2023-01", "2023-02", "2025-01"):
        part = next(Path(vintages[month]).glob("part-*.parquet"))
        shutil.copy(part, tmp_path / f"trips_{month}.parquet")
    (tmp_path / "notes.parquet").write_bytes(b"no month in this name")
    folder = str(tmp_path)
    everything = load_folder(spark, folder, schema=TRIPS)
    assert (everything.df.count(), everything.present) == (6, ["2023-01", "2023-02", "2025-01"])
    some = load_folder(spark, folder, month_range("2023-02", "2023-04"), schema=TRIPS)
    assert (some.df.count(), some.present, some.missing) == (2, ["2023-02"], ["2023-03", "2023-04"])
    files = monthly_files(spark, folder)
    assert files.agg(F.sum("bytes")).first()[0] == sum(f.stat().st_size for f in tmp_path.glob("trips_*"))
    gaps = period_gaps(periods_present(files, "month"))
    assert gaps.count() == 22
    assert month_range("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    with pytest.raises(ValueError, match="after"):
        month_range("2024-02", "2024-01")


def test_schema_checks_ignore_case(spark, vintages):
    newest = spark.read.parquet(vintages["2025-01"])
    assert missing_columns(newest, TRIPS) == []
    states = {r["column"]: r["status"] for r in schema_drift(newest, TRIPS).collect()}
    assert states["airport_fee"] == "renamed_case"
    oldest = spark.read.parquet(vintages["2023-01"])
    states = {r["column"]: r["status"] for r in schema_drift(oldest, TRIPS).collect()}
    assert states["airport_fee"] == states["passenger_count"] == "other_type"
    without = spark.read.parquet(vintages["2023-03"])
    assert missing_columns(without, TRIPS) == ["airport_fee"]
    assert load_status(without, TRIPS) == "schema_mismatch"


def test_projection_needs_its_columns(trips):
    assert project(trips({}), TRIPS_FOR_MODEL).columns == TRIPS_FOR_MODEL.names
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        project(trips({}).drop("RatecodeID"), TRIPS_FOR_MODEL)


def test_cast_present_keeps_the_rest(spark):
    df = cast_present(spark.range(1).selectExpr("id", "7 AS Airport_fee"), ["airport_fee", "extra"])
    assert df.dtypes == [("id", "bigint"), ("airport_fee", "double")]


def test_conform_types_the_missing(spark):
    df = conform(spark.range(1).selectExpr("CAST(id AS bigint) AS vendorid"), TRIPS)
    assert df.schema.simpleString() == TRIPS.simpleString()
    assert df.first()["VendorID"] == 0


def test_stats(spark, trips, vintages):
    moments = (dt.datetime(2024, 1, 31, 23), dt.datetime(2024, 3, 1))
    dated = trips(*[{"tpep_pickup_datetime": m} for m in moments])
    row = load_stats(dated, "tpep_pickup_datetime").first()
    assert (row["n_records"], row["n_columns"], row["n_months"]) == (2, 19, 2)
    assert (row["first_date"], row["last_date"]) == (dt.date(2024, 1, 31), dt.date(2024, 3, 1))
    files = file_stats(spark.read.parquet(vintages["2023-02"], vintages["2023-03"])).first()
    assert (files["n_files"], files["n_records"]) == (2, 4)
    assert files["size_bytes"] > 0


def test_gaps(spark):
    days = ["2023-11-30", "2024-01-01", "2024-01-31", "2024-04-02"]
    df = spark.createDataFrame([(d, 1) for d in days] + [("2024-02-10", 2)], "d string, k int")
    df = df.withColumn("ts", F.col("d").cast("timestamp_ntz"))
    months = periods_present(df.filter("k = 1"), "ts")
    assert sorted(str(d) for d in column(period_gaps(months), "period")) == ["2023-12-01", "2024-02-01", "2024-03-01"]
    row = coverage_summary(months).first()
    assert (row["months"], row["missing_months"]) == (3, 3)
    keyed = period_gaps(periods_present(df, "ts", "day", "k"), "day", "k")
    assert keyed.filter("k = 2").count() == 0
    assert keyed.filter("k = 1").count() == 31 + 29 + 61


def test_zone_file_and_labels(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text(
        '"LocationID","Borough","Zone","service_zone"\n'
        '1,"EWR","Newark Airport","EWR"\n'
        '132,"Queens","JFK Airport","Airports"\n'
        '264,"Unknown","NV","N/A"\n'
    )
    zones = read_zones(spark, str(path))
    assert zones.count() == 3
    df = spark.createDataFrame([(1,), (132,), (264,), (9,), (None,)], "id int")
    assert sorted(column(in_service_zones(df, zones, "id", ["Airports", "EWR"]), "id")) == [1, 132]
    assert sorted(column(outside_unknown(df, zones, "id", (264, 265)), "id"), key=str) == [1, 132, 9, None]
    labels = {r["id"]: r["zone"] for r in with_zone_label(df, zones, "id", default="Unknown ({})").collect()}
    assert labels[1] == "Newark Airport (EWR)"
    assert labels[9] == "Unknown (9)"


def test_rate_code_labels(spark):
    df = spark.createDataFrame([(1.0,), (6.0,), (99.0,), (None,)], "c double")
    assert column(df.select(rate_code_label(F.col("c")).alias("l")), "l") == [
        "Standard rate",
        "Group ride",
        "Rate code 99",
        None,
    ]


def test_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 2)
    one = sorted(column(hash_sample(df, 0.05, "id"), "id"))
    assert one == sorted(column(hash_sample(df.repartition(7), 0.05, "id"), "id"))
    assert len(one) == pytest.approx(250, abs=60)
    assert sampled_projection(df, ["x"], ["id"], 0.5, 100).count() == 100
    assert sampled_projection(df, ["x"], ["id"], 0.01, 4000).count() == hash_sample(df, 0.01, "id").count()
    with pytest.raises(ValueError, match="identify a row"):
        cap_rows(df, 1000)
    assert cap_rows(df, 10000, "id").count() == 5000
    assert sampled_projection(df, ["x"], ["id"], 0.05).count() == len(one)
    assert cap_rows(df, 1000, "id").count() == pytest.approx(1000, abs=150)


def test_samples_are_complete_whatever_the_multiplicity_of_keys(spark):
    df = spark.range(20000).selectExpr("id", "nullif(id % 100, 0) AS key", "cast(null AS int) AS none")
    assert first_by_hash(df, 200, "key").count() == 200
    assert first_by_hash(df, 200, "none", "key").count() == 200
    assert first_by_hash(df, 50000, "key").count() == 20000
    assert first_by_hash(df.limit(0), 10, "key").count() == 0
    digests = df.select(key_digest("key", "none").alias("a"), key_digest("none", "key").alias("b")).distinct()
    assert digests.filter("a = b").count() == 1  # both NULL


def test_folder_load_keeps_every_file_and_column(spark, tmp_path):
    def write(name, expression):
        made = spark.range(5).selectExpr("id", expression).coalesce(1)
        made.write.parquet(f"{tmp_path}/made/{name}")
        part = next(Path(f"{tmp_path}/made/{name}").glob("part-*.parquet"))
        Path(tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / "in" / f"{name}.parquet")

    write("a_2024-01", "id AS fare")
    write("b_2024-01", "id + 0.5 AS fee")
    write("c_2024-02", "cast(id AS double) AS fare")
    write("odd", "id AS fare")
    loaded = load_folder(spark, f"{tmp_path}/in", money=["fare", "fee"])
    assert loaded.df.count() == 15 and {"fare", "fee"} <= set(loaded.df.columns)
    assert loaded.df.agg(F.sum("fee")).first()[0] == 12.5
    assert [Path(f).name for f in loaded.unmatched] == ["odd.parquet"] and loaded.missing == []
    assert loaded.present == ["2024-01", "2024-02"]


def test_sink_prunes_partitions(spark, trips):
    path = shared_folder(spark, "sink")
    months = [dt.datetime(2024, 1 + n % 3, 5) for n in range(9)]
    df = trips(*[{"tpep_pickup_datetime": m} for m in months]).withColumn("month", F.month("tpep_pickup_datetime"))
    write_partitioned(df, path, "month")
    back = spark.read.parquet(path)
    assert back.count() == 9
    one = back.filter("month = 2")
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(base) and first != second


def monthly_folder(spark, vintages, folder, *months):
    for month in months:
        shutil.copy(next(Path(vintages[month]).glob("part-*.parquet")), folder / f"trips_{month}.parquet")


def test_footers_tell_what_a_scan_tells(spark, vintages, tmp_path):
    monthly_folder(spark, vintages, tmp_path, "2023-01", "2023-02", "2025-01")
    shutil.copy(tmp_path / "trips_2023-01.parquet", tmp_path / "copy.parquet")
    (tmp_path / "broken_2023-03.parquet").write_bytes(b"no Parquet file")
    found = footers(folder_files(spark, str(tmp_path)), "TPEP_pickup_datetime")
    rows = {Path(r["path"]).name: r for r in found.collect()}
    for name in ("trips_2023-01", "trips_2023-02", "trips_2025-01", "copy"):
        r, scan = rows[f"{name}.parquet"], spark.read.parquet(f"{tmp_path}/{name}.parquet")
        low, high = scan.agg(F.min("tpep_pickup_datetime"), F.max("tpep_pickup_datetime")).first()
        assert (r["rows"], r["first"], r["last"], r["n_columns"], r["unread"]) == (scan.count(), low, high, len(scan.columns), None)
    assert rows["trips_2023-01.parquet"]["vintage"] == rows["copy.parquet"]["vintage"] != rows["trips_2025-01.parquet"]["vintage"]
    assert rows["broken_2023-03.parquet"]["unread"] and rows["broken_2023-03.parquet"]["rows"] is None
    stats = footer_stats(found).first()
    assert (stats["n_files"], stats["n_months"], stats["n_unmatched"], stats["n_unread"], stats["n_records"]) == (5, 4, 1, 1, 8)
    assert stats["size_bytes"] == sum(f.stat().st_size for f in tmp_path.glob("*.parquet"))
    present = folder_coverage(found)
    assert coverage_summary(present).first()["missing_months"] == 21
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0] and plan.count("Relation") == 1
    assert footers(folder_files(spark, str(tmp_path)).limit(0), "x").collect() == []


def test_a_column_without_statistics_has_no_extent(spark, tmp_path):
    spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS t, 1 AS x").write.parquet(f"{tmp_path}/nulls_2024-01.parquet")
    (row,) = footers(folder_files(spark, f"{tmp_path}/nulls_2024-01.parquet", "x"), "t").collect()
    assert (row["rows"], row["first"], row["last"]) == (1, None, None)


def test_sync_loads_new_and_changed_files_only(spark, vintages, tmp_path, monkeypatch):
    folder, target = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    monthly_folder(spark, vintages, folder, "2023-01", "2023-02")
    assert sync_months(spark, str(folder), target, schema=TRIPS) == (["2023-01", "2023-02"], 2, 0)
    assert synced(spark, target).count() == 4
    assert sync_months(spark, str(folder), target, schema=TRIPS) == ([], 0, 0)

    untouched = sorted(Path(f"{target}/data/file_month=2023-01").glob("*.parquet"))
    monthly_folder(spark, vintages, folder, "2025-01")
    shutil.copy(folder / "trips_2023-02.parquet", folder / "more_2023-02.parquet")
    assert sync_months(spark, str(folder), target, schema=TRIPS) == (["2023-02", "2025-01"], 2, 0)
    by_month = {r["file_month"]: r["count"] for r in synced(spark, target).groupBy("file_month").count().collect()}
    assert by_month == {"2023-01": 2, "2023-02": 4, "2025-01": 2}
    assert sorted(Path(f"{target}/data/file_month=2023-01").glob("*.parquet")) == untouched
    assert synced(spark, target).drop("file_month").schema.simpleString() == TRIPS.simpleString()

    moved = tmp_path / "elsewhere"
    moved.mkdir()
    shutil.move(folder / "trips_2025-01.parquet", moved / "trips_2025-01.parquet")
    shutil.move(folder / "more_2023-02.parquet", moved / "more_2023-02.parquet")
    assert sync_months(spark, str(folder), target, schema=TRIPS) == (["2023-02", "2025-01"], 0, 2)
    assert {r["file_month"]: r["count"] for r in synced(spark, target).groupBy("file_month").count().collect()} == {"2023-01": 2, "2023-02": 2}
    shutil.move(moved / "trips_2025-01.parquet", folder / "trips_2025-01.parquet")
    assert sync_months(spark, str(folder), target, schema=TRIPS) == (["2025-01"], 1, 0)
    assert synced(spark, target).count() == 6


def test_a_failed_sync_leaves_the_old_state_or_is_repeated(spark, vintages, tmp_path, monkeypatch):
    folder, target = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    monthly_folder(spark, vintages, folder, "2023-01")
    sync_months(spark, str(folder), target, schema=TRIPS)
    before = sorted(map(tuple, synced(spark, target).collect()), key=str)
    shutil.copy(folder / "trips_2023-01.parquet", folder / "again_2023-01.parquet")

    def failing_tasks(df, path):
        write_months(df.withColumn("VendorID", F.when(F.rand() >= 0, F.raise_error(F.lit("lost")).cast("int"))), path)

    monkeypatch.setattr(incremental, "write_months", failing_tasks)
    with pytest.raises(Exception, match="lost"):
        sync_months(spark, str(folder), target, schema=TRIPS)
    assert sorted(map(tuple, synced(spark, target).collect()), key=str) == before

    def dies_after_data(df, path):
        write_months(df, path)
        raise RuntimeError("driver lost between the commits")

    monkeypatch.setattr(incremental, "write_months", dies_after_data)
    with pytest.raises(RuntimeError):
        sync_months(spark, str(folder), target, schema=TRIPS)
    monkeypatch.setattr(incremental, "write_months", write_months)
    assert sync_months(spark, str(folder), target, schema=TRIPS) == (["2023-01"], 1, 0)
    assert synced(spark, target).count() == 2 * len(before)
