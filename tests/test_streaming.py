"""The row-wise operators hold no state, so they run on a stream unchanged."""

from tests.conftest import column
from wayfare.operators.cleaning import keep_rows, standard_rules, with_derived
from wayfare.operators.features import basic_features, model_features
from wayfare.roles import TLC, Limits
from wayfare.sources.schemas import TRIPS
from wayfare.sources.sinks import shared_folder


def test_cleaning_and_features_on_a_stream(spark, trips):
    folder = shared_folder(spark, "stream-in")
    batch = trips({}, {"fare_amount": 1.0}, {"PULocationID": 132})
    batch.write.parquet(folder)

    def plan(df):
        kept = keep_rows(with_derived(df, TLC), standard_rules(TLC, Limits(year_max=2025)))
        return basic_features(kept, TLC).select("VendorID", *model_features(TLC))

    stream = plan(spark.readStream.schema(TRIPS).parquet(folder))
    assert stream.isStreaming
    done = stream.writeStream.format("memory").queryName("featured").trigger(availableNow=True).start()
    done.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table("featured").collect())
    assert got == sorted(tuple(r) for r in plan(batch).collect())
    assert sorted(column(spark.table("featured"), "VendorID")) == [0, 2]
