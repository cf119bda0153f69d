"""Location labels, special-location predicates and two-sided location counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.aggregates import row_count, top_k
from wayfare.roles import Roles

# Join strategy is left to Spark: it broadcasts a dimension only while its size is under
# spark.sql.autoBroadcastJoinThreshold and falls back to a shuffled join above it.


def zone_title(zone: str = "zone", borough: str = "borough") -> Column:
    return F.concat(F.col(zone), F.lit(" ("), F.col(borough), F.lit(")"))


def with_zone_label(
    df: DataFrame, zones: DataFrame, location: str, out: str = "zone", default: str = "Zone {}"
) -> DataFrame:
    """Add "Zone (Borough)" for a location id, or ``default`` with the id filled in."""
    names = zones.select(F.col("location_id").alias(location), zone_title().alias(out))
    head, tail = default.split("{}")
    fallback = F.concat(F.lit(head), F.col(location).cast("string"), F.lit(tail))
    return df.join(names, location, "left").withColumn(out, F.coalesce(out, fallback))


def in_service_zones(
    df: DataFrame, zones: DataFrame, location: str, service_zones: list[str]
) -> DataFrame:
    """Rows whose location belongs to one of the service zones (semi-join)."""
    wanted = zones.filter(F.col("service_zone").isin(*service_zones))
    return df.join(wanted.select(F.col("location_id").alias(location)), location, "left_semi")


def outside_unknown(
    df: DataFrame, zones: DataFrame, location: str, unknowns: tuple[int, ...]
) -> DataFrame:
    """Rows whose location is not a sentinel id (anti-join; a NULL id stays)."""
    sentinels = zones.filter(F.col("location_id").isin(*unknowns))
    return df.join(sentinels.select(F.col("location_id").alias(location)), location, "left_anti")


def location_counts(df: DataFrame, location: str) -> DataFrame:
    """(location_id, trips) including sentinel and NULL ids."""
    return df.groupBy(F.col(location).alias("location_id")).agg(row_count().alias("trips"))


def top_locations(counts: DataFrame, roles: Roles, k: int) -> DataFrame:
    """The ``k`` busiest real locations; ids break ties."""
    known = counts.filter(~F.col("location_id").isin(*roles.unknowns))
    return top_k(known, "trips", "location_id", k)


def both_side_counts(df: DataFrame, roles: Roles) -> DataFrame:
    """(location_id, pickups, dropoffs) in one scan of the fact table.

    Each row yields its two ends, combined map-side to at most one row per location and
    task, instead of aggregating the table twice and joining the results.
    """
    ends = df.select(
        F.explode(
            F.array(
                F.struct(F.col(roles.origin).alias("location_id"), F.lit(True).alias("pickup")),
                F.struct(F.col(roles.dest).alias("location_id"), F.lit(False).alias("pickup")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.location_id").alias("location_id")).agg(
        F.count_if("e.pickup").alias("pickups"), F.count_if(~F.col("e.pickup")).alias("dropoffs")
    )


def hotspots(df: DataFrame, roles: Roles, zones: DataFrame, k: int = 10) -> DataFrame:
    """(zone, pickups, dropoffs) of the ``k`` busiest origins."""
    sides = both_side_counts(df, roles)
    known = sides.filter(~F.col("location_id").isin(*roles.unknowns) & (F.col("pickups") > 0))
    busiest = top_k(known, "pickups", "location_id", k)
    return (
        with_zone_label(busiest, zones, "location_id")
        .orderBy(F.desc("pickups"), "location_id")
        .select("zone", "pickups", "dropoffs")
    )


def hotspots_long(frame: DataFrame) -> DataFrame:
    """(zone, side, trips): the wide comparison as long rows."""
    return frame.unpivot(["zone"], ["pickups", "dropoffs"], "side", "trips")
