"""Fixed schemas and reconciliation of files that drifted away from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT, _LONG, _REAL = T.IntegerType(), T.LongType(), T.DoubleType()
_TEXT, _WHEN = T.StringType(), T.TimestampNTZType()


def columns(**types: T.DataType) -> T.StructType:
    """A flat schema; unlike a DDL string it needs no running session."""
    return T.StructType([T.StructField(name, dtype) for name, dtype in types.items()])


# Columns and types of the public TLC yellow-trip files. Timestamps carry no
# zone, so a duration is the wall-clock difference.
TRIPS = columns(
    VendorID=_INT,
    tpep_pickup_datetime=_WHEN,
    tpep_dropoff_datetime=_WHEN,
    passenger_count=_REAL,
    trip_distance=_REAL,
    RatecodeID=_REAL,
    store_and_fwd_flag=_TEXT,
    PULocationID=_INT,
    DOLocationID=_INT,
    payment_type=_INT,
    fare_amount=_REAL,
    extra=_REAL,
    mta_tax=_REAL,
    tip_amount=_REAL,
    tolls_amount=_REAL,
    improvement_surcharge=_REAL,
    total_amount=_REAL,
    congestion_surcharge=_REAL,
    airport_fee=_REAL,
)

# The columns knowable before a trip starts, plus what the targets need.
TRIPS_FOR_MODEL = T.StructType(
    [
        TRIPS[name]
        for name in (
            "tpep_pickup_datetime",
            "tpep_dropoff_datetime",
            "passenger_count",
            "trip_distance",
            "RatecodeID",
            "PULocationID",
            "DOLocationID",
            "fare_amount",
        )
    ]
)

# Money columns whose stored type changes from file to file.
TRIPS_MONEY = [
    "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
    "improvement_surcharge", "total_amount", "congestion_surcharge", "airport_fee",
]

ZONES = columns(location_id=_INT, borough=_TEXT, zone=_TEXT, service_zone=_TEXT)


def _stored_names(df: DataFrame) -> dict[str, str]:
    """Lower-cased name -> name as stored; Spark resolves columns without regard to case."""
    return {name.lower(): name for name in df.columns}


def cast_present(df: DataFrame, columns: list[str], dtype: str = "double") -> DataFrame:
    """Cast the listed columns where they exist, keeping all others and their order."""
    wanted = {c.lower(): c for c in columns}
    return df.select(
        *[
            F.col(c).cast(dtype).alias(wanted[c.lower()]) if c.lower() in wanted else F.col(c)
            for c in df.columns
        ]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: cast, reordered, absent ones as typed NULLs."""
    stored = _stored_names(df)
    return df.select(
        *[
            (F.col(stored[f.name.lower()]) if f.name.lower() in stored else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the schema's columns, cast; a missing one is an error, not a NULL."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    stored = _stored_names(df)
    return [f.name for f in schema if f.name.lower() not in stored]


def load_status(df: DataFrame | None, schema: T.StructType) -> str:
    if df is None:
        return "empty"
    return "schema_mismatch" if missing_columns(df, schema) else "ok"


def schema_drift(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, status, non_null) per expected column: ok, other_type, renamed_case, missing."""
    stored, types = _stored_names(df), dict(df.dtypes)

    def status(field: T.StructField) -> str:
        name = stored.get(field.name.lower())
        if name is None:
            return "missing"
        if types[name] != field.dataType.simpleString():
            return "other_type"
        return "ok" if name == field.name else "renamed_case"

    states = {f.name: status(f) for f in schema}
    counts = df.agg(
        *[
            (F.count(stored[f.name.lower()]) if states[f.name] != "missing" else F.lit(0).cast("bigint")).alias(f.name)
            for f in schema
        ]
    )
    labelled = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])
    return (
        counts.unpivot([], [f.name for f in schema], "column", "non_null")
        .select("column", F.element_at(labelled, F.col("column")).alias("status"), "non_null")
        .orderBy("column")
    )
