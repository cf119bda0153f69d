"""The data-quality report of a table, whole, from one scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfare.operators.quality import duplicate_rows, sanity_checks
from wayfare.roles import Limits, Roles
from wayfare.sources.sinks import stored

_MOMENTS = {"count": F.count, "mean": F.avg, "stddev": F.stddev, "min": F.min, "max": F.max}


def _metrics(df: DataFrame, roles: Roles, limits: Limits, numeric: list[str]) -> dict[tuple[str, str, str], Column]:
    """(section, subject, measure) -> aggregate."""
    out = {("missing", c, "rows"): F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}
    out |= {("sanity", name, "rows"): F.count_if(check) for name, check in sanity_checks(roles, limits).items()}
    for c in numeric:
        out |= {("numeric", c, name): function(F.col(f"`{c}`").cast("double")) for name, function in _MOMENTS.items()}
    return out


def quality_report(df: DataFrame, roles: Roles, limits: Limits, numeric: list[str]) -> DataFrame:
    """(section, subject, measure, value): missing values, sanity checks, moments and duplicates of ``df``.

    The duplicate count is the one action; everything else is observed on the rows as it reads them, so the table is scanned
    once. Observed metrics are accumulators: a map task that runs again after its executor is lost counts twice. So the observed
    row count is held against the action's own, and if they differ the metrics are aggregated in a second scan.

    Shares are of all rows; 0 for an empty table. Duplicates are by row fingerprint. A value without rows is NULL. The report is
    computed when this is called; its rows, a few a column, pass through the driver.
    """
    metrics = _metrics(df, roles, limits, numeric)
    named = [F.count(F.lit(1)).alias("rows"), *[m.alias(f"m{i}") for i, m in enumerate(metrics.values())]]
    seen = Observation(f"quality-{uuid.uuid4().hex}")
    copies = stored(duplicate_rows(df.observe(seen, *named)), "duplicates").first()
    # without rows the plan may have nothing left to observe
    got = seen.get if copies["rows"] else {}
    if got.get("rows") != copies["rows"]:
        got = df.agg(*named).first().asDict()
    rows = got["rows"]
    table = [("table", "all", "rows", float(rows))]
    table += [("table", "all", name, float(copies[name])) for name in ("distinct_rows", "duplicates")]
    for i, (section, subject, measure) in enumerate(metrics):
        value = got[f"m{i}"]
        table.append((section, subject, measure, None if value is None else float(value)))
        if measure == "rows":
            table.append((section, subject, "pct", value / rows * 100.0 if rows else 0.0))
    return df.sparkSession.createDataFrame(table, "section string, subject string, measure string, value double")
