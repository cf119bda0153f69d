"""URL filters by a temporal list join, native DataFrame expressions only.

A list is a feed of dated edits: at a time, a pattern (a registered domain, a site, a host, or a host with a first path segment) is
listed or lifted. Edits become validity intervals, and an as-of join finds for every capture the interval of each of its
patterns that holds at fetch time.

Times keep their microseconds. What was in force is carried forward in three steps, each by windows of bounded size however hot
a pattern is: over the distinct times within one second, over the seconds of one day, over the days. Captures are reduced to distinct (pattern,
time) before they meet the list, and get their verdicts back by equi-joins against rows unique on that, which adaptive execution
splits where a key is hot.

Of edits to one pattern at the same microsecond, listing wins. Edits with a NULL pattern or time are void. An entry holds
from its time until just before the one that lifts it. Captures with a NULL or unparsable URL or NULL time
match nothing and are kept, unlisted; repeated captures are judged alike and all returned. Empty
tables on either side work. User names and passwords before a host are no part of it. Columns of captures may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.sinks import stored

# Most specific first.
KINDS = ("section", "host", "site", "domain")
# The steps over which entries are carried forward, finest first.
_STEPS = ("second", "day")


def patterns(url: Column) -> dict[str, Column]:
    """Kind -> the pattern of that kind that ``url`` falls under, or NULL."""
    host = F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:[^/?#]*@)?([^/:?#@]+)", 1)), F.lit(""))
    segment = F.nullif(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]+/([^/?#]+)", 1), F.lit(""))

    def last_labels(expression: str) -> Column:
        return F.concat(F.lit("*."), F.nullif(F.regexp_extract(host, expression, 1), F.lit("")))

    return {
        "section": F.concat(host, F.lit("/"), segment),
        "host": host,
        "site": last_labels(r"([^.]+\.[^.]+\.[^.]+)$"),
        "domain": last_labels(r"([^.]+\.[^.]+)$"),
    }


def _carried(rows: DataFrame, picked: str, neighbour) -> list[DataFrame]:
    """For each step, (pattern, of, found): what the nearest other slice of the same next coarser slice has.

    ``picked`` is the aggregate of ``rows(pattern, at, ...)`` that sums a slice up, ``neighbour`` the window function that finds the nearest
    slice with a value: one row a pattern and slice goes into a window over the slices of the next coarser one.
    """
    out = []
    for k, step in enumerate(_STEPS):
        coarser = [F.date_trunc(_STEPS[k + 1], "of")] if k + 1 < len(_STEPS) else []
        slices = rows.groupBy("pattern", F.date_trunc(step, "at").alias("of")).agg(F.expr(picked).alias("own"))
        over = Window.partitionBy("pattern", *coarser).orderBy("of")
        out.append(slices.select("pattern", F.col("of").alias(f"of_{step}"), neighbour(F.col("own"), over).alias(f"found_{step}")))
    return out


def _with_carried(rows: DataFrame, carried: list[DataFrame]) -> DataFrame:
    for step, found in zip(_STEPS, carried):
        rows = rows.withColumn(f"of_{step}", F.date_trunc(step, "at")).join(found, ["pattern", f"of_{step}"], "left")
    return rows


def validity_intervals(edits: DataFrame) -> DataFrame:
    """(pattern, since, until) from ``edits(pattern, at, listed)``; ``until`` is NULL while the entry stands.

    The next edit of a pattern is the next of the same second, or the first of the next second with one, or of the next day with one.
    """
    dated = edits.select("pattern", "at", "listed").filter("pattern IS NOT NULL AND at IS NOT NULL")
    states = dated.groupBy("pattern", "at").agg(F.max("listed").alias("listed"))
    carried = _carried(states, "min(at)", lambda own, over: F.lead(own).over(over))
    in_second = Window.partitionBy("pattern", F.date_trunc("second", "at")).orderBy("at")
    stepped = _with_carried(states.withColumn("next", F.lead("at").over(in_second)), carried)
    until = F.coalesce("next", *[f"found_{step}" for step in _STEPS])
    return stepped.filter("listed").select("pattern", F.col("at").alias("since"), until.alias("until"))


def holding(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(pattern, at, since) for each distinct point of ``points(pattern, at)`` that an interval holds.

    Intervals and points of one pattern and second are merged in time order and each point takes the last
    interval begun; without one it takes the last of the latest earlier second of the day, or else of the latest earlier day.
    """
    empty = F.lit(None).cast("timestamp")
    asked = points.select("pattern", "at", empty.alias("since"), empty.alias("until"))
    begun = intervals.select("pattern", F.col("since").alias("at"), "since", "until")
    entry = F.when(F.col("since").isNotNull(), F.struct("since", "until"))
    merged = asked.unionByName(begun).withColumn("entry", entry)

    def latest_before(own: Column, over) -> Column:
        return F.last(own, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))

    carried = _carried(merged, "max(entry)", latest_before)
    # An interval that begins at a point's time comes first.
    so_far = Window.partitionBy("pattern", F.date_trunc("second", "at")).orderBy("at", F.col("since").asc_nulls_last())
    latest = F.last("entry", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    placed = _with_carried(merged.withColumn("own", latest).filter(F.col("since").isNull()), carried)
    found = F.coalesce("own", *[f"found_{step}" for step in _STEPS])
    held = found["until"].isNull() | (F.col("at") < found["until"])
    return placed.filter(found.isNotNull() & held).select("pattern", "at", found["since"].alias("since"))


def filter_captures(captures: DataFrame, edits: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``listed``, the pattern that decides (the most specific that holds) and since when.

    Columns of these names that ``captures`` already has are replaced.
    """
    tag = "__" + uuid.uuid4().hex[:8]
    own = [F.col(f"`{c}`") for c in captures.columns if c not in ("listed", "pattern", "since")]
    fetched, keys = f"{tag}_at", [f"{tag}_{kind}" for kind in KINDS]
    found = patterns(F.col(url))
    keyed = captures.select(*own, F.col(at).cast("timestamp").alias(fetched), *[found[kind].alias(k) for kind, k in zip(KINDS, keys)])
    points = keyed.select(F.explode(F.array(*keys)).alias("pattern"), F.col(fetched).alias("at"))
    distinct = points.filter("pattern IS NOT NULL AND at IS NOT NULL").distinct()
    held = stored(holding(distinct, validity_intervals(edits)), "listed")
    joined = keyed
    for k in keys:
        hit = held.select(F.col("pattern").alias(f"{k}_p"), F.col("at").alias(f"{k}_a"), F.col("since").alias(f"{k}_s"))
        joined = joined.join(hit, (F.col(k) == F.col(f"{k}_p")) & (F.col(fetched) == F.col(f"{k}_a")), "left")
    pattern = F.coalesce(*[F.col(f"{k}_p") for k in keys])
    since = F.coalesce(*[F.col(f"{k}_s") for k in keys])
    return joined.select(*own, pattern.isNotNull().alias("listed"), pattern.alias("pattern"), since.alias("since"))
