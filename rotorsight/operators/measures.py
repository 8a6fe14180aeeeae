"""Measurements as rows (name, value, unit, segment) and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import limits as L


def _unit_map(units: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in units.items() for x in pair])


def measurements(segments: DataFrame, overall: DataFrame, keys: list[str]) -> DataFrame:
    """Segment and window figures in one long table; missing values give no row.

    Unpivoting is row-local; the unit comes from a constant map, so no join is needed.
    """
    def long(df, names, units, segment, start, end):
        wide = df.select(*keys, segment.alias("segment"), F.col(start).alias("start_time"),
                         F.col(end).alias("end_time"), *[F.col(c).cast("double") for c in names])
        rows = wide.unpivot([*keys, "segment", "start_time", "end_time"], list(names), "name",
                            "value")
        return rows.filter(F.col("value").isNotNull() & ~F.isnan("value")) \
            .withColumn("unit", F.element_at(_unit_map(units), F.col("name")))

    per_segment = long(segments, list(L.SEGMENT_UNITS), L.SEGMENT_UNITS,
                       F.concat(F.lit("phase:"), F.col("seg_index").cast("string")), "start", "end")
    whole = long(overall, list(L.OVERALL_UNITS), L.OVERALL_UNITS, F.lit("overall"),
                 "window_start", "window_end")
    return per_segment.unionByName(whole)


def lookup(rows: DataFrame, keys: list[str], names: list[str],
           segment: str = "overall") -> DataFrame:
    """First value by name within one segment, one column per name."""
    return (rows.filter((F.col("segment") == segment) & F.col("name").isin(names))
            .groupBy(*keys).pivot("name", names).agg(F.first("value")))


def segment_views(segments: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuild wide segment rows from the segment list and the long measurements."""
    names = list(L.SEGMENT_UNITS)
    wide = (rows.filter(F.col("segment") != "overall")
            .groupBy(*keys, "segment").pivot("name", names).agg(F.first("value")))
    listed = segments.select(*keys, "seg_index", "state", "start", "end", "rule_hits",
                             "ramp_start_time",
                             F.concat(F.lit("phase:"), F.col("seg_index").cast("string"))
                             .alias("segment"))
    return listed.join(wide, [*keys, "segment"], "left")


def violations(rows: DataFrame) -> DataFrame:
    """Measurements that break their contract: blank name or unit, or no value."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return rows.filter(blank("name") | blank("unit") | F.col("value").isNull())
