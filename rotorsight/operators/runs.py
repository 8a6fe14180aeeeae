"""Change-point segmentation of long time series, without ever gathering one series in a task.

A device may hold a third of all rows, so nothing here orders a whole device. The rows are cut
into time *slices* of a fixed length, and the work is done in three steps:

1. ``local_runs``: one shuffle by ``(key, slice)``. Inside a slice (bounded by the sampling rate)
   consecutive rows of one state form a run, reduced to mergeable statistics. The first and last
   rows of a slice travel along as short arrays for windows that cross the slice edge.
2. ``stitch``: decides for every slice whether its first run continues the segment of the slice
   before, and numbers the segments. This is a prefix computation over slices, done in two
   levels (blocks of slices, then blocks), so no task sees more than ``block`` slices or the
   number of blocks.
3. ``merge_runs`` (in ``segments``): runs of one segment are merged by partial aggregation.

Only step 1 reads rows; its output is roughly a hundredth of the input and is materialised once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F


SLICE_SECONDS = 3600           # 720 rows at one sample every 5 s
SLICES_PER_BLOCK = 1024


def time_slice(ts: str, seconds: int) -> Column:
    return F.expr(f"unix_seconds({ts}) div {int(seconds)}")


@dataclass(frozen=True)
class Series:
    """How a table is read as a set of time series."""

    keys: tuple[str, ...] = ("device_id",)
    ts: str = "timestamp"
    state: str = "operating_state"
    slice_seconds: int = SLICE_SECONDS
    block: int = SLICES_PER_BLOCK


def number_runs(frames: DataFrame, series: Series) -> DataFrame:
    """Add ``slice``, ``run`` (from 1 within the slice), ``rn`` and ``run_rows``.

    A ``slice`` column that is already there is kept, so that the partitioning of a join on it
    is reused instead of shuffling again.
    """
    if "slice" not in frames.columns:
        frames = frames.withColumn("slice", time_slice(series.ts, series.slice_seconds))
    part = [*series.keys, "slice"]
    by_time = W.partitionBy(*part).orderBy(series.ts)
    previous = F.lag(series.state).over(by_time)
    opens = (F.row_number().over(by_time) == 1) | ~F.col(series.state).eqNullSafe(previous)
    in_run = W.partitionBy(*part, "run").orderBy(series.ts)
    return (frames.withColumn("_opens", opens.cast("int"))
            .withColumn("run", F.sum("_opens").over(by_time))
            .withColumn("rn", F.row_number().over(in_run))
            .withColumn("run_rows", F.count(F.lit(1)).over(W.partitionBy(*part, "run")))
            .drop("_opens"))


def stitch(units: DataFrame, series: Series, halo_rows: int = 0) -> DataFrame:
    """Number segments across slices.

    ``units`` has one row per ``(key, slice)``: ``n_runs, first_state, last_state, last_start``
    and, with ``halo_rows``, ``tail`` (array of structs whose first field is the time ``t``).
    The result has one row per ``(key, slice)``:

    * ``continues``: the first run carries on the segment of the slice before,
    * ``seg_base``: number of segments opened in earlier slices,
    * ``carried_start``: start of the segment that is open when the slice begins,
    * ``halo``: up to ``halo_rows`` rows before the slice.
    """
    keys = list(series.keys)
    blocked = units.withColumn("block", F.expr(f"slice div {int(series.block)}"))
    inside = W.partitionBy(*keys, "block").orderBy("slice")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    # Within a block the first slice is taken to open a segment; the block level corrects that.
    inner = (blocked
             .withColumn("fresh", (F.row_number().over(inside) == 1)
                         | ~F.col("first_state").eqNullSafe(F.lag("last_state").over(inside)))
             .withColumn("opened", F.col("n_runs") - 1 + F.col("fresh").cast("int"))
             .withColumn("base_in", F.coalesce(F.sum("opened").over(before), F.lit(0)))
             .withColumn("start_in", F.last(
                 F.when((F.col("n_runs") > 1) | F.col("fresh"), F.col("last_start")),
                 ignorenulls=True).over(before)))
    near = inside.rowsBetween(-halo_rows, -1)
    if halo_rows:
        inner = inner.withColumn("halo_in", F.flatten(F.collect_list("tail").over(near)))

    totals = [
        F.min_by("first_state", "slice").alias("b_first"),
        F.max_by("last_state", "slice").alias("b_last"),
        F.sum("opened").alias("b_opened"),
        F.max(F.when((F.col("n_runs") > 1) | F.col("fresh"), F.col("last_start"))).alias("b_start"),
    ]
    if halo_rows:
        totals.append(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("tail")))),
                              1, halo_rows).alias("b_tail"))
    across = W.partitionBy(*keys).orderBy("block")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    outer = (inner.groupBy(*keys, "block").agg(*totals)
             .withColumn("b_continues",
                         (F.row_number().over(across) > 1)
                         & F.col("b_first").eqNullSafe(F.lag("b_last").over(across)))
             .withColumn("b_new", F.col("b_opened") - F.col("b_continues").cast("int"))
             .withColumn("base_out", F.coalesce(F.sum("b_new").over(earlier), F.lit(0)))
             .withColumn("start_out", F.last(F.when(F.col("b_new") > 0, F.col("b_start")),
                                             ignorenulls=True).over(earlier)))
    if halo_rows:
        outer = outer.withColumn("halo_out", F.flatten(
            F.collect_list("b_tail").over(across.rowsBetween(-halo_rows, -1))))
    outer = outer.select(*keys, "block", "b_continues", "base_out", "start_out",
                         *(["halo_out"] if halo_rows else []))

    joined = inner.join(outer, [*keys, "block"])
    leading = F.row_number().over(inside) == 1
    carried = joined.select(
        *keys, "slice",
        F.when(leading, F.col("b_continues")).otherwise(~F.col("fresh")).alias("continues"),
        (F.col("base_out") + F.col("base_in")
         - F.when(leading, 0).otherwise(F.col("b_continues").cast("int"))).alias("seg_base"),
        # Still inside the block's first segment, which began in an earlier block.
        F.when(leading | (F.col("b_continues") & (F.col("base_in") == 1)), F.col("start_out"))
         .otherwise(F.col("start_in")).alias("carried_start"),
        *([F.slice(F.reverse(F.array_sort(F.concat("halo_out", "halo_in"))), 1, halo_rows)
           .alias("halo")] if halo_rows else []))
    return carried


def segment_number(run: str = "run") -> Column:
    """Index from 0 of the segment a run belongs to, after joining ``stitch``."""
    return F.col("seg_base") + F.col(run) - 1 - F.col("continues").cast("int")


def prefix(units: DataFrame, keys: list[str], order: str, ops: dict[str, str],
           block: int = SLICES_PER_BLOCK) -> DataFrame:
    """For every unit, each column combined over the earlier units of its key (two levels).

    ``ops`` maps a column to ``sum`` (0 when there is none), ``min`` or ``last`` (last non-null).
    ``units`` is read by two branches: pass a small or materialised table.
    """
    take = {"sum": F.sum, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {"sum": F.sum, "min": F.min,
             "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "min": F.least, "last": F.coalesce}
    blocked = units.select(*keys, order, *ops, F.expr(f"{order} div {int(block)}").alias("block"))
    inside = W.partitionBy(*keys, "block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = blocked.select(*keys, order, "block",
                           *[take[op](c).over(inside).alias(c) for c, op in ops.items()])
    across = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    outer = (blocked.groupBy(*keys, "block")
             .agg(*[total[op](c).alias(c) for c, op in ops.items()])
             .select(*keys, "block", *[take[op](c).over(across).alias(f"_{c}")
                                       for c, op in ops.items()]))
    return inner.join(outer, [*keys, "block"]).select(
        *keys, order, *[join[op](F.col(c), F.col(f"_{c}")).alias(c) for c, op in ops.items()])


def prefix_last(units: DataFrame, keys: list[str], order: str, values: list[str],
                block: int = SLICES_PER_BLOCK) -> DataFrame:
    """For every unit the last non-null value of each column in earlier units."""
    return prefix(units, keys, order, dict.fromkeys(values, "last"), block)


def segments_of_states(rows: DataFrame, series: Series) -> DataFrame:
    """Segments of any keyed state column: index, state, start, end and number of rows."""
    from ..session import materialise

    part = [*series.keys, "slice"]
    runs = (number_runs(rows, series).groupBy(*part, "run")
            .agg(F.first(series.state).alias("state"), F.min(series.ts).alias("start"),
                 F.max(series.ts).alias("end"), F.count(F.lit(1)).alias("n")))
    runs = materialise(runs)
    units = runs.groupBy(*part).agg(
        F.max("run").alias("n_runs"), F.min_by("state", "run").alias("first_state"),
        F.max_by("state", "run").alias("last_state"), F.max("start").alias("last_start"))
    joined = runs.join(stitch(units, series), part)
    return (joined.withColumn("seg_index", segment_number())
            .groupBy(*series.keys, "seg_index")
            .agg(F.first("state").alias("state"), F.min("start").alias("start"),
                 F.max("end").alias("end"), F.sum("n").alias("data_points")))
