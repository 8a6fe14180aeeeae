"""Hashes of what a case was judged on, independent of the order of rows and tasks.

Every input row becomes one text of length-prefixed fields and its SHA-256. The digest of a group is
the SHA-256 of the number of rows and the sums of four 60-bit parts of their hashes, so it is a
partial aggregate: a case with very many frames is summed where its frames are. The inputs of
a case are hashed once more over their digests. Digests tell changed inputs from equal ones; sums
are no defence against rows forged to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import limits as L
from .cases import case_frames

_PARTS = (1, 16, 31, 46)


def field(df: DataFrame, name: str) -> Column:
    """A column as text that cannot run into its neighbours: '-' for null, else length:text.

    Times count in microseconds, floating numbers in units of the ninth digit after the point (those
    out of its range as they print).
    """
    kind, value = df.schema[name].dataType.typeName(), F.col(name)
    if kind in ("timestamp", "timestamp_ntz"):
        value = F.unix_micros(value.cast("timestamp"))
    elif kind in ("double", "float"):
        units = (value.try_cast("decimal(28,9)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)")
        value = F.coalesce(units.cast("string"), value.cast("string"))
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _sealed(n, parts) -> Column:
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in (n, *parts)]), 256)


def digests(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """One row per key: the number of rows (``n_<name>``) and their digest (``<name>_sha256``)."""
    row = F.sha2(F.concat(*[field(rows, c) for c in columns]), 256)
    part = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.select(key, row.alias("row")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[part(at).alias(f"s{at}") for at in _PARTS])
    return sums.select(key, F.col("n").alias(f"n_{name}"), _sealed(
        F.col("n"), [F.col(f"s{at}") for at in _PARTS]).alias(f"{name}_sha256"))


def case_digests(cases: DataFrame, frames: DataFrame, **others: DataFrame) -> DataFrame:
    """One row per case: digests of its frames, its notes and further inputs, and one over all.

    ``cases`` have windows (``cases.default_windows``). Each of ``others`` has trace_id; all its
    columns count, in order of their names. An input without rows has the digest of no rows.
    """
    inside = case_frames(cases, frames)
    inputs = {"telemetry": digests(inside, "trace_id", L.TELEMETRY_COLUMNS, "telemetry"),
              "notes": digests(cases, "trace_id", ["user_query", "alarm_code"], "notes")}
    for name, rows in others.items():
        columns = sorted(set(rows.columns) - {"trace_id"})
        inputs[name] = digests(rows, "trace_id", columns, name)
    out, nothing = cases.select("trace_id").distinct(), _sealed(F.lit(0), [F.lit(0)] * len(_PARTS))
    for name, found in inputs.items():
        out = out.join(found, "trace_id", "left").withColumns({
            f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)),
            f"{name}_sha256": F.coalesce(f"{name}_sha256", nothing)})
    return out.withColumn("inputs_sha256", F.sha2(F.concat_ws(
        "\n", *[F.concat(F.lit(f"{name}:"), f"{name}_sha256") for name in sorted(inputs)]), 256))


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases whose inputs differ between two results of ``case_digests``, with the inputs' names.

    A case in one of them only has the name 'case'.
    """
    names = [c.removesuffix("_sha256") for c in before.columns
             if c.endswith("_sha256") and c in after.columns and c != "inputs_sha256"]
    both = before.alias("a").join(after.alias("b"), "trace_id", "full")
    once = F.col("a.inputs_sha256").isNull() | F.col("b.inputs_sha256").isNull()
    differ = [F.when(F.col(f"a.{n}_sha256") != F.col(f"b.{n}_sha256"), n) for n in names]
    return both.select("trace_id", F.when(once, F.array(F.lit("case"))).otherwise(
        F.array_compact(F.array(*differ))).alias("changed")).filter(F.size("changed") > 0)
