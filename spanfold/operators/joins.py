"""Joins that Spark SQL has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    x = F.col(f"`{column}`")
    return F.unix_micros(x.cast("timestamp")) / 1e6 if kind in ("timestamp", "timestamp_ntz", "date") else x.cast("double")


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, how: str = "left", columns: list[str] | None = None, slice_width: float | None = None
) -> DataFrame:
    """Each left row with the last right row of its key that is not later; ties between right rows go to the greatest.

    Both sides are shuffled once by the key, and one window carries the last right row forward: no pair of rows is
    formed. A key with many rows is one partition of that window. Where keys are hot, give ``slice_width`` (seconds, or
    units of a numeric time): rows are then dealt by key and slice of time, and the last right row of the slices before
    is carried over by a window over slices alone. Left rows with a null key or time match nothing and enter no window;
    an inner join leaves out rows without a match.
    """
    columns = columns or [c for c in right.columns if c not in on]
    value = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    kind = right.select(value).schema[0].dataType
    known = F.col(f"`{left_time}`").isNotNull()
    for k in on:
        known &= F.col(f"`{k}`").isNotNull()
    names = [c if c not in left.columns else f"{c}_right" for c in columns]

    def tagged(df: DataFrame, side: int, at: str, own: Column, other: Column) -> DataFrame:
        cut = [F.floor(_seconds(df, at) / slice_width).cast("long").alias("__slice")] if slice_width else [F.lit(0).cast("long").alias("__slice")]
        pair = (own.alias("__left"), other.alias("__right")) if side else (other.alias("__left"), own.alias("__right"))
        return df.select(*[F.col(f"`{k}`").alias(k) for k in on], F.col(f"`{at}`").alias("__t"), *cut, F.lit(side).alias("__side"), *pair)

    usable = right.where(F.col(f"`{right_time}`").isNotNull())
    a = tagged(left.where(known), 1, left_time, F.struct("*"), F.lit(None).cast(kind))
    b = tagged(usable, 0, right_time, value, F.lit(None).cast(a.schema["__left"].dataType))
    tie = F.to_json("__right")
    before = Window.partitionBy(*on, "__slice").orderBy("__t", "__side", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("__found", F.last("__right", ignorenulls=True).over(before)).where("__side = 1")
    if slice_width:
        last = b.groupBy(*on, "__slice").agg(F.max_by("__right", F.struct("__t", tie)).alias("__last"))
        slices = a.select(*on, "__slice").distinct().join(last, [*on, "__slice"], "full")
        earlier = Window.partitionBy(*on).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(*on, "__slice", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
        found = found.join(carried, [*on, "__slice"], "left").withColumn("__found", F.coalesce("__found", "__carried"))
    matched = F.col("__found")
    if how == "inner":
        found = found.where(matched.isNotNull())
    out = found.select("__left.*", *[matched[c].alias(n) for c, n in zip(columns, names, strict=True)])
    if how == "inner":
        return out
    rest = left.where(~known)
    return out.unionByName(rest.select("*", *[F.lit(None).cast(out.schema[n].dataType).alias(n) for n in names]))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: Column | None = None) -> DataFrame:
    """Points with the ranges [low, high) that hold them, as an equi-join on buckets of ``width``.

    A range is listed in each bucket that it touches, a point in its own, so every pair meets once and no row meets
    all others. ``width`` near the usual length of a range keeps the copies few. Values are numbers.
    """
    a = points.withColumn("__bucket", F.floor(F.col(point) / width).cast("long"))
    b = ranges.where(F.col(low) < F.col(high))
    last = F.ceil(F.col(high) / width).cast("long") - 1
    b = b.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), last)))
    joined = a.join(b, "__bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    return (joined.where(on) if on is not None else joined).drop("__bucket")
