"""Running totals and row numbers of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.shared import materialize

#: Rows of a whole table up to which one window task may hold a group; they are counted where they are stored.
FEW = 1_000_000


def running(df: DataFrame, keys: list[str], order: list, few: int | None = None, at_most: int | None = None, **sums: Column) -> DataFrame:
    """Adds each of ``sums`` (name=expression) over the key's rows before this one in ``order``, and as name_all over all of the key's rows.

    The narrow rows of ``df`` are stored and counted first, so its plan runs once
    (not if the caller knows that there are ``at_most`` so few). A table of more than ``few`` rows is dealt into ranges of key and
    order, so a key with a third of all rows is the work of many tasks; only the
    ranges' totals, at most one for each key and range, are summed across ranges.
    Null keys are a group; rows alike in ``order`` follow each other in any way.
    """
    few = FEW if few is None else few
    earlier = (Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    small = at_most is not None and at_most <= few
    rows = df if small else materialize(df, "narrow")
    if small or rows.count() <= few:
        whole = Window.partitionBy(*keys)
        at = whole.orderBy(*order).rowsBetween(*earlier)
        return rows.select("*", *(zero(F.sum(e).over(at)).alias(n) for n, e in sums.items()), *(zero(F.sum(e).over(whole)).alias(f"{n}_all") for n, e in sums.items()))
    # sampling makes the ranges anew for each plan, so a row's range is stored with it
    dealt = materialize(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "_range").agg(*(F.sum(e).alias(n) for n, e in sums.items()))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(*earlier)
    totals = totals.select(*keys, "_range", *(zero(F.sum(n).over(before)).alias(f"{n}_before") for n in sums), *(zero(F.sum(n).over(whole)).alias(f"{n}_all") for n in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*earlier)
    d, t = dealt.select("*", *(zero(F.sum(e).over(inside)).alias(f"{n}_inside") for n, e in sums.items())).alias("d"), totals.alias("t")
    on = F.col("d._range") == F.col("t._range")
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}"))
    own = [F.col(f"d.`{c}`") for c in df.columns]
    return d.join(t, on).select(*own, *((F.col(f"d.{n}_inside") + F.col(f"t.{n}_before")).alias(n) for n in sums), *(F.col(f"t.{n}_all") for n in sums))


def numbered(df: DataFrame, keys: list[str], order: list, name: str, few: int | None = None) -> DataFrame:
    """Adds ``name``: the row's number from 1 within its key, in ``order``; groups of any size, as in ``running``."""
    return running(df, keys, order, few, _n=F.lit(1)).select(*df.columns, (F.col("_n") + 1).cast("int").alias(name))
