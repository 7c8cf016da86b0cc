"""Order algebra: dense numbers, running offsets, remapping and completion, cuts, blocks, priority sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def running(df: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """df with inclusive running sums over the whole order, without one task for all rows.

    Rows are dealt out by ranges of the order; sums inside a range, then the ranges' totals, are added up.
    """
    dealt = df.select("*", *[v.cast("long").alias(f"_{k}") for k, v in values.items()]).repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in values])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    joined = dealt.join(F.broadcast(totals), "_part")  # a row for each range
    return joined.select(*df.columns, *[(F.sum(f"_{k}").over(inside) + F.col(f"_b_{k}")).alias(k) for k in values])


def dense_index(df: DataFrame, order: str, skip: Column) -> DataFrame:
    """All rows numbered, and those that aren't skipped numbered by themselves (both from 0)."""
    out = running(df, order, {"all_index": F.lit(1), "kept_index": (~skip).cast("int")})
    return out.withColumn("all_index", F.col("all_index") - 1).withColumn("kept_index", F.when(~skip, F.col("kept_index") - 1))


def complete(order: DataFrame, ids: DataFrame, key: str, rank: str) -> DataFrame:
    """order, then the ids that it leaves out, ascending."""
    last = order.agg(F.coalesce(F.max(rank), F.lit(-1)).alias("_last"))
    rest = running(ids.join(order, key, "left_anti").select(key), key, {"_n": F.lit(1)})
    return order.select(rank, key).unionByName(rest.crossJoin(F.broadcast(last)).select((F.col("_last") + F.col("_n")).alias(rank), key))


def offsets(df: DataFrame, order: str, size: Column) -> DataFrame:
    """stream_begin and stream_end of rows laid out one after the other."""
    out = running(df.withColumn("_size", size), order, {"stream_end": F.col("_size")})
    return out.withColumn("stream_begin", F.col("stream_end") - F.col("_size")).drop("_size")


def position_features(rank: Column, total: Column, bins: int = 64, width: float = 1.5) -> Column:
    """Radial basis values of a relative position around evenly spaced centres."""
    sigma = width / (bins - 1)
    at = rank.cast("double") / F.greatest(total.cast("double") - 1, F.lit(1.0))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.exp(F.lit(-0.5) * F.pow((at - k.cast("double") / F.lit(float(bins - 1))) / F.lit(sigma), 2)))
