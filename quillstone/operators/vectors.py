"""Feature blocks: standardising, top variances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimensions(vectors: DataFrame) -> DataFrame:
    """dim, mean, variance (population) of each dimension; non-finite components count as 0."""
    x = F.col("x").cast("double")
    clean = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    rows = vectors.select(F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("dim").agg(F.avg(clean).alias("mean"), F.var_pop(clean).alias("variance"))


def standardised(vectors: DataFrame, keep: int) -> DataFrame:
    """vec_id, features: the keep dimensions of largest variance, standardised; rows of unit length (0 stays 0)."""
    stats = dimensions(vectors).where("variance > 1e-12").orderBy(F.desc("variance"), "dim").limit(keep)
    array = F.array_sort(F.collect_list(F.struct("dim", "mean", F.sqrt("variance").alias("sd"))))
    wide = vectors.crossJoin(F.broadcast(stats.agg(array.alias("stats"))))  # one row of keep entries
    z = wide.select("vec_id", F.transform("stats", lambda s: (F.get("embedding", s["dim"]).cast("double") - s["mean"]) / s["sd"]).alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    return z.select("vec_id", F.transform("z", lambda v: v / F.when(norm == 0, 1.0).otherwise(norm)).alias("features"))
