"""Orders from vectors: balanced splits of many groups at once, hierarchies of them, clusters on a line.

Ranks come from ordering.running(), so that no group, not even one that holds all rows, lands in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, maybe_broadcast
from . import ordering

LEVELS = (4096, 512, 64)
LOCAL = 16_384


def _rank(rows: DataFrame, key) -> DataFrame:
    """rows with r: the rank (from 0) by key, then id, inside the group."""
    numbered = ordering.running(rows.withColumn("_o", F.struct("group", key.alias("k"), "id")), "_o", {"_n": F.lit(1)}).drop("_o")
    first = numbered.groupBy("group").agg(F.min("_n").alias("_first"))
    return numbered.join(maybe_broadcast(first, first.count()), "group").withColumn("r", F.col("_n") - F.col("_first")).drop("_n", "_first")


def _gap(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def split(rows: DataFrame, iterations: int = 1) -> DataFrame:
    """group, id, features, left, is_left: of each group the `left` rows nearest to the first of two centres.

    Centres begin at the rows in the middle of both parts along the axis of largest variance; each further iteration
    takes the means of both parts. Equal gaps (to nine places) fall by id.
    """
    spread = rows.select("group", F.posexplode("features").alias("dim", "x")).groupBy("group", "dim").agg(F.round(F.var_pop("x"), 9).alias("v"))
    axis = spread.groupBy("group").agg(F.max_by("dim", F.struct("v", -F.col("dim"))).alias("axis"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    groups = materialize(axis.join(sizes, "group"), "axes")
    n = groups.count()
    with_axis = rows.join(maybe_broadcast(groups, n), "group")
    ranked = _rank(with_axis, F.get("features", F.col("axis")))
    middle = F.least(F.col("size") - 1, F.col("left") + F.floor((F.col("size") - F.col("left")) / 2))
    centres = ranked.groupBy("group").agg(
        F.max(F.when(F.col("r") == F.floor(F.col("left") / 2), F.col("features"))).alias("a"), F.max(F.when(F.col("r") == middle, F.col("features"))).alias("b"))
    for step in range(max(1, iterations)):
        gaps = rows.join(maybe_broadcast(materialize(centres, "centres"), n), "group").withColumn("gap", F.round(_gap("features", "a") - _gap("features", "b"), 9)).drop("a", "b")
        out = materialize(_rank(gaps, F.col("gap")).withColumn("is_left", F.col("r") < F.col("left")).drop("gap", "r"), "split")
        if step + 1 < iterations:
            means = out.select("group", "is_left", F.posexplode("features").alias("d", "x")).groupBy("group", "is_left", "d").agg(F.avg("x").alias("x"))
            sides = means.groupBy("group").pivot("is_left", [True, False]).agg(F.array_sort(F.collect_list(F.struct("d", "x"))))
            centres = sides.select("group", F.col("true.x").alias("a"), F.col("false.x").alias("b"))
    return out


def _halves(ids: np.ndarray, x: np.ndarray, left: int, iterations: int) -> np.ndarray:
    """split() of one group that fits into a task: whether each row is left."""
    axis = int(np.argmax(np.round(x.var(0), 9)))
    ranked = np.lexsort((ids, x[:, axis]))
    a, b = x[ranked[left // 2]], x[ranked[min(len(x) - 1, left + (len(x) - left) // 2)]]
    for _ in range(max(1, iterations)):
        gap = np.round(((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1), 9)
        side = np.zeros(len(x), bool)
        side[np.lexsort((ids, gap))[:left]] = True
        a, b = x[side].mean(0), x[~side].mean(0)
    return side


def _leaves(group: str, ids: np.ndarray, x: np.ndarray, levels: tuple[int, ...], iterations: int) -> list[tuple[str, np.ndarray]]:
    """The blocks below a group that fits into a task."""
    done, todo = [], [(group, np.arange(len(ids)))]
    while todo:
        name, rows = todo.pop()
        if len(rows) <= levels[-1]:
            done.append((name, rows))
            continue
        size = next(s for s in levels if len(rows) > s)
        side = _halves(ids[rows], x[rows], -(-len(rows) // size) // 2 * size, iterations)
        todo += [(name + "0", rows[side]), (name + "1", rows[~side])]
    return done


def hierarchical_order(vectors: DataFrame, levels: tuple[int, ...] = LEVELS, iterations: int = 2, local: int = LOCAL) -> DataFrame:
    """id, block, rank (from 0): id, features split until blocks hold the last level's rows, leaves in order of id.

    A group of n rows above a level's size goes into parts of whole blocks, floor(ceil(n / size) / 2) of them left. Groups
    of more than local rows are split by distributed ranks, all at once; smaller ones to the end, each in one task.
    """
    if any(a <= b or a % b for a, b in zip(levels, levels[1:], strict=False)):
        raise ValueError("levels must fall and divide one another")
    rows = vectors.select("id", "features", F.lit("").alias("group"))
    done = None
    while True:
        sizes = materialize(rows.groupBy("group").agg(F.count("*").alias("n")), "sizes")
        top = max(local, levels[-1])
        size = F.lit(levels[-1])
        for s in reversed(levels):
            size = F.when(F.col("n") > s, s).otherwise(size)
        left = F.when(F.col("n") > top, (F.floor(F.ceil(F.col("n") / size) / 2) * size).cast("long"))
        rows = rows.join(maybe_broadcast(sizes.select("group", left.alias("left")), sizes.count()), "group")
        small = rows.where("left IS NULL").select("id", "group", "features")
        done = small if done is None else done.unionByName(small)
        if sizes.where(F.col("n") > top).isEmpty():
            break
        halves = split(rows.where("left IS NOT NULL"), iterations)
        rows = halves.select("id", "features", F.concat("group", F.when(F.col("is_left"), "0").otherwise("1")).alias("group"))
    kind = vectors.schema["id"].dataType.simpleString()

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy()
        parts = _leaves(group["group"].iloc[0], ids, np.stack(group["features"]).astype(float), levels, iterations)
        return pd.concat([pd.DataFrame({"id": ids[rows], "group": name}) for name, rows in parts])

    done = done.groupBy("group").applyInPandas(finish, f"id {kind}, group string")
    ranked = ordering.running(done.withColumn("_o", F.struct("group", "id")), "_o", {"rank": F.lit(1)})
    return ranked.select("id", F.col("group").alias("block"), (F.col("rank") - 1).alias("rank"))


def project(vectors: DataFrame) -> DataFrame:
    """id, value: the first principal component; its largest weight is positive."""
    v = vectors.select("id", array_to_vector(F.col("features")).alias("v"))
    model = PCA(k=1, inputCol="v", outputCol="p").fit(v)
    weights = model.pc.toArray()[:, 0]
    sign = 1.0 if weights[abs(weights).argmax()] >= 0 else -1.0
    return model.transform(v).select("id", (F.get(vector_to_array("p"), F.lit(0)) * sign).alias("value"))


def line_clusters(points: DataFrame, members: int = 80, iterations: int = 3) -> DataFrame:
    """id, value, cluster: k-means on a line with one cluster for every `members` points.

    Clusters begin as runs of equally many points. On a line a point's nearest centre follows from how many midpoints
    between centres lie below it, so an iteration is a running sum over points and midpoints; centres are never
    gathered, since their number grows with the points.
    """
    n = points.count()
    k = max(1, n // members)
    ordered = ordering.running(points.select("id", "value").withColumn("_o", F.struct("value", "id")), "_o", {"r": F.lit(1)})
    out = ordered.select("id", "value", F.floor((F.col("r") - 1) * k / max(n, 1)).cast("long").alias("cluster"))
    for _ in range(iterations):
        means = out.groupBy("cluster").agg(F.round(F.avg("value"), 9).alias("centre"))
        lined = ordering.running(means.withColumn("_o", F.struct("centre", "cluster")), "_o", {"c": F.lit(1)})
        nearby = lined.select(F.explode(F.array(F.struct(F.col("c"), F.col("centre").alias("low"), F.lit(None).cast("double").alias("high")), F.struct((F.col("c") - 1).alias("c"), F.lit(None).cast("double").alias("low"), F.col("centre").alias("high")))).alias("x")).select("x.*")
        middles = nearby.groupBy("c").agg(((F.max("low") + F.max("high")) / 2).alias("value")).where("value IS NOT NULL")
        marks = middles.select(F.lit(None).cast(points.schema["id"].dataType).alias("id"), "value", F.lit(1).alias("mark"))
        both = out.select("id", "value", F.lit(0).alias("mark")).unionByName(marks)
        # a point on a midpoint stays below it
        summed = ordering.running(both.withColumn("_o", F.struct("value", "mark", "id")), "_o", {"cluster": F.col("mark")})
        out = summed.where("mark = 0").select("id", "value", "cluster")
    return out
