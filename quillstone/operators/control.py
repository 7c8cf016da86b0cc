"""Control rules: cells of a trace in which another scale of the logit loses fewer bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The least support and gain of a rule, how many rules there are, and the scale that changes nothing.
SUPPORT, GAIN, RULES, NEUTRAL = 65_536, 40.0, 32, 2


def compile_rules(cells: DataFrame, support: int = SUPPORT, gain: float = GAIN, rules: int = RULES) -> DataFrame:
    """confidence, disagreement, scale, support, train, tune, valid, holdout: the rules that gain most on validation.

    cells: split (0 to 7), confidence, disagreement, scale, n, bits. A cell's scale is the one that gains most on the
    splits 0 to 4 (the larger of equals); a rule needs the support and gain there, and gains on the splits 5 and 6. What
    split 7 gains is only reported.
    """
    on = ["split", "confidence", "disagreement"]
    base = cells.where(F.col("scale") == NEUTRAL).select(*on, F.col("n").alias("support"), F.col("bits").alias("base"))
    saved = F.col("base") - F.col("bits")
    over = lambda splits, value: F.sum(F.when(splits, value).otherwise(0))
    split = F.col("split")
    g = cells.where(F.col("scale") != NEUTRAL).join(base, on).groupBy("confidence", "disagreement", "scale").agg(
        over(split < 5, F.col("support")).alias("support"), over(split < 5, saved).alias("train"), over(split == 5, saved).alias("tune"), over(split == 6, saved).alias("valid"), over(split == 7, saved).alias("holdout"))
    best = g.groupBy("confidence", "disagreement").agg(F.max(F.struct("train", "scale", "support", "tune", "valid", "holdout")).alias("b")).select("confidence", "disagreement", "b.*")
    return best.where((F.col("support") >= support) & (F.col("train") > gain) & (F.col("tune") > 0) & (F.col("valid") > 0)).orderBy(F.desc("valid")).limit(rules)
