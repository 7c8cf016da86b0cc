"""Sequential byte models over texts, and what they save together; every text is coded by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predictor, recurrent
from ..runtime import spread, table
from .registry import query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def _bits(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.round(column(spark, F.coalesce("text", F.lit("")).cast("binary")), 3).alias("bits"))


@query()
def context_mixing_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under counters, runs and matches, mixed and refined bit by bit."""
    return _bits(spark, sf_dir, predictor.mixing_bits)


@query()
def partial_match_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under prediction by partial matching of order 4."""
    return _bits(spark, sf_dir, predictor.matching_bits)


@query()
def recurrent_model_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under a recurrent model that learns as it reads."""
    return _bits(spark, sf_dir, recurrent.recurrent_bits)
