"""Synthetic series as Spark frames; seeds fix them for a given number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _cumulative(df: DataFrame, step: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(step).over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))


def random_walk(spark: SparkSession, n: int, seed: int = 1, drift: float = 0.0, sigma: float = 1.0, tail: float | None = None, trend: float = 0.0, periods=(), noise: float = 0.0, jumps: float = 0.0, jump_size: float = 10.0) -> DataFrame:
    """``row, t, x``: sums of normal (or Pareto, with ``tail``) steps, with trend, cycles, noise and jumps."""
    base = spark.range(1, n + 1, numPartitions=1).select(F.col("id").alias("row"), F.col("id").alias("t"))
    step = F.randn(seed) * sigma if tail is None else F.signum(F.rand(seed) - 0.5) * F.pow(1.0 - F.rand(seed + 1), F.lit(-1.0 / tail)) * sigma
    step = step + drift + F.when(F.rand(seed + 2) < jumps, F.randn(seed + 3) * jump_size).otherwise(0.0)
    x = F.col("_w") + trend * F.col("row") + F.randn(seed + 4) * noise
    for period, amplitude in periods:
        x = x + amplitude * F.sin(2 * 3.141592653589793 * F.col("row") / period)
    return _cumulative(base.withColumn("_s", step), "_s", "_w").select("row", "t", x.alias("x"))


def iid_series(spark: SparkSession, n: int, kind: str = "normal", seed: int = 1) -> DataFrame:
    draw = {"normal": F.randn(seed), "uniform": F.rand(seed), "exponential": -F.log(1.0 - F.rand(seed))}
    if kind not in draw:
        raise ValueError(f"kind must be one of {sorted(draw)}")
    return spark.range(1, n + 1, numPartitions=1).select(F.col("id").alias("row"), F.col("id").alias("t"), draw[kind].alias("x"))


def insert_missing(df: DataFrame, runs: int, longest: int, seed: int = 1) -> DataFrame:
    """``runs`` stretches of 1 to ``longest`` rows as missing."""
    n = df.count()
    places = df.sparkSession.range(runs, numPartitions=1).select(F.floor(F.rand(seed) * n + 1).cast("long").alias("a"), F.floor(F.rand(seed + 1) * longest + 1).cast("long").alias("k"))
    gone = places.select(F.explode(F.sequence("a", F.col("a") + F.col("k") - 1)).alias("row")).distinct().withColumn("_g", F.lit(True))
    return df.join(F.broadcast(gone), "row", "left").select("row", "t", F.when(F.col("_g").isNull(), F.col("x")).alias("x"))


def irregular_times(df: DataFrame, mean: float = 5.0, seed: int = 1) -> DataFrame:
    """Times with exponential spacings of at least 1."""
    step = F.greatest(F.lit(1), F.round(-F.log(1.0 - F.rand(seed)) * mean).cast("long"))
    return _cumulative(df.coalesce(1).withColumn("_s", step), "_s", "_t").select("row", F.col("_t").cast("long").alias("t"), "x")
