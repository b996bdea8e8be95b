"""Empirical distributions of waits and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gaps import candidates

MODES = ("elapsed", "exact")


def _candidates(classified: DataFrame, keys, horizon: int | None) -> DataFrame:
    out = candidates(classified)
    if horizon is None:
        return out
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    return out.withColumn("class", F.when(F.col("tau") > horizon, 3).otherwise(F.col("class")))


def unclassified(waits: DataFrame) -> DataFrame:
    """Waits of series without gaps, as far as their distribution needs a class: those that end are exact."""
    return waits.where("tau > 0").withColumns({"class": F.lit(1), "lower": F.col("tau"), "upper": F.col("tau")})


def equal_distributions(a: DataFrame, b: DataFrame, keys=()) -> bool:
    """Whether two distributions have the same support and counts; what follows from these isn't compared."""
    cols = [*keys, "delta", "tau", "count", "count_exact", "count_gap_crossing"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def draw(dist: DataFrame, n: int, keys=(), seed: int = 1) -> DataFrame:
    """``n`` waits for each series and threshold, drawn from its distribution: keys, delta, draw, tau."""
    by = [*keys, "delta"]
    w = Window.partitionBy(*by)
    steps = dist.select(*by, F.coalesce(F.lag("cdf").over(w.orderBy("tau")), F.lit(0.0)).alias("_u"), "tau", F.lit(None).cast("long").alias("draw"))
    rows = dist.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    uniform = F.pmod(F.xxhash64(F.lit(seed), *by, "draw"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    drawn = rows.select(*by, uniform.alias("_u"), F.lit(None).cast("long").alias("tau"), "draw")
    # the last step of the cdf at or below each number
    at = w.orderBy("_u", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return steps.unionAll(drawn).withColumn("tau", F.last("tau", ignorenulls=True).over(at)).where("draw IS NOT NULL").select(*by, "draw", "tau")


def empirical_distribution(classified: DataFrame, keys=(), mode: str = "elapsed", horizon: int | None = None) -> DataFrame:
    """keys, delta, tau, count, pmf, cdf, ccdf, count_exact, count_gap_crossing.

    ``exact`` keeps exact waits only. Waits beyond a horizon count as
    right-censored. The cdf is a sum of integers over their total.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    kept = _candidates(classified, keys, horizon).where(F.col("class") == 1 if mode == "exact" else F.col("class") <= 2)
    k = kept.groupBy(*keys, "delta", "tau").agg(F.count("*").alias("count"), F.count_if(F.col("class") == 1).alias("count_exact"), F.count_if(F.col("class") == 2).alias("count_gap_crossing"))
    w = Window.partitionBy(*keys, "delta")
    total = F.sum("count").over(w)
    below = F.sum("count").over(w.orderBy("tau").rowsBetween(Window.unboundedPreceding, 0))
    out = k.withColumns({"pmf": F.col("count") / total, "cdf": below / total})
    return out.withColumn("ccdf", 1.0 - F.col("cdf")).select(*keys, "delta", "tau", "count", "pmf", "cdf", "ccdf", "count_exact", "count_gap_crossing")


def accounting(classified: DataFrame, keys=(), horizon: int | None = None) -> DataFrame:
    """Candidates by class, whatever the mode."""
    c = _candidates(classified, keys, horizon).groupBy(*keys, "delta")
    count = lambda k, name: F.count_if(F.col("class") == k).alias(name)
    return c.agg(F.count("*").alias("n_candidates"), count(1, "n_exact"), count(2, "n_gap_crossing"), count(3, "n_right_censored"))


def censoring_counts(classified: DataFrame, keys=()) -> DataFrame:
    """How many right-censored candidates are known to have waited so long: keys, delta, lower, count."""
    return _candidates(classified, keys, None).where("class = 3").groupBy(*keys, "delta", "lower").agg(F.count("*").alias("count"))


def mean_waiting_time(dist: DataFrame, keys=()) -> DataFrame:
    return dist.groupBy(*keys, "delta").agg((F.sum(F.col("tau") * F.col("count")) / F.sum("count")).alias("mean"))


def quantile(dist: DataFrame, p: float, keys=()) -> DataFrame:
    """The smallest wait whose cumulative count reaches a share ``p``."""
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    return dist.where(F.col("cdf") >= p).groupBy(*keys, "delta").agg(F.min("tau").alias("quantile"))


def cdf_at(dist: DataFrame, k: int, keys=()) -> DataFrame:
    return dist.groupBy(*keys, "delta").agg(F.coalesce(F.max(F.when(F.col("tau") <= k, F.col("cdf"))), F.lit(0.0)).alias("cdf"))


def index_entry(dist: DataFrame, keys=()) -> DataFrame:
    """keys, delta, n_waiting, tau_min, tau_max, tau_mean, and the lower weighted median."""
    half = F.min(F.when(2 * F.col("_below") >= F.col("_total"), F.col("tau")))
    w = Window.partitionBy(*keys, "delta")
    d = dist.withColumns({"_total": F.sum("count").over(w), "_below": F.sum("count").over(w.orderBy("tau"))})
    return d.groupBy(*keys, "delta").agg(F.sum("count").alias("n_waiting"), F.min("tau").alias("tau_min"), F.max("tau").alias("tau_max"), (F.sum(F.col("tau") * F.col("count")) / F.sum("count")).alias("tau_mean"), half.alias("tau_median"))


def ks_distance(a: DataFrame, b: DataFrame, on=("delta",)) -> DataFrame:
    """``(on, ks)``: the largest distance of two cdfs; NaN where one of them is empty."""
    u = a.select(*on, "tau", F.col("cdf").alias("x"), F.lit(None).cast("double").alias("y")).unionAll(b.select(*on, "tau", F.lit(None).cast("double"), "cdf"))
    u = u.groupBy(*on, "tau").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    w = Window.partitionBy(*on).orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)
    filled = u.select(*on, F.last("x", ignorenulls=True).over(w).alias("x"), F.last("y", ignorenulls=True).over(w).alias("y"))
    gap = F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))
    both = F.max("x").isNotNull() & F.max("y").isNotNull()
    return filled.groupBy(*on).agg(F.when(both, gap).otherwise(F.lit(float("nan"))).alias("ks"))
