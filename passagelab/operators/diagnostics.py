"""Summaries of a series and the choice of its grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GRID_TOLERANCE, MAX_DIGITS, on_grid, quantize
from ..functions.keyed import join_series
from ..functions.neighbours import with_previous
from .distribution import empirical_distribution, ks_distance, unclassified
from .passage import first_passage


def sampling_summary(df: DataFrame, gap_factor: float = 2.0, keys=()) -> DataFrame:
    """Rows, spacings, and how many are wider than ``gap_factor`` medians."""
    d = with_previous(df.select(*keys, "t"), "t", "_p", keys).withColumn("d", F.col("t") - F.col("_p"))
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("d").alias("spacing_min"), F.expr("percentile(d, 0.5)").alias("spacing_median"), F.max("d").alias("spacing_max"))
    spaced = join_series(d, base.select(*keys, "spacing_median"), keys)
    wide = spaced.groupBy(*keys).agg(F.count_if(F.col("d") > gap_factor * F.col("spacing_median")).alias("n_wide"))
    return join_series(base, wide, keys)


def value_summary(df: DataFrame, keys=()) -> DataFrame:
    q = lambda p, name: F.expr(f"percentile(x, {p})").alias(name)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("x").alias("n_observed"), F.min("x").alias("x_min"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max("x").alias("x_max"), F.avg("x").alias("x_mean"))


def resolution_digits(df: DataFrame, keys=(), max_digits: int = MAX_DIGITS) -> DataFrame:
    """``(keys, digits)``: the fewest decimals, up to ``max_digits``, that hold every value; null if none do. One pass."""
    fits = [F.bool_and(on_grid(F.col("x"), d)).alias(f"d{d}") for d in range(max_digits + 1)]
    first = F.coalesce(*[F.when(F.col(f"d{d}"), F.lit(d)) for d in range(max_digits + 1)])
    return df.where("x IS NOT NULL").groupBy(*keys).agg(*fits).select(*keys, first.alias("digits"))


def increment_scale(df: DataFrame, keys=()) -> DataFrame:
    """``(keys, scale)``: the median size of changes between observed values, of those not zero if it is zero."""
    d = with_previous(df.where("x IS NOT NULL"), "x", "_p", keys).withColumn("d", F.abs(F.col("x") - F.col("_p")))
    both = d.groupBy(*keys).agg(F.expr("percentile(d, 0.5)").alias("a"), F.expr("percentile(CASE WHEN d > 0 THEN d END, 0.5)").alias("b"))
    return both.select(*keys, F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("scale"))


def _trial(df: DataFrame, deltas, digits: int, keys) -> DataFrame:
    grid = df.where("x IS NOT NULL").select(*keys, "t", quantize(F.col("x"), digits).alias("q"))
    dist = empirical_distribution(unclassified(first_passage(grid, deltas, digits, keys)), keys)
    return dist.withColumn("delta", F.col("delta").cast("double"))


def digits_sensitivity(df: DataFrame, digits: list[int], deltas, keys=()) -> DataFrame:
    """keys, digits, delta, n_distinct, step_ratio, ks: what one more decimal changes.

    ``ks`` is the distance of the distributions at ``digits`` and at one more,
    null where the threshold isn't on the coarser grid; ``n_distinct`` the values
    told apart, ``step_ratio`` the grid step over the increment scale.
    """
    found = sorted(set(digits))
    if not found or found[0] < 0 or found[-1] >= MAX_DIGITS:
        raise ValueError(f"digits must lie in 0:{MAX_DIGITS - 1}")
    deltas = sorted({float(x) for x in deltas})
    scale, out = increment_scale(df, keys), None
    for d in found:
        levels = df.where("x IS NOT NULL").groupBy(*keys).agg(F.count_distinct(quantize(F.col("x"), d)).alias("n_distinct"))
        levels = join_series(levels, scale, keys)
        rows = levels.withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
        on = [x for x in deltas if abs(x * 10**d - round(x * 10**d)) <= GRID_TOLERANCE]
        ks = ks_distance(_trial(df, on, d, keys), _trial(df, on, d + 1, keys), [*keys, "delta"]) if on else None
        rows = join_series(rows, ks, [*keys, "delta"], "left") if ks is not None else rows.withColumn("ks", F.lit(None).cast("double"))
        row = rows.select(*keys, F.lit(d).alias("digits"), "delta", "n_distinct", (F.lit(10.0**-d) / F.col("scale")).alias("step_ratio"), "ks")
        out = row if out is None else out.unionByName(row)
    return out


def dispersion_digits(step: float) -> int:
    """The fewest decimals whose grid step is at most ``step``."""
    if not step > 0:
        raise ValueError("the step must be positive")
    return next(d for d in range(400) if 10.0**-d <= step * (1 + 1e-12))


def suggest_digits(df: DataFrame, min_digits: int = 0, max_digits: int = 8, tolerance: float = 1e-3, step_ratio: float = 0.1, keys=()) -> tuple[int, str]:
    """Digits for a series, and the rule that gave them; never fewer than ``min_digits``, which thresholds may need.

    ``recorded_resolution``: the values' own decimals, if at most ``max_digits``;
    ``sensitivity``: the first grid whose step is at most ``step_ratio`` of a usual
    change and whose distribution at threshold 0 one more digit moves by less than
    ``tolerance``; else ``max_digits``. With keys, what all series need.
    """
    if not 0 <= min_digits <= max_digits < MAX_DIGITS or not 0 < tolerance < 1 or not 0 < step_ratio <= 1:
        raise ValueError("bad parameters of suggest_digits")
    own = [r["digits"] for r in resolution_digits(df, keys, max_digits).select("digits").distinct().collect()]
    if own and None not in own:
        return max(min_digits, *own), "recorded_resolution"
    scale = increment_scale(df, keys).agg(F.min("scale")).first()[0]
    if scale is None:
        raise ValueError("the series has no changes to choose digits by")
    for d in range(max(min_digits, dispersion_digits(step_ratio * scale)), max_digits + 1):
        ks = ks_distance(_trial(df, "0", d, keys), _trial(df, "0", d + 1, keys), [*keys, "delta"])
        worst = ks.agg(F.max("ks")).first()[0]
        if worst is not None and worst < tolerance:
            return d, "sensitivity"
    return max_digits, "max_digits"


def plot_tables(df: DataFrame, every: int = 1000, bins: int = 200, keys=()) -> tuple[DataFrame, DataFrame]:
    """What figures show: every k-th row, and a histogram of grid values."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    thin = df.withColumn("_n", n).where((F.col("_n") - 1) % every == 0).drop("_n")
    ends = df.groupBy(*keys).agg(F.min("q").alias("a"), F.max("q").alias("b"))
    spread = join_series(df, ends, keys)
    width = F.expr(f"greatest(1, (b - a) div {bins} + 1)")
    hist = spread.withColumn("bin", F.col("a") + F.floor((F.col("q") - F.col("a")) / width).cast("long") * width).groupBy(*keys, "bin").count()
    return thin, hist
