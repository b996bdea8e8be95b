"""Preprocessing steps: series in, series out, each recorded.

A series frame has the key columns, ``row`` (its place in the input), ``t`` and
``x`` (null where missing). :func:`apply_steps` runs steps by name and returns the
frame with the record of what was done.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import join_series
from ..functions.neighbours import over_rows, with_previous

TIE_POLICIES = ("error", "first", "last", "mean")


def _order(keys, *more):
    return Window.partitionBy(*keys).orderBy(*(more or ("row",)))


def _observed(df: DataFrame, keys, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a transform to the observed rows and put the missing ones back as they are."""
    cols = df.columns
    return made(df.where("x IS NOT NULL")).select(*cols).unionAll(df.where("x IS NULL").select(*cols))


def _per_series(df: DataFrame, keys, **aggregates: Column) -> DataFrame:
    return join_series(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), keys)


def _require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The frame, which raises when it is read if a row is bad."""
    return df.withColumn("x", F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("x")))


def select_range(df: DataFrame, lo=None, hi=None, keys=()) -> DataFrame:
    """Rows whose time (or place, counted from 1, where there is no time) is in ``[lo, hi]``; none is an error."""
    at = F.coalesce(F.col("t"), F.col("row"))
    out = df
    if lo is not None:
        out = out.where(at >= lo)
    if hi is not None:
        out = out.where(at <= hi)
    if out.isEmpty():
        raise ValueError("the range holds no row")
    return out


def check_intervals(intervals) -> list[tuple[int, int]]:
    """Sorted ``[start, stop)`` intervals that may touch but not overlap."""
    found = sorted((int(a), int(b)) for a, b in intervals)
    if not found or any(a >= b for a, b in found):
        raise ValueError("intervals must not be empty")
    if any(x[1] > y[0] for x, y in zip(found, found[1:])):
        raise ValueError("intervals overlap")
    return found


def exclude_intervals(df: DataFrame, intervals, splice: bool = True, keys=()) -> DataFrame:
    """Cut intervals out: drop their rows and close the time, or keep the rows as missing."""
    found = check_intervals(intervals)
    t = F.col("t")
    inside = F.lit(False)
    shift = F.lit(0)
    for a, b in found:
        inside |= (t >= a) & (t < b)
        shift += F.when(t >= b, b - a).otherwise(0)
    if not splice:
        return df.withColumn("x", F.when(~inside, F.col("x")))
    out = df.where(~inside).withColumn("t", t - shift)
    if out.isEmpty():
        raise ValueError("nothing is left outside the intervals")
    return out


def collapse_ties(df: DataFrame, policy: str = "error", keys=()) -> DataFrame:
    """One row for each time; times must not decrease. Missing values don't count where others are there."""
    if policy not in TIE_POLICIES:
        raise ValueError(f"tie policy must be one of {TIE_POLICIES}")
    back = with_previous(df, "t", "_b", keys, "row")
    worst = back.agg(F.count_if(F.col("t") < F.col("_b")), F.count_if(F.col("t") == F.col("_b"))).first()
    if worst[0]:
        raise ValueError("times decrease")
    if policy == "error":
        if worst[1]:
            raise ValueError("equal times")
        return df
    seen = F.when(F.col("x").isNotNull(), F.col("row"))
    x = {"first": F.min_by("x", seen), "last": F.max_by("x", seen), "mean": F.avg("x")}[policy]
    return df.groupBy(*keys, "t").agg(F.min("row").alias("row"), x.alias("x")).select(*df.columns)


def round_values(df: DataFrame, digits: int, keys=()) -> DataFrame:
    s = F.lit(float(10**digits))
    return df.withColumn("x", F.rint(F.col("x") * s) / s)


def trailing_mean_fluctuations(df: DataFrame, window: int, denominator: str = "mean", offset="none", on_nonpositive: str = "error", keys=()) -> DataFrame:
    """Deviation from the mean of the last ``window`` observations, the first being 0.

    ``mean`` gives percent of that mean; its ``offset`` shifts the values first: a
    number, or ``auto``, to a minimum of 1 if it is below, or ``none``. ``scale``
    divides by the standard deviation of the deviations, the first left out, which
    must be positive; ``none`` leaves them.
    """
    if window < 1 or denominator not in ("mean", "scale", "none") or on_nonpositive not in ("error", "missing"):
        raise ValueError("bad parameters of trailing_mean_fluctuations")
    if isinstance(offset, str) and offset not in ("none", "auto") or not isinstance(offset, str) and not math.isfinite(offset):
        raise ValueError("offset must be none, auto or a finite number")
    if offset != "none" and denominator != "mean":
        raise ValueError('offset applies to denominator "mean" only')

    def made(obs: DataFrame) -> DataFrame:
        if offset == "auto":
            obs = _per_series(obs, keys, _shift=F.greatest(F.lit(0.0), 1.0 - F.min("x")))
        else:
            obs = obs.withColumn("_shift", F.lit(0.0 if offset == "none" else float(offset)))
        mean = F.avg(F.col("x") + F.col("_shift"))
        obs = over_rows(obs, lambda rows, w: rows.withColumn("_m", mean.over(w.rowsBetween(-window, -1))), window, 0, keys).withColumn("_d", F.col("x") + F.col("_shift") - F.col("_m"))
        first = F.col("_m").isNull()
        if denominator == "none":
            return obs.withColumn("x", F.when(first, 0.0).otherwise(F.col("_d")))
        if denominator == "scale":
            obs = _per_series(obs, keys, _s=F.stddev_samp("_d"))
            obs = _require(obs, F.coalesce(F.col("_s") <= 0, F.lit(True)), "the deviations have no positive standard deviation")
            return obs.withColumn("x", F.when(F.col("x").isNotNull(), F.when(first, 0.0).otherwise(F.col("_d") / F.col("_s"))))
        bad = F.col("_m") <= 0
        if on_nonpositive == "error":
            obs = _require(obs, bad, "a trailing mean is not positive")
        return obs.withColumn("x", F.when(first, F.when(F.col("x").isNotNull(), 0.0)).when(~bad & F.col("x").isNotNull(), F.col("_d") * 100.0 / F.col("_m")))

    return _observed(df, keys, made)


def log_returns(df: DataFrame, keys=()) -> DataFrame:
    """``100 ln(x_k / x_{k-1})`` over observed rows; the first is missing."""

    def made(obs):
        obs = _require(obs, F.col("x") <= 0, "log_returns needs positive values")
        return with_previous(obs, "x", "_p", keys, "row").withColumn("x", 100.0 * F.log(F.col("x") / F.col("_p")))

    return _observed(df, keys, made)


def log_levels(df: DataFrame, reference="first", keys=()) -> DataFrame:
    """``100 ln(x / reference)``, the first observed value or a positive number."""
    if reference != "first" and not float(reference) > 0:
        raise ValueError("the reference must be positive")

    def made(obs):
        obs = _require(obs, F.col("x") <= 0, "log_levels needs positive values")
        obs = _per_series(obs, keys, _ref=F.min_by("x", "row")) if reference == "first" else obs.withColumn("_ref", F.lit(float(reference)))
        return obs.withColumn("x", 100.0 * F.log(F.col("x") / F.col("_ref")))

    return _observed(df, keys, made)


def differences(df: DataFrame, keys=()) -> DataFrame:
    """Differences of neighbouring observed values; the first is missing."""
    return _observed(df, keys, lambda obs: with_previous(obs, "x", "_p", keys, "row").withColumn("x", F.col("x") - F.col("_p")))


def detrend_moving_average(df: DataFrame, window: int, keys=()) -> DataFrame:
    """Less the centred mean of ``window`` observations, fewer at the ends."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd")
    h = window // 2
    centred = lambda rows, w: rows.withColumn("x", F.col("x") - F.avg("x").over(w.rowsBetween(-h, h)))
    return _observed(df, keys, lambda obs: over_rows(obs, centred, h, h, keys))


def remove_rows(df: DataFrame, remove: Column, splice: bool = False, keys=()) -> DataFrame:
    """Rows as missing; or gone, with the time since the row before closed up."""
    remove = F.coalesce(remove, F.lit(False))
    if not splice:
        return df.withColumn("x", F.when(~remove, F.col("x")))
    w = _order(keys)
    gone = df.withColumn("_r", remove).withColumn("_c", F.when(F.col("_r"), F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0))).otherwise(0))
    cut = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return gone.withColumn("t", F.col("t") - cut).where(~F.col("_r")).select(*df.columns)


def clip_quantile(df: DataFrame, q: float, splice: bool = False, keys=()) -> DataFrame:
    """Remove values whose magnitude is above the ``q``-quantile of magnitudes."""
    if not 0 < q <= 1:
        raise ValueError("q must be above 0 and at most 1")
    out = _per_series(df, keys, _q=F.expr(f"percentile(abs(x), {float(q)!r}D)"))
    return remove_rows(out, F.abs("x") > F.col("_q"), splice, keys).select(*df.columns)


def clip_sigma(df: DataFrame, k: float = 3.0, center: str = "mean", scale: str = "std", splice: bool = False, keys=()) -> DataFrame:
    """Remove values further than ``k`` scales from the centre: mean or median, std or mad (about the median).

    A series whose scale isn't positive is an error.
    """
    if k <= 0 or center not in ("mean", "median") or scale not in ("std", "mad"):
        raise ValueError("bad parameters of clip_sigma")
    out = _per_series(df, keys, _mean=F.avg("x"), _median=F.expr("percentile(x, 0.5)"), _std=F.stddev_samp("x"))
    out = _per_series(out, keys, _mad=F.expr("1.4826D * percentile(abs(x - _median), 0.5)"))
    width = F.col("_std" if scale == "std" else "_mad")
    none = F.raise_error(F.lit(f"the observed values have no positive {scale}")).cast("boolean")
    far = F.when(F.coalesce(width <= 0, F.lit(True)), none).otherwise(F.abs(F.col("x") - F.col(f"_{center}")) > k * width)
    return remove_rows(out, far, splice, keys).select(*df.columns)


def extreme_cut(counts: list[tuple[float, int]], n_rows: int, fraction: float, digits: int) -> tuple[float, int]:
    """The last cut of the passes and their number, from distinct magnitudes with counts, largest first.

    The first pass cuts at the whole number below the largest magnitude, later
    ones at ``digits`` decimals, until at most ``1 - fraction`` of all rows, missing
    ones among them, is left. A pass must remove something and leave something.
    """
    if not counts:
        raise ValueError("the series has no observed value")
    left, cut, passes, at = n_rows, math.nan, 0, 0
    while left / n_rows > 1 - fraction:
        s = 10.0 ** (digits if passes else 0)
        cut, begun = math.floor(counts[at][0] * s) / s, at
        while at < len(counts) and counts[at][0] >= cut:
            left -= counts[at][1]
            at += 1
        passes += 1
        if at == begun:
            raise ValueError(f"clip_extremes made no progress at cut {cut}")
        if at == len(counts):
            raise ValueError("clip_extremes removes every observation")
    return cut, passes


def clip_extremes(df: DataFrame, fraction: float = 0.004, digits: int = 0, splice: bool = False, keys=()) -> DataFrame:
    """Remove the largest magnitudes in passes until a fraction of all rows is gone.

    Series by series on the distinct magnitudes with their counts.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    import pandas as pd

    hist = df.groupBy(*keys, F.abs("x").alias("m")).count()
    hist = _with_totals(hist, keys)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "_cut double"])

    def cut(pdf):
        rows = pdf[pdf["m"].notna()].sort_values("m", ascending=False)
        c, _ = extreme_cut(list(zip(rows["m"], rows["count"])), int(pdf["_rows"].iloc[0]), fraction, digits)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "_cut": c}])

    cuts = hist.groupBy(*(keys or [F.lit("")])).applyInPandas(cut, schema)
    return remove_rows(join_series(df, cuts, keys), F.abs("x") >= F.col("_cut"), splice, keys).select(*df.columns)


def _with_totals(hist: DataFrame, keys) -> DataFrame:
    return hist.withColumn("_rows", F.sum("count").over(Window.partitionBy(*keys)))


@dataclass(frozen=True)
class Record:
    """What was done to a series, in order; every step makes a new one."""

    steps: tuple[dict, ...] = field(default=())

    def with_step(self, op: str, **parameters) -> Record:
        return Record((*self.steps, {"op": op, **parameters}))

    def tag(self) -> str:
        return "-".join(step_tag(s) for s in self.steps) or "raw"


# The short name of a step, and the parameter (with its default) that follows it.
TAGS = {
    "select_range": ("range", None),
    "exclude_intervals": ("cut", None),
    "collapse_ties": ("ties", None),
    "round": ("round", ("digits", 0)),
    "trailing_mean_fluctuations": ("trailing", ("window", 1)),
    "log_returns": ("logret", None),
    "log_levels": ("loglevels", None),
    "differences": ("diff", None),
    "detrend_moving_average": ("detrend", ("window", 1)),
    "clip_quantile": ("clip", ("q", 1.0)),
    "clip_sigma": ("sigma", ("k", 3)),
    "clip_extremes": ("prune", ("fraction", 0.004)),
}
TRAILING = {"mean": "", "scale": "scaled", "none": "abs"}


def step_tag(step: dict) -> str:
    """A step's short name for paths; steps that aren't transforms go by their own."""
    name, parameter = TAGS.get(step["op"], (step["op"], None))
    tag = name + (str(step.get(*parameter)) if parameter else "")
    return tag + (TRAILING[step.get("denominator", "mean")] if step["op"] == "trailing_mean_fluctuations" else "")


#: Step name to transform.
STEPS: dict[str, Callable] = {
    "select_range": lambda df, keys=(), **p: select_range(df, p.pop("from", None), p.pop("to", None), keys, **p),
    "exclude_intervals": exclude_intervals,
    "collapse_ties": collapse_ties,
    "round": round_values,
    "trailing_mean_fluctuations": trailing_mean_fluctuations,
    "log_returns": log_returns,
    "log_levels": log_levels,
    "differences": differences,
    "detrend_moving_average": detrend_moving_average,
    "clip_quantile": clip_quantile,
    "clip_sigma": clip_sigma,
    "clip_extremes": clip_extremes,
}


def check_finite(df: DataFrame, op: str) -> DataFrame:
    return _require(df, F.isnan("x") | (F.abs("x") == float("inf")), f"{op} gave a value that is not finite")


def apply_steps(df: DataFrame, steps: list[dict], keys=(), record: Record | None = None) -> tuple[DataFrame, Record]:
    """Run steps ``{"op": name, **parameters}`` in order."""
    record = record or Record()
    for s in steps:
        parameters = {k: v for k, v in s.items() if k != "op"}
        if s["op"] not in STEPS:
            raise ValueError(f"unknown step {s['op']!r}")
        df = check_finite(STEPS[s["op"]](df, **parameters, keys=keys), s["op"])
        record = record.with_step(s["op"], **parameters)
    return df, record
