"""Gaps of the record: detection, declaration, structure, and the class of each wait.

A gap is a half-open interval ``[start, stop)`` with a kind and a source. Gap frames
have the key columns and ``start, stop, kind, source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import join_series
from ..functions.neighbours import kept, lookup, numbered, ranges, with_previous

# Fixed values of the data model.
GAP_KINDS = ("session", "gap", "hole", "declared", "detected")
CLASS_EXACT, CLASS_GAP_CROSSING, CLASS_RIGHT_CENSORED = 1, 2, 3
UNBOUNDED = 9223372036854775807
#: Slots that :func:`observed_mask` makes at most.
MASK_SLOTS = 1_000_000_000
#: Slots that are made from one array.
MASK_PART = 1 << 16
#: Gaps of one series that are broadcast at most, 24 bytes each.
BROADCAST_GAPS = 50_000


def _series(keys, *order):
    return Window.partitionBy(*keys).orderBy(*(order or ("t",)))


def detect_gaps(df: DataFrame, cadence: int = 1, keys=(), source: str = "") -> DataFrame:
    """Where neighbouring times are further apart than the cadence."""
    if cadence < 1:
        raise ValueError("the cadence must be positive")
    far = with_previous(df.select(*keys, "t"), "t", "b", keys).where(F.col("t") - F.col("b") > cadence)
    return far.select(*keys, (F.col("b") + 1).alias("start"), F.col("t").alias("stop"), F.lit("detected").alias("kind"), F.lit(source).alias("source"))


def check_gap_kind(kind: str) -> str:
    for part in kind.split("+"):
        if part not in GAP_KINDS and part != "unknown":
            raise ValueError(f"unknown gap kind {part!r}")
    return kind


def join_kinds(a: str, b: str) -> str:
    """Distinct kinds of both, the most specific first."""
    parts = {*a.split("+"), *b.split("+")}
    return "+".join(sorted(parts, key=lambda k: GAP_KINDS.index(k) if k in GAP_KINDS else len(GAP_KINDS)))


def join_sources(a: str, b: str) -> str:
    return ";".join(dict.fromkeys(x for s in (a, b) for x in s.split(";") if x))


def merge_gaps(entries) -> list[tuple[int, int, str, str]]:
    """One disjoint, sorted list from declared and detected ``(start, stop, kind, source)``.

    Declared entries that overlap become one with both kinds; those that touch do
    only if of one kind. Detected entries that overlap or touch become one; one that
    overlaps declared ones is absorbed: they are stretched over it, and the space between two goes to the earlier.
    """
    entries = [(int(a), int(b), check_gap_kind(k), s) for a, b, k, s in entries]
    if any(a >= b for a, b, _, _ in entries):
        raise ValueError("a gap must end after its start")
    joined: list[list] = []
    for a, b, k, s in sorted(e for e in entries if e[2] != "detected"):
        last = joined[-1] if joined else None
        if last and (a < last[1] or a == last[1] and k == last[2]):
            last[1] = max(last[1], b)
            last[2], last[3] = (last[2] if k == last[2] else join_kinds(last[2], k)), join_sources(last[3], s)
        else:
            joined.append([a, b, k, s])
    spans: list[list] = []
    for a, b, k, s in sorted(e for e in entries if e[2] == "detected"):
        if spans and a <= spans[-1][1]:
            spans[-1][1], spans[-1][3] = max(b, spans[-1][1]), join_sources(spans[-1][3], s)
        else:
            spans.append([a, b, k, s])
    alone, at = [], 0
    for a, b, k, s in spans:
        # both lists are sorted, and a stretched entry ends before the next span begins
        while at < len(joined) and joined[at][1] <= a:
            at += 1
        end = at
        while end < len(joined) and joined[end][0] < b:
            end += 1
        if end == at:
            alone.append([a, b, k, s])
            continue
        joined[at][0] = min(a, joined[at][0])
        joined[end - 1][1] = max(b, joined[end - 1][1])
        for i in range(at, end - 1):
            joined[i][1] = joined[i + 1][0]
    return [tuple(g) for g in sorted(joined + alone)]


def declare_gaps(gaps: DataFrame, declared: DataFrame, keys=()) -> DataFrame:
    """Gap frames of one run merged series by series.

    Only entries that overlap or touch, directly or by others, have to do with each
    other. Where one series without keys has many, they are cut into chains of such,
    and a task merges those that begin in one range.
    """
    cols = [*keys, "start", "stop", "kind", "source"]
    both = gaps.select(*cols).unionByName(declared.select(*cols))

    def merged(pdf):
        import pandas as pd

        rows = merge_gaps(pdf[["start", "stop", "kind", "source"]].itertuples(index=False, name=None))
        out = pd.DataFrame(rows, columns=["start", "stop", "kind", "source"])
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iloc[0]] * len(out))
        return out[cols]

    cut = ranges(both, "start", keys)
    if cut is None:
        return both.groupBy(*(keys or [F.lit("")])).applyInPandas(merged, both.schema)
    # a chain begins where all entries before have ended
    placed, reach, chain, ends, begun = both.withColumn("_range", cut.place("start")), None, None, [], []
    tops = cut.each(placed, F.max("stop").alias("top"))
    for r in tops:
        ends.append(reach)
        reach = max((x for x in (reach, r and r["top"]) if x is not None), default=None)
    w = Window.partitionBy("_range").orderBy("start")
    before = F.greatest(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), lookup(ends))
    chained = kept(placed.withColumn("_chain", F.when(before.isNull() | (F.col("start") > before), F.col("start"))))
    for r in cut.each(chained, F.max("_chain").alias("last")):
        begun.append(chain)
        chain = chain if r is None or r["last"] is None else r["last"]
    own = F.coalesce(F.max("_chain").over(w.rowsBetween(Window.unboundedPreceding, 0)), lookup(begun))
    chained = chained.withColumn("_chain", own).withColumn("_range", cut.place("_chain"))
    return chained.select("_range", *cols).groupBy("_range").applyInPandas(lambda pdf: merged(pdf), both.schema)


def validate_gaps(df: DataFrame, gaps: DataFrame, keys=()) -> None:
    """Raise unless gaps are disjoint, inside the record and without observations."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b")) if keys else df.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    placed = join_series(gaps, ends, keys, "left")
    after = F.lag("stop").over(_series(keys, "start"))
    bad = placed.withColumn("_p", after).where("stop <= start OR start < _a OR stop > _b OR start < _p OR _a IS NULL")
    if not bad.isEmpty():
        raise ValueError("gaps must be disjoint, not empty and inside the record")
    if not next_gap(df, gaps, keys, None if keys else df).where("inside").isEmpty():
        raise ValueError("a gap holds an observation")


def gap_table(gaps: DataFrame) -> DataFrame:
    """Gaps with their length, the longest first."""
    return gaps.withColumn("length", F.col("stop") - F.col("start")).orderBy(F.desc("length"), "start")


def next_gap(df: DataFrame, gaps: DataFrame, keys=(), series: DataFrame | None = None) -> DataFrame:
    """``df`` with the next gap's start, the last time before it, the last gap's stop, and whether inside one.

    One sorted pass over observations and gaps together, no range join. With
    ``series``, which has the times of ``df``, that are the same for all ``keys``, a
    long one is passed over in ranges; a range gets the last time and gap before it
    and the first gap behind it.
    """
    extra = [c for c in df.columns if c not in (*keys, "t")]
    obs = df.select(*keys, "t", F.lit(1).alias("_o"), F.lit(None).cast("long").alias("_gs"), F.lit(None).cast("long").alias("_ge"), F.struct(*(extra or ["t"])).alias("_x"))
    gap = gaps.select(*keys, F.col("start").alias("t"), F.lit(0).alias("_o"), F.col("start").alias("_gs"), F.col("stop").alias("_ge"), F.lit(None).cast(obs.schema["_x"].dataType).alias("_x"))
    both, by, cut = obs.unionByName(gap), keys, None if series is None else ranges(series)
    if cut is not None:
        both, by = both.withColumn("_range", cut.place("t")), [*keys, "_range"]
    w = _series(by, "t", "_o")
    last = F.last(F.when(F.col("_o") == 1, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # backwards, as a frame that ends at the partition's end is computed anew for every row
    ahead = _series(by, F.desc("t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.last(F.when(F.col("_o") == 0, F.struct("_gs", "_last")), ignorenulls=True).over(ahead)
    behind = F.last("_ge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if cut is not None:
        times, stops, starts, lasts = _around(cut, series, gaps)
        last, behind = F.coalesce(last, lookup(times)), F.coalesce(behind, lookup(stops))
        nearest = F.coalesce(nearest, F.when(lookup(starts).isNotNull(), F.struct(lookup(starts).alias("_gs"), lookup(lasts).alias("_last"))))
    out = both.withColumn("_last", last).withColumns({"_n": nearest, "_b": behind}).where("_o = 1")
    return out.select(*keys, "t", *[F.col(f"_x.{c}").alias(c) for c in extra], F.col("_n._gs").alias("gap_start"), F.col("_n._last").alias("last_before"), F.coalesce(F.col("_b") > F.col("t"), F.lit(False)).alias("inside"), F.col("_b").alias("last_stop"))


def _around(cut, series: DataFrame, gaps: DataFrame) -> tuple[list, list, list, list]:
    """For each range: the last time and the last gap's stop before it, and the first gap behind it with the last time before that."""
    held = cut.each(gaps.select("start", "stop").distinct().withColumn("_range", cut.place("start")), F.min("start").alias("first"), F.max_by("stop", "start").alias("stop"))
    first = [g and g["first"] for g in held]
    seen = cut.each(series.select("t").withColumn("_range", cut.place("t")), F.max("t").alias("last"), F.max(F.when(F.col("t") < lookup(first), F.col("t"))).alias("before"))
    times, stops, time, stop = [], [], None, None
    for g, r in zip(held, seen):
        times.append(time)
        stops.append(stop)
        time, stop = r["last"] if r else time, g["stop"] if g else stop
    starts, lasts, start, last = [], [], None, None
    for g, r, time in reversed(list(zip(held, seen, times))):
        starts.append(start)
        lasts.append(last)
        if g:
            start, last = g["first"], time if r is None or r["before"] is None else r["before"]
    return times, stops, starts[::-1], lasts[::-1]


def classify(waits: DataFrame, gaps: DataFrame, keys=(), series: DataFrame | None = None) -> DataFrame:
    """Waits with ``class`` (1 exact, 2 gap-crossing, 3 right-censored), ``lower`` and ``upper``.

    A wait crosses a gap if the next gap after its start begins before its end;
    what is certain then, as for a wait that never ends, is the time to the last
    observation before that gap, or before the end of the record. The last index
    is right-censored with both bounds 0, which no other row has.

    With ``series``, the frame the waits were made of, one series without keys is
    classified in place: its gaps, if they are few enough, are broadcast, and no
    wait is sorted or moved. Otherwise its times and gaps are passed over in ranges,
    and each wait learns from its time's row what it needs. Waits of series with
    keys are sorted with their gaps by series and threshold.
    """
    if series is not None and not keys:
        few = gaps.select("start", "stop").limit(BROADCAST_GAPS + 1).toArrow()
        if few.num_rows <= BROADCAST_GAPS:
            return _classified_in_place(waits, few["start"].to_numpy(), series)
        own = next_gap(series.select("t"), gaps, (), series).select(F.col("t").alias("_t"), "gap_start", "last_before")
        out = waits.join(own, F.col("t") == F.col("_t"), "left").crossJoin(F.broadcast(series.agg(F.max("t").alias("last"))))
    else:
        deltas = F.broadcast(waits.select("delta").distinct())
        by = [*keys, "delta"]
        out = next_gap(waits, gaps.crossJoin(deltas), by).withColumn("last", F.max("t").over(Window.partitionBy(*by)))
    crossing = F.col("gap_start").isNotNull() & (F.col("gap_start") < F.col("t") + F.col("tau"))
    open_ = F.col("tau") == 0
    return out.select(
        *waits.columns,
        F.when(open_, CLASS_RIGHT_CENSORED).when(crossing, CLASS_GAP_CROSSING).otherwise(CLASS_EXACT).cast("int").alias("class"),
        F.when(open_ | crossing, F.coalesce("last_before", "last") - F.col("t")).otherwise(F.col("tau")).alias("lower"),
        F.when(F.col("t") == F.col("last"), F.lit(0)).when(open_, F.lit(UNBOUNDED)).otherwise(F.col("tau")).alias("upper"),
    )


def _classified_in_place(waits: DataFrame, few, series: DataFrame) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    starts = np.sort(few).astype(np.int64)

    def latest(batches):
        for b in batches:
            t = b.column(0).to_numpy()
            g = np.searchsorted(starts, t, side="right")
            found = np.unique(g)
            tops = np.full(len(starts) + 1, np.iinfo(np.int64).min)
            np.maximum.at(tops, g, t)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(tops[found])], names=["g", "t"])

    # the last observation before each gap, and the last one of all
    before = np.full(len(starts) + 1, np.iinfo(np.int64).min)
    for g, t in series.select("t").mapInArrow(latest, "g long, t long").groupBy("g").agg(F.max("t")).collect():
        before[g] = t
    last = int(before.max())
    before = np.maximum.accumulate(before)
    shared = waits.sparkSession.sparkContext.broadcast((starts, before))
    schema = waits.withColumns({"class": F.lit(0), "lower": F.lit(0).cast("long"), "upper": F.lit(0).cast("long")}).schema

    def classed(batches):
        starts, before = shared.value
        for b in batches:
            t, tau = b.column("t").to_numpy(), b.column("tau").to_numpy()
            g = np.searchsorted(starts, t, side="right")
            begins = np.r_[starts, UNBOUNDED][g]
            open_, crossing = tau == 0, (tau > 0) & (begins < t + tau)
            kind = np.where(open_, CLASS_RIGHT_CENSORED, np.where(crossing, CLASS_GAP_CROSSING, CLASS_EXACT)).astype(np.int32)
            lower = np.where(open_ | crossing, before[g] - t, tau)
            upper = np.where(t == last, 0, np.where(open_, UNBOUNDED, tau))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind), pa.array(lower), pa.array(upper)], names=[*b.schema.names, "class", "lower", "upper"])

    return waits.mapInArrow(classed, schema)


def candidates(classified: DataFrame) -> DataFrame:
    """All indices but the last of each series, which alone has the upper bound 0."""
    return classified.where("upper <> 0")


def class_totals(classified: DataFrame, keys=()) -> DataFrame:
    """Candidates and their classes for each series and threshold; the last index is no candidate."""
    count = lambda k, name: F.count_if(F.col("class") == k).alias(name)
    return candidates(classified).groupBy(*keys, "delta").agg(F.count("*").alias("n_candidates"), count(1, "n_exact"), count(2, "n_gap_crossing"), count(3, "n_right_censored"))


def sampling_step(df: DataFrame, keys=()) -> DataFrame:
    """``(keys, step)``: the greatest common divisor of all spacings; null with one row."""
    d = with_previous(df.select(*keys, "t"), "t", "b", keys).select(*keys, (F.col("t") - F.col("b")).alias("d")).where("d IS NOT NULL").distinct()

    def divisor(pdf):
        import numpy as np
        import pandas as pd

        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "step": int(np.gcd.reduce(pdf["d"].to_numpy()))}])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "step long"])
    # distinct spacings of parts first, so that a task sees few numbers for a long series
    parts = d.withColumn("_s", F.pmod(F.xxhash64("d"), F.lit(64)))
    first = parts.groupBy(*keys, "_s").applyInPandas(divisor, schema)
    return first.withColumnRenamed("step", "d").groupBy(*(keys or [F.lit("")])).applyInPandas(divisor, schema)


def record_length(df: DataFrame, keys=()) -> DataFrame:
    """``(keys, record_length)``: sampling slots from the first to the last time."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    step = sampling_step(df, keys)
    # one observation has no spacing and one slot
    both = join_series(ends, step, keys, "left") if keys else ends.join(step, F.lit(True), "left")
    return both.select(*keys, (F.expr("(b - a) div coalesce(step, 1)") + 1).alias("record_length"))


def observed_mask(df: DataFrame, keys=(), max_length: int = MASK_SLOTS) -> DataFrame:
    """``(keys, slot, observed)`` for every sampling slot of the record."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    step = sampling_step(df, keys)
    both = (join_series(ends, step, keys, "left") if keys else ends.join(step, F.lit(True), "left")).withColumn("step", F.coalesce("step", F.lit(1).cast("long")))
    if not both.where(F.expr(f"(b - a) div step >= {max_length}")).isEmpty():
        raise ValueError(f"the mask would have more than {max_length} slots")
    # an array for each part of a series, so that none is longer than a part
    parts = both.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"((b - a) div step) div {MASK_PART}"))))
    slots = parts.select(*keys, "a", "step", F.explode(F.sequence(F.col("part") * MASK_PART, F.least(F.expr("(b - a) div step"), (F.col("part") + 1) * MASK_PART - 1))).alias("slot"))
    slots = slots.withColumn("t", F.col("a") + F.col("slot") * F.col("step"))
    seen = df.select(*keys, "t", F.lit(True).alias("_seen"))
    return join_series(slots, seen, [*keys, "t"], "left").select(*keys, "slot", F.coalesce("_seen", F.lit(False)).alias("observed"))


def segment_table(df: DataFrame, gaps: DataFrame, keys=()) -> DataFrame:
    """Stretches without gap: segment, start, stop (one step after the last time), length, and the kinds around."""
    kinds = gaps.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"), "kind")
    # a segment's rows share the stop of the last gap before them
    placed = next_gap(df.select(*keys, "t"), gaps, keys, None if keys else df.select("t"))
    runs = placed.groupBy(*keys, "last_stop").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("length"), F.max("gap_start").alias("gap_start"))
    runs = numbered(runs if keys else kept(runs), keys, "first", "segment")
    before = kinds.select(*keys, F.col("_e").alias("last_stop"), F.col("kind").alias("kind_before"))
    after = kinds.select(*keys, F.col("_s").alias("gap_start"), F.col("kind").alias("kind_after"))
    out = join_series(join_series(runs, before, [*keys, "last_stop"], "left"), after, [*keys, "gap_start"], "left")
    empty = F.lit("")
    return out.select(*keys, "segment", F.col("first").alias("start"), F.col("last").alias("end"), "length", F.coalesce("kind_before", empty).alias("kind_before"), F.coalesce("kind_after", empty).alias("kind_after"))


def erosion_weight(segments: DataFrame, k: int, keys=()) -> DataFrame:
    """``(keys, weight)``: indices with k observations after them in their segment."""
    return segments.groupBy(*keys).agg(F.sum(F.greatest(F.col("length") - k, F.lit(0))).cast("long").alias("weight"))


def _from_first(df: DataFrame, keys) -> DataFrame:
    """The frame with ``_f``, the first observed row of its series."""
    return join_series(df, df.groupBy(*keys).agg(F.min(F.when(F.col("x").isNotNull(), F.col("row"))).alias("_f")), keys)


def index_axis(df: DataFrame, gaps: DataFrame, keys=()) -> DataFrame:
    """The series on the axis of row ordinals, counted from the first observed row.

    ``df`` has row, t and x; rows without x keep their ordinal and become gaps.
    """
    return _from_first(df, keys).where("x IS NOT NULL").select(*keys, (F.col("row") - F.col("_f") + 1).alias("t"), F.col("t").alias("time_original"), "row", "x")


def index_gaps(df: DataFrame, gaps: DataFrame, keys=()) -> DataFrame:
    """Gaps of the index axis: declared ones by the rows they hold; those that hold none close."""
    rows = _from_first(df, keys).select(*keys, "t", (F.col("row") - F.col("_f") + 1).alias("i"), "x")
    placed = next_gap(rows, gaps, keys, None if keys else rows).where("inside AND x IS NULL")
    held = placed.groupBy(*keys, F.col("last_stop").alias("stop")).agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"))
    return join_series(held, gaps.select(*keys, "stop", "kind", "source"), [*keys, "stop"]).select(*keys, F.col("a").alias("start"), F.col("b").alias("stop"), "kind", "source")


def describe(df: DataFrame, gaps: DataFrame, digits: int = 0, keys=()) -> DataFrame:
    """One row for each series: sizes, ends, values in data units, step, segments and gaps.

    ``gap_share`` is the part of the time from the first to the last observation
    that gaps cover, and ``gaps_by_kind`` maps each kind to its count and share.
    """
    x = F.col("q") / F.lit(10.0**digits)
    base = df.withColumn("_x", x).groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("first_time"), F.max("t").alias("last_time"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"), F.expr("percentile(_x, 0.5)").alias("median"))
    named = lambda name: [F.col(k).alias(k) for k in keys] + [F.col(name)]
    out = join_series(base, record_length(df, keys).select(*named("record_length")), keys)
    step = sampling_step(df, keys)
    out = join_series(out, step, keys, "left") if keys else out.join(F.broadcast(step), F.lit(True), "left")
    segments = segment_table(df.select(*keys, "t"), gaps, keys).groupBy(*keys).agg(F.count("*").alias("n_segments"))
    out = join_series(out, segments, keys)
    length = F.sum(F.col("stop") - F.col("start"))
    kinds = gaps.groupBy(*keys, "kind").agg(F.count("*").alias("count"), length.alias("length"))
    of = kinds.groupBy(*keys).agg(F.sum("count").alias("n_gaps"), F.sum("length").alias("_covered"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.struct("count", "length"))))).alias("_kinds"))
    out = join_series(out, of, keys, "left")
    span = F.col("last_time") - F.col("first_time")
    share = lambda c: F.when(span > 0, c / span).otherwise(F.lit(0.0))
    kinds = F.transform_values(F.col("_kinds"), lambda _, v: F.struct(v["count"].alias("count"), share(v["length"]).alias("share")))
    none = F.expr("cast(map() as map<string, struct<count: bigint, share: double>>)")
    return out.select(*keys, "n", "record_length", "first_time", "last_time", "min", "max", "mean", "median", F.lit(digits).alias("digits"), F.col("step").alias("sampling_step"), "n_segments", F.coalesce("n_gaps", F.lit(0)).cast("long").alias("n_gaps"), share(F.coalesce("_covered", F.lit(0))).alias("gap_share"), F.coalesce(kinds, none).alias("gaps_by_kind"))
