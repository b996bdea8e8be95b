"""Registered queries of the first-passage engine and their oracle SQL.

The series are made of ``events``: the time is ``event_id``, the value ``value``
with two digits; ``missing`` variants take values of type ``error`` as missing.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.grid import linear_grid, log_grid, on_grid, quantize
from .operators import diagnostics, distribution, gaps, passage, prepare
from .plans.storage import Collection
from .sources import readers
from .streaming.online import online_snapshots

DIGITS = 2
DELTAS = ["5", "50", "200"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def grid_series(spark, sf_dir, *keys) -> DataFrame:
    return events(spark, sf_dir).select(*keys, F.col("event_id").alias("t"), quantize(F.col("value"), DIGITS).alias("q"))


def raw_series(spark, sf_dir, *keys) -> DataFrame:
    """Rows with missing values, numbered from 1."""
    e = events(spark, sf_dir)
    return e.select(*keys, (F.col("event_id") + 1).alias("row"), F.col("event_id").alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"))


def observed_series(spark, sf_dir, *keys) -> DataFrame:
    return raw_series(spark, sf_dir, *keys).where("x IS NOT NULL").select(*keys, "t", quantize(F.col("x"), DIGITS).alias("q"))


def flagship(spark, sf_dir) -> DataFrame:
    """Distributions of three thresholds over all events."""
    s = grid_series(spark, sf_dir)
    w = passage.first_passage(s, DELTAS, DIGITS)
    return distribution.empirical_distribution(gaps.classify(w, gaps.detect_gaps(s), series=s))


Q = "cast(round_even(round_even(value*100,0)/100*100,0) as bigint)"
D = "d(d,delta) as (values (500,'5.00'),(5000,'50.00'),(20000,'200.00'))"
S = f"s as (select event_id t, {Q} q, row_number() over (order by event_id) n from events)"
W = "w as (select d.delta, d.d, a.n, a.t, a.q, coalesce(min(b.t)-a.t,0) tau from d cross join s a left join s b on b.t>a.t and b.q>=a.q+d.d group by d.delta,d.d,a.n,a.t,a.q)"
WAITS_SQL = f"with {S}, {D}, {W} select delta, d, n, t, q, tau from w"
KS = f"s as (select user_id, event_id t, {Q} q, row_number() over (partition by user_id order by event_id) n from events)"
KW = "w as (select a.user_id, d.delta, d.d, a.n, a.t, a.q, coalesce(min(b.t)-a.t,0) tau from d cross join s a left join s b on b.user_id=a.user_id and b.t>a.t and b.q>=a.q+d.d group by a.user_id,d.delta,d.d,a.n,a.t,a.q)"
RAW = "r as (select event_id+1 as \"row\", event_id t, case when event_type<>'error' then value end x from events)"
OBS = f"{RAW}, s as (select t, cast(round_even(round_even(x*100,0)/100*100,0) as bigint) q, row_number() over (order by t) n from r where x is not null)"
GAP = "g as (select b+1 as start, t as stop from (select t, lag(t) over (order by t) b from s) where t-b>1)"
CLS = f"""{OBS}, {GAP}, {D}, {W},
gn as (select s.n, min(g.start) gs from s left join g on g.start>s.t group by s.n),
gl as (select g.start, max(s.t) lt from g join s on s.t<g.start group by g.start),
c as (select w.delta, w.n, w.t, w.tau,
  cast(case when tau=0 then 3 when gs is not null and gs<w.t+tau then 2 else 1 end as integer) as class,
  case when tau=0 then coalesce(gl.lt,(select max(t) from s))-w.t when gs is not null and gs<w.t+tau then gl.lt-w.t else tau end as lower,
  case when w.n=(select max(n) from s) then 0 when tau=0 then 9223372036854775807 else tau end as upper
  from w join gn using(n) left join gl on gl.start=gn.gs),
k as (select * from c where n < (select max(n) from s))"""
KOBS = "r as (select user_id, event_id t, case when event_type<>'error' then value end x from events), s as (select user_id, t, cast(round_even(round_even(x*100,0)/100*100,0) as bigint) q, row_number() over (partition by user_id order by t) n from r where x is not null)"
KCLS = f"""{KOBS}, g as (select user_id, b+1 as start, t as stop from (select user_id, t, lag(t) over (partition by user_id order by t) b from s) where t-b>1), {D}, {KW},
e as (select user_id, max(t) last, max(n) top from s group by user_id),
gn as (select s.user_id, s.n, min(g.start) gs from s left join g on g.user_id=s.user_id and g.start>s.t group by s.user_id, s.n),
gl as (select g.user_id, g.start, max(s.t) lt from g join s on s.user_id=g.user_id and s.t<g.start group by g.user_id, g.start),
c as (select w.user_id, w.delta, w.n, w.t, w.tau, e.top,
  cast(case when tau=0 then 3 when gs is not null and gs<w.t+tau then 2 else 1 end as integer) as class,
  case when tau=0 then coalesce(gl.lt,e.last)-w.t when gs is not null and gs<w.t+tau then gl.lt-w.t else tau end as lower,
  case when w.n=e.top then 0 when tau=0 then 9223372036854775807 else tau end as upper
  from w join e using(user_id) join gn using(user_id, n) left join gl on gl.user_id=w.user_id and gl.start=gn.gs)"""
DIST_TAIL = """h as (select delta, tau, count(*) as count, count(*) filter (class=1) as count_exact, count(*) filter (class=2) as count_gap_crossing from kk group by delta, tau)
select delta, tau, count, cast(count as double)/cast(sum(count) over (partition by delta) as double) as pmf,
 cast(sum(count) over (partition by delta order by tau) as double)/cast(sum(count) over (partition by delta) as double) as cdf,
 1.0-cast(sum(count) over (partition by delta order by tau) as double)/cast(sum(count) over (partition by delta) as double) as ccdf,
 count_exact, count_gap_crossing from h"""


def _waits(strategy):
    return lambda s, d: passage.first_passage(grid_series(s, d), DELTAS, DIGITS, strategy=strategy)


def _classified(s, d):
    o = observed_series(s, d)
    return gaps.classify(passage.first_passage(o, DELTAS, DIGITS), gaps.detect_gaps(o), series=o)


def _classified_keyed(s, d):
    o = observed_series(s, d, "user_id")
    return gaps.classify(passage.first_passage(o, DELTAS, DIGITS, ["user_id"]), gaps.detect_gaps(o, keys=["user_id"]), ["user_id"])


def _user_waits(strategy):
    return lambda s, d: passage.first_passage(grid_series(s, d, "user_id"), DELTAS, DIGITS, ["user_id"], strategy)


def _segments(s, d):
    o = observed_series(s, d)
    return gaps.segment_table(o, gaps.detect_gaps(o))


def _describe(s, d):
    o = observed_series(s, d)
    out = gaps.describe(o, gaps.detect_gaps(o), DIGITS).withColumn("mean", F.round("mean", 9)).withColumn("gap_share", F.round("gap_share", 12))
    kind = F.col("gaps_by_kind")["detected"]
    return out.withColumns({"detected_count": kind["count"], "detected_share": F.round(kind["share"], 12)}).drop("gaps_by_kind")


def _tied(spark, sf_dir) -> DataFrame:
    """Events on a minute axis, with equal times."""
    e = events(spark, sf_dir)
    return e.select((F.col("event_id") + 1).alias("row"), F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"))


def _user_raw(s, d):
    return raw_series(s, d, "user_id")


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Values to digits that neither the order of a sum nor the math library moves."""
    return df.withColumn("x", F.round("x", digits))


def _index_axis(s, d):
    return gaps.index_axis(raw_series(s, d), None)


def _gaps_declared(s, d):
    """Detected gaps, of which some hold a declared hole at their start or a session at their end."""
    found = gaps.detect_gaps(observed_series(s, d))
    holes = found.where("start % 3 = 0").select("start", (F.col("start") + 1).alias("stop"), F.lit("hole").alias("kind"), F.lit("a").alias("source"))
    sessions = found.where("stop - start >= 3").select((F.col("stop") - 1).alias("start"), "stop", F.lit("session").alias("kind"), F.lit("b").alias("source"))
    return gaps.declare_gaps(found, holes.unionAll(sessions))


def _thresholds(s, d):
    rows = [("linear", x.d, str(x)) for x in linear_grid(0, 5, 0.25, DIGITS)] + [("log", x.d, str(x)) for x in log_grid(0.1, 1000, 5, DIGITS)]
    return s.createDataFrame(rows, "kind string, d long, delta string")


def _workspace(spark: SparkSession, label: str) -> str:
    """A new folder for what a query writes: in the shared folder, or in a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="passagelab-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def _written_lines(s, d, name: str, header: str, line) -> str:
    """The events as text files in their order, a line each, behind the header that every file has; returns their folder."""
    path = _workspace(s, name)
    lines = events(s, d).select(F.col("event_id").alias("o"), line.alias("value"))

    def headed(batches):
        first = [header]
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": first + b.column("value").to_pylist()})
            first = []
        if first:
            yield pa.RecordBatch.from_pydict({"value": first})

    lines.repartitionByRange("o").sortWithinPartitions("o").select("value").mapInArrow(headed, "value string").write.text(path)
    return path


def _read_csv(s, d):
    """Quoted cells with delimiters and quotes in them, blank values, and millisecond stamps."""
    value = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("value").cast("string"))
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat(F.lit('"a,""b"" '), F.col("event_type"), F.lit('",'), value, F.lit(",\""), stamp, F.lit('Z"'))
    path = _written_lines(s, d, "csv", "note,value,time", line)
    return readers.read_series(s, path, format="csv", value_column="value", time_column="time", time_unit="microsecond")


def _read_dat(s, d):
    """Numbers between runs of blanks."""
    path = _written_lines(s, d, "dat", "second  value", F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit("    "), F.col("value").cast("string")))
    return readers.read_series(s, path, format="dat", value_column=2, time_column="second", time_unit="second")


def _collection(s, d) -> Collection:
    """A collection of the flagship series, as the pipeline writes it."""
    c = Collection(s, _workspace(s, "collection"))
    o, deltas = observed_series(s, d), [f"{x}.00" for x in DELTAS]
    w = c.write_waits(_classified(s, d), deltas)
    dist = distribution.empirical_distribution(w)
    c.write_series(o, gaps.detect_gaps(o), _segments(s, d))
    c.write_partitions(dist, distribution.censoring_counts(w), distribution.accounting(w).join(distribution.index_entry(dist), "delta", "left"), deltas)
    return c


def _online(s, d):
    """The last snapshot of every user's stream, fed in three files."""
    at = _workspace(s, "online")
    rows = events(s, d).select("user_id", F.col("event_id").alias("t"), F.col("value").alias("x"))
    n = rows.agg(F.max("t")).first()[0] or 0
    for i in range(3):
        part = rows.where((F.col("t") * 3 >= i * (n + 1)) & (F.col("t") * 3 < (i + 1) * (n + 1)))
        part.repartition(1).write.mode("append").parquet(f"{at}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    snapshots = online_snapshots(stream, DELTAS, DIGITS, ["user_id"])
    query = snapshots.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = s.read.parquet(f"{at}/out")
    last = found.groupBy("user_id").agg(F.max("n_seen").alias("n_seen"))
    return found.join(last, ["user_id", "n_seen"]).where("count > 0").select("user_id", "delta", "tau", "count", "n_seen", "n_right_censored")


def _registry() -> dict:
    dist = distribution.empirical_distribution
    raw = raw_series
    found = {
        "flagship_distribution": (flagship, f"with {S}, {D}, {W}, kk as (select delta, tau, 1 as class from w where tau>0), {DIST_TAIL}"),
        "quantize": (grid_series, f"select event_id t, {Q} q from events"),
        "on_grid": (lambda s, d: events(s, d).select("event_id", on_grid(F.col("value"), 1).alias("fits")), "select event_id, abs(value*10-round_even(value*10,0))<=1e-6 as fits from events"),
        "suffix_maximum": (lambda s, d: passage.suffix_maximum(grid_series(s, d)), f"with {S} select t, q, max(q) over (order by t rows between current row and unbounded following) suffix_max from s"),
    }
    for name in ("guarded", "block", "segment_tree", "sweep", "streaming", "tiles", "theta"):
        found[f"first_passage_{name}"] = (_waits(name), WAITS_SQL)
    for name in ("auto", "tiles", "block"):
        found[f"first_passage_keyed_{name}"] = (_user_waits(name), f"with {KS}, {D}, {KW} select user_id, delta, d, n, t, q, tau from w")
    found |= {
        "first_passage_zero": (lambda s, d: passage.first_passage(grid_series(s, d), "0", DIGITS), f"with {S}, d(d,delta) as (values (0,'0.00')), {W} select delta, d, n, t, q, tau from w"),
        "scan_work": (lambda s, d: passage.scan_work(passage.first_passage(grid_series(s, d), DELTAS, DIGITS)), f"with {S}, {D}, {W} select w.delta, cast(sum(case when w.tau>0 then b.n-w.n else (select max(n) from s)-w.n end) as bigint) as work from w left join s b on b.t=w.t+w.tau and w.tau>0 group by w.delta"),
        "detect_gaps": (lambda s, d: gaps.detect_gaps(observed_series(s, d)).select("start", "stop", "kind"), f"with {OBS}, {GAP} select start, stop, 'detected' as kind from g"),
        "gap_table": (lambda s, d: gaps.gap_table(gaps.detect_gaps(observed_series(s, d))).select("start", "stop", "length"), f"with {OBS}, {GAP} select start, stop, stop-start as length from g"),
        "declare_gaps": (_gaps_declared, f"""with {OBS}, {GAP}, c as (select *, start%3=0 as h, stop-start>=3 as e from g)
 select start, case when h and e then stop-1 else stop end as stop, case when h then 'hole' when e then 'session' else 'detected' end as kind, case when h then 'a' when e then 'b' else '' end as source from c
 union all select stop-1, stop, 'session', 'b' from c where h and e"""),
        "classify": (lambda s, d: _classified(s, d).select("delta", "n", "t", "tau", "class", "lower", "upper"), f"with {CLS} select delta, n, t, tau, class, lower, upper from c"),
        "class_totals": (lambda s, d: gaps.class_totals(_classified(s, d)), f"with {CLS} select delta, count(*) n_candidates, count(*) filter (class=1) n_exact, count(*) filter (class=2) n_gap_crossing, count(*) filter (class=3) n_right_censored from k group by delta"),
        "distribution_elapsed": (lambda s, d: dist(_classified(s, d)), f"with {CLS}, kk as (select * from k where class<=2), {DIST_TAIL}"),
        "distribution_exact": (lambda s, d: dist(_classified(s, d), mode="exact"), f"with {CLS}, kk as (select * from k where class=1), {DIST_TAIL}"),
        "distribution_horizon": (lambda s, d: dist(_classified(s, d), horizon=40), f"with {CLS}, kk as (select * from k where class<=2 and tau<=40), {DIST_TAIL}"),
        "accounting_horizon": (lambda s, d: distribution.accounting(_classified(s, d), horizon=40), f"with {CLS}, kk as (select delta, case when tau>40 then 3 else class end as class from k) select delta, count(*) n_candidates, count(*) filter (class=1) n_exact, count(*) filter (class=2) n_gap_crossing, count(*) filter (class=3) n_right_censored from kk group by delta"),
        "censoring": (lambda s, d: distribution.censoring_counts(_classified(s, d)), f"with {CLS} select delta, lower, count(*) as count from k where class=3 group by delta, lower"),
        "index_entry": (lambda s, d: distribution.index_entry(flagship(s, d)), f"with {S}, {D}, {W} select delta, count(*) n_waiting, min(tau) tau_min, max(tau) tau_max, cast(sum(tau) as double)/count(*) tau_mean, cast(quantile_disc(tau,0.5) as bigint) tau_median from w where tau>0 group by delta"),
        "mean_waiting_time": (lambda s, d: distribution.mean_waiting_time(flagship(s, d)), f"with {S}, {D}, {W} select delta, cast(sum(tau) as double)/count(*) mean from w where tau>0 group by delta"),
        "quantile": (lambda s, d: distribution.quantile(flagship(s, d), 0.9), f"with {S}, {D}, {W} select delta, cast(quantile_disc(tau,0.9) as bigint) quantile from w where tau>0 group by delta"),
        "cdf_at": (lambda s, d: distribution.cdf_at(flagship(s, d), 7), f"with {S}, {D}, {W} select delta, cast(count(*) filter (tau<=7) as double)/count(*) cdf from w where tau>0 group by delta"),
        "ks_distance": (lambda s, d: distribution.ks_distance(flagship(s, d), dist(_classified(s, d))), f"""with {CLS.replace(' s as (', ' o as (', 0)}, e as (select event_id t, {Q} q from events),
 v as (select d.delta, a.t, min(b.t)-a.t tau from d cross join e a join e b on b.t>a.t and b.q>=a.q+d.d group by d.delta, a.t),
 x as (select delta, tau, count(*) c from v group by all), y as (select delta, tau, count(*) c from k where class<=2 group by all),
 p as (select delta, tau from x union select delta, tau from y),
 f as (select p.delta, p.tau, coalesce((select sum(c) from x where x.delta=p.delta and x.tau<=p.tau),0)/cast((select sum(c) from x where x.delta=p.delta) as double) a, coalesce((select sum(c) from y where y.delta=p.delta and y.tau<=p.tau),0)/cast((select sum(c) from y where y.delta=p.delta) as double) b from p)
 select delta, max(abs(a-b)) ks from f group by delta"""),
        "segments": (_segments, f"with {OBS}, m as (select t, case when t-lag(t) over (order by t)>1 then 1 else 0 end b from s), i as (select t, sum(b) over (order by t) g from m), z as (select g, min(t) a, max(t) e, count(*) c from i group by g) select row_number() over (order by a) segment, a as start, e as \"end\", c as length, case when a=(select min(t) from s) then '' else 'detected' end kind_before, case when e=(select max(t) from s) then '' else 'detected' end kind_after from z"),
        "erosion_weight": (lambda s, d: gaps.erosion_weight(_segments(s, d), 3), f"with {OBS}, m as (select t, case when t-lag(t) over (order by t)>1 then 1 else 0 end b from s), i as (select t, sum(b) over (order by t) g from m), z as (select g, count(*) c from i group by g) select cast(sum(greatest(c-3,0)) as bigint) weight from z"),
        "sampling_step": (lambda s, d: gaps.sampling_step(observed_series(s, d)), f"with {OBS}, z as (select distinct t-lag(t) over (order by t) d from s) select cast(list_reduce(list(d), lambda a, b: gcd(a, b)) as bigint) step from z where d is not null"),
        "record_length": (lambda s, d: gaps.record_length(observed_series(s, d)), f"with {OBS}, z as (select distinct t-lag(t) over (order by t) d from s) select cast((max(t)-min(t))//(select list_reduce(list(d), lambda a, b: gcd(a, b)) from z where d is not null)+1 as bigint) record_length from s"),
        "observed_mask": (lambda s, d: gaps.observed_mask(observed_series(s, d)), f"with {OBS}, a as (select min(t) a, max(t) b from s), x as (select unnest(range(a, b+1)) t, a from a) select x.t-x.a as slot, s.t is not null as observed from x left join s using (t)"),
        "describe": (_describe, f"""with {OBS}, {GAP}, m as (select case when t-lag(t) over (order by t)>1 then 1 else 0 end b from s), p as (select cast(max(t)-min(t) as double) span from s)
 select count(*) n, cast(max(t)-min(t)+1 as bigint) record_length, min(t) first_time, max(t) last_time, min(q/100.0) as "min", max(q/100.0) as "max", round(avg(q/100.0),9) as "mean", quantile_cont(q/100.0,0.5) as "median", cast(2 as integer) digits, cast(1 as bigint) sampling_step,
 (select cast(sum(b)+1 as bigint) from m) n_segments, (select count(*) from g) n_gaps, (select round(cast(sum(stop-start) as double)/any_value(span),12) from g, p) gap_share, (select count(*) from g) detected_count, (select round(cast(sum(stop-start) as double)/any_value(span),12) from g, p) detected_share from s"""),
        "index_axis": (_index_axis, f"with {RAW}, f as (select min(\"row\") f from r where x is not null) select \"row\"-f+1 as t, t as time_original, \"row\", x from r, f where x is not null"),
        "select_range": (lambda s, d: prepare.select_range(raw(s, d), 100, 900), f"with {RAW} select * from r where t between 100 and 900"),
        "exclude_spliced": (lambda s, d: prepare.exclude_intervals(raw(s, d), [(50, 60), (200, 250)]), f"with {RAW} select \"row\", t-case when t>=60 then 10 else 0 end-case when t>=250 then 50 else 0 end as t, x from r where not (t>=50 and t<60) and not (t>=200 and t<250)"),
        "exclude_kept": (lambda s, d: prepare.exclude_intervals(raw(s, d), [(50, 60), (200, 250)], splice=False), f"with {RAW} select \"row\", t, case when (t>=50 and t<60) or (t>=200 and t<250) then null else x end as x from r"),
        "round_values": (lambda s, d: prepare.round_values(raw(s, d), 1), f"with {RAW} select \"row\", t, round_even(x*10,0)/10 as x from r"),
        "differences": (lambda s, d: prepare.differences(raw(s, d)), f"with {RAW} select \"row\", t, x-lag(x) over (order by \"row\") as x from r where x is not null union all select * from r where x is null"),
        "log_returns": (lambda s, d: _rounded(prepare.log_returns(raw(s, d).withColumn("x", F.col("x") + 1.0))), f"with {RAW} select \"row\", t, round(100*ln((x+1.0)/lag(x+1.0) over (order by \"row\")),9) as x from r where x is not null union all select * from r where x is null"),
        "log_levels": (lambda s, d: _rounded(prepare.log_levels(raw(s, d).withColumn("x", F.col("x") + 1.0))), f"with {RAW} select \"row\", t, round(100*ln((x+1.0)/first_value(x+1.0) over (order by \"row\")),9) as x from r where x is not null union all select * from r where x is null"),
        "trailing_mean": (lambda s, d: _rounded(prepare.trailing_mean_fluctuations(raw(s, d), 24, "none")), f"with {RAW} select \"row\", t, round(coalesce(x-avg(x) over (order by \"row\" rows between 24 preceding and 1 preceding),0),9) as x from r where x is not null union all select * from r where x is null"),
        "trailing_mean_percent": (lambda s, d: _rounded(prepare.trailing_mean_fluctuations(raw(s, d), 24, offset="auto")), f"with {RAW}, h as (select greatest(0.0,1.0-min(x)) h from r), y as (select \"row\", t, x+h as v, avg(x+h) over (order by \"row\" rows between 24 preceding and 1 preceding) m from r, h where x is not null) select \"row\", t, round(coalesce((v-m)*100.0/m,0),9) as x from y union all select * from r where x is null"),
        "trailing_mean_scaled": (lambda s, d: _rounded(prepare.trailing_mean_fluctuations(raw(s, d), 24, "scale")), f"with {RAW}, y as (select \"row\", t, x-avg(x) over (order by \"row\" rows between 24 preceding and 1 preceding) v from r where x is not null) select \"row\", t, round(coalesce(v/(select stddev_samp(v) from y),0),9) as x from y union all select * from r where x is null"),
        "detrend": (lambda s, d: _rounded(prepare.detrend_moving_average(raw(s, d), 25)), f"with {RAW} select \"row\", t, round(x-avg(x) over (order by \"row\" rows between 12 preceding and 12 following),9) as x from r where x is not null union all select * from r where x is null"),
        "differences_keyed": (lambda s, d: prepare.differences(_user_raw(s, d), ["user_id"]), "with r as (select user_id, event_id+1 as \"row\", event_id t, case when event_type<>'error' then value end x from events) select user_id, \"row\", t, x-lag(x) over (partition by user_id order by \"row\") as x from r where x is not null union all select * from r where x is null"),
        "clip_quantile": (lambda s, d: prepare.clip_quantile(raw(s, d), 0.95), f"with {RAW}, q as (select quantile_cont(abs(x),0.95) q from r) select \"row\", t, case when abs(x)>q then null else x end as x from r, q"),
        "clip_quantile_spliced": (lambda s, d: prepare.clip_quantile(raw(s, d), 0.95, splice=True), f"with {RAW}, q as (select quantile_cont(abs(x),0.95) q from r), m as (select r.*, coalesce(abs(x)>q,false) z, t-lag(t) over (order by \"row\") g from r, q), c as (select *, sum(case when z then coalesce(g,0) else 0 end) over (order by \"row\") k from m) select \"row\", cast(t-k as bigint) as t, x from c where not z"),
        "clip_sigma": (lambda s, d: prepare.clip_sigma(raw(s, d), 2.0), f"with {RAW}, m as (select avg(x) c, stddev_samp(x) s from r) select \"row\", t, case when abs(x-c)>2.0*s then null else x end as x from r, m"),
        "clip_sigma_median": (lambda s, d: prepare.clip_sigma(raw(s, d), 3.0, "median", "mad"), f"with {RAW}, a as (select quantile_cont(x,0.5) c from r), m as (select c, 1.4826*quantile_cont(abs(x-c),0.5) s from r, a group by c) select \"row\", t, case when abs(x-c)>3.0*s then null else x end as x from r, m"),
        "clip_extremes": (lambda s, d: prepare.clip_extremes(raw(s, d), 0.3, 1), f"""with recursive {RAW}, h as (select abs(x) m, count(*) c from r where x is not null group by 1), z as (select count(*) n from r),
 p(cut, pass) as (select floor(max(m)), 1 from h union all
  select floor((select max(m) from h where m<p.cut)*10)/10, pass+1 from p, z where (z.n-(select sum(c) from h where m>=p.cut))/z.n > 0.7)
 select "row", t, case when abs(x)>=(select min(cut) from p) then null else x end as x from r"""),
        "collapse_first": (lambda s, d: prepare.collapse_ties(_tied(s, d), "first"), _TIES.format("min_by(x, \"row\") filter (x is not null)")),
        "collapse_last": (lambda s, d: prepare.collapse_ties(_tied(s, d), "last"), _TIES.format("max_by(x, \"row\") filter (x is not null)")),
        "collapse_mean": (lambda s, d: _rounded(prepare.collapse_ties(_tied(s, d), "mean")), _TIES.format("round(avg(x),9)")),
        "sampling_summary": (lambda s, d: diagnostics.sampling_summary(observed_series(s, d)), f"with {OBS}, z as (select t-lag(t) over (order by t) d from s), m as (select quantile_cont(d,0.5) m from z) select (select count(*) from s) n, min(d) spacing_min, max(m) spacing_median, max(d) spacing_max, count(*) filter (d>2.0*m) n_wide from z, m"),
        "value_summary": (lambda s, d: diagnostics.value_summary(raw(s, d)).withColumn("x_mean", F.round("x_mean", 9)), f"with {RAW} select count(*) n_rows, count(x) n_observed, min(x) x_min, quantile_cont(x,0.25) q25, quantile_cont(x,0.5) q50, quantile_cont(x,0.75) q75, max(x) x_max, round(avg(x),9) x_mean from r"),
        "resolution_digits": (lambda s, d: diagnostics.resolution_digits(raw(s, d)), f"with {RAW} select cast(case when bool_and(abs(x-round_even(x,0))<=1e-6) then 0 when bool_and(abs(x*10-round_even(x*10,0))<=1e-6) then 1 when bool_and(abs(x*100-round_even(x*100,0))<=1e-6) then 2 end as integer) digits from r where x is not null"),
        "increment_scale": (lambda s, d: diagnostics.increment_scale(raw(s, d)).withColumn("scale", F.round("scale", 9)), f"with {RAW}, z as (select abs(x-lag(x) over (order by t)) d from r where x is not null) select round(case when quantile_cont(d,0.5)>0 then quantile_cont(d,0.5) else quantile_cont(d,0.5) filter (d>0) end,9) as scale from z"),
        "digits_sensitivity": (lambda s, d: diagnostics.digits_sensitivity(raw(s, d), [1], [5.0, 0.25]).withColumns({"ks": F.round("ks", 9), "step_ratio": F.round("step_ratio", 9)}), f"""with {RAW}, o as (select t, cast(round_even(round_even(x*10,0)/10*10,0) as bigint) q, cast(round_even(round_even(x*100,0)/100*100,0) as bigint) p, abs(x-lag(x) over (order by t)) d from r where x is not null),
 a as (select min(b.t)-a.t tau from o a join o b on b.t>a.t and b.q>=a.q+50 group by a.t), b as (select min(b.t)-a.t tau from o a join o b on b.t>a.t and b.p>=a.p+500 group by a.t),
 u as (select tau from a union select tau from b),
 f as (select (select count(*) from a where a.tau<=u.tau)/(select cast(count(*) as double) from a) x, (select count(*) from b where b.tau<=u.tau)/(select cast(count(*) as double) from b) y from u),
 v as (select count(distinct q) n_distinct, round(0.1/case when quantile_cont(d,0.5)>0 then quantile_cont(d,0.5) else quantile_cont(d,0.5) filter (d>0) end,9) step_ratio from o)
 select cast(1 as integer) digits, cast(5.0 as double) delta, n_distinct, step_ratio, (select round(max(abs(x-y)),9) from f) ks from v
 union all select 1, 0.25, n_distinct, step_ratio, null from v"""),
        "threshold_grids": (_thresholds, """with l as (select 'linear' as kind, cast(i*25 as bigint) d from range(0, 21) x(i) union all
 select distinct 'log', cast(least(100000, round(pow(10, 1+k/5.0))) as bigint) from range(0, 21) x(k))
 select kind, d, cast(d//100 as varchar) || '.' || lpad(cast(d%100 as varchar), 2, '0') as delta from l"""),
        "classify_keyed": (lambda s, d: _classified_keyed(s, d).select("user_id", "delta", "n", "t", "tau", "class", "lower", "upper"), f"with {KCLS} select user_id, delta, n, t, tau, class, lower, upper from c"),
        "class_totals_keyed": (lambda s, d: gaps.class_totals(_classified_keyed(s, d), ["user_id"]), f"with {KCLS} select user_id, delta, count(*) n_candidates, count(*) filter (class=1) n_exact, count(*) filter (class=2) n_gap_crossing, count(*) filter (class=3) n_right_censored from c where n<top group by user_id, delta"),
        "read_csv": (_read_csv, "select row_number() over (order by event_id) as \"row\", epoch_us(ts) as t, case when event_type<>'error' then value end as x from events"),
        "read_dat": (_read_dat, "select row_number() over (order by event_id) as \"row\", event_id as t, value as x from events"),
        "read_parquet": (lambda s, d: readers.read_series(s, f"{d}/events.parquet", value_column="value", time_column="event_id", time_unit="second", order_column="event_id"), "select row_number() over (order by event_id) as \"row\", event_id as t, value as x from events"),
        "collection_distributions": (lambda s, d: _collection(s, d).load_distributions(["5.00", "50.00"]), f"with {CLS}, kk as (select * from k where class<=2), {DIST_TAIL} where delta<>'200.00'"),
        "collection_summary": (lambda s, d: _collection(s, d).index().select("delta", "n_candidates", "n_exact", "n_gap_crossing", "n_right_censored", "tau_min", "tau_max", "tau_median"), f"with {CLS} select delta, count(*) n_candidates, count(*) filter (class=1) n_exact, count(*) filter (class=2) n_gap_crossing, count(*) filter (class=3) n_right_censored, min(tau) filter (class<=2) tau_min, max(tau) filter (class<=2) tau_max, cast(quantile_disc(tau,0.5) filter (class<=2) as bigint) tau_median from k group by delta"),
        "collection_series": (lambda s, d: _collection(s, d).load_series(), f"with {OBS} select t, q from s"),
        "online_snapshots": (_online, f"with {KS}, {D}, {KW}, v as (select user_id, delta, count(*) n_seen, count(*)-1-count(*) filter (tau>0) n_right_censored from w group by user_id, delta) select w.user_id, w.delta, w.tau, count(*) as count, any_value(n_seen) n_seen, any_value(n_right_censored) n_right_censored from w join v using (user_id, delta) where tau>0 group by w.user_id, w.delta, w.tau"),
        "plot_histogram": (lambda s, d: diagnostics.plot_tables(grid_series(s, d))[1], f"with {S}, e as (select min(q) a, max(q) b from s) select a + ((q-a) // greatest(1,(b-a)//200+1)) * greatest(1,(b-a)//200+1) as bin, count(*) as count from s, e group by 1"),
    }
    return found


_TIES = "with e as (select event_id+1 as \"row\", cast(epoch(date_trunc('minute', ts)) as bigint) t, case when event_type<>'error' then value end x from events) select min(\"row\") as \"row\", t, {} as x from e group by t"


def queries() -> dict:
    return {name: query for name, (query, _) in _registry().items()}


def oracles() -> dict:
    return {name: sql for name, (_, sql) in _registry().items() if sql}
