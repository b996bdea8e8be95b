"""The batch pipeline: from a configuration to a resumable collection."""

from __future__ import annotations

import logging
import random
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Threshold, quantize
from ..operators import diagnostics, distribution, gaps, passage, prepare
from ..sources import readers
from . import provenance
from .config import Settings, load_settings, threshold_decimals, threshold_list
from .storage import Collection, artefact_id, content_hash

log = logging.getLogger("passagelab")
#: Thresholds that are computed and written together at first; then as many as fit the checkpoint time.
BATCH = 16
MOST = 256
#: Bytes of a task for each row of a series searched whole.
ROW_BYTES = 160


@dataclass
class Prepared:
    series: DataFrame
    gaps: DataFrame
    digits: int
    record: prepare.Record
    identity: dict
    slug: str = "series"
    source: dict | None = None


@dataclass
class Run:
    id: str
    path: str
    computed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    seconds: float = 0.0


def prepare_series(spark: SparkSession, settings: Settings) -> Prepared:
    i, q, g = settings["input"], settings["quantization"], settings["gaps"]
    options = {k: i[k] for k in ("format", "value_column", "time_column", "time_unit", "time_format", "epoch_unit", "delimiter", "header", "missing_policy")}
    path = settings.path(i["path"])
    descriptor = provenance.dataset_descriptor(settings.base, i["dataset"])
    provenance.verify_checksum(descriptor, path)
    raw = readers.read_series(spark, path, **options)
    digest = provenance.series_digest(raw)
    if i["time_column"] == "":
        raw = readers.sample_axis(raw)
    else:
        raw = prepare.collapse_ties(raw, i["tie_policy"])
    steps = [s for s in settings["preprocessing"]["steps"] if s["op"] != "suggest_digits"]
    raw, record = prepare.apply_steps(raw, steps)
    digits = q["digits"]
    if digits == "auto":
        digits, rule = diagnostics.suggest_digits(raw, threshold_decimals(settings["thresholds"]), q["auto_max_digits"], q["auto_tolerance"], q["auto_step_ratio"])
        if rule == "max_digits":
            raise ValueError(f"no grid up to auto_max_digits = {q['auto_max_digits']} meets auto_tolerance; raise it or set digits")
        record = record.with_step("suggest_digits", digits=digits, rule=rule)
    if i["time_axis"] == "index":
        declared = _declared(spark, settings)
        series = gaps.index_axis(raw, declared).select("t", "row", quantize(F.col("x"), digits).alias("q"))
        own = gaps.index_gaps(raw, declared)
    else:
        series = raw.where("x IS NOT NULL").select("t", "row", quantize(F.col("x"), digits).alias("q"))
        own = _declared(spark, settings)
    found = gaps.detect_gaps(series, g["cadence"]) if g["detect"] == "cadence" else own.limit(0)
    if not own.isEmpty():
        found = gaps.declare_gaps(found, own)
    source = provenance.source_record(settings.path(i["source_descriptor"])) if i["source_descriptor"] else None
    # what the series is, not where it was read from
    read = {k: i[k] for k in ("value_column", "time_column", "time_unit", "time_axis", "time_format", "epoch_unit", "missing_policy", "tie_policy")}
    identity = {"input": digest, "read": read, "steps": steps, "digits": digits, "detect": g["detect"], "cadence": g["cadence"], "mode": g["mode"]}
    if g["declared"]:
        identity["declared"] = provenance.file_sha256(settings.path(g["declared"]))
    if source:
        identity["source"] = source["sha256"]
    slug = (descriptor or {}).get("slug") or i["dataset"] or i["path"].rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    return Prepared(series, found, digits, record, identity, slug, source)


def _declared(spark: SparkSession, settings: Settings) -> DataFrame:
    path = settings["gaps"]["declared"]
    rows = readers.read_declared_gaps(settings.path(path)) if path else []
    return spark.createDataFrame(rows, "start long, stop long, kind string, source string")


def reference_thresholds(found: list[Threshold], n: int, seed: int) -> list[Threshold]:
    """The largest and ``n - 1`` others at random."""
    if n < 1 or not found:
        return []
    rest = random.Random(seed).sample(found[:-1], min(n - 1, len(found) - 1))
    return sorted([found[-1], *rest])


def compare_strategies(series: DataFrame, deltas, digits: int, reference: str, others: list[str], keys=()) -> DataFrame:
    """``(strategy, delta, compared, different)`` for every strategy against the reference, index by index."""
    cols = [*keys, "delta", "n", "tau"]
    base = passage.first_passage(series, deltas, digits, keys, reference).select(*cols).withColumnRenamed("tau", "expected")
    out = None
    for name in others:
        own = passage.first_passage(series, deltas, digits, keys, name).select(*cols)
        both = base.join(own, [*keys, "delta", "n"], "full")
        row = both.groupBy("delta").agg(F.count("*").alias("compared"), F.count_if(~F.col("tau").eqNullSafe(F.col("expected"))).alias("different")).withColumn("strategy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def check_work(series: DataFrame, delta: Threshold, digits: int, settings: Settings, strategy: str) -> float:
    """Comparisons that the reference would make for a threshold, counted from a run of the strategy."""
    waits = passage.first_passage(series, [delta], digits, (), strategy, check=False)
    return float(passage.scan_work(waits, (), settings["algorithm"]["reference_kernel"] != "theta").first()["work"])


def _largest_within(found: list[Threshold], within, monotone: bool) -> Threshold | None:
    """The largest threshold whose work is within the bound: by bisection where work rises with them, else tried from the largest."""
    if not monotone:
        return next((x for x in reversed(found) if within(x)), None)
    low, high, chosen = 0, len(found) - 1, None
    while low <= high:
        mid = (low + high) // 2
        if within(found[mid]):
            chosen, low = found[mid], mid + 1
        else:
            high = mid - 1
    return chosen


def _compare(series, delta: Threshold, digits: int, settings: Settings, strategy: str, **more) -> dict:
    reference = settings["algorithm"]["reference_kernel"]
    row = compare_strategies(series, [delta], digits, reference, [strategy]).first()
    check = {"delta": str(delta), "kernel": reference, "compared": row["compared"], "different": row["different"], "skipped": False, **more}
    if row["different"]:
        raise RuntimeError(f"{strategy} differs from {reference} at {delta}: {check}")
    return check


def early_check(series, found: list[Threshold], digits: int, settings: Settings, strategy: str) -> list[dict]:
    """Compare the largest threshold that the work bound allows with the reference, before anything is written."""
    if settings["algorithm"]["reference_checks"] < 1 or not found:
        return []
    bound = settings["limits"]["max_reference_work"]
    chosen = _largest_within(sorted(found), lambda x: check_work(series, x, digits, settings, strategy) <= bound, settings["algorithm"]["reference_kernel"] == "theta")
    if chosen is None:
        log.warning("no threshold is within max_reference_work: nothing is checked before it is written")
        return []
    return [_compare(series, chosen, digits, settings, strategy, early=True)]


def late_checks(series, found: list[Threshold], digits: int, settings: Settings, strategy: str, done: list[dict]) -> list[dict]:
    """Compare the largest and some random thresholds of those just computed, but for one compared before."""
    bound, checks = settings["limits"]["max_reference_work"], []
    for x in reference_thresholds(sorted(found), settings["algorithm"]["reference_checks"], settings["run"]["seed"]):
        if any(c["delta"] == str(x) for c in done):
            continue
        work = check_work(series, x, digits, settings, strategy)
        if work > bound:
            log.warning("the check of %s is left out: its work exceeds max_reference_work", x)
            checks.append({"delta": str(x), "kernel": settings["algorithm"]["reference_kernel"], "work": work, "skipped": True})
        else:
            checks.append(_compare(series, x, digits, settings, strategy, work=work))
    return checks


def generate(spark: SparkSession, settings: Settings) -> Run:
    """Compute the thresholds that a collection lacks; an interrupted run goes on where it stopped."""
    begun = time.time()
    logging.getLogger("passagelab").setLevel({"warn": "WARNING"}.get(settings["run"]["log_level"], settings["run"]["log_level"].upper()))
    p = prepare_series(spark, settings)
    name = artefact_id(p.slug, p.identity)
    c = Collection(spark, f"{settings.path(settings['output']['root'])}/{name}", settings["output"]["format"])
    known = c.metadata()
    if known and known["identity"] != content_hash(p.identity):
        raise ValueError("the collection belongs to another series")
    found = threshold_list(settings["thresholds"], p.digits)
    done = set() if settings["output"]["overwrite"] else set(c.deltas())
    missing = [x for x in found if str(x) not in done]
    run = Run(name, c.path, skipped=[str(x) for x in found if str(x) in done])
    if not known:
        c.write_series(p.series, p.gaps, gaps.segment_table(p.series, p.gaps))
        own = gaps.describe(c.load_series(), c.load_gaps(), p.digits).first()
        unit, axis = settings["input"]["time_unit"], settings["input"]["time_axis"]
        shape = {"n_observed": own["n"], "gap_kinds": {k: v["count"] for k, v in own["gaps_by_kind"].items()}, **{k: own[k] for k in ("record_length", "sampling_step", "n_segments", "n_gaps")}}
        about = {"id": name, "slug": p.slug, "identity": content_hash(p.identity), "identity_of": p.identity, "digits": p.digits, "steps": list(p.record.steps), "mode": settings["gaps"]["mode"], "time_unit": "sample" if axis == "index" else unit, "time_unit_original": unit, "time_axis": axis}
        c.write_metadata(about | shape | ({"source": p.source} if p.source else {}))
    series, own = c.load_series(), c.load_gaps()
    strategy = settings["algorithm"]["search"]
    if strategy == "auto":
        strategy = passage.choose_strategy(series, (), int(settings["limits"]["max_ram_gb"] * 1e9 / ROW_BYTES))
    session = c.free_session(time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(begun)))
    record = {"id": session, "created": begun, "status": "running", "strategy": strategy, "config_hash": content_hash(settings.values), "code": provenance.code_identity(), "environment": provenance.environment(spark)}
    c.write_session(session, record, settings.values)
    run.checks = early_check(series, missing, p.digits, settings, strategy)
    at, size = 0, BATCH
    while at < len(missing):
        part, started = missing[at : at + size], time.time()
        waits = gaps.classify(passage.first_passage(series, part, p.digits, (), strategy), own, series=series)
        dist = distribution.empirical_distribution(waits, (), settings["gaps"]["mode"])
        index = distribution.accounting(waits).join(distribution.index_entry(dist), "delta", "left")
        seconds = F.lit(round((time.time() - started) / len(part), 6))
        index = index.withColumns({"mode": F.lit(settings["gaps"]["mode"]), "strategy": F.lit(strategy), "seconds": seconds, "session": F.lit(session)})
        names = [str(x) for x in part]
        if c.form == "csv":
            index = index.select(*INDEX_COLUMNS)
        c.write_partitions(dist, distribution.censoring_counts(waits), index, names, waits if settings["output"]["store_waiting_times"] else None)
        run.computed += names
        at += len(part)
        took = max(time.time() - started, 1e-3)
        size = max(1, min(MOST, int(len(part) * settings["run"]["checkpoint_seconds"] / took)))
        log.info("%d of %d thresholds", at, len(missing))
    run.checks += late_checks(series, missing, p.digits, settings, strategy, run.checks)
    run.seconds = time.time() - begun
    c.write_session(session, record | {"status": "completed", "computed": run.computed, "skipped": run.skipped, "checks": run.checks, "seconds": run.seconds})
    c.finish()
    return run


INDEX_COLUMNS = ("n_candidates", "n_exact", "n_gap_crossing", "n_right_censored", "n_waiting", "tau_min", "tau_max", "tau_mean", "tau_median", "mode", "strategy", "seconds", "session", "delta")


def validate_strategies(spark: SparkSession, settings: Settings, deltas=None, strategies=("segment_tree", "sweep", "streaming", "block", "tiles")) -> tuple[bool, list[dict]]:
    """Whether all strategies equal the reference on a configuration's series; at least one wait must be compared."""
    p = prepare_series(spark, settings)
    found = passage.thresholds_of(deltas, p.digits) if deltas else reference_thresholds(threshold_list(settings["thresholds"], p.digits), 2, settings["run"]["seed"])
    rows = [r.asDict() for r in compare_strategies(p.series, found, p.digits, settings["algorithm"]["reference_kernel"], list(strategies)).collect()]
    return bool(rows) and sum(r["compared"] for r in rows) > 0 and not any(r["different"] for r in rows), rows


def crosscheck(spark: SparkSession, settings: Settings, every: int = 10, strategies=("segment_tree", "sweep", "tiles")) -> tuple[bool, list[dict]]:
    """Compare strategies on every ``every``-th threshold of a configuration, as far as the work bound allows."""
    if every < 1:
        raise ValueError("every must be at least 1")
    p = prepare_series(spark, settings)
    found = threshold_list(settings["thresholds"], p.digits)[::every]
    bound = settings["limits"]["max_reference_work"]
    chosen = [x for x in found if check_work(p.series, x, p.digits, settings, strategies[0]) <= bound]
    if not chosen:
        return False, []
    rows = [r.asDict() for r in compare_strategies(p.series, chosen, p.digits, settings["algorithm"]["reference_kernel"], list(strategies)).collect()]
    return not any(r["different"] for r in rows), rows


def lineage(spark: SparkSession, path: str) -> list[str]:
    """From a collection back to its producer, a line each."""
    c = Collection(spark, path)
    m = c.metadata()
    if not m:
        raise ValueError(f"no collection in {path}")
    lines = [f"collection {m['id']}: {len(c.deltas())} thresholds, mode {m['mode']}", f"series {m['identity'][:12]}: {m['n_observed']} observations, {m['digits']} digits, steps {[s['op'] for s in m['steps']]}", f"input {m['identity_of']['input'][:12]}"]
    if m.get("source"):
        s = m["source"]["summary"]
        lines.append(f"source {s['producer']} {s['producer_version']}, run {s['run_id']}, code {s['git_tree_sha1'] or 'unknown'}")
    return lines + [f"session {s['id']}: {s['status']}, strategy {s['strategy']}, code {s['code']['tree'][:12]}, {len(s.get('computed', []))} computed" for s in c.sessions()]


def run_pipeline(spark: SparkSession, path: str) -> Run:
    return generate(spark, load_settings(path))
