"""Collections: the partitions of one prepared series, by threshold, with their provenance.

A collection is a folder that Spark can write. Distributions, censoring histograms
and, if asked for, waits are Parquet or CSV partitioned by ``delta``; the index has
one row for each finished threshold and is what makes one count. Beside them are
``metadata.json``, a record and a configuration for each session, ``summary.csv`` and
a README. What is written again is first moved to ``backup``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import threshold

SCHEMA_VERSION = 2
FORMATS = ("parquet", "csv")
#: Columns of the summary, one row for each threshold.
SUMMARY = ("delta", "mode", "n_candidates", "n_exact", "n_gap_crossing", "n_right_censored", "n_waiting", "tau_min", "tau_max", "tau_mean", "tau_median", "seconds", "strategy", "session")


def canonical(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)


def content_hash(x) -> str:
    return hashlib.sha256(canonical(x).encode()).hexdigest()


def artefact_id(label: str, identity: dict) -> str:
    slug = "".join(c if c.isalnum() else "-" for c in label.lower()).strip("-")
    return f"{slug}-{content_hash(identity)[:12]}"


#: Columns of the partitions in their order, for files that don't tell their types.
CSV_SCHEMAS = {
    "distributions": "tau long, count long, pmf double, cdf double, ccdf double, count_exact long, count_gap_crossing long, delta string",
    "censoring": "lower long, count long, delta string",
    "waiting_times": "d long, n long, t long, q long, tau long, class int, lower long, upper long, delta string",
    "index": "n_candidates long, n_exact long, n_gap_crossing long, n_right_censored long, n_waiting long, tau_min long, tau_max long, tau_mean double, tau_median long, mode string, strategy string, seconds double, session string, delta string",
}


class Folder:
    """Small files of a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        root = self._at("")
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, parts) -> None:
        """The file is written beside its place and moved there, so no reader sees a part of it."""
        stream = self.fs.create(self._at(f"{name}.tmp"), True)
        try:
            for text in [parts] if isinstance(parts, str) else parts:
                stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._at(name), False)
        if not self.fs.rename(self._at(f"{name}.tmp"), self._at(name)):
            raise OSError(f"can't write {self.path}/{name}")

    def move_aside(self, name: str) -> str | None:
        """Move a file or folder to the first free ``backup/<name>#<k>``."""
        if not self.exists(name):
            return None
        k = 1
        while self.exists(f"backup/{name}#{k}"):
            k += 1
        target = f"backup/{name}#{k}"
        self.fs.mkdirs(self._at(target).getParent())
        self.fs.rename(self._at(name), self._at(target))
        return target


class Collection:
    def __init__(self, spark: SparkSession, path: str, form: str = "parquet"):
        if form not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}")
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.form = self.metadata().get("format", form)

    def _exists(self, name: str) -> bool:
        return self.folder.exists(name)

    def write_metadata(self, metadata: dict) -> None:
        self.folder.write("metadata.json", json.dumps(metadata | {"schema_version": SCHEMA_VERSION, "format": self.form}, indent=1, sort_keys=True, default=str))

    def metadata(self) -> dict:
        if not self._exists("metadata.json"):
            return {}
        found = json.loads(self.folder.read("metadata.json"))
        if found.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"can't read schema version {found.get('schema_version')}")
        return found

    def free_session(self, stamp: str) -> str:
        """``stamp``, or with a number behind it if a session of this second has it."""
        taken, k, name = {n.split(".")[0] for n in self.folder.names("sessions")}, 1, stamp
        while name in taken:
            k += 1
            name = f"{stamp}-{k}"
        return name

    def write_session(self, name: str, record: dict, config: dict | None = None) -> None:
        self.folder.write(f"sessions/{name}.json", json.dumps(record, indent=1, sort_keys=True, default=str))
        if config is not None:
            self.folder.write(f"sessions/{name}.config.json", json.dumps(config, indent=1, sort_keys=True, default=str))

    def sessions(self) -> list[dict]:
        names = [n for n in self.folder.names("sessions") if n.endswith(".json") and not n.endswith(".config.json")]
        return [json.loads(self.folder.read(f"sessions/{n}")) for n in names]

    def summary(self) -> list[dict]:
        """One row for each threshold in their order; what the index lacks is None."""
        found = self.index()
        rows = [] if found is None else [r.asDict() for r in found.collect()]
        return sorted(({c: r.get(c) for c in SUMMARY} for r in rows), key=lambda r: float(r["delta"]))

    def finish(self) -> None:
        """Write what is derived from the index: ``summary.csv`` and the README."""
        rows, meta = self.summary(), self.metadata()
        lines = [",".join(SUMMARY), *(",".join("" if r[c] is None else repr(r[c]) if isinstance(r[c], float) else str(r[c]) for c in SUMMARY) for r in rows)]
        self.folder.write("summary.csv", "".join(f"{x}\n" for x in lines))
        deltas = [r["delta"] for r in rows]
        steps = " → ".join(x["op"] for x in meta.get("steps", [])) or "none"
        ends = f"{len(deltas)} from {deltas[0]} to {deltas[-1]}" if deltas else "none"
        text = f"""# {meta.get("id", "collection")}

Distributions of waits, one for each threshold.

- Series: {meta.get("n_observed")} observations, {meta.get("n_gaps")} gaps, {meta.get("digits")} decimals, time in {meta.get("time_unit")}s ({meta.get("time_axis")} axis).
- Preprocessing: {steps}.
- Thresholds: {ends}.
- Sessions: {len(self.sessions())}.

`distributions`, `censoring` and, if kept, `waiting_times` hold a folder `delta=…` for each
threshold ({self.form}); `series`, `gaps` and `segments` the prepared series; `summary.csv`
a row for each threshold; `metadata.json` and `sessions` where it all comes from.
"""
        self.folder.write("README.md", text)

    def _write(self, df: DataFrame, name: str, deltas: list[str]) -> None:
        """Replace the partitions of these thresholds only; what was there is moved aside."""
        for delta in deltas:
            self.folder.move_aside(f"{name}/delta={delta}")
        # a threshold's rows go to one task only if they are few
        out = df.where(F.col("delta").isin(deltas)).hint("rebalance", "delta").write.mode("append").partitionBy("delta")
        out.option("header", True).csv(f"{self.path}/{name}") if self.form == "csv" else out.parquet(f"{self.path}/{name}")

    def write_partitions(self, distribution: DataFrame, censoring: DataFrame, index: DataFrame, deltas: list[str], waits: DataFrame | None = None) -> None:
        """Write what belongs to some thresholds; the index last, so an interrupted write is done again."""
        # without its index row a threshold counts as not done
        for delta in deltas:
            self.folder.move_aside(f"index/delta={delta}")
        self._write(distribution, "distributions", deltas)
        self._write(censoring, "censoring", deltas)
        if waits is not None:
            self._write(waits, "waiting_times", deltas)
        self._write(index, "index", deltas)

    def write_waits(self, waits: DataFrame, deltas: list[str]) -> DataFrame:
        """Write the waits of some thresholds before what is counted from them, and give them as they are stored."""
        for delta in deltas:
            self.folder.move_aside(f"index/delta={delta}")
        self._write(waits, "waiting_times", deltas)
        return self._read("waiting_times").where(F.col("delta").isin(deltas)).select(*waits.columns)

    def _read(self, name: str) -> DataFrame | None:
        if not self._exists(name):
            return None
        # delta is a string such as 0.50; its type must not be guessed from the folder's name
        if self.form == "csv":
            return self.spark.read.schema(CSV_SCHEMAS[name]).option("header", True).csv(f"{self.path}/{name}")
        df = self.spark.read.parquet(f"{self.path}/{name}")
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "delta"]
        return self.spark.read.schema(", ".join([*kinds, "delta string"])).parquet(f"{self.path}/{name}")

    def index(self) -> DataFrame | None:
        return self._read("index")

    def deltas(self) -> list[str]:
        found = self.index()
        return [] if found is None else sorted((r[0] for r in found.select("delta").distinct().collect()), key=float)

    def load_distributions(self, deltas: list[str] | None = None) -> DataFrame:
        """All partitions, or some; the folders of others aren't read."""
        df = self._read("distributions")
        if df is None:
            raise ValueError(f"no distributions in {self.path}")
        return df if deltas is None else df.where(F.col("delta").isin(deltas))

    def find(self, delta) -> str:
        """The stored name of a threshold given as a :class:`Threshold`, a number or a decimal string."""
        found = self.deltas()
        if not found:
            raise ValueError(f"no thresholds in {self.path}")
        digits = len(found[0].partition(".")[2])
        name = str(threshold(delta, digits))
        if name not in found:
            raise ValueError(f"no threshold {name}; there are {found}")
        return name

    def distribution(self, delta) -> DataFrame:
        return self.load_distributions([self.find(delta)])

    def class_counts(self, delta: str) -> DataFrame:
        return self.distribution(delta).select("tau", "count_exact", "count_gap_crossing")

    def censoring_histogram(self, delta) -> DataFrame | None:
        found = self._read("censoring")
        return None if found is None else found.where(F.col("delta") == self.find(delta))

    def waiting_times(self, delta) -> DataFrame | None:
        found = self._read("waiting_times")
        return None if found is None else found.where(F.col("delta") == self.find(delta))

    def record_length(self) -> int:
        return self.metadata()["record_length"]

    def source_descriptor(self) -> dict | None:
        """The descriptor of the input's producer as it was given, or None."""
        return self.metadata().get("source", {}).get("descriptor")

    def source_summary(self) -> dict | None:
        return self.metadata().get("source", {}).get("summary")

    def write_series(self, series: DataFrame, gaps: DataFrame, segments: DataFrame) -> None:
        for name, df in (("series", series), ("gaps", gaps), ("segments", segments)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def load_series(self) -> DataFrame:
        return self._read_plain("series")

    def load_gaps(self) -> DataFrame:
        gaps = self._read_plain("gaps")
        for c in ("kind", "source"):
            if c not in gaps.columns:
                gaps = gaps.withColumn(c, F.lit("unknown" if c == "kind" else ""))
        return gaps

    def segment_lengths(self) -> DataFrame:
        return self._read_plain("segments").select("length")

    def _read_plain(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def export_legacy(self, out: str, slug: str = "") -> list[str]:
        """One file ``WTS_<slug>_deltais<threshold>.dat`` for each threshold with a wait; returns their paths.

        Lines ``time pdf cdf`` with CRLF, for programs that read such files; the
        shortest decimals that read back.
        """
        folder, paths = Folder(self.spark, out), []
        slug = slug or self.metadata().get("slug", "series")
        for delta in self.deltas():
            rows = self.distribution(delta).orderBy("tau").select("tau", "pmf", "cdf")
            if rows.isEmpty():
                continue
            name = f"WTS_{slug}_deltais{delta}.dat"
            folder.write(name, (f"{line}\r\n" for part in (["time pdf cdf"], (f"{t} {p!r} {c!r}" for t, p, c in rows.toLocalIterator())) for line in part))
            paths.append(f"{folder.path}/{name}")
        return paths


def list_collections(spark: SparkSession, root: str) -> list[dict]:
    """Identity and thresholds of every collection below a folder."""
    top, found = Folder(spark, root), []
    for name in top.names():
        if top.exists(f"{name}/metadata.json"):
            c = Collection(spark, f"{top.path}/{name}")
            found.append({"id": c.metadata().get("id"), "path": c.path, "n_thresholds": len(c.deltas())})
    return found
