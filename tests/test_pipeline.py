import datetime
import random

import pyarrow as pa
import pytest

from passagelab.operators import passage
from passagelab.plans import config, pipeline, storage
from passagelab.sources import readers, synthetic

CONFIG = """
[input]
path = "walk.csv"
value_column = "value"
[quantization]
digits = 1
[thresholds]
mode = "linear"
min = 0.5
max = {max}
step = 0.5
[output]
root = "out"
"""


@pytest.fixture
def folder(tmp_path):
    rng, x, lines = random.Random(2), 0.0, ["value"]
    for i in range(300):
        x += rng.gauss(0, 1)
        lines.append("" if i % 37 == 5 else f"{x:.3f}")
    (tmp_path / "walk.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "a.toml").write_text(CONFIG.format(max=1.5))
    (tmp_path / "b.toml").write_text(CONFIG.format(max=2.5))
    return tmp_path


def test_runs_resumes_and_widens(spark, folder):
    first = pipeline.run_pipeline(spark, str(folder / "a.toml"))
    assert first.computed == ["0.5", "1.0", "1.5"] and all(c["different"] == 0 for c in first.checks) and first.checks
    again = pipeline.run_pipeline(spark, str(folder / "a.toml"))
    assert again.computed == [] and len(again.skipped) == 3
    wider = pipeline.run_pipeline(spark, str(folder / "b.toml"))
    assert wider.id == first.id and wider.computed == ["2.0", "2.5"]
    c = storage.Collection(spark, first.path)
    assert c.deltas() == ["0.5", "1.0", "1.5", "2.0", "2.5"]
    d = c.distribution("0.5")
    assert abs(sum(r["pmf"] for r in d.collect()) - 1) < 1e-12
    assert c.load_distributions(["0.5", "1.0"]).select("delta").distinct().count() == 2
    paths = c.export_legacy(str(folder / "legacy"))
    assert [p.rsplit("/", 1)[1] for p in paths] == [f"WTS_walk_deltais{x}.dat" for x in c.deltas()]
    assert (folder / "legacy" / "WTS_walk_deltais0.5.dat").read_bytes().startswith(b"time pdf cdf\r\n1 ")
    assert c.find(0.5) == c.find("0.50") == "0.5" and c.distribution(1.0).count() > 0
    assert [s["status"] for s in c.sessions()] == ["completed"] * 3 and len({s["id"] for s in c.sessions()}) == 3
    assert (folder / "out" / first.id / "summary.csv").read_text().count("\n") == 6
    assert "Thresholds: 5 from 0.5 to 2.5" in (folder / "out" / first.id / "README.md").read_text()
    assert c.metadata()["record_length"] == c.record_length() >= c.metadata()["n_observed"]
    assert any("thresholds" in line for line in pipeline.lineage(spark, first.path))
    assert sum(r[0] for r in c.segment_lengths().collect()) == c.load_series().count()
    assert storage.list_collections(spark, str(folder / "out"))[0]["n_thresholds"] == 5
    with pytest.raises(ValueError, match="no threshold"):
        c.distribution("9.9")


def test_identity_is_the_content(spark, folder):
    first = pipeline.run_pipeline(spark, str(folder / "a.toml"))
    (folder / "copy.csv").write_text((folder / "walk.csv").read_text())
    (folder / "c.toml").write_text((folder / "a.toml").read_text().replace("walk.csv", "copy.csv"))
    assert pipeline.prepare_series(spark, config.load_settings(str(folder / "c.toml"))).identity == pipeline.prepare_series(spark, config.load_settings(str(folder / "a.toml"))).identity
    lines = (folder / "walk.csv").read_text().split("\n")
    lines[10] = "77.125"
    (folder / "walk.csv").write_text("\n".join(lines))
    changed = pipeline.run_pipeline(spark, str(folder / "a.toml"))
    assert changed.id != first.id and len(changed.computed) == 3


def test_overwrite_keeps_a_backup_and_csv_is_csv(spark, folder):
    text = (folder / "a.toml").read_text()
    (folder / "o.toml").write_text(text + 'format = "csv"\noverwrite = true\nstore_waiting_times = true\n')
    first = pipeline.run_pipeline(spark, str(folder / "o.toml"))
    base = folder / "out" / first.id
    assert list(base.glob("distributions/delta=0.5/*.csv")) and not list(base.glob("distributions/**/*.parquet"))
    again = pipeline.run_pipeline(spark, str(folder / "o.toml"))
    assert len(again.computed) == 3 and (base / "backup" / "distributions" / "delta=0.5#1").is_dir()
    c = storage.Collection(spark, first.path)
    plain = pipeline.run_pipeline(spark, str(folder / "a.toml"))
    assert plain.id == first.id and plain.computed == []
    from passagelab.operators import distribution

    waits = c.waiting_times("0.5")
    assert distribution.equal_distributions(c.distribution("0.5"), distribution.empirical_distribution(waits).select(*c.distribution("0.5").columns))


def test_descriptors(spark, folder):
    from passagelab.plans import provenance

    (folder / "datasets").mkdir()
    (folder / "datasets" / "d.toml").write_text(f'slug = "named"\nsha256 = "{provenance.file_sha256(str(folder / "walk.csv"))}"\n')
    (folder / "source.toml").write_text('schema = "run/1"\nrun_id = "r7"\n[producer]\nname = "maker"\nversion = "1.2"\ngit_tree_sha1 = "abc"\n')
    text = (folder / "a.toml").read_text().replace('value_column = "value"', 'value_column = "value"\ndataset = "d"\nsource_descriptor = "source.toml"')
    (folder / "d.toml").write_text(text)
    run = pipeline.run_pipeline(spark, str(folder / "d.toml"))
    c = storage.Collection(spark, run.path)
    assert run.id.startswith("named-") and c.source_descriptor()["run_id"] == "r7"
    assert c.source_summary() == {"schema": "run/1", "producer": "maker", "producer_version": "1.2", "run_id": "r7", "git_tree_sha1": "abc", "git_dirty": None, "config_hash": None, "seed": None, "created": None, "identity": True}
    assert any("maker 1.2, run r7" in line for line in pipeline.lineage(spark, run.path))
    (folder / "datasets" / "d.toml").write_text('sha256 = "0"\n')
    with pytest.raises(ValueError, match="checksum"):
        pipeline.run_pipeline(spark, str(folder / "d.toml"))


def test_tree_hash_is_gits(tmp_path):
    import subprocess

    from passagelab.plans import provenance

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x\n")
    (tmp_path / "a.txt").write_text("hello\n")
    (tmp_path / "empty").mkdir()
    subprocess.run("git init -q . && git add -A && git write-tree > .tree", shell=True, cwd=tmp_path, check=True)
    assert provenance.tree_hash(tmp_path) == (tmp_path / ".tree").read_text().strip()


def test_work_bound(spark, folder):
    text = (folder / "b.toml").read_text()
    (folder / "w.toml").write_text(text + "[limits]\nmax_reference_work = 2000\n")
    settings = config.load_settings(str(folder / "w.toml"))
    p = pipeline.prepare_series(spark, settings)
    found = config.threshold_list(settings["thresholds"], p.digits)
    work = [pipeline.check_work(p.series, x, p.digits, settings, "segment_tree") for x in found]
    assert work == sorted(work)
    within = [x for x, w in zip(found, work) if w <= 2000]
    checks = pipeline.early_check(p.series, found, p.digits, settings, "segment_tree")
    assert [c["delta"] for c in checks] == [str(x) for x in within[-1:]]
    late = pipeline.late_checks(p.series, found, p.digits, settings, "segment_tree", checks)
    assert all(c["skipped"] == (c.get("work", 0) > 2000) for c in late)
    equal, rows = pipeline.crosscheck(spark, config.load_settings(str(folder / "b.toml")), 2, ("segment_tree", "sweep"))
    assert equal and len(rows) == 6


def test_wrong_strategy_is_caught_before_writing(spark, folder):
    def wrong(df, found, keys=()):
        return passage._strategies["segment_tree"](df, found, keys).withColumn("tau", passage.F.col("tau") + 1)

    passage.register_strategy("wrong", wrong)
    try:
        text = (folder / "a.toml").read_text() + '[algorithm]\nsearch = "wrong"\n'
        (folder / "w.toml").write_text(text)
        with pytest.raises(RuntimeError, match="differs"):
            pipeline.run_pipeline(spark, str(folder / "w.toml"))
    finally:
        passage._strategies.pop("wrong")
    ok, rows = pipeline.validate_strategies(spark, config.load_settings(str(folder / "a.toml")), ["1.0"], ["segment_tree", "block"])
    assert ok and len(rows) == 2


@pytest.mark.parametrize("change", [{"input": {"path": ""}}, {"gaps": {"cadence": 0}}, {"quantization": {"digits": 16}}, {"thresholds": {"mode": "cubic"}}, {"input": {"path": "x", "time_column": "t"}}, {"preprocessing": {"steps": [{"op": "x"}]}}, {"thresholds": {"mode": "linear", "min": 0.55, "max": 1.0, "step": 0.5}}])
def test_bad_configs(change):
    good = {"input": {"path": "x"}, "quantization": {"digits": 1}, "thresholds": {"mode": "linear", "min": 0.5, "max": 1.0, "step": 0.5}}
    config.validate(good)
    with pytest.raises(ValueError):
        config.validate(config.merge_config(good, change))


def test_overlay_and_warnings(tmp_path):
    (tmp_path / "base.toml").write_text(CONFIG.format(max=1.5))
    (tmp_path / "over.toml").write_text('base_config = "base.toml"\n[thresholds]\nmax = 1.0\n')
    assert config.load_settings(str(tmp_path / "over.toml"))["thresholds"]["max"] == 1.0
    with pytest.warns(UserWarning, match="unknown key"):
        config.validate({"input": {"path": "x", "bogus": 1}, "thresholds": {"mode": "explicit", "values": [1.0]}})


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stamp,value,label\n2020-01-01T00:00:00,1.5,a\n2020-01-01T00:01:00,,b\n2020-01-01T00:02:00,NaN,c\n")
    rows = readers.read_series(spark, str(tmp_path / "a.csv"), value_column="value", time_column="stamp", time_unit="minute").orderBy("row").collect()
    assert [r["x"] for r in rows] == [1.5, None, None] and [r["t"] for r in rows] == [26297280, 26297281, 26297282]
    (tmp_path / "b.csv").write_text("stamp,value\n2020-01-01T00:00:00.000001,1\n")
    assert readers.read_series(spark, str(tmp_path / "b.csv"), value_column=2, time_column=1, time_unit="microsecond").first()["t"] == 1577836800000001
    (tmp_path / "c.dat").write_text("t   v\n1600000000   1\n1600000020.0  2\n")
    df = readers.read_series(spark, str(tmp_path / "c.dat"), value_column="v", time_column="t", time_unit="second")
    assert [r["t"] for r in df.orderBy("row").collect()] == [1600000000, 1600000020]
    with pytest.raises(Exception, match="whole number"):
        readers.read_series(spark, str(tmp_path / "c.dat"), value_column="v", time_column="t", time_unit="hour").collect()
    (tmp_path / "d.csv").write_text("20200101,3\n20200103,4\n")
    df = readers.read_series(spark, str(tmp_path / "d.csv"), value_column=2, time_column=1, time_unit="day", time_format="yyyymmdd", header=False)
    assert [r["t"] for r in df.orderBy("row").collect()] == [18262, 18264]
    (tmp_path / "e.csv").write_text("symbol,time_ns,price,size\nA,5,10.5,1\nA,7,11.0,2\n")
    assert [r["x"] for r in readers.read_series(spark, str(tmp_path / "e.csv"), format="tick").orderBy("row").collect()] == [10.5, 11.0]
    table = pa.table({"v": [1.0, None, 3.0]})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert [r["x"] for r in readers.read_series(spark, str(tmp_path / "f.arrow"), value_column="v").orderBy("row").collect()] == [1.0, None, 3.0]
    (tmp_path / "g.csv").write_text("value\n\n1.5\n\n2\n\n")
    axis = readers.sample_axis(readers.read_series(spark, str(tmp_path / "g.csv"))).where("x IS NOT NULL")
    assert [r["t"] for r in axis.orderBy("t").collect()] == [1, 3]
    (tmp_path / "q.csv").write_text('name,value\n"x,y",1.5\n"say ""hi""",2.5\n')
    assert [r["x"] for r in readers.read_series(spark, str(tmp_path / "q.csv"), value_column="value").orderBy("row").collect()] == [1.5, 2.5]
    (tmp_path / "days").mkdir()
    (tmp_path / "days" / "1.csv").write_text("value\n1\n2\n")
    (tmp_path / "days" / "2.csv").write_text("value\n3\n")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = readers.read_series(spark, str(tmp_path / "days"), format="csv", value_column="value")
        assert [(r["row"], r["x"]) for r in df.orderBy("row").collect()] == [(1, 1), (2, 2), (3, 3)]
        df = readers.read_series(spark, str(tmp_path / "a.csv"), value_column="value", time_column="stamp", time_unit="minute")
        assert [r["t"] for r in df.orderBy("row").collect()] == [26297280, 26297281, 26297282]
        (tmp_path / "z.csv").write_text("stamp,value\n2020-01-01T02:00:00.25+02:00,1\n2020-01-01T00:00:00.25Z,2\n")
        df = readers.read_series(spark, str(tmp_path / "z.csv"), value_column="value", time_column="stamp", time_unit="millisecond")
        assert [r["t"] for r in df.orderBy("row").collect()] == [1577836800250, 1577836800250]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError, match="no column"):
        readers.read_series(spark, str(tmp_path / "g.csv"), value_column="zzz")
    with pytest.raises(ValueError):
        readers.infer_format("x.bin")


def test_declared_gap_file(tmp_path):
    (tmp_path / "g.toml").write_text('kind = "session"\nsource = "s"\nintervals = [[1, 4]]\n[[gaps]]\nstart = 6\nstop = 8\nkind = "hole"\n')
    assert readers.read_declared_gaps(str(tmp_path / "g.toml")) == [(1, 4, "session", "s"), (6, 8, "hole", "s")]


def test_synthetic(spark):
    w = synthetic.random_walk(spark, 200, seed=3, tail=1.5, jumps=0.01, periods=[(24, 2.0)])
    assert w.count() == 200 and w.orderBy("row").first() == synthetic.random_walk(spark, 200, seed=3, tail=1.5, jumps=0.01, periods=[(24, 2.0)]).orderBy("row").first()
    assert 0 < synthetic.insert_missing(w, 5, 4).where("x IS NULL").count() <= 20
    t = [r["t"] for r in synthetic.irregular_times(w).orderBy("row").collect()]
    assert all(a < b for a, b in zip(t, t[1:]))
    assert synthetic.iid_series(spark, 10, "exponential").where("x < 0").count() == 0


@pytest.mark.parametrize("name", ["read_csv", "read_dat"])
def test_text_is_written_in_ranges(spark, tmp_path, name):
    """The events are written as several files in their order, and read back in it; no task sorts them all."""
    from passagelab import catalog

    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=977 * i), "error" if i % 5 == 0 else "view", i / 8) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = catalog.queries()[name](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found.inputFiles()) > 1
    assert [(r["row"], r["x"]) for r in found.orderBy("row").collect()] == [(i + 1, None if name == "read_csv" and i % 5 == 0 else i / 8) for i in range(2000)]


def test_many_waits_of_a_threshold_are_dealt_over_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        c = storage.Collection(spark, f"file://{tmp_path}/c")
        waits = spark.range(20_000).selectExpr("id * 977 % 20011 as tau", "cast(id % 2 as string) as delta").repartition(8)
        stored = c.write_waits(waits, ["0", "1"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, waits.collect()))
    assert len(list((tmp_path / "c" / "waiting_times" / "delta=1").glob("*.parquet"))) > 1
