import random
import time

import pytest
from pyspark.sql import functions as F

from passagelab.operators import distribution, gaps, passage

VALUES = [3, 4, 2, 5, 5, 3, 6, 4, 7, 5, 8, 6, 6, 9, 7, 8, 10, 9]
TIMES = [*range(1, 9), *range(11, 21)]


def frame(spark, values, times):
    return spark.createDataFrame(list(zip(times, values)), "t long, q long")


def test_contract_series(spark):
    s = frame(spark, VALUES, TIMES)
    found = gaps.detect_gaps(s)
    assert [tuple(r)[:3] for r in found.collect()] == [(9, 11, "detected")]
    c = gaps.classify(passage.first_passage(s, ["1", "3"], 0), found)
    rows = c.orderBy("d", "n").collect()
    letter = {1: "E", 2: "G", 3: "C"}
    assert "".join(letter[r["class"]] for r in rows if r["d"] == 1) == "EEEEEEGGEEEEEEEECC"
    assert "".join(letter[r["class"]] for r in rows if r["d"] == 3) == "EGEGGEGGEECEECECCC"
    totals = {r["delta"]: tuple(r)[1:] for r in gaps.class_totals(c).collect()}
    assert totals == {"1": (17, 14, 2, 1), "3": (17, 8, 5, 4)}
    d = distribution.empirical_distribution(c)
    assert [(r["tau"], r["count"], r["count_exact"], r["count_gap_crossing"]) for r in d.where("delta = '3'").orderBy("tau").collect()] == [(1, 4, 4, 0), (2, 2, 2, 0), (3, 1, 0, 1), (6, 1, 1, 0), (8, 2, 1, 1), (9, 3, 0, 3)]
    entry = {r["delta"]: r for r in distribution.index_entry(d).collect()}
    assert entry["3"]["tau_median"] == 3 and entry["1"]["tau_mean"] == 1.9375
    assert [(r["lower"], r["count"]) for r in distribution.censoring_counts(c).where("delta = '3'").orderBy("lower").collect()] == [(1, 1), (2, 1), (4, 1), (7, 1)]
    assert distribution.accounting(c, horizon=2).where("delta = '3'").first()["n_right_censored"] == 11
    assert sum(r["count"] for r in distribution.empirical_distribution(c, mode="exact").where("delta = '3'").collect()) == 8
    segments = gaps.segment_table(s, found).orderBy("segment").collect()
    assert [(r["start"], r["length"], r["kind_before"], r["kind_after"]) for r in segments] == [(1, 8, "", "detected"), (11, 10, "detected", "")]
    assert gaps.record_length(s).first()[0] == 20
    gaps.validate_gaps(s, found)
    with pytest.raises(ValueError, match="holds an observation"):
        gaps.validate_gaps(s, spark.createDataFrame([(4, 7, "hole", "")], "start long, stop long, kind string, source string"))


def test_classification_bounds(spark):
    s = frame(spark, [1, 5, 2, 9, 3], [1, 2, 3, 7, 8])
    c = gaps.classify(passage.first_passage(s, "3", 0), gaps.detect_gaps(s)).orderBy("n").collect()
    assert [r["tau"] for r in c] == [1, 5, 4, 0, 0] and [r["class"] for r in c] == [1, 2, 2, 3, 3]
    assert [r["lower"] for r in c] == [1, 1, 0, 1, 0] and [r["upper"] for r in c][:3] == [1, 5, 4]


def test_structure(spark):
    s = frame(spark, [1, 2, 3, 4, 5], [0, 250, 500, 1500, 1750])
    hole = spark.createDataFrame([(501, 1500, "hole", "")], "start long, stop long, kind string, source string")
    assert gaps.sampling_step(s).first()[0] == 250
    assert gaps.record_length(s).first()[0] == 8
    assert [r["observed"] for r in gaps.observed_mask(s).orderBy("slot").collect()] == [True, True, True, False, False, False, True, True]
    segments = gaps.segment_table(s, hole)
    assert [gaps.erosion_weight(segments, k).first()[0] for k in (0, 1, 3)] == [5, 3, 0]
    with pytest.raises(ValueError, match="slots"):
        gaps.observed_mask(s, max_length=3)


@pytest.mark.parametrize(("entries", "expected"), [
    ([(251, 1000, "detected", ""), (500, 1000, "gap", "")], [(251, 1000, "gap", "")]),
    ([(251, 1000, "detected", ""), (300, 500, "hole", ""), (600, 900, "session", "")], [(251, 600, "hole", ""), (600, 1000, "session", "")]),
    ([(2, 5, "session", ""), (5, 10, "hole", "")], [(2, 5, "session", ""), (5, 10, "hole", "")]),
    ([(2, 6, "hole", "a"), (5, 10, "session", "b")], [(2, 10, "session+hole", "a;b")]),
    ([(2, 5, "hole", ""), (5, 10, "hole", "")], [(2, 10, "hole", "")]),
])
def test_merging(entries, expected):
    assert gaps.merge_gaps(entries) == expected


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_of_many(spark, monkeypatch):
    """Chains of entries over the borders of ranges are merged whole, and no task has all entries."""
    monkeypatch.setattr("passagelab.functions.neighbours.TASK_ROWS", 20)
    rng, at, entries = random.Random(8), 0, []
    for i in range(300):
        at += rng.randint(0, 9)
        entries.append((at, at + rng.choice([1, 2, 4, 4, 150 if i % 60 == 0 else 3]), rng.choice(["detected", "hole", "session"]), rng.choice("ab")))
    df = spark.createDataFrame(entries, "start long, stop long, kind string, source string")
    found = gaps.declare_gaps(df.where("kind = 'detected'"), df.where("kind <> 'detected'"))
    assert sorted(map(tuple, found.collect())) == gaps.merge_gaps(entries)
    assert "SinglePartition" not in plan(found)


def test_merging_is_not_quadratic():
    entries = [(10 * i, 10 * i + 5, kind, "") for i in range(60_000) for kind in ("detected", "hole")]
    begun = time.time()
    assert len(gaps.merge_gaps(entries)) == 60_000
    assert time.time() - begun < 10


def test_passes_over_ranges(spark, monkeypatch):
    rng, at, rows = random.Random(9), 0, []
    for i in range(400):
        at += 1 if rng.random() < 0.8 or 100 < i < 180 else rng.randint(2, 40)
        rows.append((at, rng.randint(0, 30)))
    s = spark.createDataFrame(rows, "t long, q long").repartition(4)

    def all_of():
        found = spark.createDataFrame(gaps.detect_gaps(s).collect(), "start long, stop long, kind string, source string")
        waits = passage.first_passage(s, ["3", "25"], 0, strategy="segment_tree")
        frames = {"segments": gaps.segment_table(s, found), "next": gaps.next_gap(s, found, (), s), "classes": gaps.classify(waits, found, series=s), "described": gaps.describe(s, found).withColumn("gaps_by_kind", F.to_json("gaps_by_kind"))}
        return frames, {k: sorted(map(str, df.collect())) for k, df in frames.items()}

    _, expected = all_of()
    for n in (1, 60):
        monkeypatch.setattr("passagelab.functions.neighbours.TASK_ROWS", n)
        monkeypatch.setattr(gaps, "BROADCAST_GAPS", n)
        frames, found = all_of()
        assert found == expected
        assert all("SinglePartition" not in plan(frames[k]) for k in ("segments", "next"))


def test_index_axis(spark):
    rows = [(i + 1, t, x) for i, (t, x) in enumerate(zip([1, 2, 3, 10, 11, 12, 13], [1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0]))]
    df = spark.createDataFrame(rows, "row long, t long, x double")
    declared = spark.createDataFrame([(4, 10, "session", ""), (12, 13, "hole", "")], "start long, stop long, kind string, source string")
    assert [r["t"] for r in gaps.index_axis(df, declared).orderBy("t").collect()] == [1, 2, 3, 4, 5, 7]
    assert [tuple(r)[:3] for r in gaps.index_gaps(df, declared).collect()] == [(6, 7, "hole")]


def test_ks(spark):
    a = spark.createDataFrame([("1", 1, 0.5), ("1", 3, 1.0)], "delta string, tau long, cdf double")
    b = spark.createDataFrame([("1", 2, 1.0)], "delta string, tau long, cdf double")
    assert distribution.ks_distance(a, b).first()["ks"] == 0.5
    assert distribution.ks_distance(a, b.limit(0)).first()["ks"] != distribution.ks_distance(a, b.limit(0)).first()["ks"]
