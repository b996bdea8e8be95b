import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagelab.functions.kernels import MaxTree, heap_search, sweep_search, tree_search
from passagelab.operators import passage

NAMES = ["theta", "guarded", "block", "segment_tree", "sweep", "streaming", "tiles"]


def series(spark, values, times=None, key=None):
    times = times or range(1, len(values) + 1)
    return spark.createDataFrame([(t, v) for t, v in zip(times, values)], "t long, q long")


def naive(q, d):
    return [next((j for j in range(i + 1, len(q)) if q[j] >= q[i] + d), -1) for i in range(len(q))]


@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_kernels_agree(values, d):
    q = np.array(values, np.int64)
    expected = naive(values, d)
    for search in (tree_search, heap_search, sweep_search):
        assert search(q, d).tolist() == expected


def test_tree_from_any_start():
    rng = np.random.default_rng(1)
    q = rng.integers(0, 50, 37)
    tree = MaxTree(q)
    for start, target in itertools.product(range(0, 40, 3), (0, 25, 49, 60)):
        found = tree.first_at_least(np.array([start]), np.array([target]))[0]
        assert found == next((j for j in range(start, len(q)) if q[j] >= target), -1)


@pytest.mark.parametrize("name", NAMES)
def test_hand_computed(spark, name):
    expected = {0: [1, 2, 1, 3, 1, 1, 0], 1: [1, 2, 1, 3, 2, 1, 0], 2: [1, 2, 1, 0, 2, 1, 0], 3: [3, 5, 1, 0, 0, 0, 0], 5: [6, 0, 0, 0, 0, 0, 0], 6: [0] * 7}
    rows = passage.first_passage(series(spark, [1, 3, 2, 5, 4, 4, 6]), list(expected), 0, strategy=name).collect()
    for d, tau in expected.items():
        assert [r["tau"] for r in sorted(rows, key=lambda r: r["n"]) if r["d"] == d] == tau


def test_irregular_times_and_edges(spark):
    rows = passage.first_passage(series(spark, [25] * 5, [1, 2, 4, 8, 16]), ["0", "0.1"], 1).orderBy("d", "t").collect()
    assert [r["tau"] for r in rows] == [1, 2, 4, 8, 0, 0, 0, 0, 0, 0]
    assert passage.first_passage(series(spark, [1]), "1", 0).first()["tau"] == 0
    assert passage.first_passage(series(spark, [1]).limit(0), "1", 0).count() == 0


@pytest.mark.parametrize("name", ["block", "tiles", "segment_tree"])
def test_keyed_ensemble(spark, name):
    paths = list(itertools.product(range(3), repeat=4))
    rows = [(f"p{i}", t, v) for i, p in enumerate(paths) for t, v in enumerate(p)] + [(None, 0, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "key string, t long, q long")
    found = passage.first_passage(df, ["1"], 0, ["key"], name).collect()
    for i, p in enumerate(paths):
        own = [r["tau"] for r in sorted(found, key=lambda r: r["n"]) if r["key"] == f"p{i}"]
        assert own == [m - n if m >= 0 else 0 for n, m in enumerate(naive(p, 1))]
    assert [r["tau"] for r in found if r["key"] is None and r["n"] == 1] == [1]


def test_long_series_over_small_tiles(spark):
    q = np.cumsum(np.random.default_rng(5).integers(-3, 4, 3000)).tolist()
    df = series(spark, q)
    expected = heap_search(np.array(q), 40)
    found = {r["n"]: r["tau"] for r in passage.tiles(df, passage.thresholds_of("40", 0), (), tile_rows=64).collect()}
    assert [found[i + 1] for i in range(len(q))] == [m - i if m >= 0 else 0 for i, m in enumerate(expected.tolist())]


@pytest.mark.parametrize("name", ["sweep", "segment_tree", "streaming", "tiles"])
@pytest.mark.parametrize("keyed", [False, True])
def test_kernels_of_long_series_by_tiles(spark, monkeypatch, name, keyed):
    """Long and short series in one frame, cut anywhere; what a task holds doesn't follow a series' length."""
    monkeypatch.setattr(passage, "SERIES_ROWS", 100)
    monkeypatch.setattr(passage, "SLICE_ROWS", 50)
    monkeypatch.setattr(passage.tiles, "__defaults__", ((), 64, *passage.tiles.__defaults__[2:]))
    rng, rows, expected = np.random.default_rng(7), [], {}
    for key, size in ((None, 150), ("a", 1), ("b", 700), ("c", 3), ("d", 64), ("e", 128), ("f", 90)) if keyed else (("b", 700),):
        q, t = np.cumsum(rng.integers(-3, 4, size)), np.cumsum(rng.integers(1, 5, size))
        rows += [(key, int(x), int(y)) for x, y in zip(t, q)]
        for d in (1, 12):
            m = heap_search(q, d)
            expected |= {(key, d, i + 1): int(t[j] - t[i]) if j >= 0 else 0 for i, j in enumerate(m)}
    df = spark.createDataFrame(rows, "k string, t long, q long").repartition(3)
    found = passage.first_passage(df if keyed else df.drop("k"), ["1", "12"], 0, ["k"] if keyed else [], name)
    assert {(r["k"] if keyed else "b", r["d"], r["n"]): r["tau"] for r in found.collect()} == expected
    assert "MapInArrow" in plan(found)


def test_tiles_hold_many_short_series(spark):
    df = spark.range(3000).selectExpr("id div 3 as k", "id % 3 as t", "id % 3 as q")
    found = passage.tiles(df, passage.thresholds_of("1", 0), ["k"])
    assert found.where("tau = 1").count() == 2000
    assert "cogroup" not in plan(found).lower()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["walk", "spike"])
@pytest.mark.parametrize("name", ["block", "guarded", "theta"])
def test_joins_of_a_long_series(spark, monkeypatch, name, kind):
    monkeypatch.setattr("passagelab.functions.neighbours.TASK_ROWS", 500)
    rng = np.random.default_rng(6)
    # a spike at the end ends nearly all waits in one place
    q = np.cumsum(rng.integers(-3, 4, 6000)) if kind == "walk" else np.r_[rng.integers(0, 9, 5999), 50]
    found = passage.first_passage(series(spark, q.tolist()), ["2", "40"], 0, strategy=name)
    for d in (2, 40):
        expected = [m - i if m >= 0 else 0 for i, m in enumerate(heap_search(q, d).tolist())]
        assert [r["tau"] for r in found.where(f"d = {d}").orderBy("n").collect()] == expected
    # no task has the whole series, and no join compares rows with all later ones
    assert "SinglePartition" not in plan(found)
    assert plan(found).count("NestedLoopJoin") + plan(found).count("CartesianProduct") <= 2


def test_scan_work_and_errors(spark):
    w = passage.first_passage(series(spark, [1, 3, 2, 5, 4, 4, 6]), "3", 0)
    assert passage.scan_work(w).first()["work"] == 15
    assert passage.scan_work(w, guarded=True).first()["work"] == 9
    with pytest.raises(OverflowError):
        passage.first_passage(series(spark, [2**62]), str(2**62), 0)
    with pytest.raises(ValueError, match="unknown strategy"):
        passage.first_passage(series(spark, [1]), "1", 0, strategy="x")
    with pytest.raises(ValueError, match="no device"):
        passage.first_passage(series(spark, [1]), "1", 0, strategy="device")
    assert "tiles" in passage.strategies()
