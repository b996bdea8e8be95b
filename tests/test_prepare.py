import math

import pytest

from passagelab.operators import diagnostics, prepare


def frame(spark, values, times=None):
    times = times or range(1, len(values) + 1)
    return spark.createDataFrame([(i + 1, t, None if v is None else float(v)) for i, (t, v) in enumerate(zip(times, values))], "row long, t long, x double")


def out(df):
    return [r["x"] for r in df.orderBy("row").collect()]


def times(df):
    return [r["t"] for r in df.orderBy("row").collect()]


def test_differences_and_logs(spark):
    assert out(prepare.differences(frame(spark, [1, 2, None, 4, 8]))) == [None, 1, None, 2, 4]
    assert out(prepare.log_returns(frame(spark, [1, 2, 4]))) == pytest.approx([None, 100 * math.log(2), 100 * math.log(2)])
    assert out(prepare.log_levels(frame(spark, [2, 4, None, 1]))) == pytest.approx([0, 100 * math.log(2), None, -100 * math.log(2)])
    with pytest.raises(Exception, match="positive"):
        prepare.log_returns(frame(spark, [1, 0])).collect()


def test_trailing_mean(spark):
    f = prepare.trailing_mean_fluctuations
    assert out(f(frame(spark, [10, 11, 12, 6]), 2)) == pytest.approx([0, 10, 1.5 * 100 / 10.5, -5.5 * 100 / 11.5])
    assert out(f(frame(spark, [-4, 1, 6]), 1, offset="auto")) == pytest.approx([0, 500, 500 / 6])
    assert out(f(frame(spark, [1, 3, 2, 6]), 2, "none")) == [0, 2, 0, 3.5]
    assert out(f(frame(spark, [1, -1, 2]), 1, offset=0, on_nonpositive="missing")) == [0, -200, None]
    with pytest.raises(Exception, match="not positive"):
        f(frame(spark, [1, -1, 2]), 1, offset=0).collect()


def test_rounding_and_trend(spark):
    assert out(prepare.round_values(frame(spark, [1.26, None, 2.35]), 1)) == [1.3, None, 2.4]
    x = out(prepare.detrend_moving_average(frame(spark, [1, 2, 3, 4, 5]), 3))
    assert x[0] == -0.5 and x[2] == 0


def test_pruning(spark):
    assert out(prepare.clip_quantile(frame(spark, [1, 2, 3, 100]), 0.75)) == [1, 2, 3, None]
    s = prepare.clip_quantile(frame(spark, [1, 50, 2, 3, 60, 4], [1, 2, 4, 7, 11, 16]), 0.6, splice=True)
    assert out(s) == [1, 2, 3, 4] and times(s) == [1, 3, 6, 11]
    assert out(prepare.clip_sigma(frame(spark, [0, 0.1, -0.1, 0.05, 100]), 1, splice=True)) == [0, 0.1, -0.1, 0.05]
    values = [1, 9.7, 2, 9.2, -9.9, 3, 4, 5, 6, 7]
    assert out(prepare.clip_extremes(frame(spark, values), 0.25, 0, splice=True)) == [1, 2, 3, 4, 5, 6, 7]
    assert out(prepare.clip_extremes(frame(spark, values), 0.35, 1)) == [1, None, 2, None, None, 3, 4, 5, 6, None]
    assert prepare.extreme_cut([(9.9, 1), (9.7, 1), (9.2, 1), (7.0, 7)], 10, 0.25, 0) == (9.0, 1)


def test_intervals(spark):
    s = prepare.exclude_intervals(frame(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 10]), [(2, 4)])
    assert out(s) == [1, 4, 5] and times(s) == [1, 2, 8]
    for intervals in ([(1, 20)], [(10, 20), (1, 10)]):
        assert times(prepare.exclude_intervals(frame(spark, [1, 2, 3], [0, 5, 25]), intervals)) == [0, 6]
    with pytest.raises(ValueError, match="overlap"):
        prepare.check_intervals([(1, 5), (4, 6)])
    with pytest.raises(ValueError, match="no row"):
        prepare.select_range(frame(spark, [1]), 5, 6)


def test_ties(spark):
    f = frame(spark, [1, 2, 3, 4], [1, 1, 2, 2])
    assert [out(prepare.collapse_ties(f, p)) for p in ("last", "first", "mean")] == [[2, 4], [1, 3], [1.5, 3.5]]
    with pytest.raises(ValueError, match="equal"):
        prepare.collapse_ties(f)
    with pytest.raises(ValueError, match="decrease"):
        prepare.collapse_ties(frame(spark, [1, 2], [2, 1]), "last")


def test_steps_are_recorded(spark):
    df, record = prepare.apply_steps(frame(spark, [1, 2, 4]), [{"op": "differences"}, {"op": "round", "digits": 1}])
    assert out(df) == [None, 1, 2] and [s["op"] for s in record.steps] == ["differences", "round"]
    assert record.tag() == "diff-round1"
    with pytest.raises(ValueError, match="unknown step"):
        prepare.apply_steps(df, [{"op": "x"}])


def test_diagnostics(spark):
    f = frame(spark, [1.25, 2.5, None, 4.75, 4.75])
    assert diagnostics.resolution_digits(f).first()["digits"] == 2
    assert diagnostics.increment_scale(f).first()["scale"] == 1.25
    assert diagnostics.suggest_digits(f) == (2, "recorded_resolution")
    assert diagnostics.suggest_digits(f, min_digits=4) == (4, "recorded_resolution")
    assert diagnostics.suggest_digits(frame(spark, [1, 2, 3]), min_digits=1) == (1, "recorded_resolution")
    assert [diagnostics.dispersion_digits(x) for x in (1.0, 0.5, 0.1, 0.01)] == [0, 1, 1, 2]
    assert diagnostics.value_summary(f).first()["n_observed"] == 4
    assert diagnostics.sampling_summary(f).first()["spacing_max"] == 1


def test_clip_extremes_counts_missing_rows(spark):
    values = [None] * 20 + [9.5, 8.2] + [1.0] * 78
    assert prepare.extreme_cut([(9.5, 1), (8.2, 1), (1.0, 78)], 100, 0.004, 1) == (9.0, 1)
    assert out(prepare.clip_extremes(frame(spark, values), 0.004, 1)) == [None] * 21 + [8.2] + [1.0] * 78
    for counts, fraction in (([(2.0, 3)], 0.5), ([(5.0, 1), (4.0, 1)], 0.9)):
        with pytest.raises(ValueError, match="every"):
            prepare.extreme_cut(counts, sum(c for _, c in counts), fraction, 0)


def test_trailing_mean_defaults(spark):
    f = frame(spark, [1, 3, 2, 6])
    std = (((2 - 11 / 6) ** 2 + (0 - 11 / 6) ** 2 + (3.5 - 11 / 6) ** 2) / 2) ** 0.5
    assert out(prepare.trailing_mean_fluctuations(f, 2, "scale")) == pytest.approx([0, 2 / std, 0, 3.5 / std])
    assert out(prepare.trailing_mean_fluctuations(f, 2, "none", offset="none")) == [0, 2, 0, 3.5]
    assert out(prepare.trailing_mean_fluctuations(f, 2)) == pytest.approx([0, 200, 0, 140])
    for bad in ({"denominator": "scale", "offset": "auto"}, {"offset": "x"}, {"denominator": "none", "offset": 1.0}):
        with pytest.raises(ValueError, match="offset"):
            prepare.trailing_mean_fluctuations(f, 2, **bad)
    with pytest.raises(Exception, match="no positive"):
        prepare.trailing_mean_fluctuations(frame(spark, [1, 1, 1]), 2, "scale").collect()


def test_step_parameters(spark):
    f = frame(spark, [1, 2, 3, 4])
    df, record = prepare.apply_steps(f, [{"op": "select_range", "from": 2, "to": 3}, {"op": "clip_sigma"}, {"op": "clip_quantile", "q": 1}])
    assert out(df) == [2, 3] and record.tag() == "range-sigma3-clip1"
    with pytest.raises(Exception, match="no positive std"):
        prepare.clip_sigma(frame(spark, [2, 2, 2])).collect()


def test_null_keys_are_keys(spark):
    f = spark.createDataFrame([(None, i, i, float(i)) for i in range(1, 5)] + [("a", i, i, float(i)) for i in range(1, 5)], "k string, row long, t long, x double")
    for made in (prepare.clip_quantile(f, 0.5, keys=["k"]), prepare.clip_sigma(f, 1.0, keys=["k"]), prepare.clip_extremes(f, 0.2, keys=["k"]), prepare.trailing_mean_fluctuations(f, 2, offset="auto", keys=["k"])):
        assert made.count() == 8
    assert diagnostics.sampling_summary(f, keys=["k"]).count() == 2


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_ranges_of_a_long_series(spark, monkeypatch, rows):
    from passagelab.functions import neighbours

    monkeypatch.setattr(neighbours, "TASK_ROWS", rows)
    times_ = [3 * i + (200 if i > 30 else 0) + i % 2 for i in range(60)]
    f = spark.createDataFrame([(i + 1, t, float(i * i % 11)) for i, t in enumerate(times_)], "row long, t long, x double").repartition(4)
    found = {r["t"]: r["p"] for r in neighbours.with_previous(f, "t", "p").collect()}
    assert found == dict(zip(times_, [None, *times_[:-1]]))
    values = [float(i * i % 11) for i in range(60)]
    assert out(prepare.differences(f)) == [None, *(b - a for a, b in zip(values, values[1:]))]
    assert neighbours.with_previous(f.limit(0), "t", "p").count() == 0


@pytest.mark.parametrize("rows", [1, 10])
def test_means_over_stretches_of_a_long_series(spark, monkeypatch, rows):
    """A mean reaches over the borders of stretches, and no task sorts the whole series."""
    f = frame(spark, [float(i * i % 11) + 1 if i % 7 else None for i in range(60)]).repartition(4)
    steps = [lambda: prepare.trailing_mean_fluctuations(f, 24, offset="auto"), lambda: prepare.trailing_mean_fluctuations(f, 3, "none"), lambda: prepare.detrend_moving_average(f, 9), lambda: prepare.log_levels(f)]
    expected = [out(step()) for step in steps]
    monkeypatch.setattr("passagelab.functions.neighbours.TASK_ROWS", rows)
    for step, before in zip(steps, expected):
        made = step()
        assert out(made) == before
        assert "windowspecdefinition(row" not in made._jdf.queryExecution().executedPlan().toString()
