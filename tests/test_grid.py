import pytest
from pyspark.sql import functions as F

from passagelab.functions.grid import Threshold, decimals, format_column, linear_grid, log_grid, on_grid, parse_threshold, quantize, quantize_number, threshold


@pytest.mark.parametrize(("x", "digits", "q"), [(0.545, 2, 55), (0.575, 2, 57), (1.015, 2, 101), (-2.5, 0, -2), (3.5, 0, 4)])
def test_rounds_half_even_twice(spark, x, digits, q):
    assert quantize_number(x, digits) == q
    assert spark.range(1).select(quantize(F.lit(x), digits)).first()[0] == q


def test_rejects_what_is_not_finite(spark):
    for x in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            spark.range(1).select(quantize(F.lit(x), 2)).collect()
    assert spark.range(1).select(quantize(F.lit(None).cast("double"), 2)).first()[0] is None


def test_thresholds():
    assert threshold(0.0005, 4).d == 5 and threshold("32.5", 1).d == 325
    assert str(Threshold(1000005, 2)) == "10000.05" and str(Threshold(7, 0)) == "7"
    for bad in ((0.00055, 4), (-1.0, 2), (float("inf"), 2), ("0.005", 2), ("x", 2)):
        with pytest.raises(ValueError):
            threshold(*bad)
    assert sorted([Threshold(3, 1), Threshold(1, 1)])[0].d == 1
    with pytest.raises(ValueError):
        _ = Threshold(1, 1) < Threshold(1, 2)
    assert parse_threshold("5.", 2) == 500 and decimals(0.25) == 2


def test_grids(spark):
    log = log_grid(0.001, 1, 3, 4)
    assert log[0].d == 10 and log[-1].d == 10000 and len({x.d for x in log}) == len(log)
    assert [x.d for x in linear_grid(0, 1, 0.25, 2)] == [0, 25, 50, 75, 100]
    df = spark.createDataFrame([(5,), (1234,)], "d long")
    assert [r[0] for r in df.select(format_column(F.col("d"), 2)).collect()] == ["0.05", "12.34"]
    assert spark.range(1).select(on_grid(F.lit(1.25), 2), on_grid(F.lit(1.255), 2)).first()[:] == (True, False)
