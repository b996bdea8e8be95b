"""The decimal grid: values and thresholds as integers of 10**-digits."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIGITS = 15
#: Grid units by which a threshold may be off the grid.
GRID_TOLERANCE = 1e-6
#: Largest magnitude a value may have on the grid.
GRID_LIMIT = 9.0e18
MAX_LONG = (1 << 63) - 1


def check_digits(digits: int) -> int:
    if not 0 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must be in 0:{MAX_DIGITS}, not {digits}")
    return digits


def quantize(x: Column, digits: int) -> Column:
    """The grid integer of a value, rounded half to even twice: to digits, then to the integer.

    Null stays null; a value that isn't finite or leaves the 64-bit range raises.
    """
    s = F.lit(float(10 ** check_digits(digits)))
    g = F.rint(F.rint(x * s) / s * s)
    bad = F.isnan(g) | (F.abs(g) >= GRID_LIMIT)
    return F.when(bad, F.raise_error(F.lit("value is not finite or outside the grid")).cast("long")).otherwise(g.cast("long"))


def quantize_number(x: float, digits: int) -> int:
    s = float(10 ** check_digits(digits))
    g = round(round(x * s) / s * s)
    if not math.isfinite(x) or abs(g) >= GRID_LIMIT:
        raise ValueError(f"{x} is not finite or outside the grid")
    return int(g)


def on_grid(x: Column, digits: int) -> Column:
    """Whether a value is within the tolerance of the grid of ``digits``."""
    g = x * F.lit(float(10 ** check_digits(digits)))
    return F.abs(g - F.rint(g)) <= GRID_TOLERANCE


@total_ordering
@dataclass(frozen=True)
class Threshold:
    """A threshold as a grid integer; thresholds of other digits don't compare."""

    d: int
    digits: int

    def __post_init__(self):
        check_digits(self.digits)
        if self.d < 0:
            raise ValueError("a threshold must not be negative")
        if self.d > MAX_LONG:
            raise OverflowError("a threshold must fit in 64 bits")

    def __lt__(self, other: Threshold) -> bool:
        if self.digits != other.digits:
            raise ValueError("thresholds of different digits don't compare")
        return self.d < other.d

    def __float__(self) -> float:
        return self.d / 10**self.digits

    def __str__(self) -> str:
        return format_threshold(self.d, self.digits)


def format_threshold(d: int, digits: int) -> str:
    """The threshold with exactly ``digits`` decimals."""
    whole, rest = divmod(d, 10**digits)
    return f"{whole}.{rest:0{digits}d}" if digits else str(whole)


def format_column(d: Column, digits: int) -> Column:
    s = 10**digits
    whole = F.floor(d / F.lit(s)).cast("long") if digits == 0 else F.expr(f"({d._jc.toString()}) div {s}")
    if digits == 0:
        return d.cast("string")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((d % s).cast("string"), digits, "0"))


def threshold_integer(delta: float, digits: int) -> int:
    """The grid integer of a threshold that must lie on the grid."""
    if not math.isfinite(delta) or delta < 0:
        raise ValueError(f"threshold {delta} must be finite and not negative")
    g = delta * 10 ** check_digits(digits)
    d = round(g)
    if abs(g - d) > GRID_TOLERANCE:
        raise ValueError(f"threshold {delta} is not on the grid of {digits} digits")
    if d > MAX_LONG:
        raise OverflowError(f"threshold {delta} must fit in 64 bits")
    return d


def parse_threshold(text: str, digits: int) -> int:
    """The grid integer of a decimal string, without rounding."""
    if not re.fullmatch(r"\d+(\.\d*)?", text.strip()):
        raise ValueError(f"not a decimal threshold: {text!r}")
    scaled = Decimal(text.strip()).scaleb(digits)
    if scaled != scaled.to_integral_value():
        raise ValueError(f"{text!r} has more than {digits} decimals")
    return int(scaled)


def threshold(delta, digits: int) -> Threshold:
    """A threshold from a :class:`Threshold`, a number or a decimal string."""
    if isinstance(delta, Threshold):
        if delta.digits != digits:
            raise ValueError(f"threshold has {delta.digits} digits, the series {digits}")
        return delta
    return Threshold(parse_threshold(delta, digits) if isinstance(delta, str) else threshold_integer(float(delta), digits), digits)


def decimals(value: float) -> int:
    """Decimals of a number as written."""
    exponent = Decimal(repr(float(value))).normalize().as_tuple().exponent
    return max(0, -int(exponent))


def linear_grid(lo: float, hi: float, step: float, digits: int) -> list[Threshold]:
    a, b, s = (threshold_integer(x, digits) for x in (lo, hi, step))
    if s < 1 or b < a:
        raise ValueError("a linear grid needs step > 0 and max >= min")
    return [Threshold(d, digits) for d in range(a, b + 1, s)]


def log_grid(lo: float, hi: float, per_decade: int, digits: int) -> list[Threshold]:
    """Points of equal ratio on the grid, at least a step apart, with ``hi`` at the end."""
    a, b = threshold_integer(lo, digits), threshold_integer(hi, digits)
    if a < 1 or b < a or per_decade < 1:
        raise ValueError("a log grid needs 0 < min <= max and points_per_decade > 0")
    found, k, last = [], 0, 0
    while True:
        value = 10 ** (math.log10(a) + k / per_decade)
        if value > b * (1 + 1e-12):
            break
        d = max(round(value), last + 1) if last else round(value)
        k += 1
        if last and round(value) <= last:
            continue
        found.append(d)
        last = d
    return [Threshold(d, digits) for d in sorted({*(x for x in found if x <= b), b})]
