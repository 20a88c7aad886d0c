"""Bins, roundings and transforms as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_bin(x: Column, scale: float, base: float) -> Column:
    return F.lit(scale) * F.pow(F.lit(base), F.floor(F.ln(x) / F.lit(math.log(base))).cast("double"))


def bin_delta_t(x: Column) -> Column:
    return F.round(_log_bin(F.greatest(x, F.lit(1e-6)), 2.48, 3.62), 2)


def bin_i(x: Column) -> Column:
    return F.round(_log_bin(x.cast("double"), 1.99, 1.89), 0)


def bin_lapse(x: Column) -> Column:
    """0 for none; the guard keeps the logarithm's argument positive."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(_log_bin(F.greatest(x, F.lit(1)).cast("double"), 1.65, 1.73), 0))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def exploit_bins(lapse: Column, delta_t: Column, i: Column) -> tuple[Column, Column, Column]:
    """Bins of the online model: rounded half to even, intervals not floored."""
    low = F.when(lapse == 0, F.lit(0.0)).otherwise(half_even(_log_bin(F.greatest(lapse, F.lit(1)).cast("double"), 1.65, 1.73)))
    return low, half_even(_log_bin(delta_t, 2.48, 3.62), 2), half_even(_log_bin(i.cast("double"), 1.99, 1.89))


def transform_elapsed(x: Column) -> Column:
    return (F.ln(x + F.lit(1e-5)) + F.lit(1.3)) / F.lit(5.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def round6(x: Column) -> Column:
    return F.round(x, 6)
