"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """1/0 flag; an unknown condition counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def at_least(x: Column, low: Column | float) -> Column:
    """Raise ``x`` to ``low``, keeping nulls null."""
    return F.when(x.isNotNull(), F.greatest(x, low if isinstance(low, Column) else F.lit(low)))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness (G1); null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def constant_in_pairs(x: Column | str, y: Column | str) -> Column:
    """Aggregate: at least two pairs are known and ``x`` has one value in all of them."""
    known = _in_pairs(x, y)
    # A variance merged from several tasks can miss zero by its last bits.
    return (F.count(known) > 1) & ((F.min(known) == F.max(known)) | (F.var_pop(known) == 0.0))


def _in_pairs(x: Column | str, y: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(y.isNotNull(), x)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the known pairs: NaN if a side is constant (``F.corr`` fails there), null below two pairs."""
    a, b = _in_pairs(x, y), _in_pairs(y, x)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    flat = constant_in_pairs(x, y) | constant_in_pairs(y, x) | (spread == 0.0)
    return F.when(F.count(F.when(b.isNotNull(), a)) < 2, None).when(flat, float("nan")).otherwise(F.covar_pop(a, b) / spread)


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of ``y`` on ``x``; NaN if ``x`` is constant, null below two pairs."""
    return F.when(constant_in_pairs(x, y), float("nan")).otherwise(F.regr_slope(y, x))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def unscale(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def to_number(x: Column) -> Column:
    """Lossy text-to-double: anything that is not a finite number becomes null."""
    v = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)
