"""Column functions for rounding, clamping and elapsed time.

Three roundings are in use and differ on purpose: truncation after adding a half (scores),
half away from zero at k decimals (shares, runtime scores), and plain truncation (ages).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round2(x) -> Column:
    """Two decimals by truncating x*100 plus or minus a half towards zero."""
    x = col(x).cast("double")
    half = F.when(x >= 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    return (x * 100 + half).cast("bigint") / F.lit(100.0)


def round_half(x, digits: int) -> Column:
    """digits decimals, halves away from zero, scaled in binary floating point."""
    scale = float(10**digits)
    return F.round(col(x).cast("double") * scale) / scale


def clamp(x, low: float, high: float) -> Column:
    """x held between low and high; NaN becomes low."""
    x = col(x).cast("double")
    return F.when(F.isnan(x), F.lit(low)).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clamp01(x) -> Column:
    return clamp(x, 0.0, 1.0)


def ratio(a, b, empty: float = 0.0) -> Column:
    """a / b, or empty where b is zero or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(empty))


def elapsed_seconds(at, now) -> Column:
    return (F.unix_micros(col(now).cast("timestamp")) - F.unix_micros(col(at).cast("timestamp"))) / F.lit(1e6)


def age_days(at, now) -> Column:
    """Whole elapsed 24-hour days, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), (elapsed_seconds(at, now) / 86400).cast("bigint"))


def decay_weight(at, now, half_life_days: float) -> Column:
    """Half as much every half life; the future and a half life of zero count fully."""
    if half_life_days <= 0:
        return F.lit(1.0)
    days = elapsed_seconds(at, now) / 86400
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.exp(days * (-0.6931471805599453 / half_life_days)))


def format_complexity(x) -> Column:
    x = col(x)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", x))


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]
