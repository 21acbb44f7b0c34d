"""Element-wise Column expressions. Missing stays missing; a division by zero is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: magnitudes from here on are treated as missing.
MAX_MAGNITUDE = 1e15
#: Fixed value: the pattern of a plain ticker (at most seven characters).
TICKER = r"^[A-Z][A-Z0-9-]{0,6}$"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(x) -> Column:
    """NaN, infinities and absurd magnitudes become NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < MAX_MAGNITUDE), x)


def zero_to_null(x) -> Column:
    x = col(x)
    return F.nullif(x, F.lit(0).cast("double"))


def null_to_zero(x) -> Column:
    return F.coalesce(sanitize(x), F.lit(0.0))


def div(a, b) -> Column:
    return col(a) / zero_to_null(b)


def add(a, b) -> Column:
    return col(a) + col(b)


def sub(a, b) -> Column:
    return col(a) - col(b)


def mul(a, b) -> Column:
    return col(a) * col(b)


def neg(a) -> Column:
    return -col(a)


def log(x) -> Column:
    """Natural logarithm, NULL where the argument is not positive."""
    x = col(x)
    return F.when(x > 0, F.log(x))


def sqrt(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def signlog(x) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def signsqrt(x) -> Column:
    """sign(x) * sqrt(|x| + 1): the jump at zero is part of the definition."""
    x = col(x)
    return F.signum(x) * F.sqrt(F.abs(x) + 1.0)


def sign_of(x) -> Column:
    """x / |x|, missing at zero."""
    x = col(x)
    return x / zero_to_null(F.abs(x))


def dollar_volume(price, volume, fallback=None) -> Column:
    """|price| * volume; ``fallback`` is the adjusted price used where the raw one is missing."""
    p = col(price) if fallback is None else F.coalesce(col(price), col(fallback))
    return F.abs(p) * col(volume)


def signed_bucket(x, thresholds) -> Column:
    """Index of |x| among half-open buckets cut at ``thresholds``, times the sign of x."""
    x = col(x)
    a = F.abs(x)
    level = sum((F.when(a >= t, 1).otherwise(0) for t in sorted(thresholds)), F.lit(0))
    return F.when(x.isNotNull(), (level * F.signum(x)).cast("int"))


def masked(x, mask) -> Column:
    """x inside the universe, missing outside."""
    return F.when(col(mask), col(x))


def sector_dummies(sector, codes, prefix: str = "sector") -> list[Column]:
    """One 0/1 column per code; a row without a sector has 0 everywhere."""
    return [
        F.coalesce((col(sector) == c).cast("double"), F.lit(0.0)).alias(f"{prefix}_{c}")
        for c in codes
    ]


def normalize_ticker(x) -> Column:
    """Trim, upper case, '.' as '-'; anything that is not a plain ticker is missing."""
    t = F.regexp_replace(F.upper(F.trim(col(x))), r"\.", "-")
    return F.when(t.rlike(TICKER), t)


def period_end(fiscal_year, fiscal_quarter, year_end_month) -> Column:
    """Last day of a fiscal quarter; a year-end month up to May lies in the next calendar year."""
    y, q, m = col(fiscal_year), col(fiscal_quarter), col(year_end_month)
    end_year = y + F.when(m <= 5, 1).otherwise(0)
    months = (end_year * 12 + (m - 1) - (4 - q) * 3).cast("int")
    return F.last_day(
        F.make_date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1))
    )


def hard_split(p, threshold: float) -> tuple[Column, Column]:
    """(calm, stress): stress is 1 above the threshold; missing stays missing."""
    p = col(p)
    d = F.when(p.isNotNull(), (p > threshold).cast("double"))
    return (1.0 - d), d


def gate_within(days, lo: int | None = None, hi: int | None = None) -> Column:
    """``lo <= days <= hi`` as a boolean; a missing counter is False."""
    days = col(days)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (days >= lo)
    if hi is not None:
        ok = ok & (days <= hi)
    return F.coalesce(ok, F.lit(False))


# --- normal distribution ---------------------------------------------------------------------
# Spark SQL has no erf. The CDF uses West's double-precision form of Hart's algorithm (Wilmott
# 2005), relative error near 1e-15; the quantile uses Acklam's rational approximation.

# Numerator and denominator coefficients of the published CDF approximation.
_CDF_NUM = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
_CDF_DEN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Coefficients of the published quantile approximation.
_Q_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2,
        -3.066479806614716e1, 2.506628277459239)
_Q_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1,
        -1.328068155288572e1, 1.0)
_Q_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734,
        4.374664141464968, 2.938163982698783)
_Q_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(x: Column, coefs) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def _bind(x, fn) -> Column:
    """fn(x) with x evaluated once: a one-element array map keeps long formulas from repeating it."""
    if isinstance(x, str):
        return fn(F.col(x))
    return F.element_at(F.transform(F.array(x), fn), 1)


def norm_cdf(x) -> Column:
    """Standard normal distribution function."""
    def formula(v):
        a = F.abs(v)
        e = F.exp(-a * a / 2.0)
        core = e * _poly(a, _CDF_NUM) / _poly(a, _CDF_DEN)
        cf = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            cf = a + F.lit(k) / cf
        far = e / cf / 2.506628274631
        tail = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, core).otherwise(far)
        return F.when(v.isNotNull(), F.when(v > 0, 1.0 - tail).otherwise(tail))

    return _bind(x, formula)


def norm_ppf(p) -> Column:
    """Standard normal quantile, relative error about 1e-9."""
    def formula(v):
        q = v - 0.5
        r = q * q
        mid = q * _poly(r, _Q_A) / _poly(r, _Q_B)
        lo_t = F.sqrt(-2.0 * F.log(v))
        hi_t = F.sqrt(-2.0 * F.log(1.0 - v))
        lo = _poly(lo_t, _Q_C) / _poly(lo_t, _Q_D)
        hi = -_poly(hi_t, _Q_C) / _poly(hi_t, _Q_D)
        x = F.when(v < 0.02425, lo).when(v > 1.0 - 0.02425, hi).otherwise(mid)
        return F.when((v > 0) & (v < 1), x)

    return _bind(p, formula)


def p_value(t, alternative: str = "two-sided") -> Column:
    """Normal p-value of a t statistic: ``less`` or ``two-sided``."""
    if alternative == "less":
        return norm_cdf(t)
    if alternative == "two-sided":
        return 2.0 * norm_cdf(-F.abs(col(t)))
    raise ValueError(f"unknown alternative {alternative!r}")
