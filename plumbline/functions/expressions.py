"""Column expressions that several operators use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcome tiers from worst to best, and the edges of their half-open bands.
TIERS = ["bust", "rotation", "starter", "all_star", "superstar"]
TIER_EDGES = [-2.0, 0.0, 3.0, 6.0]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def scale(x: Column, low: float, high: float) -> Column:
    """``x`` between ``low`` and ``high`` as 0 to 100, clipped; 50 if the range is empty."""
    return F.lit(50.0) if high <= low else clip((x - low) / (high - low) * 100.0, 0, 100)


def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places``, halves away from zero as SQL engines round doubles: what a tie's double is short of it by its last bit goes when it is scaled."""
    return F.round(x * 10.0**places) / 10.0**places


def measured(df: DataFrame, *names: str, default: float | None = 0.0) -> Column:
    """The first of the columns that ``df`` has with neither null nor NaN, else ``default``."""
    there = [F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(default).cast("double"))


def band(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of ``x`` by half-open bands [lo, hi); ``edges`` are the inner ones; null gives null."""
    ladder = F.when(x.isNull() | F.isnan(x), None)
    for label, high in zip(labels, edges, strict=False):
        ladder = ladder.when(x < high, label)
    return ladder.otherwise(labels[-1])


def tier(x: Column) -> Column:
    return band(x, TIER_EDGES, TIERS)


def mean_rank(order: Column, *partition: str) -> Column:
    """Ranks from 1 with ties at their mean, in the partition."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*partition, order)) - 1) / 2.0


def erf(x: Column) -> Column:
    """The error function by a rational approximation (Abramowitz and Stegun 7.1.26), to 1.5e-7."""
    # The published coefficients.
    p, a = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1 / (1 + p * F.abs(x))
    poly = reduce(lambda s, c: s * t + c, reversed(a[:-1]), F.lit(a[-1])) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    """The normal distribution function; a step where ``sd`` isn't positive."""
    z = (x - mean) / F.when(sd > 0, sd)
    return F.when(sd > 0, 0.5 * (1 + erf(z / 2.0**0.5))).otherwise(F.when(x >= mean, 1.0).otherwise(0.0))


def dot(names: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    return reduce(lambda s, x: s + F.col(x[0]) * float(x[1]), zip(names, weights, strict=True), F.lit(float(intercept)))


def linear_quantile(values: Column, q: float) -> Column:
    """The linear quantile of an array column (nulls left out)."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    place = (F.size(v) - 1) * q
    low = F.floor(place).cast("int")
    a, b = F.try_element_at(v, low + 1), F.try_element_at(v, F.ceil(place).cast("int") + 1)
    return a + (b - a) * (place - low)
