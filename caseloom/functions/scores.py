"""Guarded arithmetic: every ratio and statistic has a defined value for empty and constant input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, or ``empty`` where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 for fewer than two rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    seen = lambda c: F.when(both, c)
    usable = (F.count_if(both) > 1) & (F.max(seen(x)) > F.min(seen(x))) & (F.max(seen(y)) > F.min(seen(y)))
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # central moments, which large values leave exact
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(F.lit(0.0))


def sample_variance(x: Column) -> Column:
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def trimmed(values: Column) -> Column:
    """A sorted array without one least and one greatest value, if it has more than two."""
    return F.when(F.size(values) > 2, F.slice(values, F.lit(2), F.size(values) - 2)).otherwise(values)


def middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.element_at(values, ((n + 1) / 2).cast("int")) + F.element_at(values, (n / 2).cast("int") + 1)) / 2


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / F.greatest(size(a) * size(b), F.lit(1e-8))


def differing_bits(a: Column, b: Column, bits: int = 16) -> Column:
    """Ascending positions at which two numbers differ."""
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(a.bitwiseXOR(b), i) == 1)


def hamming_weight(x: Column, bits: int = 16) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit((1 << bits) - 1)))


def in_band(value: Column, truth: Column, factor: float) -> Column:
    """Within a factor of the truth; for a truth near zero, at most the factor itself."""
    return F.when(truth <= 1e-9, F.abs(value) <= factor).otherwise(value.between(truth / factor, truth * factor))


def shrunk_budget(context: Column, used: Column, now: Column) -> Column:
    """A smaller output budget that fits the context, or null if none is known, useful or smaller."""
    fits = context - used - 64
    return F.when((fits >= 64) & (fits < now), fits)


def escalated(base: Column, step: Column, cap: Column) -> Column:
    return F.least(base * F.pow(F.lit(2), step).cast("long"), cap)
