"""Column functions: ties, kernels, losses, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def miss_probability(n: Column, m: Column, draws: Column) -> Column:
    """C(n - m, draws) / C(n, draws): no hit among draws from n of which m would be hits. A product, so nothing overflows."""
    steps = F.sequence(F.lit(0), (draws - 1).cast("int"))
    factor = F.aggregate(steps, F.lit(1.0), lambda a, i: a * F.greatest(n - m - i, F.lit(0)).cast("double") / F.greatest(n - i, F.lit(1)).cast("double"))
    return F.when(draws <= 0, F.lit(1.0)).otherwise(factor)


def decay(distance: Column, reach: float, length: Column) -> Column:
    """exp(-distance / reach) times length within reach, 0 beyond."""
    return F.when(distance <= reach, F.exp(-distance / reach) * length).otherwise(0.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def weighted_log_loss(z: Column, y: Column, positive: Column) -> Column:
    """Binary cross-entropy of a log-odds, positives weighted; stable for large |z|."""
    return (1 - y) * z + (1 + (positive - 1) * y) * (F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def standardized(x: Column, centre: Column, spread: Column, mask: Column) -> Column:
    """(x - centre) / spread where the mask holds, else 0."""
    return F.when(mask, (x - centre) / spread).otherwise(0.0)
