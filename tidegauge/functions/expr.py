"""Column expressions that several operators share; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.nullif(b, F.lit(0.0))


def finite(c: Column) -> Column:
    """``c`` where it is a finite number, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def normal_cdf(z: Column) -> Column:
    """Phi(z) by the rational approximation 26.2.17 of Abramowitz and Stegun, within 7.5e-8."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def normal_quantile(p: Column) -> Column:
    """The inverse of Phi by Acklam's rational approximations, within 1.2e-9 relative."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def horner(k: tuple[float, ...], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    edge = 0.02425
    q = p - 0.5
    middle = horner(a, q * q) * q / horner(b, q * q)
    low, high = F.sqrt(-2 * F.log(F.greatest(p, F.lit(1e-300)))), F.sqrt(-2 * F.log(F.greatest(1 - p, F.lit(1e-300))))
    return F.when(p < edge, horner(c, low) / horner(d, low)).when(p > 1 - edge, -horner(c, high) / horner(d, high)).otherwise(middle)


def severity(ratio: Column, medium: float, high: float, critical: float) -> Column:
    """The class of an anomaly by how far a ratio goes beyond its thresholds."""
    return F.when(ratio >= critical, "critical").when(ratio >= high, "high").when(ratio >= medium, "medium").otherwise("low")


def severity_level(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for level, s in enumerate(SEVERITIES, 1):
        out = F.when(name == s, level).otherwise(out)
    return out


def box_cox(x: Column, power: float) -> Column:
    return F.log(x) if power == 0 else (F.pow(x, F.lit(power)) - 1) / power


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2.0 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


#: Activations of one number; softmax takes an array.
ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "swish": lambda x: x / (1 + F.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
}


def softmax(xs: Column) -> Column:
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sum_over(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Distances of arrays are infinite where the lengths differ."""
    return F.when(F.size(a) != F.size(b), F.lit(math.inf)).otherwise(F.sqrt(_sum_over(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.lit(math.inf)).otherwise(_sum_over(a, b, lambda x, y: F.abs(x - y)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector is zero."""
    norms = F.sqrt(_sum_over(a, a, lambda x, y: x * y)) * F.sqrt(_sum_over(b, b, lambda x, y: x * y))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(safe_div(_sum_over(a, b, lambda x, y: x * y), norms), F.lit(0.0)))


def diagonal_mahalanobis(a: Column, b: Column, sigma: Column) -> Column:
    """With one standard deviation per component; components of deviation 0 don't count."""
    scaled = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), sigma, lambda d, s: F.when(s > 0, d * d / (s * s)).otherwise(F.lit(0.0)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) != F.size(sigma)), F.lit(math.inf)).otherwise(F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)))
