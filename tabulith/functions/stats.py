"""Statistics as Column expressions. Nulls are missing; NaN is a value."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fields up to which Spark generates code for an aggregate inside `wide_code`.
WIDE = 2000


@contextmanager
def wide_code(spark: SparkSession) -> Iterator[None]:
    """Lets Spark generate code for aggregates of many fields (it stops at 100 by default)."""
    name = "spark.sql.codegen.maxFields"
    before = int(spark.conf.get(name))
    spark.conf.set(name, max(before, WIDE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def greatest(c: Column) -> Column:
    """max that passes NaN over, as min does."""
    return F.max(F.when(~F.isnan(c), c))


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are there; null where one is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def skew(c: Column) -> Column:
    """Population skewness from 3 values on; NaN for constants."""
    return F.when(F.count(c) > 2, F.coalesce(F.skewness(c), F.lit(float("nan"))))


def excess_kurtosis(c: Column) -> Column:
    """m4 / s^4 - 3 with the sample s; null to 2 values, NaN for 3 and for constants."""
    n = F.count(c)
    ratio = (n - 1) / F.greatest(n, F.lit(1))
    return F.when(n < 3, None).when(n < 4, F.lit(float("nan"))).otherwise(F.coalesce((F.kurtosis(c) + 3) * ratio * ratio - 3, F.lit(float("nan"))))


def erfc(x: Column) -> Column:
    """Complementary error function, relative error under 1.2e-7 (the Chebyshev fit of Numerical Recipes, 6.2)."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    # The coefficients of the fit, from the constant term.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    inner = F.lit(0.0)
    for c in reversed(fit):
        inner = c + t * inner
    tail = t * F.exp(-z * z + inner)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / 1.4142135623730951)


# The rational functions of algorithm AS 241 (Wichura 1988), PPND16, from the constant term: for the middle,
# the tails and the far tails, each the numerator and the denominator.
INVERSE_NORMAL = (
    ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)),
    ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def normal_inverse(p: Column) -> Column:
    """The quantile of the standard normal distribution for p between 0 and 1."""

    def ratio(x: Column, region: int) -> Column:
        out = []
        for polynomial in INVERSE_NORMAL[region]:
            value = F.lit(0.0)
            for c in reversed(polynomial):
                value = c + value * x
            out.append(value)
        return out[0] / out[1]

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(r - 1.6, 1)).otherwise(ratio(r - 5, 2))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, 0)).otherwise(F.signum(q) * tail)


def bin_of(v: Column, edges: list[float]) -> Column:
    """The bin (from 0) of v between equal-width edges; the last bin is closed; null outside and for NaN."""
    bins, low, high = len(edges) - 1, edges[0], edges[-1]
    at = F.array(*map(F.lit, edges))
    guess = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    # the quotient may be off by one where v is at an edge
    guess = F.when(v < F.get(at, guess), guess - 1).when((v >= F.get(at, guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    return F.when(~F.isnan(v) & (v >= low) & (v <= high), guess)
