"""Probabilities of test statistics, on the driver, without further libraries."""

from __future__ import annotations

import math

import numpy as np


#: Sample sizes up to which the Kolmogorov-Smirnov distribution is computed by matrix powers.
EXACT_SIZE = 140


def kolmogorov(d: float, n: int) -> float:
    """P of a two-sided Kolmogorov-Smirnov distance of at least d among n values: exact by matrix powers up to EXACT_SIZE,
    above by Pelz and Good's expansion (error under 1e-5)."""
    if 2 * n * d <= 1:
        return 1.0
    if d >= 1 or n * d * d > 370:
        return 0.0
    return min(1.0, max(0.0, 1.0 - (_matrix_powers(d, n) if n <= EXACT_SIZE else _pelz_good(d, n))))


def kolmogorov_settled(low: float, high: float, n: int) -> bool:
    """Whether all distances from low to high have the same P to three digits, and on the same side of 0.05. Leaves room for
    the error of `kolmogorov`, so that its P of low can stand for all."""
    most, least = min(1.0, kolmogorov(low, n) + 1e-5), max(0.0, kolmogorov(high, n) - 1e-5)
    return f"{most:.3f}" == f"{least:.3f}" and (most > 0.05) == (least > 0.05)


def _matrix_powers(d: float, n: int) -> float:
    """P of a distance under d (Marsaglia, Tsang and Wang 2003)."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    at = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    matrix = (at >= 0).astype(float)
    edge = h ** np.arange(1, m + 1)
    matrix[:, 0] -= edge
    matrix[-1] -= edge[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
    matrix *= np.where(at > 0, np.exp([[-math.lgamma(max(x, 0) + 1) for x in row] for row in at]), 1.0)
    power, exponent, result, shift = matrix, 0, np.eye(m), 0  # values are matrix * e ** exponent
    left = n
    while left:
        if left & 1:
            result, shift = result @ power, shift + exponent
            top = result.max()
            result, shift = result / top, shift + math.log(top)
        power, exponent = power @ power, 2 * exponent
        top = power.max()
        power, exponent = power / top, exponent + math.log(top)
        left >>= 1
    middle = result[k - 1, k - 1]
    return math.exp(math.log(middle) + shift + math.lgamma(n + 1) - n * math.log(n)) if middle > 0 else 0.0


def _pelz_good(d: float, n: int) -> float:
    """P of a distance under d (Pelz and Good 1976): four terms in powers of 1 / sqrt(n)."""
    z = math.sqrt(n) * d
    if z < 0.05:
        return 0.0
    w, zz = math.pi * math.pi, z * z
    odd = [(k + 0.5) ** 2 for k in range(60)]  # each stands for k and -k - 1
    even = [k * k for k in range(1, 60)]
    half = lambda f: 2 * sum(f(x) * math.exp(-w * x / (2 * zz)) for x in odd)
    whole = lambda f: 2 * sum(f(x) * math.exp(-w * x / (2 * zz)) for x in even)
    root = math.sqrt(math.pi / 2)
    first = root * half(lambda x: 1.0) / z
    second = root * half(lambda x: w * x - zz) / (6 * z**4)
    third = root * half(lambda x: 6 * zz**3 + 2 * zz**2 + w * x * (2 * zz**2 - 5 * zz) + (w * x) ** 2 * (1 - 2 * zz)) / (72 * z**7) - root * whole(lambda x: w * x) / (36 * z**3)
    fourth = root * half(lambda x: (w * x) ** 3 * (5 - 30 * zz) + (w * x) ** 2 * (-60 * zz + 212 * zz**2) + w * x * (135 * zz**2 - 96 * zz**3) - 30 * zz**3 - 90 * zz**4) / (6480 * z**10) + root * whole(lambda x: 3 * w * x * zz - (w * x) ** 2) / (108 * z**6)
    return first + second / math.sqrt(n) + third / n + fourth / n**1.5


def chi_square(x: float, df: int) -> float:
    """P of a chi-square value at least x, by the incomplete gamma function."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def anderson_limit(n: int) -> float:
    """The 5 % critical value of Anderson-Darling's statistic for a normal distribution with fitted parameters."""
    return 0.787 / (1 + 4 / n - 25 / n**2)


# The polynomials of algorithm AS R94 (Royston 1995), from the constant term.
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_SD = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _value(polynomial: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(polynomial))


def shapiro_ends(n: int, square: float, last: float, last_but_one: float) -> tuple[list[float], float]:
    """The weights of the greatest values (from the greatest), and the scale of the others: a weight is the expected normal
    score divided by it. square: the sum of squared scores; last, last_but_one: the greatest scores."""
    if n == 3:
        return [math.sqrt(0.5)], 1.0
    u, root = 1 / math.sqrt(n), math.sqrt(square)
    scores = [last] if n <= 5 else [last, last_but_one]
    ends = [_value(p, u) + m / root for p, m in zip((_LAST, _LAST_BUT_ONE), scores, strict=False)]
    return ends, math.sqrt((square - 2 * sum(m * m for m in scores)) / (1 - 2 * sum(e * e for e in ends)))


def shapiro_probability(w: float, n: int) -> float:
    """P of Shapiro and Wilk's W for 3 to 5000 values; for more, the same functions carried on."""
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = _value(_GAMMA, n)
        if y >= gamma:
            return 1e-99
        z = (-math.log(gamma - y) - _value(_SMALL_MEAN, n)) / math.exp(_value(_SMALL_SD, n))
    else:
        z = (y - _value(_LARGE_MEAN, math.log(n))) / math.exp(_value(_LARGE_SD, math.log(n)))
    return 0.5 * math.erfc(z / math.sqrt(2))
