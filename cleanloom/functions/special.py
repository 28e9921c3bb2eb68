"""Distribution functions that neither the engine nor the standard library has: small helpers on single numbers, and SQL text."""

from __future__ import annotations

import math

#: Chebyshev coefficients of the complementary error function, relative error under 1.2e-7 (fixed values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log_tail_sql(z: str) -> str:
    """SQL for the logarithm of the normal probability above ``z``, for z of 0 and more; exact far out too."""
    u = f"(({z}) / {math.sqrt(2)!r}e0)"
    t = f"(1e0 / (1e0 + 0.5e0 * {u}))"
    series = f"{ERFC[-1]!r}e0"
    for c in reversed(ERFC[:-1]):
        series = f"({c!r}e0 + {t} * {series})"
    return f"(ln({t}) - {u} * {u} + {series} - {math.log(2)!r}e0)"


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def f_tail(f: float, free: int, rest: int) -> float:
    """The probability above ``f`` of Fisher's distribution."""
    return 1.0 if f <= 0 else incomplete_beta(rest / 2, free / 2, rest / (rest + free * f))


def chi_square_tail(x: float, free: int) -> float:
    """The probability above ``x``: the regularised upper incomplete gamma function, by its series or continued fraction."""
    a, x = free / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h
