"""Tail probabilities for test statistics.

Each function takes the few scalars of an already aggregated result; none is applied per row.
The incomplete beta and gamma functions follow their standard series and continued fractions,
which keep tiny p-values that ``1 - cdf`` would round to zero.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_STEPS = 1_000_000
# From these parameters on, expansions around the limit are more exact than series and fractions.
_LARGE_BETA = 1e5
_LARGE_GAMMA = 1e5


def _continued_fraction(first: float, terms) -> float:
    """Modified Lentz evaluation of ``first + a1 / (b1 + a2 / (b2 + ...))``."""
    value = first or _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            return value
    raise ArithmeticError("a continued fraction did not converge")


def _log(x: float, rest: float) -> float:
    """``log(x)`` where ``rest`` is ``1 - x`` in full precision."""
    return math.log(x) if x < 0.5 else math.log1p(-rest)


def beta_regularized(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b). ``rest`` is ``1 - x``; give it where x is close to 1."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    if a > _LARGE_BETA and a > 1e3 * b:
        # With one large parameter, -log(x) times a + (b - 1) / 2 is a gamma variable of shape b.
        n, u = a + (b - 1.0) / 2.0, -_log(x, rest)
        return gamma_upper_regularized(b, n * u) + _beta_correction(b, n, n * u)
    if b > _LARGE_BETA and b > 1e3 * a:
        n, u = b + (a - 1.0) / 2.0, -_log(rest, x)
        return 1.0 - gamma_upper_regularized(a, n * u) - _beta_correction(a, n, n * u)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularized(rest, b, a, x)

    def terms():
        yield 1.0, 1.0
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * _log(x, rest) + b * _log(rest, x)
    )
    return math.exp(log_front) / a * _continued_fraction(0.0, terms())


def _beta_correction(shape: float, n: float, y: float) -> float:
    """The second term of that expansion, of the order ``1 / n**2``."""
    density = math.exp(shape * math.log(y) - y - math.lgamma(shape)) if y > 0 else 0.0
    return density * (1.0 - shape) * (shape + 1.0 + y) / (24.0 * n * n)


def gamma_upper_regularized(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if a > _LARGE_GAMMA:
        return _gamma_upper_large(a, x)
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        for k in range(1, _STEPS):
            term *= x / (a + k)
            total += term
            if term < total * 1e-17:
                return 1.0 - total * math.exp(log_front)
        raise ArithmeticError("a series did not converge")

    def terms():
        yield 1.0, x + 1.0 - a
        for k in range(1, _STEPS):
            yield -k * (k - a), x + 2.0 * k + 1.0 - a

    return math.exp(log_front) * _continued_fraction(0.0, terms())


def _gamma_upper_large(a: float, x: float) -> float:
    """Q(a, x) for large a: the normal tail of a signed root and the first correction to it."""
    off = (x - a) / a
    half = off - math.log1p(off)
    if abs(off) < 1e-4:  # the difference loses digits there; its series does not
        half = off * off * (0.5 - off / 3.0 + off * off / 4.0 - off**3 / 5.0)
    eta = math.copysign(math.sqrt(2.0 * max(half, 0.0)), off)
    if abs(eta) < 1e-2:
        c0 = -1.0 / 3.0 + eta / 12.0 - 2.0 * eta**2 / 135.0 + eta**3 / 864.0
        c1 = -1.0 / 540.0 - eta / 288.0
    else:
        c0 = 1.0 / off - 1.0 / eta
        c1 = 1.0 / eta**3 - 1.0 / off**3 - 1.0 / off**2 - 1.0 / (12.0 * off)
    tail = 0.5 * math.erfc(eta * math.sqrt(a / 2.0))
    return tail + math.exp(-0.5 * a * eta * eta) / math.sqrt(2.0 * math.pi * a) * (c0 + c1 / a)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_regularized(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if f <= 0.0:
        return 1.0
    if math.isinf(f):
        return 0.0
    whole = df2 + df1 * f
    return beta_regularized(df2 / whole, df2 / 2.0, df1 / 2.0, df1 * f / whole)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper_regularized(df / 2.0, x / 2.0)


def t_quantile(confidence: float, df: float) -> float:
    """The t with ``P(|T| <= t) = confidence``, by bisection on the two-sided tail."""
    tail = 1.0 - confidence
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > tail:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * high:
            break
    return (low + high) / 2.0
