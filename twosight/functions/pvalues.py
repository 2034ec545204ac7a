"""Two-sided p-values of finished test rows, as column expressions.

Spark has no error, gamma or beta function, so the tails are integrals by double-exponential quadrature: some two hundred
terms per row, after every aggregation, never on the data. The scalar functions compute the same by continued fractions
and series; the tests hold the two against each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twosight.functions.nulls import col

_TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    def guard(v: float) -> float:
        return v if abs(v) > _TINY else _TINY

    num, den = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    total = den
    for m in range(1, 20000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            den = 1.0 / guard(1.0 + term * den)
            num = guard(1.0 + term / num)
            step = num * den
            total *= step
        if abs(step - 1.0) < 1e-15:
            return total
    raise ArithmeticError(f"the continued fraction of I_{x}({a}, {b}) did not converge")


def _gamma_step(a: float, b: float) -> float:
    """log gamma(a + b) - log gamma(a). For b = 1/2 and large a by its asymptotic series: the difference of two
    large logarithms would lose digits."""
    if b == 0.5 and a > 100.0:
        return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)
    return math.lgamma(a + b) - math.lgamma(a)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = _gamma_step(a, b) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    if dof > 1e8 and t * t < 1e-3 * dof:
        # Normal with two correction terms; what is left out is of order 1 / dof^2.
        shrunk = t * (1 - (t * t + 1) / (4 * dof))
        return normal_two_sided(shrunk)
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def _gamma_upper_large(a: float, y: float) -> float:
    """Q(a, y) for large a by the uniform expansion around the normal; what is left out is of order a^(-3/2) / 100."""
    mu = y / a - 1.0
    half = mu * mu * (0.5 - mu * (1 / 3 - mu * (0.25 - mu / 5))) if abs(mu) < 1e-3 else mu - math.log1p(mu)
    eta = math.copysign(math.sqrt(2.0 * half), mu)
    first = -1 / 3 + eta / 12 - 2 * eta * eta / 135 if abs(eta) < 1e-2 else 1 / mu - 1 / eta
    return 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + math.exp(-a * half) / math.sqrt(2.0 * math.pi * a) * first


def chi2_upper(x: float, dof: float) -> float:
    """Upper tail of chi-square: regularised upper incomplete gamma Q(dof/2, x/2)."""
    if x <= 0.0:
        return 1.0
    a, y = dof / 2.0, x / 2.0
    if a > 1e5:
        return _gamma_upper_large(a, y)
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= y / k
            total += term
        return 1.0 - total * front
    b = y + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * h
    raise ArithmeticError(f"the continued fraction of Q({a}, {y}) did not converge")


#: Double-exponential quadrature: nodes k * STEP for k from -NODES to NODES.
STEP, NODES = 1 / 32, 128


def _integral(low: Column, high: Column, f: Callable[[Column], Column]) -> Column:
    """The integral of f from low to high. Nodes crowd at both ends, so neither a peak there nor a singularity matters."""
    def node(k: Column) -> Column:
        u = k * F.lit(STEP)
        bend = F.exp(F.lit(math.pi) * F.sinh(u))
        return F.struct((1 / (1 + bend)).alias("q"), (STEP * math.pi * F.cosh(u) / (2 + bend + 1 / bend)).alias("w"))

    nodes = F.transform(F.sequence(F.lit(-NODES), F.lit(NODES)), node)
    return (high - low) * F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["w"] * f(low + (high - low) * n["q"]))


def p_student(t: Column | str, dof: Column | str) -> Column:
    """Two-sided tail of Student's t: with t = sqrt(dof) / tan(angle) its density is sin(angle)^(dof - 1).

    For very many degrees of freedom it is the normal tail with two correction terms; what is left out is of order 1 / dof^2.
    """
    size, v = F.abs(col(t).cast("double")), col(dof).cast("double")
    cut = F.atan2(F.sqrt(v), size)
    sine = lambda x: F.when(x < 0.75, F.log(F.sin(x))).otherwise(F.log1p(-F.cos(x) * F.cos(x)) / 2)
    tail = _integral(F.lit(0.0), cut, lambda x: F.exp((v - 1) * (sine(x) - sine(cut))))
    body = _integral(cut, F.lit(math.pi / 2), lambda x: F.exp((v - 1) * sine(x)))
    tail = tail * F.exp((v - 1) * sine(cut))
    near = p_normal(size * (1 - (size * size + 1) / (4 * v)))
    many = (v > 1e6) & (size * size < 1e-3 * v)
    return F.when(size == float("inf"), 0.0).when(many, near).when(v > 0, tail / (tail + body))


def p_chi2(x: Column | str, dof: Column | str) -> Column:
    """Upper tail of chi-square: the gamma density above x / 2 over that of both sides, each scaled by its own peak."""
    y, a = col(x).cast("double") / 2, col(dof).cast("double") / 2
    reach = 9 * F.sqrt(2 * a) + 40
    log = lambda v: (a - 1) * F.log(v / y) - (v - y)
    below, above = F.least(y, F.greatest(a - 1, F.lit(1.0))), F.greatest(y, a - 1)
    high = F.least(y, a + reach)
    low = F.least(F.greatest(a - 1 - reach, F.lit(0.0)), high)
    body = _integral(low, high, lambda v: F.exp(log(v) - log(below)))
    tail = _integral(y, F.greatest(y, a) + reach, lambda v: F.exp(log(v) - log(above)))
    p = 1 / (1 + body / tail * F.exp(log(below) - log(above)))
    return F.when(a.isNull() | y.isNull(), None).when(y <= 0, 1.0).when(y == float("inf"), 0.0).when(a > 0, p)


def p_normal(z: Column | str) -> Column:
    """Two-sided tail of the normal distribution: that of chi-square with one degree of freedom."""
    value = col(z).cast("double")
    return p_chi2(value * value, F.lit(1.0))
