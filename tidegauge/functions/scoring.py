"""Closed-form maps on probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are kept this far from 0 and 1 before a logit.
LOGIT_EPS = 1e-6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def logit(p: Column | str) -> Column:
    q = clip(p, LOGIT_EPS, 1 - LOGIT_EPS)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column | str, a: float, b: float) -> Column:
    return sigmoid(F.lit(float(a)) * logit(p) + F.lit(float(b)))


def edges_at_or_below(value: Column | str, edges: Sequence[float]) -> Column:
    """How many of the ascending literal edges are <= value. Edges decide by comparison, so no rounding surprises.

    Evenly spaced edges take constant time: arithmetic says which edges can be next to the value, and the four around
    are compared. Others are compared one by one.
    """
    v, es = _col(value), [float(e) for e in edges]
    known = F.array(*[F.lit(e) for e in es])
    n, step = len(es), (es[-1] - es[0]) / max(len(es) - 1, 1)
    if n < 6 or step <= 0 or any(abs(e - (es[0] + i * step)) > step / 4 for i, e in enumerate(es)):
        return F.size(F.filter(known, lambda e: e <= v))
    guess = F.floor((F.greatest(F.least(v, F.lit(es[-1] + step)), F.lit(es[0] - step)) - F.lit(es[0])) / F.lit(step)).cast("int")
    low = F.greatest(guess - 1, F.lit(0))
    out = low
    for i in range(1, 5):
        out = out + F.when(low + i <= n, (F.element_at(known, F.least(low + i, F.lit(n))) <= v).cast("int")).otherwise(0)
    return out


def interpolate(value: Column | str, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear map through fixed knots, constant outside them."""
    v = _col(value)
    if len(xs) != len(ys) or not xs:
        raise ValueError("need as many y as x, and at least one knot")
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        x0, x1, y0, y1 = float(xs[i - 1]), float(xs[i]), float(ys[i - 1]), float(ys[i])
        line = F.lit(y0) + (v - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1)
        out = F.when(v < F.lit(x1), line).otherwise(out)
    out = F.when(v <= F.lit(float(xs[0])), F.lit(float(ys[0]))).otherwise(out)
    return F.when(v.isNotNull(), out)
