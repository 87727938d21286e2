"""Losses, derivatives and links as Column expressions; they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Predictions of count models are kept within exp's safe range.
COUNT_BOUND = 44.0
#: Keeps the logarithm of a count of zero finite.
COUNT_FLOOR = 1e-6


def squared(p: Column, y: Column, low: Column | float, high: Column | float) -> Column:
    """Quadratic inside [low, high]; beyond it as steep as at the bound, if the label is on the far side."""
    low, high = _col(low), _col(high)

    def beyond(bound: Column, over: Column) -> Column:
        gap = y - bound
        return gap * gap + 2 * F.abs(gap) * over

    plain = (p - y) * (p - y)
    return F.when((p < low) & (y > low), beyond(low, low - p)).when((p < low) & (y <= low), F.lit(0.0)).when((p > high) & (y < high), beyond(high, p - high)).when((p > high) & (y >= high), F.lit(0.0)).otherwise(plain)


def classic(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def hinge(p: Column, y: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - y * p)


def logistic(p: Column, y: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Labels ``low`` and ``high`` are the classes; one between them is a mixture of both."""
    share = (y - low) / (high - low)
    return share * F.log1p(F.exp(-p)) + (1 - share) * F.log1p(F.exp(p))


def quantile(p: Column, y: Column, tau: float = 0.5) -> Column:
    e = y - p
    return F.when(e > 0, tau * e).otherwise((tau - 1) * e)


def expectile(p: Column, y: Column, q: float = 0.5) -> Column:
    e = y - p
    return e * e * F.when(e > 0, F.lit(q)).otherwise(F.lit(1 - q))


def poisson(p: Column, y: Column) -> Column:
    """Deviance of a count from a prediction of its logarithm."""
    p = F.least(F.greatest(p, F.lit(-COUNT_BOUND)), F.lit(COUNT_BOUND))
    return 2 * (y * (F.log(y + COUNT_FLOOR) - p) - (y - F.exp(p)))


LOSSES: dict[str, Callable[..., Column]] = {"squared": squared, "classic": classic, "hinge": hinge, "logistic": logistic, "quantile": quantile, "pinball": quantile, "absolute": quantile, "expectile": expectile, "poisson": poisson}


def derivative(name: str, p: Column, y: Column, **by: float) -> Column:
    """Of the loss, by the prediction."""
    if name in ("squared", "classic"):
        return 2 * (p - y)
    if name == "hinge":
        return F.when(y * p < 1, -y).otherwise(F.lit(0.0))
    if name == "logistic":
        low, high = by.get("low", -1.0), by.get("high", 1.0)
        return 1 / (1 + F.exp(-p)) - (y - low) / (high - low)
    if name in ("quantile", "pinball", "absolute"):
        tau = by.get("tau", 0.5)
        return F.when(y > p, F.lit(-tau)).when(y < p, F.lit(1 - tau)).otherwise(F.lit(0.0))
    if name == "expectile":
        q = by.get("q", 0.5)
        return 2 * (p - y) * F.when(y > p, F.lit(q)).otherwise(F.lit(1 - q))
    if name == "poisson":
        return 2 * (F.exp(F.least(p, F.lit(COUNT_BOUND))) - y)
    raise ValueError(f"no loss {name}")


def link(name: str, x: Column) -> Column:
    if name == "identity":
        return x
    if name == "logistic":
        return 1 / (1 + F.exp(-x))
    if name == "glf1":
        return 2 / (1 + F.exp(-x)) - 1
    if name == "poisson":
        return F.exp(x)
    raise ValueError(f"no link {name}")


def clamp(p: Column, low: float, high: float) -> Column:
    """A prediction inside its bounds; one that is no number is 0."""
    return F.when(F.isnan(p), F.lit(0.0)).otherwise(F.least(F.greatest(p, F.lit(low)), F.lit(high)))


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
