"""Error functions of (prediction, truth) columns.

Each takes the two columns and its parameters by name and returns the terms whose
means, added up, are the loss: most have one.  Thresholds are strict on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapanel.functions.elementary import clamp, sigmoid, softplus


def huber(e: Column, delta: float) -> Column:
    a = F.abs(e)
    return F.when(a <= delta, 0.5 * e * e).otherwise(delta * (a - 0.5 * delta))


def pseudo_huber(e: Column, delta: float) -> Column:
    return delta**2 * (F.sqrt(1 + (e / delta) * (e / delta)) - 1)


def _event_weight(y: Column, threshold: float, weight: float, rest: float = 1.0) -> Column:
    return F.when(F.abs(y) > threshold, float(weight)).otherwise(float(rest))


def _penalty(is_event: Column, is_predicted: Column, false_positive: float, false_negative: float) -> Column:
    return F.when(~is_event & is_predicted, float(false_positive)).when(is_event & ~is_predicted, float(false_negative)).otherwise(1.0)


def weighted_huber(p: Column, y: Column, zero_threshold: float, delta: float, non_zero_weight: float) -> list[Column]:
    return [_event_weight(y, zero_threshold, non_zero_weight) * huber(p - y, delta)]


def weighted_penalty_huber(p: Column, y: Column, zero_threshold: float, delta: float, non_zero_weight: float, false_positive_weight: float, false_negative_weight: float) -> list[Column]:
    penalty = _penalty(F.abs(y) > zero_threshold, F.abs(p) > zero_threshold, false_positive_weight, false_negative_weight)
    return [_event_weight(y, zero_threshold, non_zero_weight) * penalty * huber(p - y, delta)]


def time_aware_weighted_huber(p: Column, y: Column, steps_left: Column, zero_weight: float, non_zero_weight: float, decay_factor: float, delta: float) -> list[Column]:
    """``steps_left``: 0 at the last step, whose weight doesn't decay."""
    return [_event_weight(y, 1e-4, non_zero_weight, zero_weight) * F.pow(F.lit(float(decay_factor)), steps_left) * huber(p - y, delta)]


def spike_focal(p: Column, y: Column, alpha: float, gamma: float, spike_threshold: float) -> list[Column]:
    e = p - y
    near = F.exp(-F.abs(e))
    weight = F.when(y > spike_threshold, alpha * F.pow(1 - near, F.lit(float(gamma)))).otherwise((1 - alpha) * F.pow(near, F.lit(float(gamma))))
    return [weight * e * e]


def tweedie(p: Column, y: Column, power: float, non_zero_weight: float, zero_threshold: float, false_positive_weight: float = 1.0, false_negative_weight: float = 1.0, eps: float = 1e-8) -> list[Column]:
    """Deviance terms for 1 < power < 2, with a softplus link."""
    if not 1 < power < 2:
        raise ValueError("the power must lie between 1 and 2")
    mu, y = softplus(p) + eps, F.greatest(y, F.lit(0.0))
    terms = F.pow(mu, F.lit(2 - power)) / (2 - power) - y * F.pow(mu, F.lit(1 - power)) / (1 - power)
    event, predicted = y > zero_threshold, mu > zero_threshold
    return [F.when(event, float(non_zero_weight)).otherwise(1.0) * _penalty(event, predicted, false_positive_weight, false_negative_weight) * terms]


def asymmetric_quantile(p: Column, y: Column, tau: float, non_zero_weight: float, zero_threshold: float) -> list[Column]:
    if not 0 < tau < 1:
        raise ValueError("tau must lie between 0 and 1")
    d = y - p
    return [_event_weight(y, zero_threshold, non_zero_weight) * F.when(d >= 0, tau * d).otherwise((tau - 1) * d)]


def zero_inflated(p: Column, y: Column, zero_weight: float, count_weight: float, delta: float, zero_threshold: float, eps: float = 1e-8) -> list[Column]:
    """Cross-entropy of being zero, and a count term on nonzero cells that is averaged over all."""
    chance = clamp(sigmoid(-10 * p), eps, 1 - eps)
    is_zero = F.abs(y) < zero_threshold
    entropy = F.when(is_zero, -F.log(chance)).otherwise(-F.log(1 - chance))
    return [zero_weight * entropy, count_weight * F.when(is_zero, 0.0).otherwise(pseudo_huber(p - y, delta))]


def shrinkage(p: Column, y: Column, a: float, c: float) -> list[Column]:
    e = p - y
    return [e * e * sigmoid(a * (F.abs(e) - c))]


def charbonnier(p: Column, y: Column, eps: float = 1e-8) -> list[Column]:
    return [F.sqrt((p - y) * (p - y) + eps) - eps**0.5]


def mse(p: Column, y: Column) -> list[Column]:
    return [(p - y) * (p - y)]


def l1(p: Column, y: Column) -> list[Column]:
    return [F.abs(p - y)]


def plain_huber(p: Column, y: Column, delta: float = 1.0) -> list[Column]:
    return [huber(p - y, delta)]


def smooth_l1(p: Column, y: Column, beta: float = 1.0) -> list[Column]:
    return [huber(p - y, beta) / beta]


def poisson_nll(p: Column, y: Column) -> list[Column]:
    """``p`` is the log of the rate."""
    return [F.exp(p) - y * p]


#: Losses that are means of cell terms, by the names that manifests use.
CELLWISE: dict[str, Callable[..., list[Column]]] = {
    "WeightedHuberLoss": weighted_huber,
    "WeightedPenaltyHuberLoss": weighted_penalty_huber,
    "SpikeFocalLoss": spike_focal,
    "TweedieLoss": lambda p, y, p_=None, **kw: tweedie(p, y, kw.pop("power", p_), **kw),
    "AsymmetricQuantileLoss": asymmetric_quantile,
    "ZeroInflatedLoss": zero_inflated,
    "ShrinkageLoss": shrinkage,
    "CharbonnierLoss": charbonnier,
    "MSELoss": mse,
    "L1Loss": l1,
    "HuberLoss": plain_huber,
    "SmoothL1Loss": smooth_l1,
    "PoissonNLLLoss": poisson_nll,
}


def cell_loss(name: str, prediction: Column, truth: Column, **parameters) -> Column:
    """The cell term of a loss (the sum of its terms): its mean is the loss."""
    if name not in CELLWISE:
        raise ValueError(f"{name!r} is none of {', '.join(CELLWISE)}")
    terms = CELLWISE[name](prediction, truth, **parameters)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out
