"""Forward passes and gradients of small forecasting networks, for use inside tasks.

A network is a row of blocks.  Each maps what the blocks before it left of the input
window, with covariates, to coefficients of a backcast, which it takes off the window, and of
a forecast, which it adds to the output.  Spark deals the windows out and adds up what
tasks return (``training``); here are only the steps over one Arrow batch.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

KINDS = ("linear", "generic", "trend", "seasonality")
Params = dict[str, np.ndarray]
Mask = Callable[[int, int, int], np.ndarray]


def basis(kind: str, length: int, degree: int) -> np.ndarray:
    """Rows of polynomials up to ``degree``, or of all Fourier waves that ``length`` steps tell apart."""
    t = np.arange(length) / length
    if kind == "trend":
        return np.stack([t**k for k in range(degree + 1)])
    waves = range(1, length // 2 + 1)
    return np.stack([np.ones(length), *(f(2 * np.pi * k * t) for k in waves for f in (np.cos, np.sin))])


@dataclass(frozen=True)
class BlockNetwork:
    """``stacks`` of kinds linear (no layers, no backcast), generic (learned bases), trend or seasonality (fixed ones).

    ``blocks`` of each stack have ``layers`` rectified layers of ``width`` units with dropout.
    ``from_last`` takes the last input off the window and adds it to the output.
    """

    input_length: int
    output_length: int
    features: int = 0
    static: int = 0
    stacks: tuple[str, ...] = ("generic",)
    blocks: int = 1
    layers: int = 2
    width: int = 32
    expansion: int = 5
    degree: int = 2
    dropout: float = 0.0
    from_last: bool = False

    def __post_init__(self):
        if unknown := set(self.stacks) - set(KINDS):
            raise ValueError(f"unknown stacks {sorted(unknown)}; known are {', '.join(KINDS)}")

    @property
    def kinds(self) -> list[str]:
        return [k for k in self.stacks for _ in range(self.blocks)]

    def bases(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        return basis(kind, self.input_length, self.degree), basis(kind, self.output_length, self.degree)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        d = self.input_length * (1 + self.features) + self.static
        for b, kind in enumerate(self.kinds):
            if kind == "linear":
                out |= {f"{b}.forecast": (d, self.output_length), f"{b}.bias": (self.output_length,)}
                continue
            sizes = [d, *[self.width] * self.layers]
            for k, (m, n) in enumerate(zip(sizes, sizes[1:])):
                out |= {f"{b}.weight{k}": (m, n), f"{b}.bias{k}": (n,)}
            if kind == "generic":
                rows = self.expansion, self.expansion
                out |= {f"{b}.backcast_basis": (self.expansion, self.input_length), f"{b}.forecast_basis": (self.expansion, self.output_length)}
            else:
                rows = tuple(len(x) for x in self.bases(kind))
            out |= {f"{b}.backcast": (sizes[-1], rows[0]), f"{b}.forecast": (sizes[-1], rows[1])}
        return out

    def init(self, seed: int) -> Params:
        """Seeded uniform weights of the usual spread (one over the root of the inputs); linear blocks start at 0."""
        rng = np.random.default_rng(seed)
        zero = {f"{b}.{n}" for b, k in enumerate(self.kinds) if k == "linear" for n in ("forecast", "bias")}
        return {k: np.zeros(s) if k in zero else rng.uniform(-1, 1, s) / math.sqrt(s[0]) for k, s in self.shapes().items()}

    def forward(self, params: Params, x: np.ndarray, more: np.ndarray, mask: Mask | None = None) -> tuple[np.ndarray, list]:
        """Outputs for rows of windows and covariates, and what ``backward`` needs."""
        last = x[:, -1:] if self.from_last else np.zeros((len(x), 1))
        left, y, tape = x - last, np.zeros((len(x), self.output_length)), []
        for b, kind in enumerate(self.kinds):
            h = np.hstack((left, more))
            if kind == "linear":
                tape.append((h,))
                y = y + h @ params[f"{b}.forecast"] + params[f"{b}.bias"]
                continue
            acts, kept = [h], []
            for k in range(self.layers):
                h = np.maximum(h @ params[f"{b}.weight{k}"] + params[f"{b}.bias{k}"], 0)
                kept.append(mask(b, k, self.width) if mask and self.dropout else 1.0)
                h = h * kept[-1]
                acts.append(h)
            back, fore = (params[f"{b}.backcast_basis"], params[f"{b}.forecast_basis"]) if kind == "generic" else self.bases(kind)
            tb, tf = h @ params[f"{b}.backcast"], h @ params[f"{b}.forecast"]
            left, y = left - tb @ back, y + tf @ fore
            tape.append((acts, kept, tb, tf, back, fore))
        return y + last, tape

    def backward(self, params: Params, tape: list, dy: np.ndarray) -> Params:
        """Sums over rows of the derivatives by each parameter, given those by the outputs."""
        grads: Params = {}
        dleft = np.zeros((len(dy), self.input_length))
        for b in range(len(tape) - 1, -1, -1):
            if len(tape[b]) == 1:
                (h,) = tape[b]
                grads |= {f"{b}.forecast": h.T @ dy, f"{b}.bias": dy.sum(axis=0)}
                dleft = dleft + (dy @ params[f"{b}.forecast"].T)[:, : self.input_length]
                continue
            acts, kept, tb, tf, back, fore = tape[b]
            if f"{b}.backcast_basis" in params:
                grads |= {f"{b}.backcast_basis": tb.T @ -dleft, f"{b}.forecast_basis": tf.T @ dy}
            dtb, dtf = -dleft @ back.T, dy @ fore.T
            grads |= {f"{b}.backcast": acts[-1].T @ dtb, f"{b}.forecast": acts[-1].T @ dtf}
            dh = dtb @ params[f"{b}.backcast"].T + dtf @ params[f"{b}.forecast"].T
            for k in range(self.layers - 1, -1, -1):
                dh = dh * kept[k] * (acts[k + 1] > 0)
                grads |= {f"{b}.weight{k}": acts[k].T @ dh, f"{b}.bias{k}": dh.sum(axis=0)}
                dh = dh @ params[f"{b}.weight{k}"].T
            dleft = dleft + dh[:, : self.input_length]
        return grads


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def dropout(keys: np.ndarray, salt: int, rate: float) -> Mask:
    """Masks by hashes of (row key, salt, block, layer, unit): equal wherever and whenever a row is computed."""
    row = mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([salt + 1], np.uint64)))

    def mask(block: int, layer: int, width: int) -> np.ndarray:
        unit = np.arange(1, width + 1, dtype=np.uint64) + np.uint64((block * 256 + layer + 1) << 24)
        draw = mix(row[:, None] + unit[None, :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        return (draw * 2.0**-53 >= rate) / (1 - rate)

    return mask


def _huber(e, delta):
    a = np.abs(e)
    return np.where(a <= delta, 0.5 * e * e, delta * (a - 0.5 * delta)), np.clip(e, -delta, delta)


def _sigmoid(x):
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1, small) / (1 + small)


def _penalty(event, predicted, false_positive, false_negative):
    return np.where(~event & predicted, false_positive, np.where(event & ~predicted, false_negative, 1.0))


def _weighted_huber(p, y, left, zero_threshold, delta, non_zero_weight):
    v, s = _huber(p - y, delta)
    w = np.where(np.abs(y) > zero_threshold, non_zero_weight, 1.0)
    return w * v, w * s


def _weighted_penalty_huber(p, y, left, zero_threshold, delta, non_zero_weight, false_positive_weight, false_negative_weight):
    v, s = _weighted_huber(p, y, left, zero_threshold, delta, non_zero_weight)
    w = _penalty(np.abs(y) > zero_threshold, np.abs(p) > zero_threshold, false_positive_weight, false_negative_weight)
    return w * v, w * s


def _time_aware(p, y, left, zero_weight, non_zero_weight, decay_factor, delta):
    v, s = _huber(p - y, delta)
    w = np.where(np.abs(y) > 1e-4, non_zero_weight, zero_weight) * decay_factor**left
    return w * v, w * s


def _spike_focal(p, y, left, alpha, gamma, spike_threshold):
    e = p - y
    near, spike = np.exp(-np.abs(e)), y > spike_threshold
    far = np.maximum(1 - near, 1e-300)
    w = np.where(spike, alpha * far**gamma, (1 - alpha) * near**gamma)
    dw = np.sign(e) * gamma * np.where(spike, alpha * far ** (gamma - 1) * near, -(1 - alpha) * near**gamma)
    return w * e * e, dw * e * e + 2 * w * e


def _tweedie(p, y, left, power, non_zero_weight, zero_threshold, false_positive_weight=1.0, false_negative_weight=1.0, eps=1e-8):
    mu, y = np.maximum(p, 0) + np.log1p(np.exp(-np.abs(p))) + eps, np.maximum(y, 0)
    w = np.where(y > zero_threshold, non_zero_weight, 1.0) * _penalty(y > zero_threshold, mu > zero_threshold, false_positive_weight, false_negative_weight)
    return w * (mu ** (2 - power) / (2 - power) - y * mu ** (1 - power) / (1 - power)), w * (mu ** (1 - power) - y * mu**-power) * _sigmoid(p)


def _asymmetric_quantile(p, y, left, tau, non_zero_weight, zero_threshold):
    w, d = np.where(np.abs(y) > zero_threshold, non_zero_weight, 1.0), y - p
    return w * np.where(d >= 0, tau * d, (tau - 1) * d), w * np.where(d >= 0, -tau, 1 - tau)


def _zero_inflated(p, y, left, zero_weight, count_weight, delta, zero_threshold, eps=1e-8):
    raw, zero, e = _sigmoid(-10 * p), np.abs(y) < zero_threshold, p - y
    chance, inside = np.clip(raw, eps, 1 - eps), (raw > eps) & (raw < 1 - eps)
    root = np.sqrt(1 + (e / delta) ** 2)
    value = zero_weight * np.where(zero, -np.log(chance), -np.log(1 - chance)) + count_weight * np.where(zero, 0.0, delta**2 * (root - 1))
    return value, zero_weight * inside * np.where(zero, 10 * (1 - raw), -10 * raw) + count_weight * np.where(zero, 0.0, e / root)


def _shrinkage(p, y, left, a, c):
    e = p - y
    g = _sigmoid(a * (np.abs(e) - c))
    return e * e * g, 2 * e * g + e * e * g * (1 - g) * a * np.sign(e)


def _charbonnier(p, y, left, eps=1e-8):
    root = np.sqrt((p - y) ** 2 + eps)
    return root - eps**0.5, (p - y) / root


def _smooth_l1(p, y, left, beta=1.0):
    v, s = _huber(p - y, beta)
    return v / beta, s / beta


#: Cell losses and their derivatives by the prediction, by the names that manifests use; ``left`` counts the steps to the last.
SLOPES: dict[str, Callable] = {
    "WeightedHuberLoss": _weighted_huber,
    "WeightedPenaltyHuberLoss": _weighted_penalty_huber,
    "TimeAwareWeightedHuberLoss": _time_aware,
    "SpikeFocalLoss": _spike_focal,
    "TweedieLoss": _tweedie,
    "AsymmetricQuantileLoss": _asymmetric_quantile,
    "ZeroInflatedLoss": _zero_inflated,
    "ShrinkageLoss": _shrinkage,
    "CharbonnierLoss": _charbonnier,
    "MSELoss": lambda p, y, left: ((p - y) ** 2, 2 * (p - y)),
    "L1Loss": lambda p, y, left: (np.abs(p - y), np.sign(p - y)),
    "HuberLoss": lambda p, y, left, delta=1.0: _huber(p - y, delta),
    "SmoothL1Loss": _smooth_l1,
    "PoissonNLLLoss": lambda p, y, left: (np.exp(p) - y * p, np.exp(p) - y),
}
