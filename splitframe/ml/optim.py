"""Steps, rates and stopping rules for the driver's small weight vectors; the data are summed by Spark."""

from __future__ import annotations

import numpy as np


METHODS = ("adadelta", "adagrad", "adam", "adamw", "adamax", "asgd", "nadam", "radam", "rmsprop", "rprop", "sgd")


class Optimizer:
    """A first-order method with an l1 (soft threshold) or l2 penalty of strength ``alpha``.

    decay: the rates of the running means of gradients and of their squares. Other settings by method:
    ``momentum`` and ``nesterov`` (sgd), ``rho`` (adadelta), ``lr_decay`` (adagrad), ``weight_decay`` (adamw),
    ``lambd``, ``power`` and ``t0`` (asgd), ``momentum_decay`` (nadam), ``etas`` and ``steps`` (rprop).
    """

    def __init__(
        self, method: str = "sgd", lr: float = 0.01, penalty: str | None = None, alpha: float = 0.0, decay: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8,
        momentum: float = 0.0, nesterov: bool = False, rho: float = 0.9, lr_decay: float = 0.0, weight_decay: float = 0.01, lambd: float = 1e-4, power: float = 0.75,
        t0: float = 1e6, momentum_decay: float = 4e-3, etas: tuple[float, float] = (0.5, 1.2), steps: tuple[float, float] = (1e-6, 50.0),
    ):
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
        if penalty not in (None, "l1", "l2"):
            raise ValueError(f"unknown penalty {penalty}")
        self.method, self.lr, self.penalty, self.alpha, self.decay, self.eps = method, lr, penalty, alpha, decay, eps
        self.momentum, self.nesterov, self.rho, self.lr_decay, self.weight_decay = momentum, nesterov, rho, lr_decay, weight_decay
        self.lambd, self.power, self.t0, self.momentum_decay, self.etas, self.bounds = lambd, power, t0, momentum_decay, etas, steps
        self.t = 0
        self.state: dict = {}

    def _mean(self, name: str, value: np.ndarray, share: float) -> np.ndarray:
        """Running mean ``name`` after one more value."""
        self.state[name] = share * self.state.get(name, 0.0) + (1 - share) * value
        return self.state[name]

    def step(self, w: np.ndarray, g: np.ndarray, rate: float = 1.0) -> np.ndarray:
        lr, self.t = self.lr * rate, self.t + 1
        if self.penalty == "l2":
            g = g + self.alpha * w
        w = w - getattr(self, f"_{self.method}")(w, g, lr)
        return np.sign(w) * np.maximum(np.abs(w) - lr * self.alpha, 0.0) if self.penalty == "l1" else w

    # Each gives what is taken from the weights.
    def _sgd(self, w, g, lr):
        if not self.momentum:
            return lr * g
        v = self.state["v"] = self.momentum * self.state["v"] + g if "v" in self.state else g
        return lr * (g + self.momentum * v if self.nesterov else v)

    def _adagrad(self, w, g, lr):
        self.state["sum"] = self.state.get("sum", 0.0) + g * g
        return lr / (1 + (self.t - 1) * self.lr_decay) * g / (np.sqrt(self.state["sum"]) + self.eps)

    def _rmsprop(self, w, g, lr):
        return lr * g / (np.sqrt(self._mean("square", g * g, self.decay[1])) + self.eps)

    def _adadelta(self, w, g, lr):
        square = self._mean("square", g * g, self.rho)
        move = np.sqrt(self.state.get("moves", 0.0) + self.eps) / np.sqrt(square + self.eps) * g
        self._mean("moves", move * move, self.rho)
        return lr * move

    def _moments(self, g):
        """Running means of gradients and squares, and what is left of each mean's start at 0."""
        a, b = self.decay
        return self._mean("mean", g, a), self._mean("square", g * g, b), 1 - a**self.t, 1 - b**self.t

    def _adam(self, w, g, lr):
        m, v, a, b = self._moments(g)
        return lr * (m / a) / (np.sqrt(v / b) + self.eps)

    def _adamw(self, w, g, lr):
        return lr * self.weight_decay * w + self._adam(w, g, lr)

    def _adamax(self, w, g, lr):
        m = self._mean("mean", g, self.decay[0])
        self.state["most"] = np.maximum(self.decay[1] * self.state.get("most", 0.0), np.abs(g) + self.eps)
        return lr / (1 - self.decay[0] ** self.t) * m / self.state["most"]

    def _nadam(self, w, g, lr):
        m, v, _, b = self._moments(g)
        mu, after = (self.decay[0] * (1 - 0.5 * 0.96 ** (t * self.momentum_decay)) for t in (self.t, self.t + 1))
        product = self.state["product"] = self.state.get("product", 1.0) * mu
        below = np.sqrt(v / b) + self.eps
        return lr * ((1 - mu) / (1 - product) * g + after / (1 - product * after) * m) / below

    def _radam(self, w, g, lr):
        m, v, a, b = self._moments(g)
        longest = 2 / (1 - self.decay[1]) - 1
        now = longest - 2 * self.t * self.decay[1] ** self.t / b
        if now <= 5:
            return lr * m / a
        rectified = np.sqrt((now - 4) * (now - 2) * longest / ((longest - 4) * (longest - 2) * now))
        return lr * (m / a) * rectified * np.sqrt(b) / (np.sqrt(v) + self.eps)

    def _asgd(self, w, g, lr):
        eta = self.state.get("eta", lr)
        new = w * (1 - self.lambd * eta) - eta * g
        share = 1 / max(1.0, self.t - self.t0)
        self.average = self.state["average"] = self.state.get("average", 0.0) * (1 - share) + share * new
        self.state["eta"] = lr / (1 + self.lambd * lr * self.t) ** self.power
        return w - new

    def _rprop(self, w, g, lr):
        turn = np.sign(g * self.state.get("before", 0.0))
        size = self.state.get("size", np.full_like(w, lr)) * np.where(turn > 0, self.etas[1], np.where(turn < 0, self.etas[0], 1.0))
        self.state["size"] = np.clip(size, *self.bounds)
        self.state["before"] = np.where(turn < 0, 0.0, g)
        return np.sign(self.state["before"]) * self.state["size"]


def start_weights(features: int, method: str = "zeros", fit_intercept: bool = True, fill: float = 0.0, seed: int | None = None) -> np.ndarray:
    """Weights to start from (the intercept last): zeros, ones, consts (``fill``), random (normal) or random_uniform from 0 to 1."""
    n = features + int(fit_intercept)
    random = np.random.default_rng(seed)
    made = {"zeros": lambda: np.zeros(n), "ones": lambda: np.ones(n), "consts": lambda: np.full(n, float(fill)), "random": lambda: random.normal(size=n), "random_uniform": lambda: random.random(n)}
    if method not in made:
        raise ValueError(f"unknown method {method}")
    return made[method]()


def rate(schedule: str, epoch: int, start: float = 1.0, end: float = 1.0, epochs: int = 1, every: int = 1, factor: float = 0.1) -> float:
    """What multiplies the learning rate in an epoch: constant, step or linear."""
    if schedule == "constant":
        return start
    if schedule == "step":
        return factor ** (epoch // every)
    if schedule == "linear":
        return start + (end - start) * min(epoch, epochs) / max(epochs, 1)
    raise ValueError(f"unknown schedule {schedule}")


def converged(rule: str, tol: float, loss: float, last: float | None, w: np.ndarray, before: np.ndarray) -> bool:
    """diff: the loss moved by less than ``tol``; abs: it is below ``tol``; weight_diff: the weights moved by less."""
    if rule == "diff":
        return last is not None and abs(loss - last) < tol
    if rule == "abs":
        return abs(loss) < tol
    if rule == "weight_diff":
        return float(np.linalg.norm(w - before)) < tol
    raise ValueError(f"unknown rule {rule}")
