"""Small neural networks in NumPy: a multi-layer perceptron, recurrent cells trained through time, their optimisers, loss
criteria and schedules of the learning rate; and least squares as a baseline."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

ACTIVATIONS = {
    None: (lambda z: z, lambda a: np.ones_like(a)),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50))), lambda a: a * (1 - a)),
}
OPTIMISERS = ("sgd", "adam", "adamax")
#: Criteria: the mean loss of an error (prediction less target) and its slope.
CRITERIA = {
    "mse": (lambda e: float(np.mean(e * e)), lambda e: 2 * e / e.size),
    "mae": (lambda e: float(np.mean(np.abs(e))), lambda e: np.sign(e) / e.size),
    "huber": (lambda e: float(np.mean(np.where(np.abs(e) <= 1, 0.5 * e * e, np.abs(e) - 0.5))), lambda e: np.clip(e, -1, 1) / e.size),
}
SCHEDULES = ("exponential", "step", "cosine")


def scheduled(lr: float, schedule: Sequence, epoch: int) -> float:
    """The learning rate at an epoch: ("exponential", factor), ("step", epochs, factor), ("cosine", epochs, least) or () for lr."""
    if not schedule:
        return lr
    kind, *args = schedule
    if kind not in SCHEDULES:
        raise ValueError(f"unknown schedule {kind!r}")
    if kind == "exponential":
        return lr * args[0] ** epoch
    if kind == "step":
        return lr * args[1] ** (epoch // args[0])
    return args[1] + (lr - args[1]) * (1 + np.cos(np.pi * min(epoch, args[0]) / args[0])) / 2


class Optimiser:
    """Gradient descent, Adam or Adamax over a list of arrays, which step changes in place."""

    def __init__(self, kind: str, parameters: Sequence[np.ndarray]):
        if kind not in OPTIMISERS:
            raise ValueError(f"unknown optimiser {kind!r}")
        self.kind, self.steps = kind, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def step(self, parameters: Sequence[np.ndarray], gradients: Sequence[np.ndarray], lr: float) -> None:
        self.steps += 1
        for k, (p, g) in enumerate(zip(parameters, gradients, strict=True)):
            p -= self._change(k, g, lr)

    def _change(self, k: int, g: np.ndarray, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> np.ndarray:
        if self.kind == "sgd":
            return lr * g
        self.first[k] = b1 * self.first[k] + (1 - b1) * g
        mean = self.first[k] / (1 - b1**self.steps)
        if self.kind == "adamax":
            self.second[k] = np.maximum(b2 * self.second[k], np.abs(g) + eps)
            return lr * mean / self.second[k]
        self.second[k] = b2 * self.second[k] + (1 - b2) * g * g
        return lr * mean / (np.sqrt(self.second[k] / (1 - b2**self.steps)) + eps)


@dataclass
class Perceptron:
    """Layers of dropout, linear map and activation, the last one included. A step trains on one batch."""

    n_in: int
    n_out: int = 1
    layers: Sequence[int] = ()
    activation: str | None = None
    drop: float = 0.0
    bias: bool = True
    lr: float = 1e-3
    optimiser: str = "adam"
    seed: int = 0
    decay: float = 1.0  # the learning rate's factor after each epoch
    criterion: str = "mse"
    schedule: Sequence = ()
    epoch: int = 0
    w: list[np.ndarray] = field(default_factory=list)
    b: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if self.activation not in ACTIVATIONS or self.criterion not in CRITERIA:
            raise ValueError(f"unknown activation {self.activation!r} or criterion {self.criterion!r}")
        self.rng = np.random.default_rng(self.seed)
        if not self.w:
            sizes = [self.n_in, *self.layers, self.n_out]
            for i, o in zip(sizes, sizes[1:], strict=False):
                k = 1 / np.sqrt(i)
                self.w.append(self.rng.uniform(-k, k, (i, o)))
                self.b.append(self.rng.uniform(-k, k, o) if self.bias else np.zeros(o))
        self.state = Optimiser(self.optimiser, (*self.w, *self.b))

    @property
    def steps(self) -> int:
        """Steps that the optimiser has taken."""
        return self.state.steps

    def _forward(self, x: np.ndarray, train: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        act, _ = ACTIVATIONS[self.activation]
        ins, outs, a = [], [], x
        for w, b in zip(self.w, self.b, strict=True):
            if train and self.drop:
                a = a * (self.rng.random(a.shape) >= self.drop) / (1 - self.drop)
            ins.append(a)
            a = act(a @ w + b)
            outs.append(a)
        return ins, outs

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(np.asarray(x, float), False)[1][-1]

    def train_on(self, x: np.ndarray, y: np.ndarray) -> float:
        """One step of the optimiser; the loss before it."""
        x, y = np.asarray(x, float), np.asarray(y, float).reshape(len(x), -1)
        _, slope = ACTIVATIONS[self.activation]
        ins, outs = self._forward(x, True)
        error = outs[-1] - y
        loss, grad = (f(error) for f in CRITERIA[self.criterion])
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            grad = grad * slope(outs[i])
            gw.insert(0, ins[i].T @ grad)
            gb.insert(0, grad.sum(axis=0) if self.bias else np.zeros_like(self.b[i]))
            grad = grad @ self.w[i].T
        self.state.step((*self.w, *self.b), (*gw, *gb), scheduled(self.lr, self.schedule, self.epoch))
        return loss

    def fit(self, x: np.ndarray, y: np.ndarray, batch_size: int = 64, epochs: int = 1, shuffle: bool = True) -> list[float]:
        """The mean loss of each epoch of mini-batches."""
        losses = []
        for _ in range(epochs):
            order = self.rng.permutation(len(x)) if shuffle else np.arange(len(x))
            parts = [order[i : i + batch_size] for i in range(0, len(x), batch_size)]
            losses.append(float(np.mean([self.train_on(x[p], y[p]) for p in parts])))
            self.lr *= self.decay
            self.epoch += 1
        return losses

    def to_json(self, optimiser_state: bool = False) -> str:
        """Weights, settings and, if asked for, the optimiser's state, for any sink that takes a string."""
        keep = {k: getattr(self, k) for k in ("n_in", "n_out", "activation", "drop", "bias", "lr", "optimiser", "seed", "decay", "criterion", "epoch")}
        keep |= {"layers": list(self.layers), "schedule": list(self.schedule), "w": [v.tolist() for v in self.w], "b": [v.tolist() for v in self.b]}
        if optimiser_state:
            keep["state"] = [self.state.steps, [v.tolist() for v in self.state.first], [v.tolist() for v in self.state.second]]
        return json.dumps(keep)

    @classmethod
    def from_json(cls, text: str) -> Perceptron:
        got = json.loads(text)
        state = got.pop("state", None)
        got["w"], got["b"] = [np.array(v) for v in got["w"]], [np.array(v) for v in got["b"]]
        out = cls(**got)
        if state:
            out.state.steps, first, second = state
            out.state.first, out.state.second = [np.array(v) for v in first], [np.array(v) for v in second]
        return out


class _Cell:
    """Weights from (input, hidden) to each gate, and the output map."""

    gates: tuple[str, ...] = ()

    def __init__(self, n_in: int, n_out: int, n_hidden: int, seed: int = 0, forward: str | None = "tanh", output: str | None = None):
        rng, k = np.random.default_rng(seed), 1 / np.sqrt(n_hidden)
        draw = lambda *s: rng.uniform(-k, k, s)
        self.n_in, self.n_hidden = n_in, n_hidden
        (self.f, self.f_slope), (self.g, self.g_slope) = ACTIVATIONS[forward], ACTIVATIONS[output]
        self.w = {g: (draw(n_in + n_hidden, n_hidden), draw(n_hidden)) for g in self.gates}
        self.out = (draw(n_hidden, n_out), draw(n_out))

    def _gate(self, name: str, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, b = self.w[name]
        return np.concatenate([x, h], axis=1) @ w + b

    def start(self, rows: int) -> tuple[np.ndarray, ...]:
        return (np.zeros((rows, self.n_hidden)),)

    def output(self, h: np.ndarray) -> np.ndarray:
        return self.g(h @ self.out[0] + self.out[1])

    def parameters(self) -> list[np.ndarray]:
        return [a for g in self.gates for a in self.w[g]] + list(self.out)

    def _back_gate(self, name: str, x: np.ndarray, h: np.ndarray, slope: np.ndarray, into: dict) -> np.ndarray:
        """Adds the gradient of a gate's weights, given that of its sum, and returns that of h."""
        both = np.concatenate([x, h], axis=1)
        into[name][0] += both.T @ slope
        into[name][1] += slope.sum(axis=0)
        return slope @ self.w[name][0][self.n_in :].T


_sigmoid = ACTIVATIONS["sigmoid"][0]


class RecurrentCell(_Cell):
    gates = ("h",)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The output and the next hidden state."""
        h = self.f(self._gate("h", x, h))
        return self.output(h), h

    def back(self, x: np.ndarray, before: tuple, after: tuple, slopes: tuple, into: dict) -> tuple[np.ndarray, ...]:
        """The gradients of the state before a step, given those of the state after it."""
        return (self._back_gate("h", x, before[0], slopes[0] * self.f_slope(after[0]), into),)


class GatedRecurrentCell(_Cell):
    gates = ("z", "r", "h")

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An update gate mixes the old state with a candidate that a reset gate lets see it."""
        z, r = _sigmoid(self._gate("z", x, h)), _sigmoid(self._gate("r", x, h))
        h = z * h + (1 - z) * self.f(self._gate("h", x, r * h))
        return self.output(h), h

    def back(self, x: np.ndarray, before: tuple, after: tuple, slopes: tuple, into: dict) -> tuple[np.ndarray, ...]:
        (h,), (dh,) = before, slopes
        z, r = _sigmoid(self._gate("z", x, h)), _sigmoid(self._gate("r", x, h))
        new = self.f(self._gate("h", x, r * h))
        mixed = self._back_gate("h", x, r * h, dh * (1 - z) * self.f_slope(new), into)
        out = dh * z + mixed * r
        out += self._back_gate("z", x, h, dh * (h - new) * z * (1 - z), into)
        return (out + self._back_gate("r", x, h, mixed * h * r * (1 - r), into),)


class LongShortTermCell(_Cell):
    gates = ("f", "i", "o", "c")

    def start(self, rows: int) -> tuple[np.ndarray, ...]:
        return np.zeros((rows, self.n_hidden)), np.zeros((rows, self.n_hidden))

    def step(self, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The output, the next hidden state and the next memory."""
        f, i, o = (_sigmoid(self._gate(g, x, h)) for g in "fio")
        c = f * c + i * self.f(self._gate("c", x, h))
        h = o * self.f(c)
        return self.output(h), h, c

    def back(self, x: np.ndarray, before: tuple, after: tuple, slopes: tuple, into: dict) -> tuple[np.ndarray, ...]:
        (h, c), (_, c_new), (dh, dc) = before, after, slopes
        f, i, o = (_sigmoid(self._gate(g, x, h)) for g in "fio")
        new, seen = self.f(self._gate("c", x, h)), self.f(c_new)
        dc = dc + dh * o * self.f_slope(seen)
        out = self._back_gate("o", x, h, dh * seen * o * (1 - o), into)
        out += self._back_gate("f", x, h, dc * c * f * (1 - f), into)
        out += self._back_gate("i", x, h, dc * new * i * (1 - i), into)
        return out + self._back_gate("c", x, h, dc * i * self.f_slope(new), into), dc * f


def unroll(cell: _Cell, x: np.ndarray) -> np.ndarray:
    """Outputs of a cell over the rows of a sequence."""
    state, out = cell.start(1), []
    for row in np.asarray(x, float):
        y, *state = cell.step(row[None, :], *state)
        out.append(y[0])
    return np.array(out)


def through_time(cell: _Cell, x: np.ndarray, y: np.ndarray, state: tuple, criterion: str = "mse") -> tuple[float, list[np.ndarray], tuple]:
    """The loss over a sequence, its gradients in the order of cell.parameters(), and the state at the end."""
    loss, slope = CRITERIA[criterion]
    states, outs = [state], []
    for row in x:
        out, *after = cell.step(row[None, :], *states[-1])
        outs.append(out[0])
        states.append(tuple(after))
    outs = np.array(outs)
    error = outs - y.reshape(len(x), -1)
    into = {g: [np.zeros_like(a) for a in cell.w[g]] for g in cell.gates}
    last = [np.zeros_like(a) for a in cell.out]
    back = tuple(np.zeros_like(a) for a in state)
    due = slope(error) * cell.g_slope(outs)
    for t in range(len(x) - 1, -1, -1):
        h = states[t + 1][0]
        last[0] += h.T @ due[t][None, :]
        last[1] += due[t]
        back = (back[0] + due[t][None, :] @ cell.out[0].T, *back[1:])
        back = cell.back(x[t][None, :], states[t], states[t + 1], back, into)
    return loss(error), [a for g in cell.gates for a in into[g]] + last, states[-1]


CELLS = {"rnn": RecurrentCell, "gru": GatedRecurrentCell, "lstm": LongShortTermCell}


class Recurrent:
    """A cell trained through time on pieces of a sequence; the state goes from piece to piece, gradients don't. predict starts anew."""

    def __init__(self, kind: str, n_in: int, n_out: int = 1, n_hidden: int = 8, lr: float = 1e-2, optimiser: str = "adam", seed: int = 0, criterion: str = "mse", schedule: Sequence = (), forward: str | None = "tanh", output: str | None = None, most: float = 5.0):
        if kind not in CELLS or criterion not in CRITERIA:
            raise ValueError(f"unknown cell {kind!r} or criterion {criterion!r}")
        self.cell = CELLS[kind](n_in, n_out, n_hidden, seed, forward, output)
        self.lr, self.criterion, self.schedule, self.epoch, self.most = lr, criterion, schedule, 0, most
        self.state = Optimiser(optimiser, self.cell.parameters())

    def fit(self, x: np.ndarray, y: np.ndarray, batch_size: int = 32, epochs: int = 1) -> list[float]:
        """The mean loss of each epoch; gradients longer than most are shortened to it."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        losses = []
        for _ in range(epochs):
            state, found = self.cell.start(1), []
            for at in range(0, len(x), batch_size):
                loss, gradients, state = through_time(self.cell, x[at : at + batch_size], y[at : at + batch_size], state, self.criterion)
                size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
                if size > self.most:
                    gradients = [g * (self.most / size) for g in gradients]
                self.state.step(self.cell.parameters(), gradients, scheduled(self.lr, self.schedule, self.epoch))
                found.append(loss)
            losses.append(float(np.mean(found)))
            self.epoch += 1
        return losses

    def predict(self, x: np.ndarray) -> np.ndarray:
        return unroll(self.cell, x)


class LeastSquares:
    """Linear regression with a constant, as a baseline; each fit starts anew."""

    def fit(self, x: np.ndarray, y: np.ndarray, batch_size: int = 0, epochs: int = 1) -> list[float]:
        a, y = np.c_[np.ones(len(x)), x], np.asarray(y, float)
        self.w = np.linalg.lstsq(a, y, rcond=None)[0]
        return [float(np.mean((a @ self.w - y) ** 2))]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), x] @ self.w
