"""Regressors for design matrices that fit a task: linear family and tree ensembles.

Pooled models over a whole panel use ``pyspark.ml``; these serve per-series recursion,
where the fitted model must be evaluated step by step inside a grouped function.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class Linear:
    """Least squares; ``l2`` ridge, ``l1`` lasso, both elastic net (intercept unpenalised)."""

    l2: float = 0.0
    l1: float = 0.0
    intercept: bool = True
    rounds: int = 500
    linear = True

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None):
        w = np.ones(len(x)) if w is None else w
        mx = (w @ x) / w.sum() if self.intercept else np.zeros(x.shape[1])
        my = float(w @ y) / w.sum() if self.intercept else 0.0
        xc, yc, r = x - mx, y - my, np.sqrt(w)
        if self.l1:
            scale, coef, rest = (w[:, None] * xc * xc).sum(axis=0) / w.sum() + self.l2, np.zeros(x.shape[1]), yc.copy()
            for _ in range(self.rounds):
                before = coef.copy()
                for j in range(x.shape[1]):
                    if scale[j] <= 0:
                        continue
                    rho = (w * xc[:, j]) @ rest / w.sum() + (scale[j] - self.l2) * coef[j]
                    new = np.sign(rho) * max(0.0, abs(rho) - self.l1) / scale[j]
                    rest -= xc[:, j] * (new - coef[j])
                    coef[j] = new
                if np.abs(coef - before).max(initial=0.0) < 1e-10:
                    break
        elif self.l2:
            coef = np.linalg.solve((xc * w[:, None]).T @ xc + self.l2 * np.eye(x.shape[1]), (xc * w[:, None]).T @ yc)
        else:
            coef = np.linalg.lstsq(xc * r[:, None], yc * r, rcond=None)[0]
        return FittedLinear(coef, my - float(mx @ coef))


@dataclass
class FittedLinear:
    coef: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.intercept


@dataclass(frozen=True)
class Tree:
    """Least-squares regression tree; ``linear_leaves`` fits a ridge model in every leaf."""

    depth: int = 6
    least: int = 5
    features: float = 1.0
    linear_leaves: bool = False
    seed: int = 0
    linear = False

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None):
        w = np.ones(len(x)) if w is None else w
        return FittedTree(self._grow(x, y, w, self.depth, np.random.default_rng(self.seed)))

    def _leaf(self, x, y, w):
        if self.linear_leaves and len(y) > 2 * x.shape[1]:
            return ("linear", Linear(l2=1e-6).fit(x, y, w))
        return ("mean", float(w @ y / w.sum()) if w.sum() else 0.0)

    def _grow(self, x, y, w, depth, rng):
        n = len(y)
        if depth == 0 or n < 2 * self.least or np.ptp(y) == 0:
            return self._leaf(x, y, w)
        columns = np.arange(x.shape[1])
        if self.features < 1.0:
            columns = rng.choice(columns, max(1, round(self.features * len(columns))), replace=False)
        best = (1e-12, None, None)
        for j in columns:
            order = np.argsort(x[:, j], kind="stable")
            xs, ws, wy = x[order, j], w[order], (w * y)[order]
            sw, sy = np.cumsum(ws), np.cumsum(wy)
            cut = np.arange(self.least - 1, n - self.least)
            cut = cut[xs[cut] < xs[cut + 1]]
            if len(cut):
                left, right = sw[cut], sw[-1] - sw[cut]
                gain = np.where((left > 0) & (right > 0), sy[cut] ** 2 / np.maximum(left, 1e-300) + (sy[-1] - sy[cut]) ** 2 / np.maximum(right, 1e-300), 0) - sy[-1] ** 2 / sw[-1]
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, (xs[cut[k]] + xs[cut[k] + 1]) / 2)
        if best[1] is None:
            return self._leaf(x, y, w)
        go = x[:, best[1]] <= best[2]
        return ("split", best[1], best[2], self._grow(x[go], y[go], w[go], depth - 1, rng), self._grow(x[~go], y[~go], w[~go], depth - 1, rng))


@dataclass
class FittedTree:
    root: tuple

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        self._down(self.root, x, np.arange(len(x)), out)
        return out

    def _down(self, node, x, rows, out):
        if node[0] == "mean":
            out[rows] = node[1]
        elif node[0] == "linear":
            out[rows] = node[1].predict(x[rows])
        else:
            go = x[rows, node[1]] <= node[2]
            self._down(node[3], x, rows[go], out)
            self._down(node[4], x, rows[~go], out)


@dataclass
class _Sum:
    members: list
    weights: list
    base: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(w * m.predict(x) for m, w in zip(self.members, self.weights))


@dataclass(frozen=True)
class Forest:
    trees: int = 50
    tree: Tree = field(default_factory=lambda: Tree(depth=8, features=0.6))
    seed: int = 0
    linear = False

    def fit(self, x, y, w=None):
        rng, members = np.random.default_rng(self.seed), []
        for k in range(self.trees):
            rows = rng.integers(len(y), size=len(y))
            members.append(replace(self.tree, seed=k).fit(x[rows], y[rows]))
        return _Sum(members, [1.0 / self.trees] * self.trees)


@dataclass(frozen=True)
class GradientBoosting:
    """Also stands in for the histogram and library boosters."""

    trees: int = 80
    rate: float = 0.1
    tree: Tree = field(default_factory=lambda: Tree(depth=3))
    linear = False

    def fit(self, x, y, w=None):
        base, members = float(np.mean(y)), []
        rest = y - base
        for _ in range(self.trees):
            members.append(self.tree.fit(x, rest))
            rest = rest - self.rate * members[-1].predict(x)
        return _Sum(members, [self.rate] * self.trees, base)


@dataclass
class _Median:
    members: list
    weights: np.ndarray

    def predict(self, x):
        p = np.array([m.predict(x) for m in self.members])
        order = np.argsort(p, axis=0)
        total = np.cumsum(self.weights[order], axis=0)
        at = (total >= total[-1] / 2).argmax(axis=0)
        return np.take_along_axis(p, np.take_along_axis(order, at[None], 0), 0)[0]


@dataclass(frozen=True)
class AdaBoost:
    """AdaBoost.R2 with linear loss: the weighted median of its trees."""

    trees: int = 40
    tree: Tree = field(default_factory=lambda: Tree(depth=4))
    linear = False

    def fit(self, x, y, w=None):
        weight, members, says = np.full(len(y), 1.0 / len(y)), [], []
        for _ in range(self.trees):
            m = self.tree.fit(x, y, weight)
            error = np.abs(m.predict(x) - y)
            top = error.max()
            if top == 0:
                members.append(m)
                says.append(20.0)
                break
            loss = float(weight @ (error / top))
            if loss >= 0.5:
                if not members:
                    members.append(m)
                    says.append(1.0)
                break
            beta = loss / (1.0 - loss)
            weight = weight * beta ** (1.0 - error / top)
            weight /= weight.sum()
            members.append(m)
            says.append(float(np.log(1.0 / beta)))
        return _Median(members, np.array(says))


#: name -> regressor, for configuration by name.
REGRESSORS = {
    "linear": Linear(),
    "ridge": Linear(l2=1.0),
    "lasso": Linear(l1=0.1),
    "elastic_net": Linear(l1=0.05, l2=0.05),
    "tree": Tree(),
    "model_tree": Tree(depth=3, least=20, linear_leaves=True),
    "forest": Forest(),
    "boosting": GradientBoosting(),
    "adaboost": AdaBoost(),
}
