"""Iterative fits of many models at once: every step is one aggregate over the rows for all of them.

Folds of a logistic regression and restarts of k-means or of a mixture differ only in which rows they
see and in a few numbers, so each batch of rows is summed up for every model before anything is shuffled. The
number of passes over the data is that of the slowest model, not their sum. The numbers of a step
travel as values, not as literals of the plan, whose code would be compiled anew for every step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as V
from newsgauge.operators.classify import Moments, Scaler, column_moments
from newsgauge.operators.ranks import HASH_SPAN, hash_key

NEWTON_STEPS = 50
NEWTON_TOLERANCE = 1e-8
LLOYD_STEPS = 300
LLOYD_MOVE = 1e-4
COST_DIGITS = 6
EM_STEPS = 1000
EM_GAIN = 1e-4
VARIANCE_FLOOR = 1e-6
# Mass that a component without rows has, so that its logarithm is defined.
LEAST_MASS = 1e-14


def _fields(names: Sequence[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def _table_of(rows: list[list[float]], names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array([float(v) for v in c], pa.float64()) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def _dot(weights: Sequence[float], values: Sequence[Column]) -> Column:
    total = F.lit(float(weights[-1]))
    for w, z in zip(weights, values):
        total = total + F.lit(float(w)) * z
    return total


# --- logistic regression -------------------------------------------------------------------


class FoldModels:
    """One L2-regularised logistic regression per fold, fitted with its scaler on the other folds."""

    def __init__(self, features: Sequence[str], scalers: dict[int, Scaler], weights: dict[int, np.ndarray]):
        self.features, self.scalers, self.weights = list(features), scalers, weights

    @classmethod
    def fit(cls, data: DataFrame, features: Sequence[str], folds: int, c: float = 1.0) -> FoldModels:
        """Newton's method on ``fold, y`` and features without nulls; ``w^2 / 2c`` is the penalty.

        The sums of a step hold the loss, gradient and Gram matrix of every fold's model. A step that
        does not lower the loss is halved.
        """
        scalers = _training_scalers(data, features, folds)
        size = len(features) + 1
        penalty = np.diag([1.0 / c] * (size - 1) + [0.0])
        weights = {i: np.zeros(size) for i in range(folds)}
        last: dict[int, tuple[float, np.ndarray]] = {}
        done: set[int] = set()
        for _ in range(NEWTON_STEPS):
            open_ = [i for i in range(folds) if i not in done]
            for i, (loss, gradient, gram) in _sums(data, scalers, weights, open_).items():
                w = weights[i]
                loss += w @ penalty @ w / 2
                if i in last and loss > last[i][0] * (1 + 1e-12):
                    weights[i] = (w + last[i][1]) / 2
                    continue
                step = np.linalg.solve(gram + penalty, gradient + penalty @ w)
                last[i] = loss, w
                weights[i] = w - step
                if np.abs(step).max() <= NEWTON_TOLERANCE:
                    done.add(i)
            if len(done) == folds:
                return cls(features, scalers, weights)
        raise RuntimeError(f"no convergence of folds {sorted(set(range(folds)) - done)}")

    def prediction(self) -> Column:
        """1 where the model of the row's own fold, which has not seen it, says fake."""
        found = F.lit(None).cast("int")
        for i, weights in self.weights.items():
            score = _dot(weights, self.scalers[i].columns())
            found = F.when(F.col("fold") == i, (score > 0).cast("int")).otherwise(found)
        return found


def _training_scalers(data: DataFrame, features: Sequence[str], folds: int) -> dict[int, Scaler]:
    parts = column_moments(data, ["fold"], features)
    scalers = {}
    for i in range(folds):
        total: Moments | None = None
        for (fold,), moments in parts.items():
            if fold != i:
                total = moments if total is None else total + moments
        if total is None:
            raise ValueError(f"no rows to fit fold {i} to")
        scalers[i] = Scaler.of(total, features)
    return scalers


def _sums(
    data: DataFrame, scalers: dict[int, Scaler], weights: dict[int, np.ndarray], models: Sequence[int]
) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Gram matrix of each model over the rows of the other folds."""
    features = next(iter(scalers.values())).features
    size = len(features) + 1
    wanted = {i: (np.array(scalers[i].mean), np.array(scalers[i].std), weights[i]) for i in models}
    cells = [(a, b) for a in range(size) for b in range(a, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(columns)
            out = []
            for i, (mean, std, w) in wanted.items():
                mine = fold != i
                z = np.column_stack([(x[mine] - mean) / std, np.ones(mine.sum())])
                s, t = z @ w, y[mine]
                p = 1.0 / (1.0 + np.exp(-s))
                loss = np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0.0) - t * s
                gram = (z * (p * (1.0 - p))[:, None]).T @ z
                out.append([i, loss.sum(), *(z.T @ (p - t)), *(gram[a, b] for a, b in cells)])
            yield _table_of(out, names)

    names = ["model", "loss", *[f"g{a}" for a in range(size)], *[f"h{a}_{b}" for a, b in cells]]
    rows = data.select("fold", "y", *features).mapInArrow(run, _fields(names))
    found = {}
    for row in rows.groupBy("model").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect():
        gram = np.array([[row[f"h{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)])
        found[int(row["model"])] = row["loss"], np.array([row[f"g{a}"] for a in range(size)]), gram
    return found


# --- k-means -------------------------------------------------------------------------------


def _starts(data: DataFrame, z: Sequence[str], key: str, seeds: Sequence[int]) -> dict[int, np.ndarray]:
    """Two rows for each seed, by weighted reservoirs over hashes of the key.

    The first is drawn evenly, the second with the square of its distance to the first as weight.
    """

    def point(order: Column) -> Column:
        return F.min(F.struct(order.alias("order"), *z))

    def drawn(points: list[Column]) -> list[np.ndarray | None]:
        row = data.agg(*[p.alias(f"p{i}") for i, p in enumerate(points)]).first()
        return [None if p is None else np.array([p[n] for n in z]) for p in row]

    firsts = drawn([point(hash_key(F.col(key), s)) for s in seeds])
    if any(f is None for f in firsts):
        return {}
    points = []
    for s, first in zip(seeds, firsts):
        distance = sum(((F.col(n) - float(x)) * (F.col(n) - float(x)) for n, x in zip(z, first)), F.lit(0.0))
        share = (hash_key(F.col(key), -s) + 0.5) / float(HASH_SPAN[1] + 1)
        points.append(F.min(F.when(distance > 0, F.struct((-F.log(share) / distance).alias("order"), *z))))
    seconds = drawn(points)
    return {s: np.array([f, f if g is None else g]) for s, f, g in zip(seeds, firsts, seconds)}


def _distance(z: Sequence[str], centre: np.ndarray) -> Column:
    terms = [(F.col(n) - float(x)) * (F.col(n) - float(x)) for n, x in zip(z, centre)]
    return sum(terms[1:], terms[0])


def nearest_of_two(z: Sequence[str], centres: np.ndarray) -> Column:
    """0 or 1; a tie is 0."""
    return (_distance(z, centres[1]) < _distance(z, centres[0])).cast("int")


def two_means(
    data: DataFrame, z: Sequence[str], key: str, restarts: int, seed: int = V.SEED
) -> tuple[np.ndarray, float] | None:
    """Two centres and their cost, the best of several starts; None without rows.

    A restart stops when the squared moves of its centres add up to at most ``LLOYD_MOVE``; it then
    takes no part in further passes. Costs are compared to ``COST_DIGITS`` digits, ties go to the
    first restart. Centres come in ascending order.
    """
    centres = _starts(data, z, key, range(seed, seed + restarts))
    if not centres:
        return None
    costs: dict[int, float] = {}
    open_ = set(centres)
    for _ in range(LLOYD_STEPS):
        for s, sums in _cluster_sums(data, z, {s: centres[s] for s in open_}).items():
            moved = centres[s].copy()
            for cluster, (n, total, _) in sums.items():
                moved[cluster] = total / n
            if ((moved - centres[s]) ** 2).sum() <= LLOYD_MOVE:
                open_.discard(s)
            centres[s] = moved
        if not open_:
            break
    for s, sums in _cluster_sums(data, z, centres).items():
        costs[s] = round(sum(cost for _, _, cost in sums.values()), COST_DIGITS)
    best = min(centres, key=lambda s: (costs[s], s))
    return np.array(sorted(centres[best].tolist())), costs[best]


def _cluster_sums(
    data: DataFrame, z: Sequence[str], centres: dict[int, np.ndarray]
) -> dict[int, dict[int, tuple[int, np.ndarray, float]]]:
    """Rows, sums and cost of both clusters of every restart, one aggregate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x[np.isfinite(x).all(axis=1)]
            out = []
            for s, two in centres.items():
                far = ((x[:, None, :] - two[None, :, :]) ** 2).sum(axis=2)
                nearer = far[:, 1] < far[:, 0]
                for cluster, mine in enumerate((~nearer, nearer)):
                    out.append([s, cluster, mine.sum(), far[mine, cluster].sum(), *x[mine].sum(axis=0)])
            yield _table_of(out, names)

    names = ["restart", "cluster", "n", "cost", *[f"z{a}" for a in range(len(z))]]
    rows = data.select(*z).mapInArrow(run, _fields(names))
    found: dict[int, dict[int, tuple[int, np.ndarray, float]]] = {s: {} for s in centres}
    grouped = rows.groupBy("restart", "cluster").agg(*[F.sum(n).alias(n) for n in names[2:]])
    for row in grouped.where("n > 0").collect():
        total = np.array([row[n] for n in names[4:]])
        found[int(row["restart"])][int(row["cluster"])] = int(row["n"]), total, row["cost"]
    return found


# --- mixture of two Gaussians --------------------------------------------------------------


@dataclass(frozen=True)
class Gaussian:
    """A weighted component; ``factor`` is the inverse of the Cholesky factor of its covariance."""

    weight: float
    mean: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, share: float, mass: float, total: np.ndarray, square: np.ndarray) -> Gaussian:
        """From a component's share of the rows, its mass, and sums of its values and products."""
        mass = mass + LEAST_MASS
        mean = total / mass
        covariance = square / mass - np.outer(mean, mean) + VARIANCE_FLOOR * np.eye(len(mean))
        return cls(share, mean, np.linalg.inv(np.linalg.cholesky(covariance)))

    @property
    def constant(self) -> float:
        turn = len(self.mean) * np.log(2 * np.pi) / 2
        return float(np.log(self.weight) - turn + np.log(np.diag(self.factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of weight times density."""
        return self.constant - (((x - self.mean) @ self.factor.T) ** 2).sum(axis=1) / 2

    def score_column(self, z: Sequence[str]) -> Column:
        far = F.lit(0.0)
        for row in self.factor:
            part = F.lit(0.0)
            for f, n, m in zip(row, z, self.mean):
                if f:
                    part = part + F.lit(float(f)) * (F.col(n) - F.lit(float(m)))
            far = far + part * part
        return F.lit(self.constant) - far / 2


Mixture = tuple[Gaussian, Gaussian]


def two_gaussians(
    data: DataFrame, z: Sequence[str], key: str, restarts: int, seed: int = V.SEED
) -> tuple[Mixture, float] | None:
    """Two components and the mean log-likelihood of a row, the best of several starts; None without rows.

    A restart begins with the rows nearer to either of its two starts, as ``two_means`` draws them,
    and ends at the first mixture whose likelihood gains less than ``EM_GAIN`` on the one before; it
    then takes no part in further passes. Likelihoods are compared to ``COST_DIGITS`` digits, ties go
    to the first restart. Components come in ascending order of their means.
    """
    starts = _starts(data, z, key, range(seed, seed + restarts))
    if not starts:
        return None
    mixtures = {s: m for s, (_, m) in _mixture_sums(data, z, starts).items()}
    reached: dict[int, float] = {}
    open_ = set(mixtures)
    for _ in range(EM_STEPS):
        for s, (likelihood, after) in _mixture_sums(data, z, {s: mixtures[s] for s in open_}).items():
            gain = likelihood - reached.get(s, -np.inf)
            reached[s] = likelihood
            if gain < EM_GAIN:
                open_.discard(s)
            else:
                mixtures[s] = after
        if not open_:
            break
    else:
        raise RuntimeError(f"no convergence of restarts {sorted(open_)}")
    best = min(reached, key=lambda s: (-round(reached[s], COST_DIGITS), s))
    a, b = sorted(mixtures[best], key=lambda g: g.mean.tolist())
    return (a, b), reached[best]


def _mixture_sums(
    data: DataFrame, z: Sequence[str], models: dict[int, Mixture | np.ndarray]
) -> dict[int, tuple[float, Mixture]]:
    """Mean log-likelihood of every restart's mixture and the mixture that follows it, one aggregate.

    A restart of two points instead gives every row to the nearer one; its likelihood is 0.
    """
    d = len(z)
    cells = [(a, b) for a in range(d) for b in range(a, d)]

    def shares(model: Mixture | np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(model, np.ndarray):
            far = ((x[:, None, :] - model[None, :, :]) ** 2).sum(axis=2)
            nearer = (far[:, 1] < far[:, 0]).astype(float)
            return np.zeros(len(x)), np.column_stack([1.0 - nearer, nearer])
        scores = np.column_stack([g.score(x) for g in model])
        whole = np.logaddexp(scores[:, 0], scores[:, 1])
        return whole, np.exp(scores - whole[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x[np.isfinite(x).all(axis=1)]
            out = []
            for s, model in models.items():
                whole, share = shares(model, x)
                for k in (0, 1):
                    mine = x * share[:, k, None]
                    square = mine.T @ x
                    out.append([s, k, len(x), whole.sum(), share[:, k].sum(), *mine.sum(axis=0),
                                *(square[a, b] for a, b in cells)])
            yield _table_of(out, names)

    names = ["restart", "component", "n", "likelihood", "mass"]
    names += [*[f"z{a}" for a in range(d)], *[f"q{a}_{b}" for a, b in cells]]
    rows = data.select(*z).mapInArrow(run, _fields(names))
    grouped = rows.groupBy("restart", "component").agg(*[F.sum(n).alias(n) for n in names[2:]])
    parts: dict[int, dict[int, Gaussian]] = {}
    likelihoods = {}
    for row in grouped.collect():
        total = np.array([row[f"z{a}"] for a in range(d)])
        square = np.array([[row[f"q{min(a, b)}_{max(a, b)}"] for b in range(d)] for a in range(d)])
        share = (row["mass"] + LEAST_MASS) / row["n"]
        s = int(row["restart"])
        parts.setdefault(s, {})[int(row["component"])] = Gaussian.of(share, row["mass"], total, square)
        likelihoods[s] = row["likelihood"] / row["n"]
    return {s: (likelihoods[s], (two[0], two[1])) for s, two in parts.items()}
