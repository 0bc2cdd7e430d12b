"""Gaussian mixtures chosen by BIC, fitted from many starts side by side, and what follows from their posteriors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint

RIDGE = 1e-6  # added to variances of standardised columns
ROUNDS = 100  # of expectation-maximisation at most
STILL = 1e-3  # a mean log likelihood that gains less has settled
PIVOTS = 48  # centres of k-means|| from which starts are drawn


@dataclass
class Mixture:
    """Weights, means and covariances of clusters in columns standardised by mean and spread."""

    columns: list[str]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def posteriors(self, columns: list[Column] | None = None) -> Column:
        """The probability of each cluster, an array in their order; null where a column is null or NaN."""
        at = columns or [F.col(c) for c in self.columns]
        x = [(c - float(m)) / float(s) for c, m, s in zip(at, self.mean, self.spread)]
        logs = []
        for w, mu, cov in zip(self.weights, self.means, self.covariances):
            inverse = np.linalg.inv(np.linalg.cholesky(cov))
            z = [reduce(lambda a, b: a + b, [float(inverse[i, j]) * (x[j] - float(mu[j])) for j in range(i + 1)]) for i in range(len(x))]
            level = math.log(max(w, 1e-300)) + float(np.log(np.diag(inverse)).sum())
            logs.append(level - 0.5 * reduce(lambda a, b: a + b, [v * v for v in z]))
        one = lambda v: F.lit(1.0) / reduce(lambda a, b: a + b, [F.exp(other - v) for other in logs])
        shares = F.array(*[one(v) for v in logs])
        real = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in at])
        return F.when(real, shares)

    def centres(self) -> list[tuple]:
        """(cluster, a value of each column), in the columns' own scale."""
        return [(k, *map(float, m * self.spread + self.mean)) for k, m in enumerate(self.means)]

    def regimes(self) -> tuple[int, int]:
        """The clusters of least and of greatest summed dense rank of their centres; of equals the first and the last."""
        places = [sorted(set(v)) for v in zip(*[c[1:] for c in self.centres()])]
        score = [(sum(p.index(v) for p, v in zip(places, c[1:])), c[0]) for c in self.centres()]
        return min(score)[1], max(score)[1]


def _log_densities(x: np.ndarray, model: tuple) -> np.ndarray:
    out = np.empty((len(x), len(model[0])))
    for k, (w, mu, cov) in enumerate(zip(*model)):
        inverse = np.linalg.inv(np.linalg.cholesky(cov))
        z = (x - mu) @ inverse.T
        out[:, k] = math.log(max(w, 1e-300)) + np.log(np.diag(inverse)).sum() - 0.5 * ((z * z).sum(1) + x.shape[1] * math.log(2 * math.pi))
    return out


def _moments(scaled: DataFrame, models: dict[int, tuple]) -> dict[int, tuple[float, np.ndarray]]:
    """Log likelihood and, for each cluster, the sums of 1, x and x x' weighted by responsibility, of every model, in one pass.

    The last column of ``scaled`` is the number of rows that are alike.
    """
    d = len(scaled.columns) - 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            x = batch.to_numpy(float)
            if not len(x):
                continue
            x, n = x[:, :-1], x[:, -1:]
            square = (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)
            terms = n * np.hstack([np.ones((len(x), 1)), x, square])
            for name, model in models.items():
                logs = _log_densities(x, model)
                top = logs.max(1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                found = np.hstack([np.exp(logs - total[:, None]).T @ terms, np.full((logs.shape[1], 1), total @ n[:, 0])])
                sums[name] = sums.get(name, 0) + found
        if sums:
            cells = [(name, k, place, v) for name, found in sums.items() for k, row in enumerate(found) for place, v in enumerate(row)]
            yield pd.DataFrame(cells, columns=["model", "k", "place", "v"])

    rows = scaled.mapInPandas(partial, "model int, k int, place int, v double").groupBy("model", "k", "place").agg(F.sum("v").alias("v")).collect()  # models x clusters x moments
    out = {name: np.zeros((len(m[0]), 2 + d + d * d)) for name, m in models.items()}
    for r in rows:
        out[r.model][r.k, r.place] = r.v
    return {name: (found[0, -1], found[:, :-1]) for name, found in out.items()}


def _from_moments(sums: np.ndarray, d: int) -> tuple:
    n = np.maximum(sums[:, 0], 1e-10)
    means = sums[:, 1 : 1 + d] / n[:, None]
    cov = sums[:, 1 + d :].reshape(-1, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    values, vectors = np.linalg.eigh(cov)  # rounding may leave a variance just below 0
    cov = (vectors * np.maximum(values, 0)[:, None, :]) @ vectors.transpose(0, 2, 1)
    return n / n.sum(), means, cov + RIDGE * np.eye(d)


def _starts(scaled: DataFrame, n: int, most: int, restarts: int, seed: int) -> dict[int, tuple]:
    """Models to start from: the centres of one k-means|| run, weighted by their rows, drawn apart again for every start."""
    columns = scaled.columns[:-1]
    d = len(columns)
    models = {0: (np.ones(1), np.zeros((1, d)), np.eye(d)[None])}
    places = scaled.count()
    if most < 2 or places < 2:
        return models
    packed = VectorAssembler(inputCols=columns, outputCol="features").transform(scaled)
    fitted = KMeans(k=min(PIVOTS, places), initMode="k-means||", initSteps=2, maxIter=3, seed=seed, weightCol=scaled.columns[-1]).fit(packed)
    pivots = np.array(fitted.clusterCenters())
    held = dict(map(tuple, fitted.transform(packed).groupBy("prediction").agg(F.sum(scaled.columns[-1])).collect()))  # one row per pivot
    weight = np.array([held.get(i, 0) for i in range(len(pivots))], float)
    within = fitted.summary.trainingCost / n / d
    for k in range(2, min(most, n, int((weight > 0).sum())) + 1):
        for r in range(restarts):
            rng = np.random.default_rng([seed, k, r])
            chosen = [rng.choice(len(pivots), p=weight / weight.sum())]
            while len(chosen) < k:
                far = weight * ((pivots[:, None] - pivots[chosen][None]) ** 2).sum(2).min(1)
                chosen.append(rng.choice(len(pivots), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(pivots)))
            home = ((pivots[:, None] - pivots[chosen][None]) ** 2).sum(2).argmin(1)
            sums = np.array([np.concatenate([[w.sum()], w @ pivots, np.einsum("i,ij,ik->jk", w, pivots, pivots).ravel()]) for w in (weight * (home == c) for c in range(k))])
            shares, means, cov = _from_moments(sums, d)
            models[len(models)] = (shares, np.where(sums[:, :1] > 0, means, pivots[chosen]), cov + within * np.eye(d))
    return models


def fit_mixture(rows: DataFrame, columns: list[str], most: int = 6, seed: int = 1, restarts: int = 10) -> Mixture | None:
    """The mixture of 1 to ``most`` clusters of least BIC, of the best of ``restarts`` starts each; None without rows.

    Rows with a null or NaN in a column take no part; rows that are alike go through as one with their number. All starts go through expectation-maximisation together, one pass over
    the rows a round; the driver gets sums of models x clusters x moments only.
    """
    valid = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    facts = valid.agg(F.count(F.lit(1)), *[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    n, d = facts[0], len(columns)
    if not n:
        return None
    mean = np.array(facts[1::2], float)
    spread = np.array([s if s > 0 else 1.0 for s in facts[2::2]], float)
    alike = valid.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    scaled = checkpoint(alike.select(*[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, mean, spread)], "__n"))
    models, likely = _starts(scaled, n, most, restarts, seed), {}
    going = set(models)
    for _ in range(ROUNDS):
        for name, (value, sums) in _moments(scaled, {name: models[name] for name in going}).items():
            if abs(value - likely.get(name, -math.inf)) < STILL * n:
                going.discard(name)  # the model that has this likelihood stays
            else:
                likely[name], models[name] = value, _from_moments(sums, d)
        if not going:
            break
    free = lambda k: k * (d + d * (d + 1) / 2) + k - 1
    best = min(likely, key=lambda name: (free(len(models[name][0])) * math.log(n) - 2 * likely[name], name))
    return Mixture(list(columns), mean, spread, *models[best])


def labelled(rows: DataFrame, mixture: Mixture | None) -> DataFrame:
    """Rows with their most likely cluster (the first of equals) and its probability; null where a column is null."""
    if mixture is None:
        return rows.withColumn("cluster", F.lit(None).cast("int")).withColumn("probability", F.lit(None).cast("double"))
    with_all = rows.withColumn("__p", mixture.posteriors())
    top = F.array_max("__p")
    return with_all.withColumn("cluster", (F.array_position("__p", top) - 1).cast("int")).withColumn("probability", top).drop("__p")


def mixture_clusters(rows: DataFrame, columns: list[str], most: int = 6, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows with cluster and probability, and the centres in the columns' own scale; no centres for an empty table."""
    mixture = fit_mixture(rows, columns, most, seed)
    kind = "cluster int, " + ", ".join(f"{c} double" for c in columns)
    return labelled(rows, mixture), SparkSession.active().createDataFrame(mixture.centres() if mixture else [], kind)


def centre_scores(centres: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of the dense ranks of each centre's columns; one row per cluster."""
    score = sum((F.dense_rank().over(Window.orderBy(c)) for c in columns[1:]), F.dense_rank().over(Window.orderBy(columns[0])))
    return centres.withColumn("score", score)


def boundary(grid: DataFrame) -> DataFrame:
    """x, y where the value of grid(x, y, value) first changes sign along y, by linear interpolation."""
    w = Window.partitionBy("x").orderBy("y")
    before = grid.withColumn("y0", F.lag("y").over(w)).withColumn("v0", F.lag("value").over(w)).filter("v0 is not null and sign(v0) <> sign(value)")
    cross = F.col("y0") + (F.col("y") - F.col("y0")) * F.try_divide(-F.col("v0"), F.col("value") - F.col("v0"))
    return before.withColumn("at", cross).groupBy("x").agg(F.min_by("at", "y").alias("y"))


def regime_boundary(rows: DataFrame, mixture: Mixture | None, across: int = 200, up: int = 400) -> DataFrame:
    """x, y where, over a grid of the range of a mixture's two columns, its lowest and highest regime first are as likely.

    No rows for an empty table or a mixture of one cluster.
    """
    nothing = SparkSession.active().createDataFrame([], "x double, y double")
    if mixture is None or len(mixture.weights) < 2:
        return nothing
    valid = rows.select(*[F.col(c).cast("double").alias(c) for c in mixture.columns]).dropna()
    low_x, high_x, low_y, high_y = valid.agg(*[f(c) for c in mixture.columns for f in (F.min, F.max)]).first()
    step = lambda i, low, high, n: F.lit(low) + i * ((high - low) / (n - 1))
    grid = SparkSession.active().range(across).select(step(F.col("id"), low_x, high_x, across).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(up - 1))).alias("j"))
    grid = grid.select("x", step(F.col("j"), low_y, high_y, up).alias("y"))
    low, high = mixture.regimes()
    p = mixture.posteriors([F.col("x"), F.col("y")])
    return boundary(grid.withColumn("p", p).select("x", "y", (F.get("p", F.lit(low)) - F.get("p", F.lit(high))).alias("value")))
