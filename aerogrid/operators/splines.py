"""Additive models of penalised cubic splines, fitted from one distributed sum of products.

Each feature is a row of cubic B-splines on equal intervals between its least and greatest value. What a fit needs of the data is the matrix of
sums of products of all columns, with the target: tasks add up their own, and only those sums (some thousands) reach the driver. How strongly
each feature's curve is held straight is chosen there, by generalised cross-validation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Intervals of a curve, strengths that are tried (of the sum of squared second differences of its coefficients), and rounds over the features.
INTERVALS, STRENGTHS, ROUNDS = 10, tuple(10.0**i for i in range(-4, 9)), 2


class Curve(NamedTuple):
    """A feature's range; one that never varies has no curve."""

    low: float
    high: float
    intervals: int

    @property
    def width(self) -> int:
        return self.intervals + 3 if self.high > self.low else 0


def spline_rows(x: np.ndarray, curve: Curve) -> np.ndarray:
    """The cubic B-splines at each value: four that aren't 0, which sum to 1. Values beyond the range count as its ends."""
    u = (np.clip(x, curve.low, curve.high) - curve.low) / (curve.high - curve.low) * curve.intervals
    j = np.minimum(np.floor(u), curve.intervals - 1).astype(int)
    t, out, at = u - j, np.zeros((len(x), curve.width)), np.arange(len(x))
    for k, w in enumerate(((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)):
        out[at, j + k] = w
    return out


def design(x: np.ndarray, curves: Sequence[Curve]) -> np.ndarray:
    """A column of ones, then the splines of each feature."""
    return np.hstack([np.ones((len(x), 1)), *(spline_rows(x[:, i], c) for i, c in enumerate(curves) if c.width)])


def products(rows: DataFrame, curves: Sequence[Curve]) -> np.ndarray:
    """The matrix of sums of products of design columns and target over all rows; rows: x (array), y."""
    ship_package(rows.sparkSession)
    k = 2 + sum(c.width for c in curves)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                a = np.hstack([design(x, curves), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total += a.T @ a
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((k, k))
    for i, j, v in rows.select("x", "y").mapInArrow(add_up, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # k (k + 1) / 2 rows
        out[i, j] = out[j, i] = v
    return out


class Fit(NamedTuple):
    coefficients: np.ndarray
    strengths: tuple[float, ...]
    score: float


def penalised(total: np.ndarray, curves: Sequence[Curve], strengths: Sequence[float]) -> Fit:
    """Least squares with each curve's second differences held down, and the generalised cross-validation of it: n rss / (n - degrees)²."""
    n, k = total[0, 0], len(total) - 1
    held, one = np.zeros((k, k)), np.zeros((k, k))
    at = 1
    for c, s in zip([c for c in curves if c.width], strengths, strict=True):
        d = np.diff(np.eye(c.width), 2, axis=0)
        held[at : at + c.width, at : at + c.width] = s * d.T @ d
        one[at : at + c.width, at : at + c.width] = 1.0  # a curve's level is the constant's: its coefficients sum to 0
        at += c.width
    gram, to_y = total[:k, :k], total[:k, k]
    # constraint and penalty leave the fit among those of the curves alone; a little ridge stands for places without data
    system = gram + held + one * max(n, 1.0) * 1e-6 + np.eye(k) * 1e-9 * max(n, 1.0) / k
    solved = np.linalg.solve(system, np.column_stack([to_y, gram]))
    beta, degrees = solved[:, 0], np.trace(solved[:, 1:])
    rss = max(total[k, k] - 2 * beta @ to_y + beta @ gram @ beta, 0.0)
    return Fit(beta, tuple(strengths), n * rss / max(n - degrees, 1e-9) ** 2)


def best_fit(total: np.ndarray, curves: Sequence[Curve], strengths: Sequence[float] = STRENGTHS, rounds: int = ROUNDS) -> Fit:
    """The strengths of least cross-validation: one for all first, then each curve's in turn."""
    n = sum(c.width > 0 for c in curves)
    best = min((penalised(total, curves, [s] * n) for s in strengths), key=lambda f: f.score)
    for i in [*range(n)] * rounds if n > 1 else []:
        tried = (penalised(total, curves, [*best.strengths[:i], s, *best.strengths[i + 1 :]]) for s in strengths)
        best = min([best, *tried], key=lambda f: f.score)
    return best


class PenalisedSplines(Estimator):
    """An additive model of splines: features (a vector) to a number. Rows without a label are left out of the fit."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", intervals: int = INTERVALS, strengths: Sequence[float] = STRENGTHS):
        super().__init__()
        self.names, self.intervals, self.strengths = (featuresCol, labelCol, predictionCol), intervals, tuple(strengths)

    def _fit(self, dataset: DataFrame) -> SplineModel:
        features, label, _ = self.names
        rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull())
        first = rows.first()
        if first is None:
            raise ValueError("there are no rows to fit on")
        n = len(first["x"])
        ends = rows.agg(*[f(F.get("x", F.lit(i))) for i in range(n) for f in (F.min, F.max)]).first()
        curves = [Curve(ends[2 * i], ends[2 * i + 1], self.intervals) for i in range(n)]
        return SplineModel(self.names, curves, best_fit(products(rows, curves), curves, self.strengths))


class SplineModel(Model):
    def __init__(self, names: tuple[str, str, str], curves: Sequence[Curve], fit: Fit):
        super().__init__()
        self.names, self.curves, self.fit_ = names, list(curves), fit

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, _, prediction = self.names
        curves = {i: c for i, c in enumerate(self.curves) if c.width}
        beta, at, out = self.fit_.coefficients, 1, F.lit(float(self.fit_.coefficients[0]))
        # one column after the other: written into each other, a vector is unpacked and a place found dozens of times a row
        rows = dataset.withColumn("_spline_x", vector_to_array(features))
        rows = rows.withColumns({f"_spline_u{i}": _place(F.get("_spline_x", F.lit(i)), c) for i, c in curves.items()})
        rows = rows.withColumns({f"_spline_j{i}": F.least(F.floor(f"_spline_u{i}"), F.lit(c.intervals - 1)).cast("int") for i, c in curves.items()})
        rows = rows.withColumns({f"_spline_t{i}": F.col(f"_spline_u{i}") - F.col(f"_spline_j{i}") for i in curves})
        for i, c in curves.items():
            out = out + _curve(F.col(f"_spline_j{i}"), F.col(f"_spline_t{i}"), beta[at : at + c.width])
            at += c.width
        return rows.withColumn(prediction, out).drop("_spline_x", *[f"_spline_{v}{i}" for i in curves for v in "ujt"])


def _place(x: Column, c: Curve) -> Column:
    """Where in the curve's range a value lies, in intervals."""
    return (F.greatest(F.lit(c.low), F.least(F.lit(c.high), x)) - F.lit(c.low)) * F.lit(c.intervals / (c.high - c.low))


def _curve(j: Column, t: Column, beta: np.ndarray) -> Column:
    """A curve's value at the share t of interval j, as a Column: nothing leaves the JVM."""
    held = F.array(*[F.lit(float(b)) for b in beta])
    weights = ((1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6)
    return sum((F.get(held, j + k) * w for k, w in enumerate(weights)), F.lit(0.0))
