"""A series as noisy readings of a level that drifts with a drifting slope, smoothed exactly and in parts.

Smoothing is least squares over all states, whose equations tie neighbours alone. A series is cut into pieces; each piece puts its inner states out
of the equations and hands on what is left between its own first state and the next piece's; these few are solved; then the pieces solve for their inner
states. So one long series is many rows, and pieces are worked on side by side, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from ..session import ship_package
from .ranks import with_rank

#: Rows of a piece.
PIECE = 512
#: What holds the first level and slope where readings say nothing: so much of a reading of 0. One reading alone makes a level series.
HELD = (1e-15, 1e-9)


class Variances(NamedTuple):
    """Of a reading about the level, and of a step of level and slope."""

    noise: float = 1.0
    level: float = 0.1
    slope: float = 0.001


def _step(v: Variances) -> np.ndarray:
    """The 4 x 4 equations that a step adds to two neighbours (level, slope, next level, next slope)."""
    a, b = np.array([-1.0, -1.0, 1.0, 0.0]), np.array([0.0, -1.0, 0.0, 1.0])
    return np.outer(a, a) / v.level + np.outer(b, b) / v.slope


def hand_on(y: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, v: Variances) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, 4, 4) equations and (pieces, 4) right sides between each piece's first state and the next piece's.

    y: (pieces, PIECE) readings, NaN where there is none; rows: how many each piece has; first, last: whether a piece begins or ends its series. The last piece's are in
    its own first state alone.
    """
    n, step = len(y), _step(v)
    m, r = np.zeros((n, 4, 4)), np.zeros((n, 4))  # in the first state and the newest one; at the start both are the first
    known = ~np.isnan(y)
    m[:, 0, 0], r[:, 0] = known[:, 0] / v.noise, np.where(known[:, 0], y[:, 0], 0) / v.noise
    m[first, 0, 0] += HELD[0]
    m[first, 1, 1] += HELD[1]
    longest = int(rows.max(initial=0))
    for t in range(1, longest + 1):
        # a new state: inside the piece, or the next piece's first
        here = (t < rows) | ((t == rows) & ~last)
        wide, right = np.zeros((here.sum(), 6, 6)), np.zeros((here.sum(), 6))
        wide[:, :4, :4], right[:, :4] = m[here], r[here]
        if t == 1:
            wide[:, [0, 1, 4, 5], :] = 0
            at = np.ix_([0, 1, 4, 5], [0, 1, 4, 5])
            wide[:, at[0], at[1]] = step
            wide[:, :2, :2] += m[here][:, :2, :2]
            keep = [0, 1, 4, 5]
            new, side = wide[:, keep][:, :, keep], right[:, keep]
        else:
            wide[:, 2:, 2:] += step
            out, keep = [2, 3], [0, 1, 4, 5]
            solved = np.linalg.solve(wide[:, out][:, :, out], np.concatenate([wide[:, out][:, :, keep], right[:, out, None]], 2))
            back = wide[:, keep][:, :, out]
            new, side = wide[:, keep][:, :, keep] - back @ solved[:, :, :4], right[:, keep] - (back @ solved[:, :, 4:])[:, :, 0]
        seen = here & (t < rows)
        if t < y.shape[1]:
            k = (seen & known[:, min(t, y.shape[1] - 1)])[here]
            new[k, 2, 2] += 1 / v.noise
            side[k, 2] += y[here, t][k] / v.noise
        m[here], r[here] = new, side
    # a last piece still has its newest state, if that isn't its first
    for i in np.flatnonzero(last & (rows > 1)):
        solved = np.linalg.solve(m[i, 2:, 2:], np.column_stack([m[i, 2:, :2], r[i, 2:]]))
        m[i, :2, :2] -= m[i, :2, 2:] @ solved[:, :2]
        r[i, :2] -= m[i, :2, 2:] @ solved[:, 2]
    m[last, 2:, :], m[last, :, 2:], r[last, 2:] = 0, 0, 0
    return m, r


def chain(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """States (..., n, 2) of equations that tie neighbours: diagonal (..., n, 2, 2), beside (..., n - 1, 2, 2) of a state's rows and the next one's columns."""
    n = diagonal.shape[-3]
    d, r, out = diagonal.copy(), right.copy(), np.zeros_like(right)
    for t in range(1, n):
        up = np.swapaxes(beside[..., t - 1, :, :], -1, -2) @ np.linalg.inv(d[..., t - 1, :, :])
        d[..., t, :, :] -= up @ beside[..., t - 1, :, :]
        r[..., t, :] -= (up @ r[..., t - 1, :, None])[..., 0]
    for t in range(n - 1, -1, -1):
        side = r[..., t, :] if t == n - 1 else r[..., t, :] - (beside[..., t, :, :] @ out[..., t + 1, :, None])[..., 0]
        out[..., t, :] = np.linalg.solve(d[..., t, :, :], side[..., None])[..., 0]
    return out


def inner_states(y: np.ndarray, rows: np.ndarray, last: np.ndarray, start: np.ndarray, after: np.ndarray, v: Variances) -> np.ndarray:
    """(pieces, PIECE, 2) states, given each piece's first one (start) and the next piece's (after)."""
    n, width = y.shape
    step, known = _step(v), ~np.isnan(y)
    inside = np.arange(width)[None] < rows[:, None]
    d, r, beside = np.zeros((n, width, 2, 2)), np.zeros((n, width, 2)), np.zeros((n, width - 1, 2, 2))
    d[:, :, 0, 0], r[:, :, 0] = known / v.noise, np.where(known, y, 0) / v.noise
    d[:, 1:] += np.where(inside[:, 1:, None, None], step[2:, 2:], np.eye(2))  # the step into a state; places past the end solve to 0
    leaves = inside & ((np.arange(width)[None] + 1 < rows[:, None]) | ~last[:, None])
    d += np.where(leaves[:, :, None, None], step[:2, :2], 0)
    beside[:] = np.where(inside[:, 1:, None, None], step[:2, 2:], 0)
    end = np.flatnonzero(~last)
    r[end, rows[end] - 1] -= after[end] @ step[2:, :2]
    # the first state is known
    d[:, 0], r[:, 0] = np.eye(2), start
    r[:, 1:2] -= np.einsum("nba,nb->na", beside[:, 0], start)[:, None] if width > 1 else 0
    beside[:, :1] = 0
    return chain(d, beside, r)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = pdf["ys"].map(len).to_numpy()
    y = np.full((len(pdf), max(1, rows.max(initial=1))), np.nan)
    for i, ys in enumerate(pdf["ys"]):
        y[i, : len(ys)] = np.array(ys, float)
    return y, rows


def smooth_states(df: DataFrame, keys: Sequence[str], time: str, col: str, v: Variances = Variances(), piece: int = PIECE, into: tuple[str, str] = ("level", "slope")) -> DataFrame:
    """df with the smoothed level and slope of each row's series: the least-squares path through all its readings, before and after.

    Series are regular (complete_series makes them so); rows with null or non-finite readings get states too. A series without any reading has null ones,
    one with a single reading is level. Null keys are a series; times of a series must differ. Only pieces of `piece` rows, then a row a piece of one series, are in a task.
    """
    spark = df.sparkSession
    ship_package(spark)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    ranked = cut(with_rank(df.withColumn("_g", group), ["_g", time], "_i"))
    starts = ranked.groupBy("_g").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if(F.abs(F.col(col)) < float("inf")).alias("_known"))
    at = cut(ranked.select("_g", "_i", F.when(F.abs(F.col(col)) < float("inf"), F.col(col).cast("double")).alias("_y")).join(starts, "_g").withColumn("_p", F.floor((F.col("_i") - F.col("_first")) / piece)))
    pieces = at.groupBy("_g", "_p", "_first", "_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_y"))), lambda s: s["_y"]).alias("ys"))
    pieces = cut(pieces.withColumns({"first": F.col("_p") == 0, "last": (F.col("_p") + 1) * piece >= F.col("_n")}))

    def hand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, r = hand_on(*_arrays(pdf), pdf["first"].to_numpy(bool), pdf["last"].to_numpy(bool), v)
            yield pd.DataFrame({"f": pdf["_first"], "p": pdf["_p"], "m": list(m.reshape(-1, 16)), "r": list(r)})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        m, r = np.stack(pdf["m"].to_list()).reshape(-1, 4, 4), np.stack(pdf["r"].to_list())
        d, side = m[:, :2, :2].copy(), r[:, :2].copy()
        d[1:] += m[:-1, 2:, 2:]
        side[1:] += r[:-1, 2:]
        x = chain(d, m[:-1, :2, 2:], side)
        return pd.DataFrame({"f": pdf["f"], "p": pdf["p"], "start": list(x), "after": list(np.vstack([x[1:], np.zeros((1, 2))]))})

    few = pieces.select("_first", "_p", "ys", "first", "last").mapInPandas(hand, "f long, p long, m array<double>, r array<double>")
    ends = few.groupBy("f").applyInPandas(solve, "f long, p long, start array<double>, after array<double>")

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, rows = _arrays(pdf)
            start, after = (np.stack(pdf[c].to_list()) if len(pdf) else np.zeros((0, 2)) for c in ("start", "after"))
            x = inner_states(y, rows, pdf["last"].to_numpy(bool), start, after, v)
            yield pd.DataFrame({"_first": pdf["_first"], "_p": pdf["_p"], "level": [x[i, :n, 0] for i, n in enumerate(rows)], "slope": [x[i, :n, 1] for i, n in enumerate(rows)]})

    met = pieces.join(ends, (F.col("_first") == F.col("f")) & (F.col("_p") == F.col("p"))).select("_first", "_p", "ys", "last", "start", "after")
    found = met.mapInPandas(inner, "_first long, _p long, level array<double>, slope array<double>")
    found = found.select("_first", "_p", F.posexplode(F.arrays_zip("level", "slope")).alias("_at", "s"))
    found = found.select((F.col("_first") + F.col("_p") * piece + F.col("_at")).alias("_i"), F.col("s.level").alias("_level"), F.col("s.slope").alias("_slope"))
    known = at.select("_i", (F.col("_known") > 0).alias("_some"))
    out = ranked.join(known, "_i").join(found, "_i")
    return out.withColumns({into[0]: F.when(F.col("_some"), F.col("_level")), into[1]: F.when(F.col("_some"), F.col("_slope"))}).drop("_g", "_i", "_some", "_level", "_slope")


def impute_states(df: DataFrame, keys: Sequence[str], time: str, col: str, v: Variances = Variances(), period: int | None = None) -> DataFrame:
    """Nulls of a regular series take the smoothed level; with a period, that of the series without its means by phase, which are put back."""
    if period is None:
        out = smooth_states(df, keys, time, col, v, into=("_fit", "_drift"))
        return out.withColumn(col, F.coalesce(F.col(col).cast("double"), "_fit")).drop("_fit", "_drift")
    from pyspark.sql import Window

    phase = F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1, F.lit(period))
    out = df.withColumn("_phase", phase)
    out = out.withColumn("_season", F.coalesce(F.avg(col).over(Window.partitionBy(*keys, "_phase")), F.lit(0.0)))
    out = smooth_states(out.withColumn("_flat", F.col(col) - F.col("_season")), keys, time, "_flat", v, into=("_fit", "_drift"))
    return out.withColumn(col, F.coalesce(F.col(col).cast("double"), F.col("_fit") + F.col("_season"))).drop("_phase", "_season", "_flat", "_fit", "_drift")
