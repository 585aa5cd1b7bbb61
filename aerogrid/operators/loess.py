"""Seasonal-trend decomposition by local regression, of series of any length in overlapping stretches.

What a value of the decomposition depends on lies within a distance that its windows give. A stretch is worked out with so many rows on either side, as
arrays, and only its own rows are kept; so stretches are independent, and what they keep is what the whole series would give.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, small
from ..session import ship_package
from .ranks import group_quantiles, with_rank

#: Rows of a stretch, and values of windows that are laid out at once.
STRETCH, LAID_OUT = 20_000, 2_000_000


def odd(n: float) -> int:
    """The next odd whole number."""
    n = int(np.ceil(n))
    return n + 1 - n % 2


def local_lines(y: np.ndarray, w: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
    """Local lines at places (0 is y's first, and they may lie beyond its ends) through the q nearest values, by tricube weights times w.

    The window is centred where it can be and else lies at the end. With fewer than q values all count, and the weights reach farther by half of what lacks.
    Where no weight is left a value stays as it is (beyond the ends: the nearest).
    """
    n = len(y)
    width = min(q, n)
    out = np.empty(len(at))
    for i in range(0, len(at), max(1, LAID_OUT // width)):
        x = at[i : i + max(1, LAID_OUT // width)]
        start = np.clip(x - width // 2, 0, n - width)
        places = start[:, None] + np.arange(width)
        far = np.abs(places - x[:, None]).astype(float)
        h = far.max(1, keepdims=True) + max(0, (q - n) // 2)
        near = np.where(far <= 0.001 * h, 1.0, np.where(far <= 0.999 * h, (1 - (far / np.maximum(h, 1e-300)) ** 3) ** 3, 0.0)) * w[places]
        total = near.sum(1)
        some = total > 0
        near /= np.where(some, total, 1)[:, None]
        mean = (near * places).sum(1)
        off = places - mean[:, None]
        spread = (near * off * off).sum(1)
        tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (x - mean) / np.where(spread > 0, spread, 1), 0.0)
        out[i : i + len(x)] = np.where(some, (near * (1 + tilt[:, None] * off) * y[places]).sum(1), y[np.clip(x, 0, n - 1)])
    return out


def running_mean(y: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y - y[0])])
    return (total[n:] - total[:-n]) / n + y[0]


def season_and_trend(y: np.ndarray, w: np.ndarray, trend: np.ndarray, period: int, windows: tuple[int, int, int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend after so many rounds from a trend: phases smoothed, their own trend taken out, and what is left smoothed to the new trend."""
    n, (season, low, slow) = len(y), windows
    one, all_ = np.ones(n), np.arange(n)
    seasonal = np.zeros(n)
    for _ in range(rounds):
        flat, cycle = y - trend, np.empty(n + 2 * period)
        for p in range(period):
            own = flat[p::period]
            cycle[p::period] = local_lines(own, w[p::period], season, np.arange(-1, len(own) + 1))
        passed = running_mean(running_mean(running_mean(cycle, period), period), 3)
        seasonal = cycle[period : period + n] - local_lines(passed, one, low, all_)
        trend = local_lines(y - seasonal, w, slow, all_)
    return seasonal, trend


def _reach(period: int, windows: tuple[int, int, int], rounds: int) -> int:
    """How far off a value can matter."""
    season, low, slow = windows
    return rounds * (period * (season // 2 + 2) + period + 2 + low // 2 + slow // 2 + 2)


def decompose_loess(
    df: DataFrame, keys: Sequence[str], time: str, col: str, period: int, season: int = 11, slow: int | None = None, low: int | None = None, rounds: int = 2,
    robust: int = 0, stretch: int = STRETCH,
) -> DataFrame:
    """df with trend, seasonal and remainder of each regular series, which add up to its values.

    season, slow, low: widths of the windows over a phase's values, for the trend (12 periods at first), and for the season's own trend (a period); even
    ones are widened by one. robust: how often values are weighed anew by how far off they lie (bisquare of six medians of the absolute remainder). Null or
    non-finite values fail the job: fill them first. Series shorter than two periods have a null decomposition. Null keys are a series; times of a series must differ.

    A task holds a stretch with its surroundings, not a series; each robust round is a pass and a median of all series (ranks.group_quantiles).
    """
    if period < 2 or season < 3:
        raise ValueError("a period has 2 rows at least, a season's window 3")
    ship_package(df.sparkSession)
    windows = odd(season), odd(low or period), odd(slow or 12 * period)
    reach = _reach(period, windows, rounds)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    bad = F.raise_error(F.concat(F.lit("a series has an unknown value at "), F.col(time).cast("string")))
    ranked = cut(with_rank(df.withColumns({"_g": group, "_y": F.when(F.abs(F.col(col)) < float("inf"), F.col(col).cast("double")).otherwise(bad)}), ["_g", time], "_i"))
    firsts = ranked.groupBy("_g").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = cut(ranked.select("_g", "_i", "_y").join(firsts, "_g").filter(F.col("_n") >= 2 * period).select("_first", (F.col("_i") - F.col("_first")).alias("_at"), "_y"))
    state = rows.withColumns({"_w": F.lit(1.0), "_trend": F.lit(0.0)})

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        y, w, trend = (pdf[c].to_numpy() for c in ("_y", "_w", "_trend"))
        seasonal, trend = season_and_trend(y, w, trend, period, windows, rounds)
        own = (pdf["_at"] // stretch == pdf["_s"]).to_numpy()
        return pd.DataFrame({"_first": pdf["_first"], "_at": pdf["_at"], "_y": y, "_trend": trend, "_seasonal": seasonal})[own]

    for again in range(robust + 1):
        near = F.sequence(F.floor(F.greatest(F.col("_at") - reach, F.lit(0)) / stretch), F.floor((F.col("_at") + reach) / stretch))
        # a stretch that no row of its own has isn't there
        dealt = state.withColumn("_s", F.explode(near)).join(small(rows.select("_first", F.floor(F.col("_at") / stretch).alias("_s")).distinct()), ["_first", "_s"])
        done = cut(dealt.groupBy("_first", "_s").applyInPandas(work, "_first long, _at long, _y double, _trend double, _seasonal double"))
        if again == robust:
            break
        off = done.withColumn("_off", F.abs(F.col("_y") - F.col("_trend") - F.col("_seasonal")))
        six = group_quantiles(off, ["_first"], ["_off"], [0.5]).select("_first", (6 * F.col("value")).alias("_six"))
        u = F.col("_off") / F.nullif(F.col("_six"), F.lit(0.0))
        weight = F.when(F.col("_off") <= 0.001 * F.col("_six"), 1.0).when(F.col("_off") <= 0.999 * F.col("_six"), F.pow(1 - u * u, F.lit(2))).otherwise(0.0)
        state = cut(off.join(small(six), "_first").select("_first", "_at", "_y", weight.alias("_w"), "_trend"))
    found = done.select((F.col("_first") + F.col("_at")).alias("_i"), F.col("_trend").alias("trend"), F.col("_seasonal").alias("seasonal"), (F.col("_y") - F.col("_trend") - F.col("_seasonal")).alias("remainder"))
    return ranked.join(found, "_i", "left").drop("_g", "_i", "_y")
