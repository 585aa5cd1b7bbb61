"""Time series by station: filling, smoothing, interpolation, winsorising, splits, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, small
from .ranks import group_quantiles


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _until_here(keys: Sequence[str], order: Sequence[str]) -> tuple:
    """Frames of all rows up to this one, in the order and from its end.

    A frame that reaches to the end of the partition would be gone through anew for each row; one from the start grows.
    """
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, 0)


def centred_mean(df: DataFrame, keys, order, col: str, n: int, into: str) -> DataFrame:
    """Mean of n rows around each; null where the window isn't full. Nulls inside are passed over."""
    half = n // 2
    w = _w(keys, order).rowsBetween(-half, n - 1 - half)
    return df.withColumn(into, F.when(F.count(F.lit(1)).over(w) == n, F.avg(col).over(w)))


def trailing_mean(df: DataFrame, keys, order, col: str, n: int, into: str) -> DataFrame:
    """Mean of the last n rows; the group's mean where there are fewer, null if one of n is null."""
    w, whole = _w(keys, order).rowsBetween(1 - n, 0), Window.partitionBy(*keys)
    rows, known = F.count(F.lit(1)).over(w), F.count(col).over(w)
    value = F.when(rows < n, F.avg(col).over(whole)).when(known == n, F.avg(col).over(w))
    return df.withColumn(into, value)


def fill_down_up(df: DataFrame, keys, order, cols: Sequence[str]) -> DataFrame:
    """Nulls take the last value before, else the first after."""
    down, up = _until_here(keys, order)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(down), F.last(c, ignorenulls=True).over(up)) for c in cols})


def complete_series(df: DataFrame, keys: Sequence[str], time: str, step: str = "INTERVAL 1 DAY") -> DataFrame:
    """Each id's whole regular timeline between its first and last time; without keys, one timeline."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b")).filter("_a IS NOT NULL")
    line = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(time))
    return line.join(df, [*keys, time], "left")


def interpolate_linear(df: DataFrame, keys, time: str, cols: Sequence[str]) -> DataFrame:
    """Nulls between known values lie on the line through them in time; beyond the ends they take the nearest.

    A series with fewer than two known values is filled down and up.
    """
    down, up = _until_here(keys, [time])
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    out = df
    for c in cols:
        at = F.when(F.col(c).isNotNull(), t)
        v0, t0 = F.last(c, ignorenulls=True).over(down), F.last(at, ignorenulls=True).over(down)
        v1, t1 = F.last(c, ignorenulls=True).over(up), F.last(at, ignorenulls=True).over(up)
        between = v0 + (v1 - v0) * (t - t0) / (t1 - t0)
        out = out.withColumn(c, F.coalesce(F.col(c), F.when(t1 > t0, between), v0, v1))
    return out


def fill_gaps_mean(df: DataFrame, keys, time: str, col: str, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """A complete timeline with the id's mean in its gaps."""
    full = complete_series(df, keys, time, step)
    return full.withColumn(col, F.coalesce(F.col(col), F.avg(col).over(Window.partitionBy(*keys))))


def decompose(df: DataFrame, keys, time: str, col: str, period: int) -> DataFrame:
    """trend (centred mean over a period), seasonal (mean of what is left by phase), remainder; additive."""
    half = period // 2
    order = _w(keys, [time])
    w = order.rowsBetween(-half, period - 1 - half)
    df = df.withColumn("phase", F.pmod(F.row_number().over(order) - 1, F.lit(period)))
    df = df.withColumn("trend", F.when(F.count(F.lit(1)).over(w) == period, F.avg(col).over(w)))
    df = df.withColumn("seasonal", F.avg(F.col(col) - F.col("trend")).over(Window.partitionBy(*keys, "phase")))
    return df.withColumn("remainder", F.col(col) - F.col("trend") - F.col("seasonal"))


def impute_seasonal(df: DataFrame, keys, time: str, col: str, period: int) -> DataFrame:
    """Nulls filled on the series without its phase means, which are then put back."""
    df = df.withColumn("_phase", F.pmod(F.row_number().over(_w(keys, [time])) - 1, F.lit(period)))
    df = df.withColumn("_season", F.coalesce(F.avg(col).over(Window.partitionBy(*keys, "_phase")), F.lit(0.0)))
    df = interpolate_linear(df.withColumn("_flat", F.col(col) - F.col("_season")), keys, time, ["_flat"])
    return df.withColumn(col, F.coalesce(F.col(col), F.col("_flat") + F.col("_season"))).drop("_phase", "_season", "_flat")


def upper_fence(col: str, k: float) -> Column:
    """Third quartile plus k interquartile ranges (quartiles interpolated), as an aggregate of one group."""
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))
    return q[1] + F.lit(k) * (q[1] - q[0])


def winsorise(df: DataFrame, cols: str | Sequence[str], k: float, keys: Sequence[str] = (), into: str | Sequence[str] | None = None) -> DataFrame:
    """Values cut off at the upper fence, of the station or of all: the third quartile plus k interquartile ranges (quartiles interpolated).

    The fences of all columns and stations are found together, and no station's values need be in one task (ranks.group_quantiles). Where
    a station has no finite value its values stay.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    names = [into] if isinstance(into, str) else list(into or cols)
    q = group_quantiles(df, keys, cols, (0.25, 0.75))
    q = cut(q.groupBy(*keys, "col").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "_q1"), (0.75, "_q3"))]))
    fence = F.col("_q3") + F.lit(k) * (F.col("_q3") - F.col("_q1"))
    if keys:
        wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("col") == c, fence)).alias(f"_fence_{c}") for c in cols])
        joined = df.join(small(wide), list(keys), "left")
    else:
        found = {r["col"]: r["f"] for r in q.select("col", fence.alias("f")).collect()}  # a row for each column
        joined = df.withColumns({f"_fence_{c}": F.lit(found.get(c)).cast("double") for c in cols})
    return joined.withColumns({n: F.when(F.col(c).isNotNull(), F.least(c, f"_fence_{c}")) for c, n in zip(cols, names, strict=True)}).drop(*[f"_fence_{c}" for c in cols])


def cut_off(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Values above a limit become null."""
    return df.withColumns({c: F.when(F.col(c) <= v, F.col(c)) for c, v in limits.items()})


def smooth_station_series(df: DataFrame, keys, time: str, col: str, k: float = 3.0, n: int = 3) -> DataFrame:
    """Winsorised by station, filled, smoothed by a centred mean, filled again at the ends."""
    df = fill_down_up(winsorise(df, col, k, keys), keys, [time], [col])
    return fill_down_up(centred_mean(df, keys, [time], col, n, f"{col}_smooth"), keys, [time], [f"{col}_smooth"])


def sequence_windows(df: DataFrame, keys, time: str, cols: Sequence[str], length: int) -> DataFrame:
    """The last `length` rows as an array, for rows that have so many."""
    w = _w(keys, [time]).rowsBetween(1 - length, 0)
    df = df.withColumn("window", F.collect_list(F.struct(time, *cols)).over(w))
    return df.filter(F.size("window") == length)


def date_split(df: DataFrame, date: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split: train, val or test, cut at shares of the sorted distinct dates."""
    dates = df.select(date).distinct()
    order = Window.orderBy(date)  # a row for each date of the calendar
    dates = dates.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    label = (
        F.when(F.col("_i") <= F.floor(F.col("_n") * train), "train")
        .when(F.col("_i") <= F.floor(F.col("_n") * (train + val)), "val")
        .otherwise("test")
    )
    return df.join(dates.select(date, label.alias("split")), date)


def station_split(df: DataFrame, keys, time: str, share: float = 0.8) -> DataFrame:
    """split: the first share of each station's rows in time is for training."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(_w(keys, [time]))
    return df.withColumn("split", F.when(i <= F.floor(n * share), "train").otherwise("test"))


def rolling_origin(df: DataFrame, year: str, test_years: Sequence[int], before: int = 3) -> DataFrame:
    """Rows once for each test year they serve, as test or as one of the years before."""
    tests = df.sparkSession.createDataFrame([(int(y),) for y in test_years], "test_year int")
    joined = df.join(F.broadcast(tests), F.col(year).between(F.col("test_year") - before, F.col("test_year")))
    return joined.withColumn("role", F.when(F.col(year) == F.col("test_year"), "test").otherwise("train"))


def subset_stations(df: DataFrame, stations: Sequence | None = None, first_k: int | None = None, dates: tuple | None = None, until=None, key: str = "tmsid", date: str = "date") -> DataFrame:
    """Rows of given stations or of the first k by id, between two dates (in either order) or up to one."""
    if stations is not None:
        df = df.filter(F.col(key).isin(list(stations)))
    if first_k is not None:
        df = df.join(df.select(key).distinct().orderBy(key).limit(first_k), key, "left_semi")
    if dates is not None:
        a, b = F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")
        df = df.filter(F.col(date).between(F.least(a, b), F.greatest(a, b)))
    return df.filter(F.col(date) <= F.lit(until).cast("date")) if until is not None else df


def space_time_samples(df: DataFrame, key: str, time: str, cols: Sequence[str], length: int, pairs: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """key, time, window, neighbours: a station's sequence with those of its neighbours up to the same time.

    pairs: key, neighbour, rank and relation features. neighbours is an array by rank of struct(rank, mask, features, window);
    mask is 0 where the neighbour has no full sequence then.
    """
    own = sequence_windows(df.select(key, time, *cols), [key], time, cols, length).select(key, time, "window")
    other = own.select(F.col(key).alias("neighbour"), time, F.col("window").alias("_w"))
    joined = own.join(pairs.select(key, "neighbour", "rank", *features), key).join(other, ["neighbour", time], "left")
    one = F.struct("rank", F.col("_w").isNotNull().cast("int").alias("mask"), *features, F.col("_w").alias("window"))
    return joined.groupBy(key, time).agg(F.first("window").alias("window"), F.sort_array(F.collect_list(one)).alias("neighbours"))
