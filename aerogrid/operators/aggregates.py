"""Aggregations: daily and annual summaries, profiles, weighted means, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarize_daily(df: DataFrame, keys: Sequence[str] = ("tmsid2", "tmsid"), date: str = "date", values: Sequence[str] = ("pm10", "pm25")) -> DataFrame:
    """Daily means with flags: 1 if a day has fewer than 18 rows or more than 6 nulls."""
    n = F.count(F.lit(1))
    flags = [((n < 18) | (F.count_if(F.col(v).isNull()) > 6)).cast("int").alias(f"{v}_flag") for v in values]
    return df.groupBy(*keys, date).agg(*[F.avg(v).alias(v) for v in values], *flags)


def summarize_annual(df: DataFrame, keys: Sequence[str] = ("tmsid2", "tmsid"), date: str = "date", values: Sequence[str] = ("pm10", "pm25")) -> DataFrame:
    """Annual means, the rows and the distinct days they rest on."""
    return df.groupBy(*keys, F.year(date).alias("year")).agg(
        *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_rows"), F.count_distinct(date).alias("ndays")
    )


def weighted_mean(value: str, weight: Column) -> Column:
    """Mean with weights; null without any. A row counts only if both its value and weight are known."""
    known = F.col(value).isNotNull() & weight.isNotNull()
    total = F.sum(F.when(known, weight))
    return F.sum(F.when(known, F.col(value) * weight)) / F.nullif(total, F.lit(0.0))


def inverse_variance_mean(df: DataFrame, keys: Sequence[str], value: str, unc: str, into: str) -> DataFrame:
    return df.groupBy(*keys).agg(weighted_mean(value, F.lit(1.0) / (F.col(unc) * F.col(unc) + F.lit(1e-6))).alias(into))


def circular_mean(col: str) -> Column:
    """Mean direction in degrees from 0."""
    s, c = F.avg(F.sin(F.radians(col))), F.avg(F.cos(F.radians(col)))
    return F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0))


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, n_missing) of every column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "n_missing")


def range_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max) of finite values."""
    finite = [F.when(~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf")), F.col(c).cast("double")).alias(c) for c in cols]
    ends = df.select(*finite).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max")) for c in cols])
    return ends.select(F.inline(rows))


def enough_observations(df: DataFrame, key: str, cols: Sequence[str], least: int) -> DataFrame:
    """Rows of stations with at least so many values of some column."""
    counts = df.groupBy(key).agg(*[F.count(c).alias(f"n_{c}") for c in cols])
    return df.join(counts.filter(F.greatest(*[F.col(f"n_{c}") for c in cols]) >= least), key, "left_semi")


def weighted_sources(zones: DataFrame, sources: DataFrame, key: str, weight: Column, into: str) -> DataFrame:
    """The summed weight of each zone's sources, 0 for zones without."""
    sums = sources.groupBy(key).agg(F.sum(weight).alias(into))
    return zones.join(sums, key, "left").withColumn(into, F.coalesce(into, F.lit(0.0)))


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_ranked(df: DataFrame, by: Column, n: int) -> DataFrame:
    """The n best rows, and all that tie with the last; the rank limit is applied in each task before they meet."""
    return df.withColumn("_r", F.rank().over(Window.orderBy(by))).filter(F.col("_r") <= n).drop("_r")


def joined_names(df: DataFrame, name: str, order: Column, into: str, sep: str = ", ") -> DataFrame:
    """All names in one text, in an order; for short lists."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(name).alias("n"))))
    return df.agg(F.array_join(F.transform(pairs, lambda p: p["n"]), sep).alias(into))


def best_station(df: DataFrame, key: str, cols: Sequence[str], strict: int) -> DataFrame:
    """The station with most values: of those that reach `strict` in every column, if any, else of all."""
    counts = df.groupBy(key).agg(*[F.count(c).alias(f"n_{c}") for c in cols])
    enough = F.least(*[F.col(f"n_{c}") for c in cols]) >= strict if len(cols) > 1 else F.col(f"n_{cols[0]}") >= strict
    total = sum((F.col(f"n_{c}") for c in cols[1:]), F.col(f"n_{cols[0]}"))
    return counts.withColumns({"strict": enough.cast("int"), "total": total}).orderBy(F.desc("strict"), F.desc("total"), key).limit(1)


def best_parameters(df: DataFrame, group: Sequence[str], params: str, metric: str) -> DataFrame:
    """The parameters of the least metric in each group; ties go to the smaller parameters."""
    key = F.struct(F.col(metric), F.col(params))
    return df.groupBy(*group).agg(F.min_by(params, key).alias(params), F.min(metric).alias(metric))
