"""Joins, set operations and reshaping of feature tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import small


def merge_features(base: DataFrame, features: Sequence[DataFrame], keys: Sequence[str], units: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Left joins of feature tables on one set of keys, then unit changes. Each feature table has a row a key at most, and is never broadcast."""
    out = reduce(lambda a, b: a.join(b.hint("merge"), list(keys), "left"), features, base)
    return out.withColumns({c: F.col(c) * F.lit(a) + F.lit(b) for c, (a, b) in (units or {}).items()})


def compare_full(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full join with _old, _new and _diff columns; what is missing on a side counts as 0."""
    a = old.select(*keys, *[F.col(c).alias(f"{c}_old") for c in cols])
    b = new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in cols])
    out = a.join(b, list(keys), "full").fillna(0.0, [f"{c}_{s}" for c in cols for s in ("old", "new")])
    return out.withColumns({f"{c}_diff": F.col(f"{c}_new") - F.col(f"{c}_old") for c in cols})


def bind_columns(left: DataFrame, right: DataFrame, key: str = "gid") -> DataFrame:
    """Columns side by side, by key: rows have no position in Spark."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key)


def in_bins(stays: DataFrame, start: Column, end: Column, into: str = "_bin") -> tuple[DataFrame, int]:
    """Stays once for each stretch of days that they touch, and the stretch's length: their mean length, so that rows at most treble.

    Stays without a start or an end, or that end before they start, have no row.
    """
    rows = stays.withColumns({"_a": F.unix_date(F.to_date(start)), "_z": F.unix_date(F.to_date(end))}).filter(F.col("_a") <= F.col("_z"))
    mean = rows.agg(F.avg(F.col("_z") - F.col("_a") + 1)).first()[0]
    width = max(1, math.ceil(mean or 1))
    return rows.withColumn(into, F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width)))).drop("_a", "_z"), width


def interval_join(
    readings: DataFrame, stays: DataFrame, key: str, date: str = "date", start: str = "date_start", end: str = "date_end", site: str | None = None, how: str = "inner"
) -> DataFrame:
    """Readings taken during a stay of their site (site: the stays' column, if it isn't named as the readings'); left_semi: the readings alone.

    Stays are laid out over stretches of days as long as a stay is on average, and a reading meets those of its own stretch: a site with many stays is as many
    keys as it has stretches. Readings without a date, and stays without both ends, meet nothing.
    """
    s, width = in_bins(stays.withColumnRenamed(site or key, "_key"), F.col(start), F.col(end))
    here = F.floor(F.unix_date(F.to_date(F.col(date))) / width)
    on = (F.col(key) == F.col("_key")) & (here == F.col("_bin")) & F.col(date).between(F.to_date(start), F.to_date(end))
    out = readings.join(s, on, how)
    return out if how == "left_semi" else out.drop("_key", "_bin")


def lagged_join(df: DataFrame, yearly: DataFrame, year: str, lag: int = 1, how: str = "left") -> DataFrame:
    """Each row with the values of so many years before its own. The yearly table, wide as a rule, is never broadcast."""
    shifted = yearly.withColumn(year, F.col(year) + F.lit(lag)).hint("merge")
    return df.join(shifted, [*[c for c in df.columns if c in yearly.columns and c != year], year], how)


def lookup_first(df: DataFrame, table: DataFrame, key: str, value: str, order: Sequence) -> DataFrame:
    """Each row with the first match in the table; the table is reduced to a row a key before the join."""
    o = F.struct(*order) if len(order) > 1 else order[0]
    return df.join(table.groupBy(key).agg(F.min_by(value, o).alias(value)), key, "left")


def cross_branches(*tables: DataFrame) -> DataFrame:
    """All combinations of dimension tables; small ones are broadcast."""
    return reduce(lambda a, b: a.crossJoin(small(b)), tables)


def date_by_position(df: DataFrame, keys: Sequence[str], order: Sequence, dates: DataFrame, into: str = "date") -> DataFrame:
    """The i-th row of each group with the i-th of the dates (one column, any order, each counted once); null beyond the last."""
    name = dates.columns[0]
    calendar = dates.select(F.col(name).alias(into)).distinct()
    calendar = calendar.withColumn("_i", F.row_number().over(Window.orderBy(into)))  # a row for each date of the calendar
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(small(calendar), "_i", "left").drop("_i")


def map_layers(df: DataFrame, codes: Mapping[int, int], col: str = "layer", into: str = "class") -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return df.withColumn(into, pairs[F.col(col)])


def replicate(df: DataFrame, years: Sequence[int], into: str = "year") -> DataFrame:
    return df.withColumn(into, F.explode(F.array(*[F.lit(int(y)) for y in years])))


def stack_typed(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Union by name with a column that says which table; absent columns are null."""
    parts = [df.withColumn("type", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_long(df: DataFrame, keys: Sequence[str], pattern: str, fields: Sequence[str], value: str = "value") -> DataFrame:
    """Wide to long: columns that match, with the pattern's groups as fields."""
    import re

    cols = [c for c in df.columns if c not in keys and re.search(pattern, c)]
    long = df.unpivot(list(keys), cols, "_name", value)
    return long.withColumns({f: F.regexp_extract("_name", pattern, i) for i, f in enumerate(fields, 1)}).drop("_name")


def to_long_dated(df: DataFrame, keys: Sequence[str], value: str = "value", into: str = "date") -> DataFrame:
    """Wide to long with the date that ends each column's name (yyyyMMdd)."""
    long = to_long(df, keys, r"(\d{8})$", ["_text"], value)
    return long.withColumn(into, F.to_date("_text", "yyyyMMdd")).drop("_text")


def to_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, value: str, prefix: str = "") -> DataFrame:
    """Long to wide over known values, in one pass."""
    cells = [F.first(F.when(F.col(name) == F.lit(v), F.col(value)), ignorenulls=True).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*cells)


def uncount(df: DataFrame, n: Column | str) -> DataFrame:
    """Each row so many times; rows of 0 or null go."""
    n = F.col(n) if isinstance(n, str) else n
    return df.filter(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))
