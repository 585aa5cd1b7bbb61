"""Column functions: sentinels, text parsing, units, recoding, calendar."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Emission weight of each facility class; other classes weigh 0.
CLASS_WEIGHTS = {1: 80.0, 2: 20.0, 3: 10.0, 4: 2.0, 5: 0.25}


def null_sentinel(df: DataFrame, cols: Sequence[str], keep: Callable[[Column], Column] = lambda c: c >= 0) -> DataFrame:
    """Values that fail `keep` become null; NULL stays NULL."""
    return df.withColumns({c: F.when(keep(F.col(c)), F.col(c)) for c in cols})


def exclude_pattern(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose text doesn't match; null text is kept."""
    return df.filter(~F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def include_pattern(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose text matches; null text is dropped."""
    return df.filter(F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def convert_units(df: DataFrame, units: Mapping[str, tuple[float, float]]) -> DataFrame:
    """value * factor + offset for each named column."""
    return df.withColumns({c: F.col(c) * F.lit(a) + F.lit(b) for c, (a, b) in units.items()})


def recode(df: DataFrame, col: str, levels: Mapping[str, str], into: str, rank: str | None = None) -> DataFrame:
    """Map text to labels (unmapped text becomes null), with the label's rank in the order given."""
    order = list(dict.fromkeys(levels.values()))
    label = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col(col)]
    df = df.withColumn(into, label)
    if rank:
        df = df.withColumn(rank, F.create_map(*[F.lit(x) for i, v in enumerate(order, 1) for x in (v, i)])[F.col(into)])
    return df


def class_weight(col: Column | str) -> Column:
    """Weight of a facility class given as a number with any text around it."""
    number = F.regexp_extract(col, r"(\d+)", 1).cast("int")
    out = F.lit(0.0)
    for k, w in CLASS_WEIGHTS.items():
        out = F.when(number == k, F.lit(w)).otherwise(out)
    return out


def parse_lat_lon(col: Column | str) -> Column:
    """struct(lat, lon) of "lat, lon" text; what isn't a number becomes null."""
    parts = F.split(col, r",\s*")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon")
    )


def strict_double(col: str) -> Column:
    """A number, failing the job on text that isn't one; null stays null."""
    got = F.col(col).try_cast("double")
    return F.when(F.col(col).isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit(f"{col}: not a number: "), F.col(col)))).otherwise(got)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def reject_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df, failing the job at the first row with a null in cols."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return df.filter(F.when(bad, F.raise_error(F.lit("null in model input"))).otherwise(F.lit(True)))


def fill_missing_features(df: DataFrame, wanted: Sequence[str], value: float = 0.0) -> DataFrame:
    """Columns that are wanted but absent, with one value."""
    return df.withColumns({c: F.lit(value) for c in wanted if c not in df.columns})


def align_features(train: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables cut to their common columns, in the order of train."""
    shared = [c for c in train.columns if c in set(grid.columns) and c not in keys]
    return train.select(*shared), grid.select(*[k for k in keys if k in grid.columns], *shared), shared


def pick(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), pattern: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Columns by name (absent ones are passed over), prefix or regular expression, without those in drop."""
    import re

    chosen = [
        c
        for c in df.columns
        if c not in drop and (c in names or any(c.startswith(p) for p in prefixes) or pattern is not None and re.search(pattern, c))
    ]
    return df.select(*chosen)


def rename_by(df: DataFrame, change: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: change(c) for c in df.columns if change(c) != c})


def relocate(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns first, the rest in their order."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def bin_by_breaks(col: Column | str, breaks: Sequence[float], right: bool = True) -> Column:
    """Number (from 1) of the interval between breaks that holds the value; null outside. Closed on the right, or left."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(breaks[:-1], breaks[1:], strict=True), 1):
        inside = (c > a) & (c <= b) if right else (c >= a) & (c < b)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def calendar_features(df: DataFrame, col: str) -> DataFrame:
    """year, month, day, day of year, weekday (Sunday 1), ISO weekday (Monday 1), is_weekend, season sine and cosine."""
    d = F.col(col)
    turn = F.lit(2 * math.pi) * F.dayofyear(d) / F.lit(365.25)
    return df.withColumns(
        {
            "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "doy": F.dayofyear(d), "wday": F.dayofweek(d),
            "iso_wday": F.weekday(d) + 1, "is_weekend": (F.weekday(d) >= 5).cast("int"), "season_sin": F.sin(turn), "season_cos": F.cos(turn),
        }
    )


def one_hot(df: DataFrame, col: str, values: Sequence, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{v}": (F.col(col) == F.lit(v)).cast("int") for v in values})


def terrain_features(df: DataFrame, dsm: str = "dsm", dem: str = "dem") -> DataFrame:
    return df.withColumn("height", F.col(dsm) - F.col(dem))


def log_target(col: Column | str, shift: float = 0.1) -> Column:
    return F.log((F.col(col) if isinstance(col, str) else col) + F.lit(shift))


def unlog_target(col: Column | str, shift: float = 0.1) -> Column:
    return F.exp(col) - F.lit(shift)


def quality_ok(qa: Column | str) -> Column:
    """The low three bits say clear, and bits 8 to 11 say best quality."""
    q = F.col(qa) if isinstance(qa, str) else qa
    return (q.bitwiseAND(F.lit(7)) == 1) & (F.shiftright(q, 8).bitwiseAND(F.lit(15)) == 0)
