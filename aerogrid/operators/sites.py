"""Site histories: cleaning, segments, moves, expansion to years and days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import haversine_m

ORDER = ("site_type", "year", "date_start")


def rectify_year(df: DataFrame, field: str) -> DataFrame:
    """year_end and month_end of a date, and year_rect: the next year from June on."""
    d = F.col(field)
    rect = F.when(F.month(d) < 6, F.year(d)).otherwise(F.year(d) + 1)
    return df.withColumns({"year_end": F.year(d), "month_end": F.month(d), "year_rect": rect})


def fill_date(date: Column | str, year: Column | str, start: bool) -> Column:
    """The date, or the year's first (1 January, 1:00) or last (31 December, 23:00) local hour if it is null."""
    y = F.col(year) if isinstance(year, str) else year
    month, day, hour = (1, 1, 1) if start else (12, 31, 23)
    filled = F.make_timestamp_ntz(y, *[F.lit(v) for v in (month, day, hour, 0, 0)])
    return F.coalesce(F.col(date) if isinstance(date, str) else date, filled)


def clean_site_history(df: DataFrame, exclude: str = r"-[1-9]$") -> DataFrame:
    """One row for each stay of a site, with both dates filled.

    Sites whose type matches `exclude` go; of rows equal in site, type, dates and coordinates the first (by year) stays.
    A site's first start and last end are filled from their years; an open end in between takes the end of the next
    row; rows that still have no start go.
    """
    df = df.filter(~F.coalesce(F.col("site_type").rlike(exclude), F.lit(False)))
    kind = Window.partitionBy("tmsid", "site_type")
    df = df.withColumn("year_max", F.max("year").over(kind))
    same = Window.partitionBy("tmsid", "site_type", "date_start", "date_end", "coords").orderBy("year")
    df = df.withColumn("_rn", F.row_number().over(same)).filter("_rn = 1")
    ordered = Window.partitionBy("tmsid").orderBy(F.col("year").asc(), F.col("date_start").asc_nulls_first(), "site_type", "coords")
    whole = Window.partitionBy("tmsid")
    df = df.withColumns({"_rn": F.row_number().over(ordered), "_n": F.count(F.lit(1)).over(whole), "_next": F.lead("date_end").over(ordered)})
    start = F.when(F.col("_rn") == 1, fill_date("date_start", "year", True)).otherwise(F.col("date_start"))
    end = F.when(F.col("_rn") == F.col("_n"), fill_date("date_end", "year_max", False)).otherwise(F.coalesce("date_end", "_next"))
    df = df.withColumns({"date_start": start, "date_end": end})
    return df.filter(F.col("date_start").isNotNull()).drop("_rn", "_n", "_next")


def assign_segment_id(df: DataFrame, order: Sequence[str] = ("date_start",)) -> DataFrame:
    """tmsid2: the site's id and a letter by order within the site; fails beyond 26 segments."""
    n = F.row_number().over(Window.partitionBy("tmsid").orderBy(*order))
    letter = F.when(n <= 26, F.char(n + 64)).otherwise(F.raise_error(F.lit("more than 26 segments of a site")))
    return df.withColumn("tmsid2", F.concat("tmsid", letter))


def relocation_distance(df: DataFrame, order: Sequence[str] = ("date_start",)) -> DataFrame:
    """moved_m: metres from the site's place before; null for its first."""
    w = Window.partitionBy("tmsid").orderBy(*order)
    return df.withColumn("moved_m", haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"))


def last_segments(df: DataFrame, order: Sequence[str] = ("date_start",)) -> DataFrame:
    w = Window.partitionBy("tmsid").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def original_distance(segments: DataFrame, original: DataFrame, order: Sequence[str] = ("date_start",)) -> DataFrame:
    """Metres between a site's last place and its place in the register."""
    last = last_segments(segments, order).select("tmsid", "lon", "lat")
    first = original.select("tmsid", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    return last.join(first, "tmsid").withColumn("shift_m", haversine_m("lon0", "lat0", "lon", "lat"))


def expand_years(df: DataFrame, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """A row for each calendar year of an interval; backwards if it ends before it starts."""
    return df.withColumn("year", F.explode(F.sequence(F.year(start), F.year(end))))


def extend_grid(df: DataFrame, keys: Sequence[str], start: str = "date_start", end: str = "date_end") -> DataFrame:
    """A row for each day of each distinct interval; intervals that are open or reversed have none."""
    df = sane_intervals(df.select(*keys, start, end).distinct(), start, end)
    return df.withColumn("date", F.explode(F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))))


def sane_intervals(df: DataFrame, start: str = "date_start", end: str = "date_end") -> DataFrame:
    return df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))


def clip_to_year(df: DataFrame, year: int, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """Days of an interval that lie in a calendar year."""
    first, last = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))
    a, b = F.greatest(F.to_date(start), first), F.least(F.to_date(end), last)
    return df.filter(a <= b).withColumn("date", F.explode(F.sequence(a, b, F.expr("INTERVAL 1 DAY"))))


def valid_in_year(df: DataFrame, year: Column | str, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """Rows in operation on 1 January of their year."""
    first = F.make_date(F.col(year) if isinstance(year, str) else year, F.lit(1), F.lit(1))
    return df.filter((F.to_date(start) < first) & (F.to_date(end) >= first))


def space_time(sites: DataFrame, readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expanded sites with their aggregated readings; sites without readings stay."""
    return sites.join(readings, list(keys), "left")


def first_row(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group in an order that must be complete."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def collapse_by_interval(df: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = "date", start: str = "date_start", end: str = "date_end") -> DataFrame:
    """One row a key: the mean of values read while the site was there, its first start and last end.

    Keys with one row keep their values as they are.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("_n", n)
    inside = F.col(date).between(F.to_date(start), F.to_date(end)) | (F.col("_n") == 1)
    df = df.withColumns({v: F.when(inside, F.col(v)) for v in values})
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.min(start).alias(start), F.max(end).alias(end))


def fill_coordinates(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Nulls take the site's first known value."""
    w = Window.partitionBy("tmsid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w)) for c in cols})


def date_chunks(spark, first: str, last: str, days: int = 30) -> DataFrame:
    """chunk, start, end: spans of so many days, the last ending on `last`."""
    one = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL {int(days)} DAYS)) AS start")
    w = Window.orderBy("start")  # a row for each chunk of the calendar
    end = F.coalesce(F.date_sub(F.lead("start").over(w), 1), F.lit(last).cast("date"))
    return one.select(F.row_number().over(w).alias("chunk"), "start", end.alias("end"))
