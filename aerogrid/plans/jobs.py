"""Whole jobs: monitor tables, feature tables, comparisons. Each is one plan over all years, months and radii."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calendar_features
from ..operators import aggregates, joins, raster, series, sites, spatial
from ..operators.raster import Frame
from ..scratch import cut, small

#: A site's stays in time; of two that start together, by their coordinates.
STAY_ORDER = ("date_start", "coords")


def annual_monitors(history: DataFrame, readings: DataFrame) -> DataFrame:
    """Stays of sites, expanded to years, with the year's means of each segment."""
    stays = sites.assign_segment_id(sites.relocation_distance(sites.clean_site_history(history), STAY_ORDER), STAY_ORDER)
    yearly = aggregates.summarize_annual(readings)
    out = sites.space_time(sites.expand_years(stays.drop("year")), yearly.drop("tmsid"), ["tmsid2", "year"])
    return out.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def annual_original(register: DataFrame, history: DataFrame, readings: DataFrame) -> DataFrame:
    """The year's means of each site at its place in the register, with the metres to its last real place."""
    stays = sites.clean_site_history(history)
    shift = sites.original_distance(stays, register, STAY_ORDER).select("tmsid", "shift_m")
    yearly = aggregates.summarize_annual(readings, keys=["tmsid"])
    return register.join(shift, "tmsid", "left").join(yearly, "tmsid", "left")


def daily_monitors(history: DataFrame, readings: DataFrame, since: int = 2010) -> DataFrame:
    """Days of each stay from a year on, with the day's means and flags."""
    stays = sites.assign_segment_id(sites.relocation_distance(sites.clean_site_history(history), STAY_ORDER), STAY_ORDER)
    days = sites.extend_grid(stays, ["tmsid", "tmsid2", "lon", "lat", "moved_m"]).filter(F.year("date") >= since)
    daily = aggregates.summarize_daily(readings)
    out = sites.space_time(days.select("tmsid", "tmsid2", "lon", "lat", "moved_m", "date"), daily.drop("tmsid"), ["tmsid2", "date"])
    return out.filter(F.col("lon").isNotNull())


def annual_features(
    base: DataFrame, roads: DataFrame, terrain: DataFrame, landuse: DataFrame, emitters: DataFrame, clip: DataFrame, aod: DataFrame, blh: DataFrame,
    fine: Frame, coarse: Frame, radii: Sequence[float], classes: Sequence[int], bw: float, lag: int = 1, coverage: str = "exact",
) -> DataFrame:
    """base (site, segment or grid rows with x, y and year) with all yearly features.

    d_road (km), emission (gaussian, clipped), dem, dsm, mtpi and mtpi_1km belong to places and are computed once a place; land use
    (by radius and class) is that of `lag` years before; aod and blh are the year's medians, 0 where there is none.
    terrain: row, col and a column for each of its four; landuse: year, row, col, class; aod, blh: row, col, year, value.
    """
    base = base.withColumn("place", F.struct(F.col("x").alias("px"), F.col("y").alias("py")))
    places = base.select("place", "x", "y").distinct()
    by_place = [
        spatial.nearest_segment(places, roads, "place", "link_id").select("place", (F.col("distance") / 1000.0).alias("d_road")),
        spatial.kernel_sources(places, emitters, "place", bw, "gaussian", clip=clip),
        raster.sample_at_points(places, terrain, fine, ("dem", "dsm", "mtpi", "mtpi_1km")).drop("x", "y"),
    ]
    land = raster.zonal_fraction(places, "place", radii, landuse, fine, classes, by=["year"], coverage=coverage)
    out = joins.lagged_join(joins.merge_features(base, by_place, ["place"]), land, "year", lag)
    for name, cells in (("aod", aod), ("blh", blh)):
        yearly = raster.cell_median(cells, ["row", "col", "year"]).withColumnsRenamed({"row": "_row", "col": "_col", "year": "_year", "value": name})
        here = (coarse.row("y") == F.col("_row")) & (coarse.col("x") == F.col("_col")) & (F.col("year") == F.col("_year"))
        out = out.join(yearly, here, "left").drop("_row", "_col", "_year").fillna(0.0, [name])
    return out.drop("place")


def daily_features(monitors: DataFrame, dynamic: Sequence[DataFrame], yearly: DataFrame, key: str, static: Sequence[str]) -> DataFrame:
    """Daily monitors with what changes by day, and the named yearly features of the day's year."""
    monitors = cut(monitors)
    days = small(monitors.select(key, "date").distinct())
    dynamic = [d.join(days, [key, "date"], "left_semi") for d in dynamic]
    out = joins.merge_features(monitors, list(dynamic), [key, "date"]).withColumn("year", F.year("date"))
    return out.join(yearly.select(key, "year", *static), [key, "year"], "left")


def landuse_comparison(points: DataFrame, key: str, old: DataFrame, new: DataFrame, frame: Frame, radii: Sequence[float], classes: Sequence[int], coverage: str = "exact") -> DataFrame:
    """key, class, radius, type (old, new, diff), fraction."""
    def long(cells: DataFrame) -> DataFrame:
        wide = raster.zonal_fraction(points, key, radii, cells, frame, classes, coverage=coverage)
        return joins.to_long(wide, [key], r"landuse_frac_(\d+)_(\d+)", ["class", "radius"], "fraction")

    both = joins.compare_full(long(old), long(new), [key, "class", "radius"], ["fraction"])
    pick = lambda c: both.select(key, "class", "radius", F.col(f"fraction_{c}").alias("fraction"))
    return joins.stack_typed({c: pick(c) for c in ("old", "new", "diff")})


def smoothed_daily(readings: DataFrame, features: DataFrame, values: Sequence[str] = ("pm10", "pm25"), key: str = "tmsid2", k: float = 1.5, n: int = 7, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Daily means of the sites that have features, with calendar columns and, for each value, <v>_a (winsorised by the fence of all),
    <v>_<n> and <v>_a<n> (centred means of n days of either; null where the window isn't full).

    With limits, values above them are cut off first. features: key, year and more.
    """
    daily = readings.groupBy(key, "date").agg(*[F.avg(v).alias(v) for v in values])
    daily = cut(series.cut_off(daily, dict(limits)) if limits else daily)
    out = calendar_features(daily, "date").select(*daily.columns, "year", "month", "day", F.col("iso_wday").alias("weekday"), "is_weekend")
    out = series.winsorise(out, values, k, into=[f"{v}_a" for v in values])
    for v in values:
        for c in (v, f"{v}_a"):
            out = series.centred_mean(out, [key], ["date"], c, n, f"{c}_{n}" if c == v else f"{c}{n}")
    return out.join(features, [key, "year"])
