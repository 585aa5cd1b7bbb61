"""Queries on readings and site histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import loess
from ..operators import series as W
from ..operators import sites as H
from ..operators import states as Z
from ..scratch import new_path
from ..sources import readers as S
from . import jobs
from .tables import Tables

Q: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


DAILY_SQL = """SELECT tmsid2, tmsid, date, AVG(pm10) AS pm10, AVG(pm25) AS pm25,
  CASE WHEN COUNT(*) < 18 OR COUNT(*) - COUNT(pm10) > 6 THEN 1 ELSE 0 END AS pm10_flag,
  CASE WHEN COUNT(*) < 18 OR COUNT(*) - COUNT(pm25) > 6 THEN 1 ELSE 0 END AS pm25_flag
  FROM {measurements} GROUP BY tmsid2, tmsid, date"""


@query(DAILY_SQL)
def daily_station_summary(t: Tables):
    return A.summarize_daily(S.clean_measurements(t.raw_measurements))


@query("SELECT event_id, tmsid, tmsid2, datehour, date, pm10, pm25 FROM {measurements}")
def read_measurements(t: Tables):
    return S.clean_measurements(t.raw_measurements).select("event_id", "tmsid", "tmsid2", "datehour", "date", "pm10", "pm25")


@query("SELECT event_id, CASE WHEN pm10 > -990 THEN pm10 END AS pm10, CASE WHEN pm25 > -990 THEN pm25 END AS pm25 FROM {raw_measurements}")
def null_sentinel_low(t: Tables):
    return C.null_sentinel(t.raw_measurements, ["pm10", "pm25"], lambda c: c > -990).select("event_id", "pm10", "pm25")


@query("SELECT s_suppkey, site_type FROM {site_history} WHERE NOT COALESCE(regexp_matches(site_type, 'port|-[1-9]$'), FALSE)")
def exclude_site_types(t: Tables):
    return C.exclude_pattern(t.site_history, "site_type", "port|-[1-9]$").select("s_suppkey", "site_type")


@query("SELECT s_suppkey, site_type FROM {site_history} WHERE regexp_matches(site_type, '^urban')")
def include_site_types(t: Tables):
    return C.include_pattern(t.site_history, "site_type", "^urban").select("s_suppkey", "site_type")


@query("SELECT link_id, road_type FROM {roads} WHERE road_type NOT IN ('002', '004') AND road_use = 0")
def filter_roads(t: Tables):
    return t.roads.filter(~F.col("road_type").isin("002", "004") & (F.col("road_use").cast("string") == "0")).select("link_id", "road_type")


@query("SELECT eid, emission FROM {emitters} WHERE status = '01'")
def operating_emitters(t: Tables):
    return t.emitters.filter(F.col("status") == "01").select("eid", "emission")


@query("SELECT event_id, date FROM {measurements} WHERE strftime(date, '%Y-%m') = '2024-01' AND year(date) = 2024")
def month_branch(t: Tables):
    return t.measurements.filter(F.col("date").between(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).select("event_id", "date")


@query("SELECT stay, tmsid FROM {stays} WHERE date_start < make_date(2024, 1, 1) + 5 AND date_end >= make_date(2024, 1, 1)")
def valid_at_date(t: Tables):
    shifted = t.stays.withColumns({"date_start": F.date_sub("date_start", 5)})
    return H.valid_in_year(shifted, F.lit(2024)).select("stay", "tmsid")


@query("SELECT s_suppkey FROM {site_history} WHERE date_start IS NOT NULL AND date_end IS NOT NULL AND date_start <= date_end")
def sane_intervals(t: Tables):
    return H.sane_intervals(t.site_history).select("s_suppkey")


@query("SELECT event_id, pm10, pm25 FROM {measurements} WHERE pm10 IS NOT NULL AND pm25 IS NOT NULL")
def drop_missing(t: Tables):
    return t.measurements.dropna(subset=["pm10", "pm25"]).select("event_id", "pm10", "pm25")


@query("SELECT eid, x, y FROM {emitters} WHERE x BETWEEN 902000 AND 909000 AND y BETWEEN 1901000 AND 1912000")
def bounding_box(t: Tables):
    return S.window_read(t.emitters, 902000, 909000, 1901000, 1912000).select("eid", "x", "y")


@query("SELECT pm10, pm25, tmsid FROM {measurements}")
def tidy_select(t: Tables):
    return C.pick(t.measurements, names=["tmsid", "absent"], prefixes=["pm"], pattern="^nothing$", drop=["tmsid2"])


@query("SELECT event_id AS id, pm10 AS mean_pm10, pm25 AS mean_pm25 FROM {measurements}")
def rename_columns(t: Tables):
    df = t.measurements.select(F.col("event_id").alias("id"), F.col("pm10").alias("mean.pm10"), F.col("pm25").alias("mean.pm25"))
    return C.relocate(C.rename_by(df, lambda c: c.replace("mean.", "mean_")), ["mean_pm10", "id"])


@query("SELECT event_id, pm10 - 273.15::DOUBLE AS pm10, pm25 * 0.5::DOUBLE AS pm25 FROM {measurements}")
def convert_units(t: Tables):
    return C.convert_units(t.measurements, {"pm10": (1.0, -273.15), "pm25": (0.5, 0.0)}).select("event_id", "pm10", "pm25")


@query(
    """SELECT s_suppkey, CASE site_type WHEN 'urban' THEN 'city' WHEN 'urban-1' THEN 'city' WHEN 'road' THEN 'roadside' WHEN 'rural' THEN 'country' END AS kind,
    CASE site_type WHEN 'urban' THEN 1 WHEN 'urban-1' THEN 1 WHEN 'road' THEN 2 WHEN 'rural' THEN 3 END AS kind_rank FROM {site_history}"""
)
def recode_site_types(t: Tables):
    levels = {"urban": "city", "urban-1": "city", "road": "roadside", "rural": "country"}
    return C.recode(t.site_history, "site_type", levels, "kind", "kind_rank").select("s_suppkey", "kind", "kind_rank")


@query("SELECT eid, CASE kind WHEN 'class 1' THEN 80.0 WHEN 'class 2' THEN 20.0 WHEN 'class 3' THEN 10.0 WHEN 'class 4' THEN 2.0 WHEN 'class 5' THEN 0.25 ELSE 0.0 END::DOUBLE AS weight FROM {emitters}")
def class_weights(t: Tables):
    return t.emitters.select("eid", C.class_weight("kind").alias("weight"))


@query("SELECT s_suppkey, lat, lon FROM {site_history}")
def parse_coordinates(t: Tables):
    return t.site_history.select("s_suppkey", C.parse_lat_lon("coords").alias("p")).select("s_suppkey", "p.lat", "p.lon")


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS number FROM customer")
def strict_numbers(t: Tables):
    return t.customer.withColumn("c_text", F.col("c_custkey").cast("string")).select("c_custkey", C.strict_double("c_text").alias("number"))


@query("SELECT eid, emission, 0.0::DOUBLE AS lc_a, 0.0::DOUBLE AS lc_b FROM {emitters}")
def fill_feature_columns(t: Tables):
    return C.fill_missing_features(t.emitters.select("eid", "emission"), ["emission", "lc_a", "lc_b"])


@query("SELECT event_id, COALESCE(pm10, 0) AS pm10 FROM {measurements}")
def fill_nulls(t: Tables):
    return t.measurements.fillna(0.0, ["pm10"]).select("event_id", "pm10")


@query("SELECT eid, x, y, emission FROM {emitters}")
def reject_null_input(t: Tables):
    return C.reject_nulls(C.require_columns(t.emitters, ["x", "emission"]), ["x", "emission"]).select("eid", "x", "y", "emission")


@query("SELECT pid AS gid, x, y FROM {points}")
def align_features(t: Tables):
    grid = t.points.withColumnRenamed("pid", "gid").withColumn("extra", F.lit(1))
    return C.align_features(t.emitters.select("x", "emission", "y"), grid, ["gid"])[1]


@query("SELECT event_id, tmsid, date FROM {measurements} WHERE tmsid IN (SELECT DISTINCT tmsid FROM {measurements} ORDER BY tmsid LIMIT 5) AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND date <= DATE '2024-01-18'")
def subset_stations(t: Tables):
    return W.subset_stations(t.measurements, first_k=5, dates=("2024-01-20", "2024-01-05"), until="2024-01-18").select("event_id", "tmsid", "date")


@query("SELECT event_id, CASE WHEN pm10 > 0 AND pm10 <= 2000 THEN 1 WHEN pm10 > 2000 AND pm10 <= 5000 THEN 2 WHEN pm10 > 5000 AND pm10 <= 10000 THEN 3 END AS bin FROM {measurements}")
def bin_by_breaks(t: Tables):
    return t.measurements.select("event_id", C.bin_by_breaks("pm10", [0, 2000, 5000, 10000]).alias("bin"))


@query(
    """SELECT DISTINCT date, year(date)::INT AS year, month(date)::INT AS month, day(date)::INT AS day, dayofyear(date)::INT AS doy, (dayofweek(date) + 1)::INT AS wday,
    isodow(date)::INT AS iso_wday, (CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END)::INT AS is_weekend,
    round(sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE), 6) AS season_sin, round(cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE), 6) AS season_cos FROM {measurements}"""
)
def calendar_features(t: Tables):
    df = C.calendar_features(t.measurements.select("date").distinct(), "date")
    return df.withColumns({c: F.round(c, 6) for c in ("season_sin", "season_cos")})


@query("SELECT stay, (stay % 3 = 0)::INT AS d_0, (stay % 3 = 1)::INT AS d_1, (stay % 3 = 2)::INT AS d_2, x - y AS height FROM {stays}")
def derived_features(t: Tables):
    df = C.one_hot(t.stays.withColumn("m", F.col("stay") % 3), "m", [0, 1, 2], "d_")
    return C.terrain_features(df, "x", "y").select("stay", "d_0", "d_1", "d_2", "height")


@query("SELECT event_id, round(ln(pm10 + 0.1), 5) AS l, round(exp(ln(pm10 + 0.1)) - 0.1, 3) AS back FROM {measurements} WHERE pm10 IS NOT NULL")
def log_target(t: Tables):
    df = t.measurements.filter("pm10 IS NOT NULL").withColumn("l", C.log_target("pm10"))
    return df.select("event_id", F.round("l", 5).alias("l"), F.round(C.unlog_target("l"), 3).alias("back"))


@query("SELECT count(*)::BIGINT AS n FROM {aod} WHERE qa & 7 = 1 AND (qa >> 8) & 15 = 0")
def quality_bits(t: Tables):
    return t.aod.filter(C.quality_ok("qa")).agg(F.count(F.lit(1)).alias("n"))


# --- aggregates ---------------------------------------------------------------------------------------------------
@query("SELECT tmsid2, tmsid, year(date)::INT AS year, AVG(pm10) AS pm10, AVG(pm25) AS pm25, COUNT(*) AS n_rows, COUNT(DISTINCT date) AS ndays FROM {measurements} GROUP BY ALL")
def annual_summary(t: Tables):
    return A.summarize_annual(t.measurements)


@query("SELECT tmsid, date, AVG(pm10) AS pm10 FROM {measurements} GROUP BY tmsid, date")
def simple_daily_mean(t: Tables):
    return t.measurements.groupBy("tmsid", "date").agg(F.avg("pm10").alias("pm10"))


@query("SELECT year(o_orderdate)::INT AS year, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def count_by_year(t: Tables):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


@query("SELECT tmsid, AVG(pm10) AS pm10, COUNT(*) AS n FROM {measurements} GROUP BY tmsid")
def sql_group_mean(t: Tables):
    return S.query_tables(t.spark, "SELECT tmsid, AVG(pm10) AS pm10, COUNT(*) AS n FROM {m} GROUP BY tmsid", m=t.measurements)


@query("SELECT 'pm10' AS \"column\", COUNT(*) - COUNT(pm10) AS n_missing FROM {measurements} UNION ALL SELECT 'pm25', COUNT(*) - COUNT(pm25) FROM {measurements}")
def missing_profile(t: Tables):
    return A.missing_profile(t.measurements.select("pm10", "pm25"))


@query("SELECT 'pm10' AS \"column\", MIN(pm10) AS min, MAX(pm10) AS max FROM {measurements} UNION ALL SELECT 'pm25', MIN(pm25), MAX(pm25) FROM {measurements}")
def range_report(t: Tables):
    return A.range_report(t.measurements, ["pm10", "pm25"])


@query("SELECT event_id, tmsid2 FROM {measurements} WHERE tmsid2 IN (SELECT tmsid2 FROM {measurements} GROUP BY tmsid2 HAVING COUNT(pm10) >= 300 OR COUNT(pm25) >= 300)")
def enough_observations(t: Tables):
    return A.enough_observations(t.measurements, "tmsid2", ["pm10", "pm25"], 300).select("event_id", "tmsid2")


@query("SELECT tmsid, median(lon) AS lon, median(lat) AS lat FROM {stays} GROUP BY tmsid")
def median_coordinates(t: Tables):
    return t.stays.groupBy("tmsid").agg(F.median("lon").alias("lon"), F.median("lat").alias("lat"))


@query("SELECT tmsid, stay, lon FROM (SELECT *, row_number() OVER (PARTITION BY tmsid ORDER BY date_start, stay) AS rn FROM {stays}) WHERE rn = 1")
def keep_first(t: Tables):
    return A.keep_first(t.stays, ["tmsid"], ["date_start", "stay"]).select("tmsid", "stay", "lon")


@query("SELECT tmsid, COUNT(DISTINCT date) AS n_dates FROM {measurements} GROUP BY tmsid")
def unique_counts(t: Tables):
    return t.measurements.groupBy("tmsid").agg(F.count_distinct("date").alias("n_dates"))


@query("SELECT (SELECT COUNT(*) FROM {points}) AS n_points, (SELECT AVG(x) FROM {points}) AS mean_x, (SELECT COUNT(*) FROM {emitters}) AS n_emitters")
def comparison_summary(t: Tables):
    a = t.points.agg(F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("mean_x"))
    return a.crossJoin(t.emitters.agg(F.count(F.lit(1)).alias("n_emitters")))


@query("SELECT string_agg(p_name, ', ' ORDER BY p_retailprice DESC, p_name) AS names FROM (SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_name LIMIT 10)")
def top_names(t: Tables):
    top = t.part.orderBy(F.desc("p_retailprice"), "p_name").limit(10)
    return A.joined_names(top, "p_name", -F.col("p_retailprice"), "names")


@query("SELECT eid, emission FROM (SELECT *, rank() OVER (ORDER BY emission DESC) AS r FROM {emitters}) WHERE r <= 10")
def top_with_ties(t: Tables):
    return A.top_ranked(t.emitters, F.desc("emission"), 10).select("eid", "emission")


@query(
    """SELECT tmsid2, n_pm10, n_pm25, (CASE WHEN least(n_pm10, n_pm25) >= 250 THEN 1 ELSE 0 END)::INT AS strict, n_pm10 + n_pm25 AS total
    FROM (SELECT tmsid2, COUNT(pm10) AS n_pm10, COUNT(pm25) AS n_pm25 FROM {measurements} GROUP BY tmsid2) ORDER BY strict DESC, total DESC, tmsid2 LIMIT 1"""
)
def best_station(t: Tables):
    return A.best_station(t.measurements, "tmsid2", ["pm10", "pm25"], 250)


@query("SELECT p_brand, arg_min(p_name, (p_retailprice, p_name)) AS p_name, MIN(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand")
def best_parameters(t: Tables):
    return A.best_parameters(t.part, ["p_brand"], "p_name", "p_retailprice")


@query("SELECT tmsid, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS direction, mean FROM (SELECT tmsid, degrees(atan2(AVG(sin(radians(pm10))), AVG(cos(radians(pm10))))) AS d, AVG(pm10) AS mean FROM {measurements} WHERE pm10 IS NOT NULL GROUP BY tmsid)")
def wind_means(t: Tables):
    return t.measurements.filter("pm10 IS NOT NULL").groupBy("tmsid").agg(F.round(A.circular_mean("pm10"), 4).alias("direction"), F.avg("pm10").alias("mean"))


# --- site histories -----------------------------------------------------------------------------------------------
CLEAN = """f AS (SELECT *, max(year) OVER (PARTITION BY tmsid, site_type) AS year_max FROM {site_history} WHERE NOT coalesce(regexp_matches(site_type, '-[1-9]$'), FALSE)),
d AS (SELECT *, row_number() OVER (PARTITION BY tmsid, site_type, date_start, date_end, coords ORDER BY year) AS rn FROM f),
o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY tmsid) AS n, lead(date_end) OVER w AS nx FROM d WHERE rn = 1
  WINDOW w AS (PARTITION BY tmsid ORDER BY year, date_start NULLS FIRST, site_type NULLS FIRST, coords)),
clean AS (SELECT * FROM (SELECT tmsid, site_type, year, year_max, coords, lon, lat,
  CASE WHEN r = 1 THEN coalesce(date_start::TIMESTAMP, make_timestamp(year, 1, 1, 1, 0, 0)) ELSE date_start::TIMESTAMP END AS date_start,
  CASE WHEN r = n THEN coalesce(date_end::TIMESTAMP, make_timestamp(year_max, 12, 31, 23, 0, 0)) ELSE coalesce(date_end, nx)::TIMESTAMP END AS date_end
  FROM o) WHERE date_start IS NOT NULL)"""
SEGMENTS = CLEAN + """, seg AS (SELECT *, tmsid || chr((64 + row_number() OVER (PARTITION BY tmsid ORDER BY date_start, coords))::INT) AS tmsid2,
  lag(lon) OVER (PARTITION BY tmsid ORDER BY date_start, coords) AS lon0, lag(lat) OVER (PARTITION BY tmsid ORDER BY date_start, coords) AS lat0 FROM clean)"""
HAVERSINE = "round(2 * 6371008.8::DOUBLE * asin(sqrt(least(1, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))), 2)"
STAY = ["tmsid", "site_type", "year", "year_max", "coords", "lon", "lat", "date_start", "date_end"]


def _history(t: Tables):
    return t.site_history.drop("s_suppkey")


def _segments(t: Tables):
    clean = H.clean_site_history(_history(t))
    return H.assign_segment_id(H.relocation_distance(clean, ["date_start", "coords"]), ["date_start", "coords"])


@query("SELECT s_suppkey, year(date_end)::INT AS year_end, month(date_end)::INT AS month_end, (CASE WHEN month(date_end) < 6 THEN year(date_end) ELSE year(date_end) + 1 END)::INT AS year_rect FROM {site_history}")
def rectify_year(t: Tables):
    return H.rectify_year(t.site_history, "date_end").select("s_suppkey", "year_end", "month_end", "year_rect")


@query("SELECT s_suppkey, coalesce(date_start::TIMESTAMP, make_timestamp(year, 1, 1, 1, 0, 0)) AS a, coalesce(date_end::TIMESTAMP, make_timestamp(year, 12, 31, 23, 0, 0)) AS b FROM {site_history}")
def fill_dates(t: Tables):
    return t.site_history.select("s_suppkey", H.fill_date("date_start", "year", True).alias("a"), H.fill_date("date_end", "year", False).alias("b"))


@query(f"WITH {CLEAN} SELECT * FROM clean")
def clean_site_history(t: Tables):
    return H.clean_site_history(_history(t)).select(*STAY)


@query(f"WITH {SEGMENTS} SELECT tmsid, tmsid2, date_start, {HAVERSINE} AS moved_m FROM seg")
def segments_and_moves(t: Tables):
    return _segments(t).select("tmsid", "tmsid2", "date_start", F.round("moved_m", 2).alias("moved_m"))


@query(f"WITH {CLEAN}, l AS (SELECT *, row_number() OVER (PARTITION BY tmsid ORDER BY date_start DESC, coords DESC) AS k FROM clean), j AS (SELECT l.tmsid, l.lon, l.lat, r.lon AS lon0, r.lat AS lat0 FROM l JOIN {{original_sites}} r USING (tmsid) WHERE k = 1) SELECT tmsid, {HAVERSINE} AS shift_m FROM j")
def original_distance(t: Tables):
    clean = H.clean_site_history(_history(t))
    return H.original_distance(clean, t.original_sites, ["date_start", "coords"]).select("tmsid", F.round("shift_m", 2).alias("shift_m"))


@query("SELECT o_orderkey, unnest(range(year(o_orderdate), year(o_orderdate + INTERVAL 900 DAYS) + 1))::INT AS year FROM orders")
def expand_years(t: Tables):
    df = t.orders.withColumn("b", F.expr("o_orderdate + INTERVAL 900 DAYS"))
    return H.expand_years(df, "o_orderdate", "b").select("o_orderkey", "year")


@query("SELECT stay, tmsid, date_start, date_end, unnest(generate_series(date_start::TIMESTAMP, date_end::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT stay, tmsid, date_start, date_end FROM {stays} WHERE date_start <= date_end)")
def extend_grid(t: Tables):
    return H.extend_grid(t.stays, ["stay", "tmsid"])


@query("SELECT stay, unnest(generate_series(greatest(date_start, DATE '2024-01-01')::TIMESTAMP, least(date_end, DATE '2024-12-31')::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM {stays} WHERE greatest(date_start, DATE '2024-01-01') <= least(date_end, DATE '2024-12-31')")
def clip_to_year(t: Tables):
    return H.clip_to_year(t.stays, 2024).select("stay", "date")


@query("SELECT s.stay, s.tmsid, s.date, d.pm10 FROM (SELECT stay, tmsid, unnest(generate_series(date_start::TIMESTAMP, date_end::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM {stays} WHERE date_start <= date_end) s LEFT JOIN (SELECT tmsid, date, AVG(pm10) AS pm10 FROM {measurements} GROUP BY tmsid, date) d USING (tmsid, date)")
def station_space_time(t: Tables):
    days = H.extend_grid(t.stays, ["stay", "tmsid"]).select("stay", "tmsid", "date")
    return H.space_time(days, t.measurements.groupBy("tmsid", "date").agg(F.avg("pm10").alias("pm10")), ["tmsid", "date"]).select("stay", "tmsid", "date", "pm10")


@query("SELECT tmsid, stay FROM (SELECT *, row_number() OVER (PARTITION BY tmsid ORDER BY date_start, stay) AS rn FROM {stays}) WHERE rn = 1")
def collapse_first(t: Tables):
    return H.first_row(t.stays, ["tmsid"], ["date_start", "stay"]).select("tmsid", "stay")


@query(
    """WITH j AS (SELECT d.tmsid, d.date, d.pm10, s.date_start, s.date_end, count(*) OVER (PARTITION BY d.tmsid, d.date) AS n
      FROM {daily} d JOIN {stays} s ON d.tmsid = s.tmsid)
    SELECT tmsid, date, round(AVG(CASE WHEN n = 1 OR date BETWEEN date_start AND date_end THEN pm10 END), 6) AS pm10, MIN(date_start) AS date_start, MAX(date_end) AS date_end FROM j GROUP BY tmsid, date"""
)
def collapse_by_interval(t: Tables):
    rows = t.daily.select("tmsid", "date", "pm10").join(t.stays.select("tmsid", "date_start", "date_end"), "tmsid")
    return H.collapse_by_interval(rows, ["tmsid", "date"], ["pm10"]).withColumn("pm10", F.round("pm10", 6))


@query("SELECT s.s_suppkey, s.tmsid, m.year, m.pm10 FROM {site_history} s LEFT JOIN (SELECT tmsid, year(date)::INT AS year, AVG(pm10) AS pm10 FROM {measurements} GROUP BY 1, 2) m USING (tmsid)")
def simple_site_means(t: Tables):
    m = t.measurements.groupBy("tmsid", F.year("date").alias("year")).agg(F.avg("pm10").alias("pm10"))
    return t.site_history.select("s_suppkey", "tmsid").join(m, "tmsid", "left").select("s_suppkey", "tmsid", "year", "pm10")


@query("SELECT s_suppkey, tmsid, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN lon END, first_value(CASE WHEN s_suppkey % 3 = 0 THEN lon END IGNORE NULLS) OVER (PARTITION BY tmsid ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lon FROM {site_history}")
def fill_coordinates(t: Tables):
    df = t.site_history.withColumn("lon", F.when(F.col("s_suppkey") % 3 == 0, F.col("lon")))
    return H.fill_coordinates(df, ["lon"], ["s_suppkey"]).select("s_suppkey", "tmsid", "lon")


@query(
    """WITH e AS (SELECT MIN(date) AS a, MAX(date) AS b FROM {measurements}), s AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 10 DAY))::DATE AS start, b FROM e)
    SELECT row_number() OVER (ORDER BY start)::INT AS chunk, start, coalesce(lead(start) OVER (ORDER BY start) - 1, b) AS "end" FROM s"""
)
def date_chunks(t: Tables):
    ends = t.measurements.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return H.date_chunks(t.spark, str(ends["a"]), str(ends["b"]), 10)


# --- joins, sets, shapes ------------------------------------------------------------------------------------------
@query("SELECT p.pid, p.x, d.v1 * 0.001::DOUBLE AS v1, e.v2 FROM {points} p LEFT JOIN (SELECT s_suppkey AS pid, s_acctbal AS v1 FROM supplier WHERE s_suppkey % 2 = 0) d USING (pid) LEFT JOIN (SELECT s_suppkey AS pid, s_nationkey AS v2 FROM supplier WHERE s_suppkey % 3 = 0) e USING (pid)")
def merge_features(t: Tables):
    s = t.supplier.withColumn("pid", F.col("s_suppkey"))
    a = s.filter("s_suppkey % 2 = 0").select("pid", F.col("s_acctbal").alias("v1"))
    b = s.filter("s_suppkey % 3 = 0").select("pid", F.col("s_nationkey").alias("v2"))
    return J.merge_features(t.points.select("pid", "x"), [a, b], ["pid"], {"v1": (0.001, 0.0)}).select("pid", "x", "v1", "v2")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS na, b.n AS nb FROM (SELECT user_id AS k, COUNT(*) AS n FROM events GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k")
def full_join(t: Tables):
    a = t.events.groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("na"))
    return a.join(t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("nb")), "k", "full")


@query(
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0)::DOUBLE AS v_old, coalesce(b.v, 0)::DOUBLE AS v_new, coalesce(b.v, 0)::DOUBLE - coalesce(a.v, 0)::DOUBLE AS v_diff
    FROM (SELECT row AS k, COUNT(*) AS v FROM {landuse} WHERE class < 3 GROUP BY 1) a FULL JOIN (SELECT row AS k, COUNT(*) AS v FROM {landuse_old} WHERE class = 5 GROUP BY 1) b ON a.k = b.k"""
)
def compare_full(t: Tables):
    count = lambda df: df.groupBy(F.col("row").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return J.compare_full(count(t.landuse.filter("class < 3")), count(t.landuse_old.filter("class = 5")), ["k"], ["v"])


@query("SELECT p.pid AS gid, p.x, p.y, s.lon, s.lat FROM {points} p JOIN {stays} s ON p.pid = s.stay")
def bind_columns(t: Tables):
    return J.bind_columns(t.points.withColumnRenamed("pid", "gid"), t.stays.select(F.col("stay").alias("gid"), "x", "lon", "lat"))


@query("SELECT m.event_id, s.stay FROM {measurements} m JOIN {stays} s ON m.tmsid = s.tmsid AND m.date BETWEEN s.date_start AND s.date_end")
def interval_join(t: Tables):
    return J.interval_join(t.measurements.select("event_id", "tmsid", "date"), t.stays.select("tmsid", "stay", "date_start", "date_end"), "tmsid").select("event_id", "stay")


@query("SELECT a.k, a.year, b.v FROM (SELECT o_custkey AS k, year(o_orderdate)::INT AS year FROM orders GROUP BY 1, 2) a LEFT JOIN (SELECT o_custkey AS k, year(o_orderdate)::INT + 1 AS year, SUM(round(o_totalprice * 100)) AS v FROM orders GROUP BY 1, 2) b USING (k, year)")
def lagged_join(t: Tables):
    yearly = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).alias("v"))
    return J.lagged_join(yearly.select("k", "year"), yearly, "year").select("k", "year", "v")


@query("SELECT event_id FROM {measurements} WHERE tmsid IN (SELECT tmsid FROM {stays} WHERE stay % 5 = 0)")
def key_list_filter(t: Tables):
    return t.measurements.join(t.stays.filter("stay % 5 = 0").select("tmsid"), "tmsid", "left_semi").select("event_id")


@query("SELECT DISTINCT n_nationkey, r_regionkey, n_regionkey = r_regionkey AS own FROM nation, region")
def branch_product(t: Tables):
    df = J.cross_branches(t.nation.select("n_nationkey", "n_regionkey"), t.region.select("r_regionkey"))
    return df.select("n_nationkey", "r_regionkey", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


@query("SELECT m.event_id, l.stay FROM {measurements} m LEFT JOIN (SELECT tmsid, arg_min(stay, (date_start, stay)) AS stay FROM {stays} GROUP BY tmsid) l USING (tmsid)")
def lookup_first(t: Tables):
    return J.lookup_first(t.measurements.select("event_id", "tmsid"), t.stays.select("tmsid", "stay", "date_start"), "tmsid", "stay", ["date_start", "stay"]).select("event_id", "stay")


@query("SELECT row, col, CASE class WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 50 END AS code FROM {landuse}")
def map_layers(t: Tables):
    return J.map_layers(t.landuse, {0: 10, 1: 20, 2: 50}, "class", "code").select("row", "col", "code")


@query("SELECT pid, x, NULL::DOUBLE AS emission, 'points' AS type FROM {points} UNION ALL SELECT eid, x, emission, 'emitters' FROM {emitters}")
def stack_typed(t: Tables):
    return J.stack_typed({"points": t.points.select("pid", "x"), "emitters": t.emitters.select(F.col("eid").alias("pid"), "x", "emission")})


@query("SELECT pid, yr AS year FROM {points}, (VALUES (2015), (2020), (2024)) v(yr)")
def replicate_years(t: Tables):
    return J.replicate(t.points.select("pid"), [2015, 2020, 2024])


@query("SELECT tmsid, date, 'pm10' AS name, 'pm' AS kind, pm10 AS value FROM {daily} UNION ALL SELECT tmsid, date, 'pm25', 'pm', pm25 FROM {daily}")
def wide_to_long(t: Tables):
    return J.to_long(t.daily.select("tmsid", "date", "pm10", "pm25"), ["tmsid", "date"], r"^((pm)\d+)$", ["name", "kind"])


@query("SELECT k.tmsid2, d.date, v.pm10 AS value FROM (SELECT DISTINCT tmsid2 FROM {daily}) k CROSS JOIN (SELECT DISTINCT date FROM {daily}) d LEFT JOIN {daily} v ON v.tmsid2 = k.tmsid2 AND v.date = d.date")
def long_wide_long(t: Tables):
    """All dates become columns (the calendar is as long as the table's span of days) and rows again."""
    rows = t.daily.withColumn("d", F.date_format("date", "yyyyMMdd"))
    dates = [r["d"] for r in rows.select("d").distinct().orderBy("d").collect()]
    return J.to_long_dated(J.to_wide(rows, ["tmsid2"], "d", dates, "pm10", "pm10_"), ["tmsid2"])


@query("SELECT tmsid2, MAX(CASE WHEN date = DATE '2024-01-05' THEN pm10 END) AS \"d_2024-01-05\", MAX(CASE WHEN date = DATE '2024-01-06' THEN pm10 END) AS \"d_2024-01-06\" FROM {daily} GROUP BY tmsid2")
def long_to_wide(t: Tables):
    return J.to_wide(t.daily.withColumn("d", F.col("date").cast("string")), ["tmsid2"], "d", ["2024-01-05", "2024-01-06"], "pm10", "d_")


@query(
    """WITH g AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
    c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM {measurements}))
    SELECT s_nationkey, s_suppkey, date FROM g LEFT JOIN c USING (i)"""
)
def date_by_position(t: Tables):
    rows = t.supplier.select("s_nationkey", "s_suppkey")
    return J.date_by_position(rows, ["s_nationkey"], ["s_suppkey"], t.measurements.select("date")).select("s_nationkey", "s_suppkey", "date")


@query("SELECT s_suppkey, unnest(range(1, s_suppkey % 4 + 1))::INT AS copy FROM supplier WHERE s_suppkey % 4 > 0")
def uncount(t: Tables):
    return J.uncount(t.supplier, F.col("s_suppkey") % 4).select("s_suppkey", "copy")


# --- series -------------------------------------------------------------------------------------------------------
@query("SELECT tmsid2, date, lag(pm10) OVER w AS before, lead(pm10) OVER w AS after, row_number() OVER w AS i, count(*) OVER (PARTITION BY tmsid2) AS n, min(year(date)) OVER (PARTITION BY tmsid2) AS first_year FROM {daily} WINDOW w AS (PARTITION BY tmsid2 ORDER BY date)")
def lag_lead(t: Tables):
    from pyspark.sql import Window

    w, g = Window.partitionBy("tmsid2").orderBy("date"), Window.partitionBy("tmsid2")
    return t.daily.select("tmsid2", "date", F.lag("pm10").over(w).alias("before"), F.lead("pm10").over(w).alias("after"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(g).alias("n"), F.min(F.year("date")).over(g).alias("first_year"))


@query("SELECT tmsid2, date, round(CASE WHEN count(*) OVER w = 3 THEN avg(pm10) OVER w END, 3) AS m FROM {daily} WINDOW w AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def centred_mean(t: Tables):
    return W.centred_mean(t.daily, ["tmsid2"], ["date"], "pm10", 3, "m").select("tmsid2", "date", F.round("m", 3).alias("m"))


@query("SELECT event_id, round(CASE WHEN count(*) OVER w < 7 THEN avg(pm10) OVER (PARTITION BY tmsid2) WHEN count(pm10) OVER w = 7 THEN avg(pm10) OVER w END, 3) AS m FROM {measurements} WINDOW w AS (PARTITION BY tmsid2 ORDER BY datehour, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def trailing_mean(t: Tables):
    return W.trailing_mean(t.measurements, ["tmsid2"], ["datehour", "event_id"], "pm10", 7, "m").select("event_id", F.round("m", 3).alias("m"))


FILL = "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY {1} ORDER BY {2} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({0} IGNORE NULLS) OVER (PARTITION BY {1} ORDER BY {2} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("SELECT event_id, " + FILL.format("pm10", "tmsid2", "datehour, event_id") + " AS pm10 FROM {measurements}")
def fill_down_up(t: Tables):
    return W.fill_down_up(t.measurements, ["tmsid2"], ["datehour", "event_id"], ["pm10"]).select("event_id", "pm10")


#: All days of all stations, with gaps in the values.
SPARSE = "(SELECT tmsid2, date, CASE WHEN day(date) % 3 <> 0 THEN pm10 END AS pm10 FROM {daily})"
LINE = f"(SELECT e.tmsid2, e.date, s.pm10 FROM (SELECT tmsid2, unnest(generate_series(MIN(date)::TIMESTAMP, MAX(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM {SPARSE} GROUP BY tmsid2) e LEFT JOIN {SPARSE} s USING (tmsid2, date))"


def _sparse(t: Tables):
    return t.daily.select("tmsid2", "date", F.when(F.dayofmonth("date") % 3 != 0, F.col("pm10")).alias("pm10"))


@query(f"SELECT * FROM {LINE}")
def complete_series(t: Tables):
    return W.complete_series(_sparse(t), ["tmsid2"], "date").select("tmsid2", "date", "pm10")


@query(f"SELECT date, SUM(CASE WHEN pm10 IS NULL THEN 0 ELSE 1 END)::BIGINT AS n FROM (SELECT e.date, s.pm10 FROM (SELECT unnest(generate_series(MIN(date)::TIMESTAMP, MAX(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM {SPARSE}) e LEFT JOIN {SPARSE} s USING (date)) GROUP BY date")
def complete_globally(t: Tables):
    return W.complete_series(_sparse(t), [], "date").groupBy("date").agg(F.count("pm10").alias("n"))


@query(
    f"""WITH l AS {LINE}, k AS (SELECT tmsid2, date, pm10, (epoch(date::TIMESTAMP) / 86400)::BIGINT AS d,
      last_value(pm10 IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN pm10 IS NOT NULL THEN (epoch(date::TIMESTAMP) / 86400)::BIGINT END IGNORE NULLS) OVER a AS t0,
      first_value(pm10 IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN pm10 IS NOT NULL THEN (epoch(date::TIMESTAMP) / 86400)::BIGINT END IGNORE NULLS) OVER b AS t1 FROM l
      WINDOW a AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT tmsid2, date, round(coalesce(pm10, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (d - t0) / (t1 - t0) END, v0, v1), 3) AS pm10 FROM k"""
)
def interpolate_linear(t: Tables):
    df = W.interpolate_linear(W.complete_series(_sparse(t), ["tmsid2"], "date"), ["tmsid2"], "date", ["pm10"])
    return df.select("tmsid2", "date", F.round("pm10", 3).alias("pm10"))


@query(f"SELECT tmsid2, date, round(coalesce(pm10, avg(pm10) OVER (PARTITION BY tmsid2)), 3) AS pm10 FROM {LINE}")
def fill_gaps_mean(t: Tables):
    return W.fill_gaps_mean(_sparse(t), ["tmsid2"], "date", "pm10", "INTERVAL 1 DAY").select("tmsid2", "date", F.round("pm10", 3).alias("pm10"))


@query(
    """WITH a AS (SELECT tmsid2, date, pm10, (row_number() OVER (PARTITION BY tmsid2 ORDER BY date) - 1) % 7 AS phase,
      CASE WHEN count(*) OVER w = 7 THEN avg(pm10) OVER w END AS trend FROM {daily} WINDOW w AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    b AS (SELECT *, avg(pm10 - trend) OVER (PARTITION BY tmsid2, phase) AS seasonal FROM a)
    SELECT tmsid2, date, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(pm10 - trend - seasonal, 3) AS remainder FROM b"""
)
def decompose(t: Tables):
    df = W.decompose(t.daily, ["tmsid2"], "date", "pm10", 7)
    return df.select("tmsid2", "date", *[F.round(c, 3).alias(c) for c in ("trend", "seasonal", "remainder")])


@query(
    f"""WITH l AS {LINE}, p AS (SELECT *, (row_number() OVER (PARTITION BY tmsid2 ORDER BY date) - 1) % 7 AS phase FROM l),
    q AS (SELECT *, coalesce(avg(pm10) OVER (PARTITION BY tmsid2, phase), 0) AS season FROM p), f AS (SELECT *, pm10 - season AS flat, (epoch(date::TIMESTAMP) / 86400)::BIGINT AS d FROM q),
    k AS (SELECT *, last_value(flat IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN flat IS NOT NULL THEN d END IGNORE NULLS) OVER a AS t0,
      first_value(flat IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN flat IS NOT NULL THEN d END IGNORE NULLS) OVER b AS t1 FROM f
      WINDOW a AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT tmsid2, date, round(coalesce(pm10, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (d - t0) / (t1 - t0) END + season, v0 + season, v1 + season), 3) AS pm10 FROM k"""
)
def impute_seasonal(t: Tables):
    df = W.impute_seasonal(W.complete_series(_sparse(t), ["tmsid2"], "date"), ["tmsid2"], "date", "pm10", 7)
    return df.select("tmsid2", "date", F.round("pm10", 3).alias("pm10"))


@query()
def impute_states(t: Tables):
    """Gaps on the smoothed level of each station's days, without and with a week's season."""
    line = W.complete_series(_sparse(t), ["tmsid2"], "date")
    plain = Z.impute_states(line, ["tmsid2"], "date", "pm10").select("tmsid2", "date", F.round("pm10", 3).alias("pm10"))
    weekly = Z.impute_states(line, ["tmsid2"], "date", "pm10", period=7).select("tmsid2", "date", F.round("pm10", 3).alias("pm10_weekly"))
    return plain.join(weekly, ["tmsid2", "date"])


@query()
def smooth_states(t: Tables):
    """Level and slope of each station's hours, all readings of an hour together."""
    hours = t.measurements.groupBy("tmsid2", F.date_trunc("hour", "datehour").alias("hour")).agg(F.avg("pm10").alias("pm10"))
    out = Z.smooth_states(hours, ["tmsid2"], "hour", "pm10", Z.Variances(100.0, 10.0, 0.1))
    return out.select("tmsid2", "hour", F.round("level", 3).alias("level"), F.round("slope", 4).alias("slope"))


@query()
def decompose_loess(t: Tables):
    """Trend, weekly season and remainder of each station's days by local regression, one robust round."""
    line = Z.impute_states(W.complete_series(t.daily.select("tmsid2", "date", "pm10"), ["tmsid2"], "date"), ["tmsid2"], "date", "pm10")
    out = loess.decompose_loess(line, ["tmsid2"], "date", "pm10", 7, robust=1)
    return out.select("tmsid2", "date", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "remainder")])


FENCE = "quantile_cont(pm10, 0.75) + {0}::DOUBLE * (quantile_cont(pm10, 0.75) - quantile_cont(pm10, 0.25))"


@query("SELECT event_id, least(pm10, f) AS pm10 FROM (SELECT event_id, pm10, (SELECT " + FENCE.format("1.5") + " FROM {measurements}) AS f FROM {measurements} WHERE pm10 IS NOT NULL)")
def winsorise_all(t: Tables):
    return W.winsorise(t.measurements, "pm10", 1.5).filter("pm10 IS NOT NULL").select("event_id", "pm10")


@query("SELECT event_id, least(pm10, f) AS pm10 FROM {measurements} JOIN (SELECT tmsid2, " + FENCE.format("0.5") + " AS f FROM {measurements} GROUP BY tmsid2) USING (tmsid2) WHERE pm10 IS NOT NULL")
def winsorise_by_station(t: Tables):
    return W.winsorise(t.measurements, "pm10", 0.5, ["tmsid2"]).filter("pm10 IS NOT NULL").select("event_id", "pm10")


@query("SELECT event_id, CASE WHEN pm10 <= 8000 THEN pm10 END AS pm10, CASE WHEN pm25 <= 3000 THEN pm25 END AS pm25 FROM {measurements}")
def cut_off(t: Tables):
    return W.cut_off(t.measurements, {"pm10": 8000.0, "pm25": 3000.0}).select("event_id", "pm10", "pm25")


SMOOTH = """WITH w0 AS (SELECT tmsid2, date, CASE WHEN pm10 IS NOT NULL THEN least(pm10, f) END AS v FROM (SELECT d.*, q.f FROM {daily} d JOIN (SELECT tmsid2, """ + FENCE.format("0.5") + """ AS f FROM {daily} GROUP BY tmsid2) q USING (tmsid2))),
w1 AS (SELECT tmsid2, date, """ + FILL.format("v", "tmsid2", "date") + """ AS v FROM w0),
w2 AS (SELECT tmsid2, date, v, CASE WHEN count(*) OVER w = 3 THEN avg(v) OVER w END AS m FROM w1 WINDOW w AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT tmsid2, date, round(v, 3) AS pm10, round(""" + FILL.format("m", "tmsid2", "date") + """, 3) AS pm10_smooth FROM w2"""


@query(SMOOTH)
def smooth_station_series(t: Tables):
    df = W.smooth_station_series(t.daily.select("tmsid2", "date", "pm10"), ["tmsid2"], "date", "pm10", 0.5)
    return df.select("tmsid2", "date", F.round("pm10", 3).alias("pm10"), F.round("pm10_smooth", 3).alias("pm10_smooth"))


@query("SELECT tmsid2, date, len(w)::INT AS n, w[1] AS first_date FROM (SELECT tmsid2, date, list(date) OVER (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS w FROM {daily}) WHERE len(w) = 7")
def sequence_windows(t: Tables):
    df = W.sequence_windows(t.daily, ["tmsid2"], "date", ["pm10"], 7)
    return df.select("tmsid2", "date", F.size("window").alias("n"), F.get("window", F.lit(0))["date"].alias("first_date"))


@query("WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {daily})) SELECT tmsid2, date, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM {daily} JOIN d USING (date)")
def date_split(t: Tables):
    return W.date_split(t.daily, "date").select("tmsid2", "date", "split")


@query("SELECT tmsid2, date, CASE WHEN row_number() OVER (PARTITION BY tmsid2 ORDER BY date) <= floor(count(*) OVER (PARTITION BY tmsid2) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {daily}")
def station_split(t: Tables):
    return W.station_split(t.daily, ["tmsid2"], "date").select("tmsid2", "date", "split")


@query("SELECT o_orderkey, y AS test_year, CASE WHEN year(o_orderdate) = y THEN 'test' ELSE 'train' END AS role FROM orders JOIN (VALUES (1995), (1997)) v(y) ON year(o_orderdate) BETWEEN y - 3 AND y")
def rolling_origin(t: Tables):
    df = t.orders.select("o_orderkey", F.year("o_orderdate").alias("yr"))
    return W.rolling_origin(df, "yr", [1995, 1997]).select("o_orderkey", "test_year", "role")


# --- jobs ---------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {SEGMENTS}, y AS (SELECT tmsid2, year(date)::INT AS year, AVG(pm10) AS pm10, COUNT(*) AS n_rows, COUNT(DISTINCT date) AS ndays FROM {{measurements}} GROUP BY 1, 2),
    e AS (SELECT tmsid, tmsid2, {HAVERSINE} AS moved_m, unnest(range(year(date_start), year(date_end) + 1))::INT AS year FROM seg)
    SELECT tmsid, tmsid2, e.year, moved_m, pm10, n_rows, ndays FROM e LEFT JOIN y USING (tmsid2, year)"""
)
def job_annual_monitors(t: Tables):
    out = jobs.annual_monitors(_history(t), t.measurements)
    return out.select("tmsid", "tmsid2", "year", F.round("moved_m", 2).alias("moved_m"), "pm10", "n_rows", "ndays")


@query(
    f"""WITH {CLEAN}, l AS (SELECT *, row_number() OVER (PARTITION BY tmsid ORDER BY date_start DESC, coords DESC) AS k FROM clean),
    j AS (SELECT l.tmsid, l.lon, l.lat, r.lon AS lon0, r.lat AS lat0 FROM l JOIN {{original_sites}} r USING (tmsid) WHERE k = 1), s AS (SELECT tmsid, {HAVERSINE} AS shift_m FROM j),
    y AS (SELECT tmsid, year(date)::INT AS year, AVG(pm10) AS pm10, COUNT(*) AS n_rows FROM {{measurements}} GROUP BY 1, 2)
    SELECT o.tmsid, o.lon, o.lat, s.shift_m, y.year, y.pm10, y.n_rows FROM {{original_sites}} o LEFT JOIN s USING (tmsid) LEFT JOIN y USING (tmsid)"""
)
def job_annual_original(t: Tables):
    out = jobs.annual_original(t.original_sites, _history(t), t.measurements)
    return out.select("tmsid", "lon", "lat", F.round("shift_m", 2).alias("shift_m"), "year", "pm10", "n_rows")


@query(
    f"""WITH {SEGMENTS}, g AS (SELECT tmsid, tmsid2, lon, lat, {HAVERSINE} AS moved_m, unnest(generate_series(date_trunc('day', date_start), date_trunc('day', date_end), INTERVAL 1 DAY))::DATE AS date FROM seg WHERE date_start <= date_end),
    dd AS ({DAILY_SQL}) SELECT g.tmsid, g.tmsid2, g.date, moved_m, pm10, pm25, pm10_flag FROM g LEFT JOIN dd ON g.tmsid2 = dd.tmsid2 AND g.date = dd.date"""
)
def job_daily_monitors(t: Tables):
    out = jobs.daily_monitors(_history(t), t.measurements)
    return out.select("tmsid", "tmsid2", "date", F.round("moved_m", 2).alias("moved_m"), "pm10", "pm25", "pm10_flag")


def _smoothed_sql(v: str) -> tuple[str, str]:
    fence = FENCE.replace("pm10", v).format("1.5")
    a = f"CASE WHEN {v} IS NOT NULL THEN least({v}, (SELECT {fence} FROM a)) END AS {v}_a"
    m = ", ".join(f"round(CASE WHEN count(*) OVER w = 7 THEN avg({c}) OVER w END, 3) AS {n}" for c, n in ((v, f"{v}_7"), (f"{v}_a", f"{v}_a7")))
    return a, f"round({v}, 3) AS {v}, round({v}_a, 3) AS {v}_a, {m}"


_PM10, _PM25 = _smoothed_sql("pm10"), _smoothed_sql("pm25")


@query(
    f"""WITH a AS (SELECT tmsid2, date, CASE WHEN AVG(pm10) <= 8000 THEN AVG(pm10) END AS pm10, AVG(pm25) AS pm25 FROM {{measurements}} GROUP BY tmsid2, date),
    b AS (SELECT *, {_PM10[0]}, {_PM25[0]} FROM a),
    c AS (SELECT tmsid2, date, year(date)::INT AS year, month(date)::INT AS month, day(date)::INT AS day, isodow(date)::INT AS weekday, (isodow(date) >= 6)::INT AS is_weekend, {_PM10[1]}, {_PM25[1]}
      FROM b WINDOW w AS (PARTITION BY tmsid2 ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    f AS (SELECT k.tmsid2, p.x AS coords_x, p.y AS coords_y, l.value AS dem FROM (SELECT DISTINCT tmsid2, tmsid FROM {{measurements}}) k JOIN {{points}} p ON p.pid = CAST(k.tmsid AS BIGINT)
      LEFT JOIN {{landuse}} l ON l.row = floor((1920000 - p.y) / 500) AND l.col = floor((p.x - 900000) / 400))
    SELECT c.*, f.coords_x, f.coords_y, f.dem FROM c JOIN f ON f.tmsid2 = c.tmsid2 WHERE c.year = 2024"""
)
def job_smoothed_daily(t: Tables):
    from ..operators import raster as R

    fine = R.Frame(900_000.0, 1_920_000.0, 400.0, 500.0)
    places = R.sample_at_points(t.points, t.landuse.select("row", "col", "value"), fine).select(F.col("pid").cast("string").alias("tmsid"), F.col("x").alias("coords_x"), F.col("y").alias("coords_y"), F.col("value").alias("dem"))
    features = t.measurements.select("tmsid2", "tmsid", F.lit(2024).alias("year")).distinct().join(places, "tmsid").drop("tmsid")
    out = jobs.smoothed_daily(t.measurements, features, limits={"pm10": 8000.0})
    values = [f"{v}{e}" for v in ("pm10", "pm25") for e in ("", "_a", "_7", "_a7")]
    return out.withColumns({c: F.round(c, 3) for c in values})


# --- readers, by what they read back ------------------------------------------------------------------------------
@query("SELECT tmsid, site_type, year, date_start::TIMESTAMP AS date_start, coords FROM {site_history}")
def read_site_history(t: Tables):
    path = new_path(t.spark)
    dated = t.site_history.select("tmsid", "site_type", "year", F.col("date_start").cast("timestamp_ntz").alias("date_start"), F.col("date_end").cast("timestamp_ntz").alias("date_end"), "coords")
    dated.write.csv(path, header=True)
    return S.read_site_history(t.spark, path).select("tmsid", "site_type", "year", "date_start", "coords")


@query("SELECT tmsid, lon AS longitude, lat AS latitude FROM {original_sites}")
def read_original_sites(t: Tables):
    path = new_path(t.spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t.original_sites.select("tmsid", text("lon").alias("longitude"), text("lat").alias("latitude")).write.parquet(path)
    return S.read_original_sites(t.spark, path)


@query("SELECT event_id, tmsid, CASE WHEN pm10 > -990 THEN pm10 * 0.1::DOUBLE END AS pm10 FROM {raw_measurements}")
def read_weather(t: Tables):
    path = new_path(t.spark)
    t.raw_measurements.select("event_id", "tmsid", "pm10").write.parquet(path)
    return S.read_weather(t.spark, path, ["pm10"], scale=0.1)


@query("SELECT row, col, CASE WHEN class IS NOT NULL THEN value END AS value FROM {landuse}")
def read_raster_cells(t: Tables):
    path = new_path(t.spark)
    t.landuse.select("row", "col", F.when(F.col("class").isNotNull(), F.col("value")).otherwise(-9999.0).alias("value")).write.parquet(path)
    return S.read_raster_cells(t.spark, path, nodata=-9999.0)


@query("SELECT user_id, value FROM events")
def read_or_empty(t: Tables):
    """The table that is there with one that isn't: only the former's rows."""
    schema = t.events.select("user_id", "value").schema
    here = S.read_or_empty(t.spark, f"{t.sf_dir}/events.parquet", schema)
    return here.union(S.read_or_empty(t.spark, new_path(t.spark), schema))


@query("SELECT event_id, date, date AS name_date, year(date)::INT AS name_year FROM {measurements}")
def read_partitions(t: Tables):
    """A folder for each day of the year; the day is read back from the names of the files."""
    path = new_path(t.spark)
    stamped = t.measurements.select("event_id", "date", F.concat(F.lit("MCD19.A"), F.date_format("date", "yyyyDDD")).alias("stamp"))
    stamped.repartition("stamp").write.partitionBy("stamp").parquet(path)
    return S.read_partitions(t.spark, f"{path}/stamp=*", r"A(\d{7})/", "yyyyDDD").select("event_id", "date", "name_date", "name_year")
