"""Station, raster and feature tables derived from the given tables.

Each is one SELECT that both Spark and DuckDB run, in whole-number arithmetic, so that the SQL of a query starts from the same
rows as the query. Names in braces are tables, given or derived.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "raw_measurements": """
        SELECT event_id, CAST(user_id % 16 AS STRING) AS tmsid,
          CONCAT(CAST(user_id % 16 AS STRING), CASE WHEN user_id % 16 < 8 OR CAST(ts AS DATE) < DATE '2024-01-16' THEN 'A' ELSE 'B' END) AS tmsid2,
          ts, CASE WHEN event_id % 29 = 0 THEN CAST(-999 AS DOUBLE) ELSE ROUND(value * 100) END AS pm10,
          CASE WHEN event_id % 31 = 0 THEN CAST(-999 AS DOUBLE) ELSE ROUND(value * 100) * CAST(0.5 AS DOUBLE) END AS pm25
        FROM {events}""",
    "measurements": """
        SELECT event_id, tmsid, tmsid2, ts + INTERVAL 9 HOURS AS datehour, CAST(ts + INTERVAL 9 HOURS AS DATE) AS date,
          CASE WHEN pm10 >= 0 THEN pm10 END AS pm10, CASE WHEN pm25 >= 0 THEN pm25 END AS pm25
        FROM {raw_measurements}""",
    "daily": """
        SELECT tmsid2, tmsid, date, AVG(pm10) AS pm10, AVG(pm25) AS pm25, COUNT(*) AS n_rows FROM {measurements} GROUP BY tmsid2, tmsid, date""",
    "site_history": """
        SELECT s_suppkey, CAST(CASE WHEN s_suppkey < 160 THEN s_suppkey % 16 ELSE CAST(FLOOR(s_suppkey / 10) AS BIGINT) END AS STRING) AS tmsid,
          CASE s_nationkey % 7 WHEN 0 THEN 'urban' WHEN 1 THEN 'road' WHEN 2 THEN 'port' WHEN 3 THEN 'rural' WHEN 4 THEN 'urban-1' WHEN 5 THEN 'background' END AS site_type,
          CAST(2024 AS INT) AS year,
          CASE WHEN s_suppkey % 19 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 20 AS INT) END AS date_start,
          CASE WHEN s_suppkey % 13 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 20 AS INT) + CAST(s_suppkey % 11 AS INT) END AS date_end,
          CONCAT(CAST(34 + CAST(s_suppkey * 53 % 400 AS DOUBLE) / 100 AS STRING), ', ', CAST(126 + CAST(s_suppkey * 37 % 400 AS DOUBLE) / 100 AS STRING)) AS coords,
          126 + CAST(s_suppkey * 37 % 400 AS DOUBLE) / 100 AS lon, 34 + CAST(s_suppkey * 53 % 400 AS DOUBLE) / 100 AS lat
        FROM {supplier}""",
    "stays": """
        SELECT s_suppkey AS stay, tmsid, date_start, COALESCE(date_end, DATE '2024-01-31') AS date_end, lon, lat,
          CAST(900000 + s_suppkey * 7919 % 20000 AS DOUBLE) AS x, CAST(1900000 + s_suppkey * 6101 % 20000 AS DOUBLE) AS y
        FROM {site_history} WHERE date_start IS NOT NULL""",
    "points": """
        SELECT CAST(s_suppkey AS BIGINT) AS pid, CAST(900000 + s_suppkey * 7919 % 20000 AS DOUBLE) AS x, CAST(1900000 + s_suppkey * 6101 % 20000 AS DOUBLE) AS y
        FROM {supplier}""",
    "original_sites": """
        SELECT tmsid, CASE WHEN s_suppkey % 17 <> 0 THEN lon + CAST(s_suppkey % 5 AS DOUBLE) / 1000 END AS lon,
          CASE WHEN s_suppkey % 17 <> 0 THEN lat + CAST(s_suppkey % 5 AS DOUBLE) / 1000 END AS lat
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tmsid ORDER BY s_suppkey) AS nth FROM {site_history}) WHERE nth = 1""",
    "originals": """
        SELECT CAST(s_suppkey AS BIGINT) AS pid, CAST(900000 + (s_suppkey * 7919 + 137) % 20000 AS DOUBLE) AS x, CAST(1900000 + (s_suppkey * 6101 + 211) % 20000 AS DOUBLE) AS y
        FROM {supplier}""",
    "gridpoints": """
        SELECT CAST(c_custkey AS BIGINT) AS pid, CAST(900050 + c_custkey % 200 * 100 AS DOUBLE) AS x, CAST(1900050 + FLOOR(c_custkey / 200) % 200 * 100 AS DOUBLE) AS y
        FROM {customer}""",
    "plots": """
        SELECT eid AS zone, x - 150 AS xmin, y - 150 AS ymin, x + 150 AS xmax, y + 150 AS ymax FROM {emitters}""",
    "site_years": """
        SELECT stay AS pid, tmsid, CONCAT(tmsid, '-', CAST(stay AS STRING)) AS tmsid2, x, y, CAST(1994 + stay % 2 + n AS INT) AS year
        FROM {stays} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) two""",
    "point_years": """
        SELECT pid, x, y, CAST(1995 AS INT) AS year FROM {points}""",
    "grid_years": """
        SELECT pid, x, y, CAST(1995 AS INT) AS year FROM {gridpoints}""",
    "original_years": """
        SELECT pid, x, y, CAST(1994 + pid % 3 AS INT) AS year FROM {originals}""",
    "terrain": """
        SELECT row, col, value AS dem, value + row % 3 AS dsm, value - col % 5 AS mtpi, value * 2 - row % 7 AS mtpi_1km FROM {landuse}""",
    "landuse_years": """
        SELECT CAST(1993 + n AS INT) AS year, row, col, CAST((class + n * row) % 6 AS INT) AS class
        FROM {landuse} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n UNION ALL SELECT 2 AS n) three""",
    "aod_years": """
        SELECT row, col, CAST(YEAR(date) AS INT) AS year, aod AS value FROM {aod}""",
    "blh_years": """
        SELECT row, col, CAST(YEAR(ts) AS INT) AS year, value FROM {reanalysis} WHERE variable = 'sp'""",
    "emitters": """
        SELECT c_custkey AS eid, CAST(900000 + c_custkey * 7919 % 20000 AS DOUBLE) AS x, CAST(1900000 + c_custkey * 6101 % 20000 AS DOUBLE) AS y,
          ABS(c_acctbal) AS emission, CONCAT('class ', CAST(c_nationkey % 7 AS STRING)) AS kind, CASE WHEN c_custkey % 3 = 0 THEN '01' ELSE '02' END AS status
        FROM {customer}""",
    "watersheds": """
        SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST(900000 + (n_nationkey % 5) * 4000 AS DOUBLE) AS xmin, CAST(1900000 + CAST(FLOOR(n_nationkey / 5) AS BIGINT) * 4000 AS DOUBLE) AS ymin,
          CAST(904000 + (n_nationkey % 5) * 4000 AS DOUBLE) AS xmax, CAST(1904000 + CAST(FLOOR(n_nationkey / 5) AS BIGINT) * 4000 AS DOUBLE) AS ymax
        FROM {nation}""",
    "roads": """
        SELECT CAST(p_partkey AS BIGINT) AS link_id, LPAD(CAST(p_size % 8 AS STRING), 3, '0') AS road_type, CAST(p_partkey % 2 AS INT) AS road_use,
          CAST(900000 + p_partkey * 7919 % 20000 AS DOUBLE) AS x1, CAST(1900000 + p_partkey * 6101 % 20000 AS DOUBLE) AS y1,
          CAST(900000 + p_partkey * 7919 % 20000 + p_size * 20 AS DOUBLE) AS x2, CAST(1900000 + p_partkey * 6101 % 20000 + p_partkey % 700 AS DOUBLE) AS y2
        FROM {part}""",
    "estates": """
        SELECT zone, x0, y0, leg, CONCAT('MULTIPOLYGON (((', x0, ' ', y0, ', ', x0 + 600, ' ', y0, ', ', x0 + 600, ' ', y0 + 600, ', ', x0, ' ', y0 + 600, ', ', x0, ' ', y0, '), (',
          x0 + 50, ' ', y0 + 50, ', ', x0 + 50, ' ', y0 + 150, ', ', x0 + 150, ' ', y0 + 150, ', ', x0 + 150, ' ', y0 + 50, ', ', x0 + 50, ' ', y0 + 50, '), (',
          x0 + 200, ' ', y0 + 200, ', ', x0 + 550, ' ', y0 + 200, ', ', x0 + 550, ' ', y0 + 500, ', ', x0 + 200, ' ', y0 + 500, ', ', x0 + 200, ' ', y0 + 200, ')), ((',
          x0 + 700, ' ', y0, ', ', x0 + 700 + leg, ' ', y0, ', ', x0 + 700, ' ', y0 + leg, ', ', x0 + 700, ' ', y0, ')), ((',
          x0, ' ', y0 + 700, ', ', x0, ' ', y0 + 800, ', ', x0 + 100, ' ', y0 + 800, ', ', x0 + 100, ' ', y0 + 700, ', ', x0, ' ', y0 + 700, ')))') AS wkt
        FROM (SELECT CAST(s_suppkey AS BIGINT) AS zone, CAST(900000 + s_suppkey * 7919 % 20000 AS BIGINT) AS x0, CAST(1900000 + s_suppkey * 6101 % 20000 AS BIGINT) AS y0,
          CAST(200 + s_suppkey % 100 AS BIGINT) AS leg FROM {supplier})""",
    "polylines": """
        SELECT link_id, x1, y1, x2, y2, x3, y3, x4, y4, x5, y5,
          CONCAT('MULTILINESTRING ((', x1, ' ', y1, ', ', x2, ' ', y2, ', ', x3, ' ', y3, '), (', x4, ' ', y4, ', ', x5, ' ', y5, '))') AS wkt
        FROM (SELECT link_id, x AS x1, y AS y1, x + size * 7 AS x2, y + link_id % 300 AS y2, x + size * 20 AS x3, y + link_id % 700 AS y3,
          x - 300 AS x4, y AS y4, x - 300 AS x5, y + link_id % 500 AS y5
          FROM (SELECT CAST(p_partkey AS BIGINT) AS link_id, CAST(p_size AS BIGINT) AS size, CAST(900000 + p_partkey * 7919 % 20000 AS BIGINT) AS x, CAST(1900000 + p_partkey * 6101 % 20000 AS BIGINT) AS y FROM {part}))""",
    "page_points": """
        SELECT page_id AS pid, CAST(900000 + page_id * 7919 % 20000 AS DOUBLE) AS x, CAST(1900000 + page_id * 6101 % 20000 AS DOUBLE) AS y FROM {pages}""",
    "document_sources": """
        SELECT doc_id AS eid, CAST(900000 + (doc_id * 7919 + 31) % 20000 AS DOUBLE) AS x, CAST(1900000 + (doc_id * 6101 + 77) % 20000 AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) AS emission FROM {documents}""",
    "document_features": """
        SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS DOUBLE) END AS chars, CASE WHEN doc_id % 11 <> 0 THEN CAST(n_chars % 100 + doc_id % 37 AS DOUBLE) END AS rest,
          CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars AS DOUBLE) / 6 + CAST(doc_id % 5 AS DOUBLE) END AS words
        FROM {documents}""",
    "landuse": """
        SELECT CAST(FLOOR(p_partkey / 50) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size <> 50 THEN CAST(p_size % 6 AS INT) END AS class,
          CAST(p_size AS DOUBLE) AS value
        FROM {part}""",
    "landuse_old": """
        SELECT row, col, CAST((class + row) % 6 AS INT) AS class, value FROM {landuse}""",
    "reanalysis": """
        SELECT CAST(FLOOR(o_custkey % 400 / 20) AS INT) AS row, CAST(o_custkey % 20 AS INT) AS col,
          CASE o_orderkey % 6 WHEN 0 THEN 't2m' WHEN 1 THEN 'u10' WHEN 2 THEN 'v10' WHEN 3 THEN 'sp' WHEN 4 THEN 'ssr' ELSE 'tp' END AS variable,
          o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL 1 HOUR AS ts, ROUND(o_totalprice * 100) AS value
        FROM {orders}""",
    "aod": """
        SELECT CAST(l_partkey % 3 AS INT) AS tile, CAST(FLOOR(l_partkey % 400 / 20) AS INT) AS row, CAST(l_partkey % 20 AS INT) AS col, CAST(l_shipdate AS DATE) AS date, l_linenumber AS overpass,
          CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS aod, l_discount + CAST(0.01 AS DOUBLE) AS unc, CAST(l_orderkey % 4096 AS INT) AS qa, l_quantity AS value
        FROM {lineitem}""",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in GIVEN:
        return given(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def with_views(sql: str) -> str:
    """The SQL with a leading WITH for every derived table that it names in braces."""
    needed: dict[str, str] = {}

    def add(text: str) -> str:
        for n in re.findall(r"\{(\w+)\}", text):
            if n not in GIVEN and n not in needed:
                body = add(VIEWS[n])
                needed[n] = body
        return re.sub(r"\{(\w+)\}", r"\1", text)

    body = add(sql)
    if not needed:
        return body
    lead = ",\n".join(f"{n} AS ({t})" for n, t in needed.items())
    inner = body.strip()
    return f"WITH {lead}" + (f",\n{inner[5:]}" if inner[:5].upper() == "WITH " else f"\n{inner}")
