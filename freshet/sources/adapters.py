"""Views that derive grids, buildings, gauges and marks from the data set's tables.

Each is one SQL text that Spark and DuckDB read alike; {name} stands for a table or an earlier view. The grid has COLS columns and
as many rows as the orders need, so it grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from freshet.sources.store import table

COLS = 128
CELLSIZE = 10.0

VIEWS = {
    "dem": """
        SELECT CAST(l_orderkey AS BIGINT) AS cell, CAST(floor(l_orderkey / 128) AS INT) AS r, CAST(l_orderkey % 128 AS INT) AS c,
               CAST(4000 - 2 * floor(l_orderkey / 128) + sum(CAST(l_quantity AS BIGINT)) % 25 AS DOUBLE) AS z
        FROM {lineitem} GROUP BY l_orderkey""",
    "buildings": """
        SELECT CAST(p_partkey AS BIGINT) AS building_id, CAST(p_partkey * 7 AS BIGINT) AS cell,
               CASE substr(p_type, 1, 1) WHEN 'S' THEN 'residential' WHEN 'P' THEN 'commercial' WHEN 'L' THEN 'industrial'
                    WHEN 'M' THEN 'RES1-1SNB' WHEN 'E' THEN 'COM4' ELSE 'shed' END AS building_class,
               CAST(p_size AS DOUBLE) AS height, 40.0 + p_size * 3 AS area_m2, CAST(p_retailprice AS DOUBLE) AS value, CAST(p_size % 9 AS DOUBLE) AS num_floors,
               CAST(p_partkey % 5 AS DOUBLE) AS pop, 0.1 * (p_size % 7) AS found_ht_m
        FROM {part}""",
    "peaks": """
        SELECT o_orderpriority AS site, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS period,
               max(o_totalprice) / 1000 AS cms
        FROM {orders} GROUP BY o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) - 1""",
    "marks": """
        SELECT CAST(c_custkey AS BIGINT) AS mark_id, CAST(c_custkey * 9 AS BIGINT) AS cell, CAST(c_custkey % 4 AS INT) AS quality,
               CASE c_custkey % 3 WHEN 0 THEN 'Coastal' WHEN 1 THEN 'Riverine' ELSE NULL END AS environment,
               CAST(c_acctbal % 7 AS DOUBLE) AS depth_m, CAST(c_nationkey AS INT) AS event_id
        FROM {customer}""",
    "gauge": """SELECT CAST(user_id AS BIGINT) AS site, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DOUBLE) AS value, event_type FROM {events}""",
}


def sql_text(view: str) -> str:
    """The view's text with table names in place, for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[view])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of sf_dir."""
    names = re.findall(r"\{(\w+)\}", VIEWS[name])
    return spark.sql(VIEWS[name], **{n: table(spark, sf_dir, n) for n in names})
