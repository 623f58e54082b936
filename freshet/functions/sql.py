"""Functions for SQL texts: scalar ones and table functions, as SQL functions that the optimizer inlines (no Python)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from freshet.operators.tiles import DIRECTIONS

_NEIGHBOURS = ", ".join(f"({k}S, {a}, {b}, {'1.0D' if a == 0 or b == 0 else 'sqrt(2.0D)'})" for k, a, b in DIRECTIONS)

#: Name and definition of each function.
FUNCTIONS = {
    "interp": """(x DOUBLE, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN size(filter(xs, v -> v <= x)) = 0 THEN get(ys, 0) WHEN size(filter(xs, v -> v <= x)) = size(xs) THEN get(ys, size(ys) - 1)
        ELSE get(ys, size(filter(xs, v -> v <= x)) - 1) + (x - get(xs, size(filter(xs, v -> v <= x)) - 1)) / (get(xs, size(filter(xs, v -> v <= x))) - get(xs, size(filter(xs, v -> v <= x)) - 1))
            * (get(ys, size(filter(xs, v -> v <= x))) - get(ys, size(filter(xs, v -> v <= x)) - 1)) END""",
    "water_year": "(day DATE) RETURNS INT RETURN year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END",
    "utm_srid": "(lon DOUBLE, lat DOUBLE) RETURNS INT RETURN 26900 + CAST(floor((lon + 180) / 6) AS INT) + 1",
    "floor_margin": "(stage DOUBLE, hand DOUBLE, floor DOUBLE) RETURNS DOUBLE RETURN CASE WHEN stage - hand > 0 THEN stage - hand - floor ELSE -1e6 END",
    "channel_depth": "(area_km2 DOUBLE) RETURNS DOUBLE RETURN CASE WHEN area_km2 > 0 THEN least(0.381D * pow(area_km2, 0.246D), 8.0D) ELSE 0.0D END",
    "d8_neighbours": f"""(at_r INT, at_c INT) RETURNS TABLE (code SMALLINT, r INT, c INT, far DOUBLE)
        RETURN SELECT k, at_r + dr, at_c + dc, d FROM VALUES {_NEIGHBOURS} AS t(k, dr, dc, d)""",
    "cells_of_box": """(xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, size DOUBLE) RETURNS TABLE (r INT, c INT)
        RETURN SELECT e.rr, e.cc FROM (SELECT explode(flatten(transform(sequence(CAST(-ceil(ymax / size) AS INT), CAST(-ceil(ymin / size) AS INT)), y ->
            transform(sequence(CAST(floor(xmin / size) AS INT), CAST(floor(xmax / size) AS INT)), x -> named_struct('rr', y, 'cc', x))))) AS e)""",
}


def register(spark: SparkSession) -> None:
    """Make the functions usable from SQL texts of this session."""
    for name, definition in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
