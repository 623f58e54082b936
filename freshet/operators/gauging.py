"""Gauge records and surveyed marks: tables of tab-separated text, peaks, levels, choice of gauges, and events that marks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalar import water_year
from freshet.operators.hydraulics import CFS, UNITS, gauge_to_datum, slope_stage

FEET = 0.3048


def parsed_rdb(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key and record (a map of texts) of every data line of tab-separated tables, one whole table a row.

    Comment lines (#) and empty ones are skipped; the first line names the columns, the second holds formats; lines of another number
    of fields are dropped, and a table of fewer than three lines has no records.
    """
    lines = texts.select(key, F.filter(F.split(F.col(column), r"\r?\n"), lambda x: (x != "") & ~x.startswith("#")).alias("lines")).where(F.size("lines") >= 3)
    rows = lines.select(key, F.split(F.get("lines", F.lit(0)), "\t").alias("names"), F.explode(F.slice("lines", 3, F.size("lines"))).alias("line"))
    values = rows.select(key, "names", F.split("line", "\t").alias("values"))
    return values.where(F.size("names") == F.size("values")).select(key, F.map_from_arrays("names", "values").alias("record"))



def peak_series(records: DataFrame, key: str) -> DataFrame:
    """key, date, cms, water_year and gage_ht of the records that hold a peak."""
    flow = F.col("record.peak_va")
    return records.where(F.trim(F.coalesce(flow, F.lit(""))) != "").select(key, F.coalesce("record.peak_dt", F.lit("")).alias("date"), (F.trim(flow).try_cast("double") * CFS).alias("cms"), water_year(F.col("record.peak_dt")).alias("water_year"), F.col("record.gage_ht").alias("gage_ht"))


def peak_of_record(peaks: DataFrame, key: str) -> DataFrame:
    """key, discharge_cms, date and n_years: the largest peak (the earliest of equal ones) and the number of peaks."""
    top = F.max_by(F.struct("cms", "date"), F.struct("cms", -F.unix_date(F.try_to_date(F.col("date"), "yyyy-MM-dd"))))
    return peaks.groupBy(key).agg(top.alias("top"), F.count("*").alias("n_years")).select(key, F.col("top.cms").alias("discharge_cms"), F.col("top.date").alias("date"), "n_years")


def peak_surface(sites: DataFrame) -> DataFrame:
    """sites (alt_va, gage_ht in feet as text) with wse_m, null where either is blank or no number."""
    level = F.trim("alt_va").try_cast("double") + F.trim("gage_ht").try_cast("double")
    return sites.withColumn("wse_m", level * FEET)


def chosen_gauges(gauges: DataFrame, by: str, most: float = 20.0) -> DataFrame:
    """gauges (by, site, wse_m, bed_m, datum) with a reason where they are dropped (null: kept).

    A gauge that implies no finite depth of 0 to `most` metres over the model's bed goes; of the rest, those on the vertical datum of
    the majority stay (the least name on a tie), and those without a datum.
    """
    depth = F.col("wse_m") - F.col("bed_m")
    plausible = F.coalesce((depth >= 0) & (depth <= most) & ~F.isnan(depth), F.lit(False))
    named = F.when(plausible & (F.coalesce("datum", F.lit("")) != ""), F.col("datum"))
    counts = gauges.select(by, named.alias("d")).where("d IS NOT NULL").groupBy(by, "d").agg(F.count("*").alias("n"))
    usual = counts.groupBy(by).agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("usual"))
    reason = F.when(~plausible, "implausible depth").when((F.coalesce("datum", F.lit("")) != "") & (F.col("datum") != F.col("usual")), "another datum")
    return gauges.join(usual, by, "left").withColumn("reason", reason).drop("usual")


def resolved_gauges(readings: DataFrame, cells: DataFrame, unit: str, offset: float) -> DataFrame:
    """site, datum_m, bed_m, depth_m and problem of readings (site, cell, reading) against the filled ground (cell, z).

    problem: the cell is outside or undefined, or the level lies below the bed; a reading with a problem has no depth.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {sorted(UNITS)}")
    level = gauge_to_datum(F.col("reading"), unit, offset)
    rows = readings.join(cells.select("cell", F.col("z").alias("bed_m")), "cell", "left").select("site", level.alias("datum_m"), "bed_m")
    problem = F.when(F.col("bed_m").isNull() | F.isnan("bed_m"), "no ground").when(F.col("datum_m") < F.col("bed_m"), "below the bed")
    return rows.withColumn("problem", problem).withColumn("depth_m", F.when(F.col("problem").isNull(), F.col("datum_m") - F.col("bed_m")))


def stage_field(cells: DataFrame, mode: str, depth: float, slope: float = 0.0) -> DataFrame:
    """cells with stage_m: one constant depth, or one that falls upstream by a slope (column distance_m; none keeps the depth)."""
    if depth < 0 or mode not in ("constant", "slope"):
        raise ValueError("a stage is constant or by slope, and not negative")
    return cells.withColumn("stage_m", F.lit(float(depth)) if mode == "constant" else slope_stage(F.col("distance_m"), depth, slope))


def best_gauge(snapped: DataFrame, by: str, cell_area: float) -> DataFrame:
    """Per unit, the snapped gauge (site, accumulation) of the largest drained area; the least site on a tie."""
    top = snapped.groupBy(by).agg(F.max_by(F.struct("site", "accumulation"), F.struct("accumulation", -F.col("site"))).alias("g"))
    return top.select(by, F.col("g.site").alias("site"), F.round(F.col("g.accumulation") * cell_area / 1e6, 1).alias("area_km2"))


def located_marks(marks: DataFrame, events: DataFrame) -> DataFrame:
    """marks with place and level, and the event's name and date ('' where the catalogue lacks it)."""
    known = events.select("event_id", F.col("name").alias("event_name"), F.col("date").alias("event_date"))
    good = marks.where("longitude_dd IS NOT NULL AND latitude_dd IS NOT NULL AND elev_ft IS NOT NULL")
    return good.join(known, "event_id", "left").withColumns({"event_name": F.coalesce("event_name", F.lit("")), "event_date": F.coalesce("event_date", F.lit(""))})


def placed_marks(marks: DataFrame, ground: DataFrame, cellsize: float, rows: int, cols: int) -> DataFrame:
    """marks (x, y from the top left, y downwards negative) with r, c and ground_m to the centimetre; those off the grid or without ground go."""
    at = marks.withColumns({"r": (-F.col("y") / cellsize).cast("int"), "c": (F.col("x") / cellsize).cast("int")}).where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < rows) & (F.col("c") < cols))
    return at.join(ground.where("z IS NOT NULL AND NOT isnan(z)").select("r", "c", F.round("z", 2).alias("ground_m")), ["r", "c"])


def event_matched(gauges: DataFrame, marks: DataFrame, peaks: DataFrame) -> DataFrame:
    """gauges (unit, site) with event_year, event_discharge_cms, event_date and matched_marks, null where nothing matches.

    The year is that of most marks of the unit (unit, event_date as text; on a tie the one seen first, by mark_id); the discharge is
    the gauge's largest peak in that year (site, date, cms).
    """
    years = marks.select("unit", F.substring(F.coalesce("event_date", F.lit("")), 1, 4).alias("year"), "mark_id").where("year <> ''")
    counts = years.groupBy("unit", "year").agg(F.count("*").alias("n"), F.min("mark_id").alias("seen"))
    usual = counts.groupBy("unit").agg(F.max_by(F.struct("year", "n"), F.struct("n", -F.col("seen"))).alias("u")).select("unit", F.col("u.year").alias("event_year"), F.col("u.n").alias("matched_marks"))
    top = peaks.select("site", F.substring("date", 1, 4).alias("event_year"), "cms", "date").groupBy("site", "event_year").agg(F.max_by(F.struct("cms", "date"), F.struct("cms", "date")).alias("p"))
    met = gauges.join(usual, "unit").join(top, ["site", "event_year"]).select("unit", "site", "event_year", F.col("p.cms").alias("event_discharge_cms"), F.col("p.date").alias("event_date"), "matched_marks")
    return gauges.join(met, ["unit", "site"], "left")


def larger_floods(peaks: DataFrame, events: DataFrame, most: int = 5) -> DataFrame:
    """site and floods: the peaks above the event's discharge, largest first, at most `most` of them (a report's list)."""
    above = peaks.join(events.select("site", "discharge_cms"), "site").where("cms > discharge_cms")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("cms"), "date"))
    kept = above.withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.round("cms").alias("cms"), "date"))), lambda x: F.struct(x["cms"].alias("cms"), x["date"].alias("date"))).alias("floods"))
