"""Validation and display: extent and mark scores, rank correlation, comparison with claims, reductions and quantised layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalar import log_scale
from freshet.operators.graph import spread_join
from freshet.sources.store import written


def extent_metrics(pairs: DataFrame) -> DataFrame:
    """Hits, misses, false alarms, correct negatives and scores of boolean columns model and reference; 0/0 is null."""
    m, t = F.col("model"), F.col("reference")
    counts = pairs.agg(F.count_if(m & t).alias("hits"), F.count_if(~m & t).alias("misses"), F.count_if(m & ~t).alias("false_alarms"), F.count_if(~m & ~t).alias("correct_negatives"))
    h, x, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return counts.withColumns({"csi": F.try_divide(h, h + x + f), "hit_rate": F.try_divide(h, h + x), "far": F.try_divide(f, h + f), "bias": F.try_divide(h + f, h + x)})


def scorable_marks(marks: DataFrame, graded_only: bool = True) -> DataFrame:
    """Marks that are not coastal and, with graded_only, of quality 1 or 2."""
    inland = F.lower(F.coalesce("environment", F.lit(""))) != "coastal"
    return marks.where(inland & F.col("quality").isin(1, 2)) if graded_only else marks.where(inland)


def mark_metrics(marks: DataFrame) -> DataFrame:
    """n, rmse, bias, median absolute error and share wet; columns surface_m, ground_m, observed_m; dry marks count at the ground."""
    error = F.coalesce("surface_m", "ground_m") - F.col("observed_m")
    rows = written(marks.select(error.alias("e"), F.abs(error).alias("v"), F.col("surface_m").isNotNull().cast("double").alias("wet")), "errors")
    n = rows.where("v IS NOT NULL").count()
    middle = at_places(rows.select("v"), "v", [(n - 1) // 2, n // 2]) if n else None
    sums = rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.avg("wet").alias("recall"))
    return sums.select("n", "rmse", "bias", F.lit(None if middle is None else sum(middle) / 2).cast("double").alias("median_abs"), "recall")


def _ranged(df: DataFrame, value: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The distinct values with their counts n in range partitions (part), and (part, values before it, values in it)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange(parts, value).withColumn("part", F.spark_partition_id()), "ranks")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per partition
    out, at = [], 0
    for part, n in sizes:
        out.append((part, at, n))
        at += n
    return placed, out


def implied_discharge(marks: DataFrame, stages: DataFrame, least_wet: float = 0.7) -> DataFrame:
    """multiplier, n, rmse, wet and chosen: how well each rung of the discharge fits the marks, in one pass over marks and rungs.

    marks: reach, hand, ground_m, observed_m; stages: reach, multiplier, stage_m. A mark that stays dry, or lies on no reach, is scored at the ground. The
    discharge that the marks imply is the rung of the least error among those that wet at least `least_wet` of them (the smaller
    one on a tie); without such a rung none is chosen.
    """
    known = marks.where("observed_m IS NOT NULL AND ground_m IS NOT NULL").select("reach", "hand", "ground_m", "observed_m")
    depth = F.coalesce(F.greatest(F.col("stage_m") - F.col("hand"), F.lit(0.0)), F.lit(0.0))
    rungs = stages.select("multiplier").distinct()  # some tens
    rows = known.crossJoin(F.broadcast(rungs)).join(stages.select("reach", "multiplier", "stage_m"), ["reach", "multiplier"], "left").select("multiplier", (depth > 0).alias("wet"), (F.col("ground_m") + depth - F.col("observed_m")).alias("e"))
    fit = rows.groupBy("multiplier").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.col("wet").cast("double")).alias("wet"))
    best = fit.where(F.col("wet") >= least_wet).agg(F.min(F.struct("rmse", "multiplier"))["multiplier"].alias("best"))  # one row
    return fit.crossJoin(F.broadcast(best)).select("multiplier", "n", "rmse", "wet", F.coalesce(F.col("multiplier") == F.col("best"), F.lit(False)).alias("chosen"))


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank of value, ties at their mean: counts per value, ranked over the distinct values.

    The running count goes over range partitions and their starts, so that no task sees all rows.
    """
    placed, starts = _ranged(df, value)
    pairs = [F.lit(x) for part, at, _ in starts for x in (part, at)]
    offset = F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(0)
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(value))
    ranked = placed.select(value, (offset + upto - (F.col("n") - 1) / 2.0).alias(name), "n")
    return spread_join(df, ranked.drop("n"), value, value if len(df.columns) == 1 else next(c for c in df.columns if c != value), counts=ranked.select(value, "n"), total=sum(n for _, _, n in starts))


def at_places(df: DataFrame, value: str, places: list[int]) -> list:
    """The values at places (from 0) of the sorted rows, by range partitions: only those that hold a place are looked into."""
    placed, starts = _ranged(df.where(F.col(value).isNotNull()), value)
    found = []
    for place in places:
        part, at, _ = next(s for s in starts if s[1] <= place < s[1] + s[2])
        upto = F.sum("n").over(Window.partitionBy("part").orderBy(value))
        found.append(placed.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") > place - at).agg(F.min(value).alias("v")).first()["v"])
    return found


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns, ties at their mean rank; null under three rows."""
    ranked = mean_ranks(mean_ranks(df.select(x, y), x, "rx"), y, "ry")
    return ranked.agg(F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def upper_median(df: DataFrame, value: Column) -> DataFrame:
    """The value at place n div 2 (from 0) of the sorted ones, and n; no task holds all values."""
    rows = df.select(value.alias("v")).where("v IS NOT NULL")
    n = rows.count()
    found = at_places(rows, "v", [n // 2])[0] if n else None
    return df.sparkSession.createDataFrame([(None if found is None else float(found), n)], "median double, n long")


def compare_tracts(model: DataFrame, claims: DataFrame, aid: DataFrame) -> DataFrame:
    """tract, modelled, wet, paid, claims, aid: joined by key, what is missing counts 0; tracts with modelled damage only."""
    z = lambda c: F.coalesce(c, F.lit(0))
    both = model.where("modelled > 0").join(claims, "tract", "left").join(aid, "tract", "left")
    return both.select("tract", "modelled", "wet", z("paid").alias("paid"), z("claims").alias("claims"), z("aid").alias("aid"))


def tract_scores(tracts: DataFrame, claims: DataFrame | None = None, aid: DataFrame | None = None) -> DataFrame:
    """One row over compared tracts: how many are modelled, how many have both series, rank correlations and ratios over those.

    Two observed series that measure the same flood bound what any model can reach, so paid claims are ranked against aid beside modelled damage
    against each; only tracts where both are positive count. Ratios are upper medians. claims and aid give totals of all tracts, also
    of those without modelled damage.
    """
    both = written(tracts.where("paid > 0 AND aid > 0"), "tracts")
    rho = lambda x, y, name: spearman(both, x, y).select(F.col("rho").alias(name))
    ratio = lambda y, name: upper_median(both, F.col("modelled") / F.col(y)).select(F.col("median").alias(name))
    out = tracts.agg(F.count("*").alias("n_modelled"), F.count_if((F.col("paid") > 0) & (F.col("aid") > 0)).alias("n_both"))
    totals = [x.agg(F.coalesce(F.sum(v), F.lit(0)).alias(n)) for x, v, n in ((claims, "paid", "paid_total"), (claims, "claims", "claims_total"), (aid, "aid", "aid_total")) if x is not None]
    for one in (rho("paid", "aid", "rho_paid_aid"), rho("modelled", "paid", "rho_paid"), rho("modelled", "aid", "rho_aid"), ratio("paid", "ratio_paid"), ratio("aid", "ratio_aid"), *totals):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def against_interval(claims: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Claims filed (key, claims, paid) beside the model's count of flooded buildings (key, low, modelled, high) and its damage.

    ratio: buildings modelled for each claim; damage_ratio: modelled damage for each unit paid; model_below_claims: even the top of the
    interval lies under the claims, the one direction that is a failure for sure.
    """
    both = intervals.join(claims, key, "left").withColumns({"claims": F.coalesce("claims", F.lit(0)), "paid": F.coalesce("paid", F.lit(0.0))})
    over = lambda a, b: F.try_divide(F.col(a).cast("double"), F.when(F.col(b) > 0, F.col(b)))
    return both.select(key, "claims", "paid", over("modelled", "claims").alias("ratio"), over("damage", "paid").alias("damage_ratio"), F.col("claims").between(F.col("low"), F.col("high")).alias("inside"), (F.col("high") < F.col("claims")).alias("model_below_claims"))


def count_within(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """inside and n: how many values lie between low and high, both included."""
    return rows.agg(F.count_if(F.col(value).between(low, high)).alias("inside"), F.count("*").alias("n"))


def block_reduce(cells: DataFrame, factor: int, how: str, rows: int, cols: int) -> DataFrame:
    """r, c, v per block of factor * factor cells: mean, max or sum of value; missing cells ignored, partial blocks left out."""
    agg = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    inside = (F.col("r") < rows // factor * factor) & (F.col("c") < cols // factor * factor)
    block = lambda k: F.floor(F.col(k) / factor).cast("int").alias(k)
    return cells.where(inside).groupBy(block("r"), block("c")).agg(agg("value").alias("v"))


def rasterise_damage(points: DataFrame, cellsize: float) -> DataFrame:
    """r, c, damage, n: sums by the cell of each centroid (x, y from the top left, y downwards negative)."""
    at = lambda x: F.floor(x / cellsize).cast("int")
    return points.groupBy(at(-F.col("y")).alias("r"), at(F.col("x")).alias("c")).agg(F.sum("damage").alias("damage"), F.count("*").alias("n"))


def damage_layer(grid: DataFrame) -> DataFrame:
    """The raster's damage on a logarithmic byte scale."""
    return grid.withColumn("shade", log_scale(F.col("damage")))


def drift(now: DataFrame, golden: DataFrame, tolerance: float) -> DataFrame:
    """key, value, expected, drifted: relative difference beyond the tolerance; keys that fail to be computed keep their old value."""
    both = golden.join(now, "key", "left")
    gap = F.abs(F.col("value") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-12))
    return both.select("key", F.coalesce("value", "expected").alias("value"), "expected", F.coalesce(gap > tolerance, F.lit(False)).alias("drifted"))


def evict_to_budget(files: DataFrame, budget: int) -> DataFrame:
    """Files (path, mtime, size, unit) to delete, oldest first within each unit, until what stays is within the budget.

    The running size goes over range partitions of (unit, newest first) and what lies before each of them in the unit, so that a unit
    of any size is spread over tasks.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("unit"), F.col("mtime").desc(), F.col("path")]
    placed = written(files.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "files")
    sums = placed.groupBy("unit", "part").agg(F.sum("size").alias("held"))  # partitions + units rows at most
    before = sums.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    upto = F.sum("size").over(Window.partitionBy("unit", "part").orderBy(F.col("mtime").desc(), "path").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("upto", upto).join(before, ["unit", "part"]).where(F.col("upto") + F.col("before") > budget).select(*files.columns)


def first_valid(tiles: DataFrame) -> DataFrame:
    """Mosaic: of the rows (cell, ord, z) of a cell, the valid one of least ord."""
    good = F.col("z").isNotNull() & ~F.isnan("z")
    return tiles.groupBy("cell").agg(F.min_by(F.when(good, F.col("z")), F.when(good, F.col("ord"))).alias("z"))
