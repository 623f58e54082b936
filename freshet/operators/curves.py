"""Depth-damage curves as a small table: reading, checking, matching to buildings, and the Monte Carlo interval over them.

A curve table has family, class, component (structure or contents), depths (metres, ascending), fractions, sigmas and verified: a row
per curve, some hundreds at most whatever the inventory, which is what makes broadcasting it safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.scalar import clip, interp
from freshet.operators.exposure import CURVES, DEPTHS, NO_WATER_BELOW, curve_class, exposed_value, floor_margin, storey_exposure

SCHEMA = "family string, class string, component string, depths array<double>, fractions array<double>, sigmas array<double>, verified boolean"
FEET = 0.3048

_POINTS = "struct<source: string, damagefunction: struct<xvalues: array<double>, ydistributions: array<struct<parameters: struct<mean: double, value: double, standarddeviation: double>>>>>"
_OCCUPANCIES = f"occupancytypes map<string, struct<componentdamagefunctions: map<string, struct<damagefunctions: map<string, {_POINTS}>>>>>"
_FAMILIES = "map<string, struct<verified: boolean, classes: map<string, struct<depths_m: array<double>, fractions: array<double>>>>>"


def bundled(spark: SparkSession, families: dict = CURVES) -> DataFrame:
    """The built-in curves, unverified and without a published spread."""
    rows = [(f, k, "structure", list(DEPTHS), list(v), [0.0] * len(v), False) for f, classes in families.items() for k, v in classes.items()]
    return spark.createDataFrame(rows, SCHEMA)


def _running_max(values: Column) -> Column:
    return F.transform(values, lambda _, i: F.array_max(F.concat(F.array(F.lit(0.0)), F.slice(values, F.lit(1), i + 1))))


def occupancy_curves(texts: DataFrame, column: str = "json", family: str = "USACE") -> DataFrame:
    """Curves of occupancy files (a JSON text a row): feet to metres, percent to shares, made non-decreasing; verified.

    A component without a function of depth (or a default one) has no curve; deterministic points have no spread.
    """
    code = texts.select(F.explode(F.from_json(column, _OCCUPANCIES)["occupancytypes"]).alias("class", "entry"))
    part = code.select("class", F.explode("entry.componentdamagefunctions").alias("component", "found")).where("component IN ('structure', 'contents')")
    chosen = part.select("class", "component", F.coalesce(F.try_element_at("found.damagefunctions", F.lit("depth")), F.try_element_at("found.damagefunctions", F.lit("default"))).alias("f")).where("f.damagefunction IS NOT NULL")
    mean = lambda y: F.coalesce(y["parameters"]["mean"], y["parameters"]["value"]) / 100
    points = chosen.select("class", "component", F.transform("f.damagefunction.xvalues", lambda x: x * FEET).alias("depths"), F.transform("f.damagefunction.ydistributions", mean).alias("raw"), F.transform("f.damagefunction.ydistributions", lambda y: F.coalesce(y["parameters"]["standarddeviation"], F.lit(0.0)) / 100).alias("sigmas"))
    return points.select(F.lit(family).alias("family"), "class", "component", "depths", _running_max(F.col("raw")).alias("fractions"), "sigmas", F.lit(True).alias("verified"))


def family_curves(texts: DataFrame, column: str = "json") -> DataFrame:
    """Curves of files that map families to classes to points (a JSON text a row)."""
    family = texts.select(F.explode(F.from_json(column, _FAMILIES)).alias("family", "entry"))
    return family.select("family", F.coalesce("entry.verified", F.lit(False)).alias("verified"), F.explode("entry.classes").alias("class", "p")).select("family", "class", F.lit("structure").alias("component"), F.col("p.depths_m").alias("depths"), F.col("p.fractions").alias("fractions"), F.transform("p.fractions", lambda _: F.lit(0.0)).alias("sigmas"), "verified")


def problems(curves: DataFrame, default: str | None = None) -> DataFrame:
    """family, class, component and problem of each curve that cannot be interpolated; with default, also families without that class."""
    rising = lambda xs, strict: ~F.exists(F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda a, b: b <= a if strict else b < a), lambda x: x)
    d, f = F.col("depths"), F.col("fractions")
    long = F.size(d) >= 2
    why = F.when(F.size(d) != F.size(f), "lengths differ").when(~long, "fewer than two points").when(~rising(d, True), "depths do not ascend").when(~rising(f, False), "fractions decrease").when(F.exists(f, lambda x: (x < 0) | (x > 1)), "fractions outside of 0 to 1")
    bad = curves.select("family", "class", "component", why.alias("problem")).where("problem IS NOT NULL")
    if default is None:
        return bad
    lacking = curves.where("component = 'structure'").groupBy("family").agg(F.max((F.col("class") == default).cast("int")).alias("has")).where("has = 0")
    return bad.unionByName(lacking.select("family", F.lit(default).alias("class"), F.lit("structure").alias("component"), F.lit("no default class").alias("problem")))


def checked(curves: DataFrame, default: str | None = None) -> DataFrame:
    """curves, or ValueError that names the first bad ones."""
    bad = problems(curves, default).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['family']}/{r['class']}/{r['component']}: {r['problem']}" for r in bad))
    return curves


def breakpoints(curves: DataFrame, cap: float = 6.0) -> DataFrame:
    """family and depth_m: the places that any curve of a family bends at, up to the cap, which is one too."""
    own = curves.where("component = 'structure'").select("family", F.explode("depths").alias("depth_m")).where(F.col("depth_m") <= cap)
    return own.unionByName(curves.select("family", F.lit(cap).alias("depth_m"))).distinct()


def matched(buildings: DataFrame, curves: DataFrame, family: str, component: str = "structure", default: str = "residential", prefix: str = "") -> DataFrame:
    """buildings with the depths, fractions and sigmas of their class's curve: exact, else generic, else the default class."""
    own = curves.where((F.col("family") == family) & (F.col("component") == component))
    known = sorted(r["class"] for r in own.select("class").distinct().collect())  # a curve table's classes
    names = {c: f"{prefix}{c}" for c in ("depths", "fractions", "sigmas")}
    own = F.broadcast(own.select(F.col("class").alias("class_"), *[F.col(c).alias(n) for c, n in names.items()]))
    return buildings.withColumn("class_", curve_class(F.col("building_class"), known, default)).join(own, "class_", "left").drop("class_")


def curve_fraction(depth: Column, z: Column | float = 0.0, cap: float = 6.0, prefix: str = "") -> Column:
    """The curve's share at a depth, shifted by z published standard deviations and held in [0, 1]; 0 without water."""
    x = F.least(depth, F.lit(cap))
    share = interp(x, F.col(f"{prefix}depths"), F.col(f"{prefix}fractions"))
    if not (isinstance(z, float) and z == 0.0):
        share = share + z * interp(x, F.col(f"{prefix}depths"), F.col(f"{prefix}sigmas"))
    return F.when(depth <= NO_WATER_BELOW, 0.0).otherwise(clip(share, 0.0, 1.0))


def refuse_clamped(buildings: DataFrame, curves: DataFrame) -> None:
    """ValueError if curves that start below the floor meet depths of exactly 0 with none below: the mark of clamped depths."""
    low = curves.where("component = 'structure'").agg(F.min(F.element_at("depths", 1)).alias("low")).first()["low"]
    if low is None or low >= 0:
        return
    seen = buildings.agg(F.count_if(F.col("margin_m") == 0).alias("zero"), F.count_if(F.col("margin_m") < 0).alias("below")).first()
    if seen["zero"] and not seen["below"]:
        raise ValueError(f"{seen['zero']} depths are exactly 0 and none is negative; give signed margins")


def priced(buildings: DataFrame, curves: DataFrame, family: str, default: str = "residential", contents: bool = False, cost_scale: float = 1.0, z: float = 0.0, storeys: bool = True) -> DataFrame:
    """buildings with fraction, exposed, structure, contents and damage.

    buildings: margin_m, building_class, storeys, and structure_value or floor_area_m2; with contents, contents_value too, priced on
    the contents curves of the family (the default class where its code has none). Contents need both values and curves: one without
    the other is an error, as a total would leave them out without anyone noticing.
    """
    if contents and ("contents_value" not in buildings.columns or curves.where((F.col("family") == family) & (F.col("component") == "contents")).isEmpty()):
        raise ValueError(f"contents need a column contents_value and contents curves of {family}")
    refuse_clamped(buildings, curves.where(F.col("family") == family))
    reach = storey_exposure(F.col("margin_m"), F.col("storeys")) if storeys else F.lit(1.0)
    value = F.col("structure_value") * cost_scale if "structure_value" in buildings.columns else exposed_value(F.col("floor_area_m2"), F.col("building_class"), cost_scale)
    rows = matched(buildings, curves, family, "structure", default, "s_")
    rows = rows.withColumns({"fraction": curve_fraction(F.col("margin_m"), z, prefix="s_") * reach, "exposed": value}).withColumn("structure", F.col("fraction") * F.col("exposed"))
    if contents:
        rows = matched(rows, curves, family, "contents", default, "c_").withColumn("contents", curve_fraction(F.col("margin_m"), z, prefix="c_") * reach * F.col("contents_value") * cost_scale)
    else:
        rows = rows.withColumn("contents", F.lit(0.0))
    return rows.withColumn("damage", F.col("structure") + F.col("contents")).select(*buildings.columns, "fraction", "exposed", "structure", "contents", "damage")


def totals(damaged: DataFrame) -> DataFrame:
    """One row: damage, structure, contents, exposed, n, n_damaged and loss_ratio."""
    sums = damaged.agg(F.sum("damage").alias("damage"), F.sum("structure").alias("structure"), F.sum("contents").alias("contents"), F.sum("exposed").alias("exposed"), F.count("*").alias("n"), F.count_if(F.col("damage") > 0).alias("n_damaged"))
    return sums.withColumn("loss_ratio", F.coalesce(F.try_divide("damage", "exposed"), F.lit(0.0)))


def top_classes(damaged: DataFrame, n: int = 8) -> DataFrame:
    """The n classes of most damage: a report's limit."""
    return damaged.groupBy("building_class").agg(F.sum("damage").alias("damage")).orderBy(F.desc("damage"), "building_class").limit(n)


def priced_ladder(buildings: DataFrame, stages: DataFrame, curves: DataFrame, family: str, default: str = "residential", contents: bool = False) -> DataFrame:
    """multiplier, damage, structure, contents, wet, in_channel (damage at heights of 0 or less) and its share, per rung of the stage table."""
    rows = buildings.where("reach IS NOT NULL AND hand IS NOT NULL").join(stages, "reach").withColumn("margin_m", floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))
    hit = priced(rows, curves, family, default, contents)
    sums = hit.groupBy("multiplier").agg(*[F.sum(c).alias(c) for c in ("damage", "structure", "contents")], F.count_if(F.col("margin_m") > 0).alias("wet"), F.sum(F.when(F.col("hand") <= 0, F.col("damage")).otherwise(0.0)).alias("in_channel"))
    return sums.withColumn("share", F.coalesce(F.try_divide("in_channel", "damage"), F.lit(0.0)))


# Draws. A uniform number is a mixed integer of (seed, kind, draw, building), so it depends on no partition, and SQL can repeat it.

_BITS = 30
_SPACE = 1 << _BITS


def mixed(key: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Three rounds of a quadratic permutation and a half rotation of 30-bit integers."""
    x = key % _SPACE
    for k in range(rounds):
        x = (x * (2 * x + 1) + 2654435 * (k + 1)) % _SPACE
        x = (x >> 15) + (x % 32768) * 32768
    return x


def uniform(seed: int, kind: int, draw: np.ndarray, building: np.ndarray | int = 0) -> np.ndarray:
    first = mixed(np.asarray(building, np.int64) + 7919 * kind + seed)
    return (mixed(first + np.asarray(draw, np.int64) * 104729) + 0.5) / _SPACE


def normal(seed: int, kind: int, draw: np.ndarray, building: np.ndarray | int = 0) -> np.ndarray:
    """Standard normal numbers from two uniform ones."""
    return np.sqrt(-2 * np.log(uniform(seed, 2 * kind, draw, building))) * np.cos(2 * np.pi * uniform(seed, 2 * kind + 1, draw, building))


def monte_carlo(buildings: DataFrame, curves: DataFrame, weights: dict[str, float], draws: int = 1000, seed: int = 20220228, sigma_stage: float = 0.15, sigma_dem: float = 0.15, sigma_cost: float = 0.25, default: str = "residential", contents: bool = False, block: int = 256) -> DataFrame:
    """Partial figures of every draw and the expected damage of every building, in one vectorised pass.

    Rows with draw, total and wet hold a task's sums of a draw; rows with building_id and expected hold a building's mean damage. A
    draw picks a family by weight, one shift of the stage, one multiplier of cost (log-normal of median 1) and one number of published
    standard deviations of the curves; the error of the ground is drawn for each building and draw. Depths are not clamped.
    buildings: building_id (a whole number), margin_m, building_class, storeys, and structure_value or floor_area_m2; with contents,
    contents_value. A task holds `block` buildings times draws at a time.
    """
    table = {(r["family"], r["component"], r["class"]): (np.array(r["depths"]), np.array(r["fractions"]), np.array(r["sigmas"])) for r in curves.where(F.col("family").isin(list(weights))).collect()}
    names = list(weights)
    value = F.col("structure_value") if "structure_value" in buildings.columns else exposed_value(F.col("floor_area_m2"), F.col("building_class"))
    classes = {name: curve_class(F.col("building_class"), sorted(k for f, part, k in table if f == name and part == "structure"), default) for name in names}
    inside = {name: curve_class(F.col("building_class"), sorted(k for f, part, k in table if f == name and part == "contents"), default) for name in names} if contents else {}
    rows = buildings.select(F.col("building_id").cast("long").alias("building_id"), F.col("margin_m").cast("double"), F.col("storeys").cast("double"), value.cast("double").alias("value"), (F.col("contents_value") if contents else F.lit(0.0)).cast("double").alias("inside"), *[c.alias(f"s{i}") for i, c in enumerate(classes.values())], *[c.alias(f"c{i}") for i, c in enumerate(inside.values())])
    cap = 6.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = np.arange(draws)
        p = np.cumsum(np.array([weights[n] for n in names])) / sum(weights.values())
        family = np.minimum(np.searchsorted(p, uniform(seed, 0, each), side="right"), len(names) - 1)
        stage, cost, shift = normal(seed, 1, each) * sigma_stage, np.exp(normal(seed, 2, each) * sigma_cost), normal(seed, 3, each)
        sums, wet = np.zeros(draws), np.zeros(draws, np.int64)

        def share(part: str, i: int, column: pa.Array, depth: np.ndarray, mine: np.ndarray) -> np.ndarray:
            out, names_ = np.zeros((len(column), int(mine.sum()))), np.array(column.to_pylist())
            for name in set(names_.tolist()):
                at, (depths, fractions, sigmas) = names_ == name, table[names[i], part, name]
                x = np.minimum(depth[at][:, mine], cap)
                out[at] = np.clip(np.interp(x, depths, fractions) + shift[mine] * np.interp(x, depths, sigmas), 0, 1)
            return out

        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                ids, margin, floors, worth, goods = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                dry = margin <= NO_WATER_BELOW
                depth = margin[:, None] + stage + normal(seed, 4, each[None, :], ids[:, None]) * sigma_dem
                n = np.maximum(floors, 1.0)[:, None]
                reach = np.clip(np.ceil(np.maximum(depth, 0) / 3.0), 1, n) / n
                damage = np.zeros_like(depth)
                for i in range(len(names)):
                    mine = family == i
                    if mine.any():
                        damage[:, mine] = share("structure", i, batch.column(5 + i), depth, mine) * worth[:, None]
                        if contents:
                            damage[:, mine] += share("contents", i, batch.column(5 + len(names) + i), depth, mine) * goods[:, None]
                damage *= reach * cost
                damage[dry] = 0.0
                sums += damage.sum(axis=0)
                wet += ((depth > 0) & ~dry[:, None]).sum(axis=0)
                none = pa.nulls(len(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([none, pa.nulls(len(ids), pa.float64()), pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(damage.mean(axis=1))], ["draw", "total", "wet", "building_id", "expected"])
        yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array(sums), pa.array(wet), pa.nulls(draws, pa.int64()), pa.nulls(draws, pa.float64())], ["draw", "total", "wet", "building_id", "expected"])

    return rows.mapInArrow(run, "draw int, total double, wet long, building_id long, expected double")


def draw_totals(figures: DataFrame) -> DataFrame:
    """draw, total and wet of every draw."""
    return figures.where("draw IS NOT NULL").groupBy("draw").agg(F.sum("total").alias("total"), F.sum("wet").alias("wet"))


def expected_damage(figures: DataFrame) -> DataFrame:
    """building_id and its mean damage over the draws."""
    return figures.where("building_id IS NOT NULL").select("building_id", "expected")


def uncertainty_budget(buildings: DataFrame, curves: DataFrame, weights: dict[str, float], lead: str, point: float, draws: int = 1000, **more) -> DataFrame:
    """term and width_pct: the 5 to 95 % width with all terms, and with each alone, in percent of the point estimate."""
    from freshet.operators.exposure import interval

    alone = {lead: 1.0}
    cases = {"all": (weights, {}), "stage": (alone, {"sigma_dem": 0.0, "sigma_cost": 0.0}), "dem": (alone, {"sigma_stage": 0.0, "sigma_cost": 0.0}), "cost": (alone, {"sigma_stage": 0.0, "sigma_dem": 0.0}), "curve": (weights, {"sigma_stage": 0.0, "sigma_dem": 0.0, "sigma_cost": 0.0})}
    out = None
    for term, (mix, sigmas) in cases.items():
        one = interval(draw_totals(monte_carlo(buildings, curves, mix, draws, **{**more, **sigmas}))).select(F.lit(term).alias("term"), (100 * (F.col("high") - F.col("low")) / point).alias("width_pct"))
        out = one if out is None else out.unionByName(one)
    return out
