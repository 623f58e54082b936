"""Area-weighted overlay of polygons, in column expressions; a ring is an array of structs (x, y) in an equal-area projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "array<struct<x:double,y:double>>"


def _turned(ring: Column, by: int = 1) -> Column:
    """The ring begun at its second point, so that a zip with the ring gives its edges."""
    return F.when(F.size(ring) > 0, F.concat(F.slice(ring, by + 1, F.size(ring)), F.slice(ring, 1, by))).otherwise(ring)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive if the ring runs counter-clockwise."""
    terms = F.zip_with(ring, _turned(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clip(ring: Column, window: Column) -> Column:
    """The part of a simple ring inside a convex window: cut by each edge of the window in turn."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.array().cast(POINT)
    ccw = F.when(signed_area(window) < 0, F.reverse(window)).otherwise(window)
    edges = _let(ccw, lambda w: F.zip_with(w, _turned(w), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))))

    def pair(p: Column, q: Column) -> Column:
        """What the edge from p to q leaves, by the sides s of its ends."""
        share = F.try_divide(p["s"], p["s"] - q["s"])
        cross = point(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share)
        here, there = p["s"] >= 0, q["s"] >= 0
        mine = point(p["x"], p["y"])
        return F.when(here & there, F.array(mine)).when(here, F.array(mine, cross)).when(there, F.array(cross)).otherwise(none)

    def cut(kept: Column, e: Column) -> Column:
        sided = F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (e["dx"] * (p["y"] - e["y"]) - e["dy"] * (p["x"] - e["x"])).alias("s")))
        return F.flatten(_let(sided, lambda k: F.zip_with(k, _turned(k), pair))).cast(POINT)

    return F.aggregate(edges, ring.cast(POINT), cut)


def _convex(ring: Column) -> Column:
    """Whether a ring turns one way only."""
    turn = F.zip_with(F.zip_with(ring, _turned(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), _turned(ring, 2), lambda e, c: (e["b"]["x"] - e["a"]["x"]) * (c["y"] - e["b"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (c["x"] - e["b"]["x"]))
    return _let(turn, lambda t: F.forall(t, lambda x: x >= 0) | F.forall(t, lambda x: x <= 0))


def _shared_area(ring: Column, window: Column) -> Column:
    """Area of the overlap with any simple window: over the triangles of a fan, those that turn against the window taken off."""
    fan = F.transform(F.sequence(F.lit(1), F.size(window) - 2), lambda i: F.array(F.get(window, F.lit(0)), F.get(window, i), F.get(window, i + 1)))
    part = F.transform(fan, lambda t: F.signum(signed_area(t)) * F.abs(_let(clip(ring, t), signed_area)))
    return F.abs(F.aggregate(part, F.lit(0.0), lambda s, x: s + x))


def inside_share(ring: Column, window: Column) -> Column:
    """Share of a simple window's area that the ring covers, 0 to 1; 0 for a window without area. A convex window is cut out at once."""
    shared = F.when(F.size(window) < 3, 0.0).when(_convex(window), F.abs(_let(clip(ring, window), signed_area))).otherwise(_shared_area(ring, window))
    share = F.try_divide(shared, F.abs(signed_area(window)))
    return F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def weigh_claims(groups: DataFrame, claims: DataFrame, watersheds: DataFrame) -> DataFrame:
    """huc, claims, paid, matched: claims (group, n, paid) of groups (group, ring), by the share inside watersheds (huc, ring).

    Groups and watersheds meet by grid squares of the larger extent, never all with all: a group has a row per square it touches.
    """
    known = claims.where("n > 0")
    met = _meeting(groups.join(known, "group").select("group", "n", "paid", F.col("ring").alias("g")), watersheds.select("huc", F.col("ring").alias("w")))
    shares = met.select("huc", "n", "paid", inside_share(F.col("w"), F.col("g")).alias("share"))
    found = shares.groupBy("huc").agg(F.sum(F.col("n") * F.col("share")).alias("claims"), F.sum(F.col("paid") * F.col("share")).alias("paid"), F.count_if(F.col("share") > 0).alias("matched"))
    return watersheds.select("huc").join(found, "huc", "left").select("huc", F.coalesce(F.round("claims"), F.lit(0.0)).cast("long").alias("claims"), F.coalesce("paid", F.lit(0.0)).alias("paid"), F.coalesce("matched", F.lit(0)).alias("matched"))


def _meeting(groups: DataFrame, watersheds: DataFrame, square: float = 10_000.0) -> DataFrame:
    """Pairs whose bounding boxes overlap, each once, spread evenly, as cutting rings is the costly part."""

    def boxes(df: DataFrame, ring: str, name: str) -> DataFrame:
        ends = [f(F.col(ring)[k]).alias(f"{name}_{k}{i}") for k in "xy" for i, f in enumerate((F.array_min, F.array_max))]
        at = lambda c: F.floor(F.col(f"{name}_{c}") / square).cast("long")
        wide = df.select("*", *ends).withColumn("sx", F.explode(F.sequence(at("x0"), at("x1"))))
        return wide.withColumn("sy", F.explode(F.sequence(at("y0"), at("y1")))).drop(ring)

    met = boxes(groups.select("group", "g"), "g", "a").join(boxes(watersheds, "w", "b"), ["sx", "sy"])
    overlap = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    pairs = met.where(overlap).select("group", "huc").distinct()
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(groups, "group").join(watersheds, "huc").repartition(parts, "huc", "group")
