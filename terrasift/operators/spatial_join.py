"""Spatial self-joins as equi-joins on the cells of a grid with levels.

A geometry is filed in the cells of the level whose cells are as wide as its box, four at most, and looked up in the
cells of the wider levels too. A pair is kept only in the cell that holds the corner (greatest xmin, greatest
ymin) of the two boxes, so none comes twice and no distinct is needed. Large boxes cost a row or four a level
instead of thousands of cells, and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import geo_box

#: A level's cells are so many times as wide as the one below's.
STEP = 8.0


def boxed(df: DataFrame, geom: str, grow: float = 0.0) -> DataFrame:
    """df with column box, grown on all sides; rows without a box are left out."""
    b = F.col("__b")
    grown = F.struct((b["xmin"] - grow).alias("xmin"), (b["ymin"] - grow).alias("ymin"), (b["xmax"] + grow).alias("xmax"), (b["ymax"] + grow).alias("ymax"))
    return df.withColumn("__b", geo_box(F.col(geom))).where(b["xmin"].isNotNull()).withColumn("box", grown).drop("__b")


def cell_width(boxes: DataFrame) -> tuple[float, list[int]] | None:
    """Width of level 0's cells, twice the median extent, and the levels that boxes need."""
    b = F.col("box")
    extent = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    got = boxes.agg(
        F.count("*").alias("n"), F.percentile_approx(extent, 0.5, 1000).alias("mid"), F.max(extent).alias("most"),
        F.greatest(F.max(b["xmax"]) - F.min(b["xmin"]), F.max(b["ymax"]) - F.min(b["ymin"])).alias("span"),
    ).first()
    if not got.n:
        return None
    # Points have no extent: cells that hold about one of them, were they spread evenly.
    width = max(2 * got.mid, got.span / max(1.0, got.n) ** 0.5 if got.mid == 0 else 0.0, got.span * 1e-9) or 1.0
    top, levels = width, 1
    while top < got.most:
        top, levels = top * STEP, levels + 1
    return width, list(range(levels))


def pairs(df: DataFrame, fid: str, geom: str, grow: float = 0.0, closed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(l, r, gl, gr, and l_x, r_x of each column x to keep) of rows l < r whose boxes meet.

    grow widens every box on all sides (half the distance of a range join). closed: boxes that only touch count.
    """
    boxes = boxed(df.select(fid, geom, *keep), geom, grow)
    found = cell_width(boxes)
    width, levels = found or (1.0, [0])
    b = F.col("box")
    extent = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(extent, F.lit(1e-300)) / width) / F.log(F.lit(STEP)))).cast("int")
    rows = boxes.withColumn("own", level).withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("own"))))
    size = F.lit(width) * F.pow(F.lit(STEP), F.col("level"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(b[lo] / size), F.floor(b[hi] / size)))
    rows = rows.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    names = [fid, geom, *keep, "box", "own"]
    left = rows.where("own = level").select("level", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in names])
    right = rows.select("level", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in names])
    x, y = F.col("a_box"), F.col("b_box")
    less = (lambda p, q: p <= q) if closed else (lambda p, q: p < q)
    meet = less(x["xmin"], y["xmax"]) & less(y["xmin"], x["xmax"]) & less(x["ymin"], y["ymax"]) & less(y["ymin"], x["ymax"])
    corner = (F.col("cx") == F.floor(F.greatest(x["xmin"], y["xmin"]) / size)) & (F.col("cy") == F.floor(F.greatest(x["ymin"], y["ymin"]) / size))
    once = F.when(F.col("b_own") == F.col("level"), F.col(f"a_{fid}") < F.col(f"b_{fid}")).otherwise(F.col(f"a_{fid}") != F.col(f"b_{fid}"))
    joined = left.join(right, ["level", "cx", "cy"]).where(once & meet & corner)
    swap = F.col(f"a_{fid}") > F.col(f"b_{fid}")
    first = lambda c: F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    second = lambda c: F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    return joined.select(first(fid).alias("l"), second(fid).alias("r"), first(geom).alias("gl"), second(geom).alias("gr"), *[f(c).alias(f"{s}_{c}") for c in keep for s, f in (("l", first), ("r", second))])


def flagged(found: DataFrame) -> DataFrame:
    """Distinct ids on either side of pairs (l, r), as column fid."""
    return found.select(F.explode(F.array("l", "r")).alias("fid")).distinct()


