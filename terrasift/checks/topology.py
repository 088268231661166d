"""Overlaps, gaps and dangling line ends, in metric coordinates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.checks.base import ISSUES, Results, to_metric
from terrasift.config import TopologyRule
from terrasift.functions.geo import geo_area, geo_ends, geo_intersection_area, geo_is_empty, geo_repair, geo_type, round_half_even
from terrasift.geom import kernel, wkb
from terrasift.model import FID, CheckResult, Issue, LayerFrame, Status
from terrasift.operators.components import ensure_checkpoint_dir, labelled
from terrasift.operators.spatial_join import boxed, cell_width, flagged, pairs

POLYGONS, LINES = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString")
#: Shared areas up to this part of the larger polygon are rounding.
NOISE = 1e-9
#: A tile's width in cells of the join's grid, and polygons united at once.
TILE, PART = 8, 1000


def run(frame: LayerFrame, layer: str, source: str, rule: TopologyRule) -> list[CheckResult]:
    if not rule.enabled or not frame.has_geometry:
        return []
    out = Results("topology", layer, source, rule.severity)
    metric, note = to_metric(frame)
    g = F.col(metric.geom_col)
    work = metric.df.where(g.isNotNull()).select(FID, g.alias("g"), geo_type(g).alias("type"))
    work = work.where(~geo_is_empty(F.col("g")))
    polygons = repaired(work)
    if rule.no_overlaps:
        _overlaps(polygons, rule, out)
    if rule.no_gaps:
        _gaps(polygons, rule, out)
    if rule.no_dangles:
        _dangles(work, rule, out)
    if note:
        for r in out.found:
            r.message = f"{r.message} [{note}]"
    return out.found


def repaired(work: DataFrame) -> DataFrame:
    """Polygons of a layer, each made valid."""
    return work.where(F.col("type").isin(*POLYGONS)).select(FID, geo_repair("g").alias("g")).where(~geo_is_empty(F.col("g")))


def overlap_pairs(polygons: DataFrame, min_area: float = 0.0) -> DataFrame:
    """(l, r, area) of polygons that share more area than min_area and rounding."""
    sized = polygons.withColumn("size", geo_area("g"))
    found = pairs(sized, FID, "g", closed=False, keep=("size",)).withColumn("area", geo_intersection_area("gl", "gr"))
    noise = F.lit(NOISE) * F.greatest(F.col("l_size"), F.col("r_size"), F.lit(1.0))
    return found.where(F.col("area") > F.greatest(F.lit(float(min_area)), noise)).select("l", "r", "area")


def _overlaps(polygons: DataFrame, rule: TopologyRule, out: Results) -> None:
    total = polygons.count()
    if not total:
        out.add("no_overlaps", "No polygon features.", status=Status.SKIP)
        return
    try:
        found = overlap_pairs(polygons, rule.min_area).persist()
        n = flagged(found).count()
    except Exception as e:  # noqa: BLE001 - a failed join is a result
        out.add("no_overlaps", f"sjoin failed: {e}", total, status=Status.ERROR)
        return
    issues = [Issue(f"overlap area={r.area:.6g}", r.l, {"other": r.r, "area": r.area}, r.l) for r in found.orderBy("l", "r").limit(ISSUES).collect()]
    message = f"{n} polygon(s) overlap one another." if n else "No overlapping polygons."
    out.add("no_overlaps", message, total, n, issues=issues, failing=found.select(F.col("l").alias(FID)).distinct(), cached=found)


def dissolved(polygons: DataFrame) -> DataFrame:
    """(_fid, g): unions of neighbouring polygons, a tile at a time; a tile of many polygons is united in parts.

    Union is associative, so any cut will do. Inner edges vanish, and what is left to unite grows with the tiles'
    outlines instead of their content.
    """
    boxes = boxed(polygons, "g")
    found = cell_width(boxes)
    if found is None:
        return polygons.select(FID, "g")
    b, width = F.col("box"), found[0] * TILE
    rows = boxes.withColumn("tx", F.floor((b["xmin"] + b["xmax"]) / 2 / width)).withColumn("ty", F.floor((b["ymin"] + b["ymax"]) / 2 / width))
    sizes = rows.groupBy("tx", "ty").agg(F.ceil(F.count("*") / PART).alias("parts"))
    rows = rows.join(sizes, ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64(FID), F.col("parts")))

    def unite(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FID)
        whole = kernel.united([wkb.decode(bytes(x)) for x in part["g"]])
        return pd.DataFrame({FID: [int(part[FID].iloc[0])], "g": [wkb.encode(whole)]})

    return rows.select(FID, "g", "tx", "ty", "part").groupBy("tx", "ty", "part").applyInPandas(unite, f"{FID} long, g binary")


def gap_areas(polygons: DataFrame) -> DataFrame:
    """(component, area) of the interior rings of the union of all polygons.

    Polygons are dissolved by tiles first. A ring belongs to one connected part, so each component of what is left
    is then dissolved on its own; one coverage of all land is one component, of the tiles' outlines.
    """
    ensure_checkpoint_dir(polygons)
    tiles = dissolved(polygons).checkpoint()
    box = pairs(tiles, FID, "g")
    labels = labelled(tiles.select(F.col(FID).alias("id")), box.select("l", "r"))
    rows = tiles.join(labels, F.col(FID) == F.col("id")).select("component", FID, "g")

    def holes(part: pd.DataFrame) -> pd.DataFrame:
        found = kernel.holes_of_union([wkb.decode(bytes(x)) for x in part.sort_values(FID)["g"]])
        return pd.DataFrame({"component": part["component"].iloc[0], "area": found}, columns=["component", "area"]).astype({"component": "int64", "area": "float64"})

    return rows.groupBy("component").applyInPandas(holes, "component long, area double")


def _gaps(polygons: DataFrame, rule: TopologyRule, out: Results) -> None:
    total = polygons.count()
    if not total:
        out.add("no_gaps", "No polygon features.", status=Status.SKIP)
        return
    found = gap_areas(polygons).where(F.col("area") > rule.min_area).persist()
    n = found.count()
    rows = found.orderBy("component", "area").limit(ISSUES).collect() if n else []
    message = f"{n} gap(s) found between dissolved polygons." if n else "No gaps between polygons."
    out.add("no_gaps", message, total, n, issues=[Issue(f"gap (interior hole) area={r.area:.6g}", detail={"area": r.area}) for r in rows], cached=found)


def dangling_ends(lines: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(fid, x, y) of line ends whose snapped place no other end has: a hash aggregation, combined before the shuffle."""
    ends = lines.select(F.col(FID).alias("fid"), F.posexplode(geo_ends("g")).alias("n", "p")).select("fid", "n", "p.x", "p.y")
    key = (lambda c: F.rint(F.col(c) / tolerance)) if tolerance > 0 else (lambda c: round_half_even(F.col(c)))
    # -0.0 and 0.0 are one place.
    ends = ends.withColumn("kx", key("x") + 0.0).withColumn("ky", key("y") + 0.0)
    first = F.min(F.struct("fid", "n", "x", "y")).alias("at")
    return ends.groupBy("kx", "ky").agg(F.count("*").alias("times"), first).where("times = 1").select("at.fid", "at.x", "at.y")


def _dangles(work: DataFrame, rule: TopologyRule, out: Results) -> None:
    lines = work.where(F.col("type").isin(*LINES))
    total = lines.count()
    if not total:
        out.add("no_dangles", "No line features.", status=Status.SKIP)
        return
    found = dangling_ends(lines, rule.snap_tolerance).persist()
    n = found.count()
    issues = [Issue(f"dangling endpoint at ({r.x:.3f}, {r.y:.3f})", r.fid, {"x": r.x, "y": r.y}, r.fid) for r in found.orderBy("fid", "x", "y").limit(ISSUES).collect()]
    message = f"{n} dangling line endpoint(s) detected." if n else "No dangling endpoints."
    out.add("no_dangles", message, total, n, issues=issues, failing=found.select(F.col("fid").alias(FID)).distinct(), cached=found)
