"""Geometries that come twice: exactly, by their normal form, or nearly, by a spatial self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.checks.base import ISSUES, Results, to_metric
from terrasift.config import DuplicatesRule, FuzzyRule
from terrasift.functions.geo import geo_area, geo_distance, geo_intersection_area, geo_is_empty, geo_normal, geo_related, geo_type
from terrasift.model import FID, CheckResult, Issue, LayerFrame, Status
from terrasift.operators.spatial_join import flagged, pairs

POLYGONAL = ("Polygon", "MultiPolygon")


def run(frame: LayerFrame, layer: str, source: str, rule: DuplicatesRule) -> list[CheckResult]:
    if not rule.enabled or not frame.has_geometry:
        return []
    out = Results("duplicates", layer, source, rule.severity)
    if rule.exact:
        _exact(frame, out)
    if rule.fuzzy.enabled:
        _fuzzy(frame, rule.fuzzy, out)
    return out.found


def exact_groups(df: DataFrame, geom: str) -> tuple[DataFrame, DataFrame]:
    """(key, n) of geometries that come twice or more, and (_fid, key) of all rows that have one."""
    keys = df.select(FID, geo_normal(F.col(geom)).alias("key")).where(F.col("key").isNotNull())
    # The digest is half a rectangle's WKB and a small part of a long one: it shrinks the shuffle.
    keys = keys.select(FID, F.sha2("key", 256).alias("key")).persist()
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), keys


def _exact(frame: LayerFrame, out: Results) -> None:
    groups, keys = exact_groups(frame.df, frame.geom_col)
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")).first()
    members = keys.join(groups.select("key"), "key", "left_semi").select(FID)
    rows = members.orderBy(FID).limit(ISSUES).collect() if n.extra else []
    message = f"{n.members} features form exact-duplicate groups ({n.extra} redundant)." if n.extra else "No exact duplicate geometries."
    out.add("exact", message, frame.df.count(), n.extra, issues=[Issue("exact duplicate geometry", r[FID], fid=r[FID]) for r in rows], failing=members, cached=keys)


def near_pairs(frame: LayerFrame, rule: FuzzyRule) -> DataFrame:
    """(l, r, iou, distance) of near duplicates in a metric layer: polygons by IoU, other pairs by distance."""
    g = F.col(frame.geom_col)
    work = frame.df.where(g.isNotNull()).where(~geo_is_empty(g)).select(FID, frame.geom_col, geo_type(g).isin(*POLYGONAL).alias("poly"))
    within = rule.predicate == "dwithin"
    found = pairs(work, FID, frame.geom_col, rule.max_distance / 2 if within else 0.0, keep=("poly",))
    both = F.col("l_poly") & F.col("r_poly")
    if not within:
        found = found.where(geo_related(rule.predicate)(F.col("gl"), F.col("gr")))
    polygons = found.where(both).withColumn("i", geo_intersection_area("gl", "gr")).withColumn("u", geo_area("gl") + geo_area("gr") - F.col("i"))
    polygons = polygons.withColumn("iou", F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(0.0))
    # Within a distance means near for polygons too.
    polygons = polygons.where(F.col("iou") >= rule.min_overlap).select("l", "r", "iou", F.lit(None).cast("double").alias("distance"))
    if rule.max_distance <= 0:
        return polygons
    others = found.where(~both).withColumn("distance", geo_distance("gl", "gr")).where(F.col("distance") <= rule.max_distance)
    return polygons.unionByName(others.select("l", "r", F.lit(None).cast("double").alias("iou"), "distance"))


def _fuzzy(frame: LayerFrame, rule: FuzzyRule, out: Results) -> None:
    total = frame.df.count()
    metric, note = to_metric(frame)
    try:
        found = near_pairs(metric, rule).persist()
        n = flagged(found).count()
    except Exception as e:  # noqa: BLE001 - a failed join is a result
        out.add("fuzzy", f"Fuzzy duplicate join failed: {e}", total, status=Status.ERROR)
        return
    issues = []
    for r in found.orderBy("l", "r").limit(ISSUES).collect():
        if r.iou is not None:
            issues.append(Issue(f"near-duplicate polygon (IoU={r.iou:.3f})", r.l, {"other": r.r, "iou": round(r.iou, 4)}, r.l))
        else:
            issues.append(Issue(f"near-duplicate within {r.distance:.3g} m", r.l, {"other": r.r, "distance": round(r.distance, 6)}, r.l))
    failing = found.select(F.col("l").alias(FID)).distinct()
    message = f"{n} features look like near-duplicates (predicate={rule.predicate})." if n else "No fuzzy/near duplicates found."
    out.add("fuzzy", f"{message} [{note}]" if note else message, total, n, issues=issues, failing=failing, cached=found)
