"""Are geometries there, not empty and valid? One pass over the column answers all three; repair is one more column."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.checks.base import ISSUES, Results, row_issues, status_for
from terrasift.config import GeometryRule
from terrasift.functions.geo import geo_make_valid, geo_state
from terrasift.model import FID, CheckResult, Issue, LayerFrame, Status
from terrasift.operators.components import ensure_checkpoint_dir


def run(frame: LayerFrame, layer: str, source: str, rule: GeometryRule) -> list[CheckResult]:
    if not rule.enabled:
        return []
    out = Results("geometry", layer, source, rule.severity)
    if not frame.has_geometry:
        out.add("", "Layer has no geometry column.", status=Status.SKIP)
        return out.found
    g = F.col(frame.geom_col)
    df = frame.df.select(FID, g.alias("__g"), geo_state(g).alias("__s"))
    missing, empty, invalid = F.col("__g").isNull(), F.coalesce(F.col("__s.empty"), F.lit(False)), F.col("__s.reason").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = df.agg(F.count("*").alias("all"), count(missing).alias("missing"), count(empty).alias("empty"), count(invalid).alias("invalid")).first()
    if rule.no_missing:
        out.add("no_missing", "All features have geometry." if not n.missing else f"{n.missing} feature(s) have NULL geometry.", n["all"], n.missing,
                issues=row_issues(df, missing, "NULL geometry") if n.missing else [], failing=df.where(missing).select(FID))
    if rule.no_empty:
        out.add("no_empty", "No empty geometries." if not n.empty else f"{n.empty} feature(s) have EMPTY geometry.", n["all"], n.empty,
                issues=row_issues(df, empty, "EMPTY geometry") if n.empty else [], failing=df.where(empty).select(FID))
    if rule.valid:
        rows = df.where(invalid).select(FID, F.col("__s.reason").alias("reason")).orderBy(FID).limit(ISSUES).collect() if n.invalid else []
        fixed = 0
        if rule.fix and n.invalid:
            # Later checks see the repaired layer; it is kept, as each of them would repair it anew. What repair can't mend isn't counted.
            ensure_checkpoint_dir(frame.df)
            mended = frame.df.withColumn("__s", geo_state(g)).withColumn("__bad", F.col("__s.reason").isNotNull())
            mended = mended.withColumn(frame.geom_col, F.when(F.col("__bad"), geo_make_valid(g)).otherwise(g)).withColumn("__left", geo_state(g)["reason"]).checkpoint()
            fixed = mended.where(F.col("__bad") & F.col("__left").isNull()).count()
            frame.df = mended.drop("__s", "__bad", "__left")
        if not n.invalid:
            message = "All geometries are valid."
        elif fixed:
            message = f"{n.invalid} invalid geometr(ies) found; {fixed} repaired with make_valid()."
        else:
            message = f"{n.invalid} invalid geometr(ies) found (use geometry.fix: true to repair)."
        out.add("valid", message, n["all"], n.invalid, status_for(n.invalid - fixed, rule.severity), fixed=fixed,
                issues=[Issue(r.reason, r[FID], fid=r[FID]) for r in rows], failing=df.where(invalid).select(FID))
    return out.found
