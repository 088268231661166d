"""What the checks share: statuses, issues and metric coordinates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import geo_box, geo_transform
from terrasift.geom import crs as systems
from terrasift.model import FID, CheckResult, Issue, LayerFrame, Severity, Status

ISSUES = 200


def status_for(n_failed: int, severity: Severity) -> Status:
    """Any failure under a severity other than warn fails, info included."""
    if not n_failed:
        return Status.PASS
    return Status.WARN if severity == Severity.WARN else Status.FAIL


class Results:
    """Results of one check on one layer, each named check.rule."""

    def __init__(self, check: str, layer: str, source: str, severity: Severity) -> None:
        self.check, self.layer, self.source, self.severity = check, layer, source, severity
        self.found: list[CheckResult] = []

    def add(self, rule: str, message: str, n_total: int = 0, n_failed: int = 0, status: Status | None = None, **more) -> CheckResult:
        name = f"{self.check}.{rule}" if rule else self.check
        out = CheckResult(name, self.layer, self.source, status or status_for(n_failed, self.severity), message, self.severity, n_total, n_failed, **more)
        self.found.append(out)
        return out


def first_rows(df: DataFrame, bad: Column, *columns: Column | str) -> list:
    """The first failing rows by id: a top-k, not a sort of the layer."""
    return df.where(bad).select(FID, *columns).orderBy(FID).limit(ISSUES).collect()


def row_issues(df: DataFrame, bad: Column, message: str, value: str | None = None) -> list[Issue]:
    """Issues of failing rows; their id is the row's, or a column's value."""
    if value is None:
        return [Issue(message, r[FID], fid=r[FID]) for r in first_rows(df, bad)]
    return [Issue(message, r["__v"], fid=r[FID]) for r in first_rows(df, bad, F.col(f"`{value}`").alias("__v"))]


def is_null(df: DataFrame, column: str) -> Column:
    """Null, or NaN where the type has it."""
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[column] in ("float", "double") else c.isNull()


def to_metric(frame: LayerFrame) -> tuple[LayerFrame, str | None]:
    """The layer in a system of metres, and a note on what was done."""
    if not frame.crs:
        return frame, "CRS undefined; areas/distances are in raw coordinate units"
    if not systems.is_geographic(frame.crs):
        return frame, None
    try:
        b = frame.df.select(geo_box(F.col(frame.geom_col)).alias("b")).agg(*[f(f"b.{c}") for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]).first()
        zone = systems.utm_zone(tuple(b))
        turned = geo_transform(systems.epsg_of(frame.crs) or 4326, zone)(F.col(frame.geom_col))
        return replace(frame, df=frame.df.withColumn(frame.geom_col, turned), crs=f"EPSG:{zone}"), f"reprojected to EPSG:{zone} for metric computations"
    except (ValueError, TypeError):
        return frame, "could not reproject to a metric CRS; using raw coordinate units"
