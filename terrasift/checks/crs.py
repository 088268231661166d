"""Is the coordinate system there, and one of those wanted? Answered from metadata; rows are counted only if it is missing."""

from __future__ import annotations

from terrasift.checks.base import Results
from terrasift.config import CrsRule
from terrasift.geom.crs import epsg_of
from terrasift.model import CheckResult, LayerFrame, Status


def run(frame: LayerFrame, layer: str, source: str, rule: CrsRule) -> list[CheckResult]:
    if not rule.enabled:
        return []
    out = Results("crs", layer, source, rule.severity)
    if not frame.crs:
        if rule.required:
            n = frame.df.count()
            out.add("", "CRS is undefined (missing .prj / SRID). Set a CRS before publishing.", n, n, Status.FAIL)
        else:
            out.add("", "CRS undefined but not required.", status=Status.PASS)
        return out.found
    code = epsg_of(frame.crs)
    label = f"EPSG:{code}" if code else frame.crs.splitlines()[0]
    # A wrong system fails whatever the severity.
    if rule.expected_epsg is not None and code != rule.expected_epsg:
        out.add("", f"CRS is {label}, expected EPSG:{rule.expected_epsg}. Reprojection may shift features; verify the datum transformation.", status=Status.FAIL)
    elif rule.allowed_epsg and code not in rule.allowed_epsg:
        out.add("", f"CRS {label} is not in the allowed list ({rule.allowed_epsg}).", status=Status.FAIL)
    else:
        out.add("", f"CRS OK ({label}).", status=Status.PASS)
    return out.found
