"""The report as JSON, JUnit XML and GeoJSON files."""

from __future__ import annotations

import json
from pathlib import Path
from xml.etree import ElementTree as ET

from terrasift.model import LayerReport, Report, Status
from terrasift.sources.catalog import safe_name


def _ready(path: str | Path) -> Path:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    return file


def write_json(report: Report, path: str | Path, max_issues: int = 50) -> Path:
    file = _ready(path)
    file.write_text(json.dumps(report.to_dict(max_issues), indent=2, ensure_ascii=False), encoding="utf-8")
    return file


#: What a result is in JUnit: element, and the attributes it gets; passed ones have none.
def _outcome(r) -> tuple[str, dict[str, str], str | None] | None:
    if r.status == Status.FAIL:
        return "failure", {"message": r.message, "type": r.severity.value}, None
    if r.status == Status.ERROR:
        return "error", {"message": r.message, "type": "error"}, None
    if r.status == Status.SKIP:
        return "skipped", {"message": r.message}, None
    return ("system-out", {}, f"WARNING: {r.message}") if r.status == Status.WARN else None


def _totals(layers: list[LayerReport]) -> dict[str, str]:
    results = [r for x in layers for r in x.results]
    count = lambda s: str(sum(r.status == s for r in results))
    return {"tests": str(len(results)), "failures": count(Status.FAIL), "errors": count(Status.ERROR), "skipped": count(Status.SKIP), "time": f"{sum(r.duration_s for r in results):.4f}"}


def junit(report: Report) -> ET.Element:
    """A layer is a test suite, a check a test case."""
    root = ET.Element("testsuites", {"name": report.suite_name} | _totals(report.layers))
    for layer in report.layers:
        suite = ET.SubElement(root, "testsuite", {"name": layer.layer, "package": layer.source} | _totals([layer]))
        for r in layer.results:
            case = ET.SubElement(suite, "testcase", {"name": r.check, "classname": layer.layer, "time": f"{r.duration_s:.4f}"})
            if found := _outcome(r):
                ET.SubElement(case, found[0], found[1]).text = found[2]
    return root


def write_junit(report: Report, path: str | Path) -> Path:
    file = _ready(path)
    ET.ElementTree(junit(report)).write(file, encoding="utf-8", xml_declaration=True)
    return file


def write_failures(report: Report, folder: str | Path) -> list[Path]:
    """A GeoJSON file for each layer with failing features; layers of one name get numbers."""
    out: list[Path] = []
    for layer in report.layers:
        if layer.failures and layer.failures.get("features"):
            file, n = _ready(Path(folder) / f"{safe_name(layer.layer)}.failures.geojson"), 2
            while file in out:
                file, n = file.with_name(f"{safe_name(layer.layer)}-{n}.failures.geojson"), n + 1
            file.write_text(json.dumps(layer.failures, ensure_ascii=False), encoding="utf-8")
            out.append(file)
    return out
