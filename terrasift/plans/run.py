"""Runs a suite: layers, rules, checks, repaired layers and failing features, into a report."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.config import LayerRules, Suite
from terrasift.functions.geo import geo_json, geo_transform, geo_type
from terrasift.geom.crs import epsg_of
from terrasift.model import FID, CheckResult, LayerFrame, LayerReport, Report, Severity, Status, now
from terrasift.registry import CheckSpec, checks_in_use
from terrasift.sources.catalog import layers_of, safe_name

log = logging.getLogger("terrasift")
#: Failing features exported of each rule at most: they end up in one file that a map shows.
FEATURES = 200


def run_suite(
    suite: Suite, fix_output_dir: str | Path | None = None, progress: Callable[[str], None] | None = None,
    workers: int = 1, collect_failures: bool = False, spark: SparkSession | None = None,
) -> Report:
    """Every check on every layer. With workers > 1 the layers' jobs run side by side; the report is the same."""
    spark = spark or SparkSession.builder.getOrCreate()
    report = Report(suite.name)
    layers = list(layers_of(suite, spark))
    taken: dict[str, int] = {}
    fixed_names = []
    for x in layers:
        taken[x.name] = taken.get(x.name, 0) + 1
        fixed_names.append(safe_name(x.name) + (f"-{taken[x.name]}" if taken[x.name] > 1 else ""))

    def one(i: int) -> LayerReport:
        if progress:
            progress(layers[i].name)
        where = Path(fix_output_dir) / f"{fixed_names[i]}.fixed.gpkg" if fix_output_dir else None
        return run_layer(suite, layers[i], where, collect_failures)

    if workers > 1 and len(layers) > 1:
        with ThreadPoolExecutor(workers) as pool:
            report.layers = list(pool.map(one, range(len(layers))))
    else:
        report.layers = [one(i) for i in range(len(layers))]
    report.finished_at = now()
    return report


def _problem(check: str, layer: LayerFrame, message: str) -> CheckResult:
    return CheckResult(check, layer.name, layer.source, Status.ERROR, message)


def run_layer(suite: Suite, layer: LayerFrame, fix_file: Path | None = None, collect_failures: bool = False) -> LayerReport:
    out = LayerReport(layer.name, layer.source)
    if layer.error or layer.df is None:
        out.results.append(_problem("load", layer, f"Could not read layer: {layer.error or 'unknown error'}"))
        return out
    frame = replace(layer)
    try:
        out.n_features, out.geometry_type = overview(frame)
    except Exception as e:  # noqa: BLE001 - files that break while being read are load errors
        out.results.append(_problem("load", layer, f"Could not read layer: {e}"))
        return out
    out.crs = frame.crs
    try:
        rules = suite.rules_for(layer.name)
    except Exception as e:  # noqa: BLE001
        out.results.append(_problem("config", layer, f"Invalid configuration for layer: {e}"))
        return out
    out.results = checked(frame, rules)
    if fix_file and any(r.fixed for r in out.results):
        out.results.append(_write_fixed(frame, fix_file))
    if collect_failures:
        out.failures = collected(frame, out.results)
    for r in out.results:
        if r.cached is not None:
            r.cached.unpersist()
    return out


def overview(frame: LayerFrame) -> tuple[int, str | None]:
    """Number of rows and the most frequent geometry type (the first by name of several), in one job."""
    if not frame.has_geometry:
        return frame.df.count(), None
    got = frame.df.agg(F.count("*").alias("n"), F.mode(geo_type(F.col(frame.geom_col)), True).alias("type")).first()
    return got.n, got.type


def checked(frame: LayerFrame, rules: LayerRules) -> list[CheckResult]:
    out = []
    for spec in checks_in_use().values():
        rule = getattr(rules, spec.name, None)
        if rule is not None:
            out += timed(spec, frame, rule)
    return out


def timed(spec: CheckSpec, frame: LayerFrame, rule: Any) -> list[CheckResult]:
    """A check's results with their share of its time; one error result in their place if it raises."""
    began = time.perf_counter()
    try:
        results = spec.runner(frame, frame.name, frame.source, rule)
    except Exception as e:  # noqa: BLE001 - one check never stops the others
        log.exception("check %r broke off on layer %s", spec.name, frame.name)
        results = [_problem(spec.name, frame, f"check raised {type(e).__name__}: {e}")]
    for r in results:
        r.duration_s = (time.perf_counter() - began) / len(results)
    return results


def _write_fixed(frame: LayerFrame, file: Path) -> CheckResult:
    from terrasift.sources.geopackage import write

    done = CheckResult("geometry.fix.output", frame.name, frame.source, Status.PASS, f"Wrote repaired layer to {file}", Severity.INFO)
    try:
        file.parent.mkdir(parents=True, exist_ok=True)
        write(frame, file)
    except Exception as e:  # noqa: BLE001
        done.status, done.severity, done.message = Status.ERROR, Severity.WARN, f"Failed to write repaired layer: {e}"
    return done


def failing_rows(frame: LayerFrame, results: list[CheckResult], most: int | None = None) -> DataFrame | None:
    """(_fid, checks) of the rows that failed or broken checks name; checks joined in order. most: rows of each check."""
    parts = []
    for r in results:
        if r.status in (Status.FAIL, Status.ERROR) and r.failing is not None:
            rows = r.failing if most is None else r.failing.orderBy(FID).limit(most)
            parts.append(rows.select(FID, F.lit(r.check).alias("check")))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy(FID).agg(F.array_join(F.array_sort(F.collect_set("check")), ", ").alias("checks"))


def collected(frame: LayerFrame, results: list[CheckResult]) -> dict[str, Any] | None:
    """Failing features as GeoJSON in longitude and latitude, or None."""
    if not frame.has_geometry:
        return None
    try:
        failing = failing_rows(frame, results, FEATURES)
        if failing is None:
            return None
        g, code = F.col(frame.geom_col), epsg_of(frame.crs)
        if frame.crs and code != 4326:
            g = geo_transform(code or 0, 4326)(g)
        rows = frame.df.join(F.broadcast(failing), FID).select(FID, "checks", geo_json(g).alias("g")).orderBy(FID).collect()
        features = [{"id": str(r[FID]), "type": "Feature", "properties": {"failed_checks": r.checks}, "geometry": json.loads(r.g) if r.g else None} for r in rows]
        return {"type": "FeatureCollection", "features": features} if features else None
    except Exception:  # noqa: BLE001 - the export never fails a run
        log.exception("failing features of layer %s can't be collected", frame.name)
        return None


def results_frame(spark: SparkSession, report: Report) -> DataFrame:
    """A report's results as rows."""
    rows = [(r.layer, r.check, r.status.value, r.severity.value, r.n_total, r.n_failed, r.fixed, r.message) for r in report.all_results]
    return spark.createDataFrame(rows, "layer string, check string, status string, severity string, n_total long, n_failed long, fixed long, message string")
