"""The report as text for a terminal."""

from __future__ import annotations

import shutil
import sys
from typing import TextIO

from terrasift.model import LayerReport, Report, Status

COLOURS = {Status.PASS: "32", Status.FAIL: "31;1", Status.WARN: "33;1", Status.ERROR: "31;1", Status.SKIP: "2"}


def shown(status: Status) -> str:
    return status.value if status == Status.SKIP else status.value.upper()


def layer_lines(layer: LayerReport, verbose: bool, paint) -> list[str]:
    facts = " · ".join(x for x in (f"{layer.n_features} features", layer.geometry_type, layer.crs) if x)
    out = [f"{layer.layer}  {paint(f'[{shown(layer.status)}]', layer.status)}", f"  {layer.source}", f"  {facts}"]
    rows = [r for r in layer.results if verbose or r.status != Status.SKIP]
    wide = max([len("Check"), *(len(r.check) for r in rows)])
    out.append(f"  {'Check':<{wide}}  Status  Result")
    return out + [f"  {r.check:<{wide}}  {paint(f'{shown(r.status):<6}', r.status)}  {r.message}" for r in rows]


def print_report(report: Report, out: TextIO | None = None, verbose: bool = False) -> None:
    """Every layer's results (skipped ones only if verbose) and the totals."""
    out = out or sys.stdout
    colour = out.isatty()
    paint = lambda text, status: f"\033[{COLOURS[status]}m{text}\033[0m" if colour else text
    rule = "-" * min(100, shutil.get_terminal_size().columns)
    for layer in report.layers:
        print(rule, *layer_lines(layer, verbose, paint), sep="\n", file=out)
    n = report.counts
    print(rule, paint("PASSED", Status.PASS) if report.passed else paint("FAILED", Status.FAIL), f"Suite: {report.suite_name}", sep="\n", file=out)
    print(f"{n['pass']} passed  {n['fail']} failed  {n['warn']} warnings  {n['error']} errors  {n['skip']} skipped", file=out)
