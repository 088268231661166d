"""The report as one HTML page, with a map of each layer's failing features."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from terrasift.model import CheckResult, LayerReport, Report

#: Where the map library is found. It is loaded only if the page has a map.
LEAFLET = "https://unpkg.com/leaflet@1.9.4/dist/leaflet"
STYLE = """
body { font: 15px/1.5 system-ui, sans-serif; margin: 2rem auto; max-width: 70rem; padding: 0 1rem; color: #1c2430; }
table { border-collapse: collapse; width: 100%; margin: .5rem 0 1rem; } td, th { text-align: left; padding: .3rem .6rem; border-bottom: 1px solid #dde3ea; vertical-align: top; }
.tag { border-radius: .3rem; padding: 0 .4rem; font-size: .8rem; font-weight: 600; }
.pass { background: #d8f3dc; } .fail, .error { background: #ffd6d6; } .warn { background: #fff0c2; } .skip { background: #e8ebef; }
.map { height: 22rem; border: 1px solid #dde3ea; } .dim { color: #66707c; font-size: .85rem; }
"""


def tag(status: str) -> str:
    return f'<span class="tag {status}">{status.upper()}</span>'


def _issues(r: CheckResult, most: int) -> str:
    if not r.issues:
        return ""
    rows = []
    for i in r.issues[:most]:
        d = i.to_dict()
        who = "" if d["feature_id"] is None else f"{escape(str(d['feature_id']))}: "
        more = f" <span class=dim>{escape(json.dumps(d['detail'], ensure_ascii=False))}</span>" if d["detail"] else ""
        rows.append(f"<li>{who}{escape(d['message'])}{more}</li>")
    left = len(r.issues) - most
    return f"<details><summary>{len(r.issues)} issue(s)</summary><ul>{''.join(rows)}</ul>{f'<p class=dim>{left} more not shown</p>' if left > 0 else ''}</details>"


def _layer(layer: LayerReport, i: int, most: int, include_map: bool) -> str:
    facts = " · ".join(escape(str(x)) for x in (layer.source, f"{layer.n_features} features", layer.geometry_type, layer.crs) if x)
    rows = "".join(f"<tr><td>{escape(r.check)}</td><td>{tag(r.status.value)}</td><td>{escape(r.message)}{_issues(r, most)}</td></tr>" for r in layer.results)
    shown = f'<div class="map" id="terrasift-map-{i}"></div>' if include_map and layer.failures else ""
    return f"<section><h2>{escape(layer.layer)} {tag(layer.status.value)}</h2><p class=dim>{facts}</p><table><tr><th>Check</th><th>Status</th><th>Result</th></tr>{rows}</table>{shown}</section>"


def _maps(report: Report) -> str:
    out = [f'<link rel="stylesheet" href="{LEAFLET}.css"><script src="{LEAFLET}.js"></script><script>']
    for i, layer in enumerate(report.layers):
        if layer.failures:
            # "</" would end the script.
            data = json.dumps(layer.failures, ensure_ascii=False).replace("</", "<\\/")
            out.append(f"(function () {{ var m = L.map('terrasift-map-{i}'); L.tileLayer('https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png', {{attribution: '&copy; OpenStreetMap contributors'}}).addTo(m);"
                       f" var g = L.geoJSON({data}, {{onEachFeature: function (f, l) {{ var d = document.createElement('div'); d.textContent = f.properties.failed_checks; l.bindPopup(d); }}}}).addTo(m);"
                       " if (g.getLayers().length) m.fitBounds(g.getBounds(), {maxZoom: 16}); })();")  # fmt: skip
    return "".join(out) + "</script>"


def html_page(report: Report, title: str | None = None, max_issues: int = 50, include_map: bool = True) -> str:
    n, name = report.counts, escape(title or report.suite_name)
    head = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{name}</title><style>{STYLE}</style></head><body><h1>{name} {tag("pass" if report.passed else "fail")}</h1>'
    when = f"<p class=dim>{escape(report.suite_name)}, {report.started_at:%Y-%m-%d %H:%M:%S} UTC</p>"
    totals = "<p>" + " ".join(f"{tag(k)} {v}" for k, v in n.items()) + "</p>"
    layers = "".join(_layer(x, i, max_issues, include_map) for i, x in enumerate(report.layers))
    maps = _maps(report) if include_map and any(x.failures for x in report.layers) else ""
    return f"{head}{when}{totals}{layers}{maps}</body></html>"


def write_html(report: Report, path: str | Path, title: str | None = None, max_issues: int = 50, include_map: bool = True) -> Path:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(html_page(report, title, max_issues, include_map), encoding="utf-8")
    return file
