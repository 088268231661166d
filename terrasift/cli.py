"""The command line: run, init, validate, schema, list-checks."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from terrasift import __version__
from terrasift.config import json_schema, load_suite
from terrasift.registry import PLUGINS, builtin_specs, checks_in_use
from terrasift.report.files import write_failures, write_json, write_junit
from terrasift.report.page import write_html
from terrasift.report.text import print_report

DEFAULT_CONFIG = "terrasift.yml"
STARTER = """\
version: 1
name: "Layer quality"

sources:
  - path: "data/"
    pattern: "*.gpkg"

# Rules of every layer. A layer's own block below overrides single keys.
defaults:
  crs:
    allowed_epsg: [4326, 3857]
  geometry:
    fix: false          # true repairs invalid geometries
  duplicates:
    fuzzy:
      enabled: false
      min_overlap: 0.9  # shared part of two polygons' union

# By layer: a file's name without its suffix, or the name of a table.
layers:
  roads:
    attributes:
      required: [name]
      not_null: [name]
      domains:
        lanes: {min: 1, max: 8}
    topology:
      enabled: true
      no_dangles: true
  parcels:
    topology:
      enabled: true
      no_overlaps: true
      no_gaps: true
"""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("terrasift", description="Checks the quality of vector geospatial layers.")
    top.add_argument("--version", action="version", version=f"terrasift {__version__}")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, config: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text, description=text)
        if config:
            p.add_argument("-c", "--config", type=Path, default=Path(DEFAULT_CONFIG), help="the YAML configuration")
        return p

    run = command("run", "Run all checks and report the results.", True)
    for flag, text in (("--html", "write an HTML report here"), ("--json", "write a JSON report here"), ("--junit", "write a JUnit report here"), ("--geojson-out", "folder for failing features"), ("--fix-output", "folder for repaired layers (needs geometry.fix)")):
        run.add_argument(flag, type=Path, help=text)
    run.add_argument("--fail-on", choices=("error", "warn", "never"), default="error", type=str.lower, help="what makes the exit code 1")
    run.add_argument("--no-fail", action="store_true", help="the same as --fail-on never")
    run.add_argument("-v", "--verbose", action="store_true", help="show skipped checks too")
    run.add_argument("--log-level", choices=("debug", "info", "warning", "error"), default="warning", type=str.lower)
    run.add_argument("-q", "--quiet", action="store_true", help="log errors only")
    run.add_argument("-j", "--workers", type=int, default=1, help="layers checked side by side")
    init = command("init", "Write a configuration to start from.")
    init.add_argument("-p", "--path", type=Path, default=Path(DEFAULT_CONFIG))
    init.add_argument("-f", "--force", action="store_true", help="overwrite a file")
    command("validate", "Check a configuration without running it.", True)
    schema = command("schema", "Print the JSON schema of the configuration.")
    schema.add_argument("-o", "--output", type=Path)
    command("list-checks", "List the checks and their keys.")
    return top


def complain(text: str, code: int) -> int:
    print(text, file=sys.stderr)
    return code


def run(args: argparse.Namespace) -> int:
    if args.workers < 1:
        return complain("--workers must be 1 or more", 2)
    logging.basicConfig(level=logging.ERROR if args.quiet else args.log_level.upper(), format="%(levelname)s %(name)s: %(message)s", force=True)
    try:
        suite = load_suite(args.config)
    except Exception as e:  # noqa: BLE001 - any fault of the file is the user's to mend
        return complain(f"Config error: {e}", 2)
    from terrasift.plans.run import run_suite

    log = logging.getLogger("terrasift")
    report = run_suite(suite, args.fix_output, lambda name: log.info("checking %s", name), args.workers, bool(args.geojson_out or args.html))
    print_report(report, verbose=args.verbose)
    most = suite.report.max_issues_per_check
    if args.json:
        print(f"JSON report -> {write_json(report, args.json, most)}")
    if args.html:
        print(f"HTML report -> {write_html(report, args.html, suite.report.title or suite.name, most)}")
    if args.junit:
        print(f"JUnit report -> {write_junit(report, args.junit)}")
    if args.geojson_out:
        print(f"GeoJSON failures -> {len(write_failures(report, args.geojson_out))} file(s) in {args.geojson_out}")
    return int(report.has_failures("never" if args.no_fail else args.fail_on))


def init(args: argparse.Namespace) -> int:
    if args.path.exists() and not args.force:
        return complain(f"{args.path} already exists. Use --force to overwrite.", 1)
    args.path.write_text(STARTER, encoding="utf-8")
    print(f"Wrote starter config -> {args.path}")
    return 0


def validate(args: argparse.Namespace) -> int:
    try:
        suite = load_suite(args.config)
    except Exception as e:  # noqa: BLE001
        return complain(f"Invalid config: {e}", 2)
    wrong = []
    for name in suite.layers:
        try:
            suite.rules_for(name)
        except Exception as e:  # noqa: BLE001
            wrong.append(f"layer '{name}': {e}")
    if wrong:
        return complain("\n".join(wrong), 2)
    print(f"Config OK - {len(suite.sources)} source(s), {len(suite.layers)} layer override(s).")
    return 0


def schema(args: argparse.Namespace) -> int:
    text = json.dumps(json_schema(), indent=2, ensure_ascii=False)
    if args.output:
        args.output.write_text(text, encoding="utf-8")
        print(f"Wrote JSON Schema -> {args.output}")
    else:
        print(text)
    return 0


def list_checks(args: argparse.Namespace) -> int:
    own = {s.name for s in builtin_specs()}
    for s in checks_in_use().values():
        print(f"{s.name:<12} {'built-in' if s.name in own else 'plugin':<9} {', '.join(s.keys())}")
    print(f"Every check also has the keys enabled and severity (error, warn or info). Plugins: entry points of the group {PLUGINS}.")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return {"run": run, "init": init, "validate": validate, "schema": schema, "list-checks": list_checks}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
