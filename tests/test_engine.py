import json
import logging

import pytest
from pydantic import BaseModel, ValidationError

from terrasift import cli, config, registry
from terrasift.config import Source, Suite, load_suite, merged
from terrasift.model import CheckResult, Issue, LayerReport, Report, Severity, Status
from terrasift.plans.run import run_suite
from terrasift.report.files import junit, write_failures, write_json
from terrasift.report.page import html_page
from terrasift.sources import database
from terrasift.sources.catalog import layers_of


@pytest.fixture(autouse=True)
def fresh_registry():
    registry.checks_in_use.cache_clear()
    yield
    registry.checks_in_use.cache_clear()


def verdicts(report):
    return {(x.layer, r.check): (r.status.value, r.n_failed) for x in report.layers for r in x.results}


def test_end_to_end(spark, data_dir):
    suite, said = load_suite(data_dir / "suite.yml"), []
    report = run_suite(suite, progress=said.append, collect_failures=True, spark=spark)
    got = verdicts(report)
    want = {
        ("parcels", "geometry.valid"): ("fail", 1), ("parcels", "attributes.unique[parcel_id]"): ("fail", 1), ("parcels", "topology.no_overlaps"): ("warn", 3), ("parcels", "duplicates.exact"): ("warn", 1),
        ("parcels", "attributes.required"): ("pass", 0), ("parcels", "attributes.domain[zone]"): ("pass", 0),
        ("roads", "attributes.not_null[name]"): ("fail", 1), ("roads", "attributes.domain[lanes]"): ("fail", 1), ("roads", "topology.no_dangles"): ("warn", 3),
    }
    assert {k: got[k] for k in want} == want
    assert said == ["parcels", "roads"] and not report.passed and report.layers[0].geometry_type == "Polygon"
    side = run_suite(suite, workers=2, spark=spark)
    assert verdicts(side) == got and [x.layer for x in side.layers] == ["parcels", "roads"]
    failures = report.layers[0].failures["features"]
    # Rows are found by id, never by an attribute's value; warnings stay out.
    assert [(f["id"], f["properties"]["failed_checks"]) for f in failures] == [("0", "attributes.unique[parcel_id]"), ("2", "geometry.valid"), ("3", "attributes.unique[parcel_id]")]
    assert abs(failures[0]["geometry"]["coordinates"][0][1][0] - 8.98e-5) < 1e-6
    assert len(write_failures(report, data_dir / "out")) == 2
    page = html_page(report)
    assert "terrasift-map-0" in page and "leaflet" in page and "leaflet" not in html_page(report, include_map=False)


def test_fixed_output_and_load_errors(spark, data_dir):
    (data_dir / "broken.geojson").write_text("{ nope")
    suite = load_suite(data_dir / "suite.yml")
    suite.defaults["geometry"] = {"fix": True}
    suite.sources.append(Source(path="missing.shp"))
    suite.layers["roads"]["bogus"] = 1
    got = run_suite(suite, fix_output_dir=data_dir / "fixed", spark=spark)
    by = {x.layer: x for x in got.layers}
    assert by["broken"].results[0].check == "load" and by["broken"].status == Status.ERROR
    assert "no files matched" in by["missing.shp"].results[0].message
    assert [r.check for r in by["roads"].results] == ["config"]
    assert by["parcels"].results[-1].check == "geometry.fix.output" and by["parcels"].results[-1].status == Status.PASS
    again = Suite(sources=[Source(path=str(data_dir / "fixed"))])
    fixed = run_suite(again, spark=spark).layers[0]
    assert fixed.crs == "EPSG:3857" and fixed.n_features == 4 and {r.check: r.n_failed for r in fixed.results}["geometry.valid"] == 0


def test_check_that_breaks_is_one_error(spark, data_dir):
    class Own(BaseModel):
        limit: int = 3

    def broken(frame, layer, source, rule):
        raise RuntimeError("boom")

    def counting(frame, layer, source, rule):
        return [CheckResult("own", layer, source, Status.PASS, f"{frame.df.count()} rows, limit {rule.limit}")]

    registry.use(registry.CheckSpec("own", counting, Own, 5))
    registry.use(registry.CheckSpec("crs", broken, config.CrsRule, 10))
    logging.disable(logging.CRITICAL)
    suite = load_suite(data_dir / "suite.yml")
    suite.defaults["own"] = {"limit": 7}
    results = run_suite(suite, spark=spark).layers[0].results
    logging.disable(logging.NOTSET)
    assert results[0].message == "4 rows, limit 7"
    assert (results[1].check, results[1].status, results[1].message) == ("crs", Status.ERROR, "check raised RuntimeError: boom")
    assert "own" in config.json_schema()["$defs"]["LayerRulesWithPlugins"]["properties"]


def test_plugins(monkeypatch):
    class Point:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if isinstance(self.value, Exception):
                raise self.value
            return self.value

    class Rule(BaseModel):
        enabled: bool = True
        most: int = 1

    spec = registry.CheckSpec("zz", lambda *a: [], Rule)
    points = [Point("a", spec), Point("b", lambda: registry.CheckSpec("yy", lambda *a: [], Rule, 1)), Point("c", 3), Point("d", ImportError("x"))]
    monkeypatch.setattr(registry.metadata, "entry_points", lambda group: points)
    logging.disable(logging.CRITICAL)
    assert list(registry.known_checks()) == ["yy", "crs", "geometry", "duplicates", "attributes", "topology", "zz"]
    logging.disable(logging.NOTSET)
    assert spec.keys() == ("most",) and registry.known_checks(include_plugins=False).get("zz") is None


def test_config(tmp_path):
    assert merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2], "d": 3}}) == {"a": {"b": 1, "c": [2], "d": 3}}
    with pytest.raises(ValidationError):
        Suite(version=2)
    with pytest.raises(FileNotFoundError):
        load_suite(tmp_path / "none.yml")
    (tmp_path / "s.yml").write_text("defaults: {crs: {typo: 1}}")
    with pytest.raises(ValidationError):
        load_suite(tmp_path / "s.yml")
    (tmp_path / "s.yml").write_text("[1]")
    with pytest.raises(ValueError):
        load_suite(tmp_path / "s.yml")
    (tmp_path / "s.yml").write_text("")
    assert load_suite(tmp_path / "s.yml").sources == []
    for wrong in ({}, {"connection": "x://y"}, {"connection": "x://y", "table": "t", "query": "q"}):
        with pytest.raises(ValidationError):
            Source(**wrong)


def test_results_and_reports(tmp_path):
    r = CheckResult("c", "l", "s", Status.FAIL, "m", issues=[Issue(str(i)) for i in range(10)])
    d = r.to_dict(3)
    assert len(d["issues"]) == 3 and d["issues_truncated"] == 7
    every = [CheckResult(s.value, "l", "s", s, "m<", Severity.WARN) for s in Status]
    report = Report("suite", layers=[LayerReport("l", "s", results=every)])
    assert report.counts == {s.value: 1 for s in Status} and report.layers[0].status == Status.ERROR
    warn = Report("w", layers=[LayerReport("l", "s", results=[every[2]])])
    assert warn.passed and warn.has_failures("warn") and not report.has_failures("never") and LayerReport("l", "s", results=[every[4]]).status == Status.PASS
    root = junit(report)
    assert [root.get(k) for k in ("tests", "failures", "errors", "skipped")] == ["5", "1", "1", "1"]
    assert root.find(".//system-out").text == "WARNING: m<" and "m&lt;" in html_page(report)
    assert json.loads(write_json(report, tmp_path / "a/r.json").read_text())["counts"]["warn"] == 1


def test_sqlite_source_and_redaction(spark, tmp_path):
    import sqlite3

    from terrasift.geom import wkb
    from tests.conftest import square

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (name text, geom blob)")
        db.execute("insert into t values ('a', ?)", (wkb.encode(square(0, 0)),))
    url = f"sqlite:///{tmp_path / 'x.db'}"
    by_table, by_query, broken = (database.layer(spark, Source(connection=url, **k)) for k in ({"table": "t"}, {"query": "select geom from t", "name": "q"}, {"table": "none"}))
    assert by_table.df.count() == 1 and by_query.name == "q" and "no such table" in broken.error
    assert database.redacted("postgresql://u:p@ss@h/db") == "postgresql://u:***@h/db" and database.redacted("x://h/db") == "x://h/db"
    opts = database.jdbc_options(Source(connection="postgresql://u:p@h:5/db", table="s.t"))
    assert opts["url"] == "jdbc:postgresql://h:5/db" and '"s"."t"' in opts["query"] and opts["password"] == "p"
    assert database.layer(spark, Source(connection="postgresql://u:secret@h/db", table="t")).error


def test_formats(spark, tmp_path):
    import struct

    import pyarrow as pa
    import pyarrow.parquet as pq

    from terrasift.geom import wkb
    from tests.conftest import square

    g = wkb.encode(square(0, 0))
    geo = {"primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 3857}}}}}
    pq.write_table(pa.table({"a": [1, 2, 3], "geom": [g, g, None]}).replace_schema_metadata({"geo": json.dumps(geo)}), tmp_path / "p.parquet")
    (tmp_path / "k.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>f1</name><Placemark><name>n</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></Folder>'
                                    "<Folder><name>f2</name><Placemark><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark></Folder></Document></kml>")  # fmt: skip
    (tmp_path / "g.gml").write_text('<c xmlns:gml="http://www.opengis.net/gml"><gml:featureMember><road><id>1</id><geom><gml:Polygon srsName="EPSG:3857"><gml:exterior><gml:LinearRing><gml:posList>0 0 1 0 1 1 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></geom></road></gml:featureMember></c>')
    (tmp_path / "t.gpx").write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>t</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"/></trkseg></trk></gpx>')
    ring = square(0, 0)[1][0][::-1]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 10, 10, 1, 5, 0) + ring.astype("<f8").tobytes()
    record = struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(struct.pack(">i20xi", 9994, (100 + len(record)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + record)
    field = b"NAME\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 24, 1, 1, 1, 32 + 32 + 1, 6) + field + b"\r" + b" abc  ")
    (tmp_path / "x.fgb").write_bytes(b"fgb")
    layers = {x.name: x for x in layers_of(Suite(sources=[Source(path=str(tmp_path))]), spark)}
    assert sorted(layers) == ["f1", "f2", "g", "p", "s", "t", "x"] and layers["x"].error
    assert [r._fid for r in layers["p"].df.orderBy("_fid").collect()] == [0, 1, 2] and layers["p"].crs == "EPSG:3857"
    row = layers["s"].df.first()
    assert row.NAME == "abc" and wkb.decode(bytes(row.geometry))[0] == wkb.POLYGON and layers["s"].crs is None
    assert layers["f1"].df.first().Name == "n" and layers["g"].crs == "EPSG:3857" and wkb.decode(bytes(layers["t"].df.first().geometry))[0] == wkb.MULTILINE


def test_cli(data_dir, capsys, monkeypatch):
    c = str(data_dir / "suite.yml")
    assert cli.main(["run", "-c", c, "--json", str(data_dir / "r.json"), "--junit", str(data_dir / "r.xml"), "--html", str(data_dir / "r.html"), "--geojson-out", str(data_dir / "g")]) == 1
    assert "FAILED" in capsys.readouterr().out and json.loads((data_dir / "r.json").read_text())["passed"] is False
    assert cli.main(["run", "-c", c, "--no-fail"]) == 0 and cli.main(["run", "-c", str(data_dir / "none.yml")]) == 2
    assert cli.main(["validate", "-c", c]) == 0
    (data_dir / "bad.yml").write_text("layers: {a: {crs: {typo: 1}}}")
    assert cli.main(["validate", "-c", str(data_dir / "bad.yml")]) == 2
    new = str(data_dir / "new.yml")
    assert cli.main(["init", "-p", new]) == 0 and cli.main(["init", "-p", new]) == 1 and cli.main(["init", "-p", new, "-f"]) == 0 and cli.main(["validate", "-c", new]) == 0
    assert cli.main(["schema", "-o", str(data_dir / "s.json")]) == 0 and json.loads((data_dir / "s.json").read_text())["title"]
    assert cli.main(["list-checks"]) == 0 and "topology" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0


def test_stream(spark, tmp_path):
    from terrasift.config import AttributesRule, Domain
    from terrasift.streaming.rules import violations

    spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "id long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    q = violations(stream, AttributesRule(not_null=["v"], domains={"v": Domain(regex="[a-z]")})).writeStream.format("memory").queryName("bad_rows").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, tuple(r.checks)) for r in spark.table("bad_rows").collect()} == {(2, ("attributes.not_null[v]",)), (3, ("attributes.domain[v]",))}
