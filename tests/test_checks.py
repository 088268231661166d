import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.checks import attributes, crs, duplicates, geometry, topology
from terrasift.checks.base import ISSUES, to_metric
from terrasift.config import AttributesRule, CrsRule, Domain, DuplicatesRule, FuzzyRule, GeometryRule, TopologyRule
from terrasift.functions.geo import geo_validity
from terrasift.geom import wkb
from terrasift.model import FID, Status
from terrasift.operators.spatial_join import pairs
from tests.conftest import bowtie, line, ring, square


def by_name(results):
    return {r.check: r for r in results}


def attrs(frame, **rule):
    return by_name(attributes.run(frame, "l", "s", AttributesRule(**rule)))


def topo(frame, **rule):
    return by_name(topology.run(frame, "l", "s", TopologyRule(enabled=True, **rule)))


def test_geometry_and_repair(layer):
    frame = layer([square(0, 0), bowtie(0, 20), None, (wkb.POLYGON, [])])
    got = by_name(geometry.run(frame, "l", "s", GeometryRule()))
    assert [(got[f"geometry.{k}"].n_failed, got[f"geometry.{k}"].status) for k in ("no_missing", "no_empty", "valid")] == [(1, "fail")] * 3
    assert got["geometry.valid"].issues[0].feature_id == 1 and "Self-intersection" in got["geometry.valid"].issues[0].message
    r = by_name(geometry.run(frame, "l", "s", GeometryRule(fix=True)))["geometry.valid"]
    assert (r.fixed, r.n_failed, r.status) == (1, 1, Status.PASS)
    assert frame.df.where(geo_validity("geometry").isNotNull()).count() == 0


def test_geometryless_layer_is_skipped(layer):
    frame = layer([square(0, 0)], v=[1])
    frame.df, frame.geom_col = frame.df.drop("geometry"), None
    assert geometry.run(frame, "l", "s", GeometryRule())[0].status == Status.SKIP
    assert duplicates.run(frame, "l", "s", DuplicatesRule()) == [] and topology.run(frame, "l", "s", TopologyRule(enabled=True, no_gaps=True)) == []


@pytest.mark.parametrize(("code", "rule", "status", "part"), [
    ("EPSG:4326", {"allowed_epsg": [4326]}, "pass", "CRS OK (EPSG:4326)."), ("EPSG:4326", {"allowed_epsg": [3857]}, "fail", "not in the allowed list"),
    ("EPSG:4326", {"expected_epsg": 3857, "severity": "warn"}, "fail", "expected EPSG:3857"), (None, {}, "fail", "undefined"), (None, {"required": False}, "pass", "not required"), ("EPSG:4326", {"allowed_epsg": []}, "pass", "OK"),
])
def test_crs(layer, code, rule, status, part):
    r = crs.run(layer([square(0, 0)], crs=code), "l", "s", CrsRule(**rule))[0]
    assert r.status == status and part in r.message and r.n_failed == (code is None and status == "fail")


def test_exact_duplicates(layer):
    r = duplicates.run(layer([square(0, 0), square(0, 0), bowtie(0, 20), None, None]), "l", "s", DuplicatesRule())[0]
    assert (r.n_failed, r.status, [i.feature_id for i in r.issues]) == (1, Status.WARN, [0, 1])


def test_fuzzy_duplicates(layer):
    grown = (wkb.POLYGON, [ring((-0.01, -0.01), (10.01, -0.01), (10.01, 10.01), (-0.01, 10.01))])
    rule = DuplicatesRule(exact=False, fuzzy=FuzzyRule(enabled=True, min_overlap=0.9))
    r = duplicates.run(layer([square(0, 0), grown]), "l", "s", rule)[0]
    assert r.n_failed == 2 and r.issues[0].detail == {"other": 1, "iou": 0.996}
    p = lambda x: (wkb.POINT, np.array([x, 0.0]))
    near = DuplicatesRule(exact=False, fuzzy=FuzzyRule(enabled=True, predicate="dwithin", max_distance=1))
    r = duplicates.run(layer([p(0), p(0.5), p(5)]), "l", "s", near)[0]
    assert r.n_failed == 2 and r.issues[0].message == "near-duplicate within 0.5 m"
    bad = DuplicatesRule(exact=False, fuzzy=FuzzyRule(enabled=True, predicate="sideways"))
    assert duplicates.run(layer([square(0, 0)]), "l", "s", bad)[0].status == Status.ERROR


def test_attributes(layer):
    frame = layer([square(i, 0) for i in range(4)], zone=["residential", "mars", None, "residential"], v=[1, None, None, None], code=["ABC", "12", None, "ABC\n"], x=[float("nan"), 9.0, 1.0, 5.0], t=["7", "x", None, "12d"])
    got = attrs(frame, required=["zone", "gone"], not_null=["zone", "x", "lost"], unique=["zone"], max_null_fraction={"v": 0.1}, domains={
        "zone": Domain(allowed=["residential"]), "code": Domain(regex="^[A-Z]{3}$"), "x": Domain(max=8), "t": Domain(max=5), "v": Domain(allowed=[1, "a"])})
    n = {k: r.n_failed for k, r in got.items()}
    assert n == {
        "attributes.required": 1, "attributes.not_null[zone]": 1, "attributes.not_null[x]": 1, "attributes.missing[lost]": 1, "attributes.completeness[v]": 3, "attributes.unique[zone]": 1,
        "attributes.domain[zone]": 1, "attributes.domain[code]": 2, "attributes.domain[x]": 1, "attributes.domain[t]": 1, "attributes.domain[v]": 0,
    }
    assert got["attributes.completeness[v]"].message == "Column 'v' null fraction 75.0% (limit 10%)."
    assert [i.feature_id for i in got["attributes.unique[zone]"].issues] == ["residential"] * 2
    assert got["attributes.domain[zone]"].message == "Column 'zone' has 1 value(s) outside domain (allowed=['residential'])."
    assert attrs(frame, severity="warn", not_null=["lost"])["attributes.missing[lost]"].status == Status.WARN
    assert attrs(frame, severity="info", not_null=["v"])["attributes.not_null[v]"].status == Status.FAIL


def test_boolean_text_and_python_patterns(layer):
    frame = layer([square(0, 0)] * 3, b=[True, False, None], s=["é1", "a", None])
    assert attrs(frame, domains={"b": Domain(regex="True")})["attributes.domain[b]"].n_failed == 1
    assert attrs(frame, domains={"b": Domain(allowed=[1])})["attributes.domain[b]"].n_failed == 1
    assert attrs(frame, domains={"s": Domain(regex=r"(?P<w>\w+)")})["attributes.domain[s]"].n_failed == 0


def test_issue_cap(layer, spark):
    frame = layer([square(0, 0)])
    frame.df = spark.range(500).select(F.col("id").alias(FID), F.lit(None).cast("string").alias("v"), F.lit(None).cast("binary").alias("geometry"))
    r = attrs(frame, not_null=["v"])["attributes.not_null[v]"]
    assert r.n_failed == 500 and [i.feature_id for i in r.issues] == list(range(ISSUES))


def test_overlaps(layer):
    r = topo(layer([square(0, 0), square(5, 0)]), no_overlaps=True)["topology.no_overlaps"]
    assert (r.n_failed, r.status, r.issues[0].message) == (2, Status.WARN, "overlap area=50")
    assert topo(layer([square(0, 0), square(10, 0)]), no_overlaps=True)["topology.no_overlaps"].status == Status.PASS
    sliver = [square(0, 0), (wkb.POLYGON, [ring((9.999, 0), (20, 0), (20, 10), (9.999, 10))])]
    assert topo(layer(sliver), no_overlaps=True, min_area=1)["topology.no_overlaps"].status == Status.PASS
    assert topo(layer([line((0, 0), (1, 1))]), no_overlaps=True, no_gaps=True)["topology.no_gaps"].status == Status.SKIP


def test_gaps(layer):
    donut = (wkb.POLYGON, [square(0, 0, 30)[1][0], square(10, 10)[1][0]])
    r = topo(layer([donut]), no_gaps=True)["topology.no_gaps"]
    assert (r.n_failed, r.status, r.issues[0].message) == (1, Status.WARN, "gap (interior hole) area=100")


def test_dangles(layer):
    r = topo(layer([line((0, 0), (10, 0)), line((10, 0), (10, 10))]), no_dangles=True)["topology.no_dangles"]
    assert r.n_failed == 2 and r.issues[0].message == "dangling endpoint at (0.000, 0.000)"
    closed = line((0, 0), (1, 0), (1, 1), (0, 0))
    assert topo(layer([closed]), no_dangles=True)["topology.no_dangles"].status == Status.PASS
    gap = [line((0, 0), (10, 0)), line((10.4, 0), (20, 0))]
    assert topo(layer(gap), no_dangles=True, snap_tolerance=1)["topology.no_dangles"].n_failed == 2


def test_metric(layer):
    small = [square(9.0, 47.0, 0.001), square(9.0005, 47.0, 0.001)]
    r = topo(layer(small, crs="EPSG:4326"), no_overlaps=True)["topology.no_overlaps"]
    assert r.n_failed == 2 and r.message.endswith("[reprojected to EPSG:32632 for metric computations]")
    assert to_metric(layer(small, crs=None))[1].startswith("CRS undefined") and to_metric(layer(small))[1] is None


@pytest.mark.parametrize("parts", [1, 7])
def test_grid_join_finds_what_nested_loops_find(layer, parts):
    rng = np.random.default_rng(4)
    shapes = [square(*rng.uniform(0, 100, 2), float(s)) for s in rng.choice([0.5, 2, 3, 60], 120, p=[0.4, 0.3, 0.25, 0.05])]
    frame = layer(shapes)
    found = {(r.l, r.r) for r in pairs(frame.df.repartition(parts), FID, "geometry").select("l", "r").collect()}
    box = [wkb.bounds(g) for g in shapes]
    meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    assert found == {(i, j) for i in range(120) for j in range(i + 1, 120) if meet(box[i], box[j])}
    assert pairs(frame.df.repartition(parts), FID, "geometry").count() == len(found)
