import os
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from terrasift.geom import wkb  # noqa: E402
from terrasift.model import LayerFrame  # noqa: E402
from terrasift.sources.rows import frame_of  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ring(*points):
    return np.array([*points, points[0]], float)


def square(x, y, size=10.0):
    return wkb.POLYGON, [ring((x, y), (x + size, y), (x + size, y + size), (x, y + size))]


def bowtie(x, y):
    return wkb.POLYGON, [ring((x, y), (x + 10, y + 10), (x + 10, y), (x, y + 10))]


def line(*points):
    return wkb.LINE, np.array(points, float)


@pytest.fixture
def layer(spark):
    """A layer from geometries and columns."""

    def make(geometries, crs="EPSG:3857", name="layer", **columns):
        rows = [{k: v[i] for k, v in columns.items()} | {"geometry": None if g is None else wkb.encode(g)} for i, g in enumerate(geometries)]
        return LayerFrame(name, "memory", *frame_of(spark, rows, "geometry", crs))

    return make


@pytest.fixture
def data_dir(tmp_path):
    """Two GeoJSON layers and a configuration with faults of most kinds."""
    import json

    def write(name, geometries, rows):
        features = [{"type": "Feature", "properties": r, "geometry": wkb.to_geojson(g)} for g, r in zip(geometries, rows, strict=True)]
        doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": features}
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc))

    write("parcels", [square(0, 0), square(8, 0), bowtie(0, 20), square(0, 0)],
          [{"parcel_id": "P1", "zone": "residential"}, {"parcel_id": "P2", "zone": "commercial"}, {"parcel_id": "P3", "zone": "industrial"}, {"parcel_id": "P1", "zone": None}])
    write("roads", [line((0, 0), (10, 0)), line((10, 0), (10, 10)), line((10, 0), (10, -5))],
          [{"name": "Main St", "surface": "asphalt", "lanes": 2}, {"name": "2nd Ave", "surface": "gravel", "lanes": 4}, {"name": None, "surface": "concrete", "lanes": 12}])
    (tmp_path / "suite.yml").write_text("""
version: 1
name: test suite
sources:
  - path: .
    pattern: "*.geojson"
defaults:
  crs: {allowed_epsg: [3857]}
layers:
  parcels:
    attributes:
      required: [parcel_id, zone]
      unique: [parcel_id]
      domains: {zone: {allowed: [residential, commercial, industrial]}}
    topology: {enabled: true, no_overlaps: true}
  roads:
    attributes:
      not_null: [name]
      domains: {lanes: {min: 1, max: 8}}
    topology: {enabled: true, no_dangles: true}
""")
    return tmp_path
