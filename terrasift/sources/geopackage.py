"""GeoPackage files through sqlite3: feature tables as layers, and a writer for repaired layers."""

from __future__ import annotations

import sqlite3
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.geom import wkb
from terrasift.geom.crs import epsg_of
from terrasift.model import FID, LayerFrame
from terrasift.sources.rows import frame_of


def _open(file: Path) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def tables(file: Path) -> list[str]:
    with _open(file) as db:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type IN ('features', 'attributes') ORDER BY rowid")]


def wkb_of(blob: bytes | None) -> bytes | None:
    """A stored geometry without its header (GP, version, flags, srs_id, envelope)."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]


def read(spark: SparkSession, file: Path, table: str | None) -> tuple[DataFrame, str | None, str | None]:
    with _open(file) as db:
        table = table or next(iter(tables(file)), None)
        if table is None:
            raise ValueError("no layers in GeoPackage")
        own = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
        cur = db.execute(f'SELECT * FROM "{table.replace(chr(34), chr(34) * 2)}"')
        names = [c[0] for c in cur.description]
        keys = {r[1] for r in db.execute(f"PRAGMA table_info({quoted_one(table)})") if r[5]}
        rows = [{k: v for k, v in zip(names, r, strict=True) if k not in keys or k not in ("fid", "ogc_fid", "id")} for r in cur]
        crs = None
        if own:
            for r in rows:
                r[own[0]] = wkb_of(r[own[0]])
            srs = db.execute("SELECT organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (own[1],)).fetchone()
            if srs and own[1] > 0:
                crs = f"EPSG:{srs[1]}" if str(srs[0]).upper() == "EPSG" else srs[2]
    return frame_of(spark, rows, own[0] if own else None, crs)


#: The tables that the format requires.
SCHEMA = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL,
  organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '',
  last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL,
  z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian SRS', -1, 'NONE', -1, 'undefined', ''), ('Undefined geographic SRS', 0, 'NONE', 0, 'undefined', '');
"""


def write(frame: LayerFrame, file: Path) -> None:
    """One file, so its rows pass through the driver, a partition at a time."""
    file.unlink(missing_ok=True)
    code, g = epsg_of(frame.crs), frame.geom_col
    srs = code or -1
    kinds = dict(frame.df.dtypes)
    sql_type = lambda t: "BOOLEAN" if t == "boolean" else "INTEGER" if t in ("tinyint", "smallint", "int", "bigint") else "REAL" if t in ("float", "double") or t.startswith("decimal") else "BLOB" if t == "binary" else "TEXT"
    plain = [c for c in frame.attributes if c != "fid"]
    df = frame.df.orderBy(FID).select(g, *[F.col(f"`{c}`") if sql_type(kinds[c]) != "TEXT" and not kinds[c].startswith("decimal") else F.col(f"`{c}`").cast("double" if kinds[c].startswith("decimal") else "string") for c in plain])
    db = sqlite3.connect(file)
    try:
        db.executescript(f"PRAGMA application_id = 0x47504B47; PRAGMA user_version = 10300; {SCHEMA}")
        if code:
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', '')", (f"EPSG:{code}", code, code))
        name = frame.name
        columns = ", ".join([f"{quoted_one(g)} GEOMETRY", *[f"{quoted_one(c)} {sql_type(kinds[c])}" for c in plain]])
        db.execute(f"CREATE TABLE {quoted_one(name)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, {columns})")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (name, g, srs))
        marks = ", ".join("?" * (1 + len(plain)))
        into = f"INSERT INTO {quoted_one(name)} ({', '.join(map(quoted_one, [g, *plain]))}) VALUES ({marks})"
        for row in df.toLocalIterator():
            raw = None if row[0] is None else bytes(row[0])
            head = b"" if raw is None else b"GP" + struct.pack("<BBi", 0, 1 | (16 if wkb.is_empty(wkb.decode(raw)) else 0), srs)
            db.execute(into, [None if raw is None else head + raw, *row[1:]])
        db.commit()
    finally:
        db.close()


def quoted_one(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
