"""Layers from SQL databases: JDBC on a cluster, SQLite files with Python alone."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import SparkSession

from terrasift.config import Source
from terrasift.model import LayerFrame
from terrasift.sources.rows import frame_of


def redacted(url: str) -> str:
    """A URL without its password; the last @ ends it, so passwords may hold one."""
    m = re.match(r"([^:/]+://)([^/]*)@(.*)\Z", url, re.S)
    if not m:
        return url
    return f"{m[1]}{m[2].split(':', 1)[0]}:***@{m[3]}"


def quoted(name: str) -> str:
    """schema.table as quoted identifiers."""
    return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))


def layer(spark: SparkSession, source: Source) -> LayerFrame:
    name, shown = source.name or source.table or "query", redacted(source.connection)
    try:
        read = _sqlite if source.connection.startswith("sqlite:") else _jdbc
        return read(spark, source, name, shown)
    except Exception as e:  # noqa: BLE001 - a source that can't be read is a layer with an error
        return LayerFrame(name, shown, error=str(e).replace(source.connection, shown))


def _sqlite(spark: SparkSession, source: Source, name: str, shown: str) -> LayerFrame:
    file = re.sub(r"^sqlite:/{0,3}", "", source.connection)
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        cur = db.execute(source.query or f"SELECT * FROM {quoted(source.table)}")
        columns = [c[0] for c in cur.description]
        rows = [dict(zip(columns, r, strict=True)) for r in cur]
    if source.geom_column not in columns:
        raise ValueError(f"no geometry column '{source.geom_column}'")
    return LayerFrame(name, shown, *frame_of(spark, rows, source.geom_column, None))


def jdbc_options(source: Source) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for a postgresql:// URL; geometry comes as WKB."""
    m = re.match(r"(\w+)(?:\+\w+)?://(?:([^:@/]*)(?::(.*))?@)?([^@/]*)/(.*)\Z", source.connection)
    if not m:
        raise ValueError("connection is not a URL of the form scheme://user:password@host/database")
    g = quoted(source.geom_column)
    inner = source.query or f"SELECT * FROM {quoted(source.table)}"
    out = {"url": f"jdbc:{m[1]}://{m[4]}/{m[5]}", "query": f'SELECT q.*, ST_AsBinary(q.{g}) AS "__wkb", ST_SRID(q.{g}) AS "__srid" FROM ({inner.rstrip("; ")}) q'}
    return out | ({"user": m[2]} if m[2] else {}) | ({"password": m[3]} if m[3] else {})


def _jdbc(spark: SparkSession, source: Source, name: str, shown: str) -> LayerFrame:
    from pyspark.sql import functions as F

    from terrasift.sources.rows import numbered

    df = spark.read.format("jdbc").options(**jdbc_options(source)).load()
    srid = df.where(F.col("__srid") > 0).select("__srid").limit(1).collect()
    df = df.drop(source.geom_column, "__srid").withColumnRenamed("__wkb", source.geom_column)
    return LayerFrame(name, shown, numbered(df), source.geom_column, f"EPSG:{srid[0][0]}" if srid else None)
