"""Polygons from GeoJSON, KML, shapefiles and GeoPackages as rows ``zone, index, rings``."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.checks import InputError
from quadrille.operators.zonal import zone_name

__all__ = ["read_polygons", "vector_crs", "layers", "wkb_rings"]

RINGS = "array<array<struct<x:double,y:double>>>"
FORMATS = (".geojson", ".json", ".kml", ".shp", ".gpkg")


def read_polygons(spark: SparkSession, path: str, id_field: str, layer: str | None = None) -> DataFrame:
    """Polygon and multipolygon features; others are left out.

    ``zone`` is the id with spaces and slashes replaced, ``feature_<index>`` where the field or its
    value is missing. GeoJSON is read by Spark; the other formats are single files of local
    tools and are read on the driver, feature by feature. A GeoPackage of several layers needs
    ``layer``.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind not in FORMATS:
        raise InputError(f"{kind or path!r} is not one of {', '.join(FORMATS)}")
    if kind in (".geojson", ".json"):
        return _geojson(spark, path, id_field)
    rows = _shapefile(path, id_field) if kind == ".shp" else _kml(path, id_field) if kind == ".kml" else _geopackage(path, id_field, layer)
    found = [(i, name, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for i, (name, rings) in enumerate(rows) if rings]
    out = spark.createDataFrame(found, f"index long, name string, rings {RINGS}")
    return out.select(zone_name(F.col("name"), F.col("index")).alias("zone"), "index", "rings")


def vector_crs(path: str, layer: str | None = None) -> str | None:
    """What a file says of its projection; None where it says nothing. GeoJSON without a word and KML are WGS 84."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".kml":
        return "EPSG:4326"
    if kind in (".geojson", ".json"):
        with open(path.removeprefix("file://"), encoding="utf-8") as f:
            m = re.search(r'"crs"\s*:\s*(null|\{.*?"name"\s*:\s*"([^"]*)")', f.read(1 << 16), re.S)
        return "EPSG:4326" if m is None else m[2] or None
    if kind == ".shp":
        prj = os.path.splitext(path)[0] + ".prj"
        if not os.path.exists(prj):
            return None
        with open(prj, encoding="utf-8", errors="replace") as f:
            return f.read().strip() or None
    layer = layer or layers(path)[0]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute("select srs_id from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
    return f"EPSG:{found[0]}" if found and found[0] and found[0] > 0 else None


def _kml(path: str, id_field: str) -> Iterator[tuple[str | None, list]]:
    """Placemarks with polygons, one after the other; the id is a datum of that name, or with ``name`` the placemark's own."""
    plain = lambda e: e.tag.rpartition("}")[2]
    for _, mark in ElementTree.iterparse(path):
        if plain(mark) != "Placemark":
            continue
        who, rings = None, []
        for e in mark.iter():
            kind = plain(e)
            if (kind == "SimpleData" and e.get("name") == id_field) or (kind == "name" and id_field == "name" and who is None):
                who = (e.text or "").strip() or None
            elif kind == "Data" and e.get("name") == id_field:
                who = next(((v.text or "").strip() or None for v in e if plain(v) == "value"), None)
            elif kind == "LinearRing":
                at = next((c.text or "" for c in e if plain(c) == "coordinates"), "")
                rings.append([tuple(map(float, p.split(",")[:2])) for p in at.split()])
        yield who, rings
        mark.clear()


def _geojson(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("index", "f"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rings = lambda c: F.transform(c, lambda r: F.transform(r, point))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    kind = F.col("f.geometry.type")
    got = F.when(kind == "Polygon", rings(one)).when(kind == "MultiPolygon", rings(many))
    name = F.try_element_at("f.properties", F.lit(id_field))
    return f.select(zone_name(name, F.col("index")).alias("zone"), F.col("index").cast("long").alias("index"), got.alias("rings")).where("rings is not null")


def wkb_rings(b: bytes) -> list[list[tuple[float, float]]]:
    """The rings of a polygon or multipolygon in well-known binary; none of other kinds."""

    def read(at: int) -> tuple[list, int]:
        o = "<" if b[at] == 1 else ">"
        kind = struct.unpack_from(o + "I", b, at + 1)[0]
        at += 5 + 4 * bool(kind & 0x20000000)
        flat = (kind & 0xFFFF) % 1000
        dims = 2 + (bool(kind & 0x80000000) + bool(kind & 0x40000000) or ((kind & 0xFFFF) // 1000 + 1) // 2 if (kind & 0xFFFF) >= 1000 or kind & 0xC0000000 else 0)
        if flat not in (3, 6):
            return [], len(b)
        n, at = struct.unpack_from(o + "I", b, at)[0], at + 4
        out = []
        for _ in range(n):
            if flat == 6:
                part, at = read(at)
                out += part
            else:
                m, at = struct.unpack_from(o + "I", b, at)[0], at + 4
                v = struct.unpack_from(f"{o}{m * dims}d", b, at)
                at += 8 * m * dims
                out.append(list(zip(v[::dims], v[1::dims])))
        return out, at

    return read(0)[0]


def layers(path: str) -> list[str]:
    """The feature layers of a GeoPackage."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [x[0] for x in db.execute("select table_name from gpkg_contents where data_type = 'features' order by table_name")]


def _geopackage(path: str, id_field: str, layer: str | None) -> Iterator[tuple[str | None, list]]:
    found = layers(path)
    if layer is None and len(found) != 1:
        raise InputError(f"name one of the layers {found}")
    layer = layer or found[0]
    if layer not in found:
        raise InputError(f"{layer!r} is not one of the layers {found}")
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        geom = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]
        names = [x[1] for x in db.execute(f"pragma table_info({quote(layer)})")]
        name = quote(id_field) if id_field in names else "null"
        for who, blob in db.execute(f"select {name}, {quote(geom)} from {quote(layer)}"):
            if blob is None:
                yield who, []
                continue
            envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
            yield None if who is None else str(who), wkb_rings(blob[8 + envelope :])


def _shapefile(path: str, id_field: str) -> Iterator[tuple[str | None, list]]:
    names: list[str | None] = []
    base = os.path.splitext(path)[0]
    if os.path.exists(base + ".dbf"):
        with open(base + ".dbf", "rb") as f:
            d = f.read()
        n, head, each = struct.unpack_from("<IHH", d, 4)
        at, place = 1, None
        for i in range(32, head - 1, 32):
            if d[i : i + 11].split(b"\0")[0].decode("latin-1") == id_field:
                place = at, d[i + 16]
            at += d[i + 16]
        if place:
            names = [d[head + k * each + place[0] : head + k * each + sum(place)].decode("utf-8", "replace").strip() or None for k in range(n)]
    with open(path, "rb") as f:
        b = f.read()
    at, k = 100, 0
    while at < len(b):
        size = struct.unpack_from(">I", b, at + 4)[0] * 2
        rings = []
        if struct.unpack_from("<I", b, at + 8)[0] in (5, 15, 25):
            parts, points = struct.unpack_from("<II", b, at + 44)
            first = [*struct.unpack_from(f"<{parts}I", b, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", b, at + 52 + 4 * parts)
            rings = [list(zip(xy[2 * a : 2 * z : 2], xy[2 * a + 1 : 2 * z : 2])) for a, z in zip(first, first[1:])]
        yield names[k] if k < len(names) else None, rings
        at, k = at + 8 + size, k + 1


def write_geojson(polygons: DataFrame, path: str) -> None:
    """Polygons back as one GeoJSON file, streamed through the driver (for small results)."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for i, r in enumerate(polygons.select("zone", "rings").toLocalIterator()):
            rings = [[[p.x, p.y] for p in ring] for ring in r.rings]
            f.write(",\n" * bool(i) + json.dumps({"type": "Feature", "properties": {"zone": r.zone}, "geometry": {"type": "Polygon", "coordinates": rings}}))
        f.write("]}\n")
