"""GeoTIFF and vector files."""

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from quadrille.functions.checks import InputError
from quadrille.operators import zonal as zo
from quadrille.sources.geotiff import Header, lzw_decode, lzw_encode, read_geotiff, read_header, write_geotiff
from quadrille.sources.vector import layers, read_polygons, wkb_rings
from test_kernels import cells, grid


def test_lzw():
    bits = lambda *codes: int("".join(f"{c:09b}" for c in codes).ljust(-(-9 * len(codes) // 8) * 8, "0"), 2).to_bytes(-(-9 * len(codes) // 8), "big")
    plain, coded = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), bits(256, 7, 258, 8, 8, 258, 6, 6, 257)  # the example of TIFF 6.0
    assert lzw_encode(plain) == coded and lzw_decode(coded) == plain
    rng = np.random.default_rng(0)
    for n in (0, 1, 254, 255, 300, 767, 5000, 70_000):
        for top in (1, 3, 256):
            b = rng.integers(0, top, n, dtype=np.uint8).tobytes()
            assert lzw_decode(lzw_encode(b)) == b
    with pytest.raises(InputError):
        lzw_decode(bits(256, 300))


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
def test_round_trip(spark, tmp_path, compression):
    a = np.random.default_rng(1).integers(0, 5, (70, 45))
    h = Header(70, 45, res_x=100, res_y=100, x0=4e6, y0=3e6, epsg=3035, unit="metres", nodata=129, description="T_FOS, <x>", software="s", colormap={0: (220, 220, 220), 17: (0, 200, 0)})
    path = str(tmp_path / "a.tif")
    write_geotiff(cells(spark, a).where("row <> 3"), path, h, tile=32, compression=compression)
    df, got = read_geotiff(spark, path)
    a[3] = 129
    assert (grid(df, a.shape) == a).all() and df.count() == a.size
    assert (got.rows, got.cols, got.epsg, got.unit, got.nodata, got.description, got.software, got.dtype, got.bounds) == (70, 45, 3035, "metres", 129, "T_FOS, <x>", "s", "uint8", h.bounds)
    assert got.colormap[17] == (0, 200, 0) and got.tiled and got.block == (32, 32)


def stripped(a, order="<", compression=1, rows=4, kind=3):
    """A striped file without georeference, made by hand."""
    code = {"uint8": "B", "uint16": "H", "int16": "h"}[a.dtype.name]
    strips = [struct.pack(f"{order}{a[i : i + rows].size}{code}", *a[i : i + rows].ravel().tolist()) for i in range(0, a.shape[0], rows)]
    strips = [zlib.compress(s) if compression == 8 else s for s in strips]
    at = np.cumsum([8, *map(len, strips)])
    tags = [(256, a.shape[1]), (257, a.shape[0]), (258, a.itemsize * 8), (259, compression), (277, 1), (278, rows), (339, 2 if code == "h" else 1)]
    n = len(strips)
    ifd = int(at[-1])
    extra = ifd + 2 + 12 * (len(tags) + 2) + 4
    body = b"".join(struct.pack(order + "HHIHH", t, 3, 1, v, 0) for t, v in tags)
    body += struct.pack(order + "HHII", 273, 4, n, extra) + struct.pack(order + "HHII", 279, 4, n, extra + 4 * n)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, ifd) + b"".join(strips) + struct.pack(order + "H", len(tags) + 2) + body + b"\0" * 4 + struct.pack(f"{order}{2 * n}I", *at[:-1].tolist(), *map(len, strips))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16"])
@pytest.mark.parametrize("compression", [1, 8])
def test_strips(spark, tmp_path, order, dtype, compression):
    a = np.arange(70).reshape(10, 7).astype(dtype) - (5 if dtype == "int16" else 0)
    p = tmp_path / "s.tif"
    p.write_bytes(stripped(a.astype(dtype), order, compression))
    df, h = read_geotiff(spark, str(p))
    assert {(r.row, r.col): r.v for r in df.collect()} == {(i, j): int(a[i, j]) for i in range(10) for j in range(7)}
    assert (h.unit, h.epsg, h.res_x, h.bounds) == ("pixels", None, 1.0, (0.0, 0.0, 7.0, 10.0))


def test_not_a_tiff(tmp_path):
    p = tmp_path / "x.tif"
    for b in (b"hello world", stripped(np.zeros((3, 3), np.uint8))[:20]):
        p.write_bytes(b)
        with pytest.raises(InputError):
            read_header(str(p))


SQUARE = [[10.0, 90.0], [40.0, 90.0], [40.0, 60.0], [10.0, 60.0], [10.0, 90.0]]
HOLE = [[20.0, 80.0], [30.0, 80.0], [30.0, 70.0], [20.0, 70.0], [20.0, 80.0]]


def wkb(rings, order="<"):
    return struct.pack(order + "BII", order == "<", 3, len(rings)) + b"".join(struct.pack(f"{order}I{2 * len(r)}d", len(r), *sum(r, [])) for r in rings)


def area(spark, polygons):
    return {r.zone: r["count"] for r in zo.polygon_cells(polygons, zo.Grid(0, 100)).groupBy("zone").count().collect()}


def test_geojson(spark, tmp_path):
    f = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    data = {"type": "FeatureCollection", "features": [f("Polygon", [SQUARE, HOLE], name="a b/c"), f("MultiPolygon", [[HOLE], [[[0, 5], [5, 5], [5, 0], [0, 0], [0, 5]]]]), f("Point", [1, 2], name="p"), {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "z.geojson").write_text(json.dumps(data, indent=1))
    assert area(spark, read_polygons(spark, str(tmp_path / "z.geojson"), "name")) == {"a_b-c": 800, "feature_1": 125}
    with pytest.raises(InputError):
        read_polygons(spark, "z.xyz", "name")


def test_geopackage(spark, tmp_path):
    p = str(tmp_path / "z.gpkg")
    with sqlite3.connect(p) as db:
        db.executescript("create table gpkg_contents(table_name, data_type); create table gpkg_geometry_columns(table_name, column_name); create table one(fid integer, nom text, geom blob); insert into gpkg_contents values ('one', 'features'); insert into gpkg_geometry_columns values ('one', 'geom')")
        head = b"GP\0\3" + struct.pack("<i4d", 3035, 0, 1, 0, 1)
        db.execute("insert into one values (1, 'x', ?), (2, null, ?), (3, 'none', null)", (head + wkb([SQUARE]), head + wkb([HOLE], ">")))
    assert layers(p) == ["one"]
    assert area(spark, read_polygons(spark, p, "nom")) == {"x": 900, "feature_1": 100}
    with sqlite3.connect(p) as db:
        db.execute("insert into gpkg_contents values ('two', 'features')")
    with pytest.raises(InputError, match="layers"):
        read_polygons(spark, p, "nom")
    assert area(spark, read_polygons(spark, p, "absent", "one")) == {"feature_0": 900, "feature_1": 100}


def test_wkb():
    many = struct.pack("<BII", 1, 6, 2) + wkb([SQUARE, HOLE]) + wkb([HOLE])
    assert [len(r) for r in wkb_rings(many)] == [5, 5, 5] and wkb_rings(struct.pack("<BI2d", 1, 1, 0, 0)) == []
    z = struct.pack("<BIII", 1, 1003, 1, 3) + struct.pack("<9d", 0, 0, 9, 1, 0, 9, 1, 1, 9)
    assert wkb_rings(z) == [[(0, 0), (1, 0), (1, 1)]]


def test_shapefile(spark, tmp_path):
    pts = [xy for ring in (SQUARE, HOLE) for p in ring for xy in p]
    body = struct.pack("<I4dIIII", 5, 10, 60, 40, 90, 2, 10, 0, 5) + struct.pack(f"<{len(pts)}d", *pts)
    (tmp_path / "z.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    (tmp_path / "z.dbf").write_bytes(struct.pack("<4xIHH20x", 1, 65, 9) + field + b"\r" + b" zone one")
    assert area(spark, read_polygons(spark, str(tmp_path / "z.shp"), "NAME")) == {"zone_one": 800}
