"""Colours, reports, clips as files, polygons in KML, differences between dates."""

import csv
import json

import numpy as np
import pytest
from test_kernels import cells, grid, zone

from quadrille import tools as T
from quadrille.functions import palettes
from quadrille.functions import statistics as st
from quadrille.functions.checks import InputError
from quadrille.functions.mosaic import CODES
from quadrille.operators import change as ch
from quadrille.sources.geotiff import Header, read_geotiff, read_header, write_clips, write_geotiff
from quadrille.sources.vector import read_polygons, vector_crs


@pytest.fixture
def tif(spark, tmp_path):
    def make(a, name="in", **more):
        a = np.asarray(a)
        path = str(tmp_path / f"{name}.tif")
        write_geotiff(cells(spark, a), path, Header(*a.shape, x0=4e6, y0=3e6, res_x=10, res_y=10, epsg=3035, unit="metres", **more), tile=32)
        return path

    return make


def test_palettes():
    p = palettes.palette
    assert (p("mspa")[0], p("mspa")[17], p("mspa")[35], p("mspa_plain")[35]) == ((220, 220, 220), (0, 200, 0), (255, 0, 0), (0, 0, 0))
    assert (p("frag")[9], p("frag")[10], p("frag")[102]) == ((215, 50, 40), (250, 140, 90), (255, 255, 255))
    assert p("change")[250] == (0, 255, 0) and p("acc")[103] == (0, 0, 0) and p("mosaic_groups")[17] == (0, 191, 0)
    for s in palettes.SCHEMES:
        values = sorted(v for _, _, vs in palettes.legend(f"mosaic_{s}") for v in vs)
        assert len(values) == len(set(values)) and set(CODES) <= set(values)


def test_schemes_and_heatmap(spark, tif, tmp_path):
    lm = np.repeat([1, 2, 3], [5, 5, 1])[:, None] * np.ones((1, 11), int)
    path = tif(lm, "lm")
    m = T.landmos(path, 3, outdir=str(tmp_path), out_colors="nat")
    assert T.get_tif_colormap(m.files["tif"])[170] == (20, 140, 20)
    assert T.get_tif_colormap(m.files["tif_groups"])[19] == (191, 0, 0)
    with open(m.files["heatmap"], newline="") as f:
        lines = list(csv.reader(f))
    assert len(lines) == 13 and {len(x) for x in lines} == {22}
    shares = [float(x) for line in lines[1:] for x in line if x.strip()]
    assert len(shares) == 103 and abs(sum(shares) - 100) < 0.1
    rows = spark.read.option("header", True).csv(m.files["histogram"]).collect()
    assert abs(sum(float(r.foreground_proportion) for r in rows) - 100) < 1e-3
    assert T.landmos_stats(m.files["tif"], source=path).stats["Input"]["Input image"] == "lm"


def test_sources_of_statistics(spark, tif, tmp_path):
    a = np.zeros((15, 15), int)
    a[3:12, 3:12] = 70
    path = tif(a)
    g = T.frag_gray(path, "fed", 3, 1, outdir=str(tmp_path))
    assert T.frag_gray_stats(g.files["tif"], source=path).stats == g.stats
    alone = T.frag_gray_stats(g.files["tif"]).stats
    assert alone["Input"]["Input image"] == "n/a" and "source_foreground" not in alone["Statistics"]
    b = np.ones((20, 20), int)
    b[5:15, 5:15] = 2
    path = tif(b, "b")
    m = T.mspa(path, 8, 1, outdir=str(tmp_path), transition=False)
    assert T.mspa_stats(m.files["tif"], source=path).stats == m.stats and m.stats["External"]["Core (17)"] == 64
    assert T.get_tif_colormap(m.files["tif"])[67] == (0, 0, 0)
    with open(m.files["txt"]) as f:
        text = f.read()
    assert all(x in text for x in ("Input image", "porosity", "Bridge in Edge (35)", "Core-Opening (100)", "Total pixels", "EPSG"))


def test_differences_between_dates(spark):
    x, y = (cells(spark, [v]) for v in ([100, 50, 101], [80, 40, 101]))
    d = st.change_differences(ch.crosstab(x, y)).first()
    assert (d.a_fad_av, d.b_fad_av, d.fad_av_difference) == (75, 60, -15) and abs(d.fad_av_relative + 0.2) < 1e-12
    assert (d.a_avcon, d.b_avcon) == (50, 40) and abs(d.avcon_relative + 0.2) < 1e-12
    none = st.change_differences(ch.crosstab(*(cells(spark, [[101]]) for _ in "ab"))).first()
    assert none.fad_av_relative == none.avcon_difference == 0


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y - size), (x, y - size), (x, y)]


def test_clips_as_files(spark, tif, tmp_path):
    a = np.arange(400).reshape(20, 20) % 200
    path = tif(a, description="QDR_SPA, <1,6>", colormap={0: (9, 8, 7)})
    out = str(tmp_path / "clips")
    both = zone(spark, *square(4e6 + 10, 3e6 - 10, 50), name="a").union(zone(spark, *square(4e6 + 150, 3e6 - 150, 500), name="b"))
    got = T.extract_by_polygon(both, path, out, name_prefix="p_")
    assert {r.zone for r in got.select("zone").distinct().collect()} == {"p_a", "p_b"}
    h = read_header(f"{out}/p_a.tif")
    assert (h.rows, h.cols, h.x0, h.y0, h.epsg, h.description, h.colormap[0]) == (5, 5, 4e6 + 10, 3e6 - 10, 3035, "QDR_SPA, <1,6>", (9, 8, 7))
    back = grid(read_geotiff(spark, f"{out}/p_a.tif")[0], (5, 5))
    assert (back == a[1:6, 1:6]).all()
    assert read_header(f"{out}/p_b.tif").rows == 5  # cut at the raster's border
    triangle = zone(spark, (4e6, 3e6), (4e6 + 100, 3e6), (4e6, 3e6 - 100), name="t")
    for most in (1 << 26, 10):  # in a task, or on its own
        clips = T.extract_by_polygon(triangle, path, None)
        assert write_clips(clips, out, read_header(path), 129, most=most) == ["t"]
        t = grid(read_geotiff(spark, f"{out}/t.tif")[0], (10, 10))
        assert t[9, 9] == 129 and t[1, 1] == a[1, 1]


def test_projections_and_kml(spark, tif, tmp_path):
    path = tif(np.full((20, 20), 5))
    shape = {"type": "Polygon", "coordinates": [[list(p) for p in square(4e6 + 10, 3e6 - 10, 50)]]}
    made = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "x y"}, "geometry": shape}]}
    for k, crs in enumerate(({}, {"crs": None}, {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3035"}}})):
        f = tmp_path / f"{k}.geojson"
        f.write_text(json.dumps({**crs, **made}))
    assert [vector_crs(str(tmp_path / f"{k}.geojson")) for k in range(3)] == ["EPSG:4326", None, "urn:ogc:def:crs:EPSG::3035"]
    with pytest.raises(InputError, match="defined projection"):
        T.extract_by_polygon(str(tmp_path / "1.geojson"), path, None, "id")
    assert T.extract_by_polygon(str(tmp_path / "2.geojson"), path, None, "id").count() == 25
    assert vector_crs(str(tmp_path / "none.shp")) is None
    ring = " ".join(f"{x},{y},0" for x, y in square(4e6 + 10, 3e6 - 10, 50))
    kml = tmp_path / "a.kml"
    kml.write_text(f"""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
      <Placemark><name>one</name><ExtendedData><Data name="id"><value>k 1</value></Data></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
      <Placemark><name>two</name><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>""")
    assert [r.zone for r in read_polygons(spark, str(kml), "id").collect()] == ["k_1"]
    assert [r.zone for r in read_polygons(spark, str(kml), "name").collect()] == ["one"]
    assert T.extract_by_polygon(str(kml), path, None, "none").first().zone == "feature_0"
