"""The tools end to end, from file to file."""

import numpy as np
import pytest

from quadrille import tools as T
from quadrille.functions.checks import InputError
from quadrille.plans import report
from quadrille.sources.geotiff import Header, write_geotiff
from quadrille.streaming.tiles import append_tiles, stream_histogram
from test_kernels import BLOCKS, SPA, cells, grid, zone


@pytest.fixture
def tif(spark, tmp_path):
    def make(a, name="in", **more):
        a = np.asarray(a)
        path = str(tmp_path / f"{name}.tif")
        write_geotiff(cells(spark, a), path, Header(*a.shape, x0=4e6, y0=3e6, res_x=10, res_y=10, epsg=3035, unit="metres", **more), tile=32)
        return path

    return make


def test_frag(spark, tif, tmp_path):
    a = np.ones((11, 11), int)
    a[3:8, 3:8] = 2
    a[0, :3] = 0, 3, 4
    r = T.frag(tif(a), "FAC", 3, 8, outdir=str(tmp_path))
    s = r.stats["Statistics"]
    assert (s["missing"], s["special_3"], s["special_4"], s["foreground"]) == (1, 1, 1, 25) and r.stats["Parameters"]["window hectares"] == 0.09
    back = T.Raster.open(r.files["tif"])
    assert back.tag == {"tool": "frag", "kind": "Binary", "threshold": "-1", "connectivity": "8", "method": "FAC_5", "pixel": "10.0", "window": "3"}
    again = T.frag_stats(r.files["tif"])
    assert again.stats["Statistics"] == s
    rows = spark.read.option("header", True).csv(r.files["histogram"])
    assert rows.columns == ["pixel_value", "pixel_count", "foreground_proportion"] and rows.count() == 101
    text = open(r.files["txt"]).read()
    assert "foreground" in text and report.renew_time(text, 3661)[1] and "1 h 1 min 1 s" in report.renew_time(text, 3661)[0]
    for bad in (T.frag_gray_stats, T.spa_stats, T.landmos_stats):
        with pytest.raises(InputError):
            bad(r.files["tif"])
    b = a.copy()
    b[5, 5] = 1
    two = T.frag(tif(b, "in2"), "FAC", 3, 8, outdir=str(tmp_path))
    c = T.frag_change(r.files["tif"], two.files["tif"], outdir=str(tmp_path))
    assert c.stats["Statistics"]["loss"] == 1 and c.stats["Statistics"]["common"] == 24
    other = T.frag(tif(b, "in3"), "FAC", 5, 8, outdir=str(tmp_path))
    with pytest.raises(InputError, match="window"):
        T.frag_change(r.files["tif"], other.files["tif"])


def test_refusals(spark, tif, tmp_path):
    p = tif(np.full((5, 5), 50))
    for f in (lambda: T.frag(p, "FAD", 3), lambda: T.frag(p, "FAD", 4), lambda: T.frag_stats(p), lambda: T.acc(p, []), lambda: T.landmos(p, 3, out_colors="x"), lambda: T.frag(p, "FAD", 3, outdir=str(tmp_path / "none")), lambda: T.rss(p)):
        with pytest.raises(InputError):
            f()


def test_gray_and_mosaic(spark, tif, tmp_path):
    a = np.zeros((15, 15), int)
    a[3:12, 3:12] = 70
    g = T.frag_gray(tif(a), "fed", 3, 1, outdir=str(tmp_path))
    assert g.stats["Statistics"]["source_foreground"] == 81 and T.frag_gray_stats(g.files["tif"]).stats["Statistics"]["foreground"] == 81
    lm = np.repeat([1, 2, 3], [5, 5, 1])[:, None] * np.ones((1, 11), int)
    m = T.landmos(tif(lm, "lm"), 3, outdir=str(tmp_path))
    assert m.stats["Statistics"]["data"] == 121 and abs(sum(m.stats["Groups"].values()) - 100) < 1e-9
    assert T.landmos_stats(m.files["tif"]).stats["Statistics"] == m.stats["Statistics"]
    with pytest.raises(InputError, match="groups"):
        T.landmos_stats(m.files["tif_groups"])
    triangle = spark.read.option("header", True).csv(m.files["triangle"])
    assert triangle.count() == 10 and len(triangle.columns) == 21


def test_morphology_and_patches(spark, tif, tmp_path):
    p = tif(SPA)
    s = T.spa(p, 1, outdir=str(tmp_path))
    m = T.mspa(p, 8, 1, outdir=str(tmp_path))
    x, y = s.stats["Statistics"], m.stats["Statistics"]
    assert [x[k] for k in ("core", "edge", "perforation", "islet")] == [y[k] for k in ("core", "edge", "perforation", "islet")]
    assert x["margin"] == y["branch"] + y["bridge"] + y["loop"] and x["foreground"] == y["foreground"] + x["core_opening"]
    assert T.spa_stats(s.files["tif"]).stats["Statistics"] == x and T.mspa_stats(m.files["tif"]).stats["Statistics"] == y
    assert T.get_tif_colormap(m.files["tif"])[17] == (0, 200, 0) and T.get_tif_colormap(m.files["tif"])[0] == (220, 220, 220)
    q = tif(BLOCKS, "blocks")
    a = T.acc(q, [10], outdir=str(tmp_path))
    assert [a.stats[f"Size class {i}"]["cells"] for i in (0, 1)] == [9, 16]
    assert [T.acc_stats(a.files["tif"]).stats[f"Size class {i}"]["cells"] for i in (0, 1)] == [9, 16]
    assert T.rss(q).stats["Statistics"]["patches"] == 2


def test_extract(spark, tif, tmp_path):
    p = tif(np.repeat([[1, 2]], 20, 1).repeat(20, 0)[:, :20])
    z = zone(spark, (4e6 + 10, 3e6 - 10), (4e6 + 60, 3e6 - 10), (4e6 + 60, 3e6 - 60), (4e6 + 10, 3e6 - 60))
    out = T.extract_by_polygon(z, p, str(tmp_path / "clips"), name_prefix="p_")
    assert out.count() == 25 and out.first().zone == "p_z"
    with pytest.raises(InputError, match="do not overlap"):
        T.extract_by_polygon(zone(spark, (0, 0), (1, 0), (1, 1)), p, None)
    bare = str(tmp_path / "bare.tif")
    write_geotiff(cells(spark, np.ones((4, 4), int)), bare, Header(4, 4))
    with pytest.warns(UserWarning), pytest.raises(InputError, match="defined projection"):
        T.extract_by_polygon(z, bare, None)


def test_texts():
    assert report.parse_tag("XYZ_FOS, <Binary,-1,8,FAD_5,100.000,27>, https://x")["window"] == "27"
    assert [report.parse_tag(t) for t in ("", "--", None, "free text", "XYZ_NEW, <1>", "XYZ_FOS, <1>")] == [None] * 6
    assert report.parse_tag(report.make_tag("acc", thresholds=[1, 20])) == {"tool": "acc", "thresholds": ["1", "20"]}
    assert report.parse_palette(["0 220 220 220", "17 0 200 0 255", "x 1 2 3", "1 2", ""]) == {0: (220, 220, 220), 17: (0, 200, 0)}
    assert [report.elapsed(x) for x in (1.234, 61, 3600)] == ["1.23 s", "1 min 1 s", "1 h 0 min 0 s"]
    assert report.renew_time("nothing", 1) == ("nothing", False)
    assert "rss" in T.info() and T.info("spa").startswith("spa:") and T.citation()
    with pytest.raises(InputError):
        T.info("x")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    cells(spark, np.arange(12).reshape(3, 4) % 3).write.parquet(src)
    stream = spark.readStream.schema("row int, col int, v short").parquet(src)
    append_tiles(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    q = stream_histogram(stream).writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.v: r.n for r in spark.table("hist").collect()} == {0: 4, 1: 4, 2: 4}
