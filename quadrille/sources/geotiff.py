"""GeoTIFF: headers, a Spark data source that reads blocks as partitions, and a block-wise writer.

Decoder and encoder follow TIFF 6.0, BigTIFF and GeoTIFF 1.1: strips or tiles; no compression,
LZW, deflate or PackBits; horizontal predictor; integers of 8 to 64 bits; the first band.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quadrille.functions.checks import InputError
from quadrille.operators.tiles import ABSENT, TILE_SCHEMA, from_tiles, in_tiles, over_tiles, to_tiles
from quadrille.session import cut

__all__ = ["Header", "read_header", "GeoTiffDataSource", "read_geotiff", "read_tiles", "write_geotiff", "write_clips", "lzw_decode", "lzw_encode"]

#: TIFF field types: struct code and size.
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: Tags of the fields that are read or written.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, SOFTWARE, PREDICTOR, COLORMAP = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 305, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
GEO_MODEL, GEO_GEOGRAPHIC, GEO_PROJECTED, GEO_UNIT = 1024, 2048, 3072, 3076
PIXELS = 1 << 22
SPARE = 64 << 20


@dataclass
class Header:
    """What a file's header says. ``unit``: metres, degrees or pixels; ``epsg`` None if there is none."""

    rows: int
    cols: int
    bands: int = 1
    dtype: str = "uint8"
    res_x: float = 1.0
    res_y: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    epsg: int | None = None
    unit: str = "pixels"
    nodata: int | None = None
    description: str = ""
    software: str = ""
    colormap: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    tiled: bool = False
    block: tuple[int, int] = (256, 256)
    compression: int = 1
    predictor: int = 1
    order: str = "<"
    offsets: tuple[int, ...] = ()
    counts: tuple[int, ...] = ()

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Left, bottom, right, top."""
        return self.x0, self.y0 - self.rows * self.res_y, self.x0 + self.cols * self.res_x, self.y0

    @property
    def across(self) -> int:
        return -(-self.cols // self.block[1])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_header(path: str) -> Header:
    """The first directory of a file, without its pixels."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:

        def read(offset: int, n: int) -> bytes:
            f.seek(offset)
            b = f.read(n)
            if len(b) < n:
                raise InputError(f"{path} breaks off")
            return b

        head = read(0, 8)
        o = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(o + "H", head[2:4])[0] if o else 0
        if magic not in (42, 43):
            raise InputError(f"{path} is not a TIFF file")
        big = magic == 43
        start = struct.unpack(o + "Q", read(8, 8))[0] if big else struct.unpack(o + "I", head[4:])[0]
        n = struct.unpack(o + ("Q" if big else "H"), read(start, 8 if big else 2))[0]
        size, own, word = (20, 8, "Q") if big else (12, 4, "I")
        raw = read(start + (8 if big else 2), n * size)
        tags: dict[int, tuple] = {}
        for i in range(0, len(raw), size):
            tag, kind = struct.unpack(o + "HH", raw[i : i + 4])
            count = struct.unpack(o + word, raw[i + 4 : i + 4 + own])[0]
            code, width = KINDS.get(kind, ("B", 1))
            data = raw[i + 4 + own : i + size][: count * width] if count * width <= own else read(struct.unpack(o + word, raw[i + 4 + own : i + size])[0], count * width)
            tags[tag] = (data.rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{o}{count * len(code)}{code[0]}", data)
    get = lambda t, d: tags.get(t, (d,))[0]
    tiled = TILE_OFFSETS in tags
    rows, cols = get(HEIGHT, 0), get(WIDTH, 0)
    form = {1: "uint", 2: "int", 3: "float"}.get(get(FORMAT, 1), "uint")
    scale, tie, keys = tags.get(SCALE), tags.get(TIEPOINT), tags.get(GEOKEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = geo.get(GEO_PROJECTED) or geo.get(GEO_GEOGRAPHIC)
    unit = "degrees" if geo.get(GEO_MODEL) == 2 else "metres" if geo.get(GEO_MODEL) == 1 and geo.get(GEO_UNIT, 9001) == 9001 else "pixels"
    try:
        nodata = int(float(get(NODATA, "")))
    except ValueError:
        nodata = None
    cm = tags.get(COLORMAP, ())
    third = len(cm) // 3
    rx, ry = (scale[0], scale[1]) if scale else (1.0, 1.0)
    return Header(
        rows, cols, get(SAMPLES, 1), f"{form}{get(BITS, 1)}", rx, ry, tie[3] - tie[0] * rx if tie else 0.0, tie[4] + tie[1] * ry if tie else float(rows), epsg, unit, nodata, get(DESCRIPTION, ""), get(SOFTWARE, ""),
        {i: (cm[i] >> 8, cm[third + i] >> 8, cm[2 * third + i] >> 8) for i in range(third)}, tiled,
        (get(TILE_HEIGHT, 256), get(TILE_WIDTH, 256)) if tiled else (min(get(STRIP_ROWS, rows), rows), cols), get(COMPRESSION, 1), get(PREDICTOR, 1), o, tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()),
    )


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, one early."""
    out, table, width, last = [], [], 9, b""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, last = fresh.copy(), 9, b""
            continue
        if code == 257:
            break
        if code > len(table) or not table:
            raise InputError("damaged LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 in (512, 1024, 2048):
                width += 1
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    fresh = {bytes([i]): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    table, after, last = fresh.copy(), 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if last + c in table:
            last += c
            continue
        put(table[last])
        table[last + c] = after
        after += 1
        if after in (512, 1024, 2048):
            width += 1
        if after == 4095:
            put(256)
            table, after, width = fresh.copy(), 258, 9
        last = c
    if last:
        put(table[last])
        width += after + 1 in (512, 1024, 2048)
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out.append(data[i : i + n + 1])
            i += n + 1
        elif n > 128:
            out.append(data[i : i + 1] * (257 - n))
            i += 1
    return b"".join(out)


def decode_block(h: Header, raw: bytes, rows: int) -> np.ndarray:
    """The first band of a block, ``rows`` high."""
    if h.compression not in (1, 5, 8, 32946, 32773):
        raise InputError(f"compression {h.compression} is not supported")
    if h.predictor not in (1, 2):
        raise InputError(f"predictor {h.predictor} is not supported")
    raw = lzw_decode(raw) if h.compression == 5 else zlib.decompress(raw) if h.compression in (8, 32946) else _packbits(raw) if h.compression == 32773 else raw
    a = np.frombuffer(raw, np.dtype(h.dtype).newbyteorder(h.order), rows * h.block[1] * h.bands).reshape(rows, h.block[1], h.bands)
    if h.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=h.dtype)
    return a[:, :, 0]


class GeoTiffDataSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: a row per pixel of the first band; with option
    ``form`` "tiles" a row per block of a tiled file, as in :mod:`quadrille.operators.tiles`.

    A partition is a run of whole blocks of about four million pixels, so tasks read disjoint
    parts of the file and none holds more than its blocks, one at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return TILE_SCHEMA if self.options.get("form") == "tiles" else "row int, col int, v int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("form") == "tiles")


class _Reader(DataSourceReader):
    def __init__(self, path: str, tiles: bool) -> None:
        self.path, self.header, self.tiles = path, read_header(path), tiles
        if tiles and not self.header.tiled:
            raise InputError(f"{path} is not in tiles")
        if not self.header.dtype.startswith(("int", "uint")) or self.header.dtype[-1] not in "8624":
            raise InputError(f"a raster has integer values, not {self.header.dtype}")

    def partitions(self) -> list[InputPartition]:
        n, each = len(self.header.offsets), max(1, PIXELS // (self.header.block[0] * self.header.block[1]))
        return [InputPartition((a, min(n, a + each))) for a in range(0, n, each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        h = self.header
        fs, at = _open(self.path)
        with fs.open_input_file(at) as f:
            for k in range(*partition.value):
                r0, c0 = k // h.across * h.block[0], k % h.across * h.block[1]
                rows = min(h.block[0], h.rows - r0)
                f.seek(h.offsets[k])
                a = decode_block(h, f.read(h.counts[k]), h.block[0] if h.tiled else rows)[:rows, : h.cols - c0]
                if self.tiles:  # whole blocks; what is no byte from 0 to 254 becomes 254
                    whole = np.full(h.block, ABSENT, np.uint8)
                    whole[: a.shape[0], : a.shape[1]] = np.where((a < 0) | (a > 254), 254, a)
                    ints = (k // h.across, k % h.across, r0, c0, *h.block)
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in ints), pa.array([whole.tobytes()], pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])
                    continue
                row = np.repeat(np.arange(r0, r0 + a.shape[0], dtype=np.int32), a.shape[1])
                col = np.tile(np.arange(c0, c0 + a.shape[1], dtype=np.int32), a.shape[0])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(a.ravel().astype(np.int32))], names=["row", "col", "v"])


def read_tiles(spark: SparkSession, path: str, least: int = 64) -> DataFrame | None:
    """The blocks of a file as tiles; None where it has no square blocks of at least ``least`` cells a side."""
    h = read_header(path)
    if not h.tiled or h.block[0] != h.block[1] or h.block[0] < least:
        return None
    spark.dataSource.register(GeoTiffDataSource)
    return spark.read.format("geotiff").option("form", "tiles").load(path)


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    spark.dataSource.register(GeoTiffDataSource)
    return spark.read.format("geotiff").load(path), read_header(path)


CODES = {"none": 1, "lzw": 5, "deflate": 8}


def encode_block(a: np.ndarray, code: int) -> bytes:
    """A tile of bytes, compressed with differences along rows."""
    if code == 1:
        return a.tobytes()
    a = np.diff(a, axis=1, prepend=np.zeros((a.shape[0], 1), np.uint8)).tobytes()
    return lzw_encode(a) if code == 5 else zlib.compress(a, 6)


def _directory(header: Header, counts: np.ndarray, tile: int, code: int) -> bytes:
    """All of a file that stands before its blocks, of which the lengths are known."""
    big = int(counts.sum()) + SPARE > 1 << 32
    word, own, wide = ("Q", 8, 16) if big else ("I", 4, 4)
    geo = [1, 1, 0, 0]
    if header.epsg:
        kind = 2 if header.unit == "degrees" else 1
        geo += [GEO_MODEL, 0, 1, kind, GEO_GEOGRAPHIC if kind == 2 else GEO_PROJECTED, 0, 1, header.epsg] + ([GEO_UNIT, 0, 1, 9001] if kind == 1 else [])
        geo[3] = len(geo) // 4 - 1
    text = lambda s: (2, s.encode() + b"\0")
    pack = lambda kind, *v: (kind, struct.pack(f"<{len(v)}{KINDS[kind][0]}", *v))
    fields = {
        WIDTH: pack(4, header.cols), HEIGHT: pack(4, header.rows), BITS: pack(3, 8), COMPRESSION: pack(3, code), PHOTOMETRIC: pack(3, 3 if header.colormap else 1), SAMPLES: pack(3, 1), PLANAR: pack(3, 1), PREDICTOR: pack(3, 1 if code == 1 else 2),
        TILE_WIDTH: pack(3, tile), TILE_HEIGHT: pack(3, tile), TILE_OFFSETS: pack(wide, *[0] * len(counts)), TILE_COUNTS: pack(wide, *counts.tolist()), FORMAT: pack(3, 1),
        SCALE: pack(12, header.res_x, header.res_y, 0.0), TIEPOINT: pack(12, 0.0, 0.0, 0.0, header.x0, header.y0, 0.0), GEOKEYS: pack(3, *geo),
    }
    fields |= {t: text(s) for t, s in ((DESCRIPTION, header.description), (SOFTWARE, header.software)) if s}
    if header.colormap:
        fields[COLORMAP] = pack(3, *(header.colormap.get(i, (0, 0, 0))[c] * 257 for c in range(3) for i in range(256)))
    if header.nodata is not None:
        fields[NODATA] = text(str(header.nodata))

    def directory(offsets: np.ndarray) -> bytes:
        at = (16 if big else 8) + (8 if big else 2) + len(fields) * (20 if big else 12) + own
        entries, rest = b"", b""
        for tag, (kind, data) in sorted((fields | {TILE_OFFSETS: pack(wide, *offsets.tolist())}).items()):
            value = data.ljust(own, b"\0") if len(data) <= own else struct.pack("<" + word, at + len(rest))
            rest += b"" if len(data) <= own else data + b"\0" * (len(data) % 2)
            entries += struct.pack("<HH" + word, tag, kind, len(data) // KINDS[kind][1]) + value
        head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8))
        return head + struct.pack("<Q" if big else "<H", len(fields)) + entries + b"\0" * own + rest

    first = len(directory(np.zeros(len(counts), np.int64)))
    return directory(first + np.cumsum(counts) - counts)


def write_geotiff(cells: DataFrame, path: str, header: Header, tile: int = 256, compression: str = "deflate") -> None:
    """Write byte-valued cells, or tiles, as a tiled file; cells that aren't there get ``header.nodata`` or 0.

    Blocks are encoded by the tasks and written to the shared folder. The driver gets their
    lengths, writes the directory, and passes the blocks on one after the other. BigTIFF where
    the file comes near 4 GB. ``lzw`` is encoded byte by byte in Python, about a hundred times as slow as
    deflate.
    """
    code = CODES[compression]
    fill, down, across = header.nodata or 0, -(-header.rows // tile), -(-header.cols // tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [encode_block(np.where((a := np.frombuffer(x, np.uint8).reshape(tile, tile)) == ABSENT, np.uint8(fill), a), code) for x in b.column("data").to_pylist()]
            k = np.array(b.column("tr").to_pylist(), np.int64) * across + np.array(b.column("tc").to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["k", "n", "block"])

    if in_tiles(cells) and cells.select("h").first() != (tile,):
        cells = from_tiles(cells)
    inside = cells if in_tiles(cells) else cells.where(f"row between 0 and {header.rows - 1} and col between 0 and {header.cols - 1} and v is not null")
    blocks = cut(over_tiles(to_tiles(inside, tile), run, "k long, n long, block binary"), "blocks")
    blank = encode_block(np.full((tile, tile), fill, np.uint8), code)
    counts = np.full(down * across, len(blank), np.int64)
    for r in blocks.select("k", "n").toLocalIterator():  # sixteen bytes a block
        counts[r.k] = r.n
    fs, at = _open(path)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(_directory(header, counts, tile, code))
        k = 0
        for r in blocks.select("k", "block").orderBy("k").toLocalIterator():
            for _ in range(k, r.k):
                f.write(blank)
            f.write(bytes(r.block))
            k = r.k + 1
        for _ in range(k, len(counts)):
            f.write(blank)


def write_clips(clips: DataFrame, folder: str, header: Header, nodata: int, tile: int = 256, compression: str = "deflate", most: int = 1 << 26) -> list[str]:
    """A file ``<zone>.tif`` for each zone of ``clips(zone, row, col, v)``, cut to its own box.

    Files of up to ``most`` cells are made by the tasks, several at a time, in the shared
    ``folder``; larger ones go one by one through :func:`write_geotiff`. Returns the zones' names.
    """
    code = CODES[compression]
    boxes = cut(clips.groupBy("zone").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")), "boxes")
    cells = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)

    def own(r0: int, r1: int, c0: int, c1: int) -> Header:
        return replace(header, rows=r1 - r0 + 1, cols=c1 - c0 + 1, x0=header.x0 + c0 * header.res_x, y0=header.y0 - r0 * header.res_y)

    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)

    def write(key: tuple, t: pa.Table) -> pa.Table:
        r, c, v = (t.column(x).to_numpy() for x in ("row", "col", "v"))
        h = own(int(r.min()), int(r.max()), int(c.min()), int(c.max()))
        down, across = -(-h.rows // tile), -(-h.cols // tile)
        a = np.full((down * tile, across * tile), nodata, np.uint8)
        a[r - r.min(), c - c.min()] = v
        blocks = [encode_block(a[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile], code) for i in range(down) for j in range(across)]
        to, at = _open(f"{folder}/{key[0].as_py()}.tif")
        with to.open_output_stream(at, compression=None) as f:
            f.write(_directory(h, np.array([len(x) for x in blocks]), tile, code))
            for x in blocks:
                f.write(x)
        return pa.table({"zone": [key[0].as_py()]})

    few = clips.join(boxes.where(cells <= most).select("zone"), "zone", "left_semi")
    done = [r.zone for r in few.groupBy("zone").applyInArrow(write, "zone string").collect()]  # one short name a file
    for b in boxes.where(cells > most).toLocalIterator():
        one = clips.where(F.col("zone") == b.zone).select((F.col("row") - b.r0).alias("row"), (F.col("col") - b.c0).alias("col"), "v")
        write_geotiff(one, f"{folder}/{b.zone}.tif", replace(own(b.r0, b.r1, b.c0, b.c1), nodata=nodata), tile, compression)
        done.append(b.zone)
    return sorted(done)
