"""GeoTIFF rasters and PNG overlays as formats of Spark.

``spark.read.format("geotiff").load(path)`` gives a row per cell: path, row, col, x and y of its centre, value (null where masked).
A strip or tile of a file is a partition; conditions on ``row`` and ``col`` reach the source, and blocks without a cell in their range
are not read (``spark.sql.python.filterPushdown.enabled`` has to be on; ``register`` turns it on). One band, no compression or
deflate, with or without predictor; anything else is an error. ``geotiff_info`` gives a row per file.

``write`` cuts a table of cells into blocks, a file each; its files appear together when all are whole.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from slopeworks.sources import files
from slopeworks.sources.files import FileWriter, listing, opened

#: TIFF field types: letter for ``struct`` and size (fixed values).
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_SAMPLE = {1: "u", 2: "i", 3: "f"}
CELLS = "path string, row int, col int, x double, y double, value double"
INFO = "path string, width int, height int, bands int, dtype string, nodata double, west double, north double, res_x double, res_y double, epsg int"


class Tiff:
    """The directory of a file's first image: its shape, georeference and where its blocks are."""

    def __init__(self, file, path: str):
        self.path = path
        head = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if magic not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        self.order, big = order, magic == 43
        at = struct.unpack(f"{order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0]
        file.seek(at)
        count = struct.unpack(f"{order}{'Q' if big else 'H'}", file.read(8 if big else 2))[0]
        size, word = (20, "Q") if big else (12, "I")
        raw = file.read(count * size)
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HH{word}", raw, k * size)
            letter = _KINDS.get(kind)
            if letter is None:
                continue
            length, field = struct.calcsize(f"={letter}") * n, raw[(k + 1) * size - struct.calcsize(f"={word}") : (k + 1) * size]
            if length > len(field):
                file.seek(struct.unpack(f"{order}{word}", field)[0])
                field = file.read(length)
            tags[tag] = field[:n].rstrip(b"\0").decode("latin-1") if letter == "s" else struct.unpack(f"{order}{len(letter) * n}{letter[0]}", field[:length])
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        self.width, self.height, self.bands = one(256), one(257), one(277, 1)
        self.compression, self.predictor = one(259, 1), one(317, 1)
        self.dtype = np.dtype(f"{_SAMPLE.get(one(339, 1), 'u')}{one(258, 1) // 8 or 1}")
        self.tiled = 324 in tags
        self.block = (one(323), one(322)) if self.tiled else (min(one(278, self.height), self.height), self.width)
        self.offsets, self.counts = (tags[324], tags[325]) if self.tiled else (tags[273], tags[279])
        scale, tie = tags.get(33550, (1.0, 1.0)), tags.get(33922, (0.0,) * 6)
        self.res = (scale[0], scale[1])
        self.west, self.north = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        nodata = tags.get(42113, "").strip()
        self.nodata = float(nodata) if nodata else None
        keys = tags.get(34735, ())
        self.epsg = next((keys[k + 3] for want in (3072, 2048) for k in range(4, len(keys) - 3, 4) if keys[k] == want and keys[k + 1] == 0), None)

    def check(self) -> None:
        if self.bands != 1:
            raise ValueError(f"{self.path} has {self.bands} bands, not one")
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 2, 3):
            raise ValueError(f"{self.path} has compression {self.compression} with predictor {self.predictor}, which is not read")

    def blocks(self) -> Iterator[tuple[int, int, int]]:
        """(number, first row, first column) of all blocks."""
        across = -(-self.width // self.block[1])
        for k in range(len(self.offsets)):
            yield k, k // across * self.block[0], k % across * self.block[1]

    def values(self, file, k: int) -> np.ndarray:
        """A block's cells, cut at the raster's edge."""
        rows, cols = self.block
        across = -(-self.width // cols)
        first_row, first_col = k // across * rows, k % across * cols
        if not self.tiled:
            rows = min(rows, self.height - first_row)
        file.seek(self.offsets[k])
        data = file.read(self.counts[k])
        data = zlib.decompress(data) if self.compression != 1 else data
        size = self.dtype.itemsize
        if self.predictor == 3:  # bytes of one weight together, most significant first, each less the one before
            planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, cols * size), axis=1, dtype=np.uint8).reshape(rows, size, cols)
            out = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(rows, cols)
        else:
            out = np.frombuffer(data, self.dtype.newbyteorder(self.order), rows * cols).reshape(rows, cols)
            if self.predictor == 2:
                out = np.cumsum(out, axis=1, dtype=self.dtype)
        return out[: self.height - first_row, : self.width - first_col]


class _Block(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__((path, number))
        self.path, self.number = path, number


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        #: first and last row and column that any condition lets through
        self.span = {"row": [0, 1 << 62], "col": [0, 1 << 62]}

    def pushFilters(self, filters):
        """Conditions on rows and columns bound the blocks; Spark still applies them to the cells."""
        for f in filters:
            yield f
            span = self.span.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if span is None or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                continue
            value = f.value
            if isinstance(f, In):
                low, high = min(value, default=1 << 62), max(value, default=-1)
            else:
                low = value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else span[0]
                high = value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else span[1]
            span[:] = [max(span[0], low), min(span[1], high)]

    def partitions(self) -> list[_Block]:
        found = []
        (top, bottom), (left, right) = self.span["row"], self.span["col"]
        for path in listing(self.path, (".tif", ".tiff")):
            with opened(path) as file:
                tiff = Tiff(file, path)
                tiff.check()
                rows, cols = tiff.block
                found += [_Block(path, k) for k, r, c in tiff.blocks() if r <= bottom and r + rows > top and c <= right and c + cols > left]
        return found or [_Block("", -1)]  # Spark asks for one partition at least

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        with opened(partition.path) as file:
            tiff = Tiff(file, partition.path)
            values = tiff.values(file, partition.number)
        _, first_row, first_col = next(b for b in tiff.blocks() if b[0] == partition.number)
        row, col = (a.ravel() for a in np.indices(values.shape))
        row, col, z = row + first_row, col + first_col, values.ravel().astype(np.float64)
        masked = ~np.isfinite(z) | (z == tiff.nodata if tiff.nodata is not None else False)
        columns = [
            pa.array([partition.path] * len(z)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)),
            pa.array(tiff.west + (col + 0.5) * tiff.res[0]), pa.array(tiff.north - (row + 0.5) * tiff.res[1]), pa.array(z, mask=masked),
        ]
        yield from pa.table(columns, names=["path", "row", "col", "x", "y", "value"]).to_batches(max_chunksize=65_536)


class _Path(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class InfoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Path]:
        return [_Path(p) for p in listing(self.path, (".tif", ".tiff"))]

    def read(self, partition: _Path) -> Iterator[tuple]:
        with opened(partition.path) as file:
            t = Tiff(file, partition.path)
        yield partition.path, t.width, t.height, t.bands, t.dtype.name, t.nodata, t.west, t.north, *t.res, t.epsg


def tiff_bytes(values: np.ndarray, west: float, north: float, res: float, nodata: float, epsg: int, block: int = 256) -> bytes:
    """A tiled GeoTIFF of one band with deflate and the predictor of its type."""
    dtype, predictor = values.dtype, 3 if values.dtype.kind == "f" else 2
    height, width = values.shape
    tiles = []
    for r in range(0, height, block):
        for c in range(0, width, block):
            tile = np.full((block, block), nodata, dtype)
            part = values[r : r + block, c : c + block]
            tile[: part.shape[0], : part.shape[1]] = part
            if predictor == 3:
                planes = np.ascontiguousarray(tile.astype(dtype.newbyteorder(">"))).view(np.uint8).reshape(block, block, dtype.itemsize).transpose(0, 2, 1).reshape(block, -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((block, 1), np.uint8))
            else:
                raw = np.diff(tile, axis=1, prepend=np.zeros((block, 1), dtype)).astype(dtype.newbyteorder("<"))
            tiles.append(zlib.compress(raw.tobytes(), 6))
    text = f"{nodata!r}\0".encode()
    projected = epsg >= 32601  # zones of UTM
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, epsg)
    n = len(tiles)
    sample = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    fields = [  # tag, type, count, values
        (256, "I", 1, (width,)), (257, "I", 1, (height,)), (258, "H", 1, (8 * dtype.itemsize,)), (259, "H", 1, (8,)), (262, "H", 1, (1,)), (277, "H", 1, (1,)), (317, "H", 1, (predictor,)), (322, "I", 1, (block,)),
        (323, "I", 1, (block,)), (324, "I", n, None), (325, "I", n, tuple(map(len, tiles))), (339, "H", 1, (sample,)), (33550, "d", 3, (res, res, 0.0)), (33922, "d", 6, (0.0, 0.0, 0.0, west, north, 0.0)),
        (34735, "H", len(keys), keys), (42113, "s", len(text), text),
    ]
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    at, later, entries = 8 + 2 + 12 * len(fields) + 4, b"", []
    starts = at + sum(n * struct.calcsize(f"={k}") for _, k, n, _ in fields if n * struct.calcsize(f"={k}") > 4)
    starts += starts % 2
    offsets = tuple(itertools.accumulate([starts, *map(len, tiles[:-1])]))
    for tag, kind, count, data in fields:
        data = offsets if data is None else data
        packed = data if kind == "s" else struct.pack(f"<{count}{kind}", *data)
        if len(packed) > 4:
            entries.append(struct.pack("<HHII", tag, number[kind], count, at + len(later)))
            later += packed
        else:
            entries.append(struct.pack("<HHI", tag, number[kind], count) + packed.ljust(4, b"\0"))
    head = b"II*\0" + struct.pack("<IH", 8, len(fields)) + b"".join(entries) + bytes(4) + later
    return head.ljust(starts, b"\0") + b"".join(tiles)


def png_bytes(rgba: np.ndarray) -> bytes:
    """An image of 8 bits a channel; each line is filtered by the one above."""
    height, width = rgba.shape[:2]
    lines = rgba.reshape(height, -1)
    up = np.column_stack((np.full(height, 2, np.uint8), np.diff(lines, axis=0, prepend=np.zeros((1, lines.shape[1]), np.uint8))))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(up.tobytes(), 6)) + chunk(b"IEND", b"")


class BlockWriter(FileWriter):
    """Sorted cells (_br, _bc, row, col and values) as one file for each block."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.size = int(options["size"])

    def encoded(self, br: int, bc: int, rows: pa.Table) -> tuple[str, bytes]:
        raise NotImplementedError

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            br, bc = batch.column("_br").to_numpy(), batch.column("_bc").to_numpy()
            cuts = np.flatnonzero((np.diff(br) != 0) | (np.diff(bc) != 0)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(br)]):
                if a == b:
                    continue
                key = int(br[a]), int(bc[a])
                if now is not None and key != now:
                    yield self.encoded(*now, pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if now is not None:
            yield self.encoded(*now, pa.Table.from_batches(held))

    def placed(self, rows: pa.Table, column: str, br: int, bc: int, empty: np.ndarray) -> np.ndarray:
        """A column's values at their cells; nulls stay as they are in ``empty``."""
        known = rows.filter(rows.column(column).is_valid())
        at = known.column("row").to_numpy() - br * self.size, known.column("col").to_numpy() - bc * self.size
        empty[at] = known.column(column).to_numpy().astype(empty.dtype)
        return empty


class CellWriter(BlockWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.west, self.north, self.res, self.nodata = (float(options[k]) for k in ("west", "north", "res", "nodata"))
        self.dtype, self.epsg = np.dtype(options.get("dtype", "float32")), int(options.get("epsg", 4326))

    def encoded(self, br: int, bc: int, rows: pa.Table) -> tuple[str, bytes]:
        values = self.placed(rows, "value", br, bc, np.full((self.size, self.size), self.nodata, self.dtype))
        west, north = self.west + bc * self.size * self.res, self.north - br * self.size * self.res
        return f"r{br}_c{bc}.tif", tiff_bytes(values, west, north, self.res, self.nodata, self.epsg)


class OverlayWriter(BlockWriter):
    def encoded(self, br: int, bc: int, rows: pa.Table) -> tuple[str, bytes]:
        channels = [self.placed(rows, c, br, bc, np.zeros((self.size, self.size), np.uint8)) for c in ("red", "green", "blue", "alpha")]
        return f"r{br}_c{bc}.png", png_bytes(np.dstack(channels))


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(self.options, overwrite)


class GeoTiffInfo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_info"

    def schema(self) -> str:
        return INFO

    def reader(self, schema) -> InfoReader:
        return InfoReader(self.options)


class Overlay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "overlay"

    def writer(self, schema, overwrite: bool) -> OverlayWriter:
        return OverlayWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files.register(spark, GeoTiff, GeoTiffInfo, Overlay)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("geotiff").load(path)


def _blocked(cells: DataFrame, size: int) -> DataFrame:
    """Cells with their block; those of one block in one partition, one after another."""
    block = [F.floor(F.col(c) / size).cast("int").alias(f"_b{c[0]}") for c in ("row", "col")]
    return cells.select(*block, *cells.columns).repartition("_br", "_bc").sortWithinPartitions("_br", "_bc")


def write(cells: DataFrame, path: str, west: float, north: float, res: float, nodata: float = -9999.0, dtype: str = "float32", epsg: int = 4326, size: int = 1024, mode: str = "append") -> None:
    """``cells`` (row, col, value) as a GeoTIFF file for each block of ``size`` rows and columns; cells that are not there or null are masked.

    ``west`` and ``north`` are where row 0 and column 0 begin.
    """
    register(cells.sparkSession)
    rows = _blocked(cells.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double")), size)
    rows.write.format("geotiff").options(west=west, north=north, res=res, nodata=nodata, dtype=dtype, epsg=epsg, size=size).mode(mode).save(path)


def write_overlay(cells: DataFrame, path: str, size: int = 1024, mode: str = "append") -> None:
    """``cells`` (row, col, red, green, blue, alpha from 0 to 255) as a PNG file for each block; other cells are transparent."""
    register(cells.sparkSession)
    colours = [F.col(c).cast("int") for c in ("row", "col", "red", "green", "blue", "alpha")]
    _blocked(cells.select(*colours), size).write.format("overlay").options(size=size).mode(mode).save(path)


def on_grid(cells: DataFrame, west: float, north: float, res: float) -> DataFrame:
    """Cells of files with their row and column on one grid, and ``z``; ``tile_order`` is the files' order, for ``raster.mosaic``."""
    row, col = F.floor((F.lit(north) - F.col("y")) / res).cast("int"), F.floor((F.col("x") - F.lit(west)) / res).cast("int")
    return cells.select(row.alias("row"), col.alias("col"), F.col("value").alias("z"), F.col("path").alias("tile_order"))
