"""KML, XLSX, GeoTIFF and PNG as formats: round trips, pruning, refusals, and files that appear only when whole."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.operators import raster
from slopeworks.sources import files, geotiff, placemarks, sheets

SQUARE = "0,0,5 4,0,5 4,4,5 0,4,5 0,0,5"
HOLE = "1,1 2,1 2,2 1,1"
KML = f"""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>
<Placemark><ExtendedData><Data name=" vlcode "><value> 7 </value></Data><Data name="bare">text</Data><SchemaData><SimpleData name="simple">s</SimpleData></SchemaData></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>{SQUARE}</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>{HOLE}</coordinates></LinearRing></innerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>1,1 2,1 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon><Polygon><outerBoundaryIs><LinearRing><coordinates>9 9,9 8,8</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
<Placemark><name>no shape</name></Placemark></Folder></Document></kml>"""


def marks(spark, path, **options):
    files.register(spark, placemarks.Placemarks)
    return spark.read.format("placemarks").options(**options).load(str(path))


def test_placemarks_of_both_variants(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.KMZ", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("in/doc.KML", KML)
    rows = marks(spark, tmp_path).orderBy("path", "number").collect()
    assert len(rows) == 4 and rows[0]["attributes"] == rows[2]["attributes"] == {"vlcode": "7", "bare": ""}
    (part,) = rows[0]["parts"]
    assert [tuple(p) for p in part["shell"]] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] and len(part["holes"]) == 1 and rows[1]["parts"] == []
    assert marks(spark, tmp_path / "a.kml", variant="serving").first()["attributes"] == {"vlcode": "7", "bare": "text", "simple": "s"}


@pytest.mark.parametrize(("text", "why"), [(KML[:-20], "malformed XML"), (KML.replace("4,4,5", "4,x"), "could not convert")])
def test_malformed_placemarks_are_refused(spark, tmp_path, text, why):
    (tmp_path / "a.kml").write_text(text)
    with pytest.raises(Exception, match=why):
        marks(spark, tmp_path).collect()


def test_an_archive_without_kml_and_an_empty_folder_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("x.txt", "x")
    with pytest.raises(Exception, match="no KML file"):
        marks(spark, tmp_path).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .kml"):
        marks(spark, tmp_path / "none").collect()


def test_many_placemarks_are_parsed_in_bounded_memory(tmp_path):
    import tracemalloc

    mark = KML[KML.index("<Placemark>") : KML.index("</Placemark>") + 12]
    with zipfile.ZipFile(tmp_path / "big.kmz", "w", zipfile.ZIP_DEFLATED) as z, z.open("doc.kml", "w") as out:
        out.write(b"<kml><Document>")
        for _ in range(1000):
            out.write(mark.encode() * 100)
        out.write(b"</Document></kml>")
    reader = placemarks.PlacemarkReader({"path": str(tmp_path)})
    tracemalloc.start()
    n = sum(1 for p in reader.partitions() for _ in reader.read(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < 8e6


def test_placemarks_round_trip(spark, tmp_path):
    ring = "array<struct<x:double,y:double>>"
    one = [([(0.1, 0.2), (3.0, 0.0), (3.0, 3.0), (0.1, 0.2)], [[(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)]])]
    rows = [({"k": str(k), "a<&\">": " x&<"}, one if k % 2 else []) for k in range(20)]
    df = spark.createDataFrame(rows, f"attributes map<string,string>, parts array<struct<shell:{ring},holes:array<{ring}>>>").repartition(3)
    files.register(spark, placemarks.Placemarks)
    df.write.format("placemarks").mode("append").save(str(tmp_path / "out"))
    got = {r["attributes"]["k"]: (r["attributes"], r["parts"]) for r in marks(spark, tmp_path / "out").collect()}
    want = {r["attributes"]["k"]: ({k: v.strip() for k, v in r["attributes"].items()}, r["parts"]) for r in df.collect()}
    assert got == want and len(list((tmp_path / "out").glob("*.kmz"))) == 3


# --- sheets


def test_sheets_round_trip(spark, tmp_path):
    files.register(spark, sheets.Sheet)
    rows = [(k, f"n<{k}>&", k / 4 if k % 3 else None, " " if k == 5 else None) for k in range(50)]
    df = spark.createDataFrame(rows, "code long, name string, share double, note string").repartition(2)
    df.write.format("sheet").option("sheet", 'a "b" & c').mode("append").save(str(tmp_path / "out"))
    got = spark.read.format("sheet").option("sheet", 'a "b" & c').load(str(tmp_path / "out"))
    assert got.columns == df.columns
    text = lambda v: None if v is None else str(v)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(map(text, r)) for r in rows), key=str)
    with pytest.raises(Exception, match="has no sheet 'other'; there are: a \"b\" & c"):
        spark.read.format("sheet").option("sheet", "other").load(str(tmp_path / "out")).collect()


def test_sheet_cells_of_all_kinds(spark, tmp_path):
    main, rel = sheets._MAIN, sheets._REL[1:-3]
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><r><t>th</t></r><r><t>ird</t></r></is></c></row><row r="3"><c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>587.0</v></c><c r="C4" t="str"><f>A1</f><v>x</v></c></row><row r="5"/>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="x"/><sheet name="Two" sheetId="2" r:id="y"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/s1.xml"/><Relationship Id="y" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>first</t><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    files.register(spark, sheets.Sheet)
    two = spark.read.format("sheet").option("sheet", "Two").load(str(tmp_path))
    assert two.columns == ["first", "third"] and [tuple(r) for r in two.collect()] == [(None, "TRUE"), ("587.0", "x")]
    assert spark.read.format("sheet").load(str(tmp_path)).columns == ["1"] and sheets.column_of("AB12") == 27


# --- rasters


def test_rasters_round_trip_and_read_only_their_blocks(spark, tmp_path):
    cells = spark.range(90 * 70).selectExpr("int(id / 70) - 20 as row", "int(id % 70) as col", "if(id % 11 = 0, null, double(id % 977) / 8) as value")
    for dtype in ("float32", "int32", "float64"):
        path = str(tmp_path / dtype)
        geotiff.write(cells, path, west=76.5, north=11.5, res=0.25, dtype=dtype, size=32, nodata=-9999)
        back = geotiff.on_grid(geotiff.read(spark, path), 76.5, 11.5, 0.25)
        number = F.col("value").cast("int") if dtype == "int32" else F.col("value")
        want = {(r["row"], r["col"]): r["value"] for r in cells.withColumn("value", number).collect() if r["value"] is not None}
        assert {(r["row"], r["col"]): r["z"] for r in back.filter("z is not null").collect()} == want
    info = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.format("geotiff_info").load(path).collect()}
    assert len(info) == 4 * 3 and info["r-1_c2.tif"]["north"] == 11.5 + 8 and info["r-1_c2.tif"]["west"] == 76.5 + 16
    assert {(r["epsg"], r["dtype"], r["nodata"], r["width"]) for r in info.values()} == {(4326, "float64", -9999.0, 32)}


def test_conditions_on_rows_prune_blocks(spark, tmp_path):
    values = np.arange(700 * 600, dtype=np.float32).reshape(700, 600)
    (tmp_path / "a.tif").write_bytes(geotiff.tiff_bytes(values, 0.0, 0.0, 1.0, -1.0, 32643, block=64))
    df = geotiff.read(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 11 * 10
    some = geotiff.read(spark, str(tmp_path)).filter("row >= 64 and row < 129 and col = 70")
    assert some.rdd.getNumPartitions() == 2 and {(r["row"], r["value"]) for r in some.collect()} == {(k, k * 600 + 70.0) for k in range(64, 129)}
    assert geotiff.read(spark, str(tmp_path)).filter("row in (3, 5) and col > 590").rdd.getNumPartitions() == 1
    assert geotiff.read(spark, str(tmp_path)).filter("row > 5000").collect() == []
    assert spark.read.format("geotiff_info").load(str(tmp_path)).first()["epsg"] == 32643


def strips(values, order, compression=1, bands=1):
    """A plain file of strips of two rows, by another hand than the writer's."""
    height, width = values.shape
    raw = [values[k : k + 2].astype(values.dtype.newbyteorder(order)).tobytes() for k in range(0, height, 2)]
    raw = [zlib.compress(r) for r in raw] if compression != 1 else raw
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    at = np.cumsum([8, *map(len, raw)]).tolist()
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8 * values.dtype.itemsize]), (259, 3, [compression]), (273, 4, at[:-1]), (277, 3, [bands]), (278, 3, [2]), (279, 4, list(map(len, raw))), (339, 3, [kind])]
    entries, later, base = b"", b"", at[-1] + 2 + 12 * len(fields) + 4
    for tag, field, data in fields:
        packed = struct.pack(f"{order}{len(data)}{'H' if field == 3 else 'I'}", *data)
        if len(packed) > 4:
            packed, later = struct.pack(f"{order}I", base + len(later)), later + packed
        entries += struct.pack(f"{order}HHI", tag, field, len(data)) + packed.ljust(4, b"\0")
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", at[-1])
    return head + b"".join(raw) + struct.pack(f"{order}H", len(fields)) + entries + bytes(4) + later


@pytest.mark.parametrize(("order", "dtype", "compression"), [("<", "i2", 1), (">", "i2", 8), (">", "f4", 1), ("<", "u1", 32946)])
def test_strips_of_other_writers(spark, tmp_path, order, dtype, compression):
    values = (np.arange(35).reshape(7, 5) % 23).astype(dtype)
    (tmp_path / "a.TIF").write_bytes(strips(values, order, compression))
    rows = geotiff.read(spark, str(tmp_path)).collect()
    assert {(r["row"], r["col"]): r["value"] for r in rows} == {(i, j): float(values[i, j]) for i in range(7) for j in range(5)}


def test_rasters_that_cannot_be_read_are_refused(spark, tmp_path):
    for name, data, why in (("a", strips(np.ones((2, 2), "i2"), "<", bands=3), "3 bands"), ("b", strips(np.ones((2, 2), "i2"), "<", 5), "compression 5"), ("c", b"no tiff at all", "no TIFF")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.tif").write_bytes(data)
        with pytest.raises(Exception, match=why):
            geotiff.read(spark, str(tmp_path / name)).collect()


def test_mosaic_of_files(spark, tmp_path):
    first, second = np.full((4, 4), 1.0, np.float32), np.full((4, 4), 2.0, np.float32)
    first[1, 3] = -1
    (tmp_path / "a.tif").write_bytes(geotiff.tiff_bytes(first, 0.0, 4.0, 1.0, -1.0, 4326, block=16))
    (tmp_path / "b.tif").write_bytes(geotiff.tiff_bytes(second, 3.0, 4.0, 1.0, -1.0, 4326, block=16))
    got = {(r["row"], r["col"]): r["z"] for r in raster.mosaic(geotiff.on_grid(geotiff.read(spark, str(tmp_path)), 0.0, 4.0, 1.0)).collect()}
    assert len(got) == 4 * 7 and got[0, 3] == 1.0 and got[1, 3] == 2.0 and got[0, 4] == 2.0


def decoded_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    width, height = struct.unpack(">II", data[16:24])
    at, packed = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        packed += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 4 * width + 1)
    assert set(lines[:, 0]) == {2}
    return np.cumsum(lines[:, 1:], axis=0, dtype=np.uint8).reshape(height, width, 4)


def test_overlays(spark, tmp_path):
    cells = spark.range(30).selectExpr("int(id) as row", "int(id * 7 % 20) as col", "2 as red", "132 as green", "199 as blue", "int(75 + id) as alpha")
    geotiff.write_overlay(cells, str(tmp_path / "o"), size=20)
    seen = {}
    for br in (0, 1):
        image = decoded_png((tmp_path / "o" / f"r{br}_c0.png").read_bytes())
        seen |= {(int(i) + 20 * br, int(j)): tuple(image[i, j].tolist()) for i, j in zip(*np.nonzero(image[:, :, 3]))}
    assert seen == {(k, k * 7 % 20): (2, 132, 199, 75 + k) for k in range(30)}


def test_nothing_is_visible_of_a_write_that_fails(spark, tmp_path):
    cells = spark.range(2000).selectExpr("int(id) as row", "0 as col", "if(id = 1999, raise_error('broken'), double(id)) as value")
    with pytest.raises(Exception, match="broken"):
        geotiff.write(cells, str(tmp_path / "out"), 0, 0, 1, size=100)
    assert not list((tmp_path / "out").rglob("*.tif"))
    good = cells.filter("row < 100")
    geotiff.write(good, str(tmp_path / "out"), 0, 0, 1, size=100)
    with pytest.raises(Exception, match="has files of these names"):
        geotiff.write(good, str(tmp_path / "out"), 0, 0, 1, size=100)
    geotiff.write(cells.filter("row < 250"), str(tmp_path / "out"), 0, 0, 1, size=100, mode="overwrite")
    assert len(list((tmp_path / "out").rglob("*"))) == 3
