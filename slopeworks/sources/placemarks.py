"""KML and KMZ files as a format of Spark: ``spark.read.format("placemarks").load(path)``.

A file, zipped or not, is a partition; its XML is parsed as a stream, one placemark in memory at a time. Option ``variant``:

* ``audit`` (default): attributes are ``Data`` elements with a ``value``; the first outer boundary of a polygon is its shell.
* ``serving``: ``SimpleData`` and text without a ``value`` count too; boundaries are children of the polygon, and the last outer one
  is its shell.

Rings of fewer than four points are left out, and polygons without a shell. Malformed XML, a coordinate that is no number, and an
archive without a KML file are errors. Writing gives a KMZ file for each partition.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slopeworks.sources.files import FileWriter, listing, opened

_RING = "array<struct<x:double,y:double>>"
SCHEMA = f"path string, number long, attributes map<string,string>, parts array<struct<shell:{_RING},holes:array<{_RING}>>>"


def _tag(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _points(text: str | None) -> list[tuple[float, float]]:
    pairs = (item.split(",") for item in (text or "").split())
    return [(float(p[0]), float(p[1])) for p in pairs if len(p) > 1]


def _ring(boundary: ET.Element) -> list[tuple[float, float]]:
    found = next((n for n in boundary.iter() if _tag(n) == "coordinates"), None)
    return _points(found.text) if found is not None else []


def attributes(mark: ET.Element, serving: bool) -> dict[str, str]:
    found = {}
    for node in mark.iter():
        if _tag(node) in (("Data", "SimpleData") if serving else ("Data",)) and node.get("name"):
            value = next((c.text for c in node if _tag(c) == "value"), node.text if serving else "")
            found[node.get("name", "").strip()] = (value or "").strip()
    return found


def polygons(mark: ET.Element, serving: bool) -> list[tuple[list, list]]:
    found = []
    for node in mark.iter():
        if _tag(node) != "Polygon":
            continue
        outer = [c for c in (node if serving else node.iter()) if _tag(c) == "outerBoundaryIs"]
        shells = [r for r in map(_ring, outer if serving else outer[:1]) if len(r) >= 4]
        holes = [r for c in node if _tag(c) == "innerBoundaryIs" for r in [_ring(c)] if len(r) >= 4]
        if shells:
            found.append((shells[-1], holes))
    return found


def placemarks(stream: BinaryIO, serving: bool) -> Iterator[tuple[dict, list]]:
    """Each placemark's attributes and polygons; what has been read is let go."""
    open_elements: list[ET.Element] = []
    for event, element in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            open_elements.append(element)
            continue
        open_elements.pop()
        if _tag(element) == "Placemark":
            yield attributes(element, serving), polygons(element, serving)
            if open_elements:
                open_elements[-1].remove(element)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PlacemarkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.serving = options["path"], options.get("variant", "audit") == "serving"

    def partitions(self) -> list[_File]:
        return [_File(p) for p in listing(self.path, (".kml", ".kmz"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        point = lambda p: {"x": p[0], "y": p[1]}
        with opened(partition.path) as file:
            zipped = file.read(4) == b"PK\x03\x04"
            file.seek(0)
            if zipped:
                archive = zipfile.ZipFile(file)
                name = next((n for n in archive.namelist() if n.lower().endswith(".kml")), None)
                if name is None:
                    raise ValueError(f"no KML file in {partition.path}")
            try:
                for number, (found, parts) in enumerate(placemarks(archive.open(name) if zipped else file, self.serving)):
                    rings = [{"shell": [point(p) for p in shell], "holes": [[point(p) for p in h] for h in holes]} for shell, holes in parts]
                    yield partition.path, number, found, rings
            except ET.ParseError as e:
                raise ValueError(f"malformed XML in {partition.path}: {e}") from e


class PlacemarkWriter(FileWriter):
    """Rows with ``attributes`` and ``parts`` as one KMZ file for each partition that has any."""

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        ring = lambda r: f"<LinearRing><coordinates>{' '.join(f'{p['x']!r},{p['y']!r}' for p in r)}</coordinates></LinearRing>"
        packed, count = io.BytesIO(), 0
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("doc.kml", "w", force_zip64=True) as out:
            out.write(b'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>')
            for row in (r for batch in batches for r in batch.select(["attributes", "parts"]).to_pylist()):
                data = "".join(f"<Data name={quoteattr(k)}><value>{escape(v or '')}</value></Data>" for k, v in row["attributes"] or ())
                shapes = "".join(
                    f"<Polygon><outerBoundaryIs>{ring(p['shell'])}</outerBoundaryIs>{''.join(f'<innerBoundaryIs>{ring(h)}</innerBoundaryIs>' for h in p['holes'] or ())}</Polygon>" for p in row["parts"] or ()
                )
                out.write(f"<Placemark><ExtendedData>{data}</ExtendedData><MultiGeometry>{shapes}</MultiGeometry></Placemark>".encode())
                count += 1
            out.write(b"</Document></kml>")
        if count:
            yield f"{uuid.uuid4().hex}.kmz", packed.getvalue()


class Placemarks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placemarks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlacemarkReader:
        return PlacemarkReader(self.options)

    def writer(self, schema, overwrite: bool) -> PlacemarkWriter:
        return PlacemarkWriter(self.options["path"], overwrite)
