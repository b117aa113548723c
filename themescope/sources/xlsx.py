"""Workbooks: XLSX is zip and XML, so the standard library reads and writes it.

``spark.read.format("xlsx")`` and ``df.write.format("xlsx")``, once ``register()`` has run: a partition reads one sheet of
one file, row by row; a writing task deflates its rows as a piece of the sheet, and the commit puts the pieces
together as they are, with their checksums combined, so that no row passes the driver. Paths are those of the file systems
that pyarrow knows. ``read_xlsx()`` reads through Spark's binary reader instead, from any store that Spark reads.
The format allows 1,048,576 rows a sheet; beyond it, write Parquet.

Numbers with a date format become timestamps without a time zone, those of a time of day alone text.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DateType, MapType, NumericType, StructType, TimestampNTZType, TimestampType, VariantType

#: Rows of a sheet, its header included.
MOST_ROWS = 1_048_576
# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

_control = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_of(place: str) -> int:
    """Number from 0 of the column in a place such as AB12."""
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def place_of(column: int) -> str:
    name = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        name = chr(65 + rest) + name
    return name


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


# Numbers of the built-in formats that show dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)}
#: What a format doesn't mean as a sign: quoted and escaped characters, colours and conditions.
_unmeant = re.compile(r'"[^"]*"|\\.|_.|\[[^\]]*\]')


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{MAIN}numFmt")}
    shown = lambda k: re.search("[dmyhs]", _unmeant.sub("", own[k]), re.IGNORECASE) is not None if k in own else k in DATE_FORMATS
    styles = root.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else ()) if shown(int(x.get("numFmtId") or 0))}


def moment(serial: float, from_1904: bool = False) -> dt.datetime | str:
    """The time of a serial number of days; one below 1 is a time of day, as text. The first calendar has a 29 February 1900."""
    if 0 <= serial < 1:
        return str((dt.datetime(2000, 1, 1) + dt.timedelta(milliseconds=round(serial * 86_400_000))).time())
    base = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 31) if serial < 60 else dt.datetime(1899, 12, 30)
    return base + dt.timedelta(days=int(serial // 1), milliseconds=round(serial % 1 * 86_400_000))


def serial_of(t: dt.datetime) -> float:
    days = (t - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
    return days if days >= 61 else days - 1


def sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Parts of the sheets by name, in their order."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    named = {s.get("name"): targets[s.get(f"{LINKS}id")] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    return {name: t if t.startswith("xl/") else f"xl/{t}" for name, t in named.items()}


def read_sheet(data: bytes | io.IOBase, sheet: str) -> Iterator[list]:
    """Rows of a sheet as lists of str, float, bool, datetime or None."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        shared = [_texts(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        named = sheets(z)
        if sheet not in named:
            raise ValueError(f"no sheet {sheet!r}, only {sorted(named)}")
        dates = date_styles(z)
        whole = next(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}workbookPr"), None)
        late = whole is not None and whole.get("date1904") in ("1", "true")
        with z.open(named[sheet]) as f:
            rows = None
            for event, row in ET.iterparse(f, ("start", "end")):
                if row.tag == f"{MAIN}sheetData" and event == "start":
                    rows = row
                if row.tag != f"{MAIN}row" or event == "start":
                    continue
                out: list = []
                for cell in row.iter(f"{MAIN}c"):
                    at = column_of(cell.get("r")) if cell.get("r") else len(out)
                    out.extend([None] * (at + 1 - len(out)))
                    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        out[at] = _texts(cell)
                    elif value is not None and value.text is not None:
                        v = value.text
                        if kind == "n" and int(cell.get("s") or 0) in dates:
                            out[at] = moment(float(v), late)
                        elif kind == "d":
                            out[at] = dt.datetime.fromisoformat(v).replace(tzinfo=None)
                        else:
                            out[at] = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else float(v) if kind == "n" else None if kind == "e" else v
                if rows is not None:
                    rows.clear()
                yield out


def _kind(values: list) -> str:
    """The type of a column, from its values that aren't None."""
    found = {type(v) for v in values if v is not None}
    if found == {bool}:
        return "boolean"
    if found == {dt.datetime}:
        return "timestamp_ntz"
    if found == {float}:
        return "long" if all(v is None or v == int(v) for v in values) else "double"
    return "string"


def _as_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dt.datetime):
        return str(v)
    return str(int(v)) if v == int(v) else repr(v)


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}


def schema_of(found: dict[str, set[str]]) -> str:
    """A schema from the kinds that each column has somewhere: one kind as it is, whole and other numbers double, else text."""
    return ", ".join(f"`{n}` " + (next(iter(k)) if len(k) == 1 else "double" if k == {"long", "double"} else "string") for n, k in found.items())


def batches_of(rows: Iterator[list], schema: StructType, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The rows behind a header, in the columns of ``schema``: by name, null where the sheet has none, null for what a column can't hold."""
    place = {str(n): k for k, n in enumerate(next(rows, [])) if n is not None}
    at = [(place.get(f.name), KINDS.get(f.dataType.simpleString(), pa.string())) for f in schema.fields]

    def fit(v: object, kind: pa.DataType) -> object:
        if kind == pa.string() or v is None:
            return _as_text(v)
        if kind in (pa.int64(), pa.int32()):
            return int(v) if isinstance(v, float) and v == int(v) else None
        good = {pa.float64(): float, pa.bool_(): bool}.get(kind, dt.datetime)
        return v if isinstance(v, good) else None

    def batch(held: list[list]) -> pa.RecordBatch:
        columns = [pa.array([fit(r[k], kind) if k is not None and k < len(r) else None for r in held], kind) for k, kind in at]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    held: list[list] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def read_xlsx(spark: SparkSession, path: str, sheet: str = "data", schema: str | None = None) -> DataFrame:
    """The sheet of every workbook under ``path``, by the header line. Without a schema, the types are those that all files' columns have.

    Files may differ in the order of columns; a column that a file lacks is null there.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = read_sheet(content.as_py(), sheet)
                head = next(rows, [])
                values = list(rows)
                found = [(k, str(name), _kind([r[k] if k < len(r) else None for r in values])) for k, name in enumerate(head) if name is not None]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int32(), pa.string(), pa.string()), strict=True)], names=["at", "name", "kind"])

    if schema is None:
        seen: dict[str, set[str]] = {}
        for r in sorted(files.mapInArrow(shapes, "at int, name string, kind string").distinct().collect()):
            seen.setdefault(r.name, set()).add(r.kind)
        if not seen:
            raise ValueError(f"no header in sheet {sheet!r} under {path}")
        schema = schema_of(seen)
    wanted = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from batches_of(read_sheet(content.as_py(), sheet), wanted)

    return files.mapInArrow(run, wanted)


# The parts of a workbook with one sheet.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _cell(v: object) -> str:
    """A cell; an empty one keeps its place, so cells need no coordinates, and pieces don't know their first row."""
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.datetime):
        return f'<c s="1"><v>{serial_of(v.replace(tzinfo=None))!r}</v></c>' if v.year >= 1900 else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_control.sub("", str(v)))}</t></is></c>'


def _row(values: list) -> bytes:
    return f"<row>{''.join(map(_cell, values))}</row>".encode()


_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Of two polynomials over bits modulo that of CRC-32, the highest bit being the constant."""
    out = 0
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = a >> 1 ^ (_POLYNOMIAL if a & 1 else 0)
    return out


def combined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces from theirs, the second being ``length`` bytes: the first is shifted by as many bits."""
    shift, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            shift = _product(shift, square)
        square, n = _product(square, square), n >> 1
    return _product(first, shift) ^ second


@dataclass
class Piece:
    """Deflated bytes that other pieces may follow, with the checksum and length of what they hold."""

    crc: int = 0
    size: int = 0
    packed: int = 0
    rows: int = 0

    def follow(self, other: Piece) -> None:
        self.crc = combined_crc(self.crc, other.crc, other.size)
        self.size, self.packed, self.rows = self.size + other.size, self.packed + other.packed, self.rows + other.rows


class Deflater:
    """Deflates what is given to it into ``out``; the end is a flush, not an end of the stream."""

    def __init__(self, out: io.IOBase):
        self.out, self.piece, self.packer = out, Piece(), zlib.compressobj(6, zlib.DEFLATED, -15)

    def add(self, data: bytes, rows: int = 0) -> None:
        self.piece.crc, self.piece.size, self.piece.rows = zlib.crc32(data, self.piece.crc), self.piece.size + len(data), self.piece.rows + rows
        self._put(self.packer.compress(data))

    def end(self) -> Piece:
        self._put(self.packer.flush(zlib.Z_FULL_FLUSH))
        return self.piece

    def _put(self, data: bytes) -> None:
        self.piece.packed += len(data)
        self.out.write(data)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str
    piece: Piece


class SheetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sheet: str, schema: StructType):
        self.path, self.sheet, self.names = path, sheet, schema.names
        self.folder = f"{path.rstrip('/')}.pieces-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = store_of(self.folder)
        store.create_dir(folder)
        name = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        with store.open_output_stream(name) as out:
            deflater = Deflater(out)
            for batch in iterator:
                columns = [c.to_pylist() for c in batch.columns]
                for a in range(0, batch.num_rows, 500):
                    part = list(zip(*(c[a : a + 500] for c in columns), strict=True))
                    deflater.add(b"".join(_row(list(r)) for r in part), len(part))
            return Written(context.partitionId(), name, deflater.end())

    def commit(self, messages: list[Written | None]) -> None:
        written = sorted((m for m in messages if m), key=lambda m: m.part)
        store, target = store_of(self.path)
        rows = sum(m.piece.rows for m in written)
        try:
            if rows >= MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows, not {rows}")
            # head and foot are pieces of their own
            head, foot = io.BytesIO(), io.BytesIO()
            start, end = Deflater(head), Deflater(foot)
            start.add(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode() + _row(self.names))
            end.add(b"</sheetData></worksheet>")
            whole = start.end()
            for m in written:
                whole.follow(m.piece)
            whole.follow(end.end())
            last = b"\x03\x00"  # an empty last block
            info = zipfile.ZipInfo("xl/worksheets/sheet1.xml")
            info.compress_type, info.CRC, info.file_size, info.compress_size = zipfile.ZIP_DEFLATED, whole.crc, whole.size, whole.packed + len(last)
            made = f"{target}.{uuid.uuid4().hex}"
            with store.open_output_stream(made) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, part in PARTS.items():
                    z.writestr(name, part.replace("{sheet}", escape(self.sheet, {'"': "&quot;"})))
                # the sheet's bytes are deflated already: they go behind a header of their own
                info.header_offset = z.fp.tell()
                z.fp.write(info.FileHeader(zip64=info.file_size >= 1 << 31))
                z.fp.write(head.getvalue())
                for m in written:
                    with store.open_input_stream(m.path) as piece:
                        while data := piece.read(1 << 20):
                            z.fp.write(data)
                z.fp.write(foot.getvalue() + last)
                z.filelist.append(info)
                z.NameToInfo[info.filename] = info
                z.start_dir, z._didModify = z.fp.tell(), True
            store.move(made, target)
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = store_of(self.folder)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, schema: StructType | None):
        self.path, self.sheet, self.schema = path, sheet, schema

    def files(self) -> list[str]:
        store, path = store_of(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [path]
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.lower().endswith(".xlsx"))

    def partitions(self) -> list[Sheet]:
        """One sheet of one file each; ``*`` stands for all sheets of a file."""
        store, _ = store_of(self.path)
        found = []
        for path in self.files():
            if self.sheet != "*":
                found.append(Sheet(path, self.sheet))
                continue
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                found += [Sheet(path, name) for name in sheets(z)]
        return found

    def rows(self, part: Sheet) -> Iterator[list]:
        store, _ = store_of(self.path)
        with store.open_input_file(part.path) as f:
            yield from read_sheet(f, part.sheet)

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        yield from batches_of(self.rows(partition), self.schema)


class Workbooks(DataSource):
    """Options: path, a workbook or a folder of them; sheet ("data", or * for all). A given schema selects columns by name;
    without one, types are found by reading all rows first, row by row.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _reader(self, schema: StructType | None) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("sheet", "data"), schema)

    def schema(self) -> str:
        reader, seen = self._reader(None), {}
        for part in reader.partitions():
            rows = reader.rows(part)
            head = [(k, str(n)) for k, n in enumerate(next(rows, [])) if n is not None]
            found: dict[str, set] = {n: set() for _, n in head}
            for r in rows:
                for k, n in head:
                    if k < len(r) and r[k] is not None:
                        found[n].add(_kind([r[k]]))
            for n, kinds in found.items():
                seen.setdefault(n, set()).update(kinds)
        if not seen:
            raise ValueError(f"no header in sheet {self.options.get('sheet', 'data')!r} under {self.options['path']}")
        return schema_of({n: kinds or {"string"} for n, kinds in seen.items()})

    def reader(self, schema: StructType) -> SheetReader:
        return self._reader(schema)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], self.options.get("sheet", "data"), schema)


def register(spark: SparkSession) -> None:
    """Makes ``xlsx`` a format of the session."""
    spark.dataSource.register(Workbooks)


def write_xlsx(df: DataFrame, path: str, sheet: str = "data") -> None:
    """One workbook at ``path``, rows in the order of their partitions; nested columns become JSON, other kinds than numbers, flags and times text.

    More rows than a sheet holds are an error, after which nothing is left.
    """
    nested = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))}
    times = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))}
    plain = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if f.name not in nested | times and not isinstance(f.dataType, (NumericType, BooleanType))}
    register(df.sparkSession)
    df.withColumns(nested | times | plain).write.format("xlsx").option("sheet", sheet).mode("overwrite").save(path)


def csv_to_xlsx(spark: SparkSession, source: str, path: str) -> None:
    from themescope.sources.tables import read_csv

    write_xlsx(read_csv(spark, source), path)
