"""XLSX workbooks, read and written in parts.

Reading: a data source whose partitions are ranges of rows of a sheet. A task streams a sheet's XML, skips to its range and
looks up the shared strings that its range needs, so it holds no more than a range. Writing: tasks deflate the XML of their
rows; deflated pieces that end at a byte follow one another, and their CRCs combine, so the process that writes the file
only copies compressed bytes.
"""

from __future__ import annotations

import html
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# ---- reading ------------------------------------------------------------------------------------------------------

ROW_SCHEMA = "file string, sheet string, sheet_no int, row long, cells array<string>"
_CHUNK = 1 << 18


def opened(path: str):
    """A seekable file; paths with a scheme go by Arrow's file systems, so only what is read is fetched."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    if "://" in path:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        return store.open_input_file(at)
    return open(path, "rb")


def _listed(path: str) -> list[str]:
    """The .xlsx files of a path: one file, a folder with all below it, or several, with commas between them."""
    from pyarrow import fs

    out = []
    for p in filter(None, (x.strip() for x in path.split(","))):
        local = re.sub("^file:/*", "/", p) if p.startswith("file:") else p
        store, at = fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            scheme = local.split("://")[0] + "://" if "://" in local else ""
            out += [scheme + f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx")]
        elif info.type == fs.FileType.File:
            out.append(local)
        else:
            raise FileNotFoundError(p)
    return sorted(out)


def _elements(stream, tag: str) -> Iterator[bytes]:
    """The elements ``tag`` of an XML stream, each as its bytes; they must not nest."""
    whole = re.compile(rb"<((?:\w+:)?)" + tag.encode() + rb"(?:\s[^>]*)?(?:/>|(?<!/)>.*?</\1" + tag.encode() + rb"\s*>)", re.S)
    rest = b""
    while chunk := stream.read(_CHUNK):
        rest += chunk
        end = 0
        for m in whole.finditer(rest):
            yield m[0]
            end = m.end()
        rest = rest[end:]


_PREFIX = re.compile(rb"<(/?)\w+:")


def _parsed(element: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(_PREFIX.sub(rb"<\1", element) if b":" in element[:16] else element)


def _text(e: ElementTree.Element) -> str:
    """All text runs of an element, phonetic readings left out."""
    return "".join(t.text or "" for c in e if c.tag != "rPh" for t in ([c] if c.tag == "t" else c.iter("t")))


_FIRST_ROW = re.compile(rb'\sr="(\d+)"')


class Range(NamedTuple):
    file: str
    sheet: str
    sheet_no: int
    part: str
    first: int
    last: int | None


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order; by number where the archive has no list of them."""
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
        parts = [m for m in (re.fullmatch(r"xl/worksheets/(sheet(\d+))\.xml", n) for n in z.namelist()) if m]
        return [(m[1], m[0]) for m in sorted(parts, key=lambda m: int(m[2]))]
    book, links = (ElementTree.fromstring(z.read(n)) for n in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target", "") for r in links}
    local = lambda tag: tag.rsplit("}", 1)[-1]
    out = []
    for s in (e for e in book.iter() if local(e.tag) == "sheet"):
        at = target.get(next((v for k, v in s.attrib.items() if local(k) == "id"), ""), "")
        part = at.lstrip("/") if at.startswith("/") else f"xl/{at}"
        if part in z.namelist() and "worksheets/" in part:
            out.append((s.get("name", ""), part))
    return out


def _ranges(path: str, rows: int) -> list[Range]:
    """Ranges of about ``rows`` rows: by a sheet's dimension or, where it has none, by its size; the last one is open."""
    out = []
    with opened(path) as f, zipfile.ZipFile(f) as z:
        for n, (name, part) in enumerate(sheets_of(z)):
            with z.open(part) as s:
                head = s.read(4096)
            m = re.search(rb'<(?:\w+:)?dimension\s+ref="[A-Z]+\d+:[A-Z]+(\d+)"', head)
            total = int(m[1]) if m else z.getinfo(part).file_size // 200
            firsts = list(range(1, max(total, 1) + 1, rows))
            out += [Range(path, name, n, part, a, (b - 1) if b else None) for a, b in zip(firsts, [*firsts[1:], None], strict=True)]
    return out


def rows_of(r: Range) -> Iterator[tuple[int, list[str]]]:
    """(row, cells) of a range; rows without cells are left out, cells without a value are empty."""
    held: list[tuple[int, dict[int, str | int]]] = []
    wanted: set[int] = set()
    with opened(r.file) as f, zipfile.ZipFile(f) as z:
        with z.open(r.part) as s:
            n = 0
            for raw in _elements(s, "row"):
                m = _FIRST_ROW.search(raw[: raw.find(b">")])
                n = int(m[1]) if m else n + 1
                if n < r.first:
                    continue
                if r.last is not None and n > r.last:
                    break
                cells: dict[int, str | int] = {}
                at = -1
                for c in _parsed(raw):
                    ref = re.match("[A-Z]+", c.get("r") or "")
                    at = _column(ref[0]) if ref else at + 1
                    kind, v = c.get("t"), next((e for e in c if e.tag == "v"), None)
                    if kind == "inlineStr":
                        cells[at] = "".join(_text(e) for e in c if e.tag == "is")
                    elif v is not None and v.text:
                        cells[at] = int(v.text) if kind == "s" else v.text
                        if kind == "s":
                            wanted.add(int(v.text))
                if cells:
                    held.append((n, cells))
        strings: dict[int, str] = {}
        if wanted:
            with z.open("xl/sharedStrings.xml") as s:
                for i, raw in enumerate(_elements(s, "si")):
                    if i in wanted:
                        strings[i] = _text(_parsed(raw))
                        if len(strings) == len(wanted):
                            break
    for n, cells in held:
        yield n, [strings.get(x, "") if isinstance(x := cells.get(i, ""), int) else x for i in range(max(cells) + 1)]


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


class _RangePartition(InputPartition):
    def __init__(self, range_: Range):
        super().__init__(tuple(range_))


class _RowReader(DataSourceReader):
    def __init__(self, path: str, rows: int, first_only: bool):
        self.path, self.rows, self.first_only = path, rows, first_only

    def partitions(self) -> list[_RangePartition]:
        found = [r for p in _listed(self.path) for r in _ranges(p, self.rows) if not self.first_only or r.sheet_no == 0]
        return [_RangePartition(r) for r in found] or [_RangePartition(Range("", "", 0, "", 1, 0))]

    def read(self, partition: _RangePartition) -> Iterator[tuple]:
        r = Range(*partition.value)
        if r.file:
            for n, cells in rows_of(r):
                yield r.file, r.sheet, r.sheet_no, n, cells


class WorkbookRows(DataSource):
    """Options: ``path``, ``rows`` of a task (20,000), ``sheets`` (all, first)."""

    @classmethod
    def name(cls) -> str:
        return "workbook_rows"

    def schema(self) -> str:
        return ROW_SCHEMA

    def reader(self, schema) -> _RowReader:
        return _RowReader(self.options["path"], int(self.options.get("rows", "20000")), self.options.get("sheets", "all") == "first")


def read_rows(spark: SparkSession, path: str, rows: int = 20_000, sheets: str = "all") -> DataFrame:
    """(file, sheet, sheet_no, row, cells) of all workbooks at ``path``, a task for each ``rows`` rows of a sheet."""
    spark.dataSource.register(WorkbookRows)
    return spark.read.format("workbook_rows").option("path", path).option("rows", str(rows)).option("sheets", sheets).load()


def read_cells(spark: SparkSession, path: str, rows: int = 20_000) -> DataFrame:
    """(file, sheet, row, column, value) of every cell that is not empty."""
    cells = read_rows(spark, path, rows).select("file", "sheet", "row", F.posexplode("cells").alias("column", "value"))
    return cells.where("value <> ''")


# ---- writing ------------------------------------------------------------------------------------------------------

#: Rows of a sheet, header included, that the format allows.
SHEET_ROWS = 1_048_576
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _gf2_times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_of_both(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings one after the other, of their CRCs and the second one's length: the first is moved on by so many zero bytes, by squaring."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [_gf2_times(step, x) for x in step]  # two, four, eight: a byte
    while length:
        if length & 1:
            a = _gf2_times(step, a)
        step = [_gf2_times(step, x) for x in step]
        length >>= 1
    return a ^ b


def deflated(data: bytes) -> bytes:
    """A piece of a deflate stream that ends at a byte and is not the last."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_FULL_FLUSH)


#: The last piece of any deflate stream: an empty block.
_END = b"\x03\x00"


class _Zip:
    """A zip archive written front to back, of members whose compressed bytes come from elsewhere. Sizes may go beyond 4 GB."""

    def __init__(self, out: io.BufferedIOBase):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, crc: int, size: int, packed: int, pieces: Iterable[bytes]) -> None:
        raw, start = name.encode(), self.at
        big = max(size, packed) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, packed) if big else b""
        sizes = (0xFFFFFFFF, 0xFFFFFFFF) if big else (packed, size)
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45 if big else 20, 0x800, 8, 0, 0x21, crc, *sizes, len(raw), len(extra)) + raw + extra)
        before = self.at
        for p in pieces:
            self._put(p)
        if self.at - before != packed:
            raise ValueError(f"{name}: {self.at - before} bytes, not {packed}")
        self.entries.append((raw, crc, size, packed, start))

    def text(self, name: str, text: str) -> None:
        data = text.encode()
        piece = deflated(data) + _END
        self.member(name, zlib.crc32(data), len(data), len(piece), [piece])

    def close(self) -> None:
        start = self.at
        for raw, crc, size, packed, offset in self.entries:
            big = max(size, packed, offset) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, offset) if big else b""
            numbers = (0xFFFFFFFF,) * 3 if big else (packed, size, offset)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45 if big else 20, 0x800, 8, 0, 0x21, crc, *numbers[:2], len(raw), len(extra), 0, 0, 0, 0, numbers[2]) + raw + extra)
        n, length = len(self.entries), self.at - start
        if start + length >= 0xFFFFFFFF or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))


def escaped(c: Column) -> Column:
    """As XML text, without the control characters that XML has no form for."""
    return F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _row_xml(df: DataFrame) -> Column:
    text = [F.array_join(c, ",") if isinstance(df.schema[c].dataType, T.ArrayType) else F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c).cast("string") for c in df.columns]
    cell = lambda c: F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), escaped(c), F.lit("</t></is></c>"))
    return F.concat(F.lit("<row>"), *[cell(F.coalesce(t, F.lit(""))) for t in text], F.lit("</row>"))


_PIECE = "sheet int, part long, seq int, rows int, size long, crc long, data binary"


def _pieces(df: DataFrame, sheet: int, most: int) -> DataFrame:
    """The rows of ``df``, in their order, as deflated pieces of at most ``most`` rows."""

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = 0, 0, []

        def out(rows: list[str]) -> pa.RecordBatch:
            data = "".join(rows).encode()
            return pa.RecordBatch.from_pylist([{"sheet": sheet, "part": part, "seq": seq, "rows": len(rows), "size": len(data), "crc": zlib.crc32(data), "data": deflated(data)}], schema=kind)

        kind = pa.schema([("sheet", pa.int32()), ("part", pa.int64()), ("seq", pa.int32()), ("rows", pa.int32()), ("size", pa.int64()), ("crc", pa.int64()), ("data", pa.binary())])
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
            held += b.column(1).to_pylist()
            while len(held) >= most:
                yield out(held[:most])
                held, seq = held[most:], seq + 1
        if held:
            yield out(held)

    return df.select(F.spark_partition_id().cast("long"), _row_xml(df)).mapInArrow(deflate, _PIECE)


def _sheet_name(name: str, part: int) -> str:
    return name[:28] if part == 1 else f"{name[:24]} {part}"


def _parted(pieces: list[tuple[int, int, int, int]], most: int) -> list[list[tuple[int, int, int, int]]]:
    """Pieces (rows, size, crc, packed size) in runs of at most ``most`` rows; one run at least."""
    out, rows = [[]], 0
    for p in pieces:
        if out[-1] and rows + p[0] > most:
            out.append([])
            rows = 0
        out[-1].append(p)
        rows += p[0]
    return out


def write_sheets(sheets: dict[str, DataFrame], path: str, sink: io.RawIOBase, sheet_rows: int = SHEET_ROWS, piece_rows: int = 10_000) -> list[str]:
    """One workbook with ``sheets`` at ``sink``; the names of its sheets. Longer ones than ``sheet_rows`` (header included) go on in further ones.

    Pieces lie in a folder beside ``path`` until the file is done. The driver holds a row of numbers for each piece and copies
    compressed bytes, one piece at a time.
    """
    spark = next(iter(sheets.values())).sparkSession
    folder = f"{path}.pieces-{uuid.uuid4().hex}"
    for n, df in enumerate(sheets.values()):
        _pieces(df, n, min(piece_rows, sheet_rows - 1)).write.mode("append").parquet(folder)
    made = spark.read.schema(_PIECE).parquet(folder)
    facts = made.select("sheet", "part", "seq", "rows", "size", "crc", F.octet_length("data").alias("packed")).orderBy("sheet", "part", "seq").collect()
    data = made.select("data").where("data IS NOT NULL").orderBy(made["sheet"], made["part"], made["seq"]).toLocalIterator(prefetchPartitions=True)
    written: list[str] = []
    with io.BufferedWriter(sink, 1 << 20) as out:
        z = _Zip(out)
        for n, (name, df) in enumerate(sheets.items()):
            title = "<row>" + "".join(f'<c t="inlineStr"><is><t>{html.escape(c)}</t></is></c>' for c in df.columns) + "</row>"
            own = [(r["rows"], r["size"], r["crc"], r["packed"]) for r in facts if r["sheet"] == n]
            for part, run in enumerate(_parted(own, sheet_rows - 1), 1):
                written.append(_sheet_name(name, part))
                total = 1 + sum(p[0] for p in run)
                head = f'{_HEAD}<worksheet xmlns="{_MAIN}"><dimension ref="A1:{_letters(len(df.columns))}{total}"/><sheetData>{title}'.encode()
                tail = b"</sheetData></worksheet>"
                crc, size, first, last = zlib.crc32(head), len(head), deflated(head), deflated(tail) + _END
                for _, length, c, _ in [*run, (0, len(tail), zlib.crc32(tail), 0)]:
                    crc, size = crc32_of_both(crc, c, length), size + length
                packed = len(first) + sum(p[3] for p in run) + len(last)
                z.member(f"xl/worksheets/sheet{len(written)}.xml", crc, size, packed, _between(first, (bytes(next(data)["data"]) for _ in run), last))
        z.text("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{html.escape(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(written, 1)) + "</sheets></workbook>")
        z.text("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(written) + 1)) + "</Relationships>")
        z.text("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.text("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KINDS}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KINDS}.worksheet+xml"/>' for i in range(1, len(written) + 1)) + "</Types>")
        z.close()
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return written


def _between(first: bytes, pieces: Iterable[bytes], last: bytes) -> Iterator[bytes]:
    yield first
    yield from pieces
    yield last


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out or "A"
