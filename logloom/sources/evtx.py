"""Native event-log files: their 64 KB chunks are rows, each chunk is decoded by itself, and the XML of its records is parsed like any other.

A file is read by Spark's binary reader (any store that Spark reads, files up to 2 GB) and cut into chunks in the JVM; the chunks
are dealt to tasks, so one large file is decoded by many. Only the decoding of a chunk is Python: binary XML with its
templates, by the public description of the format, to XML text. Columns, data maps and attachments come from sources.xml_events.

Damage stays where it is: a chunk whose checksums are wrong and a record that can't be decoded become rows with a problem
instead of XML; read_evtx leaves them out, evtx_records shows them. A file that isn't one is a problem of its own.
"""

from __future__ import annotations

import struct
import zlib
from datetime import datetime, timedelta
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .xml_events import parse_xml

HEADER, CHUNK, RECORDS = 4096, 65536, 512
FILE_MARK, CHUNK_MARK, RECORD_MARK = b"ElfFile\0", b"ElfChnk\0", b"**\0\0"
ROWS = "path string, chunk int, record_id bigint, xml_data string, problem string"


# ------------------------------------------------------------------------------------- values


def _sid(data: bytes) -> str:
    parts = [data[0], int.from_bytes(data[2:8], "big"), *struct.unpack_from(f"<{data[1]}I", data, 8)]
    return "S-" + "-".join(map(str, parts))


def _guid(data: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", data)
    return f"{{{a:08X}-{b:04X}-{c:04X}-{data[8:10].hex().upper()}-{data[10:16].hex().upper()}}}"


def _filetime(data: bytes) -> str:
    ticks = int.from_bytes(data[:8], "little")
    moment = datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)
    return f"{moment:%Y-%m-%dT%H:%M:%S}.{moment.microsecond:06d}{ticks % 10}Z"


def _systemtime(data: bytes) -> str:
    y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", data)
    return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"


def _number(form: str):
    return lambda data: str(struct.unpack_from(form, data)[0])


def _utf16(data: bytes) -> str:
    return data.decode("utf-16-le", "replace").rstrip("\0")


#: Fixed codes of value types and their texts.
VALUES = {
    0x00: lambda d: "", 0x01: _utf16, 0x02: lambda d: d.decode("cp1252", "replace").rstrip("\0"), 0x03: _number("<b"), 0x04: _number("<B"), 0x05: _number("<h"), 0x06: _number("<H"), 0x07: _number("<i"), 0x08: _number("<I"),
    0x09: _number("<q"), 0x0A: _number("<Q"), 0x0B: _number("<f"), 0x0C: _number("<d"), 0x0D: lambda d: "true" if any(d) else "false", 0x0E: lambda d: d.hex().upper(), 0x0F: _guid,
    0x10: lambda d: hex(int.from_bytes(d, "little")), 0x11: _filetime, 0x12: _systemtime, 0x13: _sid, 0x14: lambda d: hex(int.from_bytes(d, "little")), 0x15: lambda d: hex(int.from_bytes(d, "little")),
}
#: Bytes of an item of an array, for types of fixed size.
SIZES = {0x03: 1, 0x04: 1, 0x05: 2, 0x06: 2, 0x07: 4, 0x08: 4, 0x09: 8, 0x0A: 8, 0x0B: 4, 0x0C: 8, 0x0D: 4, 0x0F: 16, 0x11: 8, 0x12: 16, 0x14: 4, 0x15: 8}
ARRAY, BINARY_XML = 0x80, 0x21


# ------------------------------------------------------------------------------------- chunks


class Chunk:
    """The binary XML of one chunk. Names and templates stand where they are first used; later uses point there."""

    def __init__(self, data: bytes):
        self.data, self.templates = data, {}

    def u16(self, at: int) -> int:
        return struct.unpack_from("<H", self.data, at)[0]

    def u32(self, at: int) -> int:
        return struct.unpack_from("<I", self.data, at)[0]

    def name(self, at: int) -> tuple[str, int]:
        """A name by its offset, and where reading goes on: behind the name if it stands right here."""
        place, at = self.u32(at), at + 4
        size = 2 * self.u16(place + 6)
        return self.data[place + 8 : place + 8 + size].decode("utf-16-le"), place + 10 + size if place == at else at

    def parts(self, at: int, end: int, inner: bool) -> tuple[list, int]:
        """Content up to the end of its element or fragment: texts, ("sub", number), ("made", template, values) and ("element", name, attributes, parts).

        inner: binary XML inside a value, where elements have no dependency number.
        """
        out: list = []
        while at < end:
            token, more = self.data[at] & 0x0F, self.data[at] & 0x40
            if token in (0x00, 0x04):
                return out, at + 1
            if token in (0x02, 0x03) or token == 0x06:
                return out, at
            if token == 0x01:
                element, at = self.element(at + 1 + (0 if inner else 2), end, bool(more), inner)
                out.append(element)
            elif token == 0x05:
                size = 2 * self.u16(at + 2)
                out.append(escape(self.data[at + 4 : at + 4 + size].decode("utf-16-le"), quote=True))
                at += 4 + size
            elif token == 0x07:
                size = 2 * self.u16(at + 1)
                out.append(escape(self.data[at + 3 : at + 3 + size].decode("utf-16-le"), quote=False))
                at += 3 + size
            elif token == 0x08:
                out.append(f"&#{self.u16(at + 1)};")
                at += 3
            elif token == 0x09:
                name, at = self.name(at + 1)
                out.append(f"&{name};")
            elif token == 0x0A:
                _, at = self.name(at + 1)
            elif token == 0x0B:
                at += 3 + 2 * self.u16(at + 1)
            elif token == 0x0C:
                made, at = self.instance(at + 1)
                out.append(made)
            elif token in (0x0D, 0x0E):
                out.append(("sub", self.u16(at + 1), token == 0x0E))
                at += 4
            elif token == 0x0F:
                at += 4
            else:
                raise ValueError(f"unknown token {token:#x} at {at}")
        if at > end:
            raise ValueError("content runs over its end")
        return out, at

    def element(self, at: int, end: int, attributes: bool, inner: bool) -> tuple[tuple, int]:
        name, at = self.name(at + 4)
        found = []
        if attributes:
            at += 4
            while at < end and self.data[at] & 0x0F == 0x06:
                key, at = self.name(at + 1)
                value, at = self.parts(at, end, inner)
                found.append((key, value))
        closed = self.data[at] & 0x0F == 0x03
        body, at = ([], at + 1) if closed else self.parts(at + 1, end, inner)
        return ("element", name, found, body), at

    def instance(self, at: int) -> tuple[tuple, int]:
        """A template with its values: (type, first byte, size) each."""
        place, at = self.u32(at + 5), at + 9
        if place not in self.templates:
            size = self.u32(place + 20)
            self.templates[place] = self.parts(place + 24, place + 24 + size, False)[0]
        if place == at:
            at = place + 24 + self.u32(place + 20)
        count, at = self.u32(at), at + 4
        kinds = [struct.unpack_from("<HB", self.data, at + 4 * i) for i in range(count)]
        at += 4 * count
        values = []
        for size, kind in kinds:
            values.append((kind, at, size))
            at += size
        return ("made", self.templates[place], values), at

    def items(self, kind: int, at: int, size: int) -> list[str]:
        """The texts of a value: one, or those of an array."""
        data = self.data[at : at + size]
        if not kind & ARRAY:
            return [VALUES[kind](data) if size else ""] if kind in VALUES else [data.hex().upper()]
        kind &= ~ARRAY
        if kind == 0x01:
            return data.decode("utf-16-le", "replace").rstrip("\0").split("\0")
        step = SIZES.get(kind)
        return [VALUES[kind](data[i : i + step]) for i in range(0, size, step)] if step else [data.hex().upper()]

    def text(self, parts: list, values: list) -> str:
        """Parts as XML."""
        out = []
        for part in parts:
            if isinstance(part, str):
                out.append(part)
            elif part[0] == "made":
                out.append(self.text(part[1], part[2]))
            elif part[0] == "sub":
                kind, at, size = values[part[1]] if part[1] < len(values) else (0, 0, 0)
                if kind == BINARY_XML:
                    out.append(self.text(self.parts(at, at + size, True)[0], []) if size else "")
                else:
                    out.append(", ".join(escape(x, quote=True) for x in self.items(kind, at, size)))
            else:
                out.append(self.element_text(part, values))
        return "".join(out)

    def element_text(self, element: tuple, values: list) -> str:
        _, name, attributes, body = element
        shown = ""
        for key, parts in attributes:
            gone = len(parts) == 1 and isinstance(parts[0], tuple) and parts[0][0] == "sub" and parts[0][2] and (parts[0][1] >= len(values) or values[parts[0][1]][0] == 0)
            shown += "" if gone else f' {key}="{self.text(parts, values)}"'
        if len(body) == 1 and isinstance(body[0], tuple) and body[0][0] == "sub" and body[0][1] < len(values) and values[body[0][1]][0] & ARRAY:
            return "".join(f"<{name}{shown}>{escape(x, quote=True)}</{name}>" for x in self.items(*values[body[0][1]]))  # an array repeats its element
        return f"<{name}{shown}>{self.text(body, values)}</{name}>"


def chunk_problem(data: bytes) -> str | None:
    """Why a chunk can't be trusted; None if it can."""
    if len(data) < CHUNK or data[:8] != CHUNK_MARK:
        return "no chunk"
    (free, records_sum), (own_sum,) = struct.unpack_from("<II", data, 48), struct.unpack_from("<I", data, 124)
    if not RECORDS <= free <= CHUNK or zlib.crc32(data[RECORDS:free]) != records_sum or zlib.crc32(data[128:RECORDS], zlib.crc32(data[:120])) != own_sum:
        return "wrong checksum"
    return None


def records(data: bytes, after: int | None = None) -> list[tuple[int | None, str | None, str | None]]:
    """(record id, XML, problem) of a chunk's records; after: only those with a higher id."""
    if problem := chunk_problem(data):
        return [(None, None, problem)]
    if after is not None and struct.unpack_from("<Q", data, 32)[0] <= after:
        return []
    chunk, at, out = Chunk(data), RECORDS, []
    (free,) = struct.unpack_from("<I", data, 48)
    while at + 28 <= free and data[at : at + 4] == RECORD_MARK:
        size, number = struct.unpack_from("<IQ", data, at + 4)
        if size < 28 or at + size > free:
            out.append((number, None, "wrong size"))
            break
        try:
            if chunk.u32(at + size - 4) != size:
                raise ValueError("its two sizes differ")
            found = chunk.text(chunk.parts(at + 24, at + size - 4, False)[0], [])
            if after is None or number > after:
                out.append((number, found, None))
        except (ValueError, IndexError, KeyError, struct.error, UnicodeDecodeError, RecursionError, OverflowError) as e:
            out.append((number, None, f"not decoded: {e}"))
        at += size
    return out


# -------------------------------------------------------------------------------------- Spark


def evtx_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, chunk, data) of files, folders or patterns; chunk -1 without data: a file without the format's mark."""
    files = spark.read.format("binaryFile").load(path)
    marked = F.substring("content", 1, 8) == F.lit(FILE_MARK)
    count = F.greatest(F.floor((F.length("content") - HEADER) / CHUNK), F.lit(0)).cast("int")
    places = F.when(marked, F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(-1)))
    rows = files.select("path", "content", F.explode(places).alias("chunk"))
    data = F.when(F.col("chunk") >= 0, F.substring(F.col("content"), F.col("chunk") * CHUNK + HEADER + 1, F.lit(CHUNK)))
    return rows.select("path", "chunk", data.alias("data"))


def evtx_records(spark: SparkSession, path: str, after_record: int | None = None, tasks: int | None = None) -> DataFrame:
    """Rows (path, chunk, record_id, xml_data, problem) of all records. Chunks that were never written (all zero) hold none."""
    chunks = evtx_chunks(spark, path).where(F.col("data").isNull() | (F.substring("data", 1, 8) != F.lit(bytes(8))))

    def decode(batches):
        for batch in batches:
            rows = []
            for where, chunk, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = [(None, None, "no event-log file")] if data is None else records(data, after_record)
                rows.extend((where, chunk, *r) for r in found)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "chunk", "record_id", "xml_data", "problem"])

    dealt = chunks.repartition(tasks, "path", "chunk") if tasks else chunks.repartition("path", "chunk")
    return dealt.mapInArrow(decode, ROWS)


def read_evtx(spark: SparkSession, path: str, after_record: int | None = None) -> DataFrame:
    """Canonical events of native log files; gathered_from is the file."""
    found = evtx_records(spark, path, after_record).where("problem is null")
    return parse_xml(found.withColumn("gathered_from", F.col("path")), "xml_data", keep=("gathered_from", "xml_data"))
