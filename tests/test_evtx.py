"""Native log files written here byte by byte, read back and held against the same events as exported XML."""

import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.api import EventLog, spec
from logloom.plans.requests import security_request
from logloom.sources import evtx
from logloom.sources.hosts import scan_hosts
from logloom.sources.xml_events import parse_xml

NS = "http://schemas.microsoft.com/win/2004/08/events/event"
T0 = datetime(2026, 2, 10, 10)


class Sub:
    """A place in a template that a value fills."""

    def __init__(self, number, optional=True):
        self.number, self.optional = number, optional


class Entity(str):
    pass


class CData(str):
    pass


class Node:
    def __init__(self, name, attributes=(), body=()):
        self.name, self.attributes, self.body = name, list(attributes), body


class ChunkWriter:
    """One chunk: names and templates stand where they are first used."""

    def __init__(self, first):
        self.data, self.at, self.names, self.templates, self.first, self.last = bytearray(evtx.CHUNK), evtx.RECORDS, {}, {}, first, first - 1

    def put(self, form, *values):
        struct.pack_into(form, self.data, self.at, *values)
        self.at += struct.calcsize(form)

    def raw(self, data):
        self.data[self.at : self.at + len(data)] = data
        self.at += len(data)

    def name(self, text):
        here = self.at + 4
        self.put("<I", self.names.setdefault(text, here))
        if self.names[text] == here:
            self.put("<IHH", 0, 0, len(text))
            self.raw(text.encode("utf-16-le") + b"\0\0")

    def part(self, part, inner):
        if isinstance(part, Node):
            self.node(part, inner)
        elif isinstance(part, Sub):
            self.put("<BHB", 0x0E if part.optional else 0x0D, part.number, 1)
        elif isinstance(part, Entity):
            self.put("<B", 0x09)
            self.name(str(part))
        elif isinstance(part, CData):
            self.put("<BH", 0x07, len(part))
            self.raw(part.encode("utf-16-le"))
        elif isinstance(part, int):
            self.put("<BH", 0x08, part)
        else:
            self.put("<BBH", 0x05, 1, len(part))
            self.raw(part.encode("utf-16-le"))

    def node(self, node, inner):
        self.put("<B", 0x41 if node.attributes else 0x01)
        if not inner:
            self.put("<H", 0xFFFF)
        self.put("<I", 0)
        self.name(node.name)
        if node.attributes:
            self.put("<I", 0)
            for i, (key, value) in enumerate(node.attributes):
                self.put("<B", 0x46 if i < len(node.attributes) - 1 else 0x06)
                self.name(key)
                self.part(value, inner)
        if node.body is None:
            self.put("<B", 0x03)
        else:
            self.put("<B", 0x02)
            for part in node.body:
                self.part(part, inner)
            self.put("<B", 0x04)

    def fragment(self, node, inner):
        self.raw(b"\x0f\x01\x01\x00")
        self.node(node, inner)
        self.put("<B", 0)

    def record(self, template, values, number=None):
        """values: (type, bytes or a Node)."""
        begin = self.at
        self.last = self.last + 1 if number is None else number
        self.raw(evtx.RECORD_MARK)
        self.put("<IQQ", 0, self.last, 0)
        self.raw(b"\x0f\x01\x01\x00\x0c\x01")
        self.put("<I", 77)
        here = self.at + 4
        place = self.templates.setdefault(id(template), here)
        self.put("<I", place)
        if place == here:
            self.put("<I16sI", 0, bytes(16), 0)
            start = self.at
            self.fragment(template, False)
            struct.pack_into("<I", self.data, place + 20, self.at - start)
        self.put("<I", len(values))
        sizes = self.at
        for kind, _ in values:
            self.put("<HBB", 0, kind, 0)
        for i, (_, value) in enumerate(values):
            start = self.at
            self.fragment(value, True) if isinstance(value, Node) else self.raw(value)
            struct.pack_into("<H", self.data, sizes + 4 * i, self.at - start)
        self.put("<B", 0)
        self.put("<I", self.at + 4 - begin)
        struct.pack_into("<I", self.data, begin + 4, self.at - begin)

    def done(self):
        self.data[:8] = evtx.CHUNK_MARK
        struct.pack_into("<QQQQIII", self.data, 8, self.first, self.last, self.first, self.last, 128, 0, self.at)
        struct.pack_into("<I", self.data, 52, zlib.crc32(self.data[evtx.RECORDS : self.at]))
        struct.pack_into("<I", self.data, 124, zlib.crc32(self.data[128 : evtx.RECORDS], zlib.crc32(self.data[:120])))
        return bytes(self.data)


def file_of(*chunks):
    return evtx.FILE_MARK + bytes(evtx.HEADER - 8) + b"".join(chunks)


def filetime(moment, more=0):
    return struct.pack("<Q", ((moment - datetime(1601, 1, 1)) // timedelta(microseconds=1)) * 10 + more)


def text(value):
    return 0x01, value.encode("utf-16-le")


SYSTEM = Node("System", (), [
    Node("Provider", [("Name", Sub(0)), ("Guid", Sub(1))], None), Node("EventID", [("Qualifiers", Sub(3))], [Sub(2)]), Node("Version", (), [Sub(4)]), Node("Level", (), [Sub(5)]), Node("Task", (), [Sub(6)]), Node("Opcode", (), [Sub(7)]),
    Node("Keywords", (), [Sub(8)]), Node("TimeCreated", [("SystemTime", Sub(9))], None), Node("EventRecordID", (), [Sub(10)]), Node("Correlation", [("ActivityID", Sub(11))], None),
    Node("Execution", [("ProcessID", Sub(12)), ("ThreadID", Sub(13))], None), Node("Channel", (), [Sub(14, False)]), Node("Computer", (), ["dc", Entity("amp"), 0x31, CData("<a>")]), Node("Security", [("UserID", Sub(15))], None),
])
LOGON = Node("Event", [("xmlns", NS)], [SYSTEM, Node("EventData", (), [Node("Data", [("Name", "TargetUserName")], [Sub(16)]), Node("Data", [("Name", "Elevated")], [Sub(17)]), Node("Data", [("Name", "Address")], [Sub(18)]), Node("Data", (), [Sub(19)]), Node("Binary", (), [Sub(20)])])])
OTHER = Node("Event", [("xmlns", NS)], [SYSTEM, Node("UserData", (), [Sub(16)])])
GUID, SID = bytes(range(16)), bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544)
#: The same two as text.
GUID_TEXT, SID_TEXT = "{03020100-0504-0706-0809-0A0B0C0D0E0F}", "S-1-5-32-544"


def system(number, channel="Security"):
    return [
        text("Prov & Co"), (0x0F, GUID), (0x06, struct.pack("<H", 4624)), (0x06, struct.pack("<H", 7)) if number % 2 else (0x00, b""), (0x04, b"\2"), (0x04, b"\4"), (0x06, struct.pack("<H", 12)), (0x04, b"\0"), (0x15, struct.pack("<Q", 1 << 53)),
        (0x11, filetime(T0 + timedelta(seconds=number), 7)), (0x0A, struct.pack("<Q", number)), (0x00, b""), (0x08, struct.pack("<I", 4)), (0x08, struct.pack("<I", 5)), text(channel), (0x13, SID) if number % 3 else (0x00, b""),
    ]


def logon(number):
    return [*system(number), text(f"user <{number}> é𝔘"), (0x0D, struct.pack("<I", number % 2)), (0x0F, GUID), (0x81, "one\0two\0".encode("utf-16-le")), (0x0E, b"\x01\xab")]


def exported(number, kind="logon"):
    head = f"""<System><Provider Name="Prov &amp; Co" Guid="{GUID_TEXT}"/><EventID{' Qualifiers="7"' if number % 2 else ''}>4624</EventID><Version>2</Version><Level>4</Level><Task>12</Task><Opcode>0</Opcode><Keywords>0x20000000000000</Keywords>
      <TimeCreated SystemTime="2026-02-10T10:{number // 60:02d}:{number % 60:02d}.0000007Z"/><EventRecordID>{number}</EventRecordID><Correlation/><Execution ProcessID="4" ThreadID="5"/><Channel>{'Security' if kind == 'logon' else 'App'}</Channel><Computer>dc&amp;1&lt;a&gt;</Computer>
      <Security{f' UserID="{SID_TEXT}"' if number % 3 else ''}/></System>"""
    if kind == "logon":
        body = f"""<EventData><Data Name="TargetUserName">user &lt;{number}&gt; é𝔘</Data><Data Name="Elevated">{'true' if number % 2 else 'false'}</Data><Data Name="Address">{GUID_TEXT}</Data><Data>one</Data><Data>two</Data><Binary>01AB</Binary></EventData>"""
    else:
        body = f"""<UserData><Cleared xmlns="x"><Who>me {number}</Who><Path a="b">/x</Path></Cleared></UserData>"""
    return f'<Event xmlns="{NS}">{head}{body}</Event>'


def cleared(number):
    return [*system(number, "App"), (evtx.BINARY_XML, Node("Cleared", [("xmlns", "x")], [Node("Who", (), ["me ", str(number)]), Node("Path", [("a", "b")], ["/x"])]))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three files: two good ones, of three chunks and one; one of which chunks, records and all are damaged."""
    base = tmp_path_factory.mktemp("evtx")
    chunks = []
    for k in range(3):
        c = ChunkWriter(1 + 20 * k)
        for i in range(20):
            n = 1 + 20 * k + i
            c.record(LOGON, logon(n)) if i % 4 else c.record(OTHER, cleared(n))
        chunks.append(c.done())
    (base / "a.evtx").write_bytes(file_of(*chunks) + bytes(evtx.CHUNK))  # a chunk not yet written
    one = ChunkWriter(500)
    one.record(LOGON, logon(500))
    (base / "b.evtx").write_bytes(file_of(one.done()))
    bad = ChunkWriter(900)
    for n in (900, 901, 902):
        bad.record(LOGON, logon(n))
    whole = bytearray(bad.done())
    at = evtx.RECORDS + struct.unpack_from("<I", whole, evtx.RECORDS + 4)[0]
    whole[at + 28 : at + 29] = b"\x0b\x0b"[:1]  # the second record no longer makes sense
    whole[at + 29 : at + 31] = b"\xff\xff"
    free = struct.unpack_from("<I", whole, 48)[0]
    struct.pack_into("<I", whole, 52, zlib.crc32(whole[evtx.RECORDS : free]))
    struct.pack_into("<I", whole, 124, zlib.crc32(whole[128 : evtx.RECORDS], zlib.crc32(whole[:120])))
    flipped = bytearray(chunks[0])
    flipped[5000] ^= 1
    (base / "bad").mkdir()
    (base / "bad" / "c.evtx").write_bytes(file_of(bytes(flipped), bytes(whole)))
    (base / "bad" / "d.evtx").write_bytes(b"not a log at all" * 500)
    (base / "bad" / "e.evtx").write_bytes(file_of())
    return base


COLUMNS = ["record_id", "time_created", "id", "version", "level", "task", "opcode", "keywords", "provider_name", "provider_id", "qualifiers", "activity_id", "process_id", "thread_id", "log_name", "computer_name", "user_id", "data", "attachments"]


def plain(frame):
    rows = frame.select(*[F.to_json("data").alias("data") if c == "data" else c for c in COLUMNS]).orderBy("record_id").collect()
    return [tuple(map(str, r)) for r in rows]


def test_files_read_like_their_export(spark, folder):
    native = evtx.read_evtx(spark, f"file://{folder}/*.evtx")
    xml = [exported(n, "logon" if (n - 1) % 20 % 4 else "cleared") for n in range(1, 61)] + [exported(500)]
    want = parse_xml(spark.createDataFrame([(x,) for x in xml], "xml_data string"))
    got = plain(native)
    assert len(got) == 61 and got == plain(want)
    first = native.where("record_id = 2").first()
    assert first.data == {"TargetUserName": "user <2> é𝔘", "Elevated": "false", "Address": GUID_TEXT, "NoNameA0": "one", "NoNameA1": "two", "Binary": "01AB"} and first.attachments == [b"\x01\xab"]
    assert native.where("record_id = 1").first().data == {"Who": "me 1", "Path": "/x"} and first.gathered_from.endswith("/a.evtx") and first.xml_data.startswith("<Event xmlns=")


def test_chunks_are_dealt_and_skipped(spark, folder):
    chunks = evtx.evtx_chunks(spark, f"file://{folder}/a.evtx")
    assert sorted(r.chunk for r in chunks.select("chunk").collect()) == [0, 1, 2, 3]
    assert sorted(r.record_id for r in evtx.evtx_records(spark, f"file://{folder}/a.evtx", after_record=38).collect()) == list(range(39, 61))
    assert evtx.evtx_records(spark, f"file://{folder}/a.evtx", tasks=2).rdd.getNumPartitions() == 2


def test_damage_stays_where_it_is(spark, folder):
    rows = evtx.evtx_records(spark, f"file://{folder}/bad").collect()
    found = sorted((r.path.rsplit("/", 1)[1], r.chunk, r.record_id or 0, (r.problem or "").split(":")[0]) for r in rows)
    assert found == [("c.evtx", 0, 0, "wrong checksum"), ("c.evtx", 1, 900, ""), ("c.evtx", 1, 901, "not decoded"), ("c.evtx", 1, 902, ""), ("d.evtx", -1, 0, "no event-log file")]
    assert sorted(r.record_id for r in evtx.read_evtx(spark, f"file://{folder}/bad").select("record_id").collect()) == [900, 902]


def test_entry_point_opens_native_files(spark, folder):
    log = EventLog.open(spark, f"file://{folder}/*.evtx")
    newest = log.get_list(spec(log_name="Security", named_data={"targetusername": ("user <60> é𝔘", "user <59> é𝔘")}), max_events=5)
    assert [r.record_id for r in newest] == [60, 59] and log.get_info().count() == 2
    assert log.get_events(query="*[System[EventID=4624] and UserData/Cleared/Who='me 5']").first().record_id == 5
    top, _ = log.security_report("user_logons", security_request("x", top=3))
    assert top.count() == 0  # of another provider
    found = scan_hosts(spark, {"a": f"file://{folder}/a.evtx", "b": f"file://{folder}/b.evtx", "c": f"file://{folder}/gone.evtx"}, lambda rows: rows.select("record_id"))
    assert {(r.host, r["count"]) for r in found.rows.groupBy("host").count().collect()} == {("a", 60), ("b", 1)} and found.failed == ("c",)


@pytest.mark.parametrize("kind,data,shown", [(0x03, b"\xff", "-1"), (0x05, b"\xfe\xff", "-2"), (0x09, struct.pack("<q", -3), "-3"), (0x0C, struct.pack("<d", 1.5), "1.5"), (0x02, b"a\xe9\0", "aé"), (0x12, struct.pack("<8H", 2026, 2, 2, 10, 11, 12, 13, 14), "2026-02-10T11:12:13.014Z"), (0x14, struct.pack("<I", 255), "0xff"), (0x13, SID, SID_TEXT), (0x88, struct.pack("<2I", 1, 2), "1, 2"), (0x7F, b"\1\2", "0102")])
def test_values(kind, data, shown):
    template = Node("Event", (), [Node("A", [("b", Sub(0, False))], ["x", Sub(0, False)])])
    c = ChunkWriter(1)
    c.record(template, [(kind, data)])
    ((number, found, problem),) = evtx.records(c.done())
    assert (number, problem) == (1, None) and found == f'<Event><A b="{shown}">x{shown}</A></Event>'
