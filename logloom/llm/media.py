"""Operator 7: media columns held as content-defined chunks.

A payload (a text's UTF-8 bytes, padded with spaces to a positive multiple of 192) is held as the
8-bit samples of a WAV file. The file is a header and an ordered list of chunks of the payload. A
rolling gear hash cuts the payload where its top bits are 0, so equal passages give equal chunks
wherever they stand; a chunk's digest is its SHA-256.

    chunk_lists(docs)    a row per row: the digests of its chunks, in order
    shared_digests(l)    digests that occur more than once, by aggregation and joins on digests alone
    media_rows(docs)     a row per row, the media column: header and chunk list; a chunk that occurs
                         nowhere else has its (compressed) bytes in the list, others only the digest
    chunk_store(docs)    one row per chunk that occurs more than once
    play(media, store)   one row per distinct content: joins stored chunks to the lists that refer to them,
                         puts each file together in order, checks every digest and reads the features back

Bytes of chunks without a twin, most of them, are written once and never shuffled. Whether a chunk may have
a twin is looked up in a bitmap of fixed size; a false hit only moves a chunk to the store.

Defined cases: null text counts as empty and pads to 192 spaces; rows repeat their content's values; a
damaged or missing chunk raises an error; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import FILTER_BITS, SLICE_BYTES, U64, bitmap_bytes, lean, mixed, ship, slices, staged

UNIT = 192
#: Bytes of a chunk: at least, in the mean after that (a power of two), at most.
LEAST, MEAN, MOST = 256, 1024, 8192
RATE = 8000
#: Texts of which the store's compression dictionary is made, at most.
DICTIONARY_ROWS, DICTIONARY_BYTES = 256, 262_144
LEVEL = 9

GEAR = mixed(np.arange(1, 257, dtype=U64))


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k for k < 64: the gear hash, by doubling its window."""
    h = GEAR[data]
    for m in (1, 2, 4, 8, 16, 32):
        moved = np.zeros_like(h)
        moved[m:] = h[:-m] << U64(m)
        h = h + moved
    return h


def cut_points(data: bytes, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks: candidates at LEAST apart, forced ones MOST apart."""
    ends, last = [], 0
    for c in [*candidates.tolist(), len(data)]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c > last and (c - last >= LEAST or c == len(data)):
            ends.append(c)
            last = c
    return ends


def chunked(payload: bytes) -> list[bytes]:
    h = gear(np.frombuffer(payload, np.uint8))
    ends = cut_points(payload, np.flatnonzero((h >> U64(64 - MEAN.bit_length() + 1)) == 0) + 1)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def header(samples: int) -> bytes:
    """A canonical WAV header: PCM, mono, 8 bits."""
    return b"RIFF" + struct.pack("<I", 36 + samples) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", samples)


def read_samples(file: bytes) -> bytes:
    """The samples of a WAV file as written by header()."""
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or file[36:40] != b"data":
        raise ValueError("not a WAV file of this operator")
    (n,) = struct.unpack("<I", file[40:44])
    if len(file) != 44 + n:
        raise ValueError(f"the file has {len(file) - 44} samples, its header says {n}")
    return file[44:]


def features(samples: bytes) -> str:
    """Of the samples around 128: mean and energy in thousandths, crossings of 128, least, largest, distinct."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    n = len(x)
    return f"mean={int(x.sum()) * 1000 // n};energy={int((x * x).sum()) * 1000 // n};crossings={crossings};min={x.min() + 128};max={x.max() + 128};distinct={len(np.unique(x))}"


def content_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").alias("text"))


def _payloads(batches):
    """(text bytes, payload, its chunks) of all rows, in runs of about SLICE_BYTES."""
    for batch in batches:
        for _, column in slices(batch, "text", SLICE_BYTES):
            yield [(d, p, chunked(p)) for t in column.to_pylist() for d in (t.encode(),) for p in (padded(d),)]


def chunk_lists(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (digests): the digests of the chunks of each row's payload."""

    def rows(batches):
        for run in _payloads(batches):
            yield pa.RecordBatch.from_arrays([pa.array([[hashlib.sha256(c).digest() for c in chunks] for _, _, chunks in run], pa.list_(pa.binary()))], ["digests"])

    return _texts(docs, text_col).mapInArrow(lean(rows), "digests array<binary>")


def shared_digests(lists: DataFrame) -> bytes:
    """A bitmap of 2**FILTER_BITS bits (8 MB, whatever the input) of the digests that occur more than once."""
    counts = lists.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("c")).where("c > 1")
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    return bitmap_bytes(counts.select((F.shiftright(head, 32 - FILTER_BITS) + 1).alias("bit")))


def may_be_shared(bitmap: bytes, digest: bytes) -> bool:
    bit = int.from_bytes(digest[:4], "big") >> 32 - FILTER_BITS
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def store_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """A compression dictionary from a bounded sample, the same in every run; any bytes give a right store, good ones a small one."""
    texts = _texts(docs, text_col).where(F.octet_length("text").between(1, 1 << 16)).select(F.substring("text", 1, 2000).alias("text"), F.xxhash64("text").alias("h"))
    # The least hash of each of DICTIONARY_ROWS ranges, then the texts of those: no task sends more than that to the driver.
    least = [r[0] for r in texts.groupBy(F.pmod("h", F.lit(DICTIONARY_ROWS)).alias("part")).agg(F.min("h").alias("h")).select("h").collect()]
    found = texts.where(F.col("h").isin(least)).groupBy("h", "text").agg(F.count("*").alias("c")).select("h", "text").collect() if least else []
    return b"".join(text.encode()[:2000] for _, text in sorted(map(tuple, found)))[:DICTIONARY_BYTES]


def _packer(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False), zstandard.ZstdDecompressor(dict_data=made)


MEDIA = "content binary, n_bytes bigint, payload_bytes bigint, payload_digest binary, header binary, chunks array<struct<digest:binary,packed:binary>>"
CHUNK_KIND = pa.list_(pa.struct([("digest", pa.binary()), ("packed", pa.binary())]))


def media_rows(docs: DataFrame, bitmap, dictionary: bytes = b"", text_col: str = "text") -> DataFrame:
    """The media column of every row, in MEDIA's columns; packed is null where the chunk is in the store. bitmap: a broadcast."""

    def rows(batches):
        pack, _ = _packer(dictionary)
        for run in _payloads(batches):
            cols: list[list] = [[] for _ in range(6)]
            for data, payload, chunks in run:
                digests = [hashlib.sha256(c).digest() for c in chunks]
                listed = [{"digest": d, "packed": None if may_be_shared(bitmap.value, d) else pack.compress(c)} for d, c in zip(digests, chunks, strict=True)]
                for col, value in zip(cols, (hashlib.sha256(data).digest(), len(data), len(payload), hashlib.sha256(payload).digest(), header(len(payload)), listed), strict=True):
                    col.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), CHUNK_KIND]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in MEDIA.split(", ")])

    return _texts(docs, text_col).mapInArrow(lean(rows), MEDIA)


def chunk_store(docs: DataFrame, bitmap, dictionary: bytes = b"", text_col: str = "text") -> DataFrame:
    """One row (digest, packed) per distinct chunk that may be shared. bitmap: a broadcast."""

    def rows(batches):
        pack, _ = _packer(dictionary)
        seen: set[bytes] = set()
        for run in _payloads(batches):
            out = {}
            for _, _, chunks in run:
                for chunk in chunks:
                    key = hashlib.sha256(chunk).digest()
                    if key not in seen and may_be_shared(bitmap.value, key):
                        out[key] = pack.compress(chunk)
                        seen.add(key)
            if len(seen) > 200_000:  # only saves shuffled bytes: the aggregation finds every repeat
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "packed"])

    return _texts(docs, text_col).mapInArrow(lean(rows), "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


PLAYED = "payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
PLAYED_KIND = pa.struct([("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def read_back(head: bytes, chunks: list[dict], digest: bytes, unpack) -> dict:
    """The file of a header and chunks in order, checked, and what is read from it."""
    parts = []
    for c in chunks:
        if c["packed"] is None:
            raise ValueError(f"the store has no chunk {c['digest'].hex()}")
        part = unpack.decompress(c["packed"])
        if hashlib.sha256(part).digest() != c["digest"]:
            raise ValueError(f"chunk {c['digest'].hex()} is damaged")
        parts.append(part)
    file = head + b"".join(parts)
    samples = read_samples(file)
    found = hashlib.sha256(samples).digest()
    if found != digest:
        raise ValueError(f"payload {digest.hex()} is damaged")
    return {"payload_sha256": found.hex(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": features(samples)}


def play(media: DataFrame, store: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """One row per distinct content: content, n_bytes, payload_bytes and PLAYED, all read from the stored bytes."""

    @F.arrow_udf(PLAYED)
    def played(head: pa.Array, chunks: pa.Array, digest: pa.Array) -> pa.Array:
        _, unpack = _packer(dictionary)
        return pa.array([read_back(head[i].as_py(), chunks[i].as_py(), digest[i].as_py(), unpack) for i in range(len(head))], PLAYED_KIND)

    refers = F.exists("chunks", lambda c: c["packed"].isNull())
    # A row without references is the only one of its content: a twin would share its chunks.
    whole = media.where(~refers)
    first = media.where(refers).groupBy("content").agg(*[F.first(c).alias(c) for c in ("n_bytes", "payload_bytes", "payload_digest", "header", "chunks")])
    entries = first.select("content", F.posexplode("chunks").alias("seq", "c")).select("content", "seq", F.col("c.digest").alias("digest"), F.col("c.packed").alias("own"))
    inline = entries.where("own is not null").select("content", "seq", "digest", F.col("own").alias("packed"))
    stored = entries.where("own is null").drop("own").join(store, "digest", "left").select("content", "seq", "digest", "packed")
    parts = inline.unionByName(stored).groupBy("content").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "packed"))).alias("parts"))
    joined = first.drop("chunks").join(parts, "content").withColumn("chunks", F.transform("parts", lambda p: F.struct(p["digest"].alias("digest"), p["packed"].alias("packed"))))
    rows = whole.unionByName(joined.select(*whole.columns))
    return rows.select("content", "n_bytes", "payload_bytes", played("header", "chunks", "payload_digest").alias("m")).select("content", "n_bytes", "payload_bytes", "m.*")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media, reads the stored bytes back, and returns per row the id and the values read."""
    dictionary = store_dictionary(docs, text_col)
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_digests(chunk_lists(docs, text_col)))
    media = staged(media_rows(docs, bitmap, dictionary, text_col), "media-rows", "uncompressed")
    store = staged(chunk_store(docs, bitmap, dictionary, text_col), "media-chunks", "uncompressed")
    values = play(media, store, dictionary)
    keys = docs.select(F.col(f"`{id_col}`"), content_key(F.col(f"`{text_col}`")).alias("content"))
    return keys.join(values, "content").drop("content")


ship(__name__)
