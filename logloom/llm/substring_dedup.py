"""Operator 3: removal of passages that an earlier document has, by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a WIDTH-byte string that also starts in a document with a smaller id. Strings
are judged on the input texts; matches stay within documents.

1. Suffixes are dealt to buckets by content: by the gram of GRAM bytes with the least hash within a suffix's first WIDTH bytes.
   Suffixes with equal prefixes fall into the same bucket, neighbours mostly into the same one too, so they travel as
   stretches of text. A gram's suffixes are of two sides: those that reach far before it share the bytes before it too, the others
   the bytes behind it. A first scan drops the sides whose 35 bytes or more no other text has: these suffixes equal no other.
2. A bucket is sorted by itself, in memory of bounded size (sorted_suffixes): the positions of a difference cover modulo
   PERIOD are ranked once, by doubling their depth; suffixes are sorted to a short depth of 16 bytes, and longer ties are
   resolved by the ranks at the distance where both suffixes have a cover position. No hash decides: all WIDTH bytes are compared.
3. Every run of suffixes that does not come from the least id of its string is one row of marks, and a
   document's marks are united into removed runs. Rows grow with the repeated text and no faster.

Equal texts are handled as one: their later copies lose all bytes (if there are WIDTH), and only the
earliest is sampled and sorted. A scan's slice ships equal stretches once, from its least id, and a bucket sorts them once; of a gram
whose sides two texts of a slice have, one entry is shipped. Grams that more than HOT samples share are hot: their sides are dealt by
themselves. If more than HOT share a side, its suffixes are dealt one by one, by a hash of their first WIDTH bytes, and a task ships each
string once, so the many different surroundings of a common passage don't meet in one task. Texts are
shuffled only where they hold a shared side (second scan) or a marked suffix (third scan).

Defined cases: null text counts as empty; a null id comes after all others; rows that repeat an id do not
remove each other; texts under WIDTH bytes lose nothing; an empty table gives an empty result. Ids are bigint;
columns of any other name are left unread.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .common import FILTER_BITS, U64, bitmap_bytes, bitmap_of, buffers, eights, in_bitmap, lean, mixed, ship, slices, staged, with_hit

WIDTH, GRAM = 50, 20
#: Text bytes of a task's buckets, about (of all text; only shared stretches arrive), and of one bucket.
BUCKET_BYTES, SORT_BYTES = 8_000_000, 1 << 21
#: A difference cover: for any two residues some distance leads both into it.
PERIOD, COVER = 7, (0, 1, 3)
#: Text bytes whose grams are hashed at once (they stay in a core's cache), and whose entries are shipped together.
SCAN_BYTES, SHIP_BYTES = 1 << 17, 1 << 22
#: A gram, or a side of it, that more samples share is hot: not all of its stretches fit one sort. Strings of hot sides that a task
#: remembers, to ship each once.
HOT, SEEN = SORT_BYTES // (2 * WIDTH), 200_000
LAST = (1 << 63) - 1
#: The place of an entry whose sides are known to be shared.
KNOWN = 0xFFFFFFFF


def _chained(parts) -> np.ndarray:
    """One hash of several arrays of 8 bytes."""
    out = None
    for part in parts:
        out = part * U64(0x9E3779B97F4A7C15) if out is None else np.multiply(np.bitwise_xor(out, part, out=out), U64(0x9E3779B97F4A7C15), out=out)
        out ^= out >> U64(32)
    return out


def _steps(size: int) -> list[int]:
    """Where 8 bytes are read of `size` (8 at least), so that none is left out."""
    return [*range(0, size - 8, 8), size - 8]


def _half(width: int, gram: int) -> int:
    """Windows that begin at least this far before a gram are its left side (0), the others its right side (1)."""
    return (width - gram) // 2


def _samples(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    empty = (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < width:
        return empty
    eight = eights(np.concatenate([data, np.zeros(8, np.uint8)]), len(data))
    n = len(data) - gram + 1
    names = _chained(eight[o : o + n] for o in _steps(gram))
    keys = names >> U64(32)
    keys <<= U64(32)
    keys |= np.arange(n, dtype=U64)  # ties: the leftmost
    reach, least = 1, keys
    span = width - gram + 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, place, "right") - 1
    first = np.maximum(at, offsets[text])
    count = np.minimum(np.append(at[1:], len(least)), offsets[text + 1] - width + 1) - first
    some = count > 0  # windows and grams that go on in the next text are none
    place, first, count = place[some], first[some], count[some]
    name, half = names[place] << U64(32), _half(width, gram)  # the upper bits of a least hash are small
    left = place - first >= half
    right = place - first - count + 1 < half
    for has, begin, size, shift in ((left, place - half, half + gram, 16), (right, place, width - half + 1, 0)):
        begin = np.where(has, begin, 0)
        tag = _chained(eight[np.minimum(begin + o, len(eight) - 1)] for o in _steps(size))
        name |= np.where(has, (tag >> U64(32)) % U64(0xFFFF) + U64(1), U64(0)) << U64(shift)
    return place, name, first, count


def samples(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """(position, name, first window, windows) of each sampled gram; positions are in data, windows within one text. A name is
    32 bits of the gram's hash and 16 bits each of its left and right side's (0: no windows)."""
    parts, start = [], 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SCAN_BYTES, "right")) - 1)
        base = offsets[start]
        place, name, first, count = _samples(data[base : offsets[end]], offsets[start : end + 1] - base, width, gram)
        parts.append((place + base, name, first + base, count))
        start = end
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else _samples(data, offsets, width, gram)


def _side(name: np.ndarray, side: int) -> np.ndarray:
    """Of a sample's name the gram and one side, 0 if the sample has no windows there."""
    tag = (name >> U64(16 - 16 * side)) & U64(0xFFFF)
    return np.where(tag > 0, (name & ~U64(0xFFFFFFFF)) | (tag << U64(1)) | U64(side), U64(0))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper 32 bits of names: all samples of a gram share a bucket."""
    return (mixed(name >> U64(32)) >> U64(33)).astype(np.int64) % buckets


NAMES = "bucket bigint, kind int, refs binary, names binary, places binary"
NAME_COLUMNS = ["bucket", "kind", "refs", "names", "places"]


def _cut(starts: np.ndarray, sizes: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Each column's runs as binary values."""
    runs = [(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return [pa.array([c[a:b].tobytes() for a, b in runs], pa.binary()) for c in columns]


def _common(ref: np.ndarray, name: np.ndarray, known: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Whether two texts have each entry's left and right side, or it is known of one entry; and how many samples have the side.
    A known entry has a number of samples as its ref."""
    weight = np.where(known, ref, 1)
    hit, many = [np.zeros(len(name), bool) for _ in (0, 1)], [np.zeros(len(name), np.int64) for _ in (0, 1)]
    cell = (name >> U64(max(32, 62 - len(name).bit_length()))).astype(np.int64)
    some = np.flatnonzero((np.bincount(cell)[cell] > 1) | known)  # most grams are of one entry
    for side in (0, 1):
        key = _side(name[some], side)
        own = some[key > 0]
        key = key[key > 0]
        order = np.argsort(key)
        own = own[order]
        at, size = _runs(key[order])
        if len(own):
            both = (np.maximum.reduceat(ref[own], at) != np.minimum.reduceat(ref[own], at)) | np.logical_or.reduceat(known[own], at)
            hit[side][own], many[side][own] = np.repeat(both, size), np.repeat(np.add.reduceat(weight[own], at), size)
    return hit, many


def shared_samples(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Rows (part, refs, places) from docs (ref, text): packed refs of texts, dealt to parts, and packed uint32 places of their samples'
    sides that another text has (twice the position, and 1 for the right side); and rows with names of hot grams and sides as places, part null."""
    parts = max(16, buckets // 16)

    def packed_parts(r, p):
        part = (r % parts).astype(np.int64)
        order = np.lexsort((p, r, part))
        a, n = _runs(part[order])
        return pa.array(part[order][a]), *_cut(a, n, r[order], p[order])

    def entries(batches):
        for batch in batches:
            for part, column in slices(batch, "text", SHIP_BYTES):
                data, offsets = buffers(column)
                place, name, _, _ = samples(data, offsets, width, gram)
                text = np.searchsorted(offsets, place, "right") - 1
                refs = np.asarray(part.column(0)).astype(np.int64)
                once = np.zeros(len(refs), bool)  # copies of a text in this slice
                once[np.unique(refs, return_index=True)[1]] = True
                place, name, text = place[once[text]], name[once[text]], text[once[text]]
                if not len(place):
                    continue
                ref, place = refs[text], (place - offsets[text]).astype(np.uint32)
                hit, _ = _common(ref, name, np.zeros(len(ref), bool))
                r, p = (np.concatenate(x) for x in zip(*[(ref[h], place[h] * np.uint32(2) + np.uint32(side)) for side, h in enumerate(hit)], strict=True))
                if len(r):  # two texts of this slice have it: the sides are shared, whoever else has them
                    part, r, p = packed_parts(r, p)
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.ones(len(part), np.int32)), r, pa.nulls(len(part), pa.binary()), p], NAME_COLUMNS)
                known = (hit[0] | (_side(name, 0) == 0)) & (hit[1] | (_side(name, 1) == 0))
                stay = ~known  # of known ones one entry each, so that others learn of them
                _, at, size = np.unique(name[known], return_index=True, return_counts=True)
                at = np.flatnonzero(known)[at]
                stay[at], ref[at] = True, size
                stay = np.flatnonzero(stay)
                bucket = _bucket(name[stay], buckets)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                stay, bucket = stay[order], bucket[order]
                a, n = _runs(bucket)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a], pa.int64()), pa.array(np.zeros(len(a), np.int32)), *_cut(a, n, ref[stay], name[stay], np.where(known[stay], np.uint32(KNOWN), place[stay]))], NAME_COLUMNS)

    def shared(table: pa.Table) -> pa.Table:
        direct = table.filter(pa.compute.equal(table["kind"], 1))
        out = [direct.select(["bucket", "refs", "places"]).rename_columns(["part", "refs", "places"])]
        packed = table.filter(pa.compute.equal(table["kind"], 0))
        if len(packed):
            ref, name, place = (np.frombuffer(b"".join(packed[c].to_pylist()), t) for c, t in (("refs", np.int64), ("names", U64), ("places", np.uint32)))
            known = place == KNOWN
            hit, many = _common(ref, name, known)
            some = hit[0] | hit[1] | known
            gram_, at = np.unique(name[some] & ~U64(0xFFFFFFFF), return_inverse=True)
            hot = np.concatenate([gram_[np.bincount(at, np.where(known, ref, 1)[some], len(gram_)) > HOT], *[np.unique(_side(name[h & (m > HOT)], side)) for side, (h, m) in enumerate(zip(hit, many, strict=True))]])
            if len(hot):
                out.append(pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([hot.tobytes()], pa.binary())], ["part", "refs", "places"]))
            r, p = (np.concatenate(x) for x in zip(*[(ref[h & ~known], place[h & ~known] * np.uint32(2) + np.uint32(side)) for side, h in enumerate(hit)], strict=True))
            out.append(pa.table([*packed_parts(r, p)], ["part", "refs", "places"]))
        return pa.concat_tables(out)

    return docs.mapInArrow(lean(entries), NAMES).groupBy("bucket").applyInArrow(lean(shared), "part bigint, refs binary, places binary")


def places_of(table: pa.Table) -> pa.Table:
    """A row (ref, places) for each text of a part."""
    ref, place = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("refs", np.int64), ("places", np.uint32)))
    order = np.lexsort((place, ref))
    at, size = _runs(ref[order])
    return pa.table([pa.array(ref[order][at]), *_cut(at, size, place[order])], ["ref", "places"])


def _hot_bits(name: np.ndarray) -> np.ndarray:
    """The bit (from 0) of a gram's or side's name in the bitmap of hot ones."""
    return (mixed(name) >> U64(64 - FILTER_BITS)).astype(np.int64)


def hot_names(found: DataFrame) -> bytes:
    """A bitmap (8 MB, whatever the input) of the names in the rows without part. A false hit only deals sides, or suffixes, by themselves."""

    def names(batches):
        for batch in batches:
            name = np.frombuffer(b"".join(batch.column(0).to_pylist()), U64)
            yield pa.RecordBatch.from_arrays([pa.array(_hot_bits(name) + 1)], ["bit"])

    return bitmap_bytes(found.where("part is null").select("places").mapInArrow(lean(names), "bit bigint"))


# ------------------------------------------------------------------------- suffix sorting of a bucket


def _shifts() -> np.ndarray:
    """For two residues the least distance at which both are in the cover."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return table


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal keys alike; the first key counts most."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int32)
    new[:1] = 1
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    ranks = np.empty(len(order), np.int32)
    ranks[order] = np.cumsum(new, dtype=np.int32)
    return ranks


def _dense_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """_dense() of pairs of ranks; where both and a place fit 64 bits, plain numbers are sorted, which is several times faster."""
    first, second = first.astype(U64), second.astype(U64)
    n = len(first)
    if n >= (1 << 21) - 1:
        return _dense((first << U64(32)) | second)
    packed = (first << U64(42)) | (second << U64(21)) | np.arange(n, dtype=U64)
    packed.sort()
    order = (packed & U64((1 << 21) - 1)).astype(np.int64)
    packed >>= U64(21)
    new = np.ones(n, np.int32)
    new[1:] = packed[1:] != packed[:-1]
    ranks = np.empty(n, np.int32)
    ranks[order] = np.cumsum(new, dtype=np.int32)
    return ranks


def cover_ranks(eight: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by their first `depth` (at least 8) bytes; 0 elsewhere."""
    place = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    reach = 8 + (depth - 8) % PERIOD
    ranks = np.zeros(len(eight), np.int32)
    ranks[place] = _dense(eight[place]) if reach == 8 else _dense(eight[place], eight[place + reach - 8])
    while reach < depth:
        step = min(reach // PERIOD * PERIOD, depth - reach)
        ranks[place] = _dense_pairs(ranks[place], ranks[place + step])
        reach += step
    return ranks


def sorted_suffixes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes `at` of data by 16 bytes, then by cover ranks, up to `width` bytes: (order of the short sort, class of each in
    that order). Suffixes with equal first `width` bytes have one class. data must have `width` bytes from each; width is 23 at least."""
    n = len(data)
    eight = eights(np.concatenate([data, np.zeros(width + 16, np.uint8)]), n + width)
    # A tie within 16 bytes is settled by width - 7 bytes from distance d < PERIOD, then by the 8 bytes up to width.
    ranks, shifts = cover_ranks(eight, n, width - 7), _shifts()
    order = np.lexsort((eight[at + 8], eight[at]))
    at = at[order]
    first, second = eight[at], eight[at + 8]
    new = np.ones(len(at), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    group, classes = np.cumsum(new), np.arange(len(at))
    live = np.arange(len(at))
    while True:
        begin, size = _runs(group)
        many = np.repeat(size > 1, size)
        live, group = live[many], group[many]
        if not len(live):
            return order, classes
        begin, size = _runs(group)
        pivot = np.repeat(live[begin + size // 2], size)  # of each group of ties; the others fall below, beside or above it
        p, q = at[live], at[pivot]
        d = shifts[p % PERIOD, q % PERIOD]
        side = np.sign(ranks[p + d] - ranks[q + d])
        end_p, end_q = eight[p + width - 8], eight[q + width - 8]
        side = np.where(side != 0, side, (end_p > end_q).astype(np.int32) - (end_p < end_q))
        same = side == 0
        classes[live[same]] = pivot[same]
        live, group = live[~same], group[~same] * 2 + (side[~same] > 0)
        order_ = np.argsort(group, kind="stable")
        live, group = live[order_], group[order_]
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group


STRETCHES = "bucket bigint, kind int, ids binary, refs binary, starts binary, windows binary, cells binary, texts binary"
STRETCH_NAMES = ["bucket", "kind", "ids", "refs", "starts", "windows", "cells", "texts"]
MARKED = "id bigint, ref bigint, mark bigint"


def _repeats(data: np.ndarray, eight: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray, refs: np.ndarray, starts: np.ndarray, width: int, gram: int):
    """Of stretches (count windows from first): whether an equal one here has a smaller id, and whether one is the same windows of the same text. Bytes decide."""
    later, same = np.zeros(len(first), bool), np.zeros(len(first), bool)
    if len(first) < 2:
        return later, same
    size = count + width - 1
    back = min(width, width - gram + 1) // 8 * 8 + 8  # the longest stretch has 2 * width - gram bytes
    whole = _chained([count.astype(U64), *(eight[first + o] for o in _steps(width)), *(eight[first + size - o] for o in range(8, min(back, width) + 1, 8))])
    order = np.argsort(whole)
    _, n = _runs(whole[order])
    some = order[np.repeat(n > 1, n)]
    if not len(some):
        return later, same
    some = some[np.lexsort((starts[some], refs[some], ids[some], whole[some]))]
    at, n = _runs(whole[some])
    head = np.repeat(some[at], n)
    raw = data.tobytes()
    twin = np.array([raw[a : a + k] == raw[b : b + j] for a, k, b, j in zip(first[some].tolist(), size[some].tolist(), first[head].tolist(), size[head].tolist(), strict=True)])
    later[some] = twin & (ids[some] > ids[head])
    before = np.concatenate([some[:1], some[:-1]])
    same[some] = twin & (some != head) & (ids[some] == ids[before]) & (refs[some] == refs[before]) & (starts[some] == starts[before]) & (whole[some] == whole[before]) & ~later[some]
    return later, same


def marked_suffixes(texts: DataFrame, hot, width: int, gram: int, buckets: int) -> DataFrame:
    """Rows (id, ref, mark) from (id, ref, text, places): runs of suffixes whose first bytes a text with a smaller id has, as
    start * 2**32 + windows. hot: a broadcast of hot_names()."""

    def stretches(batches):
        seen: dict[bytes, int] = {}  # strings of hot sides shipped by this task, with their least ids
        half = _half(width, gram)
        for batch in batches:
            places = batch.schema.get_field_index("places")
            for part, column in slices(batch, "text", SHIP_BYTES):
                data, offsets = buffers(column)
                place, name, first, count = samples(data, offsets, width, gram)
                text = np.searchsorted(offsets, place, "right") - 1
                wanted = np.zeros(2 * len(data), bool)
                for x, o in zip(part.column(places).to_pylist(), offsets.tolist(), strict=False):
                    wanted[np.frombuffer(x, np.uint32).astype(np.int64) + 2 * o] = True
                lefts = np.clip(place - half + 1 - first, 0, count)  # windows of the left side
                take = [wanted[2 * place] & (lefts > 0), wanted[2 * place + 1] & (lefts < count)]
                apart = in_bitmap(hot.value, _hot_bits(name & ~U64(0xFFFFFFFF)))
                # A gram's sides travel together, unless it is hot.
                whole = ~apart & (take[0] | take[1])
                made = [(name[whole], text[whole], np.where(take[0], first, first + lefts)[whole], (lefts * take[0] + (count - lefts) * take[1])[whole])]
                for side, begin, n in ((0, first, lefts), (1, first + lefts, count - lefts)):
                    own = np.flatnonzero(apart & take[side])
                    key = _side(name[own], side)
                    alone = in_bitmap(hot.value, _hot_bits(key))
                    made.append((mixed(key[~alone]), text[own[~alone]], begin[own[~alone]], n[own[~alone]]))
                    own = own[alone]  # hot sides: suffixes one by one
                    c = n[own]
                    made.append((np.zeros(c.sum(), U64), np.repeat(text[own], c), np.repeat(begin[own] - np.cumsum(c) + c, c) + np.arange(c.sum()), np.ones(c.sum(), np.int64)))
                alone = np.repeat([False, False, True, False, True], [len(m[0]) for m in made])
                name, text, first, count = (np.concatenate(c) for c in zip(*made, strict=True))
                if not len(first):
                    continue
                eight = eights(np.concatenate([data, np.zeros(8, np.uint8)]), len(data))
                if alone.any():
                    name[alone] = mixed(_chained(eight[first[alone] + o] for o in _steps(width)))
                ids, refs = (np.asarray(part.column(i)).astype(np.int64)[text] for i in (0, 1))
                start = first - offsets[text]
                bucket, cell = _bucket(name, buckets), (mixed(name >> U64(32)) & U64(0xFF)).astype(np.uint8)
                # Equal stretches of this slice: the one with the least id goes on, later ids are marked here.
                later, same = _repeats(data, eight, first, count, ids, refs, start, width, gram)
                raw = data.tobytes()
                n = count + width - 1
                for i in np.flatnonzero(alone & ~later & ~same).tolist():
                    string, id_ = raw[first[i] : first[i] + width], int(ids[i])
                    least = seen.get(string)
                    if least is None or id_ < least:
                        seen[string] = id_
                    elif id_ > least:
                        later[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                for kind, some in ((1, later), (0, ~later & ~same)):
                    own = np.flatnonzero(some)
                    own = own[np.lexsort((cell[own], bucket[own]))]
                    if not len(own):
                        continue
                    at, size = _runs(bucket[own])
                    cols = _cut(at, size, ids[own], refs[own], start[own].astype(np.uint32), count[own].astype(np.uint16), cell[own])
                    body = pa.nulls(len(at), pa.binary()) if kind else pa.array([b"".join([raw[f : f + k] for f, k in zip(first[own[a : a + s]].tolist(), n[own[a : a + s]].tolist(), strict=True)]) for a, s in zip(at.tolist(), size.tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[own][at], pa.int64()), pa.array(np.full(len(at), kind, np.int32)), *cols, body], STRETCH_NAMES)

    def sort_buckets(table: pa.Table) -> pa.Table:
        kinds = (("ids", np.int64), ("refs", np.int64), ("starts", np.uint32), ("windows", np.uint16), ("cells", np.uint8))
        marks = []
        direct = table.filter(pa.compute.equal(table["kind"], 1))
        if len(direct):
            marks.append([np.frombuffer(b"".join(direct[c].to_pylist()), t) for c, t in kinds[:4]])
        table = table.filter(pa.compute.equal(table["kind"], 0))
        if len(table):
            ids, refs, starts, counts, cells = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in kinds)
            counts = counts.astype(np.int64)
            data = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
            begin = np.cumsum(counts + width - 1) - (counts + width - 1)
            per_cell = np.cumsum(np.bincount(cells, counts + width - 1, 256))
            lo = 0
            while lo < 256:  # one bucket at a time
                hi = max(lo + 1, int(np.searchsorted(per_cell, (per_cell[lo - 1] if lo else 0) + SORT_BYTES, "right")))
                own = np.flatnonzero((cells >= lo) & (cells < hi))
                lo = hi
                if not len(own):
                    continue
                bytes_, base = _gathered(data, begin[own], counts[own] + width - 1)
                eight = eights(np.concatenate([bytes_, np.zeros(8, np.uint8)]), len(bytes_))
                later, same = _repeats(bytes_, eight, base, counts[own], ids[own], refs[own], starts[own], width, gram)
                if later.any():
                    marks.append([x[own[later]] for x in (ids, refs, starts, counts)])
                if later.any() or same.any():
                    bytes_, base_ = _gathered(bytes_, base[~later & ~same], (counts[own] + width - 1)[~later & ~same])
                    own, base = own[~later & ~same], base_
                c = counts[own]
                inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                order, classes = sorted_suffixes(bytes_, np.repeat(base, c) + inner, width)
                owner = np.repeat(own, c)
                id_ = ids[owner[order]]
                least = np.full(len(order), LAST)
                np.minimum.at(least, classes, id_)
                hit = np.sort(order[id_ > least[classes]])
                if len(hit):
                    new = np.concatenate([[True], (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])])
                    at = np.flatnonzero(new)
                    o = owner[hit[at]]
                    marks.append([ids[o], refs[o], starts[o] + inner[hit[at]], np.diff(np.append(at, len(hit)))])
        id_, ref, start, windows = (np.concatenate([m[i] for m in marks]).astype(np.int64) if marks else np.zeros(0, np.int64) for i in range(4))
        return pa.table([pa.array(id_), pa.array(ref), pa.array(start << 32 | windows)], ["id", "ref", "mark"])

    return texts.mapInArrow(lean(stretches), STRETCHES).groupBy("bucket").applyInArrow(lean(sort_buckets), MARKED)


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte runs from each begin, one behind the other, and where they begin there."""
    base = np.cumsum(size) - size
    return data[np.repeat(begin - base, size) + np.arange(size.sum())], base


def removed_runs(marks: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [start, end) of a text from its marked suffixes, start * 2**32 + windows."""
    marks = np.sort(marks)
    pairs = np.stack([marks >> 32, marks & 0xFFFFFFFF], 1)
    ends = np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1 + width)
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    at = np.flatnonzero(new)
    return list(zip(pairs[at, 0].tolist(), ends[np.append(at[1:], len(ends)) - 1].tolist(), strict=True))


def repeated_spans(docs: DataFrame, slim: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (own, ref, marks) for the earliest row of each distinct text that has marked windows; own: the id, null last.
    slim: (own, ref, n_bytes) of all rows."""
    own = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(own.alias("own"), F.xxhash64(text).alias("ref"), text.alias("text"))
    sizes = staged(slim.groupBy("ref", F.col("n_bytes").alias("n")).agg(F.min("own").alias("own")), "passages-texts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, math.ceil(total / BUCKET_BYTES))
    found = shared_samples(source.select("ref", "text").where(F.octet_length("text") >= width), width, gram, buckets)
    found = staged(found, "passages-grams")
    hot = docs.sparkSession.sparkContext.broadcast(hot_names(found))
    found = found.where("part is not null").groupBy("part").applyInArrow(lean(places_of), "ref bigint, places binary")
    found = found.join(sizes, "ref").select("own", "ref", "places")
    found = staged(found, "passages-samples")
    texts = _with_texts(source, found).select(F.col("own").alias("id"), "ref", "text", "places")
    marks = marked_suffixes(texts, hot, width, gram, buckets).groupBy("id", "ref").agg(F.collect_list("mark").alias("marks"))
    return staged(marks.select(F.col("id").alias("own"), "ref", "marks"), "passages-marks")


def _with_texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (own, ref, ...) with their texts; a bitmap keeps other texts out of the shuffle."""
    keys = bitmap_of(wanted.select(F.xxhash64("own", "ref").alias("key")), "key")
    near = with_hit(source.withColumn("key", F.xxhash64("own", "ref")), keys, "key", "hit").where("hit").drop("key", "hit")
    return near.join(wanted, ["own", "ref"])


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs [start, end))."""
    own = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(own.alias("own"), F.xxhash64(text).alias("ref"), text.alias("text"))
    slim = staged(docs.select(F.col(f"`{id_col}`").alias("id"), own.alias("own"), F.xxhash64(text).alias("ref"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "passages-rows")
    marks = repeated_spans(docs, slim, id_col, text_col, width, gram)

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            offsets, marked = batch.column(3).offsets.to_pylist(), np.asarray(batch.column(3).values)
            for t, a, b in zip(batch.column(2).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                data, runs = t.encode(), removed_runs(marked[a:b], width)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["own", "ref", "n_removed", "n_spans", "kept_sha256", "spans"])

    spans = "array<struct<start:bigint,end:bigint>>"
    done = _with_texts(source, marks).select("own", "ref", "text", "marks").mapInArrow(lean(cut), f"own bigint, ref bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {spans}")
    done = done.dropDuplicates(["own", "ref"])
    copies = staged(slim.groupBy("ref", "sha").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most").select("ref", "sha", "least"), "passages-copies")
    rows = slim.join(copies, ["ref", "sha"], "left").join(done, ["own", "ref"], "left")
    copy = (F.col("own") > F.col("least")) & (F.col("n_bytes") >= width)
    pick = lambda c, if_copy, none: F.when(copy, if_copy).otherwise(F.coalesce(F.col(c), none))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    return rows.select("id", "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0)).alias("n_removed"), pick("n_spans", F.lit(1), F.lit(0)).cast("bigint").alias("n_spans"), pick("kept_sha256", F.sha2(F.lit(""), 256), F.col("sha")).alias("kept_sha256"), pick("spans", whole, F.array().cast(spans)).alias("spans"))


ship(__name__)
