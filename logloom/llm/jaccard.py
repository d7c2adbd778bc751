"""Operator 8: exact self-join of documents on Jaccard similarity of word n-grams (default: 5 words, 0.75).

Documents with equal sets are one class. Classes pass three filters, all without loss, before
the rest is verified:

1. Sampled prefix. Tokens (64-bit hashes of shingles) are ordered by hash. Of two similar sets x and y both
   have their first `l` common tokens among the first n - ceil(t n) + l of their own. So a class
   stays only if enough tokens of its extended prefix occur in another class.
2. Token combinations. Among the classes left, tokens are ordered by frequency, rare first. A pair whose
   first common token is rare shares it as a single key of both prefixes. Otherwise its first
   two common tokens are frequent, both lie in the prefixes extended by one, and the pair of tokens is the
   key. A class with more than COMBINE frequent prefix tokens is "long": it takes no combinations, and
   every class keeps its frequent single tokens as keys that only meet long classes.
   Of the classes of a key only those stay that can link with another one of it: two sets have no more tokens in common
   than either has that any other class has, which bounds their similarity by their sizes (reach()). Letters that
   share most of their words, but not enough to link, are told apart here, without looking at a pair.
3. Verification. Classes that share a key are candidates. In each of ROUNDS rounds a class is verified against one
   other, the head that most of its keys name, by a join: in a group of copies nearly all link to its few heads, in work
   that grows with the group. A key all of whose classes are linked by then is closed: none of its pairs is needed.
   The classes of keys still open form blocks (connected components over those keys), which are verified in
   tiles of bounded bytes with matrix products; a tile yields a spanning forest of its links, never its
   pairs. Links' components are the result.

Tokens travel packed by hash bucket, the number of buckets grows with the corpus, and a token that a
third of all documents share is one entry a slice of a scan. Only counts come to the driver.

Defined cases: words are runs of bytes other than white space, A-Z lowered; with fewer words than the shingle
the whole sequence is one token; null, empty and blank texts have no token and link with nothing;
rows that repeat are linked by their equal sets; a null id never is the least unless all of a component
are null; an empty table gives an empty result. Two 64-bit token digests are taken as equal shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import FILTER_BITS, U64, bitmap_bytes, bitmap_of, buffers, in_bitmap, lean, lowered, mixed, ship, slices, staged, text_column, with_hit, words, words_hash
from .components import components

#: Extra share of a set in the sampled prefix: more entries, fewer classes left.
EXTRA = 0.1
#: A token in more classes than this is frequent.
FREQUENT = 48
#: Frequent prefix tokens of a class up to which their pairs are keys.
COMBINE = 64
#: Rounds of verification against one head each.
ROUNDS = 1
#: Classes and bytes of tokens on a side of a verification tile.
TILE, TILE_BYTES = 512, 4 << 20
#: Entries of a bucket, about.
BUCKET_ENTRIES = 1_000_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, tokens): the sorted distinct tokens of each text; and the number of each text's words."""
    data, offsets = buffers(texts)
    data = lowered(data)
    start, end, row = words(data, offsets)
    counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
    hashed = words_hash(data, start, end)
    mult = mixed(np.arange(1, k + 1, dtype=U64))
    first = np.concatenate([[0], np.cumsum(counts)])
    inside = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    total = np.zeros(len(inside), U64)
    for j in range(k):
        total += hashed[inside + j] * mult[j]
    owners, tokens = [row[inside]], [mixed(total)]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        own = [mixed(np.array([(hashed[first[i] : first[i + 1]] * mult[: counts[i]]).sum() + U64(counts[i])], U64))[0] for i in few]
        owners.append(few)
        tokens.append(np.array(own, U64))
    owner, token = np.concatenate(owners), np.concatenate(tokens)
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
    owner, token = owner[new], token[new]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64), token, counts


def fingerprints(offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two int64 columns."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(tokens ^ U64(salt)), dtype=U64)])
        out.append(mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64) * U64(salt)).view(np.int64))
    return out[0], out[1]


def needed(n: int, percent: int) -> int:
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def extra(n):
    return np.floor(EXTRA * np.asarray(n)).astype(np.int64) + 1


def _bucketed(token: np.ndarray, count: int) -> np.ndarray:
    return (mixed(token ^ U64(0xA0761D6478BD642F)) >> U64(33)).astype(np.int64) % count


def _packs(bucket: np.ndarray, ref: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, refs, runs, tokens): in each bucket the distinct refs, the length of each one's run, its tokens."""
    order = np.lexsort((ref, bucket))
    bucket, ref, token = bucket[order], ref[order], token[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        r = ref[a:b]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        rows[0].append(int(bucket[a]))
        rows[1].append(r[at].tobytes())
        rows[2].append(np.diff(np.append(at, b - a)).astype(np.uint32).tobytes())
        rows[3].append(token[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["bucket", "refs", "runs", "tokens"])


PACKED = "bucket bigint, refs binary, runs binary, tokens binary"


def _unpacked(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ref, token) entries of a bucket's packs; repeats of an entry left out."""
    refs, tokens = [], []
    for r, n, t in zip(table["refs"].to_pylist(), table["runs"].to_pylist(), table["tokens"].to_pylist(), strict=True):
        refs.append(np.repeat(np.frombuffer(r, np.int64), np.frombuffer(n, np.uint32)))
        tokens.append(np.frombuffer(t, kind))
    ref, token = np.concatenate(refs), np.concatenate(tokens)
    order = np.lexsort((ref, token))
    ref, token = ref[order], token[order]
    new = np.ones(len(ref), bool)
    new[1:] = (ref[1:] != ref[:-1]) | (token[1:] != token[:-1])
    return ref[new], token[new]


def _frequencies(token: np.ndarray) -> np.ndarray:
    """How often the token of each entry occurs (tokens sorted)."""
    at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(at, len(token)))
    return np.repeat(sizes, sizes)


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows (id, n, f1, f2): the size and the fingerprint of every document's set."""

    def rows(batches):
        for batch in batches:
            for part, column in slices(batch, "text"):
                offsets, tokens, _ = shingle_sets(column, k)
                f1, f2 = fingerprints(offsets, tokens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(f1), pa.array(f2)], ["id", "n", "f1", "f2"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(lean(rows), f"id {source.schema['id'].dataType.simpleString()}, n bigint, f1 bigint, f2 bigint")


def prefix_counts(docs: DataFrame, text_col: str, k: int, percent: int, buckets: int) -> DataFrame:
    """Rows (ref, shared): tokens of each class's extended hash prefix that another class's prefix has too."""

    def entries(batches):
        for batch in batches:
            for _, column in slices(batch, "text"):
                offsets, tokens, _ = shingle_sets(column, k)
                f1, _ = fingerprints(offsets, tokens)
                _, one = np.unique(f1, return_index=True)  # copies in this slice once
                n = np.diff(offsets)
                length = np.minimum(n, n - -(-percent * n // 100) + extra(n))
                keep = np.zeros(len(n), bool)
                keep[one] = True
                length[~keep] = 0
                place = np.repeat(offsets[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                token = tokens[place]
                bucket = _bucketed(token, buckets)
                # 40 bits a token within its bucket: a chance match only lets a class through to the next filter.
                short = (mixed(token) >> U64(24)).astype("<u8")
                order = np.lexsort((np.repeat(f1, length), bucket))
                made = _packs(bucket[order], np.repeat(f1, length)[order], short[order])
                trimmed = [np.frombuffer(t, np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in made.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*made.columns[:3], pa.array(trimmed, pa.binary())], made.schema.names)

    def counts(table: pa.Table) -> pa.Table:
        wide = []
        for t in table["tokens"].to_pylist():
            full = np.zeros((len(t) // 5, 8), np.uint8)
            full[:, :5] = np.frombuffer(t, np.uint8).reshape(-1, 5)
            wide.append(full.tobytes())
        ref, token = _unpacked(table.set_column(3, "tokens", pa.array(wide, pa.binary())), np.uint64)
        shared = ref[_frequencies(token) > 1]
        found, number = np.unique(shared, return_counts=True)
        return pa.table([pa.array(found, pa.int64()), pa.array(number, pa.int64())], ["ref", "shared"])

    packed = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(entries), PACKED)
    return packed.groupBy("bucket").applyInArrow(lean(counts), "ref bigint, shared bigint").groupBy("ref").agg(F.sum("shared").alias("shared"))


def token_profiles(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, buckets: int) -> DataFrame:
    """Rows (ref, n, tokens, df) of the given classes (id, n, f1, f2): the set's tokens that another of the
    classes has, as packed uint64, and in how many classes each is, as packed uint32; ordered by (df, token).

    Rows of a class are told by two bitmaps, of ids and of f1, and the sizes travel beside the tokens: no token is shuffled
    for a join. What a bitmap lets through by chance may raise a df, the same for all classes, and has no row."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    wanted = bitmap_of(classes.select(F.xxhash64("id").alias("key")), "key")
    likely = with_hit(source.withColumn("key", F.xxhash64("id")), wanted, "key", "hit").where("hit").select("text")
    bits = bitmap_bytes(classes.select((F.pmod("f1", F.lit(1 << FILTER_BITS)) + 1).alias("bit")))

    def entries(batches):
        refs, lists, held = [], [], 0
        for batch in batches:
            for _, column in slices(batch, "text"):
                offsets, tokens, _ = shingle_sets(column, k)
                f1, _ = fingerprints(offsets, tokens)
                _, one = np.unique(f1, return_index=True)  # copies in this slice once
                keep = np.zeros(len(f1), bool)
                keep[one] = True
                keep &= in_bitmap(bits, f1 & ((1 << FILTER_BITS) - 1))
                n = np.diff(offsets)
                refs.append(np.repeat(f1[keep], n[keep]))
                lists.append(tokens[np.repeat(keep, n)])
                held += len(lists[-1])
                if held > 1 << 18:
                    token = np.concatenate(lists)
                    yield _packs(_bucketed(token, buckets), np.concatenate(refs), token)
                    refs, lists, held = [], [], 0
        if held:
            token = np.concatenate(lists)
            yield _packs(_bucketed(token, buckets), np.concatenate(refs), token)

    def dealt(ref: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
        """Parts of classes, a row each whatever the number of its classes: (part, refs, the other columns of its entries)."""
        part = (mixed(ref.view(U64)) >> U64(33)).astype(np.int64) % buckets
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        runs = list(zip(at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True)) if len(part) else []
        return [pa.array(part[at], pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in runs], pa.binary()) for x in (c[order] for c in (ref, *columns)))]

    def shared(table: pa.Table) -> pa.Table:
        """The bucket's shared tokens, dealt to parts of classes."""
        ref, token = _unpacked(table, U64)
        df = _frequencies(token)
        keep = df > 1
        return pa.table(dealt(ref[keep], token[keep], df[keep].astype(np.uint32)), ["part", "refs", "t", "d"])

    def sizes(batches):
        """The classes' sizes, dealt like their tokens; d is null."""
        for batch in batches:
            made = dealt(*(np.asarray(batch.column(i)) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(made[0]), pa.binary())], ["part", "refs", "t", "d"])

    def ordered(table: pa.Table) -> pa.Table:
        """The part's classes, each with its size and its tokens by (df, token)."""
        size, rest = table.filter(pc.is_null(table["d"])), table.filter(pc.is_valid(table["d"]))
        ref, token, df = (np.frombuffer(b"".join(rest[c].to_pylist()), t) for c, t in (("refs", np.int64), ("t", U64), ("d", np.uint32)))
        known, n = (np.frombuffer(b"".join(size[c].to_pylist()), np.int64) for c in ("refs", "t"))
        order = np.lexsort((n, known))
        known, n = known[order], n[order]
        order = np.lexsort((token, df, ref))
        order = order[np.isin(ref[order], known)]
        ref, token, df = ref[order], token[order], df[order]
        at = np.flatnonzero(np.concatenate([[True], ref[1:] != ref[:-1]])) if len(ref) else np.zeros(0, np.int64)
        runs = list(zip(at.tolist(), np.append(at[1:], len(ref)).tolist(), strict=True)) if len(ref) else []
        return pa.table([pa.array(ref[at], pa.int64()), pa.array(n[np.searchsorted(known, ref[at])], pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in runs], pa.binary()) for x in (token, df))], ["ref", "n", "tokens", "df"])

    kind = "part bigint, refs binary, t binary, d binary"
    parts = likely.mapInArrow(lean(entries), PACKED).groupBy("bucket").applyInArrow(lean(shared), kind)
    parts = parts.unionByName(classes.select("f1", "n").mapInArrow(lean(sizes), kind))
    return parts.groupBy("part").applyInArrow(lean(ordered), "ref bigint, n bigint, tokens binary, df binary")


def class_keys(n: int, token: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(rare single keys, frequent single keys, pair keys, long) of a class."""
    unshared = n - len(token)
    reach = n - needed(n, percent)  # tokens that may miss
    one, two = reach + 1 - unshared, reach + 2 - unshared
    if one <= 0:
        return (np.zeros(0, U64),) * 3 + (False,)
    rare = token[:one][df[:one] <= FREQUENT]
    often = token[:two][df[:two] > FREQUENT]
    single = token[:one][df[:one] > FREQUENT]
    if len(often) > COMBINE:
        return rare, single, np.zeros(0, U64), True
    i, j = np.triu_indices(len(often), 1)
    # Where a set needs one common token only, there may be no second one.
    pairs = mixed(often[i] * U64(0x9E3779B97F4A7C15) + mixed(often[j])) if needed(n, percent) >= 2 else single
    return rare, single, pairs, False


def reach(n: np.ndarray, shared: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of classes with n tokens, some of them shared: two can link only if high of each is at least low of the other.

    100 * common >= percent * (n + m - common) and common <= shared give ((100 + percent) * shared - percent * n) / percent >= m. Both sides as
    64ths of a binary logarithm, rounded so that no pair is lost.
    """
    most = np.maximum(((100 + percent) * shared.astype(float) - percent * n) / percent, 1)
    return np.floor(np.log2(n) * 64 * (1 - 1e-12)).astype(np.uint16), np.ceil(np.log2(most) * 64 * (1 + 1e-12)).astype(np.uint16)


def can_link(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each entry's group has an entry (itself too, if it reaches itself) with which it can link."""
    if not len(group):
        return np.zeros(0, bool)
    _, dense = np.unique(group, return_inverse=True)
    place = dense.astype(np.int64) << 16
    order = np.argsort(place | low, kind="stable")
    lows = (place | low)[order]
    best = np.maximum.accumulate((place | high)[order])  # the groups rise, so each begins anew
    at = np.searchsorted(lows, place | high, "right") - 1  # the last of the group that this entry reaches
    return (at >= 0) & (best[at] >= (place | low)) & (lows[at] >> 16 == dense)


def _keyed(profiles: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Packs of (component, class, key, reach) entries of profiles (ref, n, tokens, df, component)."""

    def entries(batches):
        for batch in batches:
            refs, keys = [], []
            held = 0

            def flush():
                key = np.concatenate(keys)
                sizes = [c for *_, c in refs]
                own, ref = (np.repeat(np.array([r[i] for r in refs], np.int64), sizes) for i in (0, 1))
                low, high = reach(np.array([r[2] for r in refs]), np.array([r[3] for r in refs]), percent)
                fit = np.repeat(low.astype(np.uint32) << 16 | high, sizes)
                order = np.argsort(_bucketed(key & ~U64(3), buckets), kind="stable")
                key, own, ref, fit = key[order], own[order], ref[order], fit[order]
                bucket = _bucketed(key & ~U64(3), buckets)
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                runs = list(zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True))
                return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in runs], pa.binary()) for x in (own, ref, key, fit))], ["bucket", "components", "refs", "tokens", "fits"])

            for ref, n, t, d, component in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rare, single, pairs, long = class_keys(n, np.frombuffer(t, U64), np.frombuffer(d, np.uint32), percent)
                # Three key spaces, told apart by the low bits: rare and pair keys; frequent keys of long and of other classes.
                space = ~U64(3)
                own = np.unique(np.concatenate([rare & space, (pairs & space) | U64(1), (single & space) | U64(3 if long else 2)]))
                if len(own):
                    refs.append((component, ref, n, len(t) // 8, len(own)))
                    keys.append(own)
                    held += len(own)
                if held > 1 << 17:
                    yield flush()
                    refs, keys, held = [], [], 0
            if keys:
                yield flush()

    columns = ["ref", "n", "tokens", "df", "component"]
    return profiles.select(*columns).mapInArrow(lean(entries), "bucket bigint, components binary, refs binary, tokens binary, fits binary")


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(component, class, kind, group) of a bucket's entries that can link with another one of their key."""
    own, ref, key, fit = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("components", np.int64), ("refs", np.int64), ("tokens", U64), ("fits", np.uint32)))
    kind = key & U64(3)
    group = np.where(kind == 3, key & ~U64(1), key)  # frequent single keys meet whether long or not
    keep = can_link(group, (fit >> 16).astype(np.int64), (fit & 0xFFFF).astype(np.int64))
    return own[keep], ref[keep], kind[keep], group[keep]


def _open_keys(table: pa.Table, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, head) entries of a bucket's keys that have classes of two components: the head is the key's first class in
    an order by hash, of a frequent key its first long class; entries with the head's component are left out."""
    own, ref, kind, group = _entries(table)
    order = np.lexsort((mixed(ref.view(U64) ^ U64(salt)), kind != 3, group))  # long classes first
    own, ref, group, kind = own[order], ref[order], group[order], kind[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    head = np.repeat(first, np.diff(np.append(first, len(group))))
    meets = (kind[head] != 2) & (own[head] != own)  # a frequent key without a long class joins nothing
    return ref[meets], ref[head][meets]


def open_pairs(profiles: DataFrame, percent: int, buckets: int, salt: int) -> DataFrame:
    """Rows (ref, head, c): how many open keys of a class have a head, by bucket. A class in no open key is in no row."""

    def counted(table: pa.Table) -> pa.Table:
        u, v = _open_keys(table, salt)
        pairs, count = np.unique(np.stack([u, v]), axis=1, return_counts=True) if len(u) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        return pa.table([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(count, pa.int64())], ["ref", "head", "c"])

    return _keyed(profiles, percent, buckets).groupBy("bucket").applyInArrow(lean(counted), "ref bigint, head bigint, c bigint")


def heads(pairs: DataFrame) -> DataFrame:
    """Rows (ref, head): for each class with an open key the head that most of its open keys have."""
    return pairs.groupBy("ref", "head").agg(F.sum("c").alias("c")).groupBy("ref").agg(F.max(F.struct("c", "head"))["head"].alias("head"))


def only(profiles: DataFrame, refs: DataFrame) -> DataFrame:
    """The profiles whose ref is among refs (ref), and few others: by a bitmap, so no token is shuffled."""
    return with_hit(profiles, bitmap_of(refs, "ref"), "ref", "hit").where("hit").drop("hit")


def still_open(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (ref) of all classes that can have an open key, by the first round's pairs (ref, head) and the components (node,
    component) since: a key's classes are its head and those that name it, so where one is not of its head's component all stay."""
    component = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    named = pairs.select("ref", "head")
    placed = named.join(component("ref"), "ref", "left").join(component("head"), "head", "left")
    heads = placed.where(F.coalesce("of_ref", "ref") != F.coalesce("of_head", "head")).select("head").distinct()
    return named.join(heads, "head", "left_semi").select("ref").unionByName(heads.select(F.col("head").alias("ref")))


def head_links(profiles: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the pairs of named (ref, head), each verified on its two sets."""

    @F.arrow_udf("boolean")
    def linked(n: pa.Array, tokens: pa.Array, m: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for a, t, b, o in zip(n.to_pylist(), tokens.to_pylist(), m.to_pylist(), others.to_pylist(), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(t, U64), np.frombuffer(o, U64)]))
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (a + b - common))
        return pa.array(out, pa.bool_())

    own = profiles.select("ref", "n", "tokens")
    other = only(own, named.select(F.col("head").alias("ref"))).select(F.col("ref").alias("head"), F.col("n").alias("m"), F.col("tokens").alias("others"))
    pairs = named.join(only(own, named.select("ref")), "ref").join(other, "head")
    return pairs.where(linked("n", "tokens", "m", "others")).select(F.col("ref").alias("u"), F.col("head").alias("v"))


def key_edges(profiles: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (u, v) between classes that share an open key, as a spanning forest of each bucket of keys.

    A class of the head's own component needs no verification with it, but with the key's others: it is joined by the forest's
    edges of its component, so all classes of an open key are in one block.
    """

    def forest(table: pa.Table) -> pa.Table:
        own, ref, kind, group = _entries(table)
        order = np.lexsort((ref, kind != 3, group))  # long classes first
        own, ref, group, kind = own[order], ref[order], group[order], kind[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        head = np.repeat(first, size)
        open_ = np.repeat(np.logical_or.reduceat(own != own[head], first), size) if len(first) else np.zeros(0, bool)
        meets = open_ & (kind[head] != 2) & (ref[head] != ref)  # a frequent key without a long class joins nothing
        u, v = ref[meets], ref[head][meets]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = parent[x]
            return x

        pairs = np.unique(np.stack([u, v]), axis=1) if len(u) else np.zeros((2, 0), np.int64)
        made = ([], [])
        for a, b in pairs.T.tolist():
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                made[0].append(a)
                made[1].append(b)
        return pa.table([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64())], ["u", "v"])

    return _keyed(profiles, percent, buckets).groupBy("bucket").applyInArrow(lean(forest), "u bigint, v bigint")


def tile_links(refs: np.ndarray, sizes: np.ndarray, lists: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among classes: pairs (i, j) with 100 * common >= percent * union."""
    c = len(refs)
    if c < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(c), [len(x) for x in lists])
    found, column = np.unique(np.concatenate(lists), return_inverse=True)
    # A token of one class only counts for nothing here.
    keep = (np.bincount(column, minlength=len(found)) > 1)[column]
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((c, c), np.float32)
    step = max(64, (1 << 23) // c)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((c, step), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common.astype(np.float64) >= percent * union
    np.fill_diagonal(linked, False)
    # Spanning forest by breadth-first search over the matrix.
    left, us, vs = np.ones(c, bool), [], []
    for s in range(c):
        if not left[s]:
            continue
        left[s] = False
        edge = [s]
        while edge:
            x = edge.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            us.extend([x] * len(new))
            vs.extend(new.tolist())
            edge.extend(new.tolist())
    return refs[np.array(us, np.int64)], refs[np.array(vs, np.int64)]


def block_links(profiles: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within blocks (node, component): a spanning forest of every tile.

    Classes already linked with each other (profiles.component) need no verification among themselves. So a component that fills
    half a part has parts of its own, all other classes of a block share the rest of its parts, and a tile holds two parts that are
    not of one component (or a block's only part). A part has about TILE classes and TILE_BYTES of tokens, dealt by hash.
    """
    rows = only(profiles, blocks.select(F.col("node").alias("ref"))).select("ref", "n", "tokens", F.col("component").alias("linked"))
    placed = blocks.join(rows.select("ref", "linked", F.octet_length("tokens").cast("bigint").alias("bytes")), blocks["node"] == F.col("ref")).drop("node")
    groups = staged(placed.groupBy("component", "linked").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes")), "jaccard-groups")
    own = F.when(F.greatest(F.col("c") / TILE, F.col("bytes") / TILE_BYTES) >= 0.5, F.col("linked"))  # null: shares the rest
    groups = groups.withColumn("own", own)
    sized = groups.groupBy("component", "own").agg(F.ceil(F.greatest(F.sum("c") / TILE, F.sum("bytes") / TILE_BYTES)).cast("int").alias("parts"))
    parts = sized.groupBy("component").agg(F.collect_list(F.struct("own", "parts")).alias("all"))
    parts = parts.withColumn("all", F.flatten(F.transform("all", lambda g: F.transform(F.sequence(F.lit(0), g["parts"] - 1), lambda i: F.struct(g["own"].alias("own"), i.alias("part"), g["parts"].alias("parts"))))))
    named = placed.select("component", "linked", "ref").join(groups.select("component", "linked", "own"), ["component", "linked"]).join(parts, "component").drop("linked")
    mine = lambda x: x["own"].eqNullSafe(F.col("own"))
    named = named.withColumn("mine", F.filter("all", mine)[0])
    named = named.withColumn("mine", F.struct("own", F.pmod(F.xxhash64("ref"), F.col("mine.parts")).cast("int").alias("part"), F.col("mine.parts").alias("parts")))
    others = F.filter("all", lambda x: F.when(F.size("all") == 1, True).when(mine(x), F.col("own").isNull() & (x["part"] != F.col("mine.part"))).otherwise(True))
    tiles = named.withColumn("other", F.explode(others)).join(rows.drop("linked"), "ref")
    tiles = tiles.select("component", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "ref", "n", "tokens")

    def links(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(t, U64) for t in table["tokens"].to_pylist()]
        u, v = tile_links(np.asarray(table["ref"]), np.asarray(table["n"]), lists, percent)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return tiles.groupBy("component", "a", "b").applyInArrow(lean(links), "u bigint, v bigint")


def set_fingerprint(text: Column, k: int = 5) -> Column:
    """(f1, f2) of a text column's sets, as an Arrow UDF."""

    @F.arrow_udf("struct<f1: bigint, f2: bigint>")
    def fingerprint(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text_column(column)], ["text"])
        parts = [fingerprints(*shingle_sets(part, k)[:2]) for _, part in slices(batch, "text")]
        f1, f2 = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))
        return pa.StructArray.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["f1", "f2"])

    return fingerprint(text)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: the id (named id), n_shingles, component_id (the least id reachable by links)."""
    return linked_sets(docs, id_col, text_col, k, percent).select("id", F.col("n").alias("n_shingles"), "component_id")


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: id, n, the set's f1 and f2, component_id, and least: null where no other row is linked,
    else whether the set is the one of its component that holds the component's least id (one set, if several do)."""
    sketches = staged(sketch(docs, id_col, text_col, k), "jaccard-sketch")
    classes = sketches.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = staged(classes, "jaccard-classes")
    total = sketches.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, math.ceil(total * (1 - percent / 100 + EXTRA) / BUCKET_ENTRIES))
    counts = prefix_counts(docs, text_col, k, percent, buckets)
    least = F.floor(F.lit(EXTRA) * F.ceil(F.lit(percent) * F.col("n") / 100)) + 1
    # Of a similar pair the smaller set has needed(n) tokens at least; both prefixes hold that many common ones.
    alive = classes.join(counts, classes["f1"] == counts["ref"]).where(F.col("shared") >= least).select("id", "f1", "f2", "n")
    alive = staged(alive, "jaccard-alive")
    tokens = alive.agg(F.sum("n")).first()[0] or 0
    profiles = staged(token_profiles(docs, alive, id_col, text_col, k, max(16, math.ceil(tokens / BUCKET_ENTRIES))), "jaccard-profiles")
    buckets = max(16, math.ceil(tokens / BUCKET_ENTRIES))
    links, linked, first = None, None, None
    for turn in range(ROUNDS + 1):
        own = profiles.withColumn("component", F.col("ref"))
        if linked is not None:
            own = only(profiles, staged(still_open(first, linked), "jaccard-still"))
            own = own.join(linked, F.col("ref") == F.col("node"), "left").withColumn("component", F.coalesce("component", "ref")).drop("node")
            own = staged(own, "jaccard-placed")
        if turn < ROUNDS:
            pairs = staged(open_pairs(own, percent, buckets, 0x9E3779B97F4A7C15 + turn), "jaccard-pairs")
            if not turn:  # classes without an open key have no candidate, and never get one: what follows reads the others only
                first = pairs
                met = pairs.select("ref").unionByName(pairs.select(F.col("head").alias("ref")))
                profiles = staged(only(profiles, met), "jaccard-open")
            found = staged(head_links(profiles, staged(heads(pairs), "jaccard-heads"), percent), "jaccard-found")
        else:
            blocks = staged(components(key_edges(own, percent, buckets), "jaccard-blocks"), "jaccard-blocks")
            found = staged(block_links(own, blocks, percent), "jaccard-found")
        links = found if links is None else links.unionByName(found)
        linked = components(links, "jaccard-links")
    named = linked.join(classes.select(F.col("f1").alias("node"), "f2", "id"), "node")
    least_set = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "f2")).alias("m"))
    moved = linked.join(least_set, "component").select(F.col("node").alias("f1"), F.col("m.id").alias("linked_id"), F.col("m.node").alias("m1"), F.col("m.f2").alias("m2"))
    shown = [F.when(F.col("linked_id").isNull(), F.col("id")).otherwise(F.col("linked_id")).alias("component_id"), F.coalesce((F.col("f1") == F.col("m1")) & (F.col("f2") == F.col("m2")), F.lit(True)).alias("least")]
    final = staged(classes.where("copies > 1").select("f1", "f2", "n", "id").unionByName(classes.where("copies = 1").join(moved, "f1", "left_semi").select("f1", "f2", "n", "id")).join(moved, "f1", "left").select("f1", "f2", "n", *shown), "jaccard-classes")
    out = sketches.join(final, ["f1", "f2", "n"], "left")
    return out.select("id", "n", "f1", "f2", F.coalesce("component_id", "id").alias("component_id"), "least")


ship(__name__)
