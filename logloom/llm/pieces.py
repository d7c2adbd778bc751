"""Operator 6: SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

Documents up to GIANT characters are encoded word by word: where no piece has a space after another character, merges
never cross a space, so a batch's distinct words are encoded once by the library and their ids gathered.

Longer documents are cut into chunks at any character. A boundary's state is the token that covers or ends at the
cut. A chunk yields a transfer matrix from entry to exit states over the max-plus semiring. Matrices are combined
associatively, FAN neighbours at a time, level by level up to one matrix a document (combined()); on the way down each
product's end states settle the states between its factors, and every chunk then traces its own tokens back. No task
holds more than FAN matrices or one chunk of a document.

The public model is a byte-pair model: its tokens come from merges in order of score and are not the
path with the greatest sum of scores, so piece scores can't be the weights. What is additive is validity:
a sequence of tokens is the encoding of its text if each two neighbours are the encoding of their own
concatenation. Weights are thus 0 for such a pair and minus infinity for any other (sums of scores play no part), and the
one path of weight 0 is the encoding. Tests hold it against the library, whole text against whole text.

Defined cases: null and empty texts have no tokens; characters that no piece has become their UTF-8 bytes'
pieces; U+2581 decodes as a space, as in the library; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import SLICE_BYTES, fresh, lean, release, ship, slices, staged, text_column, worker_cache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a document is cut, and of a chunk.
GIANT, CHUNK = 65_536, 8_192
#: Neighbouring matrices that are combined at once.
FAN = 32
#: Distinct words whose ids a worker keeps from one slice to the next.
KEPT_WORDS = 150_000
SPACE = "▁"


class Words:
    """Ids of the words met so far: a slot for each in one array of ids. They only save time: what is dropped is encoded again."""

    def __init__(self):
        self.known = {"": 0}  # slot 0: no word
        self.pool, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def added(self, library, texts: list[str]) -> np.ndarray:
        """New slots with the ids of texts."""
        lists = library.encode(texts, num_threads=1) if texts else []
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        first = len(self.sizes)
        self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])
        return np.arange(first, first + len(lists))

    def slots(self, library, words: list[str]) -> np.ndarray:
        if len(self.sizes) > KEPT_WORDS:
            self.__init__()
        known = self.known
        out = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        asked = [words[i] for i in missing.tolist()]
        new = list(dict.fromkeys(asked))
        known.update(zip(new, self.added(library, new).tolist(), strict=True))
        out[missing] = np.fromiter(map(known.get, asked), np.int64, len(asked))
        return out


class PieceModel:
    """A SentencePiece model's library processor, its pieces and the pairwise validity of tokens."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.library.get_piece_size()
        names = self.library.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: self.library.get_score(i) for i in plain}
        self.bytes = {b: self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.unknown = self.library.unk_id()
        #: Merges never cross a space.
        self.by_word = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.words = Words()
        # Bytes of each id for decoding; None where the library has a rule of its own.
        raw: list[bytes | None] = [None] * n
        for name, i in self.ids.items():
            raw[i] = name.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.special = np.array([r is None for r in raw])
        self.spelled = np.frombuffer(b"".join(r or b"" for r in raw), np.uint8)
        self.lengths = np.array([len(r or b"") for r in raw], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.longest = max(map(len, self.ids), default=1)
        self.valid = lru_cache(1 << 17)(self._valid)

    @staticmethod
    def of(proto: bytes) -> PieceModel:
        kept, key = worker_cache(), hashlib.sha256(proto).digest()
        if key not in kept:
            kept[key] = PieceModel(proto)
        return kept[key]

    def merged(self, text: str) -> list[str]:
        """The model's own rule on a short string: join the best-scored pair of neighbours, leftmost first."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _valid(self, left: str, right: str) -> bool:
        """The two are the encoding of their concatenation ("" as left: right is one token)."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def token_ids(self, token: str) -> list[int]:
        found = self.ids.get(token)
        if found is not None:
            return [found]
        return [self.bytes[b] if self.bytes[b] != self.unknown else self.unknown for b in token.encode("utf-8", "surrogatepass")]


def encoded(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts, end of each text's) of a large_string array without nulls."""
    rows = texts.to_pylist()
    counts = np.array([t.count(" ") + 1 for t in rows], np.int64)
    slots = model.words.slots(model.library, " ".join(rows).split(" ") if rows else [])
    row = np.repeat(np.arange(len(rows)), counts)
    # Texts with spaces beside spaces or at an end, or with the mark itself, go to the library whole.
    whole = np.array([not model.by_word or SPACE in t for t in rows], bool)
    whole[row[slots == 0]] = True
    counts = np.where(whole, 1, counts)
    mark = np.repeat(whole, counts)
    entry = np.empty(len(mark), np.int64)
    entry[~mark] = slots[~whole[row]]
    entry[mark] = model.words.added(model.library, [t for t, w in zip(rows, whole.tolist(), strict=True) if w])
    begins, sizes, pool = model.words.begins, model.words.sizes, model.words.pool
    size = sizes[entry]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    ids = pool[np.repeat(begins[entry] - ends + size, size) + np.arange(total)]
    return ids, np.concatenate([[0], ends])[np.cumsum(counts)]


def decoded(model: PieceModel, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Texts of ids[cuts[i]:cuts[i + 1]]."""
    size = model.lengths[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    data = model.spelled[np.repeat(model.begins[ids] - ends + size, size) + np.arange(total)]
    place = np.concatenate([[0], ends])[cuts]
    begin, end = place[:-1], place[1:]
    # The library drops the space before a text's first piece.
    first = ids[np.minimum(cuts[:-1], max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(begin), np.int64)
    filled = end > begin
    lead = np.zeros(len(begin), bool)
    lead[filled] = (data[begin[filled]] == 32) & (model.lengths[first[filled]] > 0)
    begin = begin + lead
    heads = data[begin[end > begin]]
    sound = not model.special[ids].any() and not ((heads >= 0x80) & (heads < 0xC0)).any()
    raw = data.tobytes()
    if sound:
        try:
            raw.decode()
        except UnicodeDecodeError:
            sound = False
    if not sound:  # control ids, or bytes that spell no characters: the library's rules
        return pa.array([model.library.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.large_string())
    keep = np.ones(len(data), bool)
    keep[begin[lead] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])


def normalized(text: str) -> str:
    """The model's identity normalisation: a leading space, and spaces as U+2581."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def code(before: int, behind: int) -> int:
    return before * 256 + behind


class Chunk:
    """Characters [lo, hi) of a text, with margins of the longest piece on both sides."""

    def __init__(self, model: PieceModel, text: str, lo: int, hi: int, first: bool, last: bool):
        self.model, self.text, self.lo, self.hi, self.first, self.last = model, text, lo, hi, first, last
        self.lasts: list[dict[int, int]] = [{} for _ in range(len(text) + 1)]  # position -> token length -> mask of entry states
        self.entries = [0] if first else self.states(lo)
        self._run()

    def states(self, cut: int) -> list[int]:
        """Every token that covers or ends at a cut."""
        m, t = self.model, self.text
        spans = ((a, e) for a in range(max(0, cut - m.longest), cut) for e in range(cut, min(len(t), a + m.longest) + 1))
        return [code(cut - a, e - cut) for a, e in spans if (e - a == 1 or t[a:e] in m.ids) and m.valid("", t[a:e])]

    def _run(self) -> None:
        m, t, lasts = self.model, self.text, self.lasts
        ids, valid, longest = m.ids, m.valid, m.longest
        floor = self.lo
        for k, state in enumerate(self.entries):
            if self.first:
                lasts[self.lo][0] = 1
            else:
                end = self.lo + state % 256
                length = state // 256 + state % 256
                lasts[end][length] = lasts[end].get(length, 0) | 1 << k
        for p in range(self.lo + 1, min(self.hi + longest, len(t)) + 1):
            here = lasts[p]
            for q in range(p - 1, max(floor, p - longest) - 1, -1):
                if p > self.hi and q >= self.hi:
                    continue  # a token that begins behind the cut is the next chunk's
                token = t[q:p]
                if not lasts[q] or (p - q > 1 and token not in ids):
                    continue
                mask = 0
                for length, of in lasts[q].items():
                    if valid(t[q - length : q] if length else "", token):
                        mask |= of
                if mask:
                    here[p - q] = here.get(p - q, 0) | mask

    def exits(self) -> list[tuple[int, int]]:
        """(exit state, mask of the entry states from which it has weight 0): the finite entries of the transfer matrix."""
        out = []
        for e in range(self.hi, min(self.hi + self.model.longest, len(self.text)) + 1):
            if self.last and e > self.hi:
                break
            for length, mask in self.lasts[e].items():
                if e - length < self.hi and mask:
                    out.append((code(self.hi - e + length, e - self.hi), mask))
        return out

    def matrix(self) -> list[tuple[int, int]]:
        """Pairs (entry, exit) of weight 0."""
        return [(entry, out) for out, mask in self.exits() for k, entry in enumerate(self.entries) if mask >> k & 1]

    def trace(self, entry: int, out: int) -> list[str]:
        """Tokens after the entry state's up to the exit state's, both ends known."""
        bit = 1 << self.entries.index(entry)
        end, length = self.hi + out % 256, out // 256 + out % 256
        stop = self.lo + (0 if self.first else entry % 256)
        tokens = []
        # A token that covers the whole chunk is the entry state itself: nothing lies between.
        while end > stop:
            token = self.text[end - length : end]
            tokens.append(token)
            at = end - length
            if at <= stop:
                break
            length = next(n for n, mask in self.lasts[at].items() if mask & bit and self.model.valid(self.text[at - n : at] if n else "", token))
            end = at
        return tokens[::-1]


def combined(left: set[tuple[int, int]], right: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Max-plus product of two transfer matrices of weights 0 and minus infinity."""
    after: dict[int, list[int]] = {}
    for a, b in right:
        after.setdefault(a, []).append(b)
    return {(a, c) for a, b in left for c in after.get(b, ())}


def boundary_states(matrices: list[set[tuple[int, int]]], entry: int = 0, out: int | None = None) -> list[int]:
    """The state at every boundary, both ends' included: reachable from the entry, and from it the exit (None: the only one)."""
    ahead = [{entry}]
    for m in matrices:
        ahead.append({b for a, b in m if a in ahead[-1]})
    states, back = [0] * len(ahead), set(ahead[-1]) if out is None else {out}
    for i in range(len(matrices), -1, -1):
        both = ahead[i] & back
        if len(both) != 1:
            raise ValueError(f"boundary {i} has {len(both)} states")
        states[i] = next(iter(both))
        back = {a for a, b in matrices[i - 1] if b in both} if i else set()
    return states


def cut_chunks(model: PieceModel, text: str, size: int) -> list[tuple[str, int, int]]:
    """(text with margins, lo, hi) of every chunk; a chunk is at least as long as the longest piece."""
    size = max(size, 2 * model.longest)
    cuts = [*range(0, max(1, len(text) - size // 2), size), len(text)]
    pad = model.longest
    return [(text[max(0, a - pad) : b + pad], a - max(0, a - pad), b - max(0, a - pad)) for a, b in zip(cuts, cuts[1:], strict=False)]


def encode_by_scan(model: PieceModel, text: str, size: int = CHUNK, fan: int = FAN) -> list[int]:
    """One text by the scan, in one process."""
    full = normalized(text)
    if not full:
        return []
    parts = cut_chunks(model, full, size)
    chunks = [Chunk(model, t, lo, hi, i == 0, i == len(parts) - 1) for i, (t, lo, hi) in enumerate(parts)]
    levels = [[set(c.matrix()) for c in chunks]]
    while len(levels[-1]) > 1:
        levels.append([reduce(combined, levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    states = boundary_states(levels[-1])
    for level in levels[-2::-1]:
        parts = [boundary_states(level[i * fan : (i + 1) * fan], a, b) for i, (a, b) in enumerate(zip(states, states[1:], strict=False))]
        states = [x for part in parts for x in part[:-1]] + [states[-1]]
    return [i for c, a, b in zip(chunks, states, states[1:], strict=False) for token in c.trace(a, b) for i in model.token_ids(token)]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


CHUNKS = "key string, i int, n int, text string, lo int, hi int"


def as_set(pairs: list[int]) -> set[tuple[int, int]]:
    return set(zip(pairs[::2], pairs[1::2], strict=True))


def scan_giants(giants: DataFrame, proto: bytes, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Rows (key, tokens) from rows (key, text): chunks are cut, weighed, combined and traced back in parallel."""

    def cut(batches):
        model = PieceModel.of(proto)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = cut_chunks(model, normalized(text), size)
                cols = [[key] * len(parts), list(range(len(parts))), [len(parts)] * len(parts), *map(list, zip(*parts, strict=True))]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "i", "n", "text", "lo", "hi"])

    def weigh(batches):
        model = PieceModel.of(proto)
        for batch in batches:
            rows = batch.to_pydict()
            pairs = [Chunk(model, t, lo, hi, i == 0, i == n - 1).matrix() for i, n, t, lo, hi in zip(*(rows[c] for c in ("i", "n", "text", "lo", "hi")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[x for p in m for x in p] for m in pairs], pa.list_(pa.int32()))], ["key", "i", "pairs"])

    def product(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["i"].to_pylist(), table["pairs"].to_pylist(), strict=True))
        found = reduce(combined, (as_set(p) for _, p in rows))
        return pa.table([table["key"].slice(0, 1).combine_chunks(), pa.array([rows[0][0] // fan], pa.int32()), pa.array([[x for p in sorted(found) for x in p]], pa.list_(pa.int32()))], ["key", "i", "pairs"])

    def settle(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["i"].to_pylist(), table["pairs"].to_pylist(), strict=True))
        states = boundary_states([as_set(p) for _, p in rows], table["entry"][0].as_py(), table["out"][0].as_py())
        return pa.table([table["key"].combine_chunks(), *(pa.array(x, pa.int32()) for x in ([i for i, _ in rows], states[:-1], states[1:]))], ["key", "i", "entry", "out"])

    def ends(batches):
        for batch in batches:
            states = [boundary_states([as_set(p)]) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(states), np.int32)), *(pa.array([s[k] for s in states], pa.int32()) for k in (0, 1))], ["key", "i", "entry", "out"])

    def trace(batches):
        model = PieceModel.of(proto)
        for batch in batches:
            rows = batch.to_pydict()
            found = [[x for token in Chunk(model, t, lo, hi, i == 0, i == n - 1).trace(a, b) for x in model.token_ids(token)] for i, n, t, lo, hi, a, b in zip(*(rows[c] for c in ("i", "n", "text", "lo", "hi", "entry", "out")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("i")), pa.array(found, pa.list_(pa.int32()))], ["key", "i", "ids"])

    chunks = staged(giants.mapInArrow(lean(cut), CHUNKS), "pieces-chunks")
    tasks = max(1, giants.sparkSession.sparkContext.defaultParallelism * 4)
    matrices, settled = "key string, i int, pairs array<int>", "key string, i int, entry int, out int"
    levels = [staged(chunks.repartition(tasks, "key", "i").mapInArrow(lean(weigh), matrices), "pieces-matrices")]
    most = (chunks.agg(F.max("i")).first()[0] or 0) + 1
    group = F.floor(F.col("i") / fan).cast("int")
    while most > 1:  # up: products of neighbours
        levels.append(staged(levels[-1].groupBy("key", group.alias("g")).applyInArrow(lean(product), matrices), "pieces-matrices"))
        most = -(-most // fan)
    states = levels[-1].select("key", "pairs").mapInArrow(lean(ends), settled)
    for level in levels[-2::-1]:  # down: the states between a product's factors
        placed = level.withColumn("g", group).join(states.withColumnRenamed("i", "g"), ["key", "g"])
        states = placed.groupBy("key", "g").applyInArrow(lean(settle), settled)
    traced = chunks.join(states, ["key", "i"]).repartition(tasks, "key", "i").mapInArrow(lean(trace), "key string, i int, ids array<int>")
    ordered = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    return ordered.select("key", F.flatten(F.col("parts.ids")).alias("tokens"))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "tokens", model_path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs and, last, an array<int> column of the token ids of a text column; docs keeps a column of that name: the new one then gets a leading _."""
    proto = read_model(model_path)
    names, (shown,) = docs.columns, fresh(docs, out_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow maps take no names with dots
    text_col, out_col, key = f"c{[n.lower() for n in names].index(text_col.lower())}", "tokens", "key"

    def with_ids(batches):
        model = PieceModel.of(proto)
        for batch in batches:
            for rows, part in slices(batch, text_col):
                ids, ends = encoded(model, part)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*rows.columns, tokens], [*rows.schema.names, out_col])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = StructType([*docs.schema.fields, StructField(out_col, ArrayType(IntegerType()))])
    short = docs.where(F.length(text) <= giant).mapInArrow(lean(with_ids), kind)
    long = docs.where(F.length(text) > giant).withColumn(key, F.sha2(text, 256))
    found = staged(scan_giants(long.select(F.col(key).alias("key"), text.alias("text")).dropDuplicates(["key"]), proto, chunk), "pieces-giants")
    long = long.join(found.select(F.col("key").alias(key), F.col("tokens").alias(out_col)), key).drop(key)
    return short.unionByName(long).toDF(*names, shown)


def decode(tokens: Column, model_path: str = MODEL) -> Column:
    """Text of a column of token ids (null: empty)."""
    proto = read_model(model_path)

    @F.arrow_udf("string")
    def piece_text(column: pa.Array) -> pa.Array:
        model = PieceModel.of(proto)
        column = column.fill_null([]) if column.null_count else column
        flat, ends = np.asarray(column.flatten()), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
        out, at = [pa.array([], pa.large_string())], 0
        while at < len(column):  # about SLICE_BYTES of tokens at once
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES // 4, "right")) - 1)
            out.append(decoded(model, flat[ends[at] : ends[to]], ends[at : to + 1] - ends[at]))
            at = to
        release()
        return pa.concat_arrays(out).cast(pa.string())

    return piece_text(tokens)


ship(__name__)
