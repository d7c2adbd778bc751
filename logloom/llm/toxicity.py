"""Operator 9: toxicity by a linear classifier over character n-grams scaled by log-count ratios.

Features say whether an n-gram (of lowered code points, hashed) occurs in a text. Naive Bayes
log-count ratios r are counted over labelled texts; all n-grams whose shares differ significantly are kept
(2**TABLE_BITS slots at most), each present one has the value r, and logistic regression with L2 penalty
weighs them, in blocks of texts that hold 4 bytes for each (text, feature) pair.

Presence, not frequency, makes a text's length matter little: a long text with a few toxic words
scores like a short one. Texts are scored whole, in slices of bounded size, in an Arrow UDF.

Defined cases: null and empty texts have no n-gram and get the intercept's score; without labelled
texts of both classes every score is the share of toxic ones seen (0 if none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import SLICE_BYTES, U64, running, ship, slices, spans_hash, text_column
from .labelled import sample

LENGTHS = (4, 5, 6)
TABLE_BITS = 20
#: Labelled texts of each class at most.
ROWS_PER_CLASS = 2500
#: A feature's shares in the two classes must differ by so many standard errors.
SIGNIFICANT = 4.0


@dataclass
class ToxicModel:
    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float = 0.0


def grams(texts: pa.Array):
    """For slices of the texts: (index of the first text, texts, text index of each gram, its hash slot)."""
    start = 0
    for _, part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES // 4):
        low = pc.utf8_lower(part)
        own = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32)
        cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(low)))]).astype(np.int64)
        end = start + len(part)
        sums = running(own)
        rows, slots = [], []
        for n in LENGTHS:
            place = np.arange(max(0, len(own) - n + 1), dtype=np.int64)
            row = np.repeat(np.arange(end - start), np.diff(cuts))[: len(place)]
            inside = place + n <= cuts[row + 1]
            place, row = place[inside], row[inside]
            rows.append(row)
            slots.append((spans_hash(sums, place, place + n) >> U64(64 - TABLE_BITS)).astype(np.int64))
        yield start, end - start, np.concatenate(rows), np.concatenate(slots)
        start = end


def present(texts: pa.Array, table: np.ndarray):
    """Distinct (text, feature) pairs; table: slot -> feature, or -1."""
    for start, n, row, slot in grams(texts):
        feature = table[slot]
        keep = feature >= 0
        pairs = np.unique(row[keep] * np.int64(1 << 32) + feature[keep])
        yield start, n, pairs >> 32, pairs & ((1 << 32) - 1)


def counted(texts: pa.Array) -> np.ndarray:
    """Texts that have each slot."""
    out = np.zeros(1 << TABLE_BITS)
    for _, _, row, slot in grams(texts):
        pairs = np.unique(row * np.int64(1 << TABLE_BITS) + slot)
        out += np.bincount(pairs & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
    return out


def by_text(blocks: list[tuple], values: np.ndarray, texts: int) -> np.ndarray:
    """The sum of its features' values for each text; blocks: (first text, pairs of each text, feature of each pair)."""
    out = np.zeros(texts)
    for first, pairs, feature in blocks:
        out[first : first + len(pairs)] = np.bincount(np.repeat(np.arange(len(pairs)), pairs), values[feature], len(pairs))
    return out


def by_feature(blocks: list[tuple], values: np.ndarray, features: int) -> np.ndarray:
    """The sum of its texts' values for each feature."""
    out = np.zeros(features)
    for first, pairs, feature in blocks:
        out += np.bincount(feature, np.repeat(values[first : first + len(pairs)], pairs), features)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out=None, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> ToxicModel:
    """Fits on at most rows_per_class labelled texts of each class; held_out(id) marks ids to leave out."""
    texts = sample(docs, labels, label, rows_per_class, held_out, id_col, text_col)
    return fit_texts(texts[1], texts[0])


def fit_texts(toxic: list[str], clean: list[str], steps: int = 200) -> ToxicModel:
    n1, n0 = len(toxic), len(clean)
    empty = ToxicModel(np.zeros(0, np.int64), np.zeros(0), 0.0, n1 / (n1 + n0) if n1 + n0 else 0.0)
    if min(n1, n0) < 2:
        return empty
    arrays = [pa.array(x, pa.large_string()) for x in (toxic, clean)]
    c1, c0 = (counted(a) for a in arrays)
    p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    ratio = np.log(p1 / p0)
    pooled = (c1 + c0 + 1) / (n1 + n0 + 2)
    sure = np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    slots = np.flatnonzero((sure >= SIGNIFICANT) & (c1 + c0 >= 4))
    if not len(slots):
        return empty
    table = np.full(1 << TABLE_BITS, -1, np.int64)
    table[slots] = np.arange(len(slots))
    blocks, base = [], 0
    for a in arrays:
        for start, n, row, feature in present(a, table):
            blocks.append((start + base, np.bincount(row, minlength=n), feature.astype(np.int32)))
        base += len(a)
    r = ratio[slots]
    y = np.r_[np.ones(n1), np.zeros(n0)]
    # Nesterov's gradient steps; the step is bounded by the largest row and the mean activity.
    norm = by_text(blocks, r**2, n1 + n0)
    w, b = np.zeros(len(slots)), 0.0
    vw, vb = w.copy(), b
    rate, ridge = 4 / (norm.mean() + 1), 1e-4
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(by_text(blocks, r * vw, n1 + n0) + vb, -30, 30)))
        g = (p - y) / len(y)
        nw, nb = vw - rate * (r * by_feature(blocks, g, len(slots)) + ridge * vw), vb - rate * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return ToxicModel(slots, w * r, float(b), n1 / (n1 + n0))


def score_texts(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    if not len(model.slots):
        return np.full(len(texts), model.prior)
    table = np.full(1 << TABLE_BITS, -1, np.int64)
    table[model.slots] = np.arange(len(model.slots))
    out = np.full(len(texts), model.intercept)
    for start, n, row, feature in present(texts, table):
        out[start : start + n] += np.bincount(row, model.weights[feature], n)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(text: Column, model: ToxicModel) -> Column:
    """P(toxic) of a text column, as an Arrow UDF."""

    @F.arrow_udf("double")
    def toxicity_score(column: pa.Array) -> pa.Array:
        return pa.array(score_texts(text_column(column), model), pa.float64())

    return toxicity_score(text)


ship(__name__)
