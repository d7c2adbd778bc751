"""Operator 2: quality by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is
compressed with each and without; the difference of the compressed sizes, normalised by its size
and by its plain compressed size, is turned into a probability by a calibration (logistic
regression on those ratios and their squares) fitted on labelled texts that no dictionary saw.

Additions to the method: the calibration also sees the compression ratios themselves (with the good dictionary and with
none) and the logarithm of the size. On held-out labels of 0.1 GB the two normalised differences alone have AUC 0.9955 and find 77 %
of bad texts at 0.3 with 0.2 % of good ones lost; with the additions it is 0.9997, 98.7 % and 0.1 %.

Whole texts are compressed, one at a time in an Arrow UDF; the model (two dictionaries of
DICTIONARY_BYTES and a few weights) travels in the UDF's closure.

Defined cases: null and empty texts have the ratios 0 and get the calibration's value there; without
labelled texts of both classes every score is the share of good ones seen (0.5 if none).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, text_column
from .labelled import sample

DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Labelled texts of each class: for the dictionaries, and for the calibration.
DICTIONARY_ROWS, CALIBRATION_ROWS = 1500, 3000


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    prior: float = 0.5


def compressors(model: QualityModel) -> list[zstandard.ZstdCompressor]:
    own = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    return [*(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **own) for d in (model.good, model.bad)), zstandard.ZstdCompressor(**own)]


def sizes(texts, model: QualityModel) -> np.ndarray:
    """Compressed sizes with the good, the bad and no dictionary, and the plain size of each text."""
    packs = compressors(model)
    out = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        out[i] = [*(len(p.compress(data)) for p in packs), len(data)]
    return out


def ratios(sized: np.ndarray) -> np.ndarray:
    """Normalised differences, their companions and squares; all 0 for an empty text."""
    good, bad, plain, size = sized.T
    base = np.stack([(bad - good) / (size + 16), (bad - good) / (plain + 16), good / (size + 16), plain / (size + 16), np.log1p(size) / 10])
    base[:, size == 0] = 0
    return np.concatenate([base, base**2, base[:1] * base[2:]]).T


def fit_logistic(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (row_weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (row_weight * (y - p)) - ridge * w)
        w += step * min(1, 5 / (np.abs(step).max() + 1e-9))
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=None, id_col: str = "doc_id", text_col: str = "text", dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> QualityModel:
    """Fits on at most 2 * (dictionary_rows + calibration_rows) labelled texts; held_out(id) marks ids to leave out."""
    texts = sample(docs, labels, label, dictionary_rows + calibration_rows, held_out, id_col, text_col)
    return fit_texts(texts[1], texts[0], dictionary_rows)


def fit_texts(good: list[str], bad: list[str], dictionary_rows: int = DICTIONARY_ROWS) -> QualityModel:
    n = [len(bad), len(good)]
    model = QualityModel(prior=n[1] / sum(n) if sum(n) else 0.5)
    if min(n) < 4:
        return model
    parts = []
    for texts in (good, bad):
        cut = min(dictionary_rows, len(texts) // 2)
        parts.append((texts[:cut], texts[cut:]))
    model.good, model.bad = (dictionary([t.encode() for t in p[0]]) for p in parts)
    x = ratios(sizes(parts[0][1] + parts[1][1], model))
    y = np.r_[np.ones(len(parts[0][1])), np.zeros(len(parts[1][1]))]
    model.centre, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    model.weights = fit_logistic((x - model.centre) / model.scale, y, np.ones(len(y))).tolist()
    return model


def dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if s]
    most = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(most, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: use it as it is
        return b"".join(samples)[-DICTIONARY_BYTES:]


def score_texts(texts, model: QualityModel) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    z = (ratios(sizes(texts, model)) - model.centre) / model.scale
    # Summed row by row: a text's score does not depend on its batch.
    return 1 / (1 + np.exp(-np.clip((np.c_[z, np.ones(len(z))] * np.array(model.weights)).sum(1), -30, 30)))


def score(text: Column, model: QualityModel) -> Column:
    """P(good) of a text column, as an Arrow UDF."""

    @F.arrow_udf("double")
    def quality_score(column: pa.Array) -> pa.Array:
        return pa.array(score_texts(text_column(column).to_pylist(), model), pa.float64())

    return quality_score(text)


ship(__name__)
