"""Text quality by compression: which of two zstandard dictionaries, of good or of bad text, makes a text smaller."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, kept, sampled_text

BLOCK_BYTES = 512
LEVEL = 3
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 1 << 16
SAMPLE_BLOCK = 1 << 10
DICTIONARY_BYTES = 1 << 16


@dataclass(frozen=True)
class QualityModel:
    """Both dictionaries and the calibration: score = 1 / (1 + exp(-(intercept + slope * difference)))."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    def load():
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False,
        )

    return kept(("zstd", hashlib.sha256(content).digest()), load)


def size_difference(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(size under the bad dictionary - size under the good one) / bytes of the text; 0 for an empty text.

    Texts are compressed in blocks of 512 bytes, each on its own, so that a long text is judged by the dictionaries
    throughout and not by its own beginning.
    """
    with_good, with_bad = _compressor(good), _compressor(bad)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        view, difference = memoryview(text), 0
        for at in range(0, len(view), BLOCK_BYTES):
            block = view[at : at + BLOCK_BYTES]
            difference += len(with_bad.compress(block)) - len(with_good.compress(block))
        out[i] = difference / max(1, len(view))
    return out


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[at : at + BLOCK_BYTES] for t in texts for at in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton's method, with a slight pull of the slope to 0."""
    scale = max(float(np.std(x)), 1e-9)
    design, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    pull = np.diag([0.01, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design.T * (weight * p * (1 - p))) @ design + pull, design.T @ (weight * (y - p)) - pull @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", sample_per_class: int = SAMPLE_PER_CLASS, sample_chars: int = SAMPLE_CHARS,
) -> QualityModel:
    """Dictionaries and calibration from a bounded sample of labelled documents.

    Of the labels that hold `usable` (a condition on the id), `sample_per_class` of each class are drawn by a hash of the
    id, and of their rows (an id may be repeated) as many by a hash of id and text, equal rows once. Their texts come to the
    driver, of one longer than `sample_chars` characters that many, in blocks drawn by hash from all of it. That is the
    bound of the sample.
    Every other one trains its class's dictionary, the rest fit the calibration, weighted to the share each class has among
    all usable labels. Labels other than 0 and 1, ids labelled both ways and labels without a document are left out. If a
    class is missing, both dictionaries are empty and every text scores that share (0.5 without any label).
    """
    ident, label = column(id_column), column(label_column)
    known = labels.where(label.isin(0, 1) & ident.isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(ident.alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = (counts.get(1, 0) / sum(counts.values())) if counts else 0.5
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_per_class) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].unionAll(drawn[1]).select("id", "y"))  # two ids and labels per sampled row, bounded
    text = column(text_column)
    found = docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("draw"), text.alias("text")).join(chosen, "id").where("text <> ''")
    once = found.groupBy("y", "draw").agg(F.first(F.struct("id", sampled_text(F.col("text"), sample_chars, SAMPLE_BLOCK).alias("text"))).alias("r"))
    few = [once.where(F.col("y") == y).orderBy("draw").limit(sample_per_class) for y in (0, 1)]
    rows = sorted({(r.id, r.text, r.y) for r in few[0].unionAll(few[1]).select("r.*", "y").collect()}, key=lambda r: (hashlib.md5(repr(r[:2]).encode()).digest()))
    by = {y: [r[1].encode() for r in rows if r[2] == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    good, bad = _dictionary(by[1][::2]), _dictionary(by[0][::2])
    rest = by[0][1::2] + by[1][1::2]
    n0, n1 = len(by[0][1::2]), len(by[1][1::2])
    y = np.r_[np.zeros(n0), np.ones(n1)]
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    return QualityModel(good, bad, *_calibrate(size_difference(rest, good, bad), y, weight))


def quality_score(text: Column, model: QualityModel) -> Column:
    """The calibrated score of a text column, 0 to 1, higher: better. Null is scored as empty; whole texts are read."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        values = [t or b"" for t in texts.to_pylist()]
        x = size_difference(values, model.good, model.bad) if model.good else np.zeros(len(values))
        return pa.array(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -700, 700))), pa.float64())

    return score(text.cast("binary"))
