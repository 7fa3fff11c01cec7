"""Quality by compression: zstandard dictionaries of good and of bad labelled text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import discard, fit_logistic, held_out, labelled_sample, stored

PER_CLASS = 1500
DICT_BYTES = 112_640
LEVEL = 3
#: Texts are cut into segments of so many bytes; so many of a label, the first by hash over all texts, train its dictionary.
SEGMENT, SEGMENTS = 4096, 2000


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def compressors(self):
        made = []
        for data in (self.good, self.bad):
            if not data:
                made.append(zstandard.ZstdCompressor(level=LEVEL))
                continue
            one = zstandard.ZstdCompressionDict(data)
            one.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=one, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def features(self, texts: list[bytes | None], compressors) -> np.ndarray:
        """A constant, the difference of both compressed sizes by the larger one, how far the text shrinks, and their products."""
        good, bad = compressors
        sizes = np.array([(len(good.compress(t or b"")), len(bad.compress(t or b"")), len(t or b"")) for t in texts], float).reshape(-1, 3)
        top = sizes[:, :2].max(1)
        diff = (sizes[:, 1] - sizes[:, 0]) / np.maximum(top, 1)
        shrunk = np.log((top + 1) / (sizes[:, 2] + 20))
        return np.stack([np.ones(len(diff)), diff, shrunk, diff * diff, shrunk * shrunk, diff * shrunk], 1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


def _segments(raw: bytes, size: int = SEGMENT) -> list[bytes]:
    """The whole text in pieces of one size, the last one shorter."""
    return [raw[at : at + size] for at in range(0, len(raw), size)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too little text the text itself."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICT_BYTES:] if sum(map(len, texts)) >= 8 else b""


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, segments: int = SEGMENTS, modulus: int = 5, remainder: int = 0) -> Model:
    """Dictionaries from one bounded labelled sample, the calibration from another one.

    Both hold at most per_class rows of each label outside the held-out remainder. All
    segments of the first one's texts, whatever their length, are candidates for a
    dictionary; if there are more than ``segments`` of a label, a draw by hash takes
    them, texts alike whatever their length, so what reaches the driver has a fixed bound (2 x segments x
    SEGMENT bytes). Calibration is over whole texts, where they lie. If the second sample is empty (few labels) the
    first calibrates too; without both labels, or on empty tables, the score is 0.5
    for all. Null texts are empty; repeated ids give one row.
    """
    samples = [stored(labelled_sample(docs, labels, "quality", per_class, skip=skip, modulus=modulus, remainder=remainder), "quality-sample") for skip in (0, per_class)]
    kind = dict(samples[0].dtypes)["id"]

    def cut(batches):
        for batch in batches:
            for id_, text, label in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2))), strict=True):
                found = _segments(text) or [b""]
                yield pa.RecordBatch.from_arrays([pa.array([id_] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary()), pa.array([label] * len(found), pa.int32()), pa.array([len(found)] * len(found), pa.int64())], ["id", "place", "segment", "label", "of"])

    pieces = stored(samples[0].mapInArrow(cut, f"id {kind}, place long, segment binary, label int, of long"), "quality-segments")
    # an exponential draw with the mean of the text's segments: a long text is as likely to be met as a short one
    draw = -F.log((F.pmod(F.xxhash64("id", "place"), F.lit(1 << 52)) + 1) / float(1 << 52)) * F.col("of")
    order = [draw, F.col("id"), F.col("place")]
    first = [r for label in (0, 1) for r in pieces.where(F.col("label") == label).orderBy(*order).limit(segments).collect()]
    discard(pieces)
    first.sort(key=lambda r: (r.label, r.id, r.place))
    if {r.label for r in first} != {0, 1}:
        discard(*samples)
        return Model(b"", b"", (0.0,) * 6)
    good, bad = (_dictionary([bytes(r.segment) for r in first if r.label == k]) for k in (1, 0))
    model = Model(good, bad, (0.0,) * 6)

    def measured(batches):
        compressors = model.compressors()
        for batch in batches:
            if batch.num_rows:
                x = model.features(batch.column(1).cast(pa.binary()).to_pylist(), compressors)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    def calibration(sample: DataFrame) -> list:
        return sorted(sample.mapInArrow(measured, f"id {kind}, label int, x array<double>").collect(), key=lambda r: (r.label, r.id))

    taken = {r.id for r in samples[0].select("id").collect()}
    second = [r for r in calibration(samples[1]) if r.id not in taken]
    if {r.label for r in second} != {0, 1}:
        second = calibration(samples[0])
    discard(*samples)
    model.weights = tuple(float(w) for w in fit_logistic(np.array([r.x for r in second]), np.array([r.label for r in second], float), ridge=0.01))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score and predicted (score >= threshold) of every row; one pass, no shuffle.

    A null text counts as empty. A null id is not held out. A text of any length is
    compressed whole. Repeated rows each get a row; ties cannot occur. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        compressors = model.compressors()
        for batch in batches:
            if batch.num_rows:
                score = model.score(model.features(batch.column(2).cast(pa.binary()).to_pylist(), compressors))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), modulus, remainder).alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
