"""Quality classifier by compression with dictionaries of good and of bad text.

Two forms of a text are compressed: the text itself, and a sketch of it in which runs of
lower-case letters, capitals and digits shrink to one sign each and a word that repeats the
one before it becomes ``=``. For each form the difference of the two sizes over their sum is
a feature, and a logistic fit on labelled texts that made no dictionary turns both into a
calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learns, tune
from .compression import cut, sample_ids, sizes, with_text

#: Of each class so many texts make the dictionary, the first of them that of sketches (a larger one tells worse), and so many more the
#: calibration; bytes that are taken of a text and of a sketch. A dictionary holds all of them: DICT_TEXTS * (PIECE + 1) bytes at most.
DICT_TEXTS, SKETCH_TEXTS, FIT_TEXTS = 256, 64, 1024
PIECE, BLOCK = 256, 512

_SIGNS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def sketch(data: bytes) -> bytes:
    """The shapes of the words."""
    words, shapes = data.split(), data.translate(_SIGNS)
    for sign in (b"a", b"A", b"0"):
        while sign * 2 in shapes:
            shapes = shapes.replace(sign * 4, sign).replace(sign * 2, sign)
    return b" ".join([b"=" if x == y else s for x, y, s in zip(words, [b"", *words], shapes.split(), strict=False)])


@dataclass(frozen=True)
class QualityModel:
    texts: tuple[bytes, bytes]  #: dictionaries of class 0 and class 1
    sketches: tuple[bytes, bytes]
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def features(self, text: str | None) -> tuple[float, float]:
        data = (text or "").encode("utf-8", "replace")
        out = []
        for raws, form in ((self.texts, data), (self.sketches, sketch(data))):
            bad, good = sizes(raws, form, BLOCK)
            out.append((bad - good) / (bad + good))
        return out[0], out[1]

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a * x + b * y + c, -700, 700))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        data = [t.encode("utf-8", "replace") for t in rows["text"]]
        texts = [cut(d, PIECE, p) for d, p in zip(data, rows["place"], strict=True)]
        forms = [cut(sketch(d), PIECE, p) for d, p in zip(data, rows["place"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("place"), pa.array(texts, pa.binary()), pa.array(forms, pa.binary())], names=["class", "place", "piece", "form"])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge, on standardised features."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    ridge = np.array([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), slope)
    return *(w[:-1] / dev), float(w[-1] - (w[:-1] * mean / dev).sum())


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from a bounded sample of labelled texts; an id with both labels teaches nothing."""
    tune(documents.sparkSession)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("class"), F.max(label_col).alias("also"))
    rows = rows.where("class = also").select("id", F.col("class").cast("int").alias("class"))
    count = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    texts = with_text(sample_ids(rows, DICT_TEXTS + FIT_TEXTS), documents, id_col, text_col)
    makes = F.col("place") % ((DICT_TEXTS + FIT_TEXTS) // DICT_TEXTS) == 1
    pieces = texts.where(makes).select("class", "place", "text").mapInArrow(_pieces, "class int, place int, piece binary, form binary").collect()
    pieces.sort(key=lambda r: r["place"])
    joined = lambda k, c, n: b"\n".join([bytes(r[k]) for r in pieces if r["class"] == c][:n]) or b"\n" * 8
    model = QualityModel(tuple(joined("piece", c, DICT_TEXTS) for c in (0, 1)), tuple(joined("form", c, SKETCH_TEXTS) for c in (0, 1)))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["class", "x", "y"])

    seen = texts.where(~makes).select("class", "text").mapInArrow(measure, "class int, x double, y double").orderBy("class", "x", "y").collect()
    if not seen:
        return model
    y = np.array([r["class"] for r in seen], float)
    of = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([count[int(c)] / of[int(c)] for c in y]) * len(y) / sum(count.values())
    return QualityModel(model.texts, model.sketches, _logistic(np.array([[r["x"], r["y"]] for r in seen]), y, weight))


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score (0 to 1) and predicted (1 from 0.5 on) of every row, from its whole text alone.

    Null texts are scored as empty ones. A model without labelled texts gives 0.5. Null ids and
    repeated rows keep their rows; an empty table gives none; other columns are not read.
    """
    tune(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64()), pa.array([int(s >= 0.5) for s in own], pa.int32())], names=["id", "score", "predicted"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 3, rest: int = 1) -> DataFrame:
    """Learn from labels that are not held out, score all: id, held_out, score, predicted.

    Labels with a null id or a quality other than 0 and 1 teach nothing, nor does an id with
    both, nor one without a text. Null texts are scored as empty ones; null ids are not held
    out; repeated rows each keep a row; equal features get equal scores. Whole texts count,
    however long. An empty documents table gives no rows, labels of no class the score 0.5.
    Other columns are neither read nor returned.
    """
    model = fit(documents, labels.where(learns(F.col(id_col), mod, rest)), id_col, text_col, label_col)
    return score(documents, model, id_col, text_col).select(id_col, held_out(F.col(id_col), mod, rest).alias("held_out"), "score", "predicted")
