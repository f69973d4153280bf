"""Language identification by compression with per-language zstandard dictionaries.

The language whose dictionary makes a text smallest is chosen. A narrow lead rejects it: how
narrow is fitted on labelled texts that made no dictionary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, learns, tune
from .compression import cut, sample_ids, sizes, with_text

#: Of each language so many texts make the dictionary, and so many more fit the margin; bytes of a text that are taken. A dictionary
#: holds all of them: DICT_TEXTS * (SAMPLE_BYTES + 1) bytes at most.
DICT_TEXTS, FIT_TEXTS, SAMPLE_BYTES = 128, 384, 512
BLOCK = 2048
#: Least relative lead of the best size over the second; under it a prediction is always rejected.
MARGIN = 0.002
#: Softness of the score.
SOFT = 0.02

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The lower-cased text with a space for every run that is not letters."""
    return _OTHER.sub(" ", (text or "").lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    costs: tuple[float, ...]  #: bytes that naming the language costs: -log256 of its share of the texts
    margin: float = MARGIN  #: relative lead under which a prediction is rejected

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, lead); the lead is negative where there is nothing to predict from."""
        data = letters(text)
        if not self.languages or not any(map(str.isalpha, data.decode("utf-8", "replace"))):
            return "und", 0.0, -1.0
        own = [s + c for s, c in zip(sizes(self.dictionaries, data, BLOCK), self.costs, strict=True)]
        best = min(own)
        score = 1 / sum(math.exp(-min((s - best) / (SOFT * best), 700.0)) for s in own)
        second = sorted(own)[1] if len(own) > 1 else math.inf
        return self.languages[own.index(best)], score, 1 - best / second if second else 0.0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        out = [cut(letters(t), SAMPLE_BYTES, p) for t, p in zip(rows["text"], rows["place"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("place"), pa.array(out, pa.binary())], names=["class", "place", "piece"])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from a bounded sample of each language's texts, however many languages; shares from all texts."""
    labelled = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("class"))
    counts = [tuple(r) for r in labelled.groupBy("class").count().orderBy(F.desc("count"), "class").collect()]
    names = [c for c, _ in counts]
    spark = documents.sparkSession
    texts = Scratch(spark).save(with_text(sample_ids(labelled, DICT_TEXTS + FIT_TEXTS), documents, id_col, text_col).select("class", "place", "text"))
    makes = F.col("place") % ((DICT_TEXTS + FIT_TEXTS) // DICT_TEXTS) == 1
    rows = texts.where(makes).mapInArrow(_pieces, "class string, place int, piece binary").collect()
    pieces: dict[str, list[bytes]] = {name: [] for name in names}
    for r in sorted(rows, key=lambda r: r["place"]):
        pieces[r["class"]].append(bytes(r["piece"]))
    raws = [b" ".join(pieces[name]) for name in names]
    total = sum(n for _, n in counts)
    kept = [i for i, raw in enumerate(raws) if raw.strip()]
    model = LanguageModel(tuple(names[i] for i in kept), tuple(raws[i] for i in kept), tuple(-math.log(counts[i][1] / total, 256) for i in kept))
    shared = spark.sparkContext.broadcast(model)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            right = [f[0] == c for f, c in zip(found, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[2] for f in found], pa.float64()), pa.array(right, pa.bool_())], names=["lead", "right"])

    seen = texts.where(~makes).select("class", "text").mapInArrow(leads, "lead double, right boolean").where("lead >= 0").collect()
    return replace(model, margin=margin([(r["lead"], r["right"]) for r in seen]))


def margin(seen: list[tuple[float, bool]]) -> float:
    """The lead under which rejecting saves most: wrong predictions rejected less right ones. MARGIN at least; the smallest of equals."""
    best, most, gain = MARGIN, 0, 0
    for i, (lead, right) in enumerate(seen := sorted(seen)):
        gain += -1 if right else 1
        if gain > most and (i + 1 == len(seen) or seen[i + 1][0] > lead):
            best, most = math.nextafter(lead, math.inf), gain
    return max(best, MARGIN)


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [(name, score, lead < model.margin) for name, score, lead in map(model.predict, batch.column(batch.num_columns - 1).to_pylist())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score (0 to 1) and rejected of every row, from its whole text alone.

    A null text and one without any letter are ``und`` with score 0, rejected; so is everything
    if the model has learned no language. Equal sizes go to the language more texts have. Very
    short texts are judged like others, and a narrow lead rejects them. Null ids and repeated
    rows keep their rows; an empty table gives none; other columns are not read.
    """
    tune(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_apply(shared), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def language_id(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2) -> DataFrame:
    """Learn from the rows that are not held out, predict all: id, held_out, lang_pred, score, rejected.

    Rows whose id, text or lang is null teach nothing and are predicted like others; those
    with a null id are not held out. Null and letterless texts are ``und``. Ties go to the
    language more texts have. Repeated rows each keep a row. Whole texts count, however long.
    An empty table gives no rows; a table without any lang predicts ``und``. Other columns
    are neither read nor returned.
    """
    model = fit(documents.where(learns(F.col(id_col), mod, rest)), id_col, text_col, lang_col)
    found = identify(documents, model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col), mod, rest).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is identified, columns as given.

    The model learns from all rows with id, text and lang. Rows with a null or letterless text
    and those whose best language leads too little go; rows with a null id or lang are judged
    by their text; repeated rows stay repeated. An empty table, and one without any lang,
    gives no rows. Columns of other names pass through.
    """
    tune(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.predict(t)[2] >= model.margin for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
