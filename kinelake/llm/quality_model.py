"""Quality classifier: histogram gradient-boosted trees over document statistics.

`statistics` turns whole texts into a fixed row of numbers with array operations
over their bytes and words. The model is fitted on the driver from at most
`sample` labelled rows; it is flat arrays (trees.Forest) of a size fixed by the
number of trees and their depth, which travel to the workers inside the function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm import trees
from kinelake.llm.common import fold, give_way, is_fold, table

#: Most labelled rows that the model is fitted on (those with the smallest hashed doc_id).
SAMPLE = 20_000
THRESHOLD = 0.7

# Byte classes of the statistics.
_LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _STOP, _MARK, _SYMBOL, _LEAD, _TRAIL, _CONTROL = range(11)


def _byte_classes() -> np.ndarray:
    lut = np.full(256, _SYMBOL, np.uint8)
    lut[:32] = _CONTROL
    lut[127] = _CONTROL
    lut[ord("a") : ord("z") + 1] = _LOWER
    lut[ord("A") : ord("Z") + 1] = _UPPER
    lut[ord("0") : ord("9") + 1] = _DIGIT
    lut[[9, 11, 12, 13, 32]] = _BLANK
    lut[10] = _BREAK
    lut[[ord(c) for c in ".!?"]] = _STOP
    lut[[ord(c) for c in ",;:'\"()-"]] = _MARK
    lut[128:192] = _TRAIL
    lut[192:] = _LEAD
    return lut


BYTE_CLASS = _byte_classes()
N_CLASSES = 11
FEATURES = (
    "log_words", "log_chars", "mean_word", "long_words", "distinct_words", "repeat_lines", "words_a_line", "words_a_stop",
    "capital_words", "marked_words", "digit_words", "top_word", "lower", "upper", "digit", "blank", "break", "stop", "mark", "symbol", "wide", "control",
)


def statistics(array: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty text gives zeros."""
    n = len(array)
    raw, offsets = at.buffers(array)
    row = at.row_of(offsets)
    kinds = np.bincount(row * N_CLASSES + BYTE_CLASS[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    chars = np.maximum(1.0, kinds.sum(axis=1) - kinds[:, _TRAIL])

    found, bounds = at.words(array)
    codes, values = at.coded(found)
    w_raw, w_offsets = at.buffers(values)
    w_kinds = np.bincount(at.row_of(w_offsets) * N_CLASSES + BYTE_CLASS[w_raw], minlength=len(values) * N_CLASSES).reshape(len(values), N_CLASSES)
    length = w_kinds.sum(axis=1) - w_kinds[:, _TRAIL]
    per_word = np.stack(
        [
            length,
            length > 12,
            (w_kinds[:, _UPPER] > 1) & (w_kinds[:, _LOWER] == 0),
            w_kinds[:, _SYMBOL] > 0,
            w_kinds[:, _DIGIT] > 0,
        ]
    ).astype(float)
    count = np.diff(bounds)
    some = np.maximum(1, count)
    mean, long, capital, marked, digit = (at.per_row(v[codes], bounds) / some for v in per_word)
    keys, times = np.unique(at.row_of(bounds) * max(len(values), 1) + codes, return_counts=True)
    owner = keys // max(len(values), 1)
    distinct = np.bincount(owner, minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, owner, times)

    lines = pc.split_pattern(array, "\n")
    line_codes, line_values = at.coded(lines.flatten())
    line_bounds = lines.offsets.to_numpy().astype(np.int64)
    line_bounds = line_bounds - line_bounds[0]
    n_lines = np.maximum(1, np.diff(line_bounds))
    repeated = 1 - at.count_distinct(line_codes, line_bounds, len(line_values)) / n_lines

    parts = [kinds[:, k] / chars for k in (_LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _STOP, _MARK, _SYMBOL, _LEAD, _CONTROL)]
    return np.stack(
        [
            np.log1p(count), np.log1p(np.where(count > 0, chars, 0)), mean, long, distinct, np.where(count > 0, repeated, 0),
            count / n_lines, count / (1 + kinds[:, _STOP]), capital, marked, digit, top / some, *parts,
        ],
        axis=1,
    )


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns (one named `features` gives way) and `features`, an array of doubles in the order of FEATURES."""
    df = give_way(df, "features")
    rest = [c for c in df.columns if c != text]

    def run(batches):
        for batch in at.slices(batches, text):
            x = statistics(at.texts(batch.column(text)))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], [*rest, "features"])

    return df.mapInArrow(run, df.drop(text).withColumn("features", F.lit(None).cast("array<double>")).schema)


def sample_labels(labels: DataFrame, label: str, use: Column, sample: int) -> DataFrame:
    """At most `sample` rows (doc_id, y), the smallest by hashed doc_id among rows to use.

    A doc_id with several labels counts with the smallest; NULL ids and labels are left out.
    """
    return (
        labels.where(use & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", use: Column | None = None, sample: int = SAMPLE) -> trees.Forest:
    """Fit on the documents of at most `sample` labelled doc_ids (an action).

    The sampled ids are broadcast: `sample` bounds them. Of several documents with one
    doc_id the one with the smallest statistics stands for all.
    """
    chosen = sample_labels(labels, label, F.lit(True) if use is None else use, sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(joined).groupBy("doc_id").agg(F.min(F.struct("features", "y")).alias("r")).select("doc_id", "r.*").toPandas()
    rows = rows.sort_values("doc_id")
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return trees.fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: trees.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """docs without text, plus score (0 to 1) and predicted (1 if score >= threshold); columns of these names give way."""
    docs = give_way(docs, "score", "predicted")
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in at.slices(batches):
            p = model.probability(statistics(at.texts(batch.column("text"))))
            out = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *out], [*rest, "score", "predicted"])

    plain = docs.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    return docs.mapInArrow(run, plain.schema)


def query(spark, sf_dir):
    """Quality of every document: doc_id, held_out, score, predicted.

    Learns from labels whose fold (crc32 of doc_id mod 4) is not 2. NULL text counts as
    empty; a NULL doc_id is never held out; repeated documents give repeated rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels, use=fold("doc_id", 4) != 2)
    scored = score(docs, model)
    return scored.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")


QUERY = ("op2_quality_classifier", query)
