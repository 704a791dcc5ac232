"""Quality scores of whole texts by a byte-level convolutional network.

The network (``bytecnn``) is trained in numpy on the driver from a bounded
sample of labelled rows: at most ``SAMPLE_ROWS`` labels by hash, of each text
``SAMPLE_CHUNKS`` chunks spread evenly from its first byte to its last.  Rows
whose checksum of the id is divisible by ``folds`` are held out: their labels
are never read.  Text alone makes a score; labels, ids and other columns don't.

Scoring reads all bytes of all rows in tasks, with the weights (some 30 kB) in
the task's closure.

Defined results: a null text counts as empty; an empty text has no chunks, so
its score is what the last layer says of nothing; a null id reads as an empty
one and is held out; a label without id or value is left out, and of several
labels of one id the lowest counts; of several texts of one id training takes
one; without labels of both kinds every score is the share of ones (a half
without any); repeated rows are scored each; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bytecnn import CHUNK, STRIDE, ByteCNN, chunks_of, symbols_of
from .common import blank_to_empty, bounded_batches, hashed_sample

#: Most labelled rows that training takes, and chunks of each.
SAMPLE_ROWS = 2000
SAMPLE_CHUNKS = 8
FOLDS = 5
#: Scores from here on count as good.
CUTOFF = 0.3


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(blank_to_empty(id_col.cast("string")).cast("binary")) % folds == 0


def spread_chunks(text: Column, count: int = SAMPLE_CHUNKS) -> Column:
    """Up to ``count`` chunks of a text's bytes, the first, the last and evenly between."""
    data, n = text.cast("binary"), F.octet_length(text)
    chunks = F.greatest(F.lit(1), F.ceil((n - CHUNK) / STRIDE) + 1)
    taken = F.least(chunks, F.lit(count))
    at = lambda i: F.round(i * (chunks - 1) / F.greatest(taken - 1, F.lit(1))).cast("int") * STRIDE
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (taken - 1).cast("int")), lambda i: F.substring(data, at(i) + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<binary>"))


def labelled_chunks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, rows: int = SAMPLE_ROWS) -> list[tuple[list[bytes], int]]:
    """Chunks and label of each sampled row, in a fixed order."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out(F.col("id"), folds)).groupBy("id").agg(F.min("label").alias("label"))
    some = F.broadcast(hashed_sample(known, rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") > 0)
    # the texts of one id are many at most in one place of the sum, not here
    each = texts.join(some, "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), spread_chunks(F.col("text")).alias("chunks"))).alias("first"))
    found = each.select("id", "label", "first.chunks").collect()
    return [([bytes(c) for c in r.chunks], r.label) for r in sorted(found, key=lambda r: str(r.id))]


_models: dict[str, dict[str, np.ndarray]] = {}


def trained(sample: list[tuple[list[bytes], int]]) -> dict[str, np.ndarray]:
    """Weights from a sample; the same sample trains once."""
    key = hashlib.sha256(repr(sample).encode()).hexdigest()
    if key not in _models:
        model = ByteCNN()
        y = np.array([float(label > 0) for _, label in sample])
        if 0 < y.sum() < len(y):
            model.train([np.concatenate([chunks_of(s) for s in symbols_of(chunks)]) for chunks, _ in sample], y)
        else:
            model.w["out"][:] = 0
            model.w["out_b"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        _models.clear()
        _models[key] = model.w
    return _models[key]


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cutoff: float = CUTOFF, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``."""
    bounded_batches(docs.sparkSession)
    weights = trained(labelled_chunks(docs, labels, id_col, text_col, label_col, folds))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ByteCNN()
        model.w = weights
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()), dtype="float64")

    row = F.col(f"`{id_col}`")
    rows = docs.select(row.alias("doc_id"), held_out(row, folds).alias("held_out"), pandas_udf(scored, "double")(blank_to_empty(F.col(f"`{text_col}`")).cast("binary")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
