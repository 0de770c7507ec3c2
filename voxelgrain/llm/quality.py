"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Labelled documents of a bounded sample become vectors: counts of character-class trigrams, weighted by their rarity and
projected to the leading singular directions. They are broadcast (``sample * rank`` numbers); every document's exact
cosine with all of them is computed in blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out
from .textkernel import text_buffers

_CLASSES = np.zeros(256, np.int64)
_CLASSES[97:123] = _CLASSES[128:] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[[32, 9, 11, 12, 13]] = 4
_CLASSES[10] = 5
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES[_PUNCTUATION] = 6 + np.arange(len(_PUNCTUATION))
_N = 6 + len(_PUNCTUATION)


@dataclass(frozen=True)
class QualityConfig:
    """``sample`` bounds the labelled documents learnt from and broadcast."""

    features: int = 1024
    rank: int = 32
    sample: int = 4000
    neighbours: int = 25
    threshold: float = 0.3
    seed: int = 29


def _slots(config: QualityConfig) -> np.ndarray:
    """Feature of each trigram of classes."""
    codes = np.arange(_N**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((codes >> np.uint64(40)) % np.uint64(config.features)).astype(np.int64)


def trigram_counts(column: pa.Array, config: QualityConfig) -> Iterator[np.ndarray]:
    """Counts by feature, a block of documents at a time; whole texts."""
    slots = _slots(config)
    data, offs = text_buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 19), "right")) - 1), i + 256, n)
        block = np.zeros((j - i) * config.features)
        # a long text is counted in parts that overlap by two bytes
        for part in range(int(offs[i]), max(int(offs[j]), int(offs[i]) + 1), 1 << 20):
            stop = min(part + (1 << 20) + 2, int(offs[j]))
            codes = _CLASSES[data[part:stop]]
            if len(codes) < 3:
                continue
            grams = slots[(codes[:-2] * _N + codes[1:-1]) * _N + codes[2:]]
            place = np.arange(part, stop - 2)
            owner = np.searchsorted(offs[i : j + 1], place, "right") - 1
            inside = place + 2 < offs[i + 1 : j + 1][owner]
            block += np.bincount((owner * config.features + grams)[inside], minlength=len(block))
        yield block.reshape(j - i, config.features)
        i = j


@dataclass
class QualityModel:
    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    config: QualityConfig

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = (np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * self.weights) @ self.directions
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, by similarity; all that are as near as the last one vote, too."""
        similar = self.embed(counts) @ self.vectors.T
        last = max(similar.shape[1] - self.config.neighbours, 0)
        least = np.partition(similar, last, axis=1)[:, last, None]
        weight = np.where(similar >= least, np.square(np.square(np.maximum(similar, 0))) + np.float32(1e-9), np.float32(0))
        score = (weight @ self.labels.astype(np.float32)) / weight.sum(axis=1)
        alike = counts.sum(axis=1) == 0  # nothing to compare: every labelled document is as near
        return np.clip(np.where(alike, self.labels.mean(), score).astype(np.float64), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel | None:
    """Learn from at most ``config.sample`` labelled documents that are not held out; None without any.

    The sample is drawn by a hash of the ids; the driver gets feature counts, never texts.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(config.seed)), "doc_id").limit(config.sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = list(trigram_counts(batch.column(1), config))
            rows = [x.astype(np.float32).tobytes() for b in blocks for x in b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "counts", "quality"])

    # repeated rows of an id count once
    found = texts.mapInArrow(run, "doc_id long, counts binary, quality int").groupBy("doc_id").agg(F.min("counts").alias("counts"), F.max("quality").alias("quality")).toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.float32).reshape(found.num_rows, -1).astype(np.float64)
    share = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    weights = np.log(1 + len(counts) / (1 + (counts > 0).sum(axis=0)))
    _, vectors = np.linalg.eigh((share * weights).T @ (share * weights))
    directions = np.ascontiguousarray(vectors[:, ::-1][:, : config.rank])
    model = QualityModel(weights, directions, np.zeros((0, config.rank), np.float32), (np.array(found.column("quality").to_pylist()) > 0).astype(np.float64), config)
    model.vectors = model.embed(counts)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 at ``config.threshold`` or more).

    Defined cases: a null text, or one of fewer than three bytes, gets the share of label 1 among all learnt from; ties at
    the last place of the nearest all vote; without any label every score is 0.5; labels with a null id or quality are not used, of several for one id the highest; an empty table gives no
    rows; language, source and ids never enter a score.
    """
    model = fit_quality(docs, labels, config)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.vote(c) for c in trigram_counts(batch.column(1), config)] if model else [np.full(len(batch), 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents whose score reaches the threshold, all columns; rows that share an id share the highest score."""
    good = score_quality(docs, labels, config).groupBy("doc_id").agg(F.max("predicted").alias("__vg_good")).where("__vg_good = 1").withColumnRenamed("doc_id", "__vg_doc")
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(F.col("__vg_doc")), "left_semi")
