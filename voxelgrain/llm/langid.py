"""Language identification by a byte convolutional network.

Byte embeddings, convolutions of several widths, max pooling over a window and a softmax, trained in NumPy on a
bounded sample of labelled texts; every window of every whole text is then scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, refuse_own_names
from .textkernel import sliced, text_buffers

UNDETERMINED = "und"
_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Windows scored at once, so that the unrolled patches stay in cache.
_BLOCK = 96


@dataclass(frozen=True)
class LanguageConfig:
    """``sample`` bounds the labelled texts learnt from, and so the classes: at least one text of each is learnt."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    sample: int = 4000
    epochs: int = 8
    batch: int = 64
    rate: float = 4e-3
    seed: int = 13


class ByteCNN:
    """The network; ``windows`` are uint8 arrays (n, window), padded with zeros."""

    def __init__(self, classes: list[str], config: LanguageConfig) -> None:
        rng = np.random.default_rng(config.seed)
        self.classes, self.config = classes, config
        e, f = config.embedding, config.filters
        self.w = {"embed": rng.normal(0, 0.5, (256, e))}
        for k in config.widths:
            self.w[f"conv{k}"] = rng.normal(0, 1 / np.sqrt(k * e), (k * e, f))
        self.w["bias"] = np.zeros(f * len(config.widths))
        self.w["out"] = rng.normal(0, 0.1, (f * len(config.widths), len(classes)))
        self.w["out_bias"] = np.zeros(len(classes))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.w["embed"][0] = 0

    def _patches(self, windows: np.ndarray, width: int, embedded: np.ndarray) -> np.ndarray:
        n, length, e = embedded.shape
        flat = sliding_window_view(embedded.reshape(n, length * e), width * e, axis=1)[:, ::e]
        return flat.reshape(-1, width * e)

    def _pool(self, windows: np.ndarray, where: bool = False):
        embedded = self.w["embed"][_FOLD[windows]]
        best, at = [], []
        for k in self.config.widths:
            rows = len(windows)
            act = (self._patches(windows, k, embedded) @ self.w[f"conv{k}"]).reshape(rows, -1, self.config.filters)
            best.append(act.max(axis=1))
            if where:
                at.append(act.argmax(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.w["bias"], 0), at, embedded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for i in range(0, len(windows), _BLOCK):
            hidden, _, _ = self._pool(windows[i : i + _BLOCK])
            z = hidden @ self.w["out"] + self.w["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + _BLOCK] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, windows: np.ndarray, target: np.ndarray) -> ByteCNN:
        """Adam on the cross entropy, classes weighted evenly."""
        c = self.config
        rng = np.random.default_rng(c.seed + 1)
        weight = len(target) / (len(self.classes) * np.maximum(np.bincount(target, minlength=len(self.classes)), 1))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for _ in range(c.epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), c.batch):
                pick = order[i : i + c.batch]
                grads = self._gradients(windows[pick], target[pick], weight[target[pick]].astype(np.float32))
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= (c.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n, f, e = len(windows), self.config.filters, self.config.embedding
        hidden, at, embedded = self._pool(windows, where=True)
        z = hidden @ self.w["out"] + self.w["out_bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), target] -= 1
        p *= weight[:, None] / n
        grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0)}
        back = (p @ self.w["out"].T) * (hidden > 0)
        grads["bias"] = back.sum(axis=0)
        grads["embed"] = np.zeros_like(self.w["embed"])
        codes = _FOLD[windows]
        for b, k in enumerate(self.config.widths):
            g = back[:, b * f : (b + 1) * f]
            taps = at[b][:, :, None] + np.arange(k)
            rows = np.arange(n)[:, None, None]
            patch = embedded[rows, taps].reshape(n, f, k * e)
            grads[f"conv{k}"] = np.einsum("nf,nfd->df", g, patch)
            spread = (g[:, :, None] * self.w[f"conv{k}"].T[None]).reshape(n, f, k, e)
            np.add.at(grads["embed"], codes[rows, taps], spread)
        return grads


def windows_of(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All fixed-length windows of the texts, last one of each padded with zeros, and the text each belongs to."""
    lengths = np.diff(offs)
    counts = -(-lengths // width)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    start = offs[:-1][owner] + (np.arange(len(owner)) - first[owner]) * width
    place = start[:, None] + np.arange(width)
    inside = place < offs[1:][owner][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), owner


def fit_language_model(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> ByteCNN | None:
    """Train on at most ``config.sample`` rows that are not held out, about equally many of each language.

    The driver gets language counts and, for each sampled row, two windows of its text; never whole texts.
    None when no row is labelled.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.sample).collect()
    if not counts:
        return None
    each = max(1, config.sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.1 * each / r["count"] + 10 / r["count"]))])
    turn = draw / F.element_at(rate, F.col("lang"))  # 0 to 1 within each language, so that the limit takes all alike
    at = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - config.window, F.lit(1))).cast("int")
    sample = (
        known.where((F.length("text") > 0) & (turn < 1))
        .select(turn.alias("turn"), "doc_id", "lang", F.substring("text", 1, config.window).alias("head"), F.col("text").substr(at + 1, F.lit(config.window)).alias("inner"))
        .orderBy("turn", "doc_id", "lang", "head")
        .limit(config.sample)
        .toArrow()
    )
    langs = sample.column("lang").to_pylist()
    if not langs:
        return None
    classes = sorted(set(langs))
    blocks = []
    for name in ("head", "inner"):
        raw = [x.encode()[: config.window] for x in sample.column(name).to_pylist()]
        blocks.append(np.frombuffer(b"".join(x.ljust(config.window, b"\0") for x in raw), np.uint8).reshape(-1, config.window))
    index = {c: i for i, c in enumerate(classes)}
    target = np.array([index[x] for x in langs])
    return ByteCNN(classes, config).fit(np.concatenate(blocks), np.concatenate([target, target]))


def score_batch(model: ByteCNN, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its mean probability over all windows of each text, windows weighted by their letters."""
    data, offs = text_buffers(column)
    n, width = len(offs) - 1, model.config.window
    total = np.zeros((n, len(model.classes)))
    i = 0
    while i < n:  # at most a megabyte of windows at once, long texts in parts
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 20), "right")) - 1)
        for part in range(int(offs[i]), max(int(offs[j]), int(offs[i]) + 1), 1 << 20):
            stop = min(part + (1 << 20), int(offs[j])) if j == i + 1 else int(offs[j])
            own = np.clip(offs[i : j + 1], part, stop)
            windows, owner = windows_of(data[part:stop], own - part, width)
            if len(windows):
                letters = _LETTER[windows].sum(axis=1)
                np.add.at(total, owner + i, model.probabilities(windows) * letters[:, None])
            if j > i + 1:
                break
        i = j
    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    best = share.argmax(axis=1)
    ascii_letter = np.concatenate([[0], np.cumsum((_LETTER[data] > 0) & (data < 128))])
    plain = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    texts = column.to_pylist() if not plain.all() else None
    langs = [model.classes[b] if plain[k] or any(ch.isalpha() for ch in texts[k] or "") else UNDETERMINED for k, b in enumerate(best)]
    score = np.where([x == UNDETERMINED for x in langs], 0.0, np.clip(share.max(axis=1), 0, 1)) if n else np.zeros(0)
    return langs, score


def with_language(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``docs`` with ``__vg_lang`` and ``__vg_score`` appended; columns named so raise ValueError."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    refuse_own_names(docs)
    names = docs.columns
    place = names.index("text")
    if model is None:
        return docs.withColumns({"__vg_lang": F.lit(UNDETERMINED), "__vg_score": F.lit(0.0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place):
            langs, score = score_batch(model, batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "__vg_lang", "__vg_score"])

    schema = StructType([*docs.schema.fields, StructField("__vg_lang", StringType()), StructField("__vg_score", DoubleType())])
    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Defined cases: a null text, an empty one or one without a letter is ``und`` with score 0; a null id is not held
    out and not learnt from; rows with a null language are scored but not learnt from; with no labelled row at all
    every text is ``und``; an empty table gives no rows. Language and source never enter a prediction.
    """
    model = fit_language_model(docs.select("doc_id", "text", "lang"), config)
    scored = with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__vg_lang").alias("lang_pred"), F.col("__vg_score").alias("score"))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = 0.07, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Documents in a known language (one of ``languages``, if given), all columns; the rest go.

    A score must be ``least`` of the way from chance (one over the number of learnt languages) to certainty, so that the
    bound keeps its meaning with any number of languages. Null texts, and texts without a letter, go; rows with a null id or
    language are judged like others; with nothing to learn from every row goes; an empty table gives no rows.
    """
    model = fit_language_model(docs.select("doc_id", "text", "lang"), config)
    scored = with_language(docs, model)
    chance = 1 / len(model.classes) if model else 1.0
    known = (F.col("__vg_lang") != UNDETERMINED) & (F.col("__vg_score") >= chance + least * (1 - chance) - 1e-6)
    if languages is not None:
        known &= F.col("__vg_lang").isin(*languages)
    return scored.where(known).select(*docs.columns)
