"""Language identification by a byte convolutional network.

Filters of several widths run over byte embeddings of fixed-length windows;
their maxima over a window feed a softmax.  Trained in numpy on the driver from
a bounded sample of labelled texts; applied on executors to every window of
every text, in Arrow batches.

Defined cases: a text that is null, empty or has no letter gets ``und`` and
score 0; with no labelled text at all every text gets ``und``.  An input column
named like an output column is replaced, any other name may occur.  Equal texts
get equal predictions, repeated rows too; keys are not read for a prediction,
and only order the sample; every window of a very long text counts; of classes
with equal probability the first in ascending order is taken; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import free_name, sliced, tune, utf8

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
DIMENSIONS = 8


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of WINDOW bytes for each start; bytes past the end are 0, which embeds as zeros."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)


@dataclass
class ByteCNN:
    """Parameters of the network; ``classes`` are the learned language values."""

    classes: list[str]
    embed: np.ndarray = field(repr=False)
    kernel: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    out_bias: np.ndarray = field(repr=False)

    @classmethod
    def fresh(cls, classes: list[str], seed: int) -> ByteCNN:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        embed = rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)
        kernel = rng.normal(0, 0.3, (max(WIDTHS) * DIMENSIONS, n)).astype(np.float32)
        model = cls(classes, embed, kernel, np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))
        model.mask()
        return model

    def mask(self) -> None:
        """A filter of a small width keeps zeros beyond it; byte 0 embeds as zeros."""
        for i, width in enumerate(WIDTHS):
            self.kernel[width * DIMENSIONS :, i * FILTERS : (i + 1) * FILTERS] = 0
        self.embed[0] = 0

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, widest filter x dimensions)"""
        n, reach = len(windows), max(WIDTHS)
        flat = np.zeros((n, (WINDOW + reach - 1) * DIMENSIONS), np.float32)
        flat[:, : WINDOW * DIMENSIONS] = self.embed[windows].reshape(n, -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, reach * DIMENSIONS, axis=1)
        return np.ascontiguousarray(view[:, ::DIMENSIONS])

    def pooled(self, patches: np.ndarray) -> np.ndarray:
        n, positions, width = patches.shape
        return (patches.reshape(-1, width) @ self.kernel).reshape(n, positions, -1)

    def log_softmax(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for i in range(0, len(windows), 64):
            top = np.maximum(self.pooled(self.patches(windows[i : i + 64])).max(axis=1) + self.bias, 0)
            logits = top @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[i : i + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, seed: int) -> None:
        """Adam on cross entropy; gradients flow only through each filter's maximal position."""
        rng = np.random.default_rng(seed)
        names = ("embed", "kernel", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, reach = 0, max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 64):
                rows = order[i : i + 64]
                x, y = windows[rows], labels[rows]
                patches = self.patches(x)
                score = self.pooled(patches)
                best = score.argmax(axis=1)
                pre = np.take_along_axis(score, best[:, None], axis=1)[:, 0] + self.bias
                top = np.maximum(pre, 0)
                logits = top @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (pre > 0)
                chosen = patches[np.arange(len(y))[:, None], best]
                spread = (back[:, :, None] * self.kernel.T[None]).reshape(-1, DIMENSIONS)
                padded = np.zeros((len(y), WINDOW + reach - 1), np.uint8)
                padded[:, :WINDOW] = x
                touched = padded[np.arange(len(y))[:, None, None], best[:, :, None] + np.arange(reach)].reshape(-1)
                grad_embed = np.stack([np.bincount(touched, spread[:, d], 256) for d in range(DIMENSIONS)], axis=1)
                grads = {"embed": grad_embed, "kernel": np.einsum("nf,nfp->pf", back, chosen), "bias": back.sum(axis=0), "out": top.T @ p, "out_bias": p.sum(axis=0)}
                step += 1
                for k in names:
                    g = grads[k].astype(np.float32)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    getattr(self, k)[...] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
                self.mask()

    def predict(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and probability of each text, from all its windows; a window counts by its bytes."""
        total = np.zeros((len(starts), len(self.classes)))
        count = (ends - starts + WINDOW - 1) // WINDOW
        owner = np.repeat(np.arange(len(starts)), count)
        at = starts[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        for i in range(0, len(owner), 1024):
            rows, begin = owner[i : i + 1024], at[i : i + 1024]
            size = np.minimum(ends[rows] - begin, WINDOW)
            probability = np.exp(self.log_softmax(_windows(data, begin, ends[rows])).astype(np.float64))
            np.add.at(total, rows, probability * size[:, None])
        total /= np.maximum(ends - starts, 1)[:, None]
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def train_language_id(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, per_class: int = 500, windows_per_text: int = 2, max_classes: int = 256, epochs: int = 6, seed: int = 17) -> ByteCNN | None:
    """Fits the network on a bounded sample.

    Bounds: ``per_class`` texts of each language (those whose hashed key is smallest) and ``windows_per_text`` windows
    of each text, spread over the whole of it.  More than ``max_classes`` languages are an error: none is left out.
    Rows whose language or text is null, or whose text has no letter, are not learned from.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k"))
    counts = rows.where("l is not null").groupBy("l").count().limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} languages")
    if not counts:
        return None
    classes = sorted(r["l"] for r in counts)
    wanted = {r["l"]: min(1.0, (per_class + 6 * per_class**0.5) / r["count"]) for r in counts}
    share = F.lit(0.0)
    for name, part in wanted.items():
        share = F.when(F.col("l") == name, F.lit(part)).otherwise(share)
    unit = (F.shiftrightunsigned("h", 11).cast("double")) * F.lit(2.0**-53)
    raw = F.col("t").cast("binary")
    size = F.octet_length("t")
    cuts = [F.substring(raw, (F.floor(F.greatest(size - WINDOW, F.lit(0)) * F.lit(i / max(1, windows_per_text - 1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows_per_text)]
    picked = rows.where((unit < share) & F.col("t").rlike(r"\p{L}")).select("l", "h", "k", F.array(*cuts).alias("w"))
    sample: dict[str, list] = {c: [] for c in classes}
    for r in sorted(picked.collect(), key=lambda r: (r["h"], str(r["k"]))):
        if len(sample[r["l"]]) < per_class:
            sample[r["l"]].append([bytes(w) for w in r["w"]])
    classes = [c for c in classes if sample[c]]
    if not classes:
        return None
    cut = sorted({(i, w) for i, c in enumerate(classes) for texts in sample[c] for w in texts if w})
    block = np.zeros((len(cut), WINDOW), np.uint8)
    for i, (_, w) in enumerate(cut):
        block[i, : len(w)] = np.frombuffer(w, np.uint8)
    model = ByteCNN.fresh(classes, seed)
    model.fit(block, np.array([c for c, _ in cut]), epochs, seed)
    return model


def identify_language(docs: DataFrame, model: ByteCNN | None, text: str = "text", *, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` with the predicted language and its probability."""
    tune(docs.sparkSession)
    kept = docs.drop(*(c for c in docs.columns if c.lower() in (lang_col.lower(), score_col.lower())))
    (letter,) = free_name(kept, "has_letter")
    kept = kept.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = [c for c in kept.columns if c != letter]
    schema = T.StructType([*kept.drop(letter).schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            known = np.asarray(batch.column(batch.schema.get_field_index(letter))).astype(bool)
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and known.any():
                data, starts, ends = utf8(batch.column(batch.schema.get_field_index(text)))
                best, probability = model.predict(data, starts[known], ends[known])
                lang[known], score[known] = np.array(model.classes, object)[best], probability
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, lang_col, score_col])

    return kept.mapInArrow(apply, schema)
