"""Language of texts by a small convolutional network over bytes.

Bytes are embedded, filters of several widths slide over windows of fixed length, each
filter's largest response is kept, and a softmax layer reads those. The network is trained in
numpy on windows of a bounded sample of labelled rows and applied to all windows of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytes_np as B

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
EMBED = 8
#: Bound of the training sample: about so many rows of each language, so many windows of each row.
ROWS_PER_LANG = 600
WINDOWS_PER_ROW = 2
EPOCHS, BATCH, RATE, SEED = 10, 64, 4e-3, 11
UNKNOWN = "und"
#: Windows multiplied at a time.
AT_ONCE = 256


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest * EMBED) x filters, zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        wide = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), max(WIDTHS) * EMBED, axis=1)
        return np.ascontiguousarray(wide[:, ::EMBED])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for i in range(0, len(windows), AT_ONCE):
            pooled = np.maximum((self.patches(windows[i : i + AT_ONCE]) @ self.filters).max(axis=1) + self.bias, 0)
            out[i : i + AT_ONCE] = softmax(pooled @ self.dense + self.dense_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    used = np.repeat(np.array(WIDTHS), FILTERS) * EMBED
    return (np.arange(max(WIDTHS) * EMBED)[:, None] < used[None, :]).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Network:
    """Adam on cross-entropy; rare languages weigh as much as common ones. Same input, same network."""
    rng, mask, n_filters = np.random.default_rng(SEED), _mask(), len(WIDTHS) * FILTERS
    f32 = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = Network(
        langs, f32(256, EMBED) * 0.5, f32(*mask.shape) * mask / np.sqrt(mask.sum(axis=0)), np.zeros(n_filters, np.float32),
        f32(n_filters, len(langs)) / np.sqrt(n_filters, dtype=np.float32), np.zeros(len(langs), np.float32))
    parts = [net.embed, net.filters, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    counts = np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    weight = (len(labels) / (len(langs) * counts)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x, y = windows[pick], labels[pick]
            patch = net.patches(x)
            response = patch @ net.filters
            at = response.argmax(axis=1)
            raw = np.take_along_axis(response, at[:, None], 1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            grad = softmax(pooled @ net.dense + net.dense_bias)
            grad[np.arange(len(y)), y] -= 1
            grad *= weight[y][:, None] / len(y)
            back = (grad @ net.dense.T) * (raw > 0)
            best = np.take_along_axis(patch, at[:, :, None], 1)  # batch x filters x patch
            g_filters = np.einsum("bf,bfp->pf", back, best) * mask
            g_patch = (back[:, :, None] * net.filters.T[None]).reshape(*at.shape, max(WIDTHS), EMBED)
            g_embed = np.zeros_like(net.embed)
            for j in range(max(WIDTHS)):
                np.add.at(g_embed, np.take_along_axis(x, at + j, 1), g_patch[:, :, j])
            step += 1
            for k, g in enumerate((g_embed, g_filters, back.sum(0), pooled.T @ grad, grad.sum(0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                parts[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def as_windows(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, the last one padded with zero bytes, and the row of each."""
    n = -(-(at[1:] - at[:-1]) // WINDOW)
    row = np.repeat(np.arange(n.size), n)
    start = at[row] + (np.arange(row.size) - (np.cumsum(n) - n)[row]) * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    inside = place < at[row + 1][:, None]
    return np.where(inside, buf[np.minimum(place, max(buf.size - 1, 0))] if buf.size else 0, 0).astype(np.uint8), row


def held_out(doc_id: Column) -> Column:
    """Rows never learned from. A null id has the checksum of an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, rows: int = ROWS_PER_LANG, each: int = WINDOWS_PER_ROW) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of about ``rows`` rows of each language, chosen by a hash of the id.

    The languages' sizes are counted over all rows; what reaches the driver is bounded by
    languages x rows x windows. Rows without a language or text do not count.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    data = F.col("text").cast("binary")
    start = lambda j: F.pmod(F.xxhash64("doc_id", F.lit(j)), F.greatest(F.length("data") - WINDOW + 1, F.lit(1)))
    picked = usable.where((chance < share[F.col("lang")]) & (F.length("text") > 0)).select("doc_id", "lang", data.alias("data"))
    windows = picked.select("doc_id", "lang", F.posexplode(F.array(*[
        F.substring("data", (start(j) + 1).cast("int"), F.lit(WINDOW)) for j in range(each)])).alias("j", "window"))
    found = sorted((r["lang"], r["doc_id"] or 0, r["j"], bytes(r["window"])) for r in windows.collect())
    langs = sorted({r[0] for r in found})
    x = np.zeros((len(found), WINDOW), np.uint8)
    for i, r in enumerate(found):
        x[i, : len(r[3])] = np.frombuffer(r[3], np.uint8)
    return x, np.array([langs.index(r[0]) for r in found], np.int64), langs


def fit(docs: DataFrame, **bounds: int) -> Network | None:
    """A network for the languages of ``docs``; None if no row can be learned from."""
    windows, labels, langs = sample(docs, **bounds)
    return train(windows, labels, langs) if langs else None


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, net: Network | None, text: Column) -> Column:
    """``(lang, score)`` of a text, the mean probability over all its windows deciding.

    A null text, one without a letter, or any text where nothing was learned is ``und`` with score 0. Only
    the text is looked at.
    """
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(column: pa.Array) -> pa.Array:
        model = known.value
        names, scores = [], []
        for part in B.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t", 1 << 20):
            if model is None:
                names += [UNKNOWN] * part.num_rows
                scores += [0.0] * part.num_rows
                continue
            windows, row = as_windows(*B.text_bytes(part.column("t")))
            total = np.zeros((part.num_rows, len(model.langs)))
            np.add.at(total, row, model.probabilities(windows))
            mean = total / np.maximum(np.bincount(row, minlength=part.num_rows), 1)[:, None]
            best = mean.argmax(axis=1)
            names += [model.langs[k] for k in best]
            scores += mean[np.arange(len(best)), best].clip(0, 1).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    readable = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = F.arrow_udf(run, PREDICTION)(text.cast("string"))
    return F.when(readable, found).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
