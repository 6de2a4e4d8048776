"""Language ID by a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of a window of fixed length; the maximum of each filter
over the window goes through a ReLU and a linear layer with softmax. On one-hot bytes a filter is a table
of 256 weights for each of its positions, so the convolution is a sum of table rows.

Learning uses a bounded sample of labelled documents (``per_label``, ``windows_per_doc``). Prediction reads
every byte of every text: a text is cut into windows and their class probabilities are averaged, weighted by
the bytes a window holds. Windows are computed ``CHUNK`` at a time, so memory doesn't depend on text length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import arrow_slices, short_batches

WIDTHS = (2, 3, 4)
CHUNK = 128
UNDETERMINED = "und"


@dataclass
class ByteNetwork:
    """``tables[o]``: weights of the filters that have a position ``o``."""

    labels: list[str]
    window: int
    filters: int
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], window: int, filters: int, seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        tables = []
        for o in range(max(WIDTHS)):
            wide = sum(w > o for w in WIDTHS)
            table = rng.normal(0, 0.3, (256, wide * filters)).astype(np.float32)
            table[0] = 0  # the padding byte
            tables.append(table)
        n = len(WIDTHS) * filters
        return cls(
            labels, window, filters, tables, np.zeros(n, np.float32),
            rng.normal(0, 1 / np.sqrt(n), (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
        )

    def activations(self, x: np.ndarray) -> np.ndarray:
        """Filter responses (windows, positions, filters) of ``x`` (windows, bytes); filters in order of width."""
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        sums = np.take(self.tables[0], x, axis=0)
        for o in range(1, max(WIDTHS)):
            # position o belongs to the filters wider than o, which are the last ones
            part = np.take(self.tables[o], padded[:, o : o + x.shape[1]], axis=0)
            sums[:, :, sums.shape[2] - part.shape[2] :] += part
        return sums

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.activations(x).max(axis=1) + self.bias, 0)
        logits = pooled @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], filters: int = 16, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Fit by Adam on windows (n, window) of bytes with label numbers; the same input gives the same network."""
    net = ByteNetwork.new(names, windows.shape[1], filters, seed)
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step, n = np.random.default_rng(seed), 0, len(WIDTHS) * filters
    # classes count alike, however many windows each has
    weight = (len(labels) / (len(names) * np.maximum(1, np.bincount(labels, minlength=len(names))))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x, y = windows[rows], labels[rows]
            sums = net.activations(x)
            best = sums.argmax(axis=1)
            raw = np.take_along_axis(sums, best[:, None, :], axis=1)[:, 0, :] + net.bias
            pooled = np.maximum(raw, 0)
            logits = pooled @ net.out + net.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None]
            back = (p @ net.out.T) * (raw > 0)
            grads = []
            padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
            for o, table in enumerate(net.tables):
                cols = np.arange(n - table.shape[1], n)
                byte = np.take_along_axis(padded, best[:, cols] + o, axis=1)
                grad = np.zeros_like(table)
                np.add.at(grad, (byte, np.arange(len(cols))[None, :]), back[:, cols])
                grad[0] = 0
                grads.append(grad)
            grads += [back.sum(axis=0), pooled.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(text: str, window: int) -> np.ndarray:
    """The bytes of ``text`` as rows of ``window``; the last row is padded with zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros((max(1, -(-len(data) // window)), window), dtype=np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", window: int = 256, per_label: int = 500, windows_per_doc: int = 6, seed: int = 7) -> ByteNetwork:
    """Train on at most about ``per_label`` documents of each label and ``windows_per_doc`` windows of each.

    Rows with a null text or label are left out. The rows are drawn by a hash of ``key``, the windows
    evenly over the text. With one label the network knows that one; without labelled rows (or with an empty
    table) it has no labels, and every prediction is ``und`` with the score 0.
    """
    short_batches(labelled.sparkSession)
    clean = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("y"), F.col(text).alias("x"), F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(1 << 20)).alias("draw")
    )
    counts = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    names = sorted(counts)
    if not names:
        return ByteNetwork.new([], window, 1, seed)
    shares = {y: int((1 << 20) * min(1.0, per_label / n)) for y, n in counts.items()}
    chosen = clean.where(F.col("draw") <= F.element_at(F.create_map(*[F.lit(v) for y in names for v in (y, shares[y])]), F.col("y")))

    def cut(frames):
        for frame in frames:
            ys, xs = [], []
            for y, x in zip(frame["y"], frame["x"], strict=True):
                rows = windows_of(x, window)
                for i in np.unique(np.linspace(0, len(rows) - 1, min(len(rows), windows_per_doc)).astype(int)):
                    ys.append(y)
                    xs.append(rows[i].tobytes())
            yield pd.DataFrame({"y": ys, "x": xs})

    sample = chosen.select("y", "x").mapInPandas(cut, "y string, x binary").toPandas().sort_values(["y", "x"], kind="stable")
    number = {y: i for i, y in enumerate(names)}
    x = np.frombuffer(b"".join(sample["x"]), dtype=np.uint8).reshape(-1, window)
    return train(x, sample["y"].map(number).to_numpy(dtype=np.int64), names, seed=seed)


def score(model: ByteNetwork, size: int, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and mean probability of each text."""
    spans, rows, lengths, at = [], [], [], 0
    for x in texts:
        if model.labels and x is not None and any(map(str.isalpha, x)):
            w = windows_of(x, size)
            full = np.full(len(w), size)
            full[-1] = len(x.encode("utf-8", "replace")) - size * (len(w) - 1)
            rows.append(w)
            lengths.append(full)
            spans.append((at, at := at + len(w)))
        else:
            spans.append((at, at))
    if rows:
        data, weight = np.concatenate(rows), np.concatenate(lengths).astype(np.float64)
        p = np.concatenate([model.probabilities(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)])
        run_total = np.vstack([np.zeros(p.shape[1]), np.cumsum(p * weight[:, None], axis=0)])
        run_weight = np.concatenate([[0], np.cumsum(weight)])
    names, scores = [], []
    for start, end in spans:
        if start == end:
            names.append(UNDETERMINED)
            scores.append(0.0)
        else:
            mean = (run_total[end] - run_total[start]) / (run_weight[end] - run_weight[start])
            names.append(model.labels[int(mean.argmax())])
            scores.append(float(min(1.0, max(0.0, mean.max()))))
    return names, scores


def predict(docs: DataFrame, net: ByteNetwork, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``, the mean probability of that label over the text's bytes.

    A text that is null or holds no letter gets ``und`` and the score 0. Columns of those two names are
    replaced; repeated rows are scored alike; an empty table stays empty.
    """
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 100 KB, whatever the input

    at = kept.index(text)

    def run(batches):
        model, size = shared.value, net.window
        for whole in batches:
            for batch in arrow_slices(whole, at, 1 << 20):
                names, scores = score(model, size, batch.column(at).to_pylist())
                out = batch.append_column("lang_pred", pa.array(names, pa.string()))
                yield out.append_column("score", pa.array(scores, pa.float64()))

    fields = docs.select(*kept).schema
    return docs.select(*kept).mapInArrow(run, fields.add("lang_pred", "string").add("score", "double"))
