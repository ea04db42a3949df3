"""Quality classifier: a byte-level convolutional network in numpy.

A filter is a learned table of weights for each of WIDTH neighbouring bytes (a convolution of one-hot
bytes), so a response is a sum of WIDTH look-ups.  The whole text is covered by chunks of CHUNK bytes,
each overlapping its neighbours by half.  Responses are rectified and max-pooled in each chunk; the
mean, the largest and the least of the pooled values over all chunks go through one logistic unit,
with how much of a chunk the text leaves empty: few bytes raise few responses, which is no fault of theirs.
Texts are streamed in slabs, so memory doesn't grow with their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import bound_batches, labelled_sample, split_column

FILTERS, WIDTH, CHUNK = 16, 4, 256
HALF = CHUNK // 2
PAD = 256  # the symbol that stands for no byte
SLAB = HALF * 512
SAMPLE_ROWS, SAMPLE_BYTES = 2400, 16 << 10  # bounds of what a model is fitted on: texts, and about the bytes of each
EPOCHS, BATCH, RATE = 14, 48, 0.01
LEAST_STEPS = 500  # small samples are gone over more often
THRESHOLD, SPLIT, HELD = 0.7, 4, 2
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def empty_share(n_bytes: int) -> float:
    return 1 - min(n_bytes, CHUNK) / CHUNK


class ByteNet:
    """Parameters: tables (WIDTH x 257 x FILTERS), bias, and the weights of the logistic unit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables = (rng.standard_normal((WIDTH, 257, FILTERS)) * 0.3).astype(np.float32)
        self.tables[:, PAD] = 0
        self.bias = np.full(FILTERS, 0.1, np.float32)
        self.weights = np.append(rng.standard_normal(3 * FILTERS) * 0.1, 0).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def responses(self, symbols: np.ndarray) -> np.ndarray:
        """Filter responses at each place of an array that has WIDTH - 1 more symbols than places."""
        n = len(symbols) - WIDTH + 1
        out = np.take(self.tables[0], symbols[:n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.tables[k], symbols[k : k + n], axis=0)
        return out

    def halves(self, raw: bytes):
        """The largest response in each half chunk, slab by slab."""
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, max(1, len(data)), SLAB):
            own = data[at : at + SLAB + WIDTH - 1].astype(np.int64)
            places = min(SLAB, max(1, len(data) - at))
            padded = np.full(-(-places // HALF) * HALF + WIDTH - 1, PAD, np.int64)
            padded[: len(own)] = own[: len(padded)]
            found = self.responses(padded)
            found[places:] = -np.inf
            yield found.reshape(-1, HALF, FILTERS).max(axis=1)

    def pooled(self, raw: bytes) -> np.ndarray:
        """Mean, largest and least of the chunks' pooled values, and the share of a chunk that is left empty."""
        spare = [empty_share(len(raw))]
        total, count = np.zeros(FILTERS), 0
        most, least, before = np.full(FILTERS, -np.inf), np.full(FILTERS, np.inf), None
        for halves in self.halves(raw):
            chain = halves if before is None else np.concatenate([before, halves])
            before = chain[-1:]
            if len(chain) == 1:
                continue
            chunks = np.maximum(np.maximum(chain[:-1], chain[1:]) + self.bias, 0)
            total += chunks.sum(axis=0)
            count += len(chunks)
            most, least = np.maximum(most, chunks.max(axis=0)), np.minimum(least, chunks.min(axis=0))
        if not count:  # a text of one half chunk
            one = np.maximum(before[0] + self.bias, 0)
            return np.concatenate([one, one, one, spare])
        return np.concatenate([total / count, most, least, spare])

    def score(self, text: str | None) -> float:
        z = float(self.pooled((text or "").encode()) @ self.weights + self.offset[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 6) -> "ByteNet":
        """Joint training of filters and unit by Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        data = [(np.concatenate([np.frombuffer(t.encode(), np.uint8).astype(np.int64), np.full((-len(t.encode())) % HALF + WIDTH - 1 + HALF * (not t), PAD)]), max(1, len(t.encode())), float(y)) for t, y in sample]
        params = [self.tables, self.bias, self.weights, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(data)))) if data else 0
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in params]
                for k in order[at : at + BATCH]:
                    self._backward(*data[k], grads)
                step += 1
                rate = RATE * (1 - 0.9 * epoch / max(1, epochs - 1))
                for p, g, (m, v) in zip(params, grads, moments):
                    g /= min(BATCH, len(order) - at)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                self.tables[:, PAD] = 0
        return self

    def _backward(self, symbols: np.ndarray, places: int, y: float, grads: list[np.ndarray]) -> None:
        found = self.responses(symbols)
        found[places:] = -np.inf
        blocks = found.reshape(-1, HALF, FILTERS)
        where = blocks.argmax(axis=1)
        tops = np.take_along_axis(blocks, where[:, None], axis=1)[:, 0]
        where = where + HALF * np.arange(len(where))[:, None]
        if len(tops) > 1:
            first = tops[:-1] >= tops[1:]
            tops, where = np.where(first, tops[:-1], tops[1:]), np.where(first, where[:-1], where[1:])
        values = np.maximum(tops + self.bias, 0)
        n, f = len(values), np.arange(FILTERS)
        most, least = values.argmax(axis=0), values.argmin(axis=0)
        features = np.concatenate([values.mean(axis=0), values[most, f], values[least, f], [empty_share(places)]])
        p = 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset[0], -30, 30)))
        dz = np.float32(p - y)
        grads[2] += dz * features
        grads[3] += dz
        w = self.weights * dz
        back = np.tile(w[:FILTERS] / n, (n, 1))
        back[most, f] += w[FILTERS : 2 * FILTERS]
        back[least, f] += w[2 * FILTERS : 3 * FILTERS]
        back *= values > 0
        grads[1] += back.sum(axis=0)
        filters = np.broadcast_to(f, where.shape)
        for k in range(WIDTH):
            np.add.at(grads[0][k], (symbols[where + k], filters), back)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNet:
    """Fit on at most SAMPLE_ROWS labelled texts, none of them held out; of a longer one on a window of SAMPLE_BYTES bytes."""
    picks = labels.where(split_column(id_col, SPLIT) != HELD).select(id_col, label_col)
    return ByteNet().fit(labelled_sample(docs, picks, id_col, text_col, label_col, SAMPLE_ROWS, SAMPLE_BYTES))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    A null text counts as empty and gets the score of no bytes; a null id is scored all the same; null
    labels are not learned from; without labels the untrained network scores.  Repeated rows stay
    repeated, other columns are not read, an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            scores = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (split_column(id_col, SPLIT) == HELD).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCORES)
