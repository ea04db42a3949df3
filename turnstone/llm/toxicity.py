"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (with word marks) and of its own hash, so that
misspellings never seen share most of their vectors with the words they come from.  The vectors of a
passage of PASSAGE words are averaged and go through a linear softmax of two classes; passages overlap
and cover the whole text.  The odds of a text are the mean of the odds of its passages, in training as
in use, so a text that is repeated keeps its score, however long it becomes.  (One average over all words
of a document drowns a few toxic words among hundreds of clean ones; the README has the figures.)
The model is linear up to the softmax, so in use a word is one number, the mean over its n-grams of
the difference of the two classes' scores; each distinct word is hashed once.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import Memo, bound_batches, labelled_sample, split_column

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
PASSAGE = 2
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 10  # bounds of what a model is fitted on: texts, and about the bytes of each
EPOCHS, BATCH, RATE = 12, 64, 0.15
LEAST_STEPS = 600  # small samples are gone over more often
THRESHOLD, SPLIT, HELD = 0.3, 4, 2
WORDS = re.compile(r"\w+")
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word."""
    marked = f"<{word}>"
    raw = [marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)]
    raw.append(marked)
    return [crc32(g.encode()) % BUCKETS for g in raw]


def split_words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def passages(values: np.ndarray) -> np.ndarray:
    """Means over all runs of PASSAGE words; a shorter text is one passage."""
    n = len(values)
    if n <= PASSAGE:
        return values.mean(keepdims=True)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[PASSAGE:] - sums[:-PASSAGE]) / PASSAGE


def odds(z: np.ndarray) -> tuple[float, np.ndarray]:
    """Logit of the mean of the passages' odds, and the share of each in it."""
    top = z.max()
    e = np.exp(z - top)
    total = e.sum()
    return float(top + np.log(total / len(z))), e / total


def text_gradient(values: np.ndarray, shift: float, y: int) -> tuple[np.ndarray, float]:
    """How the cross entropy of a text of label ``y`` changes with each word's number, and with the shift."""
    z, share = odds(passages(values) + shift)
    d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
    width = min(PASSAGE, len(values))
    return np.convolve(share, np.full(width, d / width)), d


#: The log odds of a text where no label was learned.
UNLEARNED = -30.0


class SubwordBag:
    """Vectors of the buckets, and weights and biases of the two classes."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM).astype(np.float32)
        self.weights = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
        self.biases = np.zeros(2, np.float32)
        self.ready()

    def ready(self) -> None:
        """What scoring needs: one number for each bucket."""
        self.scalars = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        self.shift = float(self.biases[1] - self.biases[0])
        self._remember()

    def _remember(self) -> None:
        scalars = self.scalars.tolist()

        def solve(word: str) -> float:
            found = subwords(word)
            return sum([scalars[b] for b in found]) / len(found)

        self.known = Memo(solve)

    def score(self, text: str | None) -> float:
        words = split_words(text)
        z = self.shift
        if words:
            z += odds(passages(np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))))[0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 4) -> "SubwordBag":
        """Adagrad on the cross entropy of the texts; the rare class is weighted up.

        Without texts of both classes nothing can be learned and no text is called toxic: each scores about zero.
        """
        rng = np.random.default_rng(seed)
        index: dict[str, int] = {}
        grams, ends, texts = array("i"), array("i"), []  # flat, for lists of buckets would take many times the memory
        for text, y in sample:
            own = array("i")
            for word in split_words(text):
                at = index.get(word)
                if at is None:
                    at = index[word] = len(index)
                    grams.extend(subwords(word))
                    ends.append(len(grams))
                own.append(at)
            if own:
                texts.append((np.array(own), int(y)))
        if len({y for _, y in texts}) < 2:
            self.scalars, self.shift = np.zeros(BUCKETS, np.float32), UNLEARNED
            self._remember()
            return self
        flat, first = np.array(grams), np.concatenate([[0], np.array(ends)])
        sizes = np.diff(first)
        del index, grams, ends
        positive = max(1, sum(y for _, y in texts))
        lift = (1.0, min(4.0, max(1.0, (len(texts) - positive) / positive)))
        seen, seen_w, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        slot = np.zeros(len(sizes), np.int64)
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))
        for epoch in range(epochs):
            order, rate = rng.permutation(len(texts)), RATE * (1 - 0.8 * epoch / epochs)
            for at in range(0, len(order), BATCH):
                some = [texts[k] for k in order[at : at + BATCH]]
                used = np.unique(np.concatenate([w for w, _ in some]))
                slot[used] = np.arange(len(used))
                lengths = sizes[used]
                ends = np.cumsum(lengths)
                rows = flat[np.repeat(first[used] - ends + lengths, lengths) + np.arange(ends[-1])]
                means = np.add.reduceat(self.vectors[rows], ends - lengths, axis=0) / lengths[:, None]
                direction = self.weights[:, 1] - self.weights[:, 0]
                scalar, shift = means @ direction, self.biases[1] - self.biases[0]
                pull, grad_b = np.zeros(len(used)), 0.0  # how far each word's mean is to move along the direction
                for words, y in some:
                    own = slot[words]
                    spread, d = text_gradient(scalar[own], shift, y)
                    scale = lift[y] / len(some)
                    grad_b += d * scale
                    pull += np.bincount(own, spread * scale, len(used))
                grad_w = pull @ means
                grad_w = np.stack([-grad_w, grad_w], axis=1)
                each = np.bincount(rows, np.repeat(pull / lengths, lengths), BUCKETS)
                touched = np.flatnonzero(each)
                grad = each[touched, None] * direction
                seen[touched] += (grad * grad).mean(axis=1)
                self.vectors[touched] -= rate * grad / np.sqrt(seen[touched])[:, None]
                seen_w += grad_w**2
                self.weights -= rate * grad_w / np.sqrt(seen_w)
                step_b = np.array([-grad_b, grad_b])
                seen_b += step_b**2
                self.biases -= rate * step_b / np.sqrt(seen_b)
        self.ready()
        return self

    def __getstate__(self):
        return {"scalars": self.scalars, "shift": self.shift}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._remember()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SubwordBag:
    """Fit on at most SAMPLE_ROWS labelled texts, none of them held out; of a longer one on a window of SAMPLE_BYTES bytes."""
    picks = labels.where(split_column(id_col, SPLIT) != HELD).select(id_col, label_col)
    return SubwordBag().fit(labelled_sample(docs, picks, id_col, text_col, label_col, SAMPLE_ROWS, SAMPLE_BYTES))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    A null text and a text without words get the score of no words; a null id is scored all the same; null
    labels are not learned from; without learnable labels of both
    classes every text scores about zero and none is toxic.  Repeated rows stay
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


def without_toxic(docs: DataFrame, model: SubwordBag, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, with all their columns; nothing is shuffled.

    A null text, and one without words, has the score of no words; null ids stay as they are, repeated rows
    stay or go together, an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
