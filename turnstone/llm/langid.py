"""Language identification: script ranges, per-word n-gram scores, Viterbi with a switching penalty.

Each language learns the scripts of its letters and smoothed counts of the character n-grams (with word
marks) of its words.  A word's script narrows the languages to those that use it; its score for each of
these is the log-likelihood of its n-grams, relative to the best and bounded.  The best sequence of
languages over the words of a text, where each switch costs PENALTY, labels spans of the text.  The
text's language is the one whose spans have the most letters.

The language with the largest sum of scores is the best sequence throughout, and needs no search, if no
excursion pays: let the others change among themselves for nothing and take the best of them at each word;
if no run of words then gains more than the two switches that it costs, and none at the beginning or the
end more than one, staying is best.  This is tested with sums alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import bound_batches, labelled_sample, split_column

PENALTY, WORST = 10.0, -6.0
GRAMS, SMOOTH = (2, 3), 0.5
SAMPLE_ROWS, LEAST_ROWS, SAMPLE_BYTES = 3000, 50, 16 << 10  # bounds of what a model is fitted on: texts, least texts of a language, about the bytes of each
KEPT_WORDS = 400_000
SPLIT, HELD = 5, 0
WORDS = re.compile(r"[^\W\d_]+")
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

# First code points of Unicode script ranges; the last of a range is the next one's first less one.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def lowered(text: str) -> str:
    """Lower case, unless that moves characters: then the words' places would be lost."""
    low = text.lower()
    return low if len(low) == len(text) else text


def grams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)]


class LanguageModel:
    """Scripts and n-gram log-probabilities of the learned languages."""

    def __init__(self, sample: list[tuple[str, str]]):
        words: dict[str, Counter] = defaultdict(Counter)
        for text, lang in sample:
            words[lang].update(WORDS.findall(lowered(text)))
        self.langs = sorted(words)
        counts = [Counter() for _ in self.langs]
        uses: dict[str, Counter] = defaultdict(Counter)
        for k, lang in enumerate(self.langs):
            for word, n in words[lang].items():
                uses[script(word)][k] += n
                for g in grams(word):
                    counts[k][g] += n
        letters = [max(1, sum(words[lang].values())) for lang in self.langs]
        # a script belongs to a language that writes at least one word in a hundred in it
        self.scripts = {s: [k for k, n in by.items() if n >= 0.01 * letters[k]] for s, by in uses.items()}
        every = sorted(set().union(*counts)) if counts else []
        self.index = {g: k for k, g in enumerate(every)}
        table = np.zeros((len(every) + 1, len(self.langs)))
        for k, own in enumerate(counts):
            for n in GRAMS:  # each length is a distribution of its own
                of = [g for g in every if len(g) == n]
                total = sum(own[g] for g in of) + SMOOTH * (len(of) + 1)
                at = [self.index[g] for g in of]
                table[at, k] = np.log((np.array([own[g] for g in of]) + SMOOTH) / total)
        # n-grams that no language has say nothing: the last row stays zero
        self.table = table.astype(np.float32)
        self._start()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self.rows = np.zeros((0, max(1, len(self.langs))), np.float32)
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Score the words that aren't known yet, all at once."""
        if len(self.known) > KEPT_WORDS:
            self._start()
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.word_scores(new)])

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The scores of words for each language: 0 for the best, down to WORST."""
        get, none = self.index.get, len(self.index)
        found = [[get(g, none) for g in grams(w)] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        total = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0)
        scripts = list(map(script, words))
        for kind in set(scripts):
            allowed = self.scripts.get(kind)
            if allowed and len(allowed) < len(self.langs):
                barred = [k for k in range(len(self.langs)) if k not in allowed]
                total[np.ix_([k for k, s in enumerate(scripts) if s == kind], barred)] = -np.inf
        return np.maximum(total - total.max(axis=1, keepdims=True), WORST)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text (language, score, spans); spans are character ranges that cover it from its first word on."""
        if not self.langs:
            return [("und", 0.0, []) for _ in texts]
        words = [WORDS.findall(lowered(t or "")) for t in texts]
        self.learn(set().union(*words))
        return [self._label(t, w) for t, w in zip(texts, words)]

    def _label(self, text: str | None, words: list[str]) -> tuple[str, float, list[tuple[int, int, str]]]:
        if not words:
            return "und", 0.0, []
        scores = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
        best = int(scores.sum(axis=0, dtype=np.float64).argmax())
        if stays_best(scores, best, PENALTY):
            path = None
        else:
            path = viterbi(scores.tolist(), PENALTY)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            best = int(np.bincount(path, lengths, len(self.langs)).argmax())
        weights = np.exp(scores)
        score = float((weights[:, best] / weights.sum(axis=1)).mean())
        return self.langs[best], min(1.0, score), self._spans(text, path, best)

    def _spans(self, text: str, path: np.ndarray | None, best: int) -> list[tuple[int, int, str]]:
        if path is None:
            first = WORDS.search(lowered(text)).start()
            return [(first, len(text), self.langs[best])]
        starts = [m.start() for m in WORDS.finditer(lowered(text))]
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
        ends = [starts[c] for c in cuts[1:]] + [len(text)]
        return [(starts[c], end, self.langs[path[c]]) for c, end in zip(cuts, ends)]


def stays_best(scores: np.ndarray, best: int, penalty: float) -> bool:
    """True only if staying in one state is the best sequence; see above."""
    if scores.shape[1] == 1:
        return True
    others = np.delete(scores, best, axis=1).max(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(others - scores[:, best], dtype=np.float64)])
    lows = np.minimum.accumulate(sums)
    return sums.max() <= penalty and sums[-1] - lows[-1] <= penalty and (sums - lows).max() <= 2 * penalty


def viterbi(scores: list[list[float]], penalty: float) -> np.ndarray:
    """The best sequence of states; each switch costs ``penalty``.  Of equal ones the lowest state."""
    value, back = list(scores[0]), []
    states = range(len(value))
    for row in scores[1:]:
        top = max(value)
        leader, floor = value.index(top), top - penalty
        come = [k if value[k] >= floor else leader for k in states]
        value = [(value[k] if value[k] >= floor else floor) + row[k] for k in states]
        back.append(come)
    at = value.index(max(value))
    path = [at]
    for come in reversed(back):
        at = come[at]
        path.append(at)
    return np.array(path[::-1])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most SAMPLE_ROWS texts with a language, none of them held out; of a longer one on a window of SAMPLE_BYTES bytes.

    Each language has an equal part of the rows, but LEAST_ROWS of them if there are so many languages.
    """
    picks = docs.where(split_column(id_col, SPLIT) != HELD).select(id_col, lang_col)
    return LanguageModel(labelled_sample(docs, picks, id_col, text_col, lang_col, SAMPLE_ROWS, SAMPLE_BYTES, LEAST_ROWS))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of each row.

    A text that is null or has no letter is 'und' with score 0 and no spans, as is every text if nothing
    could be learned.  A null id is labelled all the same; null languages are not learned from.  Repeated
    rows stay repeated, other columns are not read, an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col)

    def run(batches):
        for batch in batches:
            found = model.label(batch.column(2).to_pylist())
            spans = [[{"start": a, "end": b, "lang": lang} for a, b, lang in s] for _, _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, SPANS)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (split_column(id_col, SPLIT) == HELD).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)
