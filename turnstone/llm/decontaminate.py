"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of lower-case words.  A document holds an item if some run of its
words is within ``words // EDIT_SHARE`` word edits of the item.

1. Windows.  Items of about the same number of words (within SIZE_RATIO) make a band.  A band has a stride
   of a STRIDES-th of its shortest item: document windows start at every stride-th word, and each item is
   entered once for each of its first stride words, so one of its entries starts where a window does.
2. Embedding.  Windows and entries walk through their words under shared random bits (Chakraborty, Goldenberg,
   Koucky 2016): at each step the current word is written and the walk moves on or not, by a random bit of
   step and word.  Few edits become few differing places.
3. LSH.  REPEATS times in each of WALKS walks, SAMPLES places of the embedding are the bucket of a window
   or an entry; a window meets only the entries of its buckets.  Places are drawn from the steps that a walk
   takes to pass the band's shortest entry.  The numbers are set for TARGET_RECALL of the windows at the largest
   permitted number of edits; tests measure it, and how many windows meet nothing.
4. Verification.  The least edit distance between item and any run of words around the window, exactly.

A window with more words that no item has than the band's items may have edits can't match and isn't embedded.

Items are the stated query set: they go to the executors in blocks of bounded size, each block against
all rows.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import bound_batches, keep

EDIT_SHARE = 5  # one edit for so many words of an item
WALKS, REPEATS, SAMPLES = 10, 16, 4
STEPS_A_WORD = 1.6  # a walk moves on at every other step
SIZE_RATIO, STRIDES = 1.5, 3
TARGET_RECALL = 0.99  # of windows at the largest permitted number of edits; tests measure it
BLOCK_WORDS = 100_000  # words of the items of one block
SEGMENT, STARTS = 1 << 17, 1 << 12  # words of the texts that are searched at once, windows embedded at once
KEPT_TABLES = 1000
OTHER, BREAK, END = 0, 1, 2  # words that no item has, the border of two texts, the end of an item
WORDS = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, item_words int, start_word long, n_words int, edits int, similarity double"


def split_words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """One random walk: its bits of step and word, for words numbered up to ``n_words``."""

    def __init__(self, number: int, n_words: int):
        self.number, self.words = number, np.arange(n_words, dtype=np.uint64)
        self.tables: dict[int, np.ndarray] = {}

    def bits(self, part: int) -> np.ndarray:
        """The bits of 64 steps for each word; borders and ends hold a walk back."""
        found = self.tables.get(part)
        if found is None:
            found = _mix((self.words + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), 1 + 1000 * self.number + part)
            found[[BREAK, END]] = 0
            if len(self.tables) < 64:
                self.tables[part] = found
        return found


def cgk(words: np.ndarray, starts: np.ndarray, steps: np.ndarray, walk: Walk, known: dict[int, np.ndarray]) -> np.ndarray:
    """What stands at some steps (ascending) of the walks from ``starts``: steps x starts.

    ``words`` ends with a border.  ``known`` keeps the bits of its words between calls.
    """
    out = np.empty((len(steps), len(starts)), np.uint32)
    at, row, bits = starts.astype(np.int64), 0, None
    move, one = np.empty(len(starts), np.uint64), np.uint64(1)
    for step in range(int(steps[-1]) + 1):
        if step % 64 == 0:
            bits = known.get(step // 64)
            if bits is None:
                bits = known[step // 64] = walk.bits(step // 64)[words]
        if steps[row] == step:
            np.take(words, at, out=out[row], mode="clip")
            row += 1
        np.take(bits, at, out=move, mode="clip")
        move >>= np.uint64(step % 64)
        move &= one
        at += move.view(np.int64)
    return out


class Buckets:
    """The entries of one walk by bucket: for each repetition, the sum of the sampled words, each times its sample's factor."""

    def __init__(self, keys: np.ndarray):
        repeats, n = keys.shape
        self.base = np.arange(repeats, dtype=np.uint32)[:, None]
        numbered = (self.base.astype(np.uint64) << np.uint64(32) | keys).ravel()
        order = np.argsort(numbered, kind="stable")
        self.sorted, self.order = numbered[order], (order % n).astype(np.int32)
        size = min(24, max(12, ((64 if n < 4096 else 8) * n).bit_length()))
        self.shift = np.uint32(32 - size)
        self.base <<= np.uint32(size)
        self.bitmap = np.zeros(repeats << size, bool)
        self.bitmap[self.base + (keys >> self.shift)] = True

    def meet(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(repetition, window, entry) that share a bucket's number."""
        there = np.flatnonzero(np.take(self.bitmap, (keys >> self.shift) + self.base))
        numbered = (there // keys.shape[1]).astype(np.uint64) << np.uint64(32) | keys.ravel()[there]
        low = np.searchsorted(self.sorted, numbered)
        same = np.flatnonzero(self.sorted[np.minimum(low, len(self.sorted) - 1)] == numbered)
        there, low = there[same], low[same]
        many = np.searchsorted(self.sorted, numbered[same], "right") - low
        index = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        repeat, window = np.divmod(np.repeat(there, many), keys.shape[1])
        return repeat, window, self.order[index]


class Band:
    """Items of about the same size: their entries in the buckets of all repetitions."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, edits: np.ndarray, places: np.ndarray, words: np.ndarray, walks: list[Walk], seed: int):
        least = int(sizes[members].min())
        self.stride = max(1, least // STRIDES)
        # words from a window's start that are part of any match of an item of some size, and how many of them may be edited
        inside = {(max(1, int(n - self.stride - k + 1)), int(k)) for n, k in zip(sizes[members], edits[members])}
        self.inside = [(w, k) for w, k in sorted(inside) if not any(v <= w and j >= k and (v, j) != (w, k) for v, j in inside)]
        steps = max(1, int(STEPS_A_WORD * (least - self.stride + 1)))
        rng = np.random.default_rng(seed)
        # each sample from its own part of the steps: then they rarely fall on one word
        parts = np.arange(SAMPLES) * steps // SAMPLES
        wide = np.maximum(1, (np.arange(SAMPLES) + 1) * steps // SAMPLES - parts)
        drawn = parts + (rng.random((len(walks), REPEATS, SAMPLES)) * wide).astype(np.int64)
        self.steps = [np.unique(d) for d in drawn]
        self.at = [np.searchsorted(s, d) for s, d in zip(self.steps, drawn)]
        factors = rng.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
        self.factors = [factors[np.searchsorted(parts, s, "right") - 1][:, None] for s in self.steps]
        self.item = np.repeat(members, self.stride)
        self.offset = np.tile(np.arange(self.stride), len(members))
        self.sampled, self.buckets = [], []
        for number, walk in enumerate(walks):
            columns = cgk(words, places[self.item] + self.offset, self.steps[number], walk, {})
            self.sampled.append(columns)
            self.buckets.append(Buckets(self.keys(columns, number)))

    def keys(self, columns: np.ndarray, number: int) -> np.ndarray:
        """The bucket numbers of a walk: repetitions x starts."""
        columns, at = columns * self.factors[number], self.at[number]
        out = columns[at[:, 0]]
        for k in range(1, SAMPLES):
            out += columns[at[:, k]]
        return out

    def reach(self) -> int:
        return max(int(s[-1]) for s in self.steps) + 1

    def starts(self, place: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Windows with few enough unknown words; ``place`` counts words from each text's begin, ``unknown`` unknown ones."""
        found = np.flatnonzero((place % self.stride == 0) & (place >= 0))
        few = np.zeros(len(found), bool)
        for words, edits in self.inside:
            few |= unknown[np.minimum(found + words, len(unknown) - 1)] - unknown[found] <= edits
        return found[few]

    def meet(self, words: np.ndarray, starts: np.ndarray, number: int, walk: Walk, known: dict[int, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(start, entry) that are in the same bucket of some repetition of one walk."""
        out = []
        for k in range(0, len(starts), STARTS):
            some = starts[k : k + STARTS]
            columns = cgk(words, some, self.steps[number], walk, known)
            repeats, windows, entries = self.buckets[number].meet(self.keys(columns, number))
            if len(windows):  # the same words, not just the same number
                at = self.at[number][repeats]
                same = (columns[at, windows[:, None]] == self.sampled[number][at, entries[:, None]]).all(axis=1)
                out.append((some[windows[same]], entries[same]))
        return out


class Items:
    """A block of items, ready for the search."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.words, self.vocabulary = [], [], {}
        number = self.vocabulary.setdefault
        for item_id, text in items:
            words = split_words(text)
            if words:
                self.ids.append(item_id)
                self.words.append(np.array([number(w, len(self.vocabulary) + 3) for w in words], np.uint32))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = self.sizes // EDIT_SHARE
        places = np.cumsum(self.sizes + 1) - self.sizes - 1
        flat = np.concatenate([np.append(w, np.uint32(END)) for w in self.words]) if self.words else np.zeros(0, np.uint32)
        self.walks = [Walk(k, len(self.vocabulary) + 3) for k in range(WALKS)]
        self.bands: list[Band] = []
        todo = np.argsort(self.sizes, kind="stable")
        while len(todo):
            n = int(np.searchsorted(self.sizes[todo], SIZE_RATIO * self.sizes[todo[0]], "right"))
            self.bands.append(Band(todo[:n], self.sizes, self.edits, places, flat, self.walks, 11 + len(self.bands)))
            todo = todo[n:]
        self.reach = max((b.reach() for b in self.bands), default=0)
        self.own: dict[int, np.ndarray] = {}  # which words an item has
        self.counts = {"windows": 0, "met": 0}  # of windows embedded, and of pairs of window and item that were to be verified

    def hashes(self, text: str | None) -> np.ndarray:
        """The words of a text by number; those that no item has are all OTHER, which equals none of an item's."""
        known = self.vocabulary.get
        return np.array([known(w, OTHER) for w in split_words(text)], np.uint32)

    def candidates(self, words: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows of (window, words from an item's begin to the window's, item), by the buckets.

        ``words`` ends with a border; ``place`` counts them from each text's begin, a border is -1.  So what a
        text meets depends on the text alone, not on those beside it.
        """
        found = []
        for first in range(0, len(words), SEGMENT):
            own = words[first : first + SEGMENT + self.reach]
            if own[-1] != BREAK:
                own = np.append(own, np.uint32(BREAK))
            unknown = np.concatenate([[0], np.cumsum(own <= BREAK)])
            starts = [b.starts(place[first : first + SEGMENT], unknown) for b in self.bands]
            self.counts["windows"] += sum(map(len, starts))
            for number, walk in enumerate(self.walks):
                known: dict[int, np.ndarray] = {}
                for band, some in zip(self.bands, starts):
                    for at, entries in band.meet(own, some, number, walk, known):
                        found.append(np.stack([first + at, band.offset[entries], band.item[entries]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def search(self, texts: list[str | None], any_match: bool = False) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item index, start, words, edits) of the best match of each item that it holds.

        With ``any_match`` of one item that it holds.
        """
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if self.bands and texts:
            own = [self.hashes(t) for t in texts]
            lengths = np.array([len(w) + 1 for w in own], np.int64)
            begins = np.cumsum(lengths) - lengths
            words = np.concatenate([x for w in own for x in (w, np.array([BREAK], np.uint32))])
            place = np.arange(len(words)) - np.repeat(begins, lengths)
            place[begins + lengths - 1] = -1
            met = self.candidates(words, place)
            text_of = np.searchsorted(begins, met[:, 0], "right") - 1
            pairs = np.unique(np.stack([text_of, met[:, 2], met[:, 0] - met[:, 1] - begins[text_of]], axis=1), axis=0)
            self.counts["met"] += len(pairs)
            for n, item, first, last in self._runs(pairs):
                if not best[n] or not any_match and best[n].get(item, (1,))[0]:
                    self._verify(best[n], own[n], first, last, item)
        return [[(item, start, count, edits) for item, (edits, start, count) in sorted(b.items())] for b in best]

    def _runs(self, pairs: np.ndarray):
        """(text, item, first and last begin) of begins so near that one table can verify them together."""
        before = None
        for n, item, start in pairs.tolist():
            if before and before[:2] == [n, item] and start - before[3] <= 2 * self.edits[item] + 1 and start - before[2] <= self.sizes[item]:
                before[3] = start
                continue
            if before:
                yield before
            before = [n, item, start, start]
        if before:
            yield before

    def _verify(self, mine: dict, words: np.ndarray, first: int, last: int, item: int) -> None:
        k, size = int(self.edits[item]), int(self.sizes[item])
        low = max(0, first - k)
        region = words[low : max(0, last + size + k)]
        own = self.own.get(item)
        if own is None:
            own = np.zeros(len(self.vocabulary) + 3, bool)
            own[self.words[item]] = True
            if len(self.own) >= KEPT_TABLES:
                self.own.clear()
            self.own[item] = own
        if np.count_nonzero(own[region]) < size - k:  # too few of the item's words to match
            return
        found = least_edits(self.words[item], region, k)
        if found:
            edits, at, count = found
            mine[item] = min(mine.get(item, (size, 0, 0)), (edits, low + at, count))


def _edit_row(row: np.ndarray, same: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The next row of the edit table: row[j] is the least number of edits up to place j."""
    new = row + np.int32(1)
    np.minimum(new[1:], row[:-1] + ~same, out=new[1:])
    new -= steps
    np.minimum.accumulate(new, out=new)
    new += steps
    return new


def least_edits(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, words) of the run in ``region`` nearest to ``item``, if it is within ``most`` edits.

    Of several the one that ends first, then the longest.
    """
    steps = np.arange(len(region) + 1, dtype=np.int32)
    row = np.zeros(len(region) + 1, np.int32)
    for word in item:
        row = _edit_row(row, region == word, steps)
    edits = int(row.min())
    if edits > most or edits >= len(item):
        return None
    end = int(row.argmin())
    back = region[:end][::-1]
    steps = np.arange(end + 1, dtype=np.int32)
    row = steps.copy()
    for word in item[::-1]:
        row = _edit_row(row, back == word, steps)
    n = int(np.flatnonzero(row == edits)[-1])
    return edits, end - n, n


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS):
    """Lists of items of at most about ``block_words`` words, streamed to the driver one partition at a time."""
    block, held = [], 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        words = 1 + len(r.t) // 4
        if block and held + words > block_words:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += words
    if block:
        yield block


@lru_cache(maxsize=1)
def _built(digest: str, block: "Block") -> Items:
    return Items(block.items)


class Block:
    """Items on their way to the executors; a worker builds their buckets once."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = items
        self.digest = hashlib.sha256(repr(items).encode()).hexdigest()

    def __eq__(self, other):
        return isinstance(other, Block) and self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)

    def ready(self) -> Items:
        return _built(self.digest, self)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row and item that it holds, with the best match.

    Null texts hold nothing; null items and items without words are held by nothing; a null id stays
    null; repeated rows give repeated matches.  Other columns are not read, an empty table gives an
    empty result.  Where items fill more than one block, each block's matches are written before the
    next block is read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split(" ")[0] for x in MATCHES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]

    def matches(block: Block) -> DataFrame:
        def run(batches):
            search = block.ready()
            for batch in batches:
                found = []
                for doc_id, held in zip(batch.column(0).to_pylist(), search.search(batch.column(1).to_pylist())):
                    for item, start, n, edits in held:
                        size = int(search.sizes[item])
                        found.append((doc_id, search.ids[item], size, start, n, edits, 1 - edits / size))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        return rows.mapInArrow(run, MATCHES)

    before, out = None, None
    for block in item_blocks(items, item_id_col, item_text_col):
        if before is not None:
            part = keep(matches(Block(before)), "leaks")
            out = part if out is None else out.unionByName(part)
        before = block
    if before is None:
        return spark.createDataFrame([], MATCHES)
    last = matches(Block(before))
    return last if out is None else out.unionByName(last)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns; rows with a null text stay.

    Null ids stay as they are, repeated rows stay or go together, an empty table gives an empty one, without
    items all rows stay.  Where items fill more than one block, the rows are written between blocks.
    """
    bound_batches(docs.sparkSession)

    def clean(docs: DataFrame, block: Block) -> DataFrame:
        def run(batches):
            search = block.ready()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not found for found in search.search(texts, any_match=True)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    before = None
    for block in item_blocks(items, item_id_col, item_text_col):
        if before is not None:
            docs = keep(clean(docs, Block(before)), "clean")
        before = block
    return docs if before is None else clean(docs, Block(before))
