"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary is that of a sentencepiece BPE model.  The last token of a prefix is the one suffix
that is compatible with the last token of what stands before it: two tokens are compatible if their
joined text is encoded as just these two.  So one pass over a text gives the count of each of its
prefixes, and truncation and budget questions are answered from these counts, with no encoding.

No token crosses from a non-space to a space, so a text falls into units (spaces and what follows)
whose prefix counts are independent; each distinct unit is solved once in a worker's lifetime.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

from turnstone.llm.common import Memo, bound_batches

SPACE = "▁"  # fixed value: how the model writes a space
CACHE_PAIRS = 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary"


class PrefixCounter:
    """Prefix counts of texts under one model."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False  # units carry their own space
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [p.piece for p in proto.pieces if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a token of this model crosses a word boundary")
        self.vocabulary = set(pieces)
        self.endings: dict = {}  # a trie of the reversed tokens; "" marks a token
        for piece in pieces:
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = True
        inside = {c for p in pieces if len(p) > 1 for c in p}
        self.breaks_lines = "\n" not in inside
        self.units = Memo(self.solve)
        self.pairs: dict[tuple[str, str], bool] = {}

    def compatible(self, left: str, right: str) -> bool:
        key = left, right
        known = self.pairs.get(key)
        if known is None:
            found = self.model.encode(left + right, out_type=str)
            # characters outside the vocabulary are encoded as bytes and join with nothing
            known = left not in self.vocabulary or right not in self.vocabulary or found == [left, right]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def solve(self, unit: str) -> bytes:
        """The change of the count at each character of a unit, as signed bytes."""
        n, endings, pairs = len(unit), self.endings, self.pairs
        last: list[str] = [""] * (n + 1)
        count = [0] * (n + 1)
        deltas = bytearray(n)
        for end in range(1, n + 1):
            starts, node, at = [], endings, end
            while at:
                at -= 1
                node = node.get(unit[at])
                if node is None:
                    break
                if "" in node:
                    starts.append(at)
            for start in reversed(starts):
                token = unit[start:end]
                if start:
                    before = last[start]
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[end], count[end] = token, count[start] + 1
                break
            else:  # a character outside the vocabulary: one token for each of its bytes
                if starts:
                    raise AssertionError(f"no token can end {unit[:end]!r}")
                last[end] = unit[end - 1]
                count[end] = count[end - 1] + len(last[end].encode())
            deltas[end - 1] = (count[end] - count[end - 1]) & 255
        return bytes(deltas)

    def split(self, text: str) -> list[str]:
        if self.breaks_lines and "\0" not in text and "  " not in text and text[0] != " " and SPACE not in text:
            return (SPACE + text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0")).split("\0")
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))

    def deltas(self, text: str) -> bytes:
        """One signed byte for the space that the model puts in front and one for each character."""
        if not text:
            return b""
        return b"".join(map(self.units.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_deltas of each row.

    A null text counts as empty: 0 bytes, 0 tokens, no deltas.  A null id stays null, repeated rows
    stay repeated, other columns are not read, an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        count = counter(model_path)
        for batch in batches:
            sizes, tokens, tables = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = count.deltas(text)
                sizes.append(len(text.encode()))
                tokens.append(total(found))
                tables.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tables, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


@F.pandas_udf(IntegerType())
def _tokens_at(deltas, n_chars):
    out = []
    for d, n in zip(deltas, n_chars):
        out.append(0 if n <= 0 else int(np.frombuffer(d or b"", np.int8)[: n + 1].sum(dtype=np.int64)))
    return pd.Series(out, dtype="int32")


def tokens_at(deltas: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from the stored counts."""
    return _tokens_at(deltas, n_chars)


@F.pandas_udf(IntegerType())
def _chars_within(deltas, budget):
    out = []
    for d, most in zip(deltas, budget):
        counts = np.cumsum(np.frombuffer(d or b"", np.int8), dtype=np.int64)[1:]
        fits = np.flatnonzero(counts <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="int32")


def chars_within(deltas: Column, budget: Column) -> Column:
    """Length in characters of the longest prefix of at most ``budget`` tokens."""
    return _chars_within(deltas, budget)
