"""Token-id files: a shared zstandard dictionary, one frame for each document, an offset index.

A segment is one file image of about ``segment_bytes`` bytes, little-endian throughout:

    magic "TSIDS001" | sha-256 of the dictionary (32 bytes) | documents u64 | index position u64
    frames, one after the other
    index: for each document frame position u64, frame length u32, ids u32

A document's ids are unsigned 32-bit integers, the end id included.  Any document is read by two
look-ups in the index and the decompression of its own frame; the dictionary, trained on serialized
id arrays of short documents, is what makes short frames small.  Segments hold the documents in
ascending id order, and the rows of the segment table carry the order of the segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import Memo, bound_batches, fresh_path, input_bytes

MAGIC = b"TSIDS001"  # fixed values: magic, head and index entry of a segment
HEAD, ENTRY = "<8s32sQQ", "<QII"
HEAD_SIZE, ENTRY_SIZE = struct.calcsize(HEAD), struct.calcsize(ENTRY)
END_ID, LEVEL = 1, 3
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 4096, 32 << 10
LEAST_DICTIONARY, LEAST_SAMPLES = 1024, 64
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 50_000
SEGMENTS = "part int, segment int, first_id long, n_docs long, n_ids long, doc_ids binary, content binary"
DICTIONARY = "sha256 binary, dictionary binary"
READ = "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary"


# The pre-tokenizer that `Pieces` follows, for texts of characters below U+0250 without apostrophes;
# the numbers and white space among these (all other letters and digits by Unicode category).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LIMIT, SPACES = 0x250, "\t\n\x0b\x0c\r \x85\xa0"
SPACE, LETTER, NUMBER, OTHER = range(4)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
GROUP_CHARS, KEPT_PIECES, KEPT_IDS, KEPT_CHARS = 1 << 19, 800_000, 4_000_000, 12_000_000
INPUT_BYTES = 256 << 20  # stored bytes of the input that go to one range of ids, where the session has fewer partitions


def _kind(c: str) -> int:
    if c in SPACES:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c.lower()[0])[0], OTHER)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """Cuts many texts at once with numpy, and finds the ids of each piece in a table of those it has met.

    A piece is looked up by two polynomial hashes of its lower-case characters, taken from prefix sums, and
    then held against the characters that are stored with it: hashes place a piece, only its characters
    identify it.  A text with a piece that another one has taken the place of is handed back.  The table is
    open-addressed and starts anew when it is full.
    """

    def __init__(self, encode):
        self.encode = encode  # pieces to (flat ids, where each piece's ids begin)
        chars = [chr(c) for c in range(LIMIT)]
        self.kind = np.array([_kind(c) for c in chars], np.uint8)
        self.lower = np.array([ord(c.lower()[0]) for c in chars], np.uint32)
        size = 2 * GROUP_CHARS
        self.powers = [(_powers(m, size), _powers(pow(m, -1, 1 << 64), size)) for m in MULTIPLIERS]
        self.clear()

    def clear(self) -> None:
        size = 1 << (2 * KEPT_PIECES - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros((2, size), np.uint64)
        self.at, self.count = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.ids, self.used, self.known = np.zeros(1 << 16, "<u4"), 0, 0
        self.chars, self.chars_at, self.written = np.zeros(1 << 16, np.uint16), np.zeros(size, np.int64), 0
        self.length = np.zeros(size, np.int32)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash pair, or the empty slot where the search ended; and which were found."""
        slot = (h[0] & self.mask).astype(np.int64)
        found = np.zeros(h.shape[1], bool)
        todo = np.arange(h.shape[1])
        while len(todo):
            s = slot[todo]
            key = self.keys[0, s]
            hit = (key == h[0, todo]) & (self.keys[1, s] == h[1, todo])
            found[todo[hit]] = True
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        return slot, found

    def _add(self, h: np.ndarray, pieces: list[str]) -> None:
        """New pieces of distinct hashes, and these."""
        flat, begins = self.encode(pieces)
        spelt = np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2")  # all below LIMIT: one unit each
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        places = self.written + np.cumsum(lengths) - lengths
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.written + len(spelt) > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.chars[self.written : self.written + len(spelt)] = spelt
        counts = np.diff(np.append(begins, len(flat)))
        todo, slot = np.arange(len(pieces)), (h[0] & self.mask).astype(np.int64)
        while len(todo):
            s = slot[todo]
            free = self.keys[0, s] == 0
            first = np.zeros(len(todo), bool)
            first[np.flatnonzero(free)[np.unique(s[free], return_index=True)[1]]] = True  # one piece to a free slot
            mine, put = todo[first], s[first]
            self.keys[:, put] = h[:, mine]
            self.at[put], self.count[put] = begins[mine] + self.used, counts[mine]
            self.chars_at[put], self.length[put] = places[mine], lengths[mine]
            todo = todo[~first]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        self.used += len(flat)
        self.written += len(spelt)
        self.known += len(pieces)

    def _differ(self, slot: np.ndarray, lengths: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Which pieces aren't the ones in their slots; ``spelt`` has the characters of all, one after the other."""
        wrong = self.length[slot] != lengths
        ends = np.cumsum(lengths)
        shift = self.chars_at[slot] - (ends - lengths)
        shift[wrong] = 0  # these are known to differ; any place will do
        index = np.arange(len(spelt)) + np.repeat(shift, lengths)
        unlike = self.chars[np.minimum(index, len(self.chars) - 1)] != spelt
        if unlike.any():
            wrong |= np.add.reduceat(unlike, ends - lengths) > 0
        return wrong

    def cut(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text; all their characters are below LIMIT and they have no apostrophe.

        None for a text with a piece whose place in the table another piece has.
        """
        lengths = np.array([len(t) + 1 for t in texts])
        chars = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4")
        kind, low = self.kind[chars], self.lower[chars]
        change = np.empty(len(kind) + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        number, solid = kind == NUMBER, kind != SPACE
        starts = np.flatnonzero((change[:-1] | number) & solid)
        ends = np.flatnonzero((change[1:] | number) & solid) + 1
        value = low.astype(np.uint64) + np.uint64(1)
        hashes = np.empty((2, len(starts)), np.uint64)
        for k, (power, inverse) in enumerate(self.powers):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(value)], dtype=np.uint64)])
            h = (sums[ends] - sums[starts]) * inverse[starts]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(MULTIPLIERS[1 - k])
            hashes[k] = h ^ (h >> np.uint64(32))
        hashes[0] |= (hashes[0] == 0).astype(np.uint64)  # zero marks an empty slot
        slot, found = self._find(hashes)
        missing, text = np.flatnonzero(~found), None
        while len(missing):
            new = missing[np.unique(hashes[0, missing], return_index=True)[1]]
            if self.known + len(new) > KEPT_PIECES or self.used > KEPT_IDS or self.written > KEPT_CHARS:
                self.clear()
                missing = np.arange(len(starts))
                new = np.unique(hashes[0], return_index=True)[1]
            text = text or low.tobytes().decode("utf-32-le")
            self._add(hashes[:, new], [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            slot[missing], found = self._find(hashes[:, missing])
            missing = missing[~found]
        counts = self.count[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        raw = self.ids[np.repeat(self.at[slot] - total[:-1], counts) + np.arange(total[-1])].tobytes()
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        cuts = (4 * total[first]).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(starts):
            for k in set((np.searchsorted(first, np.flatnonzero(self._differ(slot, ends - starts, low[solid].astype(np.uint16))), "right") - 1).tolist()):
                out[k] = None
        return out


class Encoder:
    """Ids of texts; each distinct piece of text is encoded once.

    Of a tokenizer that normalises to NFC and lower case and cuts by SPLIT, plain texts are cut by `Pieces`,
    whose new pieces go to the bare BPE model in batches.  All others are cut at spaces and line ends, which
    no token crosses, and each distinct word goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Memo(self._word, size=100_000)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.cuts_here = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": SPLIT}
        self.beyond = re.compile(f"[{chr(LIMIT)}-\U0010ffff'\u0130]").search  # U+0130 becomes two characters in lower case
        if self.cuts_here:
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.last = np.zeros(self.whole.get_vocab_size(), bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.pieces = Pieces(self._pieces)

    def _word(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(self.bare.encode_batch_fast([pieces[k : k + 4000]], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4") for k in range(0, len(pieces), 4000)]
        flat = np.concatenate(parts)
        ends = np.flatnonzero(self.last[flat]) + 1  # the last token of a piece carries the word end
        if len(ends) != len(pieces) or ends[-1] != len(flat):
            raise AssertionError("pieces and word ends differ")
        return flat, np.concatenate([[0], ends[:-1]])

    def plain(self, text: str) -> bool:
        return self.cuts_here and len(text) < GROUP_CHARS and not any(m in text for m in self.marks) and not self.beyond(text)

    def encode(self, texts: list[str | None], end_id: int | None = END_ID) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; a null text counts as empty."""
        end = b"" if end_id is None else struct.pack("<I", end_id)
        out: list[bytes] = [b""] * len(texts)
        group, held = [], 0

        def by_words(text: str | None) -> bytes:
            return b"".join([*map(self.words.__getitem__, (text or "").replace("\n", " ").split(" ")), end])

        def settle():
            for k, ids in zip(group, self.pieces.cut([texts[k] for k in group])):
                out[k] = by_words(texts[k]) if ids is None else ids + end

        for k, text in enumerate(texts):
            if not text or not self.plain(text):
                out[k] = by_words(text)
                continue
            if held + len(text) + 1 > GROUP_CHARS and group:
                settle()
                group, held = [], 0
            group.append(k)
            held += len(text) + 1
        if group:
            settle()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> bytes:
    """A dictionary from the texts of at most SAMPLE_DOCS ids, those with the smallest hashes, if they have at most SAMPLE_CHARS characters.

    The hashes are found in a scan of the ids alone.  Without such texts there is no dictionary.
    """
    hashed = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).cast("string").alias("t"))
    least = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first().h
    if least is None:
        return b""
    short = hashed.where((F.col("h") <= least) & F.length("t").between(1, SAMPLE_CHARS))
    sample = [r.t for r in short.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()]
    return dictionary_of(encoder(tokenizer_path).encode(sample))


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary trained on serialized id arrays; nothing but empty ones gives none.

    Training wants many samples and many times the dictionary's bytes: of few, the dictionary is made
    smaller, down to LEAST_DICTIONARY, and they are given as often as it takes.
    """
    import zstandard

    total = sum(map(len, samples))
    if not total:
        return b""
    size = min(size, max(LEAST_DICTIONARY, total // 16))
    times = max(1, -(-LEAST_SAMPLES // len(samples)), -(-16 * size // total))
    return zstandard.train_dictionary(size, samples * times, level=LEVEL).as_bytes()


def write_segments(docs: DataFrame, tokenizer_path: str, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Encode and pack all rows, in ascending order of id (null first), then of text (null first).

    Range-partitioned by id before anything is encoded, so each text is encoded once, in order.  There are
    ``parts`` ranges, or as many as the session's shuffles have and one for each INPUT_BYTES of input at least.
    A null text counts as empty, an empty table gives no segment, other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // INPUT_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h")
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text").asc_nulls_first()).withColumn("part", F.spark_partition_id()).drop("h")

    def run(batches):
        import zstandard

        encode = encoder(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        digest = hashlib.sha256(dictionary).digest()
        frames, index, ids, size, n_ids, segment, part = [], [], [], 0, 0, 0, None

        def flush():
            head = struct.pack(HEAD, MAGIC, digest, len(frames), HEAD_SIZE + size)
            content = b"".join([head, *frames, *index])
            known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([known], pa.binary()), pa.array([content], pa.binary())], names=["part", "segment", "first_id", "n_docs", "n_ids", "doc_ids", "content"])

        for batch in batches:
            for i, raw, part in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                frame = pack.compress(raw)
                index.append(struct.pack(ENTRY, HEAD_SIZE + size, len(frame), len(raw) // 4))
                frames.append(frame)
                ids.append(i)
                size += len(frame)
                n_ids += len(raw) // 4
                if size >= segment_bytes or len(ids) >= SEGMENT_DOCS:
                    yield flush()
                    frames, index, ids, size, n_ids, segment = [], [], [], 0, 0, segment + 1
        if ids:
            yield flush()

    return placed.select("doc_id", "text", "part").mapInArrow(run, SEGMENTS)


def frame_ids(content: bytes, at: int, dictionary: bytes) -> np.ndarray:
    """The ids of document ``at`` of a segment, by its index entry alone."""
    import zstandard

    magic, digest, n, index = struct.unpack_from(HEAD, content)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a segment of this dictionary")
    if not 0 <= at < n:
        raise IndexError(at)
    start, length, _ = struct.unpack_from(ENTRY, content, index + at * ENTRY_SIZE)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=data).decompress(content[start : start + length]), "<u4")


def read_segments(segments: DataFrame, dictionary: bytes, with_ids: bool = True) -> DataFrame:
    """One row for each stored document: where its ids start in its segment, their number and crc, and the ids.

    A segment of another dictionary, or whose index and frames disagree, raises; no segments give no rows; an id
    that was null is null again.
    """
    digest_wanted = hashlib.sha256(dictionary).digest()

    def run(batches):
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpack = zstandard.ZstdDecompressor(dict_data=data)
        for batch in batches:
            for part, segment, known, content in zip(*(batch.column(k).to_pylist() for k in range(4))):
                magic, digest, n, index = struct.unpack_from(HEAD, content)
                if magic != MAGIC or digest != digest_wanted:
                    raise ValueError("not a segment of this dictionary")
                values, nulls = np.frombuffer(known, "<i8", n), np.frombuffer(known, np.uint8, n, 8 * n).astype(bool)
                starts, counts, crcs, ids, local = [], [], [], [], 0
                for start, length, n_ids in struct.iter_unpack(ENTRY, content[index:]):
                    raw = unpack.decompress(content[start : start + length])
                    if len(raw) != 4 * n_ids:
                        raise ValueError("a frame and its index entry disagree")
                    starts.append(local)
                    counts.append(n_ids)
                    crcs.append(zlib.crc32(raw))
                    ids.append(raw if with_ids else None)
                    local += n_ids
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(values, pa.int64(), mask=nulls), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(ids, pa.binary())], names=["part", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"])

    # a batch holds a few segments only
    return segments.select("part", "segment", "doc_ids", "content").mapInArrow(run, READ)


def stored_dictionary(spark: SparkSession, home: str) -> bytes:
    """The dictionary that was stored beside the segments, held against its sha256."""
    row = spark.read.schema(DICTIONARY).parquet(f"{home}/dictionary").first()
    if hashlib.sha256(row.dictionary).digest() != bytes(row.sha256):
        raise ValueError("the stored dictionary is damaged")
    return bytes(row.dictionary)


def token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows to segments in the shared folder, read them back: doc_id, start, n_tokens, ids_crc32.

    The files are in ``token-files-*`` of the shared folder: ``segments``, and ``dictionary``, a row of the
    dictionary and the sha256 that the segments name; both are read back from there.

    ``start`` counts the ids of all documents before this one.  A null text counts as empty (the end
    id alone); null ids come first; rows of equal id are ordered by a hash of the text, then the
    text, and equal rows follow each other; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, id_col, text_col)
    home = fresh_path(spark, "token-files")
    spark.createDataFrame([(hashlib.sha256(dictionary).digest(), dictionary)], DICTIONARY).coalesce(1).write.parquet(f"{home}/dictionary")
    write_segments(docs, tokenizer_path, dictionary, id_col, text_col).write.option("compression", "zstd").parquet(f"{home}/segments")
    segments = spark.read.schema(SEGMENTS).parquet(f"{home}/segments")
    dictionary = stored_dictionary(spark, home)
    order = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    # one small row for each segment, not for each document
    bases = segments.select("part", "segment", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    read = read_segments(segments, dictionary, with_ids=False)
    bound_batches(spark)
    return read.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
