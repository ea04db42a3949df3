"""Token counts and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnstone.llm import token_counts, token_files

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a", "a  b   c\n\n d", "日本語テスト ▁▁x ▁", "é́ ﬁ \x00 a", "x" * 3000, "<s> </s><unk>", "\t\ta", "a　b", "👩‍👩‍👧 z", " \n x", "\n x \n", "ab" * 50 + " " * 20 + "q", "don't I'LL x's", "<|startoftext|> a<|endoftext|>", "İstanbul ẞ ΟΔΟΣ ½²"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts_of(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def odd_docs(spark):
    rows = [(k, t, "a", 1) for k, t in enumerate(ODD)] + [(None, "null id", None, 2), (3, "  a", "b", 3), (3, "  a", "b", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


def test_counts_equal_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in token_counts.prefix_counts(docs, PIECES).collect()}
    for r in docs.collect():
        assert found[r.doc_id].n_tokens == len(library.encode(r.text)) and found[r.doc_id].n_bytes == len(r.text.encode())


def test_every_prefix(spark, sf, library):
    count = token_counts.PrefixCounter(PIECES)
    rnd = random.Random(5)
    letters = "ab é▁ .\n日x"
    for text in [t for t in ODD if t] + texts_of(spark, sf)[:3] + ["".join(rnd.choice(letters) for _ in range(80)) for _ in range(40)]:
        text = text[:300]
        counts = np.cumsum(np.frombuffer(count.deltas(text), np.int8), dtype=int)
        assert [len(library.encode(text[:k])) for k in range(1, len(text) + 1)] == counts[1:].tolist(), text


def test_truncation_questions_need_no_encoding(spark, library):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = token_counts.prefix_counts(docs, PIECES).select("doc_id", token_counts.chars_within(F.col("prefix_deltas"), F.lit(5)).alias("fits"), token_counts.tokens_at(F.col("prefix_deltas"), F.lit(9)).alias("at"))
    found = {r.doc_id: r for r in rows.collect()}
    best = max(k for k in range(1, len(text) + 1) if len(library.encode(text[:k])) <= 5)
    assert found[1].fits == best and found[1].at == len(library.encode(text[:9]))
    assert found[2].fits == 0 and found[2].at == 0


def test_counts_of_odd_rows(spark, library):
    rows = token_counts.prefix_counts(odd_docs(spark), PIECES).collect()
    assert len(rows) == len(ODD) + 3
    assert sorted(r.n_tokens for r in rows) == sorted(len(library.encode(t or "")) for t in [*ODD, "null id", "  a", "  a"])
    assert token_counts.prefix_counts(odd_docs(spark).limit(0), PIECES).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_pieces_equal_the_library(tokenizer):
    encode = token_files.Encoder(WORDS)
    rnd = random.Random(2)
    alphabet = "abcXYZ'sstdmll é ÉßÀ²½ ×÷ªº.,!?\n\t\x85\xa0\x1c_-09İıŒœẞΣσς日本́ 👩<|endoftext|>"
    for rep in range(60):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(40)]
        if rep % 2:
            texts = ["".join(c for c in t if ord(c) < 0x250) for t in texts]
        wanted = [np.array([*e.ids, 1], "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encode.encode(texts) == wanted


def test_pieces_start_anew_when_full(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 300)
    monkeypatch.setattr(token_files, "GROUP_CHARS", 400)
    encode, rnd = token_files.Encoder(WORDS), random.Random(4)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("abé1.") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 60))) for _ in range(12)]
        wanted = [np.array([*e.ids, 1], "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encode.encode(texts) == wanted


def thue_morse(n, a, b):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def library_ids(tokenizer, texts):
    return [np.array([*e.ids, 1], "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_equal_hashes_are_told_apart(tokenizer, monkeypatch):
    """Thue-Morse words and their complements share all polynomial hashes modulo 2^64."""
    encode, rnd = token_files.Encoder(WORDS), random.Random(5)
    for n in (1024, 2048, 4096, 8192):
        texts = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), "x " + thue_morse(n, "b", "a") + " y " + thue_morse(n, "a", "b")]
        texts += ["".join(rnd.choice("ab") for _ in range(n)) for _ in range(3)]
        assert texts[0] != texts[1] and encode.encode(texts) == library_ids(tokenizer, texts)
        assert encode.encode(texts[::-1]) == library_ids(tokenizer, texts[::-1])
    monkeypatch.setattr(token_files, "MULTIPLIERS", (1, 1))  # now the hashes of all anagrams are equal
    encode = token_files.Encoder(WORDS)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(9))) for _ in range(30)]
        assert encode.encode(texts) == library_ids(tokenizer, texts)


def test_both_routes_give_the_same_ids(tokenizer, monkeypatch):
    texts = ["Abc def 12, ghi!\n" * 3000, "ÉcolE (x)  y\t" * 500, "word " * 200]
    by_pieces = token_files.Encoder(WORDS).encode(texts)
    monkeypatch.setattr(token_files, "GROUP_CHARS", 1)  # no text is plain any more
    assert token_files.Encoder(WORDS).encode(texts) == by_pieces == library_ids(tokenizer, texts)


@pytest.mark.parametrize("n", [1, 2, 5, 40, 700])
def test_a_dictionary_is_trained_at_every_size(n):
    import zstandard

    rnd = random.Random(n)
    samples = [np.array([rnd.randrange(300) for _ in range(rnd.randrange(1, 90))], "<u4").tobytes() for _ in range(n)]
    found = token_files.dictionary_of(samples)
    assert zstandard.ZstdCompressionDict(found, dict_type=zstandard.DICT_TYPE_FULLDICT).dict_id()
    assert token_files.dictionary_of([b"", b""]) == token_files.dictionary_of([]) == b""


def brute_force(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = token_files.token_files(docs.repartition(5), WORDS).collect()
    assert sorted(map(tuple, found)) == brute_force(rows, tokenizer)


def test_small_segments_and_single_documents(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dictionary = token_files.train_dictionary(docs, WORDS, "doc_id", "text")
    segments = token_files.write_segments(docs, WORDS, dictionary, parts=3, segment_bytes=20_000).collect()
    assert len(segments) > 6
    ids = [np.frombuffer(s.doc_ids, "<i8", s.n_docs).tolist() for s in segments]
    flat = [i for s in sorted(zip([(s.part, s.segment) for s in segments], ids)) for i in s[1]]
    assert flat == sorted(flat) and len(flat) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    s = segments[1]
    wanted = [*tokenizer.encode(texts[ids[1][2]], add_special_tokens=False).ids, 1]
    assert token_files.frame_ids(s.content, 2, dictionary).tolist() == wanted
    with pytest.raises(ValueError):
        token_files.frame_ids(s.content, 2, dictionary + b"x")
    with pytest.raises(IndexError):
        token_files.frame_ids(s.content, s.n_docs, dictionary)


def test_dictionary_makes_short_frames_smaller(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.left("text", F.lit(60)))
    dictionary = token_files.train_dictionary(spark.read.parquet(f"{sf}/documents.parquet"), WORDS, "doc_id", "text")
    size = lambda d: sum(len(r.content) for r in token_files.write_segments(docs, WORDS, d).collect())
    assert size(dictionary) < size(b"")


def test_files_of_odd_rows(spark, tokenizer):
    docs = odd_docs(spark)
    found = token_files.token_files(docs, WORDS).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    wanted = brute_force(rows, tokenizer)
    assert sorted(found, key=lambda r: r.start) == [tuple(w) for w in wanted]
    assert token_files.token_files(docs.limit(0), WORDS).count() == 0


def test_stored_files_are_enough(spark, sf):
    """Segments and dictionary, as they lie in the shared folder, give every document's ids."""
    import glob

    from tokenizers import Tokenizer

    from turnstone.llm.common import shared_dir

    stored = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/token-files-*"))
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), stored()
    n = token_files.token_files(docs, WORDS).count()
    (home,) = stored() - before
    dictionary = token_files.stored_dictionary(spark, home)
    assert dictionary
    read = token_files.read_segments(spark.read.parquet(f"{home}/segments"), dictionary).collect()
    library = Tokenizer.from_file(WORDS)
    wanted = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert len(read) == n == len(wanted)
    assert all(np.frombuffer(r.ids, "<u4")[:-1].tolist() == wanted[r.doc_id] for r in read)
