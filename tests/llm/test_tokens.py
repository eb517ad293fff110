"""Ids against the library on whole texts; codec and files as exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithoframe.llm import range_coder, token_binary
from lithoframe.llm.range_coder import decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 0x7FFFFFFE)), max_size=60), min_size=1, max_size=6))
def test_codec(blocks):
    blocks = [np.asarray(b, dtype=np.uint32) for b in blocks]
    got = decode(encode(blocks), [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, got, strict=True))


def test_codec_blocks_alone_and_small():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.5, n).clip(0, 49_000).astype(np.uint16) for n in (3000, 5, 1200)] + [np.tile(np.arange(40, dtype=np.uint16), 60), np.full(4000, 0x7FFFFFFE), rng.integers(0, 0x7FFFFFFF, 4096), np.arange(4096)]
    words = encode(blocks)
    for w, b in zip(words, blocks, strict=True):
        assert (decode([w], [len(b)])[0] == b).all() and w == encode([b])[0]
    assert len(words[3]) < 0.5 * 2 * len(blocks[3]) and len(words[4]) < 260
    for bad in (np.arange(4097), np.asarray([0x7FFFFFFF])):
        with pytest.raises(ValueError):
            encode([bad])


TEXTS = ["Hello  World's the\tcat\n", None, "", "  ", "ÀÉ ß 한국어 <|endoftext|> x<|startoftext|>y", "a b  c\x1cd \x85e", "é ́x 123 don't!!", "x" * 30_000, "İ Σς \U0001f600 \x00", "the cat " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_equal_whole_texts(library):
    rng = random.Random(4)
    pool = "ab'sT1 \t\n.,<|>é́  한İ"
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(300)]
    for remembered in (400_000, 3):
        got = list(token_binary.WordEncoder(PATH, remembered)(texts))
        assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    coder = token_binary.WordEncoder(path)
    assert not coder.by_words and [g.tolist() for g in coder(TEXTS)] == [ids_of(library, t) for t in TEXTS]


def test_words_equal_whole_documents(library, data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert [g.tolist() for g in token_binary.WordEncoder(PATH)(texts)] == [ids_of(library, t) for t in texts]


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_binary, "SHARD_CHARS", 9000)
    rows = [(7 * i % 1000, t, 1, "s") for i, t in enumerate(TEXTS * 2)]
    got = {r.doc_id: r for r in token_binary.round_trip(spark.createDataFrame(rows, "doc_id long, text string, start int, shard string"), PATH).collect()}
    start = 0
    for i, t, _, _ in sorted(rows):
        ids = ids_of(library, t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(5, "x"), (None, "a b c"), (5, "y z"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.start, r.n_tokens) for r in token_binary.round_trip(df, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [False, False, True, True] and sorted(r[2] for r in got) == [1, 2, 3, 4] and got[3][1] + got[3][2] == 10
    again = token_binary.round_trip(df.repartition(3, "text"), PATH)
    assert sorted(map(str, again.collect())) == sorted(map(str, token_binary.round_trip(df, PATH).collect()))
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (0, None)], "doc_id long, text string")
    assert token_binary.round_trip(df.limit(0), PATH).count() == 0
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in token_binary.round_trip(df, PATH).collect()) == [(0, 0, 1), (1, 1, 3), (1, 4, 3)]


def test_damage_is_found():
    data = token_binary.record(b"LFB1", 1, b"abcd", b"wxyz")
    assert token_binary.opened(data, b"LFB1")[2] == b"wxyz"
    with pytest.raises(ValueError):
        token_binary.opened(data[:-1] + b"!", b"LFB1")


class Counted:
    """A tokenizer that counts its calls and the texts that it gets."""

    def __init__(self, inner):
        self.inner, self.calls, self.words = inner, 0, []

    def encode_batch_fast(self, texts, **options):
        self.calls += 1
        self.words += " ".join(texts).split(" ")
        return self.inner.encode_batch_fast(texts, **options)


def test_pieces_are_learnt_once_and_together(library):
    rng = random.Random(5)
    runs = ["".join(rng.choice("abcdé") for _ in range(8)) for _ in range(500)]
    texts = [" ".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(["", ".", ",", "!?"]) for w in runs) + " 2024" for _ in range(4)]
    coder = token_binary.WordEncoder(PATH)
    coder.pieces = told = Counted(coder.pieces)
    assert [g.tolist() for g in coder(texts)] == [ids_of(library, t) for t in texts]
    assert told.calls == 1 and len(told.words) == len(set(told.words)) == len(set(runs)) + 3 + 3  # marks, digits


def test_columns_and_their_slices(library):
    texts = TEXTS + ["a|b a> c'est l'été", "×÷ ŉ ſ Ÿ ĿĀ", "12 3½ x²"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(3), pa.array(texts).slice(2, 5), pa.array(texts)[:0], pa.array([None, None], pa.string())):
        assert [g.tolist() for g in token_binary.WordEncoder(PATH)(column)] == [ids_of(library, t) for t in column.to_pylist()]


def test_code_words_stay(monkeypatch):
    rng = np.random.default_rng(3)
    blocks = [rng.zipf(1.5, n).clip(0, 49_000) for n in (4096, 1777, 1, 0, 2)] + [rng.integers(0, 0x7FFFFFFF, 300), np.tile(np.arange(9), 99)]
    words = encode(blocks)
    assert zlib.crc32(b"|".join(words)) == 700285878
    monkeypatch.setattr(range_coder, "group_shift_indexer", None)
    assert encode(blocks) == words
