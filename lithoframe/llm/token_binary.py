"""Token ids as binary shards: range-coded, independently readable blocks with checksums.

Documents are range-partitioned by id; a task tokenizes its shard in id order and writes records: blocks of
ids, each coded from a fresh model (range_coder), and index records with the documents' ids and
lengths. Spark's committer publishes the records' table, so a retried task leaves no half shard.

Record layout, little-endian: magic `LFB1` (block) or `LFI1` (index), u32 count, u32 crc32 of the plain
content, u32 crc32 of the payload, payload. A block's plain content is its ids as u32; an index
record's is the ids of documents as i64, their lengths as u64, and a byte each that is 1 where the id is
null (and 0 in its place), and its payload is that content.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.llm.common import shared_folder, staged
from lithoframe.llm.groups import bounds, runs
from lithoframe.llm.range_coder import decode, encode

#: Ids of a block, blocks coded in step, characters of a shard about, pieces whose ids a worker remembers,
#: bytes of the texts that are looked up at once.
BLOCK, LANES, SHARD_CHARS, REMEMBERED, PIECE = 4096, 4096, 64 << 20, 700_000, 1 << 21
END = 2
HEAD = struct.Struct("<4sIII")
SCHEMA = "shard int, kind int, seq int, record binary"

# The normalizer and the split of a tokenizer that can be fed word by word. It never joins over
# white space, and a run of letters is one piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: What is one piece or some letters of one: letters of which neither composition nor lower case can change the number, or ASCII marks.
SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+|[!-&(-/:;=-@\\[-`{-~]+")
#: Kinds of bytes, and of a key's first byte: white space, letters, marks, digits, and what only the library may take apart.
_WHITE, _LETTER, _MARK, _DIGIT, _ODD = range(5)
#: Letters of two bytes have these first bytes; neither composition nor lower case can change the number of letters, but for the second row.
_LEADS, _NO_LETTERS = (0xC3, 0xC4, 0xC5), (0xC397, 0xC3B7, 0xC4B0, 0xC4B1, 0xC589, 0xC5BF)


def _kinds() -> np.ndarray:
    """Kind of each byte of UTF-8. The apostrophe is odd (contractions), and so is <, which starts special tokens."""
    kind = np.full(256, _ODD, dtype=np.uint8)
    kind[[32, *range(9, 14)]] = _WHITE
    for c in range(33, 127):
        kind[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    kind[[ord("'"), ord("<")]] = _ODD
    kind[[*_LEADS, *range(0x80, 0xC0)]] = _LETTER
    return kind


_KIND = _kinds()


def _between(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of all ranges, one after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - size), size)


def _keys(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The keys of texts that begin in the UTF-8 data at at[:-1], and where each key starts.

    A key is a run of letters, a run of marks or a digit; a word between white space that holds an odd byte is one key.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data >= _LEADS[0]) & (data <= _LEADS[-1]))
    lead = lead[lead + 1 < len(data)]
    kind[lead[np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _NO_LETTERS)]] = _ODD
    cut = np.empty(len(data), dtype=bool)
    cut[:1] = True
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        white = kind == _WHITE
        np.not_equal(white[1:], white[:-1], out=cut[1:])
        cut[at[:-1][at[:-1] < len(data)]] = True
        words = np.append(np.flatnonzero(cut), len(data))
        w = np.unique(np.searchsorted(words, odd, side="right") - 1)
        kind[_between(words[w], words[w + 1] - words[w])] = _ODD
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == _DIGIT
    cut[at[:-1][at[:-1] < len(data)]] = True
    first = np.flatnonzero(cut)
    size = np.diff(first, append=len(data))
    keep = kind[first] != _WHITE
    first, size = first[keep], size[keep]
    ends = np.append(0, np.cumsum(size))
    black = data[kind != _WHITE]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(black)]), first


class _Numbers(dict):
    """Key -> its number; an unknown key gets the next one and is listed, as new keys are learnt together."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordEncoder:
    """Ids of whole texts by a library tokenizer.

    If its file names the split above, texts are cut into keys, the library encodes each distinct key once, and the
    ids of a text are those of its keys in order. Runs of letters or marks and digits are pieces to the library's model;
    words that hold anything else go through the whole library. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.library, self.remembered = Tokenizer.from_file(path), remembered
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = all(re.search("['<]", t["content"]) and not re.search(r"\s", t["content"]) for t in told["added_tokens"])
        self.by_words = special and told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and not told["post_processor"]
        self.pieces = Tokenizer(self.library.model)  # takes pieces in the library's letters for bytes, with spaces between
        self.pieces.pre_tokenizer = WhitespaceSplit()
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        pairs = [(lead, c) for lead in _LEADS for c in range(0x80, 0xC0)]
        self.letters = {byte: letter for pair in pairs for byte, letter in zip(pair, letters.pre_tokenize_str(bytes(pair).decode())[0][0], strict=True)}
        suffix, vocab = told["model"].get("end_of_word_suffix"), self.library.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.last[[n for token, n in vocab.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.number, self.ids, self.first, self.size = _Numbers(), array("I"), array("q"), array("q")

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has) by the library's model."""
        told = b" ".join(pieces).decode("latin-1").translate(self.letters)
        ids = np.asarray(self.pieces.encode_batch_fast([told], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1  # the last id of a piece ends a word, and no other does
        if len(ends) == len(pieces) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        each = [[t.id for t in self.library.model.tokenize(p)] for p in told.split(" ")]
        return np.asarray([n for e in each for n in e], dtype=np.uint32), np.asarray([len(e) for e in each], dtype=np.int64)

    def _learn(self) -> None:
        """The ids of the new keys, whose numbers follow those of the others."""
        plain, odd, cased = [], [], []
        for k, key in enumerate(self.number.new):  # grows by the lower-case forms that are asked for
            text = key.decode()
            if not (text.isascii() and text.isalnum() or SIMPLE.fullmatch(text)):
                odd.append(k)
            elif (lower := text.lower()) == text:
                plain.append(k)
            else:
                cased.append((k, self.number[lower.encode()]))
        keys, self.number.new = self.number.new, []
        known, size, at = len(self.first), np.zeros(len(keys), dtype=np.int64), len(self.ids)
        if plain:
            ids, size[plain] = self._encode([keys[k] for k in plain])
            self.ids.frombytes(ids.tobytes())
        for k in odd:
            ids = self.library.encode(keys[k].decode(), add_special_tokens=False).ids
            self.ids.extend(ids)
            size[k] = len(ids)
        order = np.asarray(plain + odd, dtype=np.int64)
        first = np.zeros(len(keys), dtype=np.int64)
        first[order] = at + np.cumsum(size[order]) - size[order]
        self.first.frombytes(first.tobytes())
        self.size.frombytes(size.tobytes())
        for k, lower in cased:
            self.first[known + k], self.size[known + k] = self.first[lower], self.size[lower]

    def __call__(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text with END."""
        if not self.by_words:
            for text in texts.to_pylist() if isinstance(texts, pa.Array) else texts:
                yield np.asarray([*self.library.encode(text or "", add_special_tokens=False).ids, END], dtype=np.uint32)
            return
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(data or b"", dtype=np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(at, at[a] + PIECE, side="right")) - 1)
            yield from self._some(data[at[a] : at[b]], at[a : b + 1] - at[a])
            a = b

    def _some(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        if len(self.number) > self.remembered:
            self._forget()
        keys, first = _keys(data, at)
        coded = keys.dictionary_encode()
        mine = coded.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.number.__getitem__, mine), dtype=np.int64, count=len(mine))
        if self.number.new:
            self._learn()
        at_ids, sizes, ids = (np.frombuffer(x or array(x.typecode, [0]), dtype=t) for x, t in ((self.first, np.int64), (self.size, np.int64), (self.ids, np.uint32)))
        which = coded.indices.to_numpy()
        size = sizes[number][which]
        flat = ids[_between(at_ids[number][which], size)]
        ends = np.append(0, np.cumsum(size))[np.searchsorted(first, at)]
        del at_ids, sizes, ids  # the arrays can't grow while they are looked at
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            yield np.append(flat[lo:hi], np.uint32(END))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def record(magic: bytes, count: int, plain: bytes, payload: bytes) -> bytes:
    return HEAD.pack(magic, count, zlib.crc32(plain), zlib.crc32(payload)) + payload


def opened(data: bytes, magic: bytes) -> tuple[int, int, bytes]:
    """(count, crc32 of the plain content, payload) of a record; ValueError if it is damaged."""
    kind, count, plain, crc = HEAD.unpack_from(data)
    payload = data[HEAD.size :]
    if kind != magic or zlib.crc32(payload) != crc:
        raise ValueError("damaged record")
    return count, plain, payload


def write(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Write every whole text's ids and END to folder, in ascending order of the id.

    Null is the empty text. Rows with a null id come first; rows that repeat an id are dealt and ordered by
    a hash of the text, then by the text, so that reruns agree. The number of shards follows the characters of all texts.
    """
    if shards is None:
        chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first().n
        shards = max(1, -(-int(chars) // SHARD_CHARS))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        shard, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        waiting = 0

        def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, seq
            ids = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
            full = LANES * BLOCK
            while len(ids) >= full or all_of_it and len(ids):
                some, ids = ids[:full], ids[full:]
                blocks = [some[a : a + BLOCK] for a in range(0, len(some), BLOCK)]
                coded = encode(blocks)
                records = [record(b"LFB1", len(b), b.astype("<u4").tobytes(), c) for b, c in zip(blocks, coded, strict=True)]
                for a in range(0, len(records), 256):
                    part = records[a : a + 256]
                    yield batch(1, range(seq + a, seq + a + len(part)), part)
                seq += len(records)
            held, waiting = [ids], len(ids)

        def batch(kind: int, seqs: range, records: list[bytes]) -> pa.RecordBatch:
            n = len(records)
            return pa.record_batch({"shard": pa.array([shard] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "seq": pa.array(list(seqs), pa.int32()), "record": pa.array(records, pa.binary())})

        for n, b in enumerate(batches):
            sizes = []
            for ids in words(b.column("text")):
                held.append(ids)
                sizes.append(len(ids))
                waiting += len(ids)
                if waiting >= LANES * BLOCK:
                    yield from flush(False)
            if sizes:
                doc, null = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                plain = doc.astype("<i8").tobytes() + np.asarray(sizes).astype("<u8").tobytes() + null.astype(np.uint8).tobytes()
                yield batch(0, range(n, n + 1), [record(b"LFI1", len(sizes), plain, plain)])
        yield from flush(True)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order).mapInArrow(code, SCHEMA).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, at, n_tokens, ids_crc32) of a folder of shards; at counts from the shard's start.

    Every checksum is compared; a damaged or missing record raises an error.
    """

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["shard"]):
            cut = bounds(table, ["shard"])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield from shard_of(table.slice(int(lo), int(hi - lo)))

    def shard_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds, shard = t.column("kind").to_numpy(), t.column("shard")[0].as_py()
        split = int((kinds == 0).sum())
        ids, sizes, nulls = [], [], []
        for data in t.column("record").slice(0, split).to_pylist():
            count, crc, plain = opened(data, b"LFI1")
            if zlib.crc32(plain) != crc:
                raise ValueError("damaged index")
            ids.append(np.frombuffer(plain, dtype="<i8", count=count))
            sizes.append(np.frombuffer(plain, dtype="<u8", offset=8 * count, count=count).astype(np.int64))
            nulls.append(np.frombuffer(plain, dtype=np.uint8, offset=16 * count, count=count) > 0)
        docs, size, null = np.concatenate(ids), np.concatenate(sizes), np.concatenate(nulls)
        ends, crcs, k, at, crc = np.cumsum(size), np.zeros(len(docs), dtype=np.int64), 0, 0, 0
        for a in range(split, t.num_rows, LANES):
            heads = [opened(data, b"LFB1") for data in t.column("record").slice(a, min(LANES, t.num_rows - a)).to_pylist()]
            blocks = decode([p for _, _, p in heads], [n for n, _, _ in heads])
            for (_, want, _), block in zip(heads, blocks, strict=True):
                raw = memoryview(block.astype("<u4").tobytes())
                if zlib.crc32(raw) != want:
                    raise ValueError("damaged block")
                done = 0
                while k < len(docs) and ends[k] <= at + len(block):
                    to = int(ends[k]) - at
                    crcs[k] = zlib.crc32(raw[4 * done : 4 * to], crc)
                    done, crc, k = to, 0, k + 1
                crc = zlib.crc32(raw[4 * done :], crc)
                at += len(block)
        if k < len(docs) or at != (ends[-1] if len(ends) else 0):
            raise ValueError("missing block")
        yield pa.record_batch({"shard": pa.array(np.full(len(docs), shard, dtype=np.int32)), "doc_id": pa.array(docs, mask=null), "at": pa.array(ends - size), "n_tokens": pa.array(size), "ids_crc32": pa.array(crcs)})

    table = spark.read.schema(SCHEMA).parquet(folder)
    return table.repartition("shard").sortWithinPartitions("shard", "kind", "seq").mapInArrow(open_all, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write docs' ids to folder (a new one in the shared folder) and read them back: one row per row of docs.

    doc_id, start (ids of all documents before it, in ascending order of the id), n_tokens (END
    included), ids_crc32. Null texts are empty; rows with a null id come first; of one id, the row whose text has
    the smaller hash. Extra columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/lithoframe/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, folder, key, text)
    found = read(spark, folder)
    found = staged(found, "tokens-index")
    shard = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a shard
    shard = shard.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    return found.join(shard, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
