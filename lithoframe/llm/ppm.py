"""Language-model scores by prediction by partial matching over bytes, with symbol exclusion.

The context trie is a family of tables: for each order k, the counts of (k context bytes, next symbol)
in the training texts, packed in one long. At the longest order they are counts of occurrences, below
it of the distinct longer contexts (update exclusion); escapes are estimated by discounting (method D). Code lengths of the distinct n-grams of the corpus come
from joins between neighbouring orders, so neither the trie nor the vocabulary has to fit in one place.

Texts are cut into chunks of a few MB. Each chunk has a dictionary of its distinct words and n-grams;
only dictionaries are counted, joined and sent back, and the chunk's texts are then scored in numpy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.llm.common import discard, staged
from lithoframe.llm.groups import bounds, runs

#: Longest context in bytes (6 at most), bits of a symbol, symbol that ends a text, symbols that can be coded.
ORDER, BITS, END, ALPHABET = 5, 9, 257, 257
#: Taken from every count for the escape.
DISCOUNT = 0.5
#: Bytes of text of a chunk, about; one longer text is a chunk of its own.
CHUNK = 32 << 20
#: Bytes of a chunk whose words and n-grams are numbered at once.
PIECE = 4 << 20
#: Rows that a task packs at once.
PACK_ROWS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

CHUNK_SCHEMA = "chunk long, ids array<long>, held array<boolean>, starts array<long>, body binary"


def chunked(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, held, text) -> chunks: ids, held flags, starts (and the end) of texts, lower-cased and compressed bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, room = TaskContext.get().partitionId() << 32, 0
        ids, held, sizes, parts = [], [], [], []

        def out() -> pa.RecordBatch:
            body = np.concatenate(parts)
            np.take(_LOWER, body, out=body)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            binary = pa.array([zstandard.compress(body, 3)], pa.binary())
            return pa.record_batch({"chunk": pa.array([n]), "ids": pa.ListArray.from_arrays(pa.array([0, len(starts) - 1], pa.int32()), pa.concat_arrays(ids)), "held": pa.array([np.concatenate(held)], pa.list_(pa.bool_())), "starts": pa.array([starts], pa.list_(pa.int64())), "body": binary})

        for b in batches:
            long_ = pa.types.is_large_string(b.column("text").type)
            at = np.frombuffer(b.column("text").buffers()[1], dtype=np.int64 if long_ else np.int32)[b.column("text").offset :][: b.num_rows + 1]
            flat = np.frombuffer(b.column("text").buffers()[2] or b"", dtype=np.uint8)
            doc, out_ = b.column("doc_id"), b.column("held").to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = int(np.searchsorted(at, at[lo] + max(0, size - room), side="right")) - 1
                if hi <= lo:
                    if parts:
                        yield out()
                        n, room, ids, held, sizes, parts = n + 1, 0, [], [], [], []
                        continue
                    hi = lo + 1
                hi = min(hi, b.num_rows)
                ids.append(doc.slice(lo, hi - lo))
                held.append(out_[lo:hi])
                sizes.append(np.diff(at[lo : hi + 1]))
                parts.append(flat[at[lo] : at[hi]].copy())
                room += int(at[hi] - at[lo])
                lo = hi
        if parts:
            yield out()

    return texts.mapInArrow(cut, CHUNK_SCHEMA)


def word_codes(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, offsets of the texts in the words), in order of appearance."""
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < len(raw))]
    first[inner] = word[inner]
    at = np.flatnonzero(first)
    compact = raw[word]
    place = np.cumsum(word) - 1
    offsets = np.append(place[at], len(compact)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(compact)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(at, starts)


def gram_codes(raw: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct packed n-grams, number of each coded symbol's, offsets of the texts in the symbols).

    Every text is preceded by `order` zeros and followed by END, so its contexts hold nothing of others.
    """
    n = np.diff(starts)
    size = n + order + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    s = np.zeros(begin[-1], dtype=np.int16)
    own = np.ones(len(s), dtype=bool)
    for k in range(order):
        own[begin[:-1] + k] = False
    ends = begin[1:] - 1
    own[ends] = False
    s[own] = raw.astype(np.int16) + 1
    s[ends] = END
    own[ends] = True
    key = s.astype(np.int64)
    for k in range(1, order + 1):
        for a in range(k, len(key), 1 << 20):  # in pieces, for memory
            to = min(len(key), a + (1 << 20))
            key[a:to] |= s[a - k : to - k].astype(np.int64) << (BITS * k)
    key = key[own]
    code, distinct = pd.factorize(key)
    return distinct, code, np.concatenate([[0], np.cumsum(n + 1)])


def pieces(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some texts of a chunk at a time: (first text, text after the last, their bytes, their starts)."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
        yield a, b, raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        a = b


def merged(parts: list) -> tuple[pa.Array | np.ndarray, list[np.ndarray]]:
    """Distinct entries of all parts in order of appearance, and the number of each part's entries."""
    if parts and isinstance(parts[0], pa.Array):
        coded = pa.concat_arrays(parts).dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    else:
        code, distinct = pd.factorize(np.concatenate(parts))
    return distinct, np.split(code, np.cumsum([len(p) for p in parts])[:-1])


def _opened(row: pa.RecordBatch | pa.Table, k: int, text: str = "body") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body, starts, held = (row.column(c)[k] for c in (text, "starts", "held"))
    raw = np.frombuffer(zstandard.decompress(body.as_buffer()), dtype=np.uint8)
    return raw, starts.values.to_numpy(), np.asarray(held.as_py(), dtype=bool)


def _dictionary(chunks: DataFrame, kind: str, order: int) -> DataFrame:
    """(chunk, idx, entry, n): the distinct words or n-grams of each chunk, and how often training texts have them."""

    coder = word_codes if kind == "word" else partial(gram_codes, order=order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw, starts, held = _opened(b, k)
                parts, counts = [], []
                for a, z, some, at in pieces(raw, starts):
                    distinct, code, at = coder(some, at)
                    parts.append(distinct)
                    counts.append(np.bincount(code[np.repeat(~held[a:z], np.diff(at))], minlength=len(distinct)))
                entries, numbers = merged(parts)
                n = np.zeros(len(entries), dtype=np.int64)
                for number, c in zip(numbers, counts, strict=True):
                    n[number] += c
                entries = entries.cast(pa.string()) if kind == "word" else pa.array(entries)
                chunk = pa.array(np.full(len(entries), b.column("chunk")[k].as_py(), dtype=np.int64))
                whole = pa.record_batch({"chunk": chunk, "idx": pa.array(np.arange(len(entries), dtype=np.int32)), "entry": entries, "n": pa.array(n)})
                for a in range(0, len(entries), 65_536):
                    yield whole.slice(a, 65_536)

    return chunks.select("chunk", "held", "starts", "body").mapInArrow(count, f"chunk long, idx int, entry {'string' if kind == 'word' else 'long'}, n long")


def _mask(k: int) -> int:
    return (1 << (BITS * (k + 1))) - 1


def code_lengths(grams: DataFrame, order: int) -> DataFrame:
    """(entry, n) of all n-grams, n the training count (0: only to be scored) -> (entry, logp), log10.

    For order k let ctx be the last k symbols: n(ctx) is the sum of the counts after it, q(ctx) the
    number of distinct symbols. With d = DISCOUNT, a seen symbol has (c - d) / n, the escape d q / n. After
    an escape, the symbols seen in the longer context are excluded below: their counts and their number
    are taken out of n and q. If none is left below, the escape goes on for nothing.
    Below order 0, the symbols never seen share the rest evenly. Contexts never seen are skipped
    without an escape.

    Going up the orders, `low` is the log-probability of a symbol by the orders below k once ctx has been
    escaped from, and `logp` the one that starts at the longest seen context of at most k symbols. Each
    order joins its n-grams to those one shorter and takes sums over each context's symbols (257 at most).
    """
    at: dict[int, DataFrame] = {order: grams.select(F.col("entry").alias("key"), F.when(F.col("n") > 0, F.col("n")).alias("c"))}
    for k in range(order - 1, -1, -1):
        up = at[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.count("c").alias("c"))
        at[k] = staged(up.select("key", F.when(F.col("c") > 0, F.col("c")).alias("c")), f"ppm-keys-{k}")
    context = W.partitionBy(F.shiftright("key", BITS))
    below = None
    for k in range(order + 1):
        rows = at[k]
        if k:
            short = below.select(F.col("key").alias("down"), F.col("c").alias("sc"), F.col("n").alias("sn"), F.col("q").alias("sq"), F.col("low").alias("slow"), F.col("logp").alias("shorter"))
            rows = rows.withColumn("down", F.col("key").bitwiseAND(F.lit(_mask(k - 1)))).join(short, "down").drop("down")
        rows = rows.withColumn("n", F.sum("c").over(context)).withColumn("q", F.count("c").over(context))
        if k:
            rows = rows.withColumn("free", F.col("sn") - F.sum(F.when(F.col("c").isNotNull(), F.col("sc"))).over(context)).withColumn("more", F.col("sq") - F.col("q"))
            some, all_left = F.col("more") > 0, F.log10(F.col("free").cast("double"))
            left_all = F.when(some, all_left).otherwise(0.0)
            low = F.when(F.col("sc").isNotNull(), F.log10(F.col("sc") - DISCOUNT) - left_all).otherwise(F.when(some, F.log10(DISCOUNT * F.col("more")) - all_left).otherwise(0.0) + F.col("slow"))
        else:
            low = -F.log10(F.greatest(F.lit(ALPHABET) - F.col("q"), F.lit(1)).cast("double"))
            rows = rows.withColumn("shorter", low)
        rows = rows.withColumn("low", low)
        log_n = F.log10(F.col("n").cast("double"))
        logp = F.when(F.col("c").isNotNull(), F.log10(F.col("c") - DISCOUNT) - log_n).when(F.col("q") > 0, F.log10(DISCOUNT * F.col("q")) - log_n + F.col("low")).otherwise(F.col("shorter"))
        rows = rows.withColumn("logp", logp)
        shorter, below = below, staged(rows.select("key", "logp") if k == order else rows.select("key", "c", "n", "q", "low", "logp"), f"ppm-order-{k}")
        discard(*([at[k]] if k < order else []), *([shorter] if k else []))
    return below.select(F.col("key").alias("entry"), "logp")


def _packed(rows: DataFrame, kind: int) -> DataFrame:
    """(chunk, idx, value) -> (chunk, kind, data): what a task has of a chunk, sorted and compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            chunk, idx, value = (t.column(c).to_numpy() for c in ("chunk", "idx", "value"))
            order = np.lexsort((idx, chunk))
            chunk, idx, value = chunk[order], idx[order], value[order]
            cut = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
            data = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                step = np.diff(idx[a:b], prepend=0).astype("<i4")
                code, table = pd.factorize(value[a:b])  # few values are distinct
                data.append(struct.pack("<II", b - a, len(table)) + zstandard.compress(b"".join(_planes(x) for x in (step, code.astype("<i4"))) + table.astype("<f8").tobytes(), 1))
            yield pa.record_batch({"chunk": pa.array(chunk[cut[:-1]]), "kind": pa.array(np.full(len(data), kind, dtype=np.int32)), "data": pa.array(data, pa.binary())})

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK_ROWS:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return rows.mapInArrow(pack, "chunk long, kind int, data binary")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, which compress better."""
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n)
    for d in data:
        size, values = struct.unpack_from("<II", d)
        raw = zstandard.decompress(d[8:])
        step, code = (np.frombuffer(raw, dtype=np.uint8, count=4 * size, offset=4 * size * k).reshape(4, size).T.copy().view("<i4").ravel() for k in (0, 1))
        out[np.cumsum(step)] = np.frombuffer(raw, dtype="<f8", count=values, offset=8 * size)[code]
    return out


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts where `held` isn't true train the trie and the word counts; all are scored, whole. A-Z is
    lower-cased; null is the empty text. score is the log10 probability of the text's bytes and its end
    by the trie. Tokens are the words and one end: n_known of n_tokens occur in training, which has
    train_tokens in all; base_score is the log10 probability by add-half word counts. With nothing
    to train on all symbols are equally likely. Rows with equal or null ids are separate rows; extra
    columns don't matter; an empty table gives no rows.
    """
    held = F.coalesce(held, F.lit(False))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = staged(chunked(texts, chunk), "ppm-chunks")
    words = staged(_dictionary(chunks, "word", order), "ppm-words", "gzip")
    grams = staged(_dictionary(chunks, "gram", order), "ppm-grams")
    vocabulary = staged(words.groupBy("entry").agg(F.sum("n").alias("c")), "ppm-vocabulary")
    ends = int(texts.filter(~F.col("held")).count())
    seen = vocabulary.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(seen.n) + ends, int(seen.v) + (ends > 0)
    below = np.log10(total + 0.5 * (distinct + 1))
    base_end = float(np.log10(ends + 0.5) - below)
    trie = staged(grams.groupBy("entry").agg(F.sum("n").alias("n")), "ppm-trie")
    lengths = code_lengths(trie, order)
    discard(trie)
    told_words = _packed(words.select("chunk", "idx", "entry").join(vocabulary, "entry").select("chunk", "idx", F.col("c").cast("double").alias("value")), 1)
    told_grams = _packed(grams.select("chunk", "idx", "entry").join(lengths, "entry").select("chunk", "idx", F.col("logp").alias("value")), 2)
    nothing = {"ids": "array<long>", "held": "array<boolean>", "starts": "array<long>"}
    blank = [F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    stream = chunks.select("chunk", F.lit(0).alias("kind"), F.col("body").alias("data"), *nothing).union(told_words.union(told_grams).select("chunk", "kind", "data", *blank))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["chunk"]):
            cut = bounds(table, ["chunk"])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield one_chunk(table.slice(int(lo), int(hi - lo)))

    def one_chunk(one: pa.Table) -> pa.RecordBatch:
        raw, starts, held_out = _opened(one, 0, "data")
        kind = one.column("kind").to_numpy()
        told = {k: one.column("data").filter(pa.array(kind == k)).to_pylist() for k in (1, 2)}
        n = len(held_out)
        base_score, logp, n_known, n_tokens = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # Entries are numbered as before: by their first appearance in the pieces.
        for kind_, coder in ((1, word_codes), (2, partial(gram_codes, order=order))):
            distinct, numbers = merged([coder(some, at)[0] for _, _, some, at in pieces(raw, starts)])
            value = _unpacked(told[kind_], len(distinct))
            del distinct
            base = np.log10(value + 0.5) - below if kind_ == 1 else None
            for number, (a, b, some, at) in zip(numbers, pieces(raw, starts), strict=True):
                _, code, at = coder(some, at)
                code, first, full = number[code], at[:-1], np.diff(at) > 0
                sums = lambda v: np.add.reduceat(np.append(v, 0), first) * full  # noqa: E731, B023
                if kind_ == 1:
                    base_score[a:b], n_known[a:b], n_tokens[a:b] = sums(base[code]) + base_end, sums((value[code] > 0).astype(np.int64)) + (ends > 0), np.diff(at) + 1
                else:
                    logp[a:b] = sums(value[code])
        return pa.record_batch({
            "doc_id": one.column("ids")[0].values, "held_out": pa.array(held_out), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(held_out), total, dtype=np.int64)), "base_score": pa.array(base_score), "score": pa.array(logp),
        })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return stream.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, out)
