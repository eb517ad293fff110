"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language come from a bounded sample of labelled rows; the log-probability matrix
(hash cells x languages, both bounded) is broadcast, and batches are scored in numpy by summing matrix
rows over the n-grams of each text. Texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import trimmed

#: Hash cells, n-gram lengths, and characters handled at once.
CELLS, ORDERS, PIECE = 1 << 16, (1, 2, 3), 1 << 20
#: Training rows of a language at most, about (a hash of the text picks them), and languages at most.
TRAIN_ROWS, MAX_LANGUAGES = 8_000, 512
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def pieces(texts: list[str | None], limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts as code points, some at a time: (document of each piece, start of each, code points).

    A text over the limit comes in several pieces. Each piece is followed by the next len(ORDERS) - 1
    characters of its text or by blanks, so that every n-gram is counted once, where it starts.
    """
    tail = max(ORDERS) - 1
    docs, parts, room = [], [], limit
    for i, t in enumerate(texts):
        t = t or ""
        for a in range(0, max(1, len(t)), limit):
            piece = t[a : a + limit]
            if parts and len(piece) > room:
                yield _joined(docs, parts)
                docs, parts, room = [], [], limit
            docs.append(i)
            parts.append((piece, (t[a + limit : a + limit + tail] + " " * tail)[:tail]))
            room -= len(piece) + tail
    if parts:
        yield _joined(docs, parts)


def _joined(docs: list[int], parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(p + q for p, q in parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter((len(p) + len(q) for p, q in parts), dtype=np.int64, count=len(parts))
    return np.asarray(docs), np.concatenate([[0], np.cumsum(size)]), code


def cells(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each piece, offsets, cells): cells of the n-grams of the pieces' letters, in order."""
    tail = max(ORDERS) - 1
    for docs, start, code in pieces(texts):
        is_letter = letters()[np.minimum(code, 0x10FFFF)]
        c = np.where(is_letter, code, 32).astype(np.uint32)
        own = np.ones(len(c), dtype=bool)
        for k in range(1, tail + 1):
            own[start[1:] - k] = False  # the characters that only follow a piece
        near = is_letter.copy()
        near[:-1] |= is_letter[1:]
        at = np.flatnonzero(own & near)
        at = at[at + tail < len(c) + 0] if len(at) and at[-1] + tail >= len(c) else at
        offset = np.searchsorted(at, start)
        out = np.empty((len(at), len(ORDERS)), dtype=np.uint32)
        h = np.zeros(len(at), dtype=np.uint32)
        for k in range(max(ORDERS)):
            h = (h ^ c[at + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                out[:, ORDERS.index(k + 1)] = (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        yield docs, offset, out


def score(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-probabilities (documents x languages, without the prior), and letters' n-grams of each."""
    total = np.zeros((len(texts), matrix.shape[1]))
    seen = np.zeros(len(texts), dtype=np.int64)
    for docs, offset, found in cells(texts):
        n = np.diff(offset)
        full = n > 0
        if full.any():
            for k in range(found.shape[1]):
                np.add.at(total, docs[full], np.add.reduceat(matrix[found[:, k]], offset[:-1][full], axis=0, dtype=np.float64))
            np.add.at(seen, docs[full], n[full])
    return total, seen


def train(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix as float32, log prior) from rows where `where` holds.

    Rows with a null language or text don't count. No training rows: no languages.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), where.alias("use")).filter(F.col("use") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r.lang, int(r.n)) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [x for x, _ in counts]
    if not names:
        return [], np.zeros((CELLS, 0), dtype=np.float32), np.zeros(0)
    share = spark.createDataFrame([(x, k, min(1.0, rows / n)) for k, (x, n) in enumerate(counts)], "lang string, k int, share double")
    picked = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    languages = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column("k").to_numpy()
            texts = batch.column("text").to_pylist()
            for language in np.unique(k):
                mine = [t.lower() for t, x in zip(texts, k, strict=True) if x == language]
                total = sums.setdefault(int(language), np.zeros(CELLS, dtype=np.int64))
                for _, _, found in cells(mine):
                    total += np.bincount(found.ravel(), minlength=CELLS)
        for language, total in sums.items():
            cell = np.flatnonzero(total)
            yield pa.record_batch({"k": pa.array(np.full(len(cell), language, dtype=np.int32)), "cell": pa.array(cell.astype(np.int32)), "n": pa.array(total[cell])})

    found = picked.select("k", "text").mapInArrow(trimmed(count), "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.ones((CELLS, languages))  # at most CELLS x MAX_LANGUAGES
    np.add.at(n, (found["cell"].to_numpy(), found["k"].to_numpy()), found["n"].to_numpy(dtype=np.float64))
    prior = np.log(np.asarray([x for _, x in counts], dtype=np.float64) / sum(x for _, x in counts))
    return names, np.log(n / n.sum(axis=0)).astype(np.float32), prior


def identify(docs: DataFrame, where: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (posterior of the predicted language).

    `where` picks the training rows. A text that is null or has no letter, and every text when no row
    trains, is `und` with score 0. Ties go to the language first in code-point order. Case is ignored.
    Repeated, extra or clashing columns don't matter; an empty table gives no rows.
    """
    label = labeller(docs, where, text, lang, rows)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, value = label(batch.column("text").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(value)})

    rows_in = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def labeller(docs: DataFrame, where: Column, text: str, lang: str, rows: int):
    """Train on docs; the function that labels texts: (predicted languages, scores)."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, where, text, lang, rows))

    def label(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, matrix, prior = held.value
        if not names or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total, seen = score([t.lower() if t else "" for t in texts], matrix)
        total += prior
        value = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        value[seen == 0] = 0
        return [names[b] if n else UNDETERMINED for b, n in zip(total.argmax(axis=1), seen, strict=True)], value

    return label


def keep_identified(docs: DataFrame, where: Column, least: float = 0.5, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows whose language is undetermined or scored below `least`; nothing is shuffled."""
    label = labeller(docs, where, text, lang, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, value = label(batch.column(text).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED for x in names]) if least <= 0 else pa.array(value >= least))

    return docs.mapInArrow(trimmed(keep), docs.schema)
