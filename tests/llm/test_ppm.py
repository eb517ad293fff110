"""The trie against a plain implementation that walks contexts symbol by symbol."""

import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lithoframe.llm import ppm
from lithoframe.llm.queries import op1_ppm_score

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order):
    rows = [(i, held, (t or "").translate(LOWER)) for i, held, t in rows]
    after = defaultdict(Counter)

    def symbols(text):
        s = [0] * order + [b + 1 for b in text.encode()] + [257]
        return [(tuple(s[k - order : k]), s[k]) for k in range(order, len(s))]

    tokens = Counter()
    for _, held, t in rows:
        if not held:
            tokens.update(re.findall(r"[^\x20\x09-\x0D]+", t))
            tokens["\n"] += 1
            for ctx, s in symbols(t):
                after[ctx][s] += 1
    for k in range(order - 1, -1, -1):  # each distinct longer context counts once
        for ctx in [c for c in after if len(c) == k + 1]:
            for s in after[ctx]:
                after[ctx[1:]][s] += 1
    total, distinct = sum(tokens.values()), len(tokens)
    out = {}
    for i, held, t in rows:
        logp = 0.0
        for ctx, s in symbols(t):
            gone = set()
            for k in range(order, -2, -1):
                if k == -1:
                    logp -= math.log10(max(1, 257 - len(gone)))
                    break
                seen = {x: c for x, c in after.get(ctx[order - k :], {}).items() if x not in gone}
                if ctx[order - k :] not in after or not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if s in seen:
                    logp += math.log10((seen[s] - 0.5) / n)
                    break
                logp += math.log10(0.5 * q / n)
                gone |= set(seen)
        words = [*re.findall(r"[^\x20\x09-\x0D]+", t), "\n"]
        base = sum(math.log10((tokens[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        out[i] = (held, len(words), sum(w in tokens for w in words), total, base, logp)
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, logp = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, logp, rel_tol=1e-9, abs_tol=1e-9)


TEXTS = ["Abra cadabra ", None, "", "  x\n\ny\t", "abracadabra abra", "ÄÖ ü ñ   z", "the cat the mat", "zzzz" * 50, "cat\x0bmat", "qQ \x1f\x00 q"]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE", 9)
    rows = [(i, i % 3 == 1, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, h, t, "x", 1) for i, h, t in rows], "doc_id long, out boolean, text string, entry string, n int")
    for order, chunk in ((2, 1 << 20), (4, 20)):
        same(ppm.score(df, F.col("out"), order=order, chunk=chunk).collect(), brute(rows, order))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (1, "a b")], "doc_id long, text string")
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0
    got = ppm.score(df, F.lit(True)).collect()  # nothing trains
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0} and len(got) == 3
    assert all(math.isclose(r.score, -math.log10(257) * (4 if r.doc_id == 1 else 1)) for r in got)


def test_table(spark, data):
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 1, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op1_ppm_score(spark, data).collect()
    same(got, brute(rows, ppm.ORDER))


def test_better_than_words(spark):
    got = [r for r in op1_ppm_score(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
