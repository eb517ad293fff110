"""Quality: every labelled row takes part in the weights and the threshold."""

import numpy as np
from pyspark.sql import functions as F

from lithoframe.llm import quality


def test_the_quantile_is_over_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30_000):
        y = int(i % 3 > 0)
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 6 + y))) for _ in range(rng.integers(3, 12))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.4 - 0.2 * y else w for w in words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    got = quality.rate(df.select("doc_id", "text"), df.select("doc_id", "quality"), F.lit(True)).toPandas()
    assert abs(int(got.predicted.sum()) - 20_000) <= 5
    again = quality.rate(df.repartition(3).select("doc_id", "text"), df.select("doc_id", "quality"), F.lit(True)).toPandas()
    assert (got.set_index("doc_id").score.sort_index() == again.set_index("doc_id").score.sort_index()).all()


def test_a_step_is_that_of_all_pairs():
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.3).astype(np.int64)
    z = quality.standard(rng.normal(size=(400, 13)) + y[:, None] * 0.3, np.zeros(13), np.ones(13))
    w = rng.normal(size=13) * 0.2
    d = (z[y == 1][:, None] - z[y == 0][None, :]).reshape(-1, 13)
    p = 1 / (1 + np.exp(d @ w))
    want = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(13), d.T @ p / len(d) - 1e-3 * w)
    parts = quality.tally(z[:100], y[:100], w) + quality.tally(z[100:], y[100:], w)
    assert (parts == quality.tally(z[::-1], y[::-1], w)).all()
    assert np.abs(quality.newton(parts, w) - want).max() < 5e-3  # cells hold rows of nearly one score


def test_ranks_are_exact(spark):
    x = np.round(np.random.default_rng(5).normal(size=3000), 2) ** 9
    df = spark.createDataFrame([(float(v),) for v in x], "s double")
    assert [quality.at_rank(df, k) for k in (0, 1, 1499, 2998, 2999)] == np.sort(x)[[0, 1, 1499, 2998, 2999]].tolist()
