"""Models against plain solvers and loops over whole tables, packing against the optimum of small cases."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import nbsvm as N
from siftwell.llm import queries as Q
from siftwell.llm import toxicity as T
from siftwell.llm.features import collect_sample, labelled_sample
from siftwell.llm.packing import plan
from siftwell.llm.rolling import Batch


def sample(rng, rows=40, size=25):
    ids = [np.sort(rng.choice(size, rng.integers(1, 8), replace=False)) for _ in range(rows)]
    y = np.array([int(0 in x or (1 in x and 2 in x)) for x in ids])
    y[:4] = (0, 1, 0, 1)
    return ids, y, size


def test_log_count_ratios():
    ids, y, size = sample(np.random.default_rng(1))
    got = N.log_count_ratio(ids, y, size)
    for f in range(size):
        p, q = (1 + sum(f in x for x, label in zip(ids, y, strict=True) if label == k) for k in (1, 0))
        a, b = (sum(1 + sum(g in x for x, label in zip(ids, y, strict=True) if label == k) for g in range(size)) for k in (1, 0))
        assert got[f] == pytest.approx(math.log(p / a) - math.log(q / b))


@pytest.mark.parametrize("seed", range(3))
def test_dual_coordinate_descent_reaches_the_optimum(seed):
    """The hinge-loss objective comes within a thousandth of what projected gradient steps on the whole dual reach."""
    ids, y, size = sample(np.random.default_rng(seed))
    ratio = N.log_count_ratio(ids, y, size)
    x = np.zeros((len(ids), size + 1))
    for i, own in enumerate(ids):
        x[i, own] = ratio[own]
        x[i, -1] = 1.0  # the intercept is a weight like the others
    sign = np.where(y == 1, 1.0, -1.0)

    def objective(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()

    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, step = np.zeros(len(ids)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, 1)
    best = objective((alpha * sign) @ x)
    w, b = N.dual_coordinate_descent(ids, y, ratio, epochs=400)
    plain = np.r_[np.divide(w, ratio, out=np.zeros(size), where=ratio != 0), b]
    assert best * (1 - 1e-6) <= objective(plain) <= best * 1.001


def test_quality_of_every_row_by_a_loop(spark, sf_dir):
    """The registered query against the fitted weights, summed document by document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    ids, got = collect_sample(labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), N.MAX_TRAINING_ROWS, allowed=remainder != 0, columns=("quality",)), N.HASHER, ["quality", "doc_id"])
    w, b = N.fit(ids, got["quality"], N.HASHER.size)
    rows = docs.select("doc_id", "text").collect()
    seen = N.HASHER.unique_ids(Batch(pa.array([r.text for r in rows], pa.large_string())))
    want = {r.doc_id: 1 / (1 + math.exp(-(w[x].sum() + b))) for r, x in zip(rows, seen, strict=True)}
    made = Q.op10_quality_nbsvm(spark, sf_dir).collect()
    assert len(made) == len(rows)
    for r in made:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_logistic_links_stand_at_the_optimum():
    rng = np.random.default_rng(4)
    ids, y, size = sample(rng, 80)
    dense = rng.random((80, 2))
    w, d, b = T.logistic(T.Sparse(ids, dense), y, size, steps=3000, rate=0.02)
    x = np.zeros((80, size + 3))
    for i, own in enumerate(ids):
        x[i, own] = 1
    x[:, size : size + 2], x[:, -1] = dense, 1
    weights = np.zeros(size + 3)
    penalty = np.r_[np.ones(size + 2), 0.0]
    for _ in range(60):  # Newton steps on the same penalised loss
        p = 1 / (1 + np.exp(-(x @ weights)))
        g = x.T @ (p - y) + penalty * weights
        weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-12 * np.eye(size + 3), g)
    assert np.allclose(np.r_[w, d, b], weights, atol=2e-2)


def test_toxicity_of_every_row_by_a_loop(spark, sf_dir):
    """The registered call: categories in chain order, the last link decides, every probability from a plain loop."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    english = F.col("lang") == "en"
    categories = {"toxic_english": F.col("toxic") * english.cast("int"), "toxic_other": F.col("toxic") * (~english).cast("int"), "toxic": F.col("toxic")}
    some = labelled_sample(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "toxic"), T.MAX_TRAINING_ROWS, columns=("toxic",), keep=("lang",))
    some = some.select("doc_id", "text", *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"category_{i}") for i, c in enumerate(categories.values())))
    ids, got = collect_sample(some, T.HASHER, [*(f"category_{i}" for i in range(3)), "doc_id"])
    chain = T.fit_chain(ids, [got[f"category_{i}"] for i in range(3)], T.HASHER.size)
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r, x in zip(rows, T.HASHER.unique_ids(Batch(pa.array([r.text for r in rows], pa.large_string()))), strict=True):
        p = []
        for w, d, b in chain:
            p.append(1 / (1 + math.exp(-(w[x].sum() + b + sum(q * v for q, v in zip(p, d, strict=True))))))
        want[r.doc_id] = p
    made = Q.op5_toxicity_chain(spark, sf_dir).collect()
    assert list(made[0].asDict()) == ["doc_id", *categories, "predicted"] and len(made) == len(rows)
    for r in made:
        assert [r[c] for c in categories] == pytest.approx(want[r.doc_id], abs=1e-5)
        assert r.predicted == int(r.toxic >= 0.3)
    assert any(np.abs(chain[2][1]) > 1e-3)  # the deciding link uses what the earlier ones say


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_take_the_fewest_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 33, rng.integers(1, 9)).tolist()

    def fewest():
        for k in range(1, len(lengths) + 1):
            for where in itertools.product(range(k), repeat=len(lengths)):
                if where[0] == 0 and max(np.bincount(where, weights=lengths, minlength=k)) <= 32:
                    return k
        return 0

    rules = plan(np.bincount(lengths, minlength=33), 32)
    assert rules[:, 2].sum() == len(lengths)
    used = int((rules[:, 3] + rules[:, 2]).max())
    assert fewest() <= used <= fewest() + (len(lengths) > 5)


def test_very_long_texts(spark):
    """A text of some ten megabytes is scored like any other."""
    long = "alpha beta gamma delta " * 500_000
    docs = spark.createDataFrame([(i, f"good words here number {i}" if i % 2 else f"bad ones there {i}", "en") for i in range(60)] + [(100, long, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    r = N.score_quality(docs, labels).where("doc_id = 100").first()
    t = T.score_toxicity(docs, labels, {"toxic": F.col("toxic")}).where("doc_id = 100").first()
    assert 0 <= r.score <= 1 and 0 <= t.toxic <= 1
