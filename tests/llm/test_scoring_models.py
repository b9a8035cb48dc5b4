import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm.features import Hasher, collect_sample
from siftwell.llm.nbsvm import score_quality
from siftwell.llm.rolling import Batch
from siftwell.llm.toxicity import fit_chain, probability, score_toxicity


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    words = ["the", "stone", "river", "light", "is", "of", "and", "green"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "moron"]))
        docs.append((i, " ".join(w), rng.choice(["en", "de"])))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_hashed_presence_counts_once():
    texts = ["abab", "", None, "ab cd ab cd", "x" * 5000]
    h = Hasher(orders=(1, 2, 0, -1), bits=12, lower=True)
    batch = Batch(pa.array(texts, pa.string()))
    ids = list(h.unique_ids(batch))
    w = np.random.default_rng(0).normal(size=(h.size, 2))
    sums = h.presence_sums(batch, w)
    assert np.allclose(sums, [w[x].sum(0) for x in ids])
    assert len(ids[1]) == len(ids[2]) == 0 and len(ids[4]) == 3
    alone = [x for t in texts for x in h.unique_ids(Batch(pa.array([t], pa.string())))]
    assert all((a == b).all() for a, b in zip(ids, alone, strict=True))


def test_quality_is_learned_without_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (1000, None, "en"), (1001, "", "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in score_quality(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    import zlib

    assert len(rows) == len(docs) + 2
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[i].predicted, q) for i, q, _ in labels if rows[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert rows[1000].score == rows[1001].score
    # labels of held-out rows make no difference
    turned = [(i, 1 - q if rows[i].held_out else q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in score_quality(d, spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).collect()}
    assert all(abs(again[i] - rows[i].score) < 1e-9 for i in rows)


def test_toxic_documents_are_found(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    cats = {"english": F.col("toxic") * (F.col("lang") == "en").cast("int"), "any": F.col("toxic")}
    rows = {r.doc_id: r for r in score_toxicity(d, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"), cats).collect()}
    rest = [(rows[i].predicted, t) for i, _, t in labels[300:]]
    assert np.mean([p == t for p, t in rest]) > 0.95
    assert rows[0].asDict().keys() == {"doc_id", "english", "any", "predicted"}


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(None, 1, 1), (7, None, None)]])
def test_odd_labels_and_rows(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "a b", "en", 0.1, 1), (None, None, None, None, None), (1, "a b", "en", 0.1, 1)], "doc_id long, text string, lang string, score double, ids int")
    q = score_quality(d, lab).collect()
    assert len(q) == 3 and all(0 < r.score < 1 for r in q) and sum(r.held_out is None for r in q) == 1
    t = score_toxicity(d, lab, {"any": F.col("toxic")}).collect()
    assert len(t) == 3 and all(0 < r["any"] < 1 for r in t)
    assert score_quality(d.limit(0), lab).count() == 0 and score_toxicity(d.limit(0), lab, {"any": F.col("toxic")}).count() == 0


def test_the_chain_beats_models_on_their_own():
    """A rare category inside a common one: its link learns from the earlier category's probabilities."""
    rng = np.random.default_rng(6)
    n, size = 900, 1 << 12
    toxic, english = rng.random(n) < 0.4, rng.random(n) < 0.15
    ids = []
    for t, e in zip(toxic, english, strict=True):
        x = [rng.integers(100, size, 30)]
        x.append(rng.integers(0, 12, 2) if t else x[0][:0])
        x.append(rng.integers(40, 44, 2) if e else rng.integers(60, 64, 2))
        ids.append(np.unique(np.concatenate(x)).astype(np.int32))
    y = (toxic & english).astype(int)
    fit, rest = slice(0, 450), range(450, n)

    def loss(chain):
        out = []
        for i in rest:
            p = []
            for w, d, b in chain:
                p.append(float(probability(np.array(w[ids[i]].sum() + b + np.dot(p, d)))))
            out.append(-np.log(max(p[-1] if y[i] else 1 - p[-1], 1e-12)))
        return np.mean(out)

    chain = fit_chain(ids[fit], [toxic[fit].astype(int), y[fit]], size)
    alone = fit_chain(ids[fit], [y[fit]], size)
    assert chain[1][1][0] > 0 and loss(chain) < loss(alone)


def test_samples_stay_within_their_bytes(spark):
    rows = spark.createDataFrame([(i, "word " * 20 + f"x{i}") for i in range(50)] + [(3, "twice")], "doc_id long, text string")
    h = Hasher(orders=(0,), bits=12, lower=True)
    ids, got = collect_sample(rows, h, ["doc_id"], most_bytes=8 * 10)
    assert 0 < len(ids) <= 10 and sum(len(x) * 4 for x in ids) <= 80
    ids, got = collect_sample(rows, h, ["doc_id"])
    assert len(ids) == 50 == len(set(got["doc_id"].tolist()))


def test_several_label_rows_count_as_the_largest(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    once = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = once.unionByName(once.selectExpr("doc_id", "0 AS quality", "0 AS toxic"))
    a, b = ({r.doc_id: r.score for r in score_quality(d, x).collect()} for x in (once, more))
    assert a == b
    a, b = ({r.doc_id: r["any"] for r in score_toxicity(d, x, {"any": F.col("toxic")}).collect()} for x in (once, more))
    assert a == b
