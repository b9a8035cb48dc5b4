import math
import random

import numpy as np

from siftwell.llm.mixing import BITS, TEMPERATURES, mixing_rates, named, resample


def made(n=200, seed=1):
    rng = random.Random(seed)
    words = {"en": ["the", "with", "what", "keep"], "de": ["für", "über", "groß", "zehn"], "fr": ["été", "être", "ça", "que"]}
    docs = []
    for i in range(n):
        lang = rng.choice(["en"] * 6 + ["de", "fr"])
        docs.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 60))), lang, "x", 0))
    return docs


def brute(docs, labelled, folds, targets, keep):
    """Posteriors and wanted totals, word by word."""
    domains = sorted(targets)
    words = [(d[1] or "").lower().split() for d in docs]
    tokens = np.array([len(w) for w in words], float)
    own = [i for i, d in enumerate(docs) if d[0] in labelled and d[2] in domains]
    fitted = [i for i in own if folds[docs[i][0]] != 0]
    vocabulary = sorted({w for i in fitted for w in words[i]})
    share = np.zeros((len(domains), len(vocabulary)))
    for k, d in enumerate(domains):
        c = np.array([1 + sum(words[i].count(w) for i in fitted if docs[i][2] == d) for w in vocabulary], float)
        share[k] = np.log(c / (c.sum() - len(vocabulary) + (1 << BITS)))
    share -= share.mean(0)
    prior = np.array([math.log((sum(docs[i][2] == d for i in own) + 1) / (len(own) + len(domains))) for d in domains])
    e = np.array([[sum(share[k, vocabulary.index(w)] for w in ws if w in vocabulary) for k in range(len(domains))] for ws in words])
    held = [i for i in own if folds[docs[i][0]] == 0]

    def p_at(t):
        z = prior + e / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    t = min(TEMPERATURES, key=lambda t: -sum(math.log(p_at(t)[i, domains.index(docs[i][2])]) for i in held))
    return tokens, p_at(t), np.array([targets[d] for d in domains]) / sum(targets.values()) * keep * tokens.sum()


def test_targets_are_met_and_posteriors_match(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, tokens long")
    labels = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    folds = {r._id: r._fold for r in named(labels).collect()}
    targets = {"en": 0.4, "de": 0.3, "fr": 0.3}
    got = sorted(mixing_rates(df, labels, targets, keep=0.3).collect(), key=lambda r: r.doc_id)
    tokens, p, want = brute(docs, set(range(0, 200, 2)), folds, targets, 0.3)
    assert [r.tokens for r in got] == tokens.tolist()
    mine = np.array([[r.p_de, r.p_en, r.p_fr] for r in got])
    assert np.allclose(mine, p, atol=1e-9)
    x = np.array([r.rate for r in got])
    assert (x >= 0).all()
    assert np.allclose((x * tokens) @ p, want, rtol=1e-3) and {r.gap < 1e-3 for r in got} == {True}
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    rows = resample(df, spark.createDataFrame(got))
    assert rows.columns == df.columns
    assert rows.count() == sum(r.copies for r in got)


def test_posteriors_of_unlabelled_rows_are_right(spark):
    """Held-out accuracy and calibration on a thousand documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = docs.where("doc_id % 2 = 0").select("doc_id")
    domains = sorted(r[0] for r in docs.select("lang").distinct().collect())
    rows = mixing_rates(docs, labels, dict.fromkeys(domains, 1.0)).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    sure = [max(domains, key=lambda d: r[f"p_{d}"]) == r.lang for r in rows]
    confidence = [max(r[f"p_{d}"] for d in domains) for r in rows]
    assert np.mean(sure) > 0.95 and abs(np.mean(sure) - np.mean(confidence)) < 0.05


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(i, "a b c", "en") for i in range(20)], "doc_id long, text string, lang string")
    got = mixing_rates(df, df.select("doc_id"), {"en": 1.0, "zz": 1.0}).collect()
    assert {round(r.gap, 3) for r in got} != {0.0} and all(r.rate >= 0 for r in got)


def test_very_long_texts(spark):
    df = spark.createDataFrame([(i, ("the " if i % 2 else "für ") * (200_000 if i < 2 else 50), "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in mixing_rates(df, df.select("doc_id"), {"en": 1.0, "de": 1.0}).collect()}
    assert got[0].tokens == 200_000 and got[0].p_de > 0.9 and got[1].p_en > 0.9


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, p double"
    labels = spark.createDataFrame([(1,), (None,)], "doc_id long")
    none = spark.createDataFrame([], schema)
    assert mixing_rates(none, labels, {"en": 1.0}).count() == 0
    df = spark.createDataFrame([(1, None, "en", 1.0), (None, "a b", None, 1.0), (2, "", "de", 1.0), (2, "", "de", 1.0)], schema)
    got = mixing_rates(df, labels, {"en": 1.0, "zz": 1.0})
    assert got.count() == 4
    assert all(r.rate >= 0 and math.isfinite(r.rate) for r in got.collect())
    assert resample(df, got).where("doc_id IS NULL").count() == 1
    only = spark.createDataFrame([(1, None, "en", 1.0)], schema)
    assert mixing_rates(only, labels, {"en": 1.0}).first().tokens == 0


def test_registered_rates_keep_all_tokens(spark, sf_dir):
    from siftwell.llm.queries import op4_source_mixing

    rows = op4_source_mixing(spark, sf_dir).collect()
    assert math.isclose(sum(r.rate * r.tokens for r in rows), sum(r.tokens for r in rows), rel_tol=1e-3)
